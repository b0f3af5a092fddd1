"""Shortest paths on a surface: a graph search over points on edges finds a corridor, and the path is pulled straight in it.

The search graph has ``STEINER`` points on each walkable edge (shared by exactly two faces) and the vertices; within a face all
of its points are connected. Pulling straight minimises the length over the crossing points, edge by edge in closed
form (two faces unfolded into a plane), until nothing moves. Where the pulled path is caught at a vertex, the corridor is led
around the vertex on either side, and the shorter of the pulled paths goes on; this ends when no vertex gives a shorter one, so
the result is straight in its corridor and passes vertices only where it must.
"""

from __future__ import annotations

import heapq

import numpy as np

from . import mesh as M
from . import space
from .batch import Failure

STEINER = 7
ROUNDS = 256


def shortest(v: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray, off: float | None = None) -> np.ndarray:
    d, on, face = space.closest(v, t, np.array([start, end], float))
    size = float(np.linalg.norm(v.max(axis=0) - v.min(axis=0)))
    if (d > (off if off is not None else 1e-3 * size + 1e-9)).any():
        raise Failure("Spatial.OffSurface")
    if face[0] == face[1]:
        return on
    edges = {e: f for e, f in M.face_neighbours(t).items() if len(f) == 2}
    nodes = [tuple(p) for p in v]
    by_face: list[list[int]] = [list(map(int, f)) for f in t]
    where: dict[int, tuple[int, int]] = {}
    for (a, b), faces in edges.items():
        for k in range(1, STEINER + 1):
            n = len(nodes)
            nodes.append(tuple(v[a] + (v[b] - v[a]) * k / (STEINER + 1)))
            where[n] = (a, b)
            for f in faces:
                by_face[f].append(n)
    ends = []
    for p, f in zip(on, face, strict=True):
        ends.append(len(nodes))
        nodes.append(tuple(p))
        by_face[f].append(ends[-1])
    spot = np.array(nodes)
    for k, e in enumerate(ends):  # a point on an edge or corner belongs to all faces there
        near = [f for f in np.flatnonzero(np.isin(t, t[face[k]]).any(axis=1)) if f != face[k] and space.closest(v, t[[f]], spot[[e]])[0][0] <= 1e-9 * size]
        for f in near:
            by_face[f].append(e)
    faces_of: dict[int, list[int]] = {}
    for f, members in enumerate(by_face):
        for n in members:
            faces_of.setdefault(n, []).append(f)
    best, back, done = {ends[0]: 0.0}, {}, set()
    heap = [(float(np.linalg.norm(spot[ends[0]] - spot[ends[1]])), ends[0])]
    while heap:
        _, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        if n == ends[1]:
            break
        for f in faces_of[n]:
            others = by_face[f]
            step = np.linalg.norm(spot[others] - spot[n], axis=1)
            for m, s in zip(others, step.tolist(), strict=True):
                c = best[n] + s
                if m not in done and c < best.get(m, np.inf) - 1e-15:
                    best[m], back[m] = c, n
                    heapq.heappush(heap, (c + float(np.linalg.norm(spot[m] - spot[ends[1]])), m))
    if ends[1] not in back:
        raise Failure("Spatial.NoSurfacePath")
    route = [ends[1]]
    while route[-1] != ends[0]:
        route.append(back[route[-1]])
    route.reverse()
    # a crossing is an edge, or a vertex or end point that stays where it is
    crossings = [where.get(n, n) for n in route]
    points, length = _pulled(v, crossings, spot[route].copy(), size)
    spokes: dict[int, list[tuple[int, int]]] = {}
    for e in edges:
        for x in e:
            spokes.setdefault(x, []).append(e)
    for _ in range(ROUNDS):
        shorter = None
        for i, j, w in _caught(v, crossings, points, size):
            before = set(_faces(crossings[i - 1], edges, faces_of))
            after = set(_faces(crossings[j + 1], edges, faces_of))
            for fan in _fans(w, spokes.get(w, []), edges, before, after):
                trial = [*crossings[:i], *fan, *crossings[j + 1 :]]
                middle = np.array([v[w] + (v[a + b - w] - v[w]) * 1e-3 for a, b in fan]).reshape(-1, 3)
                found = _pulled(v, trial, np.concatenate([points[:i], middle, points[j + 1 :]]), size)
                if found[1] < (shorter or (None, None, length))[2] - 1e-12 * size:
                    shorter = (trial, *found)
        if shorter is None:
            break
        crossings, points, length = shorter
    keep = [0, *[k for k in range(1, len(points)) if np.linalg.norm(points[k] - points[k - 1]) > 1e-12 * size]]
    return points[keep]


def _pulled(v: np.ndarray, crossings: list, points: np.ndarray, size: float) -> tuple[np.ndarray, float]:
    """The path moved to its least length over its edges, and that length."""
    for _ in range(500):
        moved = 0.0
        for k in range(1, len(crossings) - 1):
            if isinstance(crossings[k], tuple):
                a, b = (v[x] for x in crossings[k])
                new = _straight(points[k - 1], points[k + 1], a, b)
                moved = max(moved, float(np.linalg.norm(new - points[k])))
                points[k] = new
        if moved < 1e-12 * size:
            break
    return points, float(np.linalg.norm(np.diff(points, axis=0), axis=1).sum())


def _caught(v: np.ndarray, crossings: list, points: np.ndarray, size: float) -> list[tuple[int, int, int]]:
    """Runs i..j of inner crossings that lie on one vertex, and the vertex."""
    out, k = [], 1
    while k < len(crossings) - 1:
        ends = crossings[k] if isinstance(crossings[k], tuple) else (crossings[k],) if crossings[k] < len(v) else ()
        w = next((x for x in ends if np.linalg.norm(v[x] - points[k]) <= 1e-9 * size), None)
        last = k
        if w is not None:
            while last + 2 < len(crossings) and np.linalg.norm(points[last + 1] - v[w]) <= 1e-9 * size:
                last += 1
            out.append((k, last, w))
        k = last + 1
    return out


def _faces(crossing, edges: dict, faces_of: dict) -> list[int]:
    return edges[crossing] if isinstance(crossing, tuple) else faces_of[crossing]


def _fans(w: int, spokes: list[tuple[int, int]], edges: dict, before: set[int], after: set[int]) -> list[list[tuple[int, int]]]:
    """The edges at w that a walk around it crosses, from a face of ``before`` to one of ``after``, both ways round."""
    beside: dict[int, list[tuple[int, tuple[int, int]]]] = {}
    for e in spokes:
        f, g = edges[e]
        beside.setdefault(f, []).append((g, e))
        beside.setdefault(g, []).append((f, e))
    out = []
    for start in before & set(beside):
        for first in beside[start]:
            fan, came, (at, e) = [], start, first
            while e is not None and len(fan) <= len(spokes):
                fan.append(e)
                if at in after:
                    out.append(fan)
                    break
                came, (at, e) = at, next(((g, x) for g, x in beside[at] if x != e), (None, None))
    return out


def _straight(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The point of edge ab on the shortest way from p to q over it: both sides unfolded into one plane."""
    d = b - a
    n = float(np.linalg.norm(d))
    if n == 0:
        return a
    d = d / n
    x1, x2 = float((p - a) @ d), float((q - a) @ d)
    h1, h2 = float(np.linalg.norm(p - a - x1 * d)), float(np.linalg.norm(q - a - x2 * d))
    x = x1 + (x2 - x1) * (h1 / (h1 + h2)) if h1 + h2 > 0 else (x1 + x2) / 2
    return a + d * min(max(x, 0.0), n)
