"""Spatial queries on one mesh: through its bounding-volume tree, or against all faces where these are few."""

from __future__ import annotations

import numpy as np

from . import bvh
from . import mesh as M

PAIRS, SMALL = 400_000, 64


def _pairs(n: int, m: int):
    """Blocks of all pairs of n queries and m faces, as matched index arrays."""
    step = max(1, PAIRS // max(1, m))
    for lo in range(0, n, step):
        rows = np.arange(lo, min(n, lo + step))
        yield rows, np.repeat(rows, m), np.tile(np.arange(m), len(rows))


def nearest(v: np.ndarray, t: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distance, nearest surface point, lowest nearest triangle and feature (0 face, 1 edge, 2 corner) of each point."""
    if len(t) > SMALL:
        return bvh.index(v, t).nearest(points)
    dist, where, face, feature = np.empty(len(points)), np.empty((len(points), 3)), np.empty(len(points), np.int64), np.empty(len(points), np.int8)
    corners, slack = [v[t[:, k]] for k in range(3)], bvh.tie_slack(v)
    for rows, q, f in _pairs(len(points), len(t)):
        d2, best, kind = bvh.point_triangle(points[q], *(c[f] for c in corners))
        d2 = d2.reshape(len(rows), -1)
        k = (d2 <= d2.min(axis=1, keepdims=True) * (1 + bvh.TIE) + slack).argmax(axis=1)
        d2 = d2.ravel()
        at = np.arange(len(rows)) * len(t) + k
        dist[rows], where[rows], face[rows], feature[rows] = np.sqrt(d2[at]), best[at], k, kind[at]
    return dist, where, face, feature


def closest(v: np.ndarray, t: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, nearest surface point and lowest nearest triangle of each point."""
    return nearest(v, t, points)[:3]


def winding(v: np.ndarray, t: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Solid angle over 4 pi: 1 inside a closed mesh, 0 outside. Far parts of large meshes count as dipoles."""
    if len(t) > SMALL:
        return bvh.index(v, t).winding(points)
    out = np.empty(len(points))
    step = max(1, PAIRS // max(1, len(t)))
    for lo in range(0, len(points), step):
        a, b, c = (v[t[:, k]][None] - points[lo : lo + step, None] for k in range(3))
        la, lb, lc = (np.linalg.norm(x, axis=-1) for x in (a, b, c))
        top = np.einsum("pti,pti->pt", a, np.cross(b, c))
        low = la * lb * lc + np.einsum("pti,pti->pt", a, b) * lc + np.einsum("pti,pti->pt", b, c) * la + np.einsum("pti,pti->pt", c, a) * lb
        out[lo : lo + step] = np.arctan2(top, low).sum(axis=1) / (2 * np.pi)
    return out


def signed_distances(v: np.ndarray, t: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Negative inside; the sign is the winding number's, which holds on torn meshes too."""
    return closest(v, t, points)[0] * np.where(winding(v, t, points) > 0.5, -1.0, 1.0)


def raycast(v: np.ndarray, t: np.ndarray, origins: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance along each ray to its first hit (inf: none) and the lowest triangle there."""
    if len(t) > SMALL:
        return bvh.index(v, t).first_hits(origins, directions)
    near, face = np.full(len(origins), np.inf), np.full(len(origins), -1)
    corners = [v[t[:, k]] for k in range(3)]
    for rows, q, f in _pairs(len(origins), len(t)):
        dist = bvh.ray_triangle(origins[q], directions[q], *(c[f] for c in corners)).reshape(len(rows), -1)
        if dist.shape[1]:
            k = dist.argmin(axis=1)
            near[rows] = dist[np.arange(len(k)), k]
            face[rows] = np.where(np.isfinite(near[rows]), k, -1)
    return near, face


def crossing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether triangles p[k] and q[k] cross properly; touching and coplanar ones do not."""
    n1, n2 = (np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]) for x in (p, q))
    size = np.maximum(*(np.abs(x - x.mean(axis=1, keepdims=True)).max(axis=(1, 2)) * 2 for x in (p, q)))

    def heights(n, o, x):
        d = np.einsum("ki,kji->kj", n, x - o[:, None])
        return np.where(np.abs(d) < 1e-7 * np.linalg.norm(n, axis=1)[:, None] * size[:, None], 0, d)

    dq, dp = heights(n1, p[:, 0], q), heights(n2, q[:, 0], p)
    apart = (dq >= 0).all(axis=1) | (dq <= 0).all(axis=1) | (dp >= 0).all(axis=1) | (dp <= 0).all(axis=1)
    axis = np.abs(np.cross(n1, n2)).argmax(axis=1)

    def interval(x, d):
        s = np.take_along_axis(x, axis[:, None, None].repeat(3, 1), axis=2)[..., 0]
        low, high = np.full(len(x), np.inf), np.full(len(x), -np.inf)
        for i, j in ((0, 1), (1, 2), (2, 0)):
            cuts = d[:, i] * d[:, j] < 0
            f = np.where(cuts, d[:, i] / np.where(cuts, d[:, i] - d[:, j], 1), 0)
            at = s[:, i] + f * (s[:, j] - s[:, i])
            low, high = np.where(cuts, np.minimum(low, at), low), np.where(cuts, np.maximum(high, at), high)
            flat = d[:, i] == 0
            low, high = np.where(flat, np.minimum(low, s[:, i]), low), np.where(flat, np.maximum(high, s[:, i]), high)
        return low, high

    (l1, h1), (l2, h2) = interval(p, dp), interval(q, dq)
    return ~apart & (np.minimum(h1, h2) - np.maximum(l1, l2) > 1e-7 * size)


def self_intersections(v: np.ndarray, t: np.ndarray) -> int:
    """Triangles that cross another with which they share no vertex."""
    if not len(t):
        return 0
    low, high = v[t].min(axis=1), v[t].max(axis=1)
    pairs = bvh.index(v, t).overlaps(low, high)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    a, b = t[pairs[:, 0]], t[pairs[:, 1]]
    pairs = pairs[~(a[:, :, None] == b[:, None, :]).any(axis=(1, 2))]
    hit = pairs[crossing(v[t[pairs[:, 0]]], v[t[pairs[:, 1]]])] if len(pairs) else pairs
    return len(np.unique(hit))


def samples(v: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Even points on the surface: equal shares of area pick the faces, a plastic-number sequence the places in them."""
    size = np.cumsum(np.linalg.norm(M.face_vectors(v, t), axis=1))
    k = np.minimum(np.searchsorted(size, (np.arange(n) + 0.5) / n * size[-1]), len(t) - 1)
    # The steps of the two-dimensional low-discrepancy sequence.
    u, w = ((np.arange(n) + 1) * 0.7548776662466927) % 1, ((np.arange(n) + 1) * 0.5698402909980532) % 1
    fold = u + w > 1
    u, w = np.where(fold, 1 - u, u), np.where(fold, 1 - w, w)
    a, b, c = (v[t[k, i]] for i in range(3))
    return a + u[:, None] * (b - a) + w[:, None] * (c - a)


def centroid(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(M.face_vectors(v, t), axis=1)
    return (v[t].mean(axis=1) * size[:, None]).sum(axis=0) / size.sum() if size.sum() > 0 else v[t].mean(axis=(0, 1))


def align(sv, st, tv, tt, iterations: int = 50, tol: float = 1e-5, n: int = 2000) -> dict:
    """Point-to-plane registration with the nearest nine tenths of the samples; starts with the centroids on each other."""
    from .batch import Failure

    if iterations < 1 or not tol > 0 or n < 3:
        raise Failure("Transforms.InvalidAlignmentParameters")
    p = samples(sv, st, n)
    turn, move, last = np.eye(3), centroid(tv, tt) - centroid(sv, st), np.inf
    unit = M.face_vectors(tv, tt)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    used = 0
    for used in range(1, iterations + 1):
        q = p @ turn.T + move
        d, near, face = closest(tv, tt, q)
        keep = d <= np.sort(d)[max(3, int(np.ceil(0.9 * n))) - 1]
        rmse = float(np.sqrt((d[keep] ** 2).mean()))
        s, g, m = q[keep], near[keep], unit[face[keep]]
        c = s.mean(axis=0)
        rows = np.concatenate([np.cross(s - c, m), m], axis=1)
        right = np.einsum("ij,ij->i", g - s, m)
        normal = rows.T @ rows
        x = np.linalg.solve(normal + np.eye(6) * (1e-9 * np.trace(normal) / 6 + 1e-300), rows.T @ right)
        angle = np.linalg.norm(x[:3])
        step = np.eye(3)
        if angle > 0:
            k = x[:3] / angle
            cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
            step = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        turn, move = step @ turn, step @ (move - c) + c + x[3:]
        if abs(last - rmse) < tol or rmse < tol:
            break
        last = rmse
    final = closest(tv, tt, p @ turn.T + move)[0]
    return {"vertices": sv @ turn.T + move, "triangles": st, "rotation": [r.tolist() for r in turn], "translation": move, "rmse": float(np.sqrt((final**2).mean())), "iterations": used}
