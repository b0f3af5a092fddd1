"""Decals: outlines as prisms that follow a surface, and the check whether a surface carries them.

The frame is (origin, u, v, n). The outline's x runs along the baseline, a path marched over the surface from the
origin along u in steps of half a unit; y is measured along v. Each point settles on the surface by rays along the normal.
"""

from __future__ import annotations

import numpy as np

from . import curves, planar, space
from .batch import Failure

# Step and margin of the baseline, how far back rays start, and how far a point may settle beside its height.
STEP, MARGIN, BACK, SETTLE = 0.5, 2.0, 1e-3, 0.5
FRONT = 150.0


def _both_ways(v, t, points, normals):
    """Signed distance along the normal to the nearer hit of two rays, nan without one."""
    up, _ = space.raycast(v, t, points - BACK * normals, normals)
    down, _ = space.raycast(v, t, points + BACK * normals, -normals)
    up, down = up - BACK, -(down - BACK)
    best = np.where(np.abs(up) <= np.abs(down), up, down)
    return np.where(np.isfinite(best), best, np.nan)


def _normal_at(v, t, point, fallback):
    _, _, face = space.closest(v, t, point[None])
    a, b, c = v[t[face[0]]]
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n)
    return n / size if size > 1e-300 else fallback


def baseline(v, t, frame: dict, low: float, high: float):
    """Positions, points, directions and normals along the surface from low - MARGIN to high + MARGIN."""
    out = [(0.0, frame["origin"], frame["u"], frame["n"])]
    for sign, limit in ((1, high + MARGIN), (-1, -(low - MARGIN))):
        point, way, normal, run, part = frame["origin"], sign * frame["u"], frame["n"], 0.0, []
        while run < limit and run < 10_000 * STEP:
            nxt = point + STEP * way
            _, on, _ = space.closest(v, t, nxt[None])
            if np.linalg.norm(on[0] - nxt) < SETTLE:
                nxt = on[0]
                normal = _normal_at(v, t, nxt, normal)
                way = way - (way @ normal) * normal
                size = np.linalg.norm(way)
                if size < 1e-9:
                    break
                way = way / size
            point, run = nxt, run + STEP
            part.append((sign * run, point, sign * way, normal))
        out = out + part if sign > 0 else part[::-1] + out
    return [np.array([o[k] for o in out]) for k in range(4)]


def build_prism(row: dict, depth: float, height: float, longest: float = 0.0) -> dict:
    """The outlines of ``polygons`` as a solid from ``depth`` under to ``height`` over the surface."""
    polygons = [(p["outer"], p["holes"] or []) for p in row["polygons"] or []]
    if not polygons:
        raise Failure("Decals.EmptyOutlines")
    if longest > 0:
        cut = lambda r: curves.split_collapse(np.concatenate([r, r[:1]]), longest, 0.0)[:-1]
        polygons = [(cut(o), [cut(h) for h in hs]) for o, hs in polygons]
    try:
        p, f = planar.triangulate(polygons)
    except Failure:
        raise Failure("Decals.TriangulationFailed") from None
    frame, v, t = row["frame"], row["vertices"], row["triangles"]
    at, points, ways, normals = baseline(v, t, frame, p[:, 0].min(), p[:, 0].max())
    k = np.clip(np.searchsorted(at, p[:, 0]) - 1, 0, len(at) - 2)
    s = ((p[:, 0] - at[k]) / (at[k + 1] - at[k]))[:, None]
    mix = lambda x: x[k] + s * (x[k + 1] - x[k])
    foot, normal = mix(points), mix(normals)
    normal = normal / np.linalg.norm(normal, axis=1, keepdims=True)
    across = np.cross(normal, mix(ways))
    across = across / np.linalg.norm(across, axis=1, keepdims=True)
    flat = foot + p[:, 1:] * across
    rise = _both_ways(v, t, flat, normal)
    settled = flat + np.where(np.abs(rise) <= SETTLE + np.abs(p[:, 1]), np.nan_to_num(rise), 0.0)[:, None] * normal
    pv, pt = curves.prism(p, f, settled - depth * normal, settled + height * normal)
    return {"vertices": pv, "triangles": pt, "name": "Decal", "created_by": "triloom.decal"}


def project(row: dict) -> dict:
    """The prism, given in the frame's coordinates, laid on the surface along the frame's normal, with two warnings."""
    frame, v, t = row["frame"], row["vertices"], row["triangles"]
    p = row["prism_vertices"]
    base = frame["origin"] + p[:, :1] * frame["u"] + p[:, 1:2] * frame["v"]
    n = np.tile(frame["n"], (len(p), 1))
    front, f1 = space.raycast(v, t, base + FRONT * n, -n)
    behind, f2 = space.raycast(v, t, base, -n)
    hit = np.isfinite(front) | np.isfinite(behind)
    on = np.where(np.isfinite(front)[:, None], base + (FRONT - np.where(np.isfinite(front), front, 0))[:, None] * n, base - np.where(np.isfinite(behind), behind, 0)[:, None] * n)
    face = np.where(np.isfinite(front), f1, f2)
    a, b, c = (v[t[np.maximum(face, 0), k]] for k in range(3))
    m = np.cross(b - a, c - a)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    steep = hit & (m @ frame["n"] < 0.5)
    return {"vertices": on + p[:, 2:] * n, "triangles": row["prism_triangles"], "name": "Decal", "created_by": "triloom.decal", "overhangs": not hit.all(), "too_curved": bool(steep.any())}
