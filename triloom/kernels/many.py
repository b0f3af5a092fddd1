"""Booleans and topology audits of many small meshes at once: the rules of ``csg``, ``coplanar`` and ``mesh``, with one set of NumPy calls a batch.

Meshes lie behind one another in one vertex and one face array, and whatever meets must be of the same mesh (or pair of meshes).
Where most time goes into the calls and not into the numbers, as for meshes of some ten to some hundred faces, this is many
times faster than one mesh after the other.
"""

from __future__ import annotations

import numpy as np

from . import bvh, coplanar
from . import mesh as M
from .batch import Failure, Rows

#: Meshes with more faces go one at a time, through their trees; face pairs of a pass over a batch.
MOST_FACES, PASS = 512, 100_000
#: Groups of so few closed meshes are united, or taken away, in one pass.
MOST_OPERANDS = 6
#: Meshes of so few faces and vertices are tried for convexity.
FEW = 32
#: A direction on which different points seldom meet.
_LINE = np.array([0.5436, 0.6277, 0.5571]) / np.linalg.norm([0.5436, 0.6277, 0.5571])


def _spans(count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x) for x in start[k] .. start[k] + count[k]."""
    k = np.repeat(np.arange(len(count)), count)
    return k, np.arange(len(k)) + np.repeat(start - _starts(count), count)


def _starts(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


class Stack:
    """Meshes behind one another; ``of`` names the mesh of each face."""

    def __init__(self, meshes: list[tuple[np.ndarray, np.ndarray]]):
        self._convex: np.ndarray | None = None
        self.nv, self.nt = np.array([len(v) for v, _ in meshes], np.int64), np.array([len(t) for _, t in meshes], np.int64)
        self.v0, self.t0 = _starts(self.nv), _starts(self.nt)
        self.v = np.concatenate([v for v, _ in meshes]).astype(float)
        self.of = np.repeat(np.arange(len(meshes)), self.nt)
        self.t = np.concatenate([t for _, t in meshes]).astype(np.int64) + self.v0[self.of][:, None]
        self.low, self.high = np.minimum.reduceat(self.v, self.v0), np.maximum.reduceat(self.v, self.v0)
        self.normal = M.face_vectors(self.v, self.t)
        self.size = np.sqrt(bvh.dots(self.normal, self.normal))
        self.unit = self.normal / np.maximum(self.size, 1e-300)[:, None]
        self.height = bvh.dots(self.unit, self.v[self.t[:, 0]])
        x, y, z = (self.v[self.t[:, k]] for k in range(3))
        self.face_low, self.face_high = np.minimum(np.minimum(x, y), z), np.maximum(np.maximum(x, y), z)

    def convex(self) -> np.ndarray:
        """Which meshes are closed, hold a volume and lie behind the planes of all their faces, up to rounding; only of few faces."""
        if self._convex is None:
            few = np.flatnonzero((self.nt <= FEW) & (self.nv <= FEW))
            k, f = _spans(self.nt[few], self.t0[few])
            face, x = _spans(self.nv[few][k], self.v0[few][k])
            f, of = f[face], few[k[face]]
            slack = 1e-13 * np.abs(np.concatenate([self.low, self.high], axis=1)).max(axis=1)
            out = np.bincount(of, bvh.dots(self.unit[f], self.v[x]) > self.height[f] + slack[of], len(self.nt)) == 0
            out &= (self.nt <= FEW) & (self.nv <= FEW) & (np.bincount(self.of, self.size == 0, len(self.nt)) == 0)
            size = self.high - self.low
            a, b, c = (self.v[self.t[:, k]] - self.low[self.of] for k in range(3))
            out &= np.add.reduceat(bvh.dots(a, bvh.cross(b, c)), self.t0) > 1e-9 * bvh.dots(size, size) ** 1.5
            self._convex = out & _balanced(self.t, len(self.v), self.nt)
        return self._convex


def _balanced(t: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
    """Whether each mesh of a stack, of ``count`` faces each, passes its sides as often one way as the other."""
    h = M.half_edges(t)
    # a mesh has as many codes either way, and they lie together
    differ = np.sort(h[:, 0] * np.int64(n) + h[:, 1]) != np.sort(h[:, 1] * np.int64(n) + h[:, 0])
    return ~np.logical_or.reduceat(differ, 3 * _starts(count))


class Faces:
    """The faces of a stack as convex polygons of three or four corners: two triangles of one plane that share a side are one where they make
    a convex one. ``q`` has four corners a row, the third twice in triangles; ``of`` names the mesh of each."""

    def __init__(self, s: Stack):
        self.v, self.low, self.high = s.v, s.low, s.high
        n, m, t = np.int64(len(s.v)), len(s.t), s.t
        h = M.half_edges(t)
        key = h.min(axis=1) * n + h.max(axis=1)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(_heads(key[order]))
        two = start[np.diff(np.append(start, len(key))) == 2]
        e, o = order[two], order[two + 1]
        f, g = e % m, o % m
        x, y, c, d = h[e, 0], h[e, 1], t[f, (e // m + 2) % 3], t[g, (o // m + 2) % 3]
        flat = (h[o, 0] == y) & (f != g) & (c != d) & (bvh.dots(s.unit[f], s.unit[g]) > 1 - 1e-12)
        e, f, g, x, y, c, d = (z[flat] for z in (e, f, g, x, y, c, d))
        slack = 1e-13 * np.linalg.norm(s.high - s.low, axis=1) + 1e-15 * np.maximum(np.abs(s.low), np.abs(s.high)).max(axis=1)
        fit = np.abs(bvh.dots(s.v[d] - s.v[x], s.unit[f])) <= slack[s.of[f]]
        for a, b, z in ((c, x, d), (d, y, c)):
            one, two = s.v[b] - s.v[a], s.v[z] - s.v[b]
            fit &= bvh.dots(bvh.cross(one, two), s.unit[f]) > 1e-6 * (bvh.dots(one, one) + bvh.dots(two, two))
        f, g, x, y, c, d = (z[fit] for z in (f, g, x, y, c, d))
        # each triangle goes with its first neighbour, where that goes with it
        first, rank = np.full(m, len(f)), np.arange(len(f))
        np.minimum.at(first, f, rank)
        np.minimum.at(first, g, rank)
        both = (first[f] == rank) & (first[g] == rank)
        f, g = f[both], g[both]
        q, count, keep = np.concatenate([t, t[:, 2:]], axis=1), np.full(m, 3), np.ones(m, bool)
        q[f] = np.stack([x, d, y, c], axis=1)[both]
        count[f], keep[g] = 4, False
        self.q, self.n, self.of = q[keep], count[keep], s.of[keep]
        self.normal, self.unit, self.size, self.height = s.normal[keep], s.unit[keep], s.size[keep], s.height[keep]
        self.count = np.bincount(self.of, minlength=len(s.nt))
        self.first = _starts(self.count)
        low, high = s.face_low.copy(), s.face_high.copy()
        low[f], high[f] = np.minimum(low[f], low[g]), np.maximum(high[f], high[g])
        self.face_low, self.face_high = low[keep], high[keep]


def welded(v: np.ndarray, of: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """``mesh.weld`` within each mesh: the first kept vertex within its mesh's tolerance (``tol`` by vertex)."""
    n = len(v)
    along = v @ _LINE
    order = np.lexsort((along, of))
    head = _heads(of[order], *v[order].T)
    group = np.cumsum(head) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(head)) if n else order  # lexsort is stable: the lowest of each place
    at, own, reach = along[first], of[first], tol[first]
    found, live, step = [], np.arange(len(first) - 1), 1
    while len(live):
        live = live[live + step < len(first)]
        near = (own[live] == own[live + step]) & (at[live + step] - at[live] <= reach[live] * (1 + 1e-6) + 1e-13 * np.abs(at[live]))
        live = live[near]
        i, j = first[live], first[live + step]
        gap = v[i] - v[j]
        close = bvh.dots(gap, gap) <= tol[i] ** 2
        found.append(np.sort(np.stack([i[close], j[close]], axis=1), axis=1))
        step += 1
    keeper = np.arange(n)
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    for i, j in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if keeper[i] == i and keeper[j] == j:
            keeper[j] = i
    out = np.empty(n, np.int64)
    out[order] = keeper[first[group]]
    return out


def stackable(v: np.ndarray, t: np.ndarray) -> bool:
    """Whether a mesh is small and sound enough to share a stack: a face that names a vertex it lacks would find another mesh's."""
    return 0 < len(t) <= MOST_FACES and len(v) <= 3 * MOST_FACES and t.min() >= 0 and t.max() < len(v) and bool(np.isfinite(v).all())


def _fit(meshes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``stackable`` of each mesh."""
    nv, nt = np.array([len(v) for v, _ in meshes], np.int64), np.array([len(t) for _, t in meshes], np.int64)
    fit = (nt > 0) & (nt <= MOST_FACES) & (nv > 0) & (nv <= 3 * MOST_FACES)
    some = np.flatnonzero(fit)
    if len(some):
        v, t = np.concatenate([meshes[k][0] for k in some.tolist()]), np.concatenate([meshes[k][1] for k in some.tolist()]).ravel()
        at = 3 * _starts(nt[some])
        fit[some] = (np.minimum.reduceat(t, at) >= 0) & (np.maximum.reduceat(t, at) < nv[some]) & np.logical_and.reduceat(np.isfinite(v).ravel(), 3 * _starts(nv[some]))
    return fit


def _solid(meshes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of stackable meshes: which are closed, every side being passed as often one way as the other, and hold a positive volume."""
    nv, nt = np.array([len(v) for v, _ in meshes], np.int64), np.array([len(t) for _, t in meshes], np.int64)
    v, t = np.concatenate([v for v, _ in meshes]), np.concatenate([t for _, t in meshes]) + np.repeat(_starts(nv), nt)[:, None]
    six = bvh.dots(v[t[:, 0]], bvh.cross(v[t[:, 1]], v[t[:, 2]]))
    return _balanced(t, len(v), nt) & (np.add.reduceat(six, _starts(nt)) > 0)


def _bins(load: list[int]) -> list[np.ndarray]:
    """Neighbours put together up to the load of a pass."""
    bins = np.cumsum(load) // PASS if load else np.zeros(0, np.int64)
    return [np.flatnonzero(bins == b) for b in np.unique(bins)]


def topologies(meshes: list[tuple[np.ndarray, np.ndarray]], tol: float) -> list[dict]:
    """``mesh.topology`` of each mesh."""
    fit = _fit(meshes)
    out = [None if ok else M.topology(*m, tol) for ok, m in zip(fit, meshes, strict=True)]
    small = np.flatnonzero(fit)
    for these in _bins([10 * len(meshes[k][1]) for k in small]):
        for k, found in zip(small[these].tolist(), _audited([meshes[k] for k in small[these]], tol), strict=True):
            out[k] = found
    return out


def _audited(meshes: list[tuple[np.ndarray, np.ndarray]], tol: float) -> list[dict]:
    s = Stack(meshes)
    n, count = np.int64(len(s.v)), lambda of: np.bincount(of, minlength=len(meshes))
    good = M.proper(s.t)
    h = M.half_edges(s.t[good])
    key, uses = np.unique(h.min(axis=1) * n + h.max(axis=1), return_counts=True)
    run, runs = np.unique(h[:, 0] * n + h[:, 1], return_counts=True)
    owner = np.repeat(np.arange(len(meshes)), s.nv)
    edge, way = owner[key // n], owner[run // n]
    f = np.sort(s.t, axis=1)
    f = f[np.lexsort((f[:, 2], f[:, 1], f[:, 0]))]
    double = ~_heads(*f.T)
    used = M.distinct(s.t.ravel())
    thin = ~good | (s.size / 2 <= tol * tol)
    label = M.roots(len(s.v), np.concatenate([s.t[:, [0, 1]], s.t[:, [1, 2]]]))
    same = welded(s.v, owner, np.full(len(s.v), tol))
    columns = {
        "edges": count(edge), "boundary_edges": count(edge[uses == 1]), "non_manifold_edges": count(edge[uses > 2]), "winding_errors": np.bincount(way, runs - 1, len(meshes)).astype(np.int64),
        "degenerate_triangles": count(s.of[thin]), "duplicate_faces": count(owner[f[double, 0]]), "duplicate_vertices": count(owner[same != np.arange(len(s.v))]),
        "shells": count(owner[M.distinct(label[used])]), "unreferenced_vertices": s.nv - count(owner[used]),
    }
    names, rows = list(columns), np.stack(list(columns.values()), axis=1).tolist()
    return [dict(zip(names, r, strict=True)) for r in rows]


def volumes(meshes: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """``mesh.volume`` of each mesh."""
    fit = _fit(meshes)
    out = [0.0 if ok else M.volume(*m) for ok, m in zip(fit, meshes, strict=True)]
    small = np.flatnonzero(fit).tolist()
    if small:
        at = _starts(np.array([len(meshes[k][0]) for k in small], np.int64))
        count = np.array([len(meshes[k][1]) for k in small], np.int64)
        v, t = np.concatenate([meshes[k][0] for k in small]), np.concatenate([meshes[k][1] for k in small]) + np.repeat(at, count)[:, None]
        six = bvh.dots(v[t[:, 0]], bvh.cross(v[t[:, 1]], v[t[:, 2]]))
        for k, x in zip(small, (np.add.reduceat(six, _starts(count)) / 6).tolist(), strict=True):
            out[k] = x
    return out


def components(meshes: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """``mesh.components`` of each mesh."""
    fit = _fit(meshes)
    out = [[] if ok else M.components(*m) for ok, m in zip(fit, meshes, strict=True)]
    small = np.flatnonzero(fit)
    for these in _bins([10 * len(meshes[k][1]) for k in small]):
        s = Stack([meshes[k] for k in small[these]])
        label = M.roots(len(s.v), np.concatenate([s.t[:, [0, 1]], s.t[:, [1, 2]]]))[s.t[:, 0]]
        names, first, part = np.unique(label, return_index=True, return_inverse=True)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(first, kind="stable")] = np.arange(len(names))  # parts in order of first face
        part = rank[part]
        order = np.argsort(part, kind="stable")
        v, t = M.compact(s.v, s.t[order])
        for k, mesh in zip(small[these][s.of[np.sort(first)]].tolist(), unstacked(v, t, part[order], len(names)), strict=True):
            out[k].append(mesh)
    return out


def _reached(pairs: np.ndarray, start: np.ndarray, edges: np.ndarray, n: int, least: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vertex) of all vertices that each query reaches from its start over vertices of at least its height."""
    order = np.argsort(edges[:, 0], kind="stable")
    to, count = edges[order, 1], np.bincount(edges[:, 0], minlength=n)
    first = _starts(count)
    known = fresh = np.sort(pairs * np.int64(n) + start)
    while len(fresh):
        q, x = fresh // n, fresh % n
        k, at = _spans(count[x], first[x])
        q, y = q[k], to[at]
        high = height[y] >= least[q]
        met = M.distinct(q[high] * np.int64(n) + y[high])
        fresh = met[known[np.minimum(np.searchsorted(known, met), len(known) - 1)] != met]
        known = np.sort(np.concatenate([known, fresh]))
    return known // n, known % n


def peaks(meshes: list[tuple[np.ndarray, np.ndarray]], up: np.ndarray, tol: float, depth: float | None) -> list[Rows]:
    """``mesh.peaks`` of each mesh, with the ``summit`` and, with ``depth``, the number of vertices ``within_reach`` of each peak.

    A part with one peak never meets a higher one; only where a part has several are regions joined by falling height.
    """
    fit = _fit(meshes)
    out: list = [None if ok else _single_peaks(*m, up, tol, depth) for ok, m in zip(fit, meshes, strict=True)]
    small = np.flatnonzero(fit)
    for these in _bins([10 * len(meshes[k][1]) for k in small]):
        for k, found in zip(small[these].tolist(), _stacked_peaks([meshes[k] for k in small[these]], up / np.linalg.norm(up), tol, depth), strict=True):
            out[k] = found
    return out


def _single_peaks(v: np.ndarray, t: np.ndarray, up: np.ndarray, tol: float, depth: float | None) -> Rows:
    found = M.peaks(v, t, up)
    vids = [p["vid"] for p in found]
    within = np.array([M.reach(v, t, up, k, depth).sum() for k in vids], np.int64) if depth is not None else None
    points = lambda x: np.array(x, float).reshape(-1, 3)
    return Rows({
        "peak": np.arange(len(found)), "vid": np.array(vids, np.int64), "point": points([p["point"] for p in found]), "normal": points([p["normal"] for p in found]), "height": np.array([p["height"] for p in found], float),
        "prominence": np.array([p["prominence"] for p in found], float), "summit": points([M.summit(v, t, up, k, tol) for k in vids]), "within_reach": within,
    })


def _stacked_peaks(meshes: list[tuple[np.ndarray, np.ndarray]], up: np.ndarray, tol: float, depth: float | None) -> list[Rows]:
    s = Stack(meshes)
    n, owner = len(s.v), np.repeat(np.arange(len(meshes)), s.nv)
    height = s.v @ up
    # vertices at one place are one
    order = np.lexsort((*s.v.T[::-1], owner))
    head = _heads(owner[order], *s.v[order].T)
    one = np.empty(n, np.int64)
    one[order] = np.minimum.reduceat(order, np.flatnonzero(head))[np.cumsum(head) - 1]
    t = one[s.t]
    good = M.proper(t)
    t, of = t[good], s.of[good]
    e = M.half_edges(t)
    better = (height[e[:, 0]] > height[e[:, 1]]) | ((height[e[:, 0]] == height[e[:, 1]]) & (e[:, 0] < e[:, 1]))
    top = np.zeros(n, bool)
    top[e.ravel()] = True
    top[np.where(better, e[:, 1], e[:, 0])] = False
    vid = np.flatnonzero(top)
    vid = vid[np.lexsort((vid, -height[vid], owner[vid]))]
    mine = owner[vid]
    prominence = np.full(len(vid), np.inf)
    part = M.roots(n, e[: len(t) * 2])[vid]
    several = np.bincount(part, minlength=n)[part] > 1
    for m in M.distinct(mine[several]).tolist():
        here = np.flatnonzero(mine == m)
        ends = {p["vid"]: p["prominence"] for p in M.peaks(*meshes[m], up)}
        prominence[here] = [ends[int(x)] for x in vid[here] - s.v0[m]]
    face = M.face_vectors(s.v, t)
    size = np.zeros((n, 3))
    for d in range(3):
        size[:, d] = np.bincount(t.ravel(), np.repeat(face[:, d], 3), n)
    normal = size[vid]
    long = np.linalg.norm(normal, axis=1, keepdims=True)
    normal = np.where(long > 1e-300, normal / np.where(long > 1e-300, long, 1), 0.0)
    # the middle of each flat top, on the first face that holds it
    edges = np.concatenate([M.half_edges(s.t), M.half_edges(s.t)[:, ::-1]])
    peak = np.arange(len(vid))
    q, x = _reached(peak, vid, edges, n, height[vid] - tol, height)
    count = np.bincount(q, minlength=len(vid))
    frame = np.linalg.svd(up[None, :])[2][1:]
    flat = s.v @ frame.T
    middle = np.stack([np.bincount(q, flat[x, d], len(vid)) for d in range(2)], axis=1) / count[:, None]
    summit = s.v[vid].copy()
    facing = np.flatnonzero(s.normal @ up > 0)
    per = np.bincount(s.of[facing], minlength=len(meshes))
    wide = np.flatnonzero(count >= 3)
    k, f = _spans(per[mine[wide]], _starts(per)[mine[wide]])
    k, f = wide[k], facing[f]
    level = height[s.t[f]].min(axis=1) >= height[vid[k]] - tol
    k, f = k[level], f[level]
    a, b, c = (flat[s.t[f, d]] for d in range(3))
    b, c, m = b - a, c - a, middle[k] - a
    det = b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]
    sound = np.abs(det) > 1e-18
    det = np.where(sound, det, 1)
    u, w = (m[:, 0] * c[:, 1] - m[:, 1] * c[:, 0]) / det, (b[:, 0] * m[:, 1] - b[:, 1] * m[:, 0]) / det
    inside = sound & (u >= -1e-9) & (w >= -1e-9) & (u + w <= 1 + 1e-9)
    k, f, u, w = k[inside], f[inside], u[inside], w[inside]
    k, first = np.unique(k, return_index=True)  # by peak, then by face
    p, d1, d2 = s.v[s.t[f[first], 0]], s.v[s.t[f[first], 1]], s.v[s.t[f[first], 2]]
    summit[k] = p + u[first][:, None] * (d1 - p) + w[first][:, None] * (d2 - p)
    within = None if depth is None else np.bincount(_reached(peak, vid, edges, n, height[vid] - depth, height)[0], minlength=len(vid))
    ends = np.cumsum(np.bincount(mine, minlength=len(meshes))).tolist()
    columns = {"vid": vid - s.v0[mine], "point": s.v[vid], "normal": normal, "height": height[vid], "prominence": prominence, "summit": summit}
    out = []
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        out.append(Rows({"peak": np.arange(hi - lo)} | {name: c[lo:hi] for name, c in columns.items()} | {"within_reach": None if within is None else within[lo:hi]}))
    return out


class Polygons:
    """Convex polygons as rows of padded corners."""

    def __init__(self, p: np.ndarray, n: np.ndarray, face: np.ndarray):
        self.p, self.n, self.face = p, n, face

    def flat(self) -> np.ndarray:
        return np.arange(self.p.shape[1]) < self.n[:, None]

    def take(self, k) -> Polygons:
        return Polygons(self.p[k], self.n[k], self.face[k])

    def middle(self) -> np.ndarray:
        return np.where(self.flat()[..., None], self.p, 0).sum(axis=1) / self.n[:, None]


def _joined(parts: list[Polygons]) -> Polygons:
    wide = max([x.p.shape[1] for x in parts], default=3)
    return Polygons(np.concatenate([np.pad(x.p, ((0, 0), (0, wide - x.p.shape[1]), (0, 0))) for x in parts]), np.concatenate([x.n for x in parts]), np.concatenate([x.face for x in parts]))


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a comes before b by x, then y, then z."""
    less, same = a < b, a == b
    return less[..., 0] | same[..., 0] & (less[..., 1] | same[..., 1] & less[..., 2])


def _halved(x: Polygons, n: np.ndarray, o: np.ndarray, low: np.ndarray, high: np.ndarray, tol: np.ndarray) -> Polygons:
    """Each polygon cut by its plane, where it enters the box of what the plane stands for."""
    held, tol = x.flat(), tol[:, None]
    d = np.einsum("ijk,ik->ij", x.p, n) - o[:, None]
    cut = (held & (d <= -tol)).any(axis=1) & (held & (d >= tol)).any(axis=1)
    some = np.flatnonzero(cut)
    if len(some):
        p, inside = x.p[some], held[some][..., None]
        p = np.where(inside, p, p[:, :1])
        l1, h1, l2, h2 = p[:, 0], p[:, 0], low[some], high[some]
        for k in range(1, p.shape[1]):
            l1, h1 = np.minimum(l1, p[:, k]), np.maximum(h1, p[:, k])
        slack = tol[some]
        # of two thick things an overlap within the tolerance is a touch
        least = np.where((h1 - l1 > 4 * slack) & (h2 - l2 > 4 * slack), slack, -slack)
        cut[some] = (np.minimum(h1, h2) - np.maximum(l1, l2) > least).all(axis=1)
    if not cut.any():
        return x
    y, d, held, tol = x.take(cut), d[cut], held[cut], tol[cut]
    after = np.where(np.arange(1, d.shape[1] + 1) < y.n[:, None], np.arange(1, d.shape[1] + 1), 0)
    a, b, e = y.p, np.take_along_axis(y.p, after[..., None], axis=1), np.take_along_axis(d, after, axis=1)
    swap = ~_before(a, b)
    first, second = np.where(swap[..., None], b, a), np.where(swap[..., None], a, b)
    d1, d2 = np.where(swap, e, d), np.where(swap, d, e)
    across = held & (((d > tol) & (e < -tol)) | ((d < -tol) & (e > tol)))
    share = d1 / np.where(across, d1 - d2, 1)
    point = first + (second - first) * share[..., None]
    slots = np.stack([a, point], axis=2).reshape(len(d), -1, 3)
    halves = [x.take(~cut)]
    for s in (1, -1):
        keep = np.stack([held & (s * d >= -tol), across], axis=2).reshape(len(d), -1)
        size = keep.sum(axis=1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : max(3, int(size.max()))]
        halves.append(Polygons(np.take_along_axis(slots, order[..., None], axis=1), size, y.face).take(size >= 3))
    return _joined(halves)


def _beside(s: Faces, face: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest height of each face's corners over its plane."""
    w, x, y, z = (bvh.dots(s.v[s.q[face, k]] - at, n) for k in range(4))
    return np.minimum(np.minimum(w, x), np.minimum(y, z)), np.maximum(np.maximum(w, x), np.maximum(y, z))


def _others(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, start, mesh): the other meshes of each mesh's group, for groups of ``size`` meshes behind one another."""
    first, count = np.repeat(_starts(size), size), np.repeat(size - 1, size)
    m, x = _spans(count, np.zeros(len(count), np.int64))
    return count, _starts(count), first[m] + x + (first[m] + x >= m)


def _fragments(a: Faces, b: Faces, tol: np.ndarray, others: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[Polygons, np.ndarray]:
    """As ``csg._fragments`` for the faces of ``a``: each mesh meets its ``others`` among the meshes of ``b``, the one at its own place if none are named."""
    reach = tol[a.of]
    i, to = (np.arange(len(a.q)), a.of) if others is None else _spans(others[0][a.of], others[1][a.of])
    to = to if others is None else others[2][to]
    # faces that miss the other mesh's box meet none of its faces
    bounds = [(a.face_low[:, k] - reach, a.face_high[:, k] + reach) for k in range(3)]
    for k, (low, high) in enumerate(bounds):
        near = (low[i] <= b.high[:, k].take(to)) & (high[i] >= b.low[:, k].take(to))
        i, to = i[near], to[near]
    at, j = _spans(b.count[to], b.first[to])
    i = i[at]
    for k, (low, high) in enumerate(bounds):
        near = (low[i] <= b.face_high[:, k].take(j)) & (high[i] >= b.face_low[:, k].take(j))
        i, j = i[near], j[near]
    sized = b.size[j] > reach[i] ** 2
    i, j = i[sized], j[sized]
    cut = np.zeros(len(a.q), bool)
    cut[i] = True
    level = np.abs(bvh.dots(a.unit[i], b.unit[j])) > 1 - 1e-12
    # coplanar faces are cut by each other's sides
    fi, fj = i[level], j[level]
    same = np.abs(bvh.dots(b.unit[fj], a.v[a.q[fi, 0]]) - b.height[fj]) <= reach[fi]
    fi, fj, rank = fi[same], fj[same], np.flatnonzero(level)[same]
    ranks, owners, normals, heights, cutters = [], [], [], [], []
    for k in range(4):
        at, to = b.v[b.q[fj, k]], b.v[b.q[fj, (k + 1) % 4]]
        c = bvh.cross(a.unit[fi], to - at)
        size = np.linalg.norm(c, axis=1)
        some = size > reach[fi]
        c = c[some] / size[some][:, None]
        low, high = _beside(a, fi[some], c, at[some])
        r = 0.99 * reach[fi[some]]
        cuts = (low <= -r) & (high >= r)  # a plane that leaves the face whole leaves its pieces whole
        c, some = c[cuts], np.flatnonzero(some)[cuts]
        ranks.append(rank[some] * 4 + k), owners.append(fi[some]), normals.append(c), heights.append(bvh.dots(c, at[some])), cutters.append(fj[some])
    ci, cj, rank = i[~level], j[~level], np.flatnonzero(~level)
    low, high = _beside(a, ci, b.unit[cj], b.v[b.q[cj, 0]])
    r = reach[ci]
    meets = (low <= -0.99 * r) & (high >= 0.99 * r)
    ci, cj, rank, r = ci[meets], cj[meets], rank[meets], r[meets]
    low, high = _beside(b, cj, a.unit[ci], a.v[a.q[ci, 0]])
    meets = (low <= r) & (high >= -r)
    ranks.append(rank[meets] * 4), owners.append(ci[meets]), normals.append(b.unit[cj[meets]]), heights.append(b.height[cj[meets]]), cutters.append(cj[meets])
    rank, face, n, o, cutter = (np.concatenate(x) for x in (ranks, owners, normals, heights, cutters))
    # one cut a plane: the first, with the box of all faces that lie there
    key = np.round(np.concatenate([n, o[:, None]], axis=1), 9) + 0.0
    order = np.lexsort((rank, *key.T, face))
    heads = np.flatnonzero(_heads(face[order], *key[order].T))
    low, high = (np.minimum.reduceat(b.face_low[cutter[order]], heads), np.maximum.reduceat(b.face_high[cutter[order]], heads)) if len(heads) else (key[:, :3], key[:, :3])
    order = order[heads]
    again = np.lexsort((rank[order], face[order]))
    order, low, high = order[again], low[again], high[again]
    face, n, o = face[order], n[order], o[order]
    planes = np.bincount(face, minlength=len(a.q))
    start = _starts(planes)
    open_, done, step = Polygons(a.v[a.q], a.n, np.arange(len(a.q))), [], 0
    while len(open_.n):
        more = planes[open_.face] > step
        done.append(open_.take(~more))
        open_ = open_.take(more)
        if len(open_.n):
            k = start[open_.face] + step
            open_ = _halved(open_, n[k], o[k], low[k], high[k], reach[open_.face])
        step += 1
    parts = _joined(done)
    return parts.take(np.argsort(parts.face, kind="stable")), cut


def _places(mid: np.ndarray, normal: np.ndarray, of: np.ndarray, b: Stack, tol: np.ndarray) -> np.ndarray:
    """As ``csg._places``, of points by the mesh ``of`` of each, with a ``tol`` of each; the nearest face counts only on the surface, so only faces near a point are measured."""
    out, at = np.zeros(len(mid), int), np.arange(len(mid))
    for k in range(3):
        x, m, r = mid[at, k], of[at], tol[at]
        at = at[(x >= b.low[:, k].take(m) - r) & (x <= b.high[:, k].take(m) + r)]
    if not len(at):
        return out
    q, f = _spans(b.nt[of[at]], b.t0[of[at]])
    p, reach = mid[at], 4 * tol[at]
    qs, fs = q, f
    for k in range(3):
        near = (p[qs, k] >= b.face_low[fs, k] - reach[qs]) & (p[qs, k] <= b.face_high[fs, k] + reach[qs])
        qs, fs = qs[near], fs[near]
    near = np.abs(bvh.dots(b.unit[fs], p[qs]) - b.height[fs]) <= 1.01 * reach[qs] + 1e-14
    near |= b.size[fs] <= reach[qs] ** 2
    qs, fs = qs[near], fs[near]
    d2 = bvh.point_triangle(p[qs], *(b.v[b.t[fs, k]] for k in range(3)))[0]
    least = np.full(len(at), np.inf)
    np.minimum.at(least, qs, d2)
    slack = (1e-14 * np.maximum(np.abs(b.low), np.abs(b.high)).max(axis=1)) ** 2 + 1e-300
    tied = d2 <= least[qs] * (1 + bvh.TIE) + slack[of[at[qs]]]
    face = np.full(len(at), len(b.t))
    np.minimum.at(face, qs[tied], fs[tied])
    on = np.sqrt(least) <= reach
    out[at[on]] = np.where(bvh.dots(b.normal[face[on]], normal[at[on]]) > 0, 2, 3)
    # behind all planes of a convex solid is within it
    round_ = ~on & b.convex()[of[at]]
    k = round_[q]
    out[at[round_]] = np.bincount(q[k], bvh.dots(b.unit[f[k]], p[q[k]]) >= b.height[f[k]], len(at))[round_] == 0
    on |= round_
    off = ~on[q]
    q, f = q[off], f[off]
    x, y, z = (b.v[b.t[f, k]] - p[q] for k in range(3))
    lx, ly, lz = (np.sqrt(bvh.dots(w, w)) for w in (x, y, z))
    angle = np.arctan2(bvh.dots(x, bvh.cross(y, z)), lx * ly * lz + bvh.dots(x, y) * lz + bvh.dots(y, z) * lx + bvh.dots(z, x) * ly)
    inside = np.bincount(q, angle, len(at)) / (2 * np.pi) > 0.5
    out[at[~on]] = inside[~on]
    return out


class Sides:
    """Where pieces lie: of the pieces that were asked, ``place`` in each other mesh ``to`` of the group of ``mesh``; ``by`` names the asked piece that
    stands for a piece."""

    def __init__(self, a: Faces, parts: Polygons, cut: np.ndarray, b: Stack, tol: np.ndarray, others: tuple[np.ndarray, np.ndarray, np.ndarray]):
        owner, free = parts.face, ~cut
        label = M.roots(len(a.v), np.concatenate([a.q[free][:, k : k + 2] for k in range(3)]))
        region, whole = label[a.q[owner, 0]], free[owner]
        names, first = np.unique(region[whole], return_index=True)
        heads = np.flatnonzero(whole)[first]
        ask = np.concatenate([np.flatnonzero(~whole), heads]).astype(np.int64)
        self.by = np.empty(len(parts.n), np.int64)
        self.by[ask] = np.arange(len(ask))
        if len(heads):
            self.by[whole] = self.by[heads][np.searchsorted(names, region[whole])]
        asked = parts.take(ask)
        of = a.of[asked.face]
        self.n, (self.q, at) = len(ask), _spans(others[0][of], others[1][of])
        self.to, self.mesh = others[2][at], of[self.q]
        self.place = _places(asked.middle()[self.q], a.normal[asked.face[self.q]], self.to, b, tol[of[self.q]])

    def chosen(self, kind: str, role: np.ndarray) -> np.ndarray:
        """The pieces on the surface of the result; of equal ones the first mesh's stays. ``role`` is each mesh's place in its group."""
        r, s, p = role[self.mesh], role[self.to], self.place
        apart = (p == 0) | (p == 2) & (r < s)
        fine = {"union": lambda: apart, "intersect": lambda: (p == 1) | (p == 2) & (r < s), "subtract": lambda: np.where(r == 0, (p == 0) | (p == 3), np.where(s == 0, p == 1, apart))}[kind]()
        return (np.bincount(self.q[~fine], minlength=self.n) == 0)[self.by]


def _kept(a: Faces, parts: Polygons, chosen: np.ndarray, turned: np.ndarray | None, group: np.ndarray) -> Polygons:
    """The chosen pieces, and whole faces where all of a face's are, those of ``turned`` meshes the other way round; ``face`` names the group from here on."""
    every, some = np.bincount(parts.face, minlength=len(a.q)), np.bincount(parts.face[chosen], minlength=len(a.q))
    whole = np.flatnonzero((every == some) & (every > 0))
    out = _joined([Polygons(a.v[a.q[whole]], a.n[whole], whole), parts.take(chosen & (every != some)[parts.face])])
    if turned is not None:
        x = np.flatnonzero(turned[a.of[out.face]])
        k, n = np.arange(out.p.shape[1]), out.n[x, None]
        out.p[x] = np.take_along_axis(out.p[x], np.where(k < n, n - 1 - k, k)[..., None], axis=1)
    out.face = group[a.of[out.face]]
    return out


def _between(v: np.ndarray, of: np.ndarray, sides: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(side, point) of points on the inside of sides, along each side; ``v`` is sorted by mesh."""
    owner = of[sides[:, 0]]
    # along a line the points of a mesh fall into (mesh, mesh + 1/2), in order, and those near a side into its interval
    along, reach = v @ _LINE, tol[of]
    head = np.flatnonzero(_heads(of)) if len(of) else np.zeros(0, np.int64)
    start, scale = np.zeros(len(tol)), np.ones(len(tol))
    names = of[head]
    if len(head):
        start[names] = np.minimum.reduceat(along - reach, head)
        scale[names] = 0.5 / np.maximum(np.maximum.reduceat(along + reach, head) - start[names], 1e-300)
    place = of + (along - start[of]) * scale[of]
    order = np.argsort(place, kind="stable")
    place = place[order]
    ends, slack = along[sides], 2 * tol[owner] * scale[owner] + 1e-15 * len(tol) + 1e-12
    low, high = (owner + (x - start[owner]) * scale[owner] for x in (np.minimum(*ends.T), np.maximum(*ends.T)))
    first = np.searchsorted(place, np.maximum(low - slack, owner - 0.25))
    k, p = _spans(np.searchsorted(place, np.minimum(high + slack, owner + 0.7), side="right") - first, first)
    p = order[p]
    for axis in range(3):
        x, e = np.ascontiguousarray(v[:, axis]), v[:, axis][sides]
        low, high = np.minimum(*e.T) - tol[owner], np.maximum(*e.T) + tol[owner]
        near = (x[p] >= low[k]) & (x[p] <= high[k])
        k, p = k[near], p[near]
    a, b = sides[k].T
    some = (p != a) & (p != b)
    k, p, a, b = k[some], p[some], a[some], b[some]
    d, q = v[b] - v[a], v[p] - v[a]
    s = bvh.dots(q, d) / np.maximum(bvh.dots(d, d), 1e-300)
    gap = q - s[:, None] * d
    on = (s > 1e-12) & (s < 1 - 1e-12) & (bvh.dots(gap, gap) <= tol[owner[k]] ** 2)
    k, p, s = k[on], p[on], s[on]
    order = np.lexsort((s, k))
    return k[order], p[order]


def _sewn(x: Polygons, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``csg._sewn``: vertices, faces sorted by pair, and the pair of each face."""
    x = x.take(np.argsort(x.face, kind="stable"))
    held = x.flat()
    flat, loop = x.p[held], np.repeat(np.arange(len(x.n)), x.n)
    pair = x.face[loop]
    used, ids = np.unique(welded(flat, pair, 8 * tol[pair]), return_inverse=True)
    points, owner = flat[used], pair[used]
    # corners that meet the one before them go
    begin = _starts(x.n)
    before = np.arange(len(flat)) - 1
    before[begin[x.n > 0]] = (begin + x.n - 1)[x.n > 0]
    keep = ids != ids[before]
    order = np.lexsort((ids, loop))
    distinct = np.bincount(loop[order][_heads(loop[order], ids[order])], minlength=len(x.n))
    keep &= distinct[loop] >= 3
    ids, loop = ids[keep], loop[keep]
    if not len(ids):
        return np.zeros((0, 3)), np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    _, loop, size = np.unique(loop, return_inverse=True, return_counts=True)
    begin = _starts(size)
    after = np.arange(len(ids)) + 1
    after[begin + size - 1] = begin
    a, b = ids, ids[after]
    n = np.int64(len(points))
    code, side = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
    k, p = _between(points, owner, np.stack([code // n, code % n], axis=1), 8 * tol)
    inner = np.bincount(k, minlength=len(code))
    first = _starts(inner)
    # corners with the points on the side after each, in its direction
    c, at = _spans(inner[side], np.zeros(len(side), np.int64))
    at = first[side[c]] + np.where(a[c] < b[c], at, inner[side[c]] - 1 - at)
    whole = inner[side] + 1
    place = _starts(whole)
    full = np.empty(int(whole.sum()), np.int64)
    rest = np.ones(len(full), bool)
    full[place] = ids
    rest[place] = False
    full[rest] = p[at]
    size_full = np.bincount(loop, whole, len(size)).astype(np.int64)
    start_full = _starts(size_full)
    middle_of = np.repeat(np.arange(len(size)), np.maximum(size - 2, 0))
    step = np.arange(len(middle_of)) - np.repeat(_starts(np.maximum(size - 2, 0)), np.maximum(size - 2, 0)) + 1
    fan = np.stack([ids[begin[middle_of]], ids[begin[middle_of] + step], ids[begin[middle_of] + step + 1]], axis=1)
    pair_of = owner[ids[begin]]
    sound = np.linalg.norm(M.face_vectors(points, fan), axis=1) > tol[pair_of[middle_of]] ** 2
    fanned = size_full == size
    fanned &= (np.bincount(middle_of[~sound], minlength=len(size)) == 0) | (size_full == 3)
    centred = ~fanned & (size_full != 3)
    name = n + np.cumsum(centred) - 1
    total = np.stack([np.bincount(loop, points[ids, d], len(size)) for d in range(3)], axis=1) / size[:, None]
    v = np.concatenate([points, total[centred]])
    every = np.repeat(np.arange(len(size)), size_full)
    nxt = np.arange(len(full)) + 1
    nxt[start_full + size_full - 1] = start_full
    here = centred[every]
    spokes = np.stack([full, full[nxt], name[every]], axis=1)[here]
    faces = np.concatenate([fan[fanned[middle_of]], spokes])
    of = np.concatenate([pair_of[middle_of[fanned[middle_of]]], pair_of[every[here]]])
    good = M.proper(faces)
    faces, of = faces[good], of[good]
    live = _uncancelled(faces)
    faces, of = faces[live], of[live]
    order = np.argsort(of, kind="stable")
    return (*M.compact(v, faces[order]), of[order])


def _uncancelled(t: np.ndarray) -> np.ndarray:
    """The faces that ``csg._cancelled`` leaves, up to which of equal ones stay."""
    turned = np.take_along_axis(t, (t.argmin(axis=1)[:, None] + np.arange(3)) % 3, axis=1)
    way = turned[:, 1] < turned[:, 2]
    f = np.sort(t, axis=1)
    order = np.lexsort((way, f[:, 2], f[:, 1], f[:, 0]))
    head = _heads(*f[order].T)
    group = np.cumsum(head) - 1
    w = way[order]
    up, down = np.bincount(group, w), np.bincount(group, ~w)
    begin = np.flatnonzero(head)
    rank = np.arange(len(t)) - begin[group] - np.where(w, down[group], 0).astype(np.int64)
    keep = np.empty(len(t), bool)
    keep[order] = rank >= np.where(w, down[group], up[group])
    return keep


def booleans(kind: str, pairs: list[tuple], tolerance: float | None = None) -> list:
    """``csg.boolean`` of each (av, at, bv, bt): a mesh, or the ``Failure`` of a pair that has none."""
    return _several((kind,), pairs, tolerance)[0]


def _several(kinds: tuple[str, ...], pairs: list[tuple], tolerance: float | None = None) -> list[list]:
    """``booleans`` of each kind; pieces are cut and placed once."""
    from . import csg

    out: list[list] = [[None] * len(pairs) for _ in kinds]
    fit = _fit([m for p in pairs for m in (p[:2], p[2:])]).reshape(-1, 2).all(axis=1) & (tolerance is None or tolerance > 0)
    for k in np.flatnonzero(~fit).tolist():
        for kind, found in zip(kinds, out, strict=True):
            try:
                found[k] = csg.boolean(kind, *pairs[k], tolerance=tolerance)
            except Failure as failure:
                found[k] = failure
    small = np.flatnonzero(fit).tolist()
    for these in _bins([len(pairs[k][1]) * len(pairs[k][3]) for k in small]):
        given = [pairs[small[x]] for x in these.tolist()]
        for found, made in zip(out, _pass(kinds, [(p[:2], p[2:]) for p in given], tolerance), strict=True):
            for x, mesh in zip(these.tolist(), made, strict=True):
                found[small[x]] = mesh
    return out


def together(kind: str, groups: list[list[tuple[np.ndarray, np.ndarray]]]) -> list:
    """``unions`` or ``differences`` of groups. Where a group is a few small solids, each is cut by all others at once, so that no result in between is
    sewn and merged only to be cut again; other groups go step by step."""
    fit = np.array([2 <= len(g) <= MOST_OPERANDS and sum(len(t) for _, t in g) <= MOST_FACES for g in groups], bool)
    flat = [m for k in np.flatnonzero(fit).tolist() for m in groups[k]]
    if flat:
        good = _fit(flat)
        good[good] = _solid([m for m, ok in zip(flat, good.tolist(), strict=True) if ok])
        fit[fit] = np.logical_and.reduceat(good, _starts(np.array([len(groups[k]) for k in np.flatnonzero(fit).tolist()], np.int64)))
    out: list = [None] * len(groups)
    rest = np.flatnonzero(~fit).tolist()
    for k, found in zip(rest, (unions if kind == "union" else differences)([groups[k] for k in rest]), strict=True):
        out[k] = found
    small = np.flatnonzero(fit).tolist()
    for these in _bins([sum(len(t) for _, t in groups[k]) ** 2 // 6 for k in small]):
        for x, mesh in zip(these.tolist(), _pass((kind,), [groups[small[x]] for x in these.tolist()])[0], strict=True):
            out[small[x]] = mesh
    return out


def _folded(kind: str, groups: list, steps) -> list:
    """Booleans over groups: ``steps`` yields the (group, left, right) of the operands that meet next; the left one takes the result."""
    failed: dict[int, Failure] = {}
    for step in steps:
        meet = [(g, a, b) for g, a, b in step if g not in failed]
        for (g, a, _), found in zip(meet, booleans(kind, [(*groups[g][a], *groups[g][b]) for g, a, b in meet]), strict=True):
            if isinstance(found, Failure):
                failed[g] = found
            else:
                groups[g][a] = found
    return [failed.get(g, group[0]) for g, group in enumerate(groups)]


def unions(groups: list[list[tuple[np.ndarray, np.ndarray]]]) -> list:
    """``csg.union_all`` of each group."""
    if any(not g for g in groups):
        raise ValueError("groups have operands")
    most = max(map(len, groups), default=1)
    levels = [1 << k for k in range((most - 1).bit_length())]
    return _folded("union", [list(g) for g in groups], ([(g, k, k + w) for g, group in enumerate(groups) for k in range(0, len(group) - w, 2 * w)] for w in levels))


def differences(groups: list[list[tuple[np.ndarray, np.ndarray]]]) -> list:
    """``csg.subtract_all`` of each group."""
    live = [g[:1] + _apart(g[0], g[1:]) for g in groups]
    steps = ([(g, 0, k) for g, group in enumerate(live) if k < len(group) and len(group[0][1]) and len(group[k][1])] for k in range(1, max(map(len, live), default=1)))
    return _folded("subtract", live, steps)


def _apart(first: tuple[np.ndarray, np.ndarray], tools: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tools whose boxes lie apart are put into one mesh of several shells: what they take away together is what they take one by one."""
    if len(tools) < 2 or not all(stackable(*m) for m in (first, *tools)):
        return list(tools)
    low, high = (np.array([f(v, axis=0) for v, _ in tools]) for f in (np.min, np.max))
    gap = 8 * max(M.RELATIVE * float(np.linalg.norm(np.maximum(high.max(axis=0), first[0].max(axis=0)) - np.minimum(low.min(axis=0), first[0].min(axis=0)))), M.LEAST)
    meet = ((low[:, None] <= high[None] + gap) & (low[None] <= high[:, None] + gap)).all(axis=2)
    sets: list[list[int]] = []
    for k, (_, t) in enumerate(tools):
        fit = (x for x in sets if not meet[k, x].any() and sum(len(tools[j][1]) for j in x) + len(t) <= MOST_FACES // 2)
        into = next(fit, None)
        if into is None:
            sets.append([k])
        else:
            into.append(k)
    out = []
    for x in sets:
        at = _starts(np.array([len(tools[k][0]) for k in x], np.int64))
        v, t = np.concatenate([tools[k][0] for k in x]), np.concatenate([tools[k][1] + i for k, i in zip(x, at.tolist(), strict=True)])
        h, n = M.half_edges(t), np.int64(len(v))
        # an open shell has a winding number outside its box too, where it would count for others
        closed = len(x) == 1 or np.array_equal(np.sort(h[:, 0] * n + h[:, 1]), np.sort(h[:, 1] * n + h[:, 0]))
        out += [(v, t)] if closed else [tools[k] for k in x]
    return out


def halves(rows: list[tuple]) -> list:
    """``csg.split`` of each (v, t, normal, offset): (front, back), or its ``Failure``."""
    from . import csg

    out: list = [None] * len(rows)
    small = [k for k, (v, t, n, _) in enumerate(rows) if n is not None and stackable(v, t)]
    crossed, boxes = [], []
    for k in sorted(set(range(len(rows))) - set(small)):
        try:
            out[k] = csg.split(*rows[k])
        except Failure as failure:
            out[k] = failure
    normal, offset = np.array([rows[k][2] for k in small], float).reshape(-1, 3), np.array([rows[k][3] for k in small], float)
    size = np.sqrt(bvh.dots(normal, normal))
    sound = np.isfinite(size) & np.isfinite(offset) & (size >= 1e-12)
    for k in np.flatnonzero(~sound).tolist():
        out[small[k]] = Failure("Transforms.NonFinite")
    small, normal, offset = [small[k] for k in np.flatnonzero(sound)], normal[sound] / size[sound, None], offset[sound] / size[sound]
    if small:
        s = Stack([rows[k][:2] for k in small])
        owner = np.repeat(np.arange(len(small)), s.nv)
        d = (bvh.dots(s.v, normal[owner]) - offset[owner])[s.t]
        front, back = np.minimum.reduceat(d.min(axis=1), s.t0) >= -1e-12, np.maximum.reduceat(d.max(axis=1), s.t0) <= 1e-12
        none = (np.zeros((0, 3)), np.zeros((0, 3), np.int64))
        for k in np.flatnonzero(front | back).tolist():
            mesh = rows[small[k]][:2]
            out[small[k]] = (mesh, none) if front[k] else (none, mesh)
        some = np.flatnonzero(~(front | back))
        crossed = [small[k] for k in some.tolist()]
        boxes = [(*rows[k][:2], v, _HALF) for k, v in zip(crossed, _half_spaces(s.low[some], s.high[some], normal[some], offset[some]), strict=True)]
    for k, front, back in zip(crossed, *_several(("subtract", "intersect"), boxes), strict=True):
        out[k] = next((x for x in (front, back) if isinstance(x, Failure)), (front, back))
    return out


# The faces of a box whose corners are numbered as in ``csg.half_space``.
_HALF = np.array([f for a, b, c, d in ((0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)) for f in ((a, b, c), (a, c, d))])


def _half_spaces(low: np.ndarray, high: np.ndarray, n: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The corners of ``csg.half_space`` for each box and plane with a unit normal."""
    middle, reach = (low + high) / 2, np.linalg.norm(high - low, axis=1)[:, None] + 1
    c = middle - (bvh.dots(middle, n) - o)[:, None] * n
    u = bvh.cross(n, np.where(np.abs(n[:, :1]) < 0.6, [[1.0, 0, 0]], [[0, 1.0, 0]]))
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    w = bvh.cross(n, u)
    return np.stack([c + (2 * (i & 1) - 1) * reach * u + (2 * (i >> 1 & 1) - 1) * reach * w + (0 if i >> 2 & 1 else -2) * reach * n for i in range(8)], axis=1)


def _pass(kinds: tuple[str, ...], groups: list, tolerance: float | None = None) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Each kind of boolean of groups of meshes: all united, what all share, or the first without the others."""
    s, size = Stack([m for g in groups for m in g]), np.array([len(g) for g in groups], np.int64)
    first, group = _starts(size), np.repeat(np.arange(len(groups)), size)
    role = np.arange(len(group)) - first[group]
    if tolerance is None:
        reach = np.linalg.norm(np.maximum.reduceat(s.high, first) - np.minimum.reduceat(s.low, first), axis=1)
        tol = np.maximum(M.RELATIVE * reach, M.LEAST) / 8
    else:
        tol = np.full(len(groups), tolerance / 8)
    f, others = Faces(s), _others(size)
    parts, cut = _fragments(f, f, tol[group], others)
    sides = Sides(f, parts, cut, s, tol[group], others)
    out = []
    for kind in kinds:
        v, t, of = _sewn(_kept(f, parts, sides.chosen(kind, role), role > 0 if kind == "subtract" else None, group), tol)
        v, t, of = coplanar.merged_many(v, t, of, 8 * tol)
        out.append(unstacked(v, t, of, len(groups)))
    return out


def unstacked(v: np.ndarray, t: np.ndarray, of: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The meshes of a compact stack whose faces are sorted by mesh."""
    counts = np.bincount(of, minlength=n)
    ends = np.cumsum(counts)
    top = np.maximum.accumulate(t.max(axis=1)) + 1 if len(t) else np.zeros(0, np.int64)
    out, base = [], 0
    for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if hi == lo:
            out.append((np.zeros((0, 3)), np.zeros((0, 3), np.int64)))
            continue
        last = int(top[hi - 1])
        out.append((v[base:last], t[lo:hi] - base))
        base = last
    return out
