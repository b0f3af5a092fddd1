"""Many small meshes at once give what one mesh after the other gives."""

import numpy as np
import pytest

from triloom.kernels import csg, many, planar
from triloom.kernels import mesh as M
from triloom.kernels.batch import Failure
from triloom.operators import modify
from triloom.operators.generate import BOX_QUADS

BOX = np.array([f for a, b, c, d in BOX_QUADS for f in ((a, b, c), (a, c, d))])


def box(low, size, turn=None):
    v = np.array([[i & 1, i >> 1 & 1, i >> 2 & 1] for i in range(8)], float) * size + low
    return (v if turn is None else v @ turn.T), BOX


def ball(n, radius, center):
    up, turn = np.meshgrid(np.arange(1, n // 2) * np.pi / (n // 2), np.arange(n) * 2 * np.pi / n, indexing="ij")
    ring = np.stack([np.sin(up) * np.cos(turn), np.sin(up) * np.sin(turn), np.cos(up)], axis=-1).reshape(-1, 3)
    at = lambda i, s: 2 + (i - 1) * n + s % n
    t = [f for s in range(n) for f in ((0, at(1, s), at(1, s + 1)), (1, at(n // 2 - 1, s + 1), at(n // 2 - 1, s)))]
    t += [f for i in range(1, n // 2 - 1) for s in range(n) for f in ((at(i, s), at(i + 1, s), at(i + 1, s + 1)), (at(i, s), at(i + 1, s + 1), at(i, s + 1)))]
    return np.concatenate([[[0, 0, 1], [0, 0, -1]], ring]) * radius + center, np.array(t)


def rotation(rng):
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    return q * np.sign(np.linalg.det(q))


def pairs(seed=5):
    """Boxes that touch, share sides, hold or miss each other; turned boxes; balls; and very small and very large ones."""
    rng = np.random.default_rng(seed)
    out = [(*box((0, 0, 0), (1 + k % 9, 1 + k % 7, 1 + k % 5)), *box((k % 3, k % 2, 0.5), (1 + k % 11, 1 + k % 4, 1 + k % 6))) for k in range(60)]
    out += [(*box(rng.uniform(-1, 1, 3), rng.uniform(0.5, 2, 3), rotation(rng)), *box(rng.uniform(-1, 1, 3), rng.uniform(0.5, 2, 3), rotation(rng))) for _ in range(40)]
    out += [(*ball(10, 1.0, rng.uniform(-0.6, 0.6, 3)), *ball(8, 0.8, rng.uniform(-0.6, 0.6, 3))) for _ in range(10)]
    out += [(*ball(12, 1.0, np.zeros(3)), *box((-2, -0.3, -0.3), (4, 0.5, 0.5)))]
    out += [(a[0] * s, a[1], a[2] * s, a[3]) for s in (1e-5, 1e6) for a in out[:8]]
    return out


def measures(v, t):
    if not len(t):
        return 0.0, True, 0
    audit = M.topology(v, t, 0.0 + 1e-15)
    return M.volume(v, t), audit["boundary_edges"] == 0, audit["winding_errors"]


def same(got, want, scale):
    (a, closed, wound), (b, closed2, wound2) = measures(*got), measures(*want)
    return closed == closed2 and wound <= wound2 and abs(a - b) <= 1e-6 * scale and len(got[1]) <= len(want[1]) + 2


def sized(p):
    return abs(M.volume(*p[:2])) + abs(M.volume(*p[2:]))


@pytest.mark.parametrize("kind", ["union", "subtract", "intersect"])
def test_booleans_of_many_equal_single_ones(kind):
    given = pairs()
    for p, got in zip(given, many.booleans(kind, given), strict=True):
        assert same(got, csg.boolean(kind, *p), sized(p))


def test_many_booleans_are_not_made_one_by_one(monkeypatch):
    monkeypatch.setattr(csg, "boolean", lambda *_, **__: pytest.fail("one mesh at a time"))
    given = pairs()
    assert len(many.booleans("union", given)) == len(given)


def test_odd_pairs_keep_their_answers():
    """An empty operand is a failure of its pair only; a large mesh goes through its tree."""
    a, b, large = box((0, 0, 0), (1, 1, 1)), box((0.5, 0.5, 0.5), (1, 1, 1)), ball(40, 1.0, np.zeros(3))
    none = (np.zeros((0, 3)), np.zeros((0, 3), np.int64))
    got = many.booleans("union", [(*a, *none), (*a, *b), (*large, *b)])
    assert isinstance(got[0], Failure) and got[0].code == "Mesh.EmptyOperand"
    assert M.volume(*got[1]) == pytest.approx(1.875) and M.volume(*got[2]) == pytest.approx(M.volume(*csg.boolean("union", *large, *b)))
    with pytest.raises(IndexError):
        many.booleans("union", [(*a, *b), (a[0], a[1] + 1, *b)])


def test_topologies_equal_single_ones():
    rng = np.random.default_rng(3)
    meshes = [p[:2] for p in pairs()] + [csg.boolean("union", *p) for p in pairs()[:30]]
    meshes += [(np.concatenate([v, v[:2] + 5e-10, [[9, 9, 9]]]), np.concatenate([t[1:], t[3:4], t[4:5, ::-1], [[0, 0, 1]], rng.integers(0, len(v) + 2, (3, 3))])) for v, t in meshes[:50]]
    assert many.topologies(meshes, 1e-9) == [M.topology(*m, 1e-9) for m in meshes]


def _together(monkeypatch):
    monkeypatch.setattr(csg, "boolean", lambda *_, **__: pytest.fail("one mesh at a time"))


def test_many_subtractions_are_made_together(monkeypatch):
    given = pairs()[:60]
    want = [csg.boolean("subtract", *p) for p in given]
    _together(monkeypatch)
    assert all(same(a, b, sized(p)) for a, b, p in zip(many.booleans("subtract", given), want, given, strict=True))


def test_many_intersections_are_made_together(monkeypatch):
    given = pairs()[:60]
    want = [csg.boolean("intersect", *p) for p in given]
    _together(monkeypatch)
    assert all(same(a, b, sized(p)) for a, b, p in zip(many.booleans("intersect", given), want, given, strict=True))


def groups():
    """Groups of one to five boxes, some of which miss all others."""
    rng = np.random.default_rng(11)
    return [[box(rng.integers(0, 5, 3) / 2 + (k == 3) * 50, rng.integers(1, 6, 3) / 2) for k in range(1 + n % 5)] for n in range(60)]


def total(group):
    return sum(M.volume(*m) for m in group)


def test_unions_of_groups_are_made_together(monkeypatch):
    given = groups()
    want = [csg.union_all(g) for g in given]
    _together(monkeypatch)
    assert all(same(a, b, total(g)) for a, b, g in zip(many.unions(given), want, given, strict=True))


def test_differences_of_groups_are_made_together(monkeypatch):
    """Also where nothing is left after a step."""
    given = groups() + [[box((0, 0, 0), (1, 1, 1)), box((-1, -1, -1), (3, 3, 3)), box((0, 0, 0), (1, 1, 1))]]
    want = [csg.subtract_all(g) for g in given]
    _together(monkeypatch)
    got = many.differences(given)
    assert all(same(a, b, total(g)) for a, b, g in zip(got, want, given, strict=True)) and not len(got[-1][1])


def test_drilled_plates_are_made_together(monkeypatch):
    """Holes are bridged and the flat sides have the fewest faces there are; plates with many holes are clipped one by one."""
    holes = [box((-17 + 4.5 * k, -11 + 3 * (k % 4), -1), (2, 2, 4)) for k in range(8)]
    given = [[box((-20, -20, 0), (40, 40, 2)), *holes[: 1 + n % 8]] for n in range(16)]
    _together(monkeypatch)
    for n, (v, t) in enumerate(many.differences(given)):
        k = 1 + n % 8
        assert M.volume(v, t) == pytest.approx(3200 - 8 * k) and len(t) == 12 + 20 * k and M.topology(v, t)["boundary_edges"] == 0


def test_splits_are_made_together(monkeypatch):
    given = [(*p[:2], np.array([0.3, k % 3, 1.0]), 0.1 * k) for k, p in enumerate(pairs()[:110])] + [(*BOX_AT, np.zeros(3), 0.5)]
    want = [csg.split(*p) for p in given[:-1]]
    _together(monkeypatch)
    got = many.halves(given)
    assert isinstance(got[-1], Failure) and got[-1].code == "Transforms.NonFinite"
    for p, a, b in zip(given, got, want, strict=False):
        assert all(same(x, y, abs(M.volume(*p[:2]))) for x, y in zip(a, b, strict=True))


BOX_AT = box((0, 0, 0), (1, 1, 1))


def test_shells_of_many_are_found_and_united_together(spark):
    given = [g for g in groups() if len(g) > 1]
    piles = [(np.concatenate([v for v, _ in g]), np.concatenate([t + 8 * k for k, (_, t) in enumerate(g)])) for g in given]
    parts, single = many.components(piles), [M.components(*p) for p in piles]
    assert all(len(a) == len(b) and all(np.array_equal(x, y) for m, n in zip(a, b, strict=True) for x, y in zip(m, n, strict=True)) for a, b in zip(parts, single, strict=True))
    rows = [(k, [tuple(map(float, p)) for p in v], [tuple(map(int, f)) for f in t], None) for k, (v, t) in enumerate(piles)]
    df = spark.createDataFrame(rows, "mesh_id long, vertices array<struct<x:double,y:double,z:double>>, triangles array<struct<a:int,b:int,c:int>>, error_code string")
    for r in modify.repair_self_intersections(df).collect():
        v, t = np.array(r["vertices"]), np.array(r["triangles"])
        assert same((v, t), csg.union_all(single[r["mesh_id"]]), total(given[r["mesh_id"]]))


@pytest.mark.parametrize("depth", [None, 0.7])
def test_peaks_of_many_equal_single_ones(depth):
    """Plateaus, several peaks a part, parts beside and over each other, doubled vertices, a slanted direction."""
    rng = np.random.default_rng(7)
    piles = [(np.concatenate([v for v, _ in g]), np.concatenate([t + 8 * k for k, (_, t) in enumerate(g)])) for g in groups()]
    made = [csg.union_all(g) for g in groups()[:20]] + [p[:2] for p in pairs()[60:110]]
    soups = [(v[t].reshape(-1, 3), np.arange(3 * len(t)).reshape(-1, 3)) for v, t in made[:10]]
    rough = [(v + rng.normal(0, 0.2, v.shape), t) for v, t in [ball(10, 1.0, np.zeros(3))] * 10]
    meshes = piles + made + soups + rough
    for up in (np.array([0, 0, 1.0]), np.array([1.0, -2.0, 0.5])):
        for m, got in zip(meshes, many.peaks(meshes, up, 1e-6, depth), strict=True):
            want = many._single_peaks(*m, up, 1e-6, depth)
            assert got.size == want.size and np.array_equal(got.columns["vid"], want.columns["vid"])
            for name in ("point", "normal", "height", "prominence", "summit"):
                np.testing.assert_allclose(got.columns[name], want.columns[name], atol=1e-9)
            assert depth is None or np.array_equal(got.columns["within_reach"], want.columns["within_reach"])


def test_peaks_of_many_are_not_found_one_by_one(monkeypatch):
    monkeypatch.setattr(M, "peaks", lambda *_: pytest.fail("one mesh at a time"))
    found = many.peaks([box((k, 0, 0), (1, 1, 1 + k)) for k in range(50)], np.array([0, 0, 1.0]), 1e-6, None)
    assert [float(r.columns["height"][0]) for r in found] == list(range(1, 51))


def offset_rings():
    """Rectangles, convex and other rings, thin and tiny ones, in both directions."""
    rng = np.random.default_rng(2)
    out = [np.array([(0, 0), (x, 0), (x, y), (0, y)], float) for x in (0.3, 1, 7.5, 50) for y in (1, 3)]
    out += [planar.hull(rng.normal(0, 3, (30, 2))) for _ in range(10)]
    out += [np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float), np.array([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(0, 0), (4, 0), (4, 1e-5), (4, 4), (0, 4)], float)]
    star = np.array([(np.cos(k * 4 * np.pi / 5), np.sin(k * 4 * np.pi / 5)) for k in range(5)])
    return [x for r in [*out, star * 5] for x in (r, r[::-1], np.roll(r, 2, axis=0))]


@pytest.mark.parametrize("d", [1.0, 0.01, 1e-4, -0.25, -0.01, -3.0, 0.0])
def test_offsets_of_many_equal_single_ones(d):
    given = [*offset_rings(), np.zeros((2, 2))]
    for r, got in zip(given, planar.offsets(given, d), strict=True):
        try:
            want = planar.offset(r, d)
        except Failure as failure:
            assert isinstance(got, Failure) and got.code == failure.code
            continue
        assert planar.signed_area(got) == pytest.approx(planar.signed_area(want), rel=1e-6, abs=2e-4) and planar.signed_area(got) > 0
        np.testing.assert_allclose(got.min(axis=0), want.min(axis=0), atol=3e-5)
        np.testing.assert_allclose(got.max(axis=0), want.max(axis=0), atol=3e-5)


@pytest.mark.parametrize("d", [1.0, -0.25])
def test_convex_offsets_need_no_arrangement(d, monkeypatch):
    monkeypatch.setattr(planar, "combine", lambda *_: pytest.fail("one ring at a time"))
    assert all(len(r) >= 4 for r in planar.offsets([np.array([(0, 0), (x, 0), (x, 2), (0, 2)], float) for x in range(1, 40)], d))


def test_faces_of_a_box_are_cut_as_six_squares():
    a = many.Stack([box((0, 0, 0), (2, 2, 2))])
    assert sorted(many.Faces(a).n.tolist()) == [4] * 6
    turned = rotation(np.random.default_rng(3))
    assert sorted(many.Faces(many.Stack([box((5, 1, 2), (2, 3, 4), turned), ball(8, 1.0, np.zeros(3))])).n.tolist())[-6:] == [4] * 6


def test_planes_cut_only_where_their_faces_lie():
    """A thin rod through a plate: only pieces beside the hole arise, not a grid."""
    a, b = many.Stack([box((-5, -5, 0), (10, 10, 1))]), many.Stack([box((-1, -1, -1), (2, 2, 3))])
    parts, _ = many._fragments(many.Faces(a), many.Faces(b), np.array([1e-8]))
    assert len(parts.n) == 4 + 2 * 5


def test_split_cuts_once_for_both_halves(monkeypatch):
    passes = []
    inner = many._pass
    monkeypatch.setattr(many, "_pass", lambda kinds, *rest: passes.append(kinds) or inner(kinds, *rest))
    rows = [(*box((0, 0, 0), (k + 1, 2, 3)), np.array([0, 0, 2.0]), 1.0) for k in range(5)]
    for k, (front, back) in enumerate(many.halves(rows)):
        assert M.volume(*front) == pytest.approx((k + 1) * 5) and M.volume(*back) == pytest.approx(k + 1)
    assert passes == [("subtract", "intersect")]


def test_splits_of_many_equal_single_ones():
    rng = np.random.default_rng(8)
    rows = [(*box(rng.uniform(-1, 1, 3), rng.uniform(0.5, 2, 3), rotation(rng)), rng.normal(size=3), rng.normal() * 0.3) for _ in range(40)]
    rows += [(*box((0, 0, 0), (1, 1, 1)), np.array([0, 0, 1.0]), o) for o in (-1.0, 0.0, 1.0, 3.0)] + [(*box((0, 0, 0), (1, 1, 1)), np.zeros(3), 0.0), (*box((0, 0, 0), (1, 1, 1)), np.array([0, 0, np.nan]), 0.0)]
    for row, got in zip(rows, many.halves(rows), strict=True):
        try:
            want = csg.split(*row)
        except Failure as failure:
            assert isinstance(got, Failure) and got.code == failure.code
            continue
        assert all(same(g, w, abs(M.volume(*row[:2]))) for g, w in zip(got, want, strict=True))


def test_tools_that_lie_apart_are_taken_away_together(monkeypatch):
    steps = []
    inner = many.booleans
    monkeypatch.setattr(many, "booleans", lambda kind, pairs, *rest: steps.append(len(pairs)) or inner(kind, pairs, *rest))
    plate, holes = box((-20, -20, 0), (40, 40, 5)), [box((-17 + 4.5 * k, -11 + 3 * (k % 4), -1), (2, 2, 7)) for k in range(8)]
    (v, t), = many.differences([[plate, *holes]])
    assert steps == [1] and M.volume(v, t) == pytest.approx(5 * (1600 - 32)) and len(t) == 172 and M.topology(v, t)["boundary_edges"] == 0
    # tools that meet stay apart steps, and so do open ones
    steps.clear()
    (v, t), = many.differences([[plate, box((0, 0, -1), (2, 2, 7)), box((1, 1, -1), (2, 2, 7))]])
    assert steps == [1, 1] and M.volume(v, t) == pytest.approx(5 * (1600 - 7))
    lid = (holes[0][0], holes[0][1][2:])
    assert len(many._apart(plate, [lid, holes[1]])) == 2


def test_volumes_of_many_equal_single_ones():
    meshes = [m for p in pairs()[:70] for m in (p[:2], p[2:])] + [ball(40, 1.0, np.zeros(3))]
    assert np.allclose(many.volumes(meshes), [M.volume(*m) for m in meshes], rtol=1e-12, atol=0)
