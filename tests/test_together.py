"""Groups of meshes cut by each other in one pass."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_many import BOX, ball, box, groups, rotation, same, total

from triloom.kernels import coplanar, csg, many
from triloom.kernels import mesh as M
from triloom.kernels.batch import Failure
from triloom.operators import measure, solid
from triloom.plans import workload as W

FOLDS = {"union": csg.union_all, "subtract": csg.subtract_all}


def solids():
    """Boxes that touch, share sides and lie in each other, in all orders; turned boxes; balls."""
    rng = np.random.default_rng(17)
    out = [g for g in groups() if len(g) > 1] + [[box((0, 0, 0), (2, 2, 2))] * k for k in (2, 3)]
    out += [[box((x, 0, 0), (1, 1, 1)), box((0, 0, 0), (3, 1, 1)), box((1, y, 0), (1, 1, 2))] for x in (0, 1, 3) for y in (-1, 0, 1)]
    out += [[box(rng.uniform(-1, 1, 3), rng.uniform(0.5, 2, 3), rotation(rng)) for _ in range(3)] for _ in range(12)]
    return out + [[ball(8, 1.0, rng.uniform(-0.6, 0.6, 3)) for _ in range(3)] for _ in range(4)]


@pytest.mark.parametrize("kind", ["union", "subtract"])
def test_groups_are_cut_in_one_pass(kind, monkeypatch):
    given = solids()
    want = [FOLDS[kind](g) for g in given]
    monkeypatch.setattr(many, "booleans", lambda *_: pytest.fail("a step of its own"))
    for got, w, g in zip(many.together(kind, given), want, given, strict=True):
        assert same(got, w, total(g))


@pytest.mark.parametrize("kind", ["union", "subtract"])
def test_other_groups_go_step_by_step(kind):
    """Open, inside-out, empty, single, large and many operands."""
    a, b, c = box((0, 0, 0), (2, 2, 2)), box((1, 1, 1), (2, 2, 2)), box((1, -1, 0), (2, 2, 1))
    given = [[a, (b[0], BOX[:, ::-1]), c], [a], [a, ball(40, 1.0, np.ones(3)), c], [a, b, c] + [box((k, 0.5, 0.5), (1, 2, 3)) for k in range(6)], [a, b, c]]
    given += [[a, (b[0], BOX[2:]), c]]
    for got, g in zip(many.together(kind, given), given, strict=True):
        want = (many.unions if kind == "union" else many.differences)([g])[0]
        assert isinstance(got, tuple) and M.volume(*got) == pytest.approx(M.volume(*want))


def test_points_in_convex_meshes():
    """Behind all planes is inside only in closed solids: not in an open box, a flat one or two that lie apart."""
    two = (np.concatenate([box((0, 0, 0), (1, 1, 1))[0], box((3, 0, 0), (1, 1, 1))[0]]), np.concatenate([BOX, BOX + 8]))
    flat = (np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], float), np.array([[0, 1, 2], [2, 1, 0]]))
    meshes = [box((0, 0, 0), (1, 2, 3)), (box((0, 0, 0), (1, 1, 1))[0], BOX[2:]), (box((0, 0, 0), (1, 1, 1))[0], BOX[:, ::-1]), two, flat, box((5, 5, 5), (1, 2, 3), rotation(np.random.default_rng(2)))]
    assert many.Stack(meshes).convex().tolist() == [True, False, False, False, False, True]


def test_outlines_are_filled_from_a_corner_that_sees_all():
    """An L has one such corner, a U none, and one that turns around its corner twice does not count."""
    ell, u = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], [(0, 0), (3, 0), (3, 2), (2, 2), (2, 1), (1, 1), (1, 2), (0, 2)]
    for ring, full in ((ell, 3.0), (u, None)):
        v = np.array([(*p, 0) for p in ring], float)
        got = coplanar._starred(v, np.arange(len(v))[None], np.array([7]), np.array([[0, 0, 1.0]]), np.array([1e-9]))
        assert list(got) == ([7] if full else [])
        if full:
            areas = M.face_vectors(v, got[7])[:, 2] / 2
            assert len(areas) == len(v) - 2 and (areas > 0).all() and areas.sum() == pytest.approx(full)


@pytest.mark.parametrize("kind", ["union", "subtract"])
def test_grouped_rows_and_rows_with_operands_are_one(spark, kind):
    rows = W.three(spark, "/root/testdata/sf0.001").limit(40).cache()
    grouped = rows.select(F.col("mesh_id").alias("group_id"), F.explode("operands").alias("o")).select("group_id", "o.*")
    columns = [*measure.COUNTERS, "volume", "n_triangles", "error_code"]
    one, two = solid.batch(rows, kind, audit=True).orderBy("mesh_id").select(columns).collect(), solid.batch(grouped, kind, audit=True).orderBy("group_id").select(columns).collect()
    assert one == two and one == measure.audited(solid.batch(grouped, kind)).orderBy("group_id").select(columns).collect()


@pytest.mark.parametrize("name", ["batch_union", "batch_subtract"])
def test_a_part_that_occurs_twice_is_two_groups(spark, tmp_path, name):
    """As in the SQL; grouped by key, its six boxes were one model."""
    duckdb.execute(f"COPY (SELECT * REPLACE (least(p_partkey, 190) AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
        want = sorted(c.execute(W.ORACLES[name]).fetchall())
    assert sorted(map(tuple, W.QUERIES[name](spark, str(tmp_path)).collect())) == want


def test_an_empty_operand_fails_its_group_only(spark):
    rows = W.three(spark, "/root/testdata/sf0.001").limit(3)
    holed = rows.withColumn("operands", F.when(F.col("mesh_id") % 2 == 0, F.transform("operands", lambda o, k: F.when(k == 1, o.withField("triangles", F.slice(o["triangles"], 1, 0))).otherwise(o))).otherwise(F.col("operands")))
    for r in solid.batch(holed, "union", audit=True).collect():
        assert (r.error_code == "Mesh.EmptyOperand") == (r.mesh_id % 2 == 0) and (r.volume == 0) == (r.mesh_id % 2 == 0)
    assert isinstance(many.together("union", [[box((0, 0, 0), (1, 1, 1)), (np.zeros((0, 3)), np.zeros((0, 3), np.int64))]])[0], Failure)
