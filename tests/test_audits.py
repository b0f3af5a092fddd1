"""Results of booleans that are measured where they are made."""

import numpy as np
import pytest
from test_many import box, pairs

from triloom.operators import measure, solid
from triloom.plans import workload as W


def _rows(spark, meshes):
    """(mesh_id, vertices, triangles, other_vertices, other_triangles, error_code)"""
    point, face = "array<struct<x:double,y:double,z:double>>", "array<struct<a:int,b:int,c:int>>"
    made = [(k, *[[tuple(map(float if i % 2 == 0 else int, r)) for r in x] for i, x in enumerate(p)], None) for k, p in enumerate(meshes)]
    return spark.createDataFrame(made, f"mesh_id long, vertices {point}, triangles {face}, other_vertices {point}, other_triangles {face}, error_code string")


@pytest.mark.parametrize("kind", ["union", "subtract", "intersect"])
def test_results_are_measured_where_they_are_made(spark, kind):
    """Also those that are empty or have no operand."""
    none = (np.zeros((0, 3)), np.zeros((0, 3), np.int64))
    df = _rows(spark, [*pairs()[:40], (*box((0, 0, 0), (1, 1, 1)), *box((5, 5, 5), (1, 1, 1))), (*box((0, 0, 0), (1, 1, 1)), *none)])
    one, two = measure.audited(solid.boolean(df, kind)), solid.boolean(df, kind, audit=True)
    columns = ["mesh_id", *measure.COUNTERS, "volume", "n_triangles", "error_code"]
    assert one.select(columns).orderBy("mesh_id").collect() == two.select(columns).orderBy("mesh_id").collect()


def test_intersect_takes_one_pass(spark):
    plan = W.intersect(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
