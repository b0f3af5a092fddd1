"""Every query with a closed form equals DuckDB's answer on the smallest tables; operators run on streams and through the data source."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triloom.operators import generate, measure, spatial, transform
from triloom.plans import workload
from triloom.sources import meshio
from triloom.types import vec3

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got, want = workload.QUERIES[name](spark, SF).toPandas(), duck.sql(workload.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_unreferenced_vertices_searches_all_parts(spark, monkeypatch):
    given = []
    monkeypatch.setattr(measure, "unreferenced", given.append)
    workload.QUERIES["unreferenced_vertices"](spark, SF)
    assert given[0].count() == workload.parts(spark, SF).count()


def test_operators_run_on_a_stream(spark, tmp_path):
    workload.parts(spark, SF).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("mesh_id long, sx double, sy double, sz double").parquet(str(tmp_path / "in"))
    moved = transform.translate(workload.box(rows), 1.0, 2.0, 3.0)
    q = measure.statistics(moved).writeStream.format("memory").queryName("volumes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("volumes").where("volume > 0").count() == workload.parts(spark, SF).count()


def test_mesh_file_source(spark, tmp_path):
    meshio.register(spark)
    m = workload.box(workload.parts(spark, SF).limit(3)).withColumn("name", F.concat(F.lit("m"), "mesh_id")).select("name", "vertices", "triangles", "error_code")
    m.write.format("meshfile").option("format", "ply").mode("append").save(str(tmp_path / "out"))
    (tmp_path / "out" / "bad.obj").write_text("f 1 2 3")
    back = {r["name"]: r for r in spark.read.format("meshfile").load(str(tmp_path / "out")).collect()}
    assert len(back) == 4 and back["bad"]["error_code"] == "MeshIO.Unreadable"
    found = {r["name"]: r["error_code"] for r in meshio.import_files(spark, str(tmp_path / "out")).collect()}
    assert found["bad"] == "MeshIO.Unreadable" and list(found.values()).count(None) == 3
    with pytest.raises(Exception, match="FileExists"):
        m.write.format("meshfile").option("format", "ply").mode("append").save(str(tmp_path / "out"))


def test_mesh_file_writes_are_whole_or_nothing(spark, tmp_path):
    meshio.register(spark)
    m = workload.box(workload.parts(spark, SF).where("mesh_id <= 4")).withColumn("name", F.concat(F.lit("m"), "mesh_id")).select("name", "vertices", "triangles")
    bad = m.withColumn("triangles", F.when(F.col("name") == "m3", F.lit(None).cast(m.schema["triangles"].dataType)).otherwise(F.col("triangles")))
    with pytest.raises(Exception):  # noqa: B017
        bad.repartition(4).write.format("meshfile").option("format", "obj").mode("append").save(str(tmp_path / "torn"))
    assert not list((tmp_path / "torn").glob("*.obj")) and not list((tmp_path / "torn").glob(".stage-*"))
    m.write.format("meshfile").option("format", "obj").mode("append").save(str(tmp_path / "out"))
    (tmp_path / "out" / "old.obj").write_text("v 0 0 0")
    m.limit(2).write.format("meshfile").option("format", "obj").mode("overwrite").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 2
    gone = spark.read.format("meshfile").load(str(tmp_path / "nowhere")).collect()
    assert [(r["name"], r["error_code"]) for r in gone] == [("nowhere", "MeshIO.FileNotFound")]


def test_nearest_rows_equal_the_nested_form(spark):
    balls = workload.big_spheres(spark, SF).limit(2).drop("points")
    points = balls.select("mesh_id").join(spark.range(200).select((F.col("id") % 7).alias("a"), "id")).select("mesh_id", F.col("id").alias("pid"), vec3(F.sin(F.col("id") * 1.0) * 9, F.cos(F.col("id") * 2.0) * 9, F.sin(F.col("id") * 3.0) * 9).alias("p"))
    rows = {(r["mesh_id"], r["pid"]): (r["distance"], r["tid"]) for r in spatial.closest_rows(points, balls, 300).collect()}
    nested = balls.join(points.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("pid", "p"))).alias("q")), "mesh_id").withColumn("points", F.col("q.p"))
    for r in spatial.closest(nested).select("mesh_id", F.explode(F.arrays_zip("q", "hits")).alias("h")).select("mesh_id", "h.q.pid", "h.hits.distance", "h.hits.tid").collect():
        d, tid = rows[r["mesh_id"], r["pid"]]
        assert d == pytest.approx(r["distance"], abs=1e-12) and tid == r["tid"]
    assert len(rows) == 400


def test_failures_are_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, float("nan"))], "mesh_id long, r double")
    got = {r["mesh_id"]: r["error_code"] for r in measure.statistics(generate.cylinders(df, vec3(0, 0, 0), F.col("r"), F.lit(1.0))).collect()}
    assert got == {1: None, 2: "Generators.NonPositiveRadius", 3: "Generators.NonFiniteParameter"}


def test_unreferenced_vertices_need_no_join(spark):
    """Empty meshes, and meshes without faces or vertices, keep their answers; nothing is exploded into a join that could be broadcast."""
    kinds = "mesh_id long, vertices array<struct<x:double,y:double,z:double>>, triangles array<struct<a:int,b:int,c:int>>"
    p = (0.0, 0.0, 0.0)
    df = spark.createDataFrame([(1, [p] * 5, [(0, 1, 2), (1, 2, 4)]), (2, [p] * 2, []), (3, [], []), (4, None, None), (5, [p] * 2, None)], kinds)
    found = measure.unreferenced(df)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 3), (2, 0), (2, 1), (5, 0), (5, 1)]


@pytest.mark.parametrize("name", ["overlapping_faces", "closest_points", "raycast", "signed_distances"])
def test_meshes_are_not_broadcast(spark, name):
    plan = workload.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_tubes_use_all_cores(spark):
    assert workload.QUERIES["tubes"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["raycast", "signed_distances"])
def test_batches_carry_keys_and_queries_only(spark, monkeypatch, name):
    """What a line needs in an Arrow batch is its key and what the kernel reads; a second copy of its point is not carried along."""
    given = []
    real = getattr(spatial, name)
    monkeypatch.setattr(spatial, name, lambda rows: given.append(rows) or real(rows))
    workload.QUERIES[name](spark, SF)
    kinds = dict(given[0].dtypes)
    assert kinds["lines"] == "array<struct<l_orderkey:bigint,l_linenumber:int>>"
    assert [c for c in kinds if c in ("points", "origins")] == (["origins"] if name == "raycast" else ["points"])


def test_lines_are_dealt_over_tasks_by_their_bytes(spark):
    lines = workload.load(spark, SF, "lineitem").select("l_partkey")
    least = 2 * spark.sparkContext.defaultParallelism
    assert workload.enough_tasks(lines) == least and workload.enough_tasks(lines, 100) > least
    assert workload.signed_distances(spark, SF).rdd.getNumPartitions() == least
