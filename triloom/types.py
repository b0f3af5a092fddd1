"""Schemas, error codes and the two forms of a mesh: nested rows and normalised tables.

A nested row holds a whole mesh, so an operator on it needs no shuffle; it is the form that all operators take. The
normalised form (``vertices``, ``triangles``) serves meshes too large for one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VEC3 = "struct<x:double,y:double,z:double>"
VEC2 = "struct<x:double,y:double>"
FACE = "struct<a:int,b:int,c:int>"
RING = f"array<{VEC2}>"
POLYGON = f"struct<outer:{RING},holes:array<{RING}>>"
MESH = f"vertices array<{VEC3}>, triangles array<{FACE}>, name string, created_by string, annotations map<string,string>, error_code string"

RAGGED, OUT_OF_RANGE, NON_FINITE, EMPTY = "Mesh.RaggedTriangleArray", "Mesh.IndexOutOfRange", "Mesh.NonFiniteVertex", "Mesh.EmptyOperand"


def vec3(x, y, z) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"), as_col(z).cast("double").alias("z"))


def create_meshes(df: DataFrame, vertices: str = "vertices", indices: str = "indices") -> DataFrame:
    """Nested meshes from a vertex array and a flat index array; the first failed check is the row's error_code."""
    n = F.size(vertices)
    bad_vertex = F.exists(vertices, lambda v: v["x"].isNull() | v["y"].isNull() | v["z"].isNull() | F.isnan(v["x"] - v["x"]) | F.isnan(v["y"] - v["y"]) | F.isnan(v["z"] - v["z"]))
    code = F.when(F.size(indices) % 3 != 0, RAGGED).when(F.exists(indices, lambda i: (i < 0) | (i >= n)), OUT_OF_RANGE).when(bad_vertex, NON_FINITE)
    corner = lambda k, d: F.get(F.col(indices), k * 3 + d).cast("int")
    faces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(indices) / 3).cast("int") - 1, F.lit(0))), lambda k: F.struct(corner(k, 0).alias("a"), corner(k, 1).alias("b"), corner(k, 2).alias("c")))
    none = F.array().cast(f"array<{FACE}>")
    return df.withColumn("error_code", code).withColumn("triangles", F.when(F.col("error_code").isNull() & (F.size(indices) > 0), faces).otherwise(none)).drop(indices)


def to_tables(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mesh_id, vid, x, y, z) and (mesh_id, tid, a, b, c)."""
    v = meshes.select("mesh_id", F.posexplode("vertices").alias("vid", "p")).select("mesh_id", "vid", "p.*")
    t = meshes.select("mesh_id", F.posexplode("triangles").alias("tid", "f")).select("mesh_id", "tid", "f.*")
    return v, t


def from_tables(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Nested rows; the ordering keys are part of the data, as a shuffle keeps no order."""
    rows = lambda df, key, names, out: df.groupBy("mesh_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, *names))), lambda s: F.struct(*[s[n].alias(n) for n in names])).alias(out))
    v, t = rows(vertices, "vid", ["x", "y", "z"], "vertices"), rows(triangles, "tid", ["a", "b", "c"], "triangles")
    return v.join(t, "mesh_id", "left").withColumn("triangles", F.coalesce("triangles", F.array().cast(f"array<{FACE}>")))


def soup(meshes: DataFrame, *keep: str) -> DataFrame:
    """One row a face with its corners p, q, r; corner lookup happens inside the row, so there is no join."""
    corners = F.transform("triangles", lambda t, i: F.struct(i.alias("tid"), F.get("vertices", t["a"]).alias("p"), F.get("vertices", t["b"]).alias("q"), F.get("vertices", t["c"]).alias("r")))
    return meshes.select(*(keep or ("mesh_id",)), F.explode(corners).alias("s")).select(*(keep or ("mesh_id",)), "s.*")
