"""Rigid and scaling maps as expressions over the vertex array, and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..kernels import space
from ..kernels.batch import per_row
from ..types import EMPTY, FACE, VEC3, vec3


def _mapped(meshes: DataFrame, point, bad: list[tuple[Column, str]]) -> DataFrame:
    code = F.when(F.size("triangles") == 0, EMPTY)
    for test, text in bad:
        code = code.when(test, text)
    out = meshes.withColumn("error_code", F.coalesce("error_code", code))
    return out.withColumn("vertices", F.when(F.col("error_code").isNull(), F.transform("vertices", point)).otherwise(F.col("vertices")))


def _bad(*values) -> Column:
    out = F.lit(False)
    for v in values:
        v = v if isinstance(v, Column) else F.lit(float(v))
        out = out | v.isNull() | F.isnan(v - v)
    return out


def translate(meshes: DataFrame, dx, dy, dz) -> DataFrame:
    return _mapped(meshes, lambda v: vec3(v["x"] + dx, v["y"] + dy, v["z"] + dz), [(_bad(dx, dy, dz), "Transforms.NonFinite")])


def scale(meshes: DataFrame, fx, fy, fz) -> DataFrame:
    """About the origin; a factor that is not positive would mirror and is refused."""
    col = lambda f: f if isinstance(f, Column) else F.lit(float(f))
    mirror = (col(fx) <= 0) | (col(fy) <= 0) | (col(fz) <= 0)
    return _mapped(meshes, lambda v: vec3(v["x"] * fx, v["y"] * fy, v["z"] * fz), [(_bad(fx, fy, fz), "Transforms.NonFinite"), (mirror, "Transforms.MirroringScale")])


def rotate(meshes: DataFrame, rotation: Column) -> DataFrame:
    """By a unit quaternion; NULL is refused."""
    turned = meshes.withColumn("_q", rotation)
    return _mapped(turned, lambda v: V.rotate(F.col("_q"), v), [(F.col("_q").isNull(), "Transforms.NonFinite")]).drop("_q")


def rotate_about(meshes: DataFrame, axis: Column, radians) -> DataFrame:
    return rotate(meshes, V.axis_angle(axis, radians if isinstance(radians, Column) else F.lit(float(radians))))


def align(pairs: DataFrame, iterations: int = 50, tolerance: float = 1e-5, samples: int = 2000) -> DataFrame:
    """Moves ``vertices``/``triangles`` onto ``ref_vertices``/``ref_triangles``: rotation (rows), translation, rmse, iterations."""
    schema = f"vertices array<{VEC3}>, triangles array<{FACE}>, rotation array<array<double>>, translation {VEC3}, rmse double, iterations int, error_code string"
    run = lambda r: space.align(r["vertices"], r["triangles"], r["ref_vertices"], r["ref_triangles"], iterations, tolerance, samples)
    return per_row(pairs, ["vertices", "triangles", "ref_vertices", "ref_triangles"], run, schema, replace=True, needs=("triangles", "ref_triangles"))


def with_metadata(meshes: DataFrame, name: Column | None = None, created_by: Column | None = None, annotations: Column | None = None) -> DataFrame:
    """The same geometry under new metadata."""
    given = {"name": name, "created_by": created_by, "annotations": annotations}
    return meshes.withColumns({k: v for k, v in given.items() if v is not None})
