"""Planar polygons: measures as expressions, the rest as kernels over rows.

A polygon is struct<outer, holes>; a row's ``polygons`` or ``other`` are arrays of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import curves, planar
from ..kernels.batch import Failure, per_batch, per_row
from ..types import FACE, MESH, POLYGON, RING, VEC2

_POLYGONS = f"polygons array<{POLYGON}>, error_code string"


def signed_area(ring: Column) -> Column:
    """Shoelace sum of an array of points, as an expression."""
    n = F.size(ring)
    step = lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]
    return F.when(n >= 3, F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), step), F.lit(0.0), lambda a, x: a + x) / 2).otherwise(0.0)


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon["outer"])) - F.aggregate(F.transform(F.coalesce(polygon["holes"], F.array().cast(f"array<{RING}>")), lambda h: F.abs(signed_area(h))), F.lit(0.0), lambda a, x: a + x)


def contains(ring: Column, point: Column) -> Column:
    """Even-odd containment as an expression."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["y"] > point["y"]) != (b["y"] > point["y"])
        return F.when(spans & (point["x"] < a["x"] + F.try_divide((point["y"] - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def mirror_x(polygon: Column) -> Column:
    ring = lambda r: F.reverse(F.transform(r, lambda p: F.struct((-p["x"]).alias("x"), p["y"].alias("y"))))
    return F.struct(ring(polygon["outer"]).alias("outer"), F.transform(polygon["holes"], ring).alias("holes"))


def _rings(polygons) -> list[np.ndarray]:
    return [r for p in polygons or [] for r in [p["outer"], *(p["holes"] or [])]]


def _out(found) -> dict:
    return {"polygons": [{"outer": o, "holes": h} for o, h in found]}


def intersect(rows: DataFrame) -> DataFrame:
    return per_row(rows, ["polygons", "other"], lambda r: _out(planar.intersect(_rings(r["polygons"]), _rings(r["other"]))), _POLYGONS, replace=True)


def subtract(rows: DataFrame) -> DataFrame:
    return per_row(rows, ["polygons", "other"], lambda r: _out(planar.subtract(_rings(r["polygons"]), _rings(r["other"]))), _POLYGONS, replace=True)


def union(rows: DataFrame) -> DataFrame:
    """Outer rings only; the largest contour of their union, as ``ring``."""
    return per_row(rows, ["polygons"], lambda r: {"ring": planar.union([p["outer"] for p in r["polygons"] or []])}, f"ring {RING}, error_code string", replace=True)


def offset(rows: DataFrame, distance: float) -> DataFrame:
    def run(batch):
        return [r if isinstance(r, Failure) else {"ring": r} for r in planar.offsets([r["ring"] for r in batch], distance)]

    return per_batch(rows, ["ring"], run, f"ring {RING}, error_code string", replace=True)


def buffer_path(rows: DataFrame, distance: float) -> DataFrame:
    return per_row(rows, ["path"], lambda r: {"ring": planar.buffer_path(r["path"], distance)}, f"ring {RING}, error_code string", replace=True)


def from_loops(rows: DataFrame) -> DataFrame:
    return per_row(rows, ["loops"], lambda r: _out(planar.from_loops(r["loops"] or [])), _POLYGONS, replace=True)


def triangulate(rows: DataFrame) -> DataFrame:
    def run(r):
        p, t = planar.triangulate([(x["outer"], x["holes"] or []) for x in r["polygons"] or []])
        return {"points": p, "triangles": t}

    return per_row(rows, ["polygons"], run, f"points {RING}, triangles array<{FACE}>, error_code string", replace=True)


def extrude(rows: DataFrame) -> DataFrame:
    """``polygons`` between ``low`` and ``high`` as a mesh."""
    return per_row(rows, ["polygons", "low", "high"], lambda r: curves.extrude([(x["outer"], x["holes"] or []) for x in r["polygons"] or []], r["low"], r["high"]), MESH, replace=True)


def slice_meshes(meshes: DataFrame) -> DataFrame:
    """Regions of each mesh at its ``height``."""

    def run(r):
        if r["height"] is None or not np.isfinite(r["height"]):
            raise Failure("Polygons.NonFiniteHeight")
        return _out(planar.slice_mesh(r["vertices"], r["triangles"], r["height"]))

    return per_row(meshes, ["vertices", "triangles", "height"], run, _POLYGONS, replace=True, needs=("triangles",))


def convex_hulls(rows: DataFrame) -> DataFrame:
    """``ring`` of ``points``."""
    return per_row(rows, ["points"], lambda r: {"ring": planar.hull(r["points"])}, f"ring {RING}, error_code string", replace=True)


def convex_hulls_of_rows(points: DataFrame, key: str, salt: int = 16) -> DataFrame:
    """Hulls of (key, x, y) rows: partial hulls of each key's salted parts, then the hull of the hulls, so no task holds a key's points."""
    struct = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    part = points.groupBy(key, F.pmod(F.xxhash64("x", "y"), F.lit(salt)).alias("_s")).agg(F.collect_set(struct).alias("points"))
    corner = per_row(part, ["points"], lambda r: {"points": _corners(r["points"])}, f"points array<{VEC2}>", replace=True)
    return convex_hulls(corner.groupBy(key).agg(F.flatten(F.collect_list("points")).alias("points")))


def _corners(p: np.ndarray) -> np.ndarray:
    try:
        return planar.hull(p)
    except Failure:
        return np.unique(p[np.isfinite(p).all(axis=1)], axis=0)


def outlines(meshes: DataFrame, smooth: bool = False) -> DataFrame:
    """``ring``: the outer contour of each mesh along z, optionally smoothed."""

    def run(r):
        ring = planar.silhouette(r["vertices"], r["triangles"])
        return {"ring": curves.smooth_ring(ring, 4.0, 1.0, 0.1) if smooth else ring}

    return per_row(meshes, ["vertices", "triangles"], run, f"ring {RING}, error_code string", replace=True, needs=("triangles",))


def projected_hulls(meshes: DataFrame, smooth: bool = False) -> DataFrame:
    def run(r):
        ring = planar.hull(np.rint(r["vertices"][:, :2] * 1e4) / 1e4)
        return {"ring": curves.smooth_ring(ring, 4.0, 1.0, 0.1) if smooth else ring}

    return per_row(meshes, ["vertices", "triangles"], run, f"ring {RING}, error_code string", replace=True, needs=("triangles",))
