"""Decals on surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernels import decal
from ..kernels.batch import per_row
from ..types import MESH


def prisms(rows: DataFrame, depth: float, height: float, longest: float = 0.0) -> DataFrame:
    """``polygons`` along ``frame`` on the mesh of each row, as a solid."""
    return per_row(rows, ["polygons", "frame", "vertices", "triangles"], lambda r: decal.build_prism(r, depth, height, longest), MESH, replace=True, needs=("triangles",))


def projected(rows: DataFrame) -> DataFrame:
    """``prism_vertices``/``prism_triangles`` laid on the mesh along ``frame``; flags overhangs and too_curved."""
    return per_row(rows, ["frame", "vertices", "triangles", "prism_vertices", "prism_triangles"], decal.project, MESH + ", overhangs boolean, too_curved boolean", replace=True, needs=("triangles", "prism_triangles"))
