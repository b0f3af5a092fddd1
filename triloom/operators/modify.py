"""Surface rebuilds: repair, smoothing, offsetting, decimation. Each keeps the row's keys and replaces its geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernels import csg, field, many
from ..kernels import mesh as M
from ..kernels.batch import Failure, per_batch, per_row
from ..types import FACE, VEC3

_GEOMETRY = f"vertices array<{VEC3}>, triangles array<{FACE}>, error_code string"


def _rebuilt(meshes: DataFrame, fn) -> DataFrame:
    def run(r):
        v, t = fn(r["vertices"], r["triangles"])
        return {"vertices": v, "triangles": t}

    return per_row(meshes, ["vertices", "triangles"], run, _GEOMETRY, replace=True, needs=("triangles",))


def repair(meshes: DataFrame) -> DataFrame:
    return _rebuilt(meshes, M.repair)


def repair_self_intersections(meshes: DataFrame) -> DataFrame:
    """Shells are united; a mesh that the kernel refuses comes back unchanged."""
    refused = (Failure, ValueError, ZeroDivisionError)

    def each(v, t):
        try:
            parts = M.components(v, t)
            return csg.union_all(parts) if len(parts) > 1 else (v, t)
        except refused:
            return v, t

    def run(rows):
        meshes = [(r["vertices"], r["triangles"]) for r in rows]
        try:
            parts = many.components(meshes)
            several = [k for k, p in enumerate(parts) if len(p) > 1]
            found = many.unions([parts[k] for k in several])
            for k, m in zip(several, found, strict=True):
                meshes[k] = meshes[k] if isinstance(m, Failure) else m
        except refused:  # one of the batch: each for itself
            meshes = [each(*m) for m in meshes]
        return [{"vertices": v, "triangles": t} for v, t in meshes]

    return per_batch(meshes, ["vertices", "triangles"], run, _GEOMETRY, replace=True, needs=("triangles",))


def laplacian(meshes: DataFrame, iterations: int = 5, strength: float = 0.5) -> DataFrame:
    return _rebuilt(meshes, lambda v, t: (M.laplacian(v, t, iterations, strength), t))


def smooth_creases(meshes: DataFrame, degrees: float = 30.0, cap: float = 0.25, iterations: int = 10, strength: float = 0.5) -> DataFrame:
    return _rebuilt(meshes, lambda v, t: (M.smooth_creases(v, t, degrees, cap, iterations, strength), t))


def smooth_edges(meshes: DataFrame, degrees: float = 30.0, tolerance: float = 0.0) -> DataFrame:
    return _rebuilt(meshes, lambda v, t: M.smooth_edges(v, t, degrees, tolerance))


def offset_smooth(meshes: DataFrame, distance: float, iterations: int = 1, cell: float = 0.0) -> DataFrame:
    return _rebuilt(meshes, lambda v, t: field.closed(v, t, distance, iterations, cell))


def offset(meshes: DataFrame, distance: float, cell: float = 0.0) -> DataFrame:
    return _rebuilt(meshes, lambda v, t: field.offset(v, t, distance, cell))


def double_offset(meshes: DataFrame, distance: float, iterations: int = 1, cell: float = 0.0) -> DataFrame:
    return _rebuilt(meshes, lambda v, t: field.double_offset(v, t, distance, iterations, cell))


def decimate(meshes: DataFrame, target: int) -> DataFrame:
    return _rebuilt(meshes, lambda v, t: M.decimate(v, t, target))


def weld(meshes: DataFrame, tolerance: float = M.WELD) -> DataFrame:
    def run(v, t):
        t = M.weld(v, tolerance)[t]
        return M.compact(v, t[M.proper(t)])

    return _rebuilt(meshes, run)


def compact(meshes: DataFrame) -> DataFrame:
    return _rebuilt(meshes, M.compact)
