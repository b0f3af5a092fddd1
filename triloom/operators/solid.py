"""Set operations on solids: union, subtract, intersect, their batch forms, and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import many
from ..kernels.batch import Failure, per_batch
from ..types import FACE, MESH, VEC3
from . import measure

_WORDS = {"union": "Union", "subtract": "Subtract", "intersect": "Intersect"}


def boolean(pairs: DataFrame, kind: str, tolerance: float | None = None, audit: bool = False) -> DataFrame:
    """Of ``vertices``/``triangles`` and ``other_vertices``/``other_triangles``; annotations and name come from the left mesh.

    Corners closer than ``tolerance`` are one: by default it follows the size of both meshes. With ``audit`` each result is measured where it is made,
    as by ``measure.audited``, and only the measures leave the task.
    """

    def run(rows):
        found = many.booleans(kind, [(r["vertices"], r["triangles"], r["other_vertices"], r["other_triangles"]) for r in rows], tolerance)
        if audit:
            return measure.audits(found)
        made = lambda r, m: {"vertices": m[0], "triangles": m[1], "created_by": f"triloom.{kind}", "name": f"{r.get('name') or 'A'} {_WORDS[kind]} {r.get('other_name') or 'B'}"}
        return [m if isinstance(m, Failure) else made(r, m) for r, m in zip(rows, found, strict=True)]

    schema = f"vertices array<{VEC3}>, triangles array<{FACE}>, name string, created_by string, error_code string"
    inputs = ["vertices", "triangles", "other_vertices", "other_triangles"] + ["other_name"] * ("other_name" in pairs.columns)
    out = per_batch(pairs, inputs, run, measure.AUDIT if audit else schema, replace=True, needs=("triangles", "other_triangles"))
    return measure.counted(out) if audit else out


def batch(meshes: DataFrame, kind: str, audit: bool = False) -> DataFrame:
    """(group_id, ord, vertices, triangles) to one mesh a group: ``union`` of all, ``subtract`` from the first by ord.

    A group's meshes meet in one row and so in one task: a group is one model's operands, not a data set. Rows that hold their ``operands`` already,
    an array of (ord, vertices, triangles), are a group each and need no grouping. ``audit`` is as in ``boolean``.
    """
    grouped = F.collect_list(F.struct("ord", "vertices", "triangles"))
    packed = meshes.withColumn("operands", F.array_sort("operands")) if "operands" in meshes.columns else meshes.groupBy("group_id").agg(F.array_sort(grouped).alias("operands"))

    def run(rows):
        groups = [[(o["vertices"], o["triangles"]) for o in r["operands"]] for r in rows]
        sound = [all(len(t) for _, t in g) for g in groups]
        found = iter(many.together(kind, [g for g, ok in zip(groups, sound, strict=True) if ok]))
        out = [next(found) if ok else Failure("Mesh.EmptyOperand") for ok in sound]
        if audit:
            return measure.audits(out)
        return [m if isinstance(m, Failure) else {"vertices": m[0], "triangles": m[1], "name": f"Batch {kind}", "created_by": f"triloom.{kind}"} for m in out]

    out = per_batch(packed, ["operands"], run, measure.AUDIT if audit else MESH, replace=True, needs=("operands",))
    return measure.counted(out) if audit else out


def split(meshes: DataFrame) -> DataFrame:
    """By the plane ``normal`` . p = ``offset`` of each row: one row a ``side`` (front, back), capped."""

    def run(rows):
        found = many.halves([(r["vertices"], r["triangles"], r["normal"], r["offset"]) for r in rows])
        return [x if isinstance(x, Failure) else {"halves": [{"side": s, "vertices": v, "triangles": t} for s, (v, t) in zip(("front", "back"), x, strict=True)]} for x in found]

    found = per_batch(meshes, ["vertices", "triangles", "normal", "offset"], run, f"halves array<struct<side:string,vertices:array<{VEC3}>,triangles:array<{FACE}>>>, error_code string", replace=True, needs=("triangles",))
    kept = [c for c in found.columns if c != "halves"]
    return found.select(*kept, F.explode_outer("halves").alias("h")).select(*kept, "h.*")


def concatenated(meshes: DataFrame) -> DataFrame:
    """(group_id, ord, vertices, triangles) put into one mesh a group without any boolean; for disjoint parts."""

    packed = meshes.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ord", "vertices", "triangles"))).alias("operands"))
    shift = lambda t, n: F.struct(*[(t[k] + n).alias(k) for k in "abc"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FACE}>").alias("out"))
    faces = F.aggregate("operands", start, lambda acc, o: F.struct((acc["at"] + F.size(o["vertices"])).alias("at"), F.concat(acc["out"], F.transform(o["triangles"], lambda t: shift(t, acc["at"]))).alias("out")))["out"]
    return packed.select(F.col("group_id").alias("mesh_id"), F.flatten("operands.vertices").alias("vertices"), faces.alias("triangles"), F.lit("Pile").alias("name"), F.lit(None).cast("string").alias("error_code"))
