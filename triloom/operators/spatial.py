"""Nearest points, rays, signed distances and surface paths.

The nested forms take a mesh and an array of queries in one row. ``closest_rows`` and ``overlapping_faces`` are the
relational forms for meshes whose faces are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..kernels import geodesic, space
from ..kernels import mesh as M
from ..kernels.batch import Failure, Rows, per_row
from ..types import VEC3, soup


def _unit(v, t, face):
    n = M.face_vectors(v, t)[np.maximum(face, 0)]
    return n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)


#: Names of the features that a nearest point lies on, by number.
FEATURES = ("face", "edge", "vertex")


def closest(rows: DataFrame) -> DataFrame:
    """``hits`` for each of ``points``: distance, point, normal, tid, feature (its number in ``FEATURES``)."""

    def run(r):
        d, p, f, kind = space.nearest(r["vertices"], r["triangles"], r["points"])
        return {"hits": Rows({"distance": d, "point": p, "normal": _unit(r["vertices"], r["triangles"], f), "tid": f, "feature": kind})}

    return per_row(rows, ["vertices", "triangles", "points"], run, f"hits array<struct<distance:double,point:{VEC3},normal:{VEC3},tid:int,feature:int>>, error_code string", replace=True, needs=("triangles",))


def closest_rows(points: DataFrame, meshes: DataFrame, block_faces: int = 4096) -> DataFrame:
    """mesh_id, pid, distance, point, tid of the nearest face for each row of ``points`` (mesh_id, pid, p), for meshes of any size.

    Faces are cut into blocks along x (a block's box and one of its corners go ahead); a point meets the blocks of its mesh whose
    box is no farther than the nearest of those corners, and each (block, its points) is searched by a task. Points of a
    mesh without faces, and of no mesh, give no row. Of equally near faces the lowest counts.
    """
    faces = soup(meshes)
    # a block is an interval of the centroids' x, so that no task sorts a mesh
    middle = (F.col("p.x") + F.col("q.x") + F.col("r.x")) / 3
    stats = faces.groupBy("mesh_id").agg(F.min(middle).alias("x0"), F.max(middle).alias("x1"), F.ceil(F.count("*") / block_faces).alias("blocks"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-300))
    faces = faces.join(stats, "mesh_id").withColumn("block", F.least(F.floor((middle - F.col("x0")) / span * F.col("blocks")), F.col("blocks") - 1)).select("mesh_id", "block", "tid", "p", "q", "r")
    low, high = ([F.min(F.least(f"p.{k}", f"q.{k}", f"r.{k}")).alias(f"l{k}") for k in "xyz"], [F.max(F.greatest(f"p.{k}", f"q.{k}", f"r.{k}")).alias(f"h{k}") for k in "xyz"])
    boxes = faces.groupBy("mesh_id", "block").agg(*low, *high, F.min("p").alias("corner"))
    met = points.select("mesh_id", "pid", F.col("p").alias("at")).join(boxes, "mesh_id")
    gap = lambda k: F.greatest(F.col(f"l{k}") - F.col(f"at.{k}"), F.col(f"at.{k}") - F.col(f"h{k}"), F.lit(0.0))
    met = met.withColumn("gap", gap("x") ** 2 + gap("y") ** 2 + gap("z") ** 2).withColumn("reach", V.dot(V.sub(F.col("at"), F.col("corner")), V.sub(F.col("at"), F.col("corner"))))
    least = Window.partitionBy("mesh_id", "pid")
    met = met.withColumn("bound", F.min("reach").over(least)).where(F.col("gap") <= F.col("bound") * (1 + 1e-9))
    met = met.select(*[F.col(c).alias(c) for c in ("mesh_id", "block", "pid", "at")])  # columns of its own, as both sides come from the meshes

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        xyz = lambda c: np.stack([c.combine_chunks().field(k).to_numpy() for k in range(3)], axis=1)
        if left.num_rows and right.num_rows:
            right = right.sort_by("tid")
            v = np.concatenate([xyz(right[c]) for c in "pqr"])
            t = np.arange(right.num_rows)[:, None] + np.array([0, 1, 2]) * right.num_rows
            d, at, face, _ = space.nearest(v, t, xyz(left["at"]))
            tid = right["tid"].to_numpy()[face]
        else:
            left, d, at, tid = left.slice(0, 0), np.zeros(0), np.zeros((0, 3)), np.zeros(0, np.int32)
        point = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(at[:, k])) for k in range(3)], names=["x", "y", "z"])
        return pa.table({"mesh_id": left["mesh_id"], "pid": left["pid"], "distance": pa.array(d), "point": point, "tid": pa.array(tid, pa.int32())})

    kinds = dict(points.dtypes)
    found = met.groupBy("mesh_id", "block").cogroup(faces.groupBy("mesh_id", "block")).applyInArrow(searched, f"mesh_id {kinds['mesh_id']}, pid {kinds['pid']}, distance double, point {VEC3}, tid int")
    best = F.min(F.struct(F.round("distance", 10).alias("near"), F.col("tid"), F.col("distance"), F.col("point"))).alias("b")  # blocks round a shared edge differently
    return found.groupBy("mesh_id", "pid").agg(best).select("mesh_id", "pid", "b.distance", "b.point", "b.tid")


def signed_distances(rows: DataFrame) -> DataFrame:
    """``distances`` for each of ``points``, negative inside."""
    return per_row(rows, ["vertices", "triangles", "points"], lambda r: {"distances": space.signed_distances(r["vertices"], r["triangles"], r["points"])}, "distances array<double>, error_code string", replace=True, needs=("triangles",))


def raycast(rows: DataFrame) -> DataFrame:
    """``hits`` for each of ``origins`` and ``directions``: distance, point, normal, tid; NULL for a miss."""

    def run(r):
        d = r["directions"] / np.linalg.norm(r["directions"], axis=1, keepdims=True)
        t, f = space.raycast(r["vertices"], r["triangles"], r["origins"], d)
        n = _unit(r["vertices"], r["triangles"], f)
        hit = np.isfinite(t)
        return {"hits": Rows({"distance": t, "point": r["origins"] + np.where(hit, t, 0)[:, None] * d, "normal": n, "tid": f}, hit)}

    return per_row(rows, ["vertices", "triangles", "origins", "directions"], run, f"hits array<struct<distance:double,point:{VEC3},normal:{VEC3},tid:int>>, error_code string", replace=True, needs=("triangles",))


def shortest_paths(rows: DataFrame) -> DataFrame:
    """``path`` over the surface between ``start`` and ``end``, and its ``length``."""

    def run(r):
        p = geodesic.shortest(r["vertices"], r["triangles"], r["start"], r["end"])
        return {"path": p, "length": float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum())}

    return per_row(rows, ["vertices", "triangles", "start", "end"], run, f"path array<{VEC3}>, length double, error_code string", replace=True, needs=("triangles",))


def samples(meshes: DataFrame, n: int) -> DataFrame:
    """``points`` evenly on the surface, and its area-weighted ``centroid``."""

    def run(r):
        if n < 1:
            raise Failure("Transforms.InvalidAlignmentParameters")
        return {"points": space.samples(r["vertices"], r["triangles"], n), "centroid": space.centroid(r["vertices"], r["triangles"])}

    return per_row(meshes, ["vertices", "triangles"], run, f"points array<{VEC3}>, centroid {VEC3}, error_code string", replace=True, needs=("triangles",))


def face_boxes(meshes: DataFrame) -> DataFrame:
    """mesh_id, tid, corners and bounding box of each face."""
    s = soup(meshes)
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    return s.withColumn("low", V.minimum(V.minimum(p, q), r)).withColumn("high", V.maximum(V.maximum(p, q), r))


def overlapping_faces(meshes: DataFrame, cell: float) -> DataFrame:
    """(mesh_id, left, right) of faces whose boxes overlap, left < right.

    Each box is put into the grid cells that it touches and cells are equi-joined; a pair is kept only in the cell of the greater of
    the two lower corners, so it comes out once without a distinct. ``cell`` should be about a face's size.
    """
    boxes = face_boxes(meshes).select("mesh_id", "tid", "low", "high")
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"low.{k}") / cell), F.floor(F.col(f"high.{k}") / cell)))
    cells = boxes
    for k in "xyz":
        cells = cells.withColumn(f"c{k}", span(k))
    # dealt by cell: Spark does not see how many rows the explodes make, and would broadcast them all for a small file
    a, b = cells.hint("merge").alias("a"), cells.alias("b")
    joined = a.join(b, ["mesh_id", "cx", "cy", "cz"]).where("a.tid < b.tid")
    for k in "xyz":
        first = F.floor(F.greatest(F.col(f"a.low.{k}"), F.col(f"b.low.{k}")) / cell)
        joined = joined.where((F.col(f"a.low.{k}") <= F.col(f"b.high.{k}")) & (F.col(f"b.low.{k}") <= F.col(f"a.high.{k}")) & (F.col(f"c{k}") == first))
    return joined.select("mesh_id", F.col("a.tid").alias("left"), F.col("b.tid").alias("right"))


def neighbours(meshes: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, left, right) of faces across edges that exactly two faces share: an aggregate of half-edges."""
    pairs = F.flatten(F.transform("triangles", lambda t, i: F.array(*[F.struct(F.least(t[u], t[w]).alias("lo"), F.greatest(t[u], t[w]).alias("hi"), i.alias("tid")) for u, w in ("ab", "bc", "ca")])))
    e = meshes.select("mesh_id", F.explode(pairs).alias("e")).select("mesh_id", "e.*")
    return e.groupBy("mesh_id", "lo", "hi").agg(F.min("tid").alias("left"), F.max("tid").alias("right"), F.count("*").alias("n")).where("n = 2").drop("n")
