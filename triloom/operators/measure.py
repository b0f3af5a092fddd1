"""Measurements of meshes: statistics, topology audit, normals, components, intersections, deviation, peaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..kernels import many, space
from ..kernels import mesh as M
from ..kernels.batch import Failure, per_batch, per_row
from ..types import EMPTY, FACE, VEC3, soup

COUNTERS = ("edges", "boundary_edges", "non_manifold_edges", "winding_errors", "degenerate_triangles", "duplicate_faces", "duplicate_vertices", "shells", "unreferenced_vertices")


def statistics(meshes: DataFrame, *keep: str) -> DataFrame:
    """mesh_id, signed volume, area, bounds over all vertices, and counts; meshes without triangles get an error_code.

    Sums run inside the row over its own arrays, so nothing is exploded or shuffled.
    """
    corner = lambda t, k: F.get("vertices", t[k])

    def step(acc: Column, t: Column) -> Column:
        p, q, r = corner(t, "a"), corner(t, "b"), corner(t, "c")
        return F.struct((acc["v"] + V.dot(p, V.cross(q, r))).alias("v"), (acc["a"] + V.length(V.cross(V.sub(q, p), V.sub(r, p)))).alias("a"))

    sums = F.aggregate("triangles", F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("a")), step)
    low = [F.array_min(F.col(f"vertices.{k}")) for k in "xyz"]
    high = [F.array_max(F.col(f"vertices.{k}")) for k in "xyz"]
    empty = F.size("triangles") == 0
    out = meshes.withColumn("_s", sums).select(
        "mesh_id", (F.col("_s.v") / 6).alias("volume"), (F.col("_s.a") / 2).alias("area"), *[c.alias(f"min_{k}") for c, k in zip(low, "xyz", strict=True)], *[c.alias(f"max_{k}") for c, k in zip(high, "xyz", strict=True)],
        F.size("vertices").cast("long").alias("n_vertices"), F.size("triangles").cast("long").alias("n_triangles"), F.coalesce("error_code", F.when(empty, EMPTY)).alias("error_code"), *keep,
    )
    return out.withColumns({f"size_{k}": F.col(f"max_{k}") - F.col(f"min_{k}") for k in "xyz"})


def statistics_by_soup(meshes: DataFrame) -> DataFrame:
    """Volume and area by exploding faces: for meshes whose faces should be summed by many tasks, after a repartition by face."""
    s = soup(meshes)
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    return s.groupBy("mesh_id").agg((F.sum(V.dot(p, V.cross(q, r))) / 6).alias("volume"), (F.sum(V.length(V.cross(V.sub(q, p), V.sub(r, p)))) / 2).alias("area"), F.count("*").alias("n_triangles"))


def with_predicates(audit: DataFrame) -> DataFrame:
    """Derived booleans over the counters."""
    c = {k: F.col(k) for k in COUNTERS}
    closed, edge_manifold = c["boundary_edges"] == 0, c["non_manifold_edges"] == 0
    wound, corrupt = c["winding_errors"] == 0, c["non_manifold_edges"] > 0
    redundant = (c["degenerate_triangles"] > 0) | (c["duplicate_faces"] > 0) | (c["duplicate_vertices"] > 0) | (c["unreferenced_vertices"] > 0)
    tight = closed & edge_manifold
    return audit.withColumns({"is_closed": closed, "is_edge_manifold": edge_manifold, "is_manifold": edge_manifold & wound, "has_corrupt_topology": corrupt, "is_watertight": tight, "is_consistently_wound": wound, "has_redundant_geometry": redundant, "is_clean": tight & wound & ~redundant})


def topology(meshes: DataFrame, tolerance: float = M.WELD) -> DataFrame:
    """The nine counters of each mesh; small meshes are audited a batch at a time by one set of NumPy calls."""
    schema = "mesh_id long, " + ", ".join(f"{k} long" for k in COUNTERS) + ", error_code string"
    found = per_batch(meshes.select("mesh_id", "vertices", "triangles", "error_code"), ["vertices", "triangles"], lambda rows: many.topologies([(r["vertices"], r["triangles"]) for r in rows], tolerance), ", ".join(f"{k} long" for k in COUNTERS) + ", error_code string", replace=True, needs=("triangles",))
    return found.select(*[x.split()[0] for x in schema.split(", ")])


def with_topology(meshes: DataFrame, tolerance: float = M.WELD) -> DataFrame:
    """``meshes`` with the nine counters beside their geometry, so that more can be measured in the same pass; NULL for empty ones."""

    def run(rows):
        found = iter(many.topologies([(r["vertices"], r["triangles"]) for r in rows if len(r["triangles"])], tolerance))
        return [next(found) if len(r["triangles"]) else {} for r in rows]

    return per_batch(meshes, ["vertices", "triangles"], run, ", ".join(f"{k} long" for k in COUNTERS) + ", error_code string")


def audited(meshes: DataFrame, tolerance: float = M.WELD) -> DataFrame:
    """``meshes`` without their geometry: the nine counters (NULL for empty ones), ``volume`` (0 for empty ones) and ``n_triangles``, measured in one
    pass. For meshes that a kernel built, which lie in Arrow batches anyway: expressions over a row's faces are interpreted face by face."""
    df = meshes.withColumn("_faces", F.size("triangles").cast("long"))
    out = per_batch(df, ["vertices", "triangles"], lambda rows: audits([(r["vertices"], r["triangles"]) for r in rows], tolerance), AUDIT, replace=True)
    return counted(out.withColumn("n_triangles", F.col("_faces")).drop("_faces"))


#: What an audit measures.
AUDIT = ", ".join(f"{k} long" for k in COUNTERS) + ", volume double, n_triangles long, error_code string"


def audits(meshes: list, tolerance: float = M.WELD) -> list:
    """The outputs of ``AUDIT`` for meshes as a kernel made them; failures stay."""
    some = [m for m in meshes if not isinstance(m, Failure) and len(m[1])]
    found = zip(many.topologies(some, tolerance), many.volumes(some), some, strict=True)
    found = iter([c | {"volume": x, "n_triangles": len(m[1])} for c, x, m in found])
    return [m if isinstance(m, Failure) else next(found) if len(m[1]) else {} for m in meshes]


def counted(audit: DataFrame) -> DataFrame:
    """Meshes that are empty or could not be made have no volume and no faces."""
    return audit.withColumns({"volume": F.coalesce("volume", F.lit(0.0)), "n_triangles": F.coalesce("n_triangles", F.lit(0).cast("long"))})


def edge_table(meshes: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, uses) of the undirected edges, relationally; for meshes spread over tasks."""
    pairs = F.flatten(F.transform(F.filter("triangles", lambda t: (t["a"] != t["b"]) & (t["b"] != t["c"]) & (t["c"] != t["a"])), lambda t: F.array(*[F.struct(t[i].alias("u"), t[j].alias("w")) for i, j in ("ab", "bc", "ca")])))
    return meshes.select("mesh_id", F.explode(pairs).alias("e")).groupBy("mesh_id", F.least("e.u", "e.w").alias("lo"), F.greatest("e.u", "e.w").alias("hi")).agg(F.count("*").alias("uses"))


def edge_audit(meshes: DataFrame) -> DataFrame:
    e = edge_table(meshes)
    return e.groupBy("mesh_id").agg(F.count("*").alias("edges"), F.count_if(F.col("uses") == 1).alias("boundary_edges"), F.count_if(F.col("uses") > 2).alias("non_manifold_edges"))


def unreferenced(meshes: DataFrame) -> DataFrame:
    """(mesh_id, vid) of vertices that no face uses, found inside the row: a join of the exploded tables would broadcast the larger one,
    as Spark does not see how many rows an explode makes."""
    used = F.flatten(F.transform(F.coalesce("triangles", F.array().cast(f"array<{FACE}>")), lambda t: F.array(t["a"], t["b"], t["c"])))
    every = F.when(F.size("vertices") > 0, F.sequence(F.lit(0), F.size("vertices") - 1)).otherwise(F.array().cast("array<int>"))
    return meshes.select("mesh_id", F.explode(F.array_except(every, used)).alias("vid"))


def vertex_normals(meshes: DataFrame) -> DataFrame:
    """``normals`` of each vertex by area; an empty mesh has none and is no error."""
    return per_row(meshes, ["vertices", "triangles"], lambda r: {"normals": M.vertex_normals(r["vertices"], r["triangles"])}, f"normals array<{VEC3}>, error_code string")


def components(meshes: DataFrame) -> DataFrame:
    """One row a connected part, in order of first triangle: part, name, vertices, triangles."""

    def run(r):
        parts = M.components(r["vertices"], r["triangles"])
        return {"parts": [{"part": k, "vertices": v, "triangles": t} for k, (v, t) in enumerate(parts)]}

    found = per_row(meshes, ["vertices", "triangles"], run, f"parts array<struct<part:int,vertices:array<{VEC3}>,triangles:array<{FACE}>>>, error_code string", replace=True, needs=("triangles",))
    kept = [c for c in found.columns if c not in ("parts", "name")]
    return found.select(*kept, "name", F.explode_outer("parts").alias("p")).select(*kept, F.concat_ws(" ", "name", F.lit("part"), F.col("p.part") + 1).alias("name"), "p.*")


def self_intersections(meshes: DataFrame) -> DataFrame:
    return per_row(meshes, ["vertices", "triangles"], lambda r: {"self_intersections": space.self_intersections(r["vertices"], r["triangles"])}, "self_intersections long, error_code string").drop("vertices", "triangles")


def deviation(pairs: DataFrame) -> DataFrame:
    """Signed distances of the vertices to ``ref_vertices``/``ref_triangles``: greatest outside and inside, mean and root mean square."""

    def run(r):
        d = space.signed_distances(r["ref_vertices"], r["ref_triangles"], r["vertices"])
        return {"distances": d.tolist(), "max_outside": max(0.0, d.max()), "max_inside": max(0.0, -d.min()), "mean_abs": np.abs(d).mean(), "rms": np.sqrt((d**2).mean())}

    schema = "distances array<double>, max_outside double, max_inside double, mean_abs double, rms double, error_code string"
    return per_row(pairs, ["vertices", "triangles", "ref_vertices", "ref_triangles"], run, schema, replace=True, needs=("triangles", "ref_triangles"))


def peaks(meshes: DataFrame, up: tuple[float, float, float] = (0, 0, 1), depth: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """One row a peak: peak, vid, point, normal, height, prominence, summit and, with ``depth``, how many vertices lie within reach."""
    axis = np.array(up, float)

    def run(rows):
        return [{"peaks": p} for p in many.peaks([(r["vertices"], r["triangles"]) for r in rows], axis, tolerance, depth)]

    schema = f"peaks array<struct<peak:int,vid:int,point:{VEC3},normal:{VEC3},height:double,prominence:double,summit:{VEC3},within_reach:long>>, error_code string"
    found = per_batch(meshes, ["vertices", "triangles"], run, schema, replace=True, needs=("triangles",))
    return found.select("mesh_id", "error_code", F.explode_outer("peaks").alias("p")).select("mesh_id", "error_code", "p.*")
