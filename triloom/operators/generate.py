"""Mesh sources: boxes, spheres, cylinders, arcs (expressions); tubes, paths and level sets (kernels)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..kernels import curves, field
from ..kernels.batch import per_row
from ..types import FACE, MESH, VEC3, vec3

# The corners of a box's faces; bit k of a corner number says whether it lies at the upper end of axis k.
BOX_QUADS = ((0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6))


def _faces(rows) -> Column:
    return F.array(*[F.struct(*[F.lit(int(v)).alias(n) for v, n in zip(r, "abc", strict=True)]) for r in rows])


def _mesh(df: DataFrame, ok: list[tuple[Column, str]], vertices: Column, triangles: Column, name: str) -> DataFrame:
    """A mesh, or the code of the first failed check and an empty mesh."""
    code = F.lit(None).cast("string")
    for bad, text in reversed(ok):
        code = F.when(bad, text).otherwise(code)
    good = F.col("error_code").isNull()
    return (
        df.withColumn("error_code", code).withColumn("vertices", F.when(good, vertices).otherwise(F.array().cast(f"array<{VEC3}>")))
        .withColumn("triangles", F.when(good, triangles).otherwise(F.array().cast(f"array<{FACE}>"))).withColumn("name", F.lit(name)).withColumn("created_by", F.lit(f"triloom.{name}"))
    )


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(~F.isnan(v - v), F.lit(False))
    return out


def boxes(df: DataFrame, low: Column, high: Column, frame: Column | None = None) -> DataFrame:
    """An axis-aligned box for each row, or one in ``frame``: 8 vertices, 12 triangles."""
    corner = lambda i: vec3(*[high[k] if i >> b & 1 else low[k] for b, k in enumerate("xyz")])
    points = [corner(i) if frame is None else V.to_world(frame, corner(i)) for i in range(8)]
    triangles = [t for a, b, c, d in BOX_QUADS for t in ((a, b, c), (a, c, d))]
    flat = (low["x"] >= high["x"]) | (low["y"] >= high["y"]) | (low["z"] >= high["z"])
    checks = [(~_finite(low["x"], low["y"], low["z"], high["x"], high["y"], high["z"]), "Generators.NonFiniteParameter"), (flat, "Generators.DegenerateBox")]
    return _mesh(df, checks, F.array(*points), _faces(triangles), "Box")


def spheres(df: DataFrame, center: Column, radius: Column, segments: Column | int = 16) -> DataFrame:
    """Poles first, then rings from the top; slices = segments, rings = max(2, segments div 2)."""
    n = segments if isinstance(segments, Column) else F.lit(segments)
    n = n.cast("int")
    rings = F.greatest(F.lit(2), F.floor(n / 2).cast("int"))
    df = df.withColumns({"_n": F.greatest(n, F.lit(3)), "_rings": rings, "_r": radius.cast("double"), "_c": center})

    def ring(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda s: vec3(
            F.col("_c.x") + F.col("_r") * F.sin(math.pi * i / F.col("_rings")) * F.cos(2 * math.pi * s / F.col("_n")),
            F.col("_c.y") + F.col("_r") * F.sin(math.pi * i / F.col("_rings")) * F.sin(2 * math.pi * s / F.col("_n")),
            F.col("_c.z") + F.col("_r") * F.cos(math.pi * i / F.col("_rings"))))

    at = lambda r, s: (2 + (r - 1) * F.col("_n") + s % F.col("_n")).cast("int")
    face = lambda a, b, c: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    slices = F.sequence(F.lit(0), F.col("_n") - 1)
    one, last = F.lit(1), F.col("_rings") - 1
    caps = F.flatten(F.transform(slices, lambda s: F.array(face(F.lit(0), at(one, s), at(one, s + 1)), face(F.lit(1), at(last, s + 1), at(last, s)))))
    band = F.when(F.col("_rings") > 2, F.sequence(F.lit(1), F.greatest(F.col("_rings") - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    sides = F.flatten(F.transform(band, lambda r: F.flatten(F.transform(slices, lambda s: F.array(face(at(r, s), at(r + 1, s), at(r + 1, s + 1)), face(at(r, s), at(r + 1, s + 1), at(r, s + 1)))))))
    poles = F.array(V.add(F.col("_c"), vec3(F.lit(0.0), F.lit(0.0), F.col("_r"))), V.sub(F.col("_c"), vec3(F.lit(0.0), F.lit(0.0), F.col("_r"))))
    vertices = F.concat(poles, F.flatten(F.transform(F.sequence(F.lit(1), F.col("_rings") - 1), ring)))
    checks = [(~_finite(F.col("_r"), F.col("_c.x"), F.col("_c.y"), F.col("_c.z")), "Generators.NonFiniteParameter"), (F.col("_r") <= 0, "Generators.NonPositiveRadius"), (n < 3, "Generators.TooFewSegments")]
    return _mesh(df, checks, vertices, F.concat(caps, sides), "Sphere").drop("_n", "_rings", "_r", "_c")


def cylinders(df: DataFrame, base: Column, radius: Column, height: Column, segments: Column | int = 24) -> DataFrame:
    """Two hubs, then lower and upper rim points in turn; along +Z."""
    n = (segments if isinstance(segments, Column) else F.lit(segments)).cast("int")
    df = df.withColumns({"_n": F.greatest(n, F.lit(3)), "_r": radius.cast("double"), "_h": height.cast("double"), "_c": base})
    slices = F.sequence(F.lit(0), F.col("_n") - 1)
    rim = lambda s, up: vec3(F.col("_c.x") + F.col("_r") * F.cos(2 * math.pi * s / F.col("_n")), F.col("_c.y") + F.col("_r") * F.sin(2 * math.pi * s / F.col("_n")), F.col("_c.z") + F.col("_h") * up)
    low, high = (lambda s: (2 + 2 * (s % F.col("_n"))).cast("int")), (lambda s: (3 + 2 * (s % F.col("_n"))).cast("int"))
    face = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    faces = F.flatten(F.transform(slices, lambda s: F.array(face(F.lit(0), low(s + 1), low(s)), face(F.lit(1), high(s), high(s + 1)), face(low(s), low(s + 1), high(s + 1)), face(low(s), high(s + 1), high(s)))))
    vertices = F.concat(F.array(F.col("_c"), V.add(F.col("_c"), vec3(F.lit(0.0), F.lit(0.0), F.col("_h")))), F.flatten(F.transform(slices, lambda s: F.array(rim(s, 0.0), rim(s, 1.0)))))
    checks = [(~_finite(F.col("_r"), F.col("_h"), F.col("_c.x"), F.col("_c.y"), F.col("_c.z")), "Generators.NonFiniteParameter"), (F.col("_r") <= 0, "Generators.NonPositiveRadius"), (F.col("_h") <= 0, "Generators.NonPositiveHeight"), (n < 3, "Generators.TooFewSegments")]
    return _mesh(df, checks, vertices, faces, "Cylinder").drop("_n", "_r", "_h", "_c")


def arcs(start: Column, from_dir: Column, to_dir: Column, radius: Column, segments: Column | int) -> Column:
    """Points that leave ``start`` along ``from_dir`` and turn with ``radius`` until they run along ``to_dir``.

    Nearly equal directions (product 0.999 or more) give the start alone; opposite ones turn in a plane of our choice.
    """
    n = (segments if isinstance(segments, Column) else F.lit(segments)).cast("int")

    def turning(s: Column) -> Column:
        a, c, r = s["a"], s["c"], s["r"]
        spare = F.when(F.abs(a["x"]) < 0.6, vec3(1, 0, 0)).otherwise(vec3(0, 1, 0))
        side = V.direction(F.when(c < -0.999, V.cross(a, spare)).otherwise(V.sub(s["b"], V.scale(a, c))))
        turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
        return F.struct(s["start"].alias("start"), a.alias("a"), side.alias("side"), (r * 1.0).alias("r"), turn.alias("turn"))

    def points(s: Column) -> Column:
        along, across = (lambda k: s["r"] * F.sin(s["turn"] * k / n)), (lambda k: s["r"] * (1 - F.cos(s["turn"] * k / n)))
        return F.transform(F.sequence(F.lit(0), n), lambda k: V.add(s["start"], V.add(V.scale(s["a"], along(k)), V.scale(s["side"], across(k)))))

    def with_product(s: Column) -> Column:
        c = V.dot(s["a"], s["b"])
        given = F.struct(*[s[k].alias(k) for k in ("start", "a", "b", "r")], c.alias("c"))
        return F.when(c >= 0.999, F.array(s["start"])).otherwise(V.let(V.let(given, turning), points))

    return V.let(F.struct(start.alias("start"), V.direction(from_dir).alias("a"), V.direction(to_dir).alias("b"), radius.alias("r")), with_product)


def build(df: DataFrame) -> DataFrame:
    """Drop triangles with repeated corners."""
    return df.withColumn("triangles", F.filter("triangles", lambda t: (t["a"] != t["b"]) & (t["b"] != t["c"]) & (t["c"] != t["a"])))


def tubes(df: DataFrame, segments: int = 16, capped: bool = True) -> DataFrame:
    """A tube along ``path`` (array of points) with ``radii`` (one, or one a point)."""
    return per_row(df, ["path", "radii"], lambda r: curves.tube(r["path"], r["radii"], segments, capped), MESH)


def resampled_paths(df: DataFrame, spacing: float, smoothing: int = 2) -> DataFrame:
    return per_row(df, ["path"], lambda r: {"path": curves.resample_open(r["path"], spacing, smoothing)}, f"path array<{VEC3}>", replace=True)


def draped_paths(df: DataFrame, width: float, sink: float, top: float) -> DataFrame:
    """A ribbon of half width ``width`` about ``path`` laid on the mesh in ``vertices`` and ``triangles``."""
    return per_row(df, ["path", "vertices", "triangles"], lambda r: curves.draped(r, width, sink, top), MESH, replace=True)


def level_sets(df: DataFrame, fn, cell: float, level: float = 0.0) -> DataFrame:
    """The surface of ``fn(points) < level`` in the box ``low``..``high``; ``fn`` takes an (n, 3) array and the row."""
    return per_row(df, ["low", "high"], lambda r: field.level_set(lambda p: fn(p, r), r["low"], r["high"], cell, level), MESH, whole_row=True)
