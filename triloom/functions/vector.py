"""Vector, plane, rotation and frame algebra on struct columns; all JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import vec3

# A direction shorter than this is refused; a normal shorter than this is zero.
SHORTEST, VANISHING = 1e-12, 1e-300
ON_PLANE = 1e-9


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` written once: expressions that use an argument often would else grow as a power of their depth."""
    return F.get(F.transform(F.array(value), fn), 0)


def bound(fn):
    """Bind a function's Column arguments by ``let``."""

    def run(*args):
        named = {f"a{k}": a if isinstance(a, Column) else F.lit(float(a)) for k, a in enumerate(args)}
        return let(F.struct(*[v.alias(k) for k, v in named.items()]), lambda s: fn(*[s[k] for k in named]))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def add(a: Column, b: Column) -> Column:
    return vec3(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec3(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, k) -> Column:
    return vec3(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec3(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def cross2(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def lerp(a: Column, b: Column, t) -> Column:
    return add(a, scale(sub(b, a), t))


def minimum(a: Column, b: Column) -> Column:
    return vec3(*[F.least(a[k], b[k]) for k in "xyz"])


def maximum(a: Column, b: Column) -> Column:
    return vec3(*[F.greatest(a[k], b[k]) for k in "xyz"])


def is_finite(a: Column) -> Column:
    return ~(F.isnan(a["x"] - a["x"]) | F.isnan(a["y"] - a["y"]) | F.isnan(a["z"] - a["z"]))


@bound
def direction(a: Column) -> Column:
    """The unit vector; NULL for one that is not finite or shorter than ``SHORTEST``."""
    return F.when(is_finite(a) & (length(a) >= SHORTEST), scale(a, F.try_divide(F.lit(1.0), length(a))))


@bound
def plane_from_points(a: Column, b: Column, c: Column) -> Column:
    return plane(direction(cross(sub(b, a), sub(c, a))), a)


@bound
def plane(normal: Column, point: Column) -> Column:
    """normal . p = offset; NULL without a normal."""
    return F.when(normal.isNotNull(), F.struct(normal.alias("n"), dot(normal, point).alias("offset")))


def signed_distance(p: Column, point: Column) -> Column:
    return dot(p["n"], point) - p["offset"]


def classify(p: Column, point: Column, tolerance: float = ON_PLANE) -> Column:
    """0 on the plane (inclusive), 1 in front, 2 behind; bit_or of a polygon's corners is 3 where it spans."""
    d = signed_distance(p, point)
    return F.when(F.abs(d) <= tolerance, 0).when(d > 0, 1).otherwise(2)


def flip(p: Column) -> Column:
    return F.struct(scale(p["n"], -1.0).alias("n"), (-p["offset"]).alias("offset"))


@bound
def segment_hit(p: Column, a: Column, b: Column) -> Column:
    da, db = signed_distance(p, a), signed_distance(p, b)
    return F.when(da != db, lerp(a, b, F.try_divide(da, da - db)))


@bound
def axis_angle(axis: Column, radians) -> Column:
    """A unit quaternion; NULL for an axis without direction."""
    d, half = direction(axis), radians / 2
    return F.when(d.isNotNull(), F.struct(F.cos(half).alias("w"), *[(d[k] * F.sin(half)).alias(k) for k in "xyz"]))


@bound
def quaternion(w, x, y, z) -> Column:
    n = F.sqrt(w * w + x * x + y * y + z * z)
    return F.when(n >= SHORTEST, F.struct(*[F.try_divide(v, n).alias(k) for k, v in zip("wxyz", (w, x, y, z), strict=True)]))


def inverse(q: Column) -> Column:
    return F.struct(q["w"].alias("w"), *[(-q[k]).alias(k) for k in "xyz"])


@bound
def then(first: Column, second: Column) -> Column:
    """The rotation that applies ``first`` and then ``second``."""
    a, b = second, first
    v = add(add(scale(b, a["w"]), scale(a, b["w"])), cross(a, b))
    return F.struct((a["w"] * b["w"] - dot(a, b)).alias("w"), v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))


@bound
def between(a: Column, b: Column) -> Column:
    """The shortest rotation from direction a to b; opposite ones turn about an axis square to a, taken from X if |x| < 0.6, else from Y."""
    c = dot(a, b)
    helper = F.when(F.abs(a["x"]) < 0.6, vec3(1, 0, 0)).otherwise(vec3(0, 1, 0))
    n = cross(a, b)
    turn = quaternion(1 + c, n["x"], n["y"], n["z"])
    return F.when(c < -1 + 1e-12, axis_angle(cross(a, helper), F.lit(3.141592653589793))).otherwise(turn)


@bound
def rotate(q: Column, p: Column) -> Column:
    t = scale(cross(q, p), 2.0)
    return add(add(p, scale(t, q["w"])), cross(q, t))


def frame_from_normal(origin: Column, normal: Column) -> Column:
    """origin, tangent u, bitangent v, normal n; the reference axis is Y where |n.z| > 0.85, else Z; a bad normal is +Z."""

    def with_normal(n: Column) -> Column:
        up = F.when(F.abs(n["z"]) > 0.85, vec3(0, 1, 0)).otherwise(vec3(0, 0, 1))
        return let(direction(cross(up, n)), lambda u: F.struct(origin.alias("origin"), u.alias("u"), cross(n, u).alias("v"), n.alias("n")))

    return let(F.coalesce(direction(normal), vec3(0, 0, 1)), with_normal)


@bound
def to_local(frame: Column, p: Column) -> Column:
    d = sub(p, frame["origin"])
    return vec3(dot(d, frame["u"]), dot(d, frame["v"]), dot(d, frame["n"]))


@bound
def to_world(frame: Column, p: Column) -> Column:
    return add(add(frame["origin"], scale(frame["u"], p["x"])), add(scale(frame["v"], p["y"]), scale(frame["n"], p["z"])))
