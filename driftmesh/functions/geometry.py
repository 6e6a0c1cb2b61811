"""Vectors, polygons, rotations, mirrors and the weight kernel as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

#: What keeps square roots of squares away from zero in the kernel, in magnitudes and in polygon areas,
#: and the length of a rotation axis below which there is no rotation.
EPS_KERNEL = 1e-15
EPS_MAGNITUDE = 1e-30
EPS_AREA = 1e-15
LEAST_AXIS = 1.4901161193847656e-08


def vector(x, y, z) -> Vector:
    return tuple(F.col(c) if isinstance(c, str) else c for c in (x, y, z))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def magnitude(a: Vector) -> Column:
    return F.sqrt(dot(a, a) + F.lit(EPS_MAGNITUDE))


def distance2(a: Vector, b: Vector) -> Column:
    d = minus(a, b)
    return dot(d, d)


def distance_to_box(p: Vector, low: Vector, high: Vector) -> Column:
    """Squared distance from a point to an axis-aligned box, zero inside."""
    gaps = [F.greatest(lo - c, c - hi, F.lit(0.0)) for c, lo, hi in zip(p, low, high)]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def power(q: Column, e: float) -> Column:
    """q to the e; small whole exponents by products, whose shared parts are computed once."""
    if e != int(e) or not 1 <= e <= 16:
        return F.pow(q, F.lit(e))
    out, base, n = None, q, int(e)
    while n:
        if n & 1:
            out = base if out is None else out * base
        n >>= 1
        base = base * base
    return out


def idw_weight(area: Column, d2: Column, ldef, a_exp: float, b_exp: float, alpha: float, eps: float = EPS_KERNEL) -> Column:
    """area * (q^a + alpha^b q^b), q = ldef over the distance."""
    ratio = ldef / F.sqrt(d2 + F.lit(eps))
    return area * (power(ratio, a_exp) + F.lit(alpha**b_exp) * power(ratio, b_exp))


def rotation_matrix(n0: Vector, n1: Vector) -> list[Column]:
    """Nine columns, row by row, of the rotation that turns n0 into the direction of n1 (Rodrigues)."""
    axis = cross(n0, n1)
    length = magnitude(axis)
    turned = length >= LEAST_AXIS
    unit = [F.when(turned, axis[0] / length).otherwise(F.lit(1.0))] + [F.when(turned, c / length).otherwise(F.lit(0.0)) for c in axis[1:]]
    m0, m1 = magnitude(n0), magnitude(n1)
    cosine = F.least(F.lit(1.0), dot(tuple(c / m0 for c in n0), tuple(c / m1 for c in n1)))
    angle = F.when(turned, F.acos(F.greatest(cosine, F.lit(-1.0)))).otherwise(F.lit(0.0))
    s, c1 = F.sin(angle), 1 - F.cos(angle)
    x, y, z = unit
    return [
        1 - c1 * (y * y + z * z), c1 * x * y - s * z, c1 * x * z + s * y,
        c1 * x * y + s * z, 1 - c1 * (x * x + z * z), c1 * y * z - s * x,
        c1 * x * z - s * y, c1 * y * z + s * x, 1 - c1 * (x * x + y * y),
    ]


def polygon_props(corners: Column) -> Column:
    """struct<area,nx,ny,nz> of array<struct<x,y,z>>: a fan about the mean; triangles weigh alike in the normal."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    n = F.size(corners)
    # a lambda's second argument would be the position, so names are bound by a function around it
    pick = lambda c: lambda p: p[c]
    share = lambda k: lambda t: t["c"][k] / t["m"]
    centre = F.struct(*[(total(F.transform(corners, pick(c))) / n).alias(c) for c in "xyz"])

    def fans(bound):
        pts, mid = bound["p"], bound["c"]
        rays = F.transform(pts, lambda p: F.struct(*[(p[c] - mid[c]).alias(c) for c in "xyz"]))
        return F.transform(rays, lambda r, i: F.struct(r.alias("a"), F.get(rays, F.pmod(i + 1, F.size(rays))).alias("b")))

    def normal(pair):
        c = cross(tuple(pair["a"][k] for k in "xyz"), tuple(pair["b"][k] for k in "xyz"))
        return F.struct(*[v.alias(k) for v, k in zip(c, "xyz")])

    bound = F.transform(F.array(F.struct(corners.alias("p"), centre.alias("c"))), fans)
    normals = F.transform(F.get(bound, F.lit(0)), normal)
    sized = F.transform(normals, lambda c: F.struct(c.alias("c"), F.sqrt(c["x"] * c["x"] + c["y"] * c["y"] + c["z"] * c["z"] + F.lit(EPS_AREA)).alias("m")))
    sums = F.transform(F.array(sized), lambda s: F.struct(
        total(F.transform(s, lambda t: t["m"] * 0.5)).alias("area"), *[total(F.transform(s, share(k))).alias(k) for k in "xyz"]
    ))
    unit = F.transform(sums, lambda s: F.struct(s["area"].alias("area"), *[(s[k] / F.sqrt(s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"])).alias(f"n{k}") for k in "xyz"]))
    return F.get(unit, F.lit(0))


def mirror_point(r: Vector, planes: Sequence[tuple[Sequence[float], Sequence[float]]], image: int) -> Vector:
    """r mirrored at each plane whose bit is set in image, in order; planes are (point, unit normal)."""
    for j, (p, n) in enumerate(planes):
        if image >> j & 1:
            away = sum((r[k] - F.lit(float(p[k]))) * F.lit(float(n[k])) for k in range(3))
            r = tuple(r[k] - 2 * away * F.lit(float(n[k])) for k in range(3))
    return r


def mirror_vector(v: Vector, planes: Sequence[tuple[Sequence[float], Sequence[float]]], image: int) -> Vector:
    for j, (_, n) in enumerate(planes):
        if image >> j & 1:
            along = sum(v[k] * F.lit(float(n[k])) for k in range(3))
            v = tuple(v[k] - 2 * along * F.lit(float(n[k])) for k in range(3))
    return v


def plane_foot(p: Vector, n: Vector) -> Vector:
    """The point of the plane that is nearest to the origin."""
    along = dot(p, n)
    return tuple(along * c for c in n)


def same_plane(p1: Vector, n1: Vector, p2: Vector, n2: Vector) -> Column:
    """Whether two planes are one, up to the sign of the normal."""
    d = minus(p2, p1)
    out = F.abs(dot(d, n1)) * F.sqrt(dot(n1, n1)) / (F.sqrt(dot(d, d)) + F.lit(1e-30))
    return (F.abs(dot(n1, n2)) >= 0.99) & (out <= 1e-8)


#: Distances over radius at which a tree node's error is known.
ERROR_KNOTS = (2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 640.0)


def error_at(errors: Column, ratio: Column) -> Column:
    """Errors at the knots, joined linearly; past the last knot the last."""
    out = F.get(errors, F.lit(11))
    for i in range(10, -1, -1):
        share = (ratio - ERROR_KNOTS[i]) / (ERROR_KNOTS[i + 1] - ERROR_KNOTS[i])
        out = F.when(ratio < ERROR_KNOTS[i + 1], (1 - share) * F.get(errors, F.lit(i)) + share * F.get(errors, F.lit(i + 1))).otherwise(out)
    return out
