"""Scalar functions on coordinates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
KT = 2.5
COULOMB = 138.935485


def vector(prefix: str = "", suffix: str = "") -> Vector:
    """The columns x, y, z with a prefix and a suffix."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b))


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b))


def times(a: Vector, k) -> Vector:
    return tuple(p * k for p in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return tuple(F.when(n > 0, p / n).otherwise(0.0) for p in a)


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def angle_between(a: Vector, b: Vector) -> Column:
    """Radians; the cosine is clipped to -1..1."""
    c = dot(a, b) / (norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def angle(a: Vector, b: Vector, c: Vector) -> Column:
    """At b."""
    return angle_between(minus(a, b), minus(c, b))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Around b-c, in -pi..pi."""
    b1, b2, b3 = minus(b, a), minus(c, b), minus(d, c)
    n2 = cross(b2, b3)
    return F.atan2(norm(b2) * dot(b1, n2), dot(cross(b1, b2), n2))


def angle_output(radians: Column, kind: str) -> list[Column]:
    """degrees, cos, sin or both of an angle."""
    return {"degrees": [F.degrees(radians)], "cos": [F.cos(radians)], "sin": [F.sin(radians)], "cossin": [F.cos(radians), F.sin(radians)]}[kind]


def switch(d: Column, d0: float = 7.0, m: int = 12, n: int = 6) -> Column:
    """(1 - r^n) / (1 - r^m), r = d / d0; its limit n / m at d0. For m = 2n it is 1 / (1 + r^n)."""
    r = d / d0
    if m == 2 * n:
        return 1.0 / (1.0 + F.pow(r, n))
    return F.when(d == d0, n / m).otherwise((1.0 - F.pow(r, n)) / (1.0 - F.pow(r, m)))


def switch_reach(weight: float, d0: float) -> float:
    """Distance at which switch() with m = 12, n = 6 falls to a weight."""
    return d0 * (1.0 / weight - 1.0) ** (1.0 / 6.0)


def power_law(x: Column, k: float, c0: float, e: float, b: float) -> Column:
    return k * F.pow(x + c0, e) + b


def lennard_jones(sigma_a: Column, eps_a: Column, sigma_b: Column, eps_b: Column, d_nm: Column) -> Column:
    s6 = F.pow((sigma_a + sigma_b) / 2.0 / d_nm, 6)
    return 4.0 * F.sqrt(eps_a * eps_b) * (s6 * s6 - s6)


def coulomb(qa: Column, qb: Column, d_angstrom: Column, dielectric: float = 4.0) -> Column:
    return COULOMB * qa * qb / (d_angstrom * 0.1 * dielectric)


def plane_distance(a: Column, b: Column, c: Column, p: Vector) -> Column:
    """Signed distance of a point from z = ax + by + c."""
    return (a * p[0] + b * p[1] - p[2] + c) / F.sqrt(a * a + b * b + 1.0)


def wrap(c: Column, lo: float, hi: float) -> Column:
    """A coordinate moved once into a periodic box."""
    return F.when(c <= lo, c + (hi - lo)).when(c >= hi, c - (hi - lo)).otherwise(c)


def rotate(p: Vector, axis: Vector, theta: float) -> Vector:
    """Around a unit axis through the origin, by Rodrigues' formula."""
    cos, sin = F.cos(F.lit(theta)), F.sin(F.lit(theta))
    across, along = cross(axis, p), dot(axis, p) * (1.0 - cos)
    return tuple(p[i] * cos + across[i] * sin + axis[i] * along for i in range(3))


def perpendicular(a: Vector) -> Vector:
    """A unit vector at right angles: with the z axis, or with the x axis if a is along z."""
    flat = (a[0] == 0) & (a[1] == 0)
    return tuple(F.when(flat, F.lit(1.0 if i == 0 else 0.0)).otherwise(v) for i, v in enumerate(unit((-a[1], a[0], F.lit(0.0)))))
