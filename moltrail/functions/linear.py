"""Small symmetric matrices as arrays of arrays, in Column expressions: products and leading eigenvectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squarings: the power of 2^40 parts eigenvalues that differ in the tenth digit.
SQUARINGS = 40


def symmetric(upper: dict[str, Column], names: str) -> Column:
    """A matrix from its upper triangle, whose keys are pairs of names in order."""
    at = lambda a, b: upper[a + b] if a + b in upper else upper[b + a]
    return F.array(*[F.array(*[at(a, b) for b in names]) for a in names])


def _dot(a: Column, b: Column, n: int) -> Column:
    return sum((a[k] * b[k] for k in range(1, n)), a[0] * b[0])


def leading_vector(matrix: Column, n: int, squarings: int = SQUARINGS) -> Column:
    """The eigenvector of a symmetric matrix of n x n, without negative eigenvalues, that belongs to the greatest: squared over and
    over the matrix turns into the projection on it, whose longest column is the vector. Its largest part is positive. Of a zero matrix
    it is the first axis."""

    def square(p: Column, _: Column) -> Column:
        t = sum((p[k][k] for k in range(1, n)), p[0][0])
        t = F.when(t > 0, t).otherwise(F.lit(1.0))
        return F.transform(p, lambda a: F.transform(p, lambda b: _dot(a, b, n) / t / t))

    p = F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), matrix, square)
    longest = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.struct(F.lit(0).alias("k"), p.alias("p")), lambda s, k: F.struct(F.when(s["p"][k][k] > s["p"][s["k"]][s["k"]], k).otherwise(s["k"]).alias("k"), s["p"].alias("p")), lambda s: s["p"][s["k"]])

    def unit(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        top = F.aggregate(v, F.lit(0.0), lambda s, x: F.when(F.abs(x) > F.abs(s), x).otherwise(s))
        return F.when(size > 0, F.transform(v, lambda x: x / (size * F.when(top < 0, -1.0).otherwise(1.0)))).otherwise(F.array(*[F.lit(1.0 if k == 0 else 0.0) for k in range(n)]))

    # one-element arrays bind the vector once, where naming it again would compute it again
    return F.transform(F.array(longest), unit)[0]


def quaternion_matrix(s: dict[str, Column]) -> Column:
    """The 4 x 4 matrix whose leading eigenvector is the quaternion of the rotation that brings p onto q best; s["xy"] is
    the sum of p's x times q's y. Moved up by a bound of its eigenvalues, so that none is negative."""
    bound = F.sqrt(3.0 * sum((v * v for v in list(s.values())[1:]), list(s.values())[0] * list(s.values())[0]))
    up = F.when(bound > 0, bound).otherwise(1.0)
    upper = {
        "ww": s["xx"] + s["yy"] + s["zz"] + up, "wx": s["yz"] - s["zy"], "wy": s["zx"] - s["xz"], "wz": s["xy"] - s["yx"],
        "xx": s["xx"] - s["yy"] - s["zz"] + up, "xy": s["xy"] + s["yx"], "xz": s["zx"] + s["xz"],
        "yy": s["yy"] - s["xx"] - s["zz"] + up, "yz": s["yz"] + s["zy"], "zz": s["zz"] - s["xx"] - s["yy"] + up,
    }
    return symmetric(upper, "wxyz")


def quaternion_rotation(q: Column) -> list[list[Column]]:
    """The rotation of a unit quaternion, row by row."""
    w, x, y, z = (q[k] for k in range(4))
    return [
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ]
