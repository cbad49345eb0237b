"""Matrices in long form: row, col, value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .network import expanded


def from_wide(df: DataFrame, row: str, columns: list[str], shift: int = 0) -> DataFrame:
    """One row for each cell; columns are numbered from 0, labels shifted."""
    rows = df.select(F.col(row).alias("row"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("col", "value"))
    return rows.withColumns({"row": F.col("row") + shift, "col": F.col("col") + shift})


def to_wide(m: DataFrame, labels: list) -> DataFrame:
    """R2: a column for each label."""
    return m.groupBy("row").pivot("col", labels).agg(F.first("value"))


def window(m: DataFrame, rows: tuple[float, float], cols: tuple[float, float]) -> DataFrame:
    """both ends inclusive."""
    return m.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def in_range(m: DataFrame, lo: float, hi: float) -> DataFrame:
    """values outside lo <= v < hi become 0."""
    return m.withColumn("value", F.when((F.col("value") >= lo) & (F.col("value") < hi), F.col("value")).otherwise(0.0))


def near_diagonal_zero(m: DataFrame, n: int = 4, shift: tuple[float, float, float] = (0, 0, 0), scale: float = 1.0) -> DataFrame:
    """values with |row - col| <= n become 0; values are scaled, then all three columns shifted."""
    v = F.when(F.abs(F.col("row") - F.col("col")) <= n, 0.0).otherwise(F.col("value") * scale)
    return m.select((F.col("row") + shift[0]).alias("row"), (F.col("col") + shift[1]).alias("col"), (v + shift[2]).alias("value"))


def merged(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """The first above the diagonal, the second below and on it."""
    a, b = upper.withColumnRenamed("value", "va"), lower.withColumnRenamed("value", "vb")
    return a.join(b, ["row", "col"], "full").select("row", "col", F.when(F.col("col") > F.col("row"), F.col("va")).otherwise(F.col("vb")).alias("value"))


def average(matrices: list[DataFrame]) -> DataFrame:
    """Cell by cell."""
    every = matrices[0]
    for m in matrices[1:]:
        every = every.unionByName(m)
    return every.groupBy("row", "col").agg(F.avg("value").alias("value"))


def domain_average(m: DataFrame, domains: DataFrame, zero_diagonal: bool = False) -> DataFrame:
    """The mean value of each pair of domains, over all their ranges; pairs without values are null."""
    d = expanded(domains)
    rows = m.join(d.select(F.col("residue").alias("row"), F.col("name").alias("a")), "row").join(d.select(F.col("residue").alias("col"), F.col("name").alias("b")), "col")
    got = rows.groupBy("a", "b").agg(F.avg("value").alias("value"))
    names = domains.select("name").distinct()
    every = names.withColumnRenamed("name", "a").crossJoin(names.withColumnRenamed("name", "b"))  # of names, not of rows
    out = every.join(got, ["a", "b"], "left")
    return out.withColumn("value", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("value"))) if zero_diagonal else out


def paired_t(a: DataFrame, b: DataFrame) -> DataFrame:
    """T and degrees of freedom of the cells' differences."""
    d = a.join(b.withColumnRenamed("value", "other"), ["row", "col"]).withColumn("d", F.col("value") - F.col("other"))
    return d.agg((F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d")))).alias("t"), (F.count("d") - 1).alias("df"))


def independent_t(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pooled variance."""
    sums = lambda m, s: m.agg(F.avg("value").alias(f"m{s}"), F.var_samp("value").alias(f"v{s}"), F.count("value").alias(f"n{s}"))
    rows = sums(a, "a").crossJoin(sums(b, "b"))  # two single rows
    df = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / df
    return rows.select(((F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"), df.alias("df"))


def linear_fit(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """A39."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """The continued fraction of the incomplete beta function, from the far end inwards."""
    f = np.zeros_like(x)
    for m in range(steps, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = even / (1 + odd / (1 + f))
    return 1 / (1 + (-(a + b) * x / (a + 1)) / (1 + f))


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided probability of |t| or more."""
    from math import lgamma

    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    far = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side only
    a, b, x = np.where(far, b, a), np.where(far, a, b), np.where(far, 1 - x, x)
    log = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-x)) / a
    p = front * _beta_fraction(a, b, x)
    return np.where(far, 1 - p, p)


@F.pandas_udf(T.DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    """U4: the p-value of a t statistic, for rows that are already aggregated."""
    return pd.Series(student_tail(t.to_numpy(float), df.to_numpy(float)))
