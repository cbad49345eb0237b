"""Correlations of very many columns: tiles of columns by columns are summed in tasks, added up in rounds, and only
pairs over a limit ever become rows. Nothing as large as columns x columns meets on the driver or in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import cut_lineage

#: Columns of a tile, and bytes of tiles that a task sums at a time.
BLOCK = 256
TILES_BYTES = 256 << 20
#: Partial sums of a tile that one task adds up.
FAN_IN = 32


def _values(part: pd.DataFrame, means: np.ndarray) -> np.ndarray:
    x = part.to_numpy(float) - means
    return np.where(np.isnan(x), 0.0, x)


def _means(rows: DataFrame, width: int) -> np.ndarray:
    def run(parts):
        s, n = np.zeros(width), np.zeros(width)
        for part in parts:
            x = part.to_numpy(float)
            s, n = s + np.nansum(x, axis=0), n + (~np.isnan(x)).sum(axis=0)
        yield pd.DataFrame({"k": np.arange(width), "s": s, "n": n})

    sums = rows.mapInPandas(run, "k int, s double, n double").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = np.zeros(width)  # a number for each of the columns, which the caller has named
    for r in sums:
        out[r["k"]] = r["s"] / max(1.0, r["n"])
    return out


def _tiles(rows: DataFrame, means: np.ndarray, pairs: list[tuple[int, int]], block: int) -> DataFrame:
    """i, j, part, g: a partition's products of two blocks of columns."""
    cut = lambda x, k: x[:, k * block : (k + 1) * block]

    def run(parts):
        sums, seen = {}, False
        for part in parts:
            x, seen = _values(part, means), True
            for i, j in pairs:
                g = cut(x, i).T @ cut(x, j)
                sums[i, j] = sums[i, j] + g if (i, j) in sums else g
        if seen:
            for (i, j), g in sums.items():
                yield pd.DataFrame({"i": [i], "j": [j], "g": [g.tobytes()]})

    return rows.mapInPandas(run, "i int, j int, g binary").withColumn("part", F.spark_partition_id())


def _added(tiles: DataFrame) -> DataFrame:
    """One sum of each tile, FAN_IN by FAN_IN."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        g = sum(np.frombuffer(b) for b in own["g"])
        return pd.DataFrame({"i": own["i"].iloc[:1], "j": own["j"].iloc[:1], "g": [g.tobytes()], "part": own["part"].iloc[:1] // FAN_IN})

    tiles = cut_lineage(tiles)
    most = tiles.agg(F.max("part")).first()[0] or 0
    while True:
        tiles = tiles.groupBy("i", "j", F.expr(f"part div {FAN_IN}").alias("slot")).applyInPandas(run, "i int, j int, g binary, part int")
        most //= FAN_IN
        if not most:
            return cut_lineage(tiles)


def correlated_pairs(df: DataFrame, columns: list[str], limit: float, block: int = BLOCK) -> DataFrame:
    """A, b, r of the pairs of columns, a before b, whose correlation is over the limit in size. A null counts as its column's mean;
    a constant column has no correlation."""
    rows = cut_lineage(df.select(*[F.col(c).cast("double") for c in columns]))
    means = _means(rows, len(columns))
    blocks = range(-(-len(columns) // block))
    pairs = [(i, j) for i in blocks for j in blocks if i <= j]
    at_a_time = max(1, TILES_BYTES // (8 * block * block))
    tiles = _added(_tiles(rows, means, pairs[:at_a_time], block))
    for k in range(at_a_time, len(pairs), at_a_time):
        tiles = tiles.unionByName(_added(_tiles(rows, means, pairs[k : k + at_a_time], block)))
    width = lambda k: min(block, len(columns) - k * block)

    def diagonal(parts):
        for part in parts:
            for i, g in zip(part["i"], part["g"]):
                v = np.frombuffer(g).reshape(width(i), width(i)).diagonal()
                yield pd.DataFrame({"k": i * block + np.arange(len(v)), "v": v})

    var = np.zeros(len(columns))
    for r in tiles.where("i = j").select("i", "g").mapInPandas(diagonal, "k int, v double").collect():
        var[r["k"]] = r["v"]

    def over(parts):
        for part in parts:
            for i, j, g in zip(part["i"], part["j"], part["g"]):
                a, b = i * block, j * block
                scale = np.sqrt(np.outer(var[a : a + width(i)], var[b : b + width(j)]))
                r = np.divide(np.frombuffer(g).reshape(scale.shape), scale, out=np.zeros_like(scale), where=scale > 0)
                p, q = np.nonzero(np.abs(r) > limit)
                keep = p + a < q + b
                p, q = p[keep], q[keep]
                names = lambda at: np.array([columns[k] for k in at], object)
                yield pd.DataFrame({"a": pd.Series(names(p + a), dtype=object), "b": pd.Series(names(q + b), dtype=object), "r": r[p, q]})

    return tiles.select("i", "j", "g").mapInPandas(over, "a string, b string, r double")


def uncorrelated(df: DataFrame, columns: list[str], limit: float = 0.85) -> list[str]:
    """Going through pairs i < j in order, i goes if both are left and |r| is over the limit. As nothing behind i has gone by
    then, i goes just where it correlates with some column behind it."""
    gone = {r["a"] for r in correlated_pairs(df, columns, limit).select("a").distinct().collect()}  # of the columns' names
    return [c for c in columns if c not in gone]
