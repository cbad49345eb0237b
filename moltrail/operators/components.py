"""Principal components of wide, sparse data that stay in long form (row, feature, value).

A randomised range finder: the matrix is multiplied by random signs, which a feature's hash gives, so that nothing as wide as
the features is held anywhere; then rounds of two multiplications (a join and a grouped sum each) turn that thin block towards
the leading components. What is as long as the rows, or as the features, is a distributed table of some twenty columns; only the
products of these columns with each other, some twenty by twenty numbers, meet on the driver. Columns are centred by their
means without ever filling the zeros: a product with the centred matrix is the product less its mean over the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import cut_lineage

#: Directions beyond those asked for; at most 64 in all, the bits of a hash.
OVER = 10
ROUNDS = 4


@dataclass
class Components:
    """projections: row, PC_0, ...; loadings: feature, PC_0, ... (unit length, the largest positive); shares of the variance."""

    projections: DataFrame
    loadings: DataFrame
    shares: list[float]


def _names(n: int) -> list[str]:
    return [f"_{j}" for j in range(n)]


def _products(block: DataFrame, width: int, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    """The products of a block's columns with each other, about their means where centred, and the means. Tasks' sums are
    added up before they meet the driver."""
    names = _names(width)
    means = np.array([x or 0.0 for x in block.agg(*[F.avg(c) for c in names]).first()]) if centred else np.zeros(width)

    def run(parts):
        g, seen = np.zeros((width, width)), False
        for part in parts:
            x = part[names].to_numpy(float) - means
            g, seen = g + x.T @ x, True
        if seen:
            yield pd.DataFrame({"g": [g.ravel().tolist()]})

    sums = block.select(*names).mapInPandas(run, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    out = np.zeros(width * width)
    for r in sums:
        out[r["pos"]] = r["v"]
    return out.reshape(width, width), means


def _turned(block: DataFrame, key: str, means: np.ndarray, turn: np.ndarray) -> DataFrame:
    """The block's columns less their means, times a small matrix."""
    names, kind = _names(turn.shape[1]), block.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            x = (part[_names(len(means))].to_numpy(float) - means) @ turn
            yield pd.concat([part[[key]], pd.DataFrame(x, columns=names, index=part.index)], axis=1)

    return block.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))


def _orthonormal(block: DataFrame, key: str, width: int, centred: bool) -> tuple[DataFrame, int]:
    """Columns of unit length at right angles to each other that span the block's; fewer where these depend on each other."""
    g, means = _products(block, width, centred)
    w, v = np.linalg.eigh(g)
    keep = w > max(w.max(initial=0.0), 0.0) * 1e-13
    if not keep.any():
        return block, 0
    return _turned(block, key, means, v[:, keep] / np.sqrt(w[keep])), int(keep.sum())


def _multiplied(entries: DataFrame, block: DataFrame, on: str, by: str, width: int) -> DataFrame:
    sums = [F.sum(F.col("_v") * F.col(n)).alias(n) for n in _names(width)]
    return entries.join(block.withColumnRenamed(on, "_on"), F.col(on) == F.col("_on")).groupBy(by).agg(*sums)


def wide_components(rows: DataFrame, row: str, feature: str, value: str, k: int, all_rows: DataFrame | None = None, over: int = OVER, rounds: int = ROUNDS, seed: int = 0) -> Components:
    """The first k components of the matrix whose entries are the rows' sums of value; others are 0. all_rows may list rows
    without entries too. Exact where the matrix has no more than k + over independent rows or columns; otherwise leading components come
    as close as their shares stand out from those behind k + over, to the power of twice the rounds. Components of no variance are left out."""
    k = min(k, 64)
    width = min(64, k + over)
    entries = cut_lineage(rows.groupBy(row, feature).agg(F.sum(F.col(value).cast("double")).alias("_v")).where("_v <> 0"))
    ids = cut_lineage((rows if all_rows is None else all_rows).select(row).distinct())
    n = ids.count()
    by_feature = entries.groupBy(feature).agg(F.sum("_v").alias("s"), F.avg("_v").alias("m"), F.count("*").alias("c"), F.var_pop("_v").alias("v"))
    spread = F.col("c") * F.col("v") + F.pow("m", 2) * F.col("c") * (1 - F.col("c") / n)  # about the mean, zeros included
    total = by_feature.agg(F.sum(spread)).first()[0] or 0.0

    def by_row(sums: DataFrame, width: int) -> DataFrame:
        full = ids.withColumnRenamed(row, "_on").join(sums, F.col("_on") == F.col(row), "left")
        return cut_lineage(full.select(F.col("_on").alias(row), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _names(width)]))

    signed = entries.withColumn("_h", F.xxhash64(F.lit(seed), F.col(feature)))
    signs = [F.when(F.shiftright("_h", j).bitwiseAND(F.lit(1)) == 1, F.col("_v")).otherwise(-F.col("_v")) for j in range(width)]
    block = by_row(signed.groupBy(row).agg(*[F.sum(s).alias(c) for s, c in zip(signs, _names(width))]), width)
    q, width = _orthonormal(block, row, width, True)
    rounds = 0 if n <= min(64, k + over) else rounds  # so few rows are spanned at once
    for last in [False] * rounds + [True]:
        if not width:
            break
        z = cut_lineage(_multiplied(entries, q, row, feature, width))
        if not last:
            z, width = _orthonormal(z, feature, width, False)
            q, width = _orthonormal(by_row(_multiplied(entries, z, feature, row, width), width), row, width, True)
    if not width:
        return Components(ids, entries.select(feature).distinct(), [])
    g, _ = _products(z, width, False)
    w, v = np.linalg.eigh(g)
    order = [j for j in np.argsort(-w)[:k] if w[j] > w.max() * 1e-12]
    loadings = cut_lineage(_turned(z, feature, np.zeros(width), v[:, order] / np.sqrt(w[order])))
    names = _names(len(order))
    # the loading of greatest size is made positive; of equal ones the first feature's
    tops = loadings.agg(*[F.min(F.struct((-F.abs(F.round(c, 9))).alias("a"), F.col(feature).alias("f"), F.col(c).alias("v"))).alias(c) for c in names]).first()
    signs = np.diag([1.0 if tops[c]["v"] >= 0 else -1.0 for c in names])
    loadings = cut_lineage(_turned(loadings, feature, np.zeros(len(order)), signs))
    block = by_row(_multiplied(entries, loadings, feature, row, len(order)), len(order))
    _, means = _products(block, len(order), True)
    renamed = {c: f"PC_{j}" for j, c in enumerate(names)}
    projections = _turned(block, row, means, np.eye(len(order))).withColumnsRenamed(renamed)
    return Components(projections, loadings.withColumnsRenamed(renamed), [float(x) / total for x in w[order]])


def long_coordinates(coords: DataFrame, frame: str, atom: str) -> DataFrame:
    """frame, feature (atom and axis), value: a coordinate a row."""
    axes = F.explode(F.array(*[F.struct(F.struct(F.col(atom).alias("atom"), F.lit(c).alias("axis")).alias("feature"), F.col(c).alias("value")) for c in "xyz"])).alias("_c")
    return coords.select(frame, axes).select(frame, "_c.*")
