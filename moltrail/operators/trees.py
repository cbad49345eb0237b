"""Importance of features by extremely randomised trees, grown level by level over all rows.

Every node looks at a few features, which a hash of tree, node and feature chooses, and cuts each somewhere between its least and
greatest value there, where another hash says. So a level takes two passes over the rows, one for the ranges and one for the
classes on either side; tasks send one row for each node and feature looked at. The same data give the same trees, however
they are partitioned, and a plain recursion gives them too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import cut_lineage


def chance(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, kind: int) -> np.ndarray:
    """A number in [0, 1) that its arguments decide."""
    h = np.full(1, (seed * 2 + kind + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for v in (tree, node, feature):
        h = (h ^ np.asarray(v, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)) / float(1 << 53)


def gini(counts: np.ndarray) -> np.ndarray:
    """Rows times impurity, of rows of class counts."""
    n = counts.sum(axis=-1)
    return n - (counts**2).sum(axis=-1) / np.maximum(n, 1)


def looked_at(seed: int, tree: int, node: int, features: np.ndarray, k: int) -> np.ndarray:
    """The k of these features that have the least chance."""
    own = chance(seed, np.full(len(features), tree), np.full(len(features), node), features, 0)
    return np.sort(features[np.argsort(own, kind="stable")[:k]])


class _Level:
    """The nodes of a level: their features looked at, and how rows get there. Children of node k are 2k and 2k + 1."""

    def __init__(self, splits: list[dict[int, tuple[int, float]]], nodes: list[tuple[int, int]], seed: int, features: np.ndarray, k: int):
        self.splits, self.nodes = splits, nodes
        self.features = np.array([looked_at(seed, t, n, features, k) for t, n in nodes]).reshape(len(nodes), k)
        self.slots: dict[int, dict[int, int]] = {}
        for s, (t, n) in enumerate(nodes):
            self.slots.setdefault(t, {})[n] = s

    def places(self, x: np.ndarray):
        """(rows, slots) of each tree that has nodes in this level."""
        for t, own in self.slots.items():
            at = np.ones(len(x), np.int64)
            depth = max(own).bit_length() - 1
            for level in range(depth):
                step = {n: s for n, s in self.splits[t].items() if n.bit_length() - 1 == level}
                here = at.copy()
                for n, (f, cut) in step.items():
                    rows = np.flatnonzero(here == n)
                    at[rows] = 2 * n + (x[rows, f] > cut)
            slot = np.full(2 << depth, -1)
            slot[list(own)] = list(own.values())
            s = slot[at]
            yield np.flatnonzero(s >= 0), s[s >= 0]


def _varying(rows: DataFrame, n_features: int) -> np.ndarray:
    """The features that have more than one value."""

    def run(parts):
        lo, hi = np.full(n_features, np.inf), np.full(n_features, -np.inf)
        for part in parts:
            x = part.iloc[:, 1:].to_numpy(float)
            lo, hi = np.minimum(lo, x.min(axis=0, initial=np.inf)), np.maximum(hi, x.max(axis=0, initial=-np.inf))
        yield pd.DataFrame({"k": np.arange(n_features), "lo": lo, "hi": hi})

    sums = rows.mapInPandas(run, "k int, lo double, hi double").groupBy("k").agg((F.min("lo") < F.max("hi")).alias("v"))
    return np.array(sorted(r["k"] for r in sums.where("v").select("k").collect()), np.int64)  # numbers of the caller's columns


def _ranges(rows: DataFrame, level: _Level) -> tuple[np.ndarray, np.ndarray]:
    shape = level.features.shape

    def run(parts):
        lo, hi = np.full(shape, np.inf), np.full(shape, -np.inf)
        for part in parts:
            x = part.iloc[:, 1:].to_numpy(float)
            for at, slot in level.places(x):
                for j in range(shape[1]):
                    v = x[at, level.features[slot, j]]
                    np.minimum.at(lo[:, j], slot, v)
                    np.maximum.at(hi[:, j], slot, v)
        seen = np.flatnonzero(lo.ravel() <= hi.ravel())
        yield pd.DataFrame({"k": seen, "lo": lo.ravel()[seen], "hi": hi.ravel()[seen]})

    lo, hi = np.full(shape[0] * shape[1], np.inf), np.full(shape[0] * shape[1], -np.inf)
    for r in rows.mapInPandas(run, "k long, lo double, hi double").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # one for each node and feature looked at
        lo[r["k"]], hi[r["k"]] = r["lo"], r["hi"]
    return lo.reshape(shape), hi.reshape(shape)


def _classes(rows: DataFrame, level: _Level, cuts: np.ndarray, n_classes: int) -> np.ndarray:
    """Rows of each class at each node, feature looked at and side of its cut (0: not over it)."""
    shape = (*cuts.shape, 2, n_classes)

    def run(parts):
        n = np.zeros(shape, np.int64)
        for part in parts:
            x, y = part.iloc[:, 1:].to_numpy(float), part.iloc[:, 0].to_numpy(np.int64)
            for at, slot in level.places(x):
                for j in range(shape[1]):
                    np.add.at(n, (slot, j, (x[at, level.features[slot, j]] > cuts[slot, j]).astype(int), y[at]), 1)
        seen = np.flatnonzero(n.ravel())
        yield pd.DataFrame({"k": seen, "n": n.ravel()[seen]})

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in rows.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out.reshape(shape)


def importances(df: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 6, seed: int = 0) -> dict[str, float]:
    """The mean over trees of each feature's share of the impurity that the tree's cuts take away; 0 where nothing is taken. Rows
    without a label or with a null feature are left out. Of the features that vary at all each node looks at as many as the
    square root of their number; of equal gains the first feature's cut counts."""
    df = df.select(label, *[F.col(c).cast("double") for c in columns]).na.drop()
    kinds = sorted(r[0] for r in df.select(label).distinct().collect())  # classes, few
    if len(kinds) < 2:
        return dict.fromkeys(columns, 0.0)
    number = F.create_map(*[F.lit(v) for k, c in enumerate(kinds) for v in (c, k)])
    rows = cut_lineage(df.select(number[F.col(label)].alias("_y"), *columns))
    varying = _varying(rows, len(columns))
    k = max(1, int(np.sqrt(len(varying))))
    splits: list[dict[int, tuple[int, float]]] = [{} for _ in range(trees)]
    gains = np.zeros((trees, len(columns)))
    nodes = [(t, 1) for t in range(trees)]
    for d in range(depth):
        if not nodes or not len(varying):
            break
        level = _Level(splits, nodes, seed, varying, k)
        lo, hi = _ranges(rows, level)
        t, n = np.array(nodes).T
        cuts = lo + chance(seed, t[:, None], n[:, None], level.features, 1) * (hi - lo)
        cuts = np.where(lo < hi, np.minimum(cuts, np.nextafter(hi, -np.inf)), np.inf)
        counts = _classes(rows, level, cuts, len(kinds))
        gain = gini(counts[:, 0].sum(axis=1))[:, None] - gini(counts).sum(axis=2)
        gain = np.where(lo < hi, gain, -1.0)
        best = gain.argmax(axis=1)
        nodes, parents = [], nodes
        for s, (tree, node) in enumerate(parents):
            j = best[s]
            if gain[s, j] <= 0:
                continue
            f = int(level.features[s, j])
            splits[tree][node] = (f, float(cuts[s, j]))
            gains[tree, f] += gain[s, j]
            if d + 1 < depth:
                nodes += [(tree, 2 * node + side) for side in (0, 1) if (counts[s, j, side] > 0).sum() > 1]
    total = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(axis=0)
    return dict(zip(columns, map(float, shares / (shares.sum() or 1.0))))
