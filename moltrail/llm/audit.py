"""Operator 11, filter interaction audit.

Filters are applied in some order; what one removes, hides what the next would have removed. Each document
is put in a cell by the set of filters that it fails. For each part of the table a Gray code walks through
all subsets of filters, toggling one filter at a time: every cell counts how many of the subset's filters
it fails, and documents leave the survivors where that count leaves zero and come back where it returns.
The survivors of the 32 subsets answer every order of filters by differences.

A copy is a row whose text stands under a smaller doc_id anywhere in the table. Rows are counted by text
and id first, so that a text or an id that many rows share is a number by then, and no task gets a whole
group of copies; the texts themselves never move, only their digests.

Rows: null text is empty; a null lang is the part of the empty string; a row without a doc_id is no copy and
makes none, and has no labels; of several labels of one id a 1 counts; rows of one id are copies of each other only if
a smaller id has the text; repeated rows count each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # per cent
MOST_CAPITALS = 3  # per cent
SYMBOLS = "[#$%&*|]"
#: Rows without an id are spread over so many values where ids are joined.
SPREAD = 1024


def failing(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """docs with what the text filters need, and each filter's condition of failure."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, SPACES), "").alias("words"))
    seen = seen.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return seen, {
        "A": F.col("n") < LEAST_WORDS,
        "B": F.col("distinct") * 100 < F.col("n") * LEAST_DISTINCT,
        "C": capitals * 100 > F.length("text") * MOST_CAPITALS,
        "D": F.col("text").rlike(SYMBOLS),
    }


def cells(seen: DataFrame, conditions: dict[str, Column], labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows by the filters that they fail. seen has doc_id, part and text; bit k of the mask is
    the k-th condition, and the bit after them says that a smaller doc_id has the same text."""
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions.values())), F.lit(0))
    rows = seen.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    each = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long")))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic").where("_id IS NOT NULL")
    known = known.groupBy("_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]).withColumn("_salt", F.lit(0).cast("long"))
    each = each.join(known, (F.col("doc_id") == F.col("_id")) & (F.col("salt") == F.col("_salt")), "left")
    each = each.select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    texts = each.groupBy("digest", "part", "mask", "quality", "toxic").agg(least, F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.doc_id").over(W.partitionBy("digest"))  # a text has a row for each part and label
    texts = texts.withColumn("first", first).withColumn("own", F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    out = texts.select("part", "quality", "toxic", both.alias("c")).where("c.n > 0")
    return out.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.expr("c.n * quality")).alias("good"), F.sum(F.expr("c.n * toxic")).alias("toxic"))


def gray_walk(masks: np.ndarray, counts: np.ndarray, n_filters: int) -> np.ndarray:
    """Row s: what of counts (a row for each cell) survives the filters of subset s. One filter is toggled at a time."""
    states = np.zeros((1 << n_filters, counts.shape[1]), np.int64)
    active, subset, survivors = np.zeros(len(masks), np.int64), 0, counts.sum(axis=0)
    states[0] = survivors
    for step in range(1, 1 << n_filters):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        fails = (masks >> bit) & 1 == 1
        if subset >> bit & 1:
            survivors = survivors - counts[fails & (active == 0)].sum(axis=0)
            active += fails
        else:
            active -= fails
            survivors = survivors + counts[fails & (active == 0)].sum(axis=0)
        states[subset] = survivors
    return states


def steps(part: str, masks: np.ndarray, counts: np.ndarray, letters: str) -> pd.DataFrame:
    """A row for each order of the filters and each step of it. counts: documents, good and toxic ones of each cell."""
    bits, n = {x: k for k, x in enumerate(letters)}, len(letters)
    states = gray_walk(masks, counts, n)
    fails = [counts[(masks >> k) & 1 == 1, 0].sum() for k in range(n)]
    only = [counts[masks == 1 << k, 0].sum() for k in range(n)]
    rows, shares = [], np.zeros(n, np.int64)
    for order in permutations(letters):
        subset = 0
        for step, x in enumerate(order, 1):
            k = bits[x]
            after = subset | 1 << k
            lost = states[subset] - states[after]
            shares[k] += lost[0]
            rows.append((part, "".join(order), step, states[after][0], lost[0], fails[k] - lost[0], only[k], lost[1], lost[2], k))
            subset = after
    out = pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    out["shapley"] = shares[out["shapley"]]
    return out


def audit(found: DataFrame, letters: str) -> DataFrame:
    """Of cells (part, mask, n, good, toxic) the steps of all orders of the filters, whose bits follow the letters."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        return steps(own["part"].iloc[0], own["mask"].to_numpy(np.int64), own[["n", "good", "toxic"]].to_numpy(np.int64), letters)

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return found.groupBy("part").applyInPandas(run, schema)  # a part has a cell for each subset of filters at most


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, conditions = failing(table(spark, sf_dir, "documents"))
    return audit(cells(seen, conditions, table(spark, sf_dir, "labels")), "".join(conditions) + "E")


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT d.doc_id, part, CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), cell AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), subset AS (
  SELECT part, s, sum(CASE WHEN mask & s = 0 THEN n ELSE 0 END) AS n, sum(CASE WHEN mask & s = 0 THEN good ELSE 0 END) AS good, sum(CASE WHEN mask & s = 0 THEN toxic ELSE 0 END) AS toxic
  FROM cell, (SELECT unnest(range(32)) AS s) GROUP BY part, s
), f AS (
  SELECT unnest(range(5)) AS k, unnest(['A', 'B', 'C', 'D', 'E']) AS x
), fails AS (
  SELECT part, k, sum(CASE WHEN mask & (1 << k)::INT <> 0 THEN n ELSE 0 END) AS n, sum(CASE WHEN mask = (1 << k)::INT THEN n ELSE 0 END) AS lone FROM cell, f GROUP BY part, k
), orders AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.k, f2.k, f3.k, f4.k, f5.k] AS ks FROM f f1, f f2, f f3, f f4, f f5 WHERE len(list_distinct([f1.k, f2.k, f3.k, f4.k, f5.k])) = 5
), step AS (
  SELECT filter_order, i AS step, ks[i] AS k, list_sum([0] || [(1 << y)::INT FOR y IN ks[1:i-1]])::INT AS s0, list_sum([(1 << y)::INT FOR y IN ks[1:i]])::INT AS s1 FROM orders, (SELECT unnest(range(1, 6)) AS i)
), r AS (
  SELECT b.part, filter_order, step, step.k, a.n AS kept, b.n - a.n AS removed, fails.n - (b.n - a.n) AS redundant, lone, b.good - a.good AS good_lost, b.toxic - a.toxic AS toxic_lost
  FROM step JOIN subset b ON b.s = s0 JOIN subset a ON a.part = b.part AND a.s = s1 JOIN fails ON fails.part = b.part AND fails.k = step.k
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(lone AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM r
"""
