"""Operator 12, periodic run detection.

A run is a stretch of words that repeats itself with a period, as long as it can be. Over a document's
words an enhanced suffix array is built: suffixes in order, common prefixes of neighbours and the intervals of
these, without tree nodes. Where an interval of depth d splits, the suffixes of its smaller side look up the places of
the suffixes d words before and behind: in the other side they make a square of period d that can't move right. Each
square moves left, word by word, while it stays one; where it stops, the run begins. Squares of several periods over one stretch are one
run of the least. Only documents with five words that occur twice can hold a run, so that others need no suffix array.

Rows: null and empty texts have no words, no runs and an empty collapse; repeated rows give a row each; a null doc_id is kept;
extra columns are ignored; an empty table gives no rows. Texts are taken whole; memory follows the longest, at
some 60 bytes a word and 4 for each doubling of the longest repeat. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix, table
from .enhanced import intervals, prefixes, suffix_array

LEAST_LENGTH = 6
LEAST_PERIODS = 4
#: Words that must occur twice where there is a run: it has at least max(6 - period, 3 periods) words in common with itself a period later.
SEED = 5
#: Suffixes of smaller sides that are looked up at a time.
AT_A_TIME = 1 << 20
CHUNK = 4 << 20


def may_repeat(x: np.ndarray, seed: int = SEED) -> bool:
    """Whether some seed of items occurs twice (or two have one hash)."""
    n = len(x) - seed + 1
    if n < 2:
        return False
    h = np.zeros(n, np.uint64)
    for k in range(seed):
        h = mix(h * np.uint64(31) + x[k : k + n].astype(np.uint64))
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def branching_squares(x: np.ndarray, least_periods: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of each square that doesn't stay one when moved right; of no longer period than leaves room for least_periods."""
    n = len(x)
    order, levels = suffix_array(x)
    common = prefixes(order, levels)
    levels.clear()
    first, behind = intervals(common)
    slot = np.full(n + 1, -1, np.int64)
    slot[order] = np.arange(n)
    split = np.flatnonzero((common > 0) & (common * least_periods <= n))
    left = split - first[split] <= behind[split] - split  # the smaller side
    lo, size = np.where(left, first[split], split), np.where(left, split - first[split], behind[split] - split)
    other_lo, other_hi = np.where(left, split, first[split]), np.where(left, behind[split], split)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sums = np.cumsum(size)
    at = 0
    while at < len(split):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + AT_A_TIME, side="right")))
        node = np.repeat(np.arange(at, to), size[at:to])
        place = np.arange(len(node)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        i, d = order[lo[node] + place], common[split[node]]
        for start, partner in ((i, i + d), (i - d, i - d)):
            there = slot[np.where((partner >= 0) & (partner < n), partner, n)]
            hit = (there >= other_lo[node]) & (there < other_hi[node])
            starts.append(start[hit])
            periods.append(d[hit])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def runs(x: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least least_length items and least_periods periods, by start, then period."""
    start, period = branching_squares(x, least_periods)
    end = start + 2 * period
    room = end - np.maximum(least_length, least_periods * period)  # the run must begin here or before
    for back in range(1, 9):  # most squares stop within some steps
        now = start - back
        alive = (room >= 0) & ((now < room) | (x[np.maximum(now, 0)] == x[np.maximum(now, 0) + period]))
        start, period, end, room = start[alive], period[alive], end[alive], room[alive]
    by = np.lexsort((period, end))
    found: list[tuple[int, int, int]] = []
    here: list[tuple[int, int]] = []  # start and period of what ends at last_end
    last_end = -1
    for i, d, e, r in zip(*[v[by].tolist() for v in (start, period, end, room)]):
        if e != last_end:
            here, last_end = [], e
        if any(d % q == 0 and s <= i for s, q in here):  # a square inside a run of a period that divides its own
            continue
        step = 64
        while i > 0:  # rotate left
            lo = max(0, i - step)
            stop = np.flatnonzero(x[lo:i] != x[lo + d : i + d])
            if len(stop):
                i = lo + int(stop[-1]) + 1
                break
            i, step = lo, 2 * step
        here.append((i, d))
        if i <= r:
            found.append((i, e - i, d))
    return sorted(found)


def collapse(words: list[bytes], own: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run holds behind its first period."""
    if not own:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in own:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (an array of start, length and period, by start, then period) and collapsed, the text's words without repeats.
    change may put other words in place of a document's."""

    def run(batches):
        for batch in chunks(batches, CHUNK):
            ids = batch.column("doc_id").to_pylist()
            every, texts = [], []
            for i, text in zip(ids, batch.column("text")):
                words = (text.as_py() or "").encode().split()
                if change:
                    words = change(i, words)
                number: dict[bytes, int] = {}
                x = np.fromiter(map(number.setdefault, words, range(len(words))), np.int64, len(words))
                own = runs(x) if len(number) <= len(x) - SEED and may_repeat(x) else []
                every.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(collapse(words, own).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(every, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by its id's checksum, made periodic from some word on; one without an id stays as it is."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted)
    key = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), key.alias("k"), _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))
    period = -F.col("k.period")
    return found.select("doc_id", "n_runs", (-F.col("k.start")).alias("start"), F.col("k.length").alias("length"), period.alias("period"), F.expr("k.length * 1000 DIV -k.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
