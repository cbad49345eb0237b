"""Operator 5, benchmark decontamination by the q-gram lemma.

Texts are normalised: lower case, each run of other ASCII characters than letters and digits one space.
A window of W characters that occurs in a document with at most e edits shares W - q + 1 - q * e of its
q-grams with it, all on diagonals that lie within e of each other. So the shared q-grams are counted,
first for each item over stretches of the document, then in overlapping diagonal bands; the places in an
item where WINDOW characters meet the bound are verified by a banded alignment with the document there.
An item leaks into a document when any WINDOW characters of it (all of it, if shorter) do, wherever they
start. Items of under SHORT characters are searched without edits, as whole words.

The benchmark's items go to the tasks PASS_BYTES of text at a time, nearly always all at once; a task
indexes them in blocks of at most BLOCK_ITEMS items and about BLOCK_BYTES bytes, and compares each chunk of
documents with each block. Documents are read once a pass and aren't shuffled. A chunk of about CHUNK bytes
of documents is held at a time, and counts of PIECE places.

Rows: null and empty texts have no matches; null items and those without a letter or digit aren't searched;
repeated rows, on either side, give repeated pairs; a null id stays null; extra columns are ignored; empty
tables give no rows. A match is one row for each document and item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut_lineage, flat, table

Q = 8
WINDOW = 80
EDITS = 0.0625
SHORT = 32
BLOCK_ITEMS = 1000
BLOCK_BYTES = 1 << 20
PASS_BYTES = 32 << 20
#: Indexes that a task keeps; more blocks than these are indexed again for each chunk of documents.
KEPT_BLOCKS = 4
STRETCH = 9  # bits: q-grams are first counted over two stretches of 512 characters
PIECE = 1 << 18
CHUNK = 1 << 21


def _byte_map() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    for lo, hi in ((48, 58), (97, 123), (128, 256)):
        out[lo:hi] = np.arange(lo, hi)
    out[65:91] = np.arange(97, 123)
    return out


_MAP = _byte_map()


def normalise(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes of all texts, their places in data, and the offsets of the texts in them."""
    out = _MAP[data]
    if len(data):
        accent = np.zeros(len(data), bool)  # capitals of Latin-1 are C3 80 to C3 9E
        accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[accent] += 0x20
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
        keep[ends[:-1][ends[:-1] < len(data)]] = True
    at = np.flatnonzero(keep)
    return out[at], at, np.searchsorted(at, ends)


def grams(text: np.ndarray) -> np.ndarray:
    """The q = 8 bytes from each place on, as one number."""
    n = max(0, len(text) - Q + 1)
    if not n:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), np.dtype("<u8"), np.ascontiguousarray(text).tobytes(), 0, (1,)).astype(np.uint64)


@dataclass
class Index:
    """A block of the benchmark: where each q-gram stands in its items' normalised texts."""

    ids: list
    keys: np.ndarray
    first: np.ndarray  # of each key's places, and their end
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray  # of each item's windows
    bound: np.ndarray
    seen: np.ndarray  # by the key's hash
    joined: np.ndarray  # the texts, one after another, and where each begins
    begin: np.ndarray
    words: list  # id and text of items of under Q characters

    def named(self, i: int) -> tuple[int, int]:
        """id and length of an item."""
        if i < len(self.ids):
            return self.ids[i], int(self.begin[i + 1] - self.begin[i])
        item, text = self.words[i - len(self.ids)]
        return item, len(text) - 2

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in g and in the postings that have the same q-gram."""
        maybe = np.flatnonzero(self.seen[_slot(g)])
        k = np.searchsorted(self.keys, g[maybe])
        same = self.keys[np.minimum(k, len(self.keys) - 1)] == g[maybe]
        maybe, k = maybe[same], k[same]
        n = self.first[k + 1] - self.first[k]
        where = np.repeat(maybe, n)
        return where, np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def budget(n: int) -> int:
    """Edits allowed in a window of n characters."""
    return int(EDITS * n) if n >= SHORT else 0


def shared_bound(n: int) -> int:
    return max(1, n - Q + 1 - Q * budget(n))


def _clean(texts: list[bytes]) -> list[bytes]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    text, _, at = normalise(data, np.cumsum([0, *map(len, texts)]))
    return [text[a:b].tobytes().strip() for a, b in zip(at[:-1], at[1:])]


def index(rows: list[tuple[int, str]]) -> Index:
    ids, texts, words = [], [], []
    for (i, _), t in zip(rows, _clean([(t or "").encode() for _, t in rows])):
        if len(t) >= Q:
            ids.append(i)
            texts.append(t)
        elif t:
            words.append((i, b" " + t + b" "))
    g = [grams(np.frombuffer(t, np.uint8)) for t in texts]
    every = np.concatenate(g) if g else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int32)
    place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in g]) if g else np.zeros(0, np.int32)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[_slot(keys)] = True
    size = np.array([min(WINDOW, len(t)) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])
    return Index(ids, keys, np.append(first, len(every)), item[order], place[order], size, np.array([shared_bound(n) for n in size], np.int64), seen, joined, begin, words)


def banded(pattern: np.ndarray, windows: np.ndarray, size: int, text: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window (a place in pattern, `size` long) the least edits against a part of text[lo:hi] whose alignment
    stays on `width` diagonals, where the window's start meets text from `start` on; and that part's start and end."""
    out = [np.zeros((3, 0), np.int64)]
    columns = np.arange(width, dtype=np.int32)
    for k in range(0, len(windows), block):
        p, s, least, most = (x[k : k + block] for x in (windows, start, lo, hi))
        cost = np.broadcast_to(columns, (len(p), width)).copy()  # edits * 64 + the column it starts in
        for t in range(size):
            at = (s + t)[:, None] + columns
            same = (text[np.clip(at, 0, len(text) - 1)] == pattern[p + t][:, None]) & (at >= least[:, None]) & (at < most[:, None])
            new = cost + (64 - (same.astype(np.int32) << 6))
            np.minimum(new[:, :-1], cost[:, 1:] + 64, out=new[:, :-1])
            cost = np.minimum.accumulate(new - 64 * columns, axis=1) + 64 * columns  # characters of the text alone
        end = cost.argmin(axis=1)
        best = cost[np.arange(len(p)), end]
        out.append(np.stack([best >> 6, np.clip(s + (best & 63), least, most), np.clip(s + size + end, least, most)]))
    return tuple(np.concatenate(out, axis=1))


def _hits(known: Index, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shared q-grams where an item has enough of them within two stretches: document, item, places in the text and in the item."""
    g, n, out = grams(text), len(known.ids), []
    for lo in range(0, len(g), PIECE):
        left = max(0, lo - (1 << STRETCH))
        where, posting = known.hits(g[left : lo + PIECE + (1 << STRETCH)])
        where = where + left
        doc = np.searchsorted(at, where, side="right") - 1
        whole = where + Q <= at[doc + 1]
        where, posting, doc = where[whole], posting[whole], doc[whole]
        item = known.item[posting]
        cell = ((where >> STRETCH) - (left >> STRETCH)) * n + item
        counts = np.bincount(cell, minlength=((PIECE >> STRETCH) + 3) * n).reshape(-1, n)
        enough = counts[:-1] + counts[1:] >= known.bound  # this stretch and the next
        enough = np.concatenate([enough[:1], enough[1:] | enough[:-1], enough[-1:]])
        kept = enough.ravel()[cell] & (where >= lo) & (where < lo + PIECE)
        out.append((doc[kept], item[kept].astype(np.int64), where[kept], known.place[posting[kept]].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, the first most important, and the number of the group of all keys but the last; equal rows once."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys[:-1]:
        new[1:] |= x[order][1:] != x[order][:-1]
    own = new.copy()
    own[1:] |= keys[-1][order][1:] != keys[-1][order][:-1]
    return order[own], (np.cumsum(new) - 1)[own]


def _dense(known: Index, item: np.ndarray, place: np.ndarray, group: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of q-grams in order of group and place: windows that hold `need` of a group, as a q-gram of the group and the window's place."""
    to = np.arange(len(item)) + need - 1
    k = np.flatnonzero(to < len(item))
    k = k[(group[to[k]] == group[k]) & (place[to[k]] - place[k] <= known.size[item[k]] - Q)]
    size = known.size[item[k]]
    first = np.maximum(0, place[to[k]] + Q - size)
    n = np.maximum(0, np.minimum(place[k], np.diff(known.begin)[item[k]] - size) - first + 1)
    which = np.repeat(k, n)
    window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    _, once = np.unique(group[which] << 32 | window, return_index=True)
    return which[once], window[once]


def search(known: Index, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """For a chunk of documents: document, item, matched, edits, and start and end as bytes of the document."""
    text, back, at = normalise(data, ends)
    out = _whole_words(known, text, back, at, ends)
    if not known.ids:
        return out
    doc, item, where, place = _hits(known, text, at)
    diagonal = where - place
    # windows that stand in the document as they are: all their q-grams on one diagonal
    order, group = _grouped(doc, item, diagonal, place)
    d, i, p, q = (x[order] for x in (doc, item, diagonal, place))
    k, window = _dense(known, i, q, group, known.size[i] - Q + 1)
    found = [(d[k], i[k], window, np.zeros(len(k), np.int64), window + p[k], window + p[k] + known.size[i[k]])]
    # others: enough q-grams in a band of diagonals, then an alignment
    most = np.array([budget(n) for n in known.size.tolist()], np.int64)
    width = 2 * most[item] + 1
    band = np.concatenate([diagonal // width, diagonal // width - 1])  # bands overlap by half
    doc, item, place, width = (np.tile(x, 2) for x in (doc, item, place, width))
    order, group = _grouped(doc, item, band, place)
    d, i, p, q = (x[order] for x in (doc, item, band * width, place))
    k, window = _dense(known, i, q, group, known.bound[i])
    pair = lambda d, i, w: (d * len(known.ids) + i) << 32 | w
    left = ~np.isin(pair(d[k], i[k], window), pair(*found[0][:3]))
    k, window = k[left], window[left]
    for size in np.unique(known.size[i[k]]).tolist():  # short items have shorter windows
        own = np.flatnonzero(known.size[i[k]] == size)
        j, w, e = k[own], window[own], budget(size)
        edits, lo, hi = banded(known.joined, known.begin[i[j]] + w, size, text, w + p[j] - e, at[d[j]], at[d[j] + 1], 6 * e + 2)
        good = edits <= e
        found.append(tuple(x[good] for x in (d[j], i[j], w, edits, lo, hi)))
    doc, item, window, edits, lo, hi = (np.concatenate(x) for x in zip(*found))
    short = known.size[item] < SHORT  # whole words
    edge = lambda x, end: (x == at[doc + 1] if end else x == at[doc]) | (text[np.clip(x if end else x - 1, 0, len(text) - 1)] == 32)
    keep = ~short | edge(lo, False) & edge(hi, True)
    doc, item, window, edits, lo, hi = (x[keep] for x in (doc, item, window, edits, lo, hi))
    order = np.lexsort((lo, edits, window, item, doc))
    doc, item, window, edits, lo, hi = (x[order] for x in (doc, item, window, edits, lo, hi))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    best = new.copy()
    best[1:] |= window[1:] != window[:-1]
    new, doc, item, window, edits, lo, hi = (x[best] for x in (new, doc, item, window, edits, lo, hi))
    cuts = np.flatnonzero(new)
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        d, i = int(doc[a]), int(item[a])
        covered = np.minimum(np.diff(window[a:b], append=window[b - 1] + known.size[i]), known.size[i])
        start, stop = int(lo[a:b].min()), int(hi[a:b].max())
        out.append((d, i, int(covered.sum()), int(edits[a:b].max()), int(back[start] - ends[d]), int(back[stop - 1] + 1 - ends[d])))
    return out


def _whole_words(known: Index, text: np.ndarray, back: np.ndarray, at: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of items of under Q characters, which follow the others in number."""
    out = []
    if known.words:
        for d, (a, b) in enumerate(zip(at[:-1], at[1:])):
            here = b" " + text[a:b].tobytes() + b" "
            for k, (_, word) in enumerate(known.words):
                p = here.find(word)
                if p >= 0:
                    n = len(word) - 2
                    out.append((d, len(known.ids) + k, n, 0, int(back[a + p] - ends[d]), int(back[a + p + n - 1] + 1 - ends[d])))
    return out


class Items:
    """Some of the benchmark's rows (id, text), indexed by the tasks in blocks."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows, self.cuts, self.kept = rows, [0], {}
        size = 0
        for k, (_, t) in enumerate(rows):
            size += len(t)
            if k - self.cuts[-1] >= BLOCK_ITEMS or size > BLOCK_BYTES and k > self.cuts[-1]:
                self.cuts.append(k)
                size = len(t)
        self.cuts.append(len(rows))

    def blocks(self):
        for a, b in zip(self.cuts, self.cuts[1:]):
            known = self.kept.get(a) or index(self.rows[a:b])
            if len(self.kept) < KEPT_BLOCKS:
                self.kept[a] = known
            yield known


def passes(benchmark: DataFrame) -> Iterator[tuple[Items, bool]]:
    """The benchmark in parts of about PASS_BYTES, one at a time on the driver, and whether there are several."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // PASS_BYTES))
    part = lambda b: items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
    for b in range(n):
        yield Items([(r["item_id"], r["text"]) for r in part(b).orderBy("item_id", "text").collect()]), n > 1


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_chars and matched_chars (normalised), edits (most in a window), start and end (code points
    of the document's text, from the first to the last matched window). Where the benchmark has several parts, the matches of each are
    written before the next is gathered, so that the driver never holds more than one."""
    out = None
    for items, several in passes(benchmark):
        found = _matches(docs, items)
        found = cut_lineage(found) if several else found
        out = found if out is None else out.unionByName(found)
    return out


def _matches(docs: DataFrame, items: Items) -> DataFrame:
    names = ["doc_id", "item_id", "item_chars", "matched_chars", "edits", "start", "end"]
    place = lambda text, n: len(text[:n].tobytes().decode("utf-8", "ignore"))

    def run(batches):
        for batch in chunks(batches, CHUNK):
            data, ends = flat(batch.column("text"))
            ids, rows = batch.column("doc_id").to_pylist(), []
            for known in items.blocks():
                for d, i, matched, edits, lo, hi in search(known, data, ends):
                    item, n = known.named(i)
                    text = data[ends[d] : ends[d + 1]]
                    rows.append((ids[d], item, n, matched, edits, place(text, lo), place(text, hi)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item of the benchmark leaks, as they are."""
    for items, several in passes(benchmark):

        def run(batches, items=items):
            for batch in chunks(batches, CHUNK):
                data, ends = flat(batch.column("text"))
                clean = np.ones(batch.num_rows, bool)
                for known in items.blocks():
                    clean[[d for d, *_ in search(known, data, ends)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        docs = cut_lineage(docs) if several else docs  # the next part is gathered when this one is done with
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
