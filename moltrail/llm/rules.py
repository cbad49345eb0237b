"""Operator 9, quality rules.

Counting rules: words, characters in words, symbols, repeated lines and words in repeated five-word
windows. The verdict compares two histograms of a document, of character classes and of common words,
with those of its language over the whole table, by the Jensen-Shannon distance (0 to 1). Documents of
fewer words than a guard aren't compared, as short histograms are far from any reference.

Common words are learned: of each of the LANGUAGES commonest languages the EACH words that most of its documents hold.

References: each document of enough words adds its histogram in millionths, so that long documents
weigh no more than others and sums don't depend on their order. Every language has a reference: those of
the KNOWN_LANGUAGES commonest go to the tasks, those of others are joined by language. A null or empty
language, and one without a document of enough words, takes that of all documents, whatever their language;
where that is empty too, nothing is compared.

Rows: null text is empty, has no words and fails the counting rules; every row, repeated or not, gives
a row; a null doc_id stays null; extra columns are ignored; an empty table gives no rows. Work on a
text grows with its length only; a batch of texts is held at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import chunks, cut_lineage, flat, is_space, lower_ascii, mix, span_hashes, table, words

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
#: Words from which a document's character classes, and its common words, are compared.
GUARD_CHARS = 30
GUARD_COMMON = 60
FAR_CHARS = 0.3
FAR_COMMON = 0.34
KNOWN_LANGUAGES = 256
CHUNK, ROWS = 4 << 20, 4096
SYMBOLS = b"#*$%&|<>"
#: Languages whose common words are taken, and how many of each.
LANGUAGES, EACH = 32, 32


def _classes() -> np.ndarray:
    """Class of each byte: a letter each, capitals, digits, blanks, points, other marks, symbols, lead bytes, following bytes."""
    out = np.zeros(256, np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91], out[48:58] = 27, 28
    out[[32]], out[[9, 10, 11, 12, 13]] = 29, 30
    out[list(b".,")], out[list(b";:?'\"-()")], out[list(b"!")], out[list(SYMBOLS)] = 31, 32, 33, 34
    out[0xC0:0xC4], out[0xC4:0xE0], out[0xE0:0xF0], out[0xF0:] = 35, 36, 37, 38
    out[0x80:0xC0] = 39 + (np.arange(64) >> 3)
    return out


CLASSES = _classes()
N_CLASSES = 47


def hash_words(said: list[str]) -> np.ndarray:
    """The hashes by which (lower-case) words are known."""
    raw = [np.frombuffer(w.encode(), np.uint8) for w in said]
    return np.array([span_hashes(w, np.zeros(1, np.int64), np.array([len(w)]))[0] for w in raw], np.uint64)


def _parts(batches):
    """Batches of bounded text and rows, as each row has a bin for each common word."""
    for batch in chunks(batches, CHUNK):
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _doc_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, starts, side="right") - 1


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether an equal one comes earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], later[order] = same[:-1] | same[1:], same[:-1]
    return twice, later


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(data: np.ndarray, ends: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and the two histograms of each document in a flat batch; common: sorted hashes of words."""
    starts, stops, bounds = words(data, ends)
    n_words = np.diff(bounds)
    out = {"n_words": n_words, "word_chars": _per_doc(~is_space(data) & ((data & 0xC0) != 0x80), ends), "n_symbols": _per_doc(CLASSES[data] == 34, ends)}

    breaks = np.flatnonzero(data == 10)
    at = np.unique(np.concatenate([breaks + 1, ends[:-1]]))  # starts of lines; an empty line at the end has no word
    at = at[at < len(data)] if len(data) else at[:0]
    stop = np.append(at[1:], len(data)) if len(at) else at
    stop = np.where((stop > at) & (data[np.maximum(stop - 1, 0)] == 10) if len(at) else np.zeros(0, bool), stop - 1, stop)
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, at)
    at, stop = at[has], stop[has]
    doc = _doc_of(at, ends) if len(at) else at
    _, later = _repeated(mix(span_hashes(data, at, stop) ^ mix(doc.astype(np.uint64) + np.uint64(1))))
    out["n_dup_lines"] = np.bincount(doc[later], minlength=len(ends) - 1)

    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        h = span_hashes(data, starts, stops)
        window = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window = mix(window * np.uint64(31) + h[k : len(h) - WINDOW + 1 + k])
        doc = _doc_of(starts, ends)
        whole = doc[: len(window)] == doc[WINDOW - 1 :]
        first = np.flatnonzero(whole)
        twice, _ = _repeated(mix(window[first] ^ mix(doc[first].astype(np.uint64) + np.uint64(1))))
        first = first[twice]
        covered += np.bincount(first, minlength=len(covered)) - np.bincount(first + WINDOW, minlength=len(covered))
    out["n_repeat_words"] = _per_doc(np.cumsum(covered[:-1]) > 0, bounds)

    return out | histograms(data, ends, starts, stops, bounds, common)


def histograms(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """Character classes and common words of each document, whose words are given; the last bin is of other words."""
    out = {"n_words": np.diff(bounds)}
    h = span_hashes(lower_ascii(data), starts, stops)
    place = np.searchsorted(common, h)
    if len(common):
        place = np.where(common[np.minimum(place, len(common) - 1)] == h, place, len(common))
    classes, width = CLASSES[data], len(common) + 1
    out["chars"] = np.array([np.bincount(classes[a:b], minlength=N_CLASSES) for a, b in zip(ends[:-1], ends[1:])], np.int64).reshape(-1, N_CLASSES)
    out["common"] = np.array([np.bincount(place[a:b], minlength=width) for a, b in zip(bounds[:-1], bounds[1:])], np.int64).reshape(-1, width)
    return out


def common_words(docs: DataFrame, languages: int = LANGUAGES, each: int = EACH) -> np.ndarray:
    """Sorted hashes of the words that most documents of a language hold, each of the languages whose documents hold most words; at most
    languages * each. A null language counts as the empty one. Tasks send the distinct words of a batch, which are summed before
    they are shuffled."""

    def run(batches):
        for batch in chunks(batches, CHUNK):
            data, ends = flat(batch.column("text"))
            starts, stops, bounds = words(data, ends)
            h = span_hashes(lower_ascii(data), starts, stops)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            _, once = np.unique(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)  # a word counts once a document
            names, lang = np.unique(np.array([x or "" for x in batch.column("lang").to_pylist()], str), return_inverse=True)
            h, lang = h[once], lang[doc[once]]
            for k, name in enumerate(names.tolist()):
                own, n = np.unique(h[lang == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n, pa.int64())], ["lang", "h", "n"])

    counts = docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    most = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "h"))
    found = counts.where(F.col("lang").isin(most)).withColumn("rank", rank).where(F.col("rank") <= each).select("h").collect() if most else []
    return np.unique(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def _shares(h: np.ndarray) -> np.ndarray:
    return h / np.maximum(1, h.sum(axis=-1, keepdims=True))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


@dataclass
class References:
    """The two histograms' shares of common languages, and of all documents under None; the sums (lang, h) of other languages;
    the hashes of common words."""

    common: dict[str | None, tuple[np.ndarray, np.ndarray]]
    names: list[str]
    rest: DataFrame | None
    words: np.ndarray


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _shares(h[:N_CLASSES]), _shares(h[N_CLASSES:])


def _summed(parts: DataFrame, width: range) -> DataFrame:
    """lang, n and h, the bins' sums, of the histograms of parts: bins are rows while they are summed, as they may be a thousand."""
    bins = parts.select("lang", "n", F.posexplode("h").alias("pos", "v")).groupBy("lang", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = bins.groupBy("lang").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("h"))
    return rows.select("lang", "n", F.transform("h", lambda b: b["v"]).alias("h"))


def references(docs: DataFrame) -> References:
    said = common_words(docs)

    def run(batches):
        for batch in _parts(batches):
            data, ends = flat(batch.column("text"))
            got = histograms(data, ends, *words(data, ends), said)
            every = np.concatenate([(1e6 * _shares(got["chars"])).astype(np.int64), (1e6 * _shares(got["common"])).astype(np.int64)], axis=1)
            every[got["n_words"] < GUARD_COMMON] = 0
            langs = np.array(["" if x is None else x for x in batch.column("lang").to_pylist()], object)
            names = sorted(set(langs))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([int((langs == x).sum()) for x in names], pa.int64()), pa.array([every[langs == x].sum(axis=0) for x in names], pa.list_(pa.int64()))], ["lang", "n", "h"])

    parts = docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, n long, h array<long>")
    width = range(N_CLASSES + len(said) + 1)
    each = cut_lineage(_summed(parts, width))
    rows = each.orderBy(F.desc("n"), "lang").limit(KNOWN_LANGUAGES + 1).collect()
    total = np.zeros(len(width))
    for r in each.select(F.posexplode("h")).groupBy("pos").agg(F.sum("col").alias("v")).collect():  # one for each bin
        total[r["pos"]] = r["v"]
    top = rows[:KNOWN_LANGUAGES]
    common = {r["lang"]: _halves(np.array(r["h"], float)) for r in top if r["lang"] and any(r["h"])}
    names = sorted({"", *(r["lang"] for r in top)})
    rest = each.where(~F.col("lang").isin(names) & F.exists("h", lambda x: x > 0)).select("lang", "h") if len(rows) > KNOWN_LANGUAGES else None
    return References({**common, None: _halves(total)}, names, rest, said)


def apply_rules(docs: DataFrame, known: References, far_chars: float = FAR_CHARS, far_common: float = FAR_COMMON) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the distances far_chars and far_common (null below the guards, and where
    there is no reference)."""
    common, said = known.common, known.words
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in _parts(batches):
            data, ends = flat(batch.column("text"))
            got = measure(data, ends, said)
            n = got["n_words"]
            failed = (n < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * n)
            own = zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist())
            refs = [common.get(x, common[None]) if h is None else _halves(np.array(h, float)) for x, h in own]
            chars, spoken = np.array([r[0] for r in refs]).reshape(-1, N_CLASSES), np.array([r[1] for r in refs]).reshape(-1, len(said) + 1)
            a, b = distance(_shares(got["chars"]), chars), distance(_shares(got["common"]), spoken)
            use_a, use_b = (n >= GUARD_CHARS) & chars.any(axis=1), (n >= GUARD_COMMON) & spoken.any(axis=1)
            off = (use_a & (a > far_chars)) | (use_b & (b > far_common))
            arrays = [batch.column("doc_id"), *[pa.array(got[k].astype(np.int64)) for k in counts], pa.array(failed), pa.array(~failed & ~off)]
            arrays += [pa.array(a, mask=~use_a), pa.array(b, mask=~use_b)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *counts, "base_failed", "kept", "far_chars", "far_common"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean, far_chars double, far_common double"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    none = F.lit(None).cast("array<bigint>").alias("h")
    if known.rest is None:
        return rows.select("*", none).mapInArrow(run, schema)
    listed = F.coalesce(F.col("lang").isin(known.names), F.lit(True))  # common languages aren't shuffled by language
    joined = rows.where(~listed).join(known.rest, "lang", "left").select(*rows.columns, "h")
    return rows.where(listed).select("*", none).unionByName(joined).mapInArrow(run, schema)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, references(docs))
