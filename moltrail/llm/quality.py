"""Operator 2, quality by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed with
each. Two differences of sizes, both per byte of text, go through a logistic curve that is fitted on the
labels: that of the two compressed sizes (bad less good: positive where the good dictionary helps more),
and, as a logarithm, that of the better one to the text itself, without which texts that compress to almost
nothing under both pass. For the fit every labelled text is measured with dictionaries of the other half,
so that the curve doesn't see texts that its dictionary holds.

Only the fit is on a bounded sample: at most SAMPLE rows of each label, those with the least hash of
doc_id. The dictionaries are built from pieces of PIECE bytes of their texts: all of them, wherever they stand, or, where these
labelled texts have more than PIECES a label, the PIECES with the least hash. They come to the driver, at most 2 * PIECE * PIECES bytes; sizes
for the curve, as all scores, are of whole texts and taken in tasks.

Rows: null and empty texts have no sizes, and score the share of good texts among the labelled; repeated rows
each give a row; of rows of one labelled id the least text is learnt from; a null doc_id is scored and counts as
not held out; without two texts of each label every score is the share of good ones (1 without labels); extra
columns are kept by score() and accepted(); score() replaces own columns of the names that it adds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut_lineage, flat, table

SAMPLE = 2000
DICTIONARY_BYTES = 32_768
PIECE, PIECES = 2000, 16_384
LEVEL = 3
ACCEPT = 0.3
FOLDS = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    share: float  # of good texts among the labelled

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.share)
        x = Measure(self.good, self.bad).features(texts)
        s = 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -60, 60)))
        return np.where([len(t) > 0 for t in texts], s, self.share)


class Measure:
    """Sizes of texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def press(d: bytes):
            kind = zstandard.DICT_TYPE_AUTO if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.good, self.bad = press(good), press(bad)

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1
        for k, t in enumerate(texts):
            if t:
                a, b = len(self.good(t)), len(self.bad(t))
                out[k, 1:] = math.tanh(10 * (b - a) / len(t)), math.log(min(1.0, min(a, b) / len(t)))
        return out


def pieces_of(text: bytes) -> list[bytes]:
    """All of a text in pieces of PIECE bytes."""
    return [text[k : k + PIECE] for k in range(0, len(text), PIECE)]


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary of pieces; too few for the trainer: their bytes themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))


def _cut(batches):
    for batch in chunks(batches):
        data, ends = flat(batch.column("text"))
        pieces = [pieces_of(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("labelled"), batch.column("quality"), pa.array(pieces, pa.list_(pa.binary()))], ["labelled", "quality", "pieces"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pieces: int = PIECES) -> Model:
    """From labelled rows that are not held out; sample bounds the rows of a label, pieces their pieces."""
    rows = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality")).where(F.col("labelled").isNotNull() & (fold(F.col("labelled")) != 0))
    picked = [rows.where(F.col("quality") == q).orderBy(F.xxhash64("labelled"), "labelled").limit(sample) for q in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample rows of two numbers
    found = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(picked, F.col("_doc") == F.col("labelled"))
    texts = cut_lineage(found.groupBy("labelled", "quality").agg(F.min("text").alias("text")).where("text <> ''"))
    got = sorted(map(tuple, texts.select("quality", "labelled").collect()))
    sides = [[r for r in got if r[0] == q] for q in (0, 1)]
    cut = texts.mapInArrow(_cut, "labelled long, quality int, pieces array<binary>").select("quality", "labelled", F.posexplode("pieces").alias("k", "piece"))
    drawn = [cut.where(F.col("quality") == q).orderBy(F.xxhash64("labelled", "k"), "labelled", "k").limit(pieces) for q in (0, 1)]
    known: dict[tuple[int, int], list[bytes]] = {}
    for q, labelled, _, piece in sorted(map(tuple, drawn[0].unionByName(drawn[1]).collect())):
        known.setdefault((q, labelled), []).append(bytes(piece))
    share = len(sides[1]) / len(got) if got else 1.0
    if min(map(len, sides)) < 2:
        return Model(b"", b"", (0.0, 0.0, 0.0), share)
    join = lambda q, rows: dictionary([p for r in rows for p in known.get(r, [])])
    half = {(q, r[1]): k % 2 for q in (0, 1) for k, r in enumerate(sides[q])}
    halves = [(join(1, sides[1][1 - h :: 2]), join(0, sides[0][1 - h :: 2])) for h in (0, 1)]  # each for the other half

    def measure(batches):
        measures = [Measure(*d) for d in halves]
        for batch in chunks(batches):
            data, ends = flat(batch.column("text"))
            keys = list(zip(batch.column("quality").to_pylist(), batch.column("labelled").to_pylist()))
            x = [measures[half[key]].features([data[a:b].tobytes()])[0] for key, a, b in zip(keys, ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in keys], pa.int64()), pa.array([q for q, _ in keys], pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["labelled", "quality", "x"])

    measured = sorted(map(tuple, texts.mapInArrow(measure, "labelled long, quality int, x array<double>").collect()))
    w = fit_curve(np.array([r[2] for r in measured]), np.array([r[1] for r in measured], float))
    return Model(join(1, sides[1]), join(0, sides[0]), tuple(float(v) for v in w), share)


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """docs' rows with their columns, and held_out, score, predicted."""
    docs = docs.drop("held_out", "score", "predicted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for batch in chunks(batches):
            data, ends = flat(batch.column("text"))
            data = data.tobytes()
            s = model.scores([data[a:b] for a, b in zip(ends[:-1], ends[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    rows = docs.mapInArrow(run, f"{kinds}, score double")
    return rows.withColumns({"held_out": fold(F.col("doc_id").cast("long")) == 0, "predicted": (F.col("score") >= accept).cast("int")})


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs whose score is at least `accept`, as they are."""

    def run(batches):
        for batch in chunks(batches):
            data, ends = flat(batch.column("text"))
            data = data.tobytes()
            yield batch.filter(pa.array(model.scores([data[a:b] for a, b in zip(ends[:-1], ends[1:])]) >= accept))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "held_out", "score", "predicted")
