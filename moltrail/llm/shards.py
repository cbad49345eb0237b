"""Documents in shards: a table of few rows, each the compressed texts of many documents, so that
operators that need a shard's documents together move them once and work on flat arrays."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, mix, pack, unpack

#: Bytes of text that are dealt at a time.
DEALT_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).max


def shard_count(docs: DataFrame, shard_bytes: int, least: int, small_bytes: int = 0) -> int:
    """Shards of about shard_bytes; at least so many, but none of under small_bytes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-size // shard_bytes), min(least, -(-size // small_bytes)) if small_bytes else least)


def sharded(docs: DataFrame, n: int) -> DataFrame:
    """Rows (shard, ids, sizes, text): a batch's documents by shard. The shard comes from id and text, so that rows of one
    id spread; rows without an id, which may be many and alike, spread by partition and place too."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, DEALT_BYTES):
            data, ends = flat(batch.column("text"))
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            sums = np.array([zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.uint64)
            salt = np.where(ids == NO_ID, np.arange(seen, seen + len(ids)) + (task << 32), 0).astype(np.uint64)
            seen += len(ids)
            shard = (mix(mix(ids.astype(np.uint64) ^ (sums << np.uint64(32))) + salt) % np.uint64(n)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            sizes = np.diff(ends)
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                text = np.concatenate([data[ends[k] : ends[k + 1]] for k in own])
                rows.append((int(shard[own[0]]), pack(ids[own]), pack(sizes[own]), pack(text)))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "ids", "sizes", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "shard int, ids binary, sizes binary, text binary")


def opened(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a shard's documents, by id, then text: the same however the rows came."""
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ids = np.concatenate([unpack(x.as_py(), np.int64) for x in rows.column("ids")])
    sizes = np.concatenate([unpack(x.as_py(), np.int64) for x in rows.column("sizes")])
    data = np.concatenate([unpack(x.as_py(), np.uint8) for x in rows.column("text")])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(ids, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
        if len(run) > 1:  # rows of one id by their text
            order[np.searchsorted(ids[order], ids[run[0]]) :][: len(run)] = sorted(run, key=lambda k: data[ends[k] : ends[k + 1]].tobytes())
    data = np.concatenate([data[ends[k] : ends[k + 1]] for k in order])
    return ids[order], data, np.concatenate([[0], np.cumsum(sizes[order])])


def as_table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def rows_of(batches):
    """The rows of batches as dicts, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
