"""Shared pieces of the operators: reading tables, flat byte views of Arrow text columns,
word boundaries and rolling hashes in numpy, and byte blobs for moving many small values
as few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..operators.ranges import cut_lineage  # noqa: F401  for the operators of this folder

#: A word of the contracts: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values, one after another, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, (ends - ends[0] if len(ends) else np.zeros(1, np.int64))


def chunks(batches, most: int = 4 << 20):
    """Record batches cut so that each has about `most` bytes of text; a longer text is one by itself."""
    for batch in batches:
        _, ends = flat(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the flat bytes, and the number of words before each document (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~is_space(data)
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True  # a document's end also ends its last word
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, ends)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (murmur's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of each span data[start:stop], the same for equal bytes wherever they stand.
    Spans must be in order of start; they are hashed in blocks, so that powers stay short."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    cut = np.searchsorted(starts, np.arange(0, int(starts[-1]) + 1, block))
    for a, b in zip(cut, [*cut[1:], len(starts)]):
        if a == b:
            continue
        lo, hi = int(starts[a]), int(stops[a:b].max())
        n = hi - lo
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        s, e = starts[a:b] - lo, stops[a:b] - lo
        out[a:b] = (total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def pack(array: np.ndarray) -> bytes:
    """Bytes of an array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)
