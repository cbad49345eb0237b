"""Operator 3, near duplicates by SimHash.

A fingerprint's bit is set if it is set in over half of the XXH64 hashes of the document's word
shingles. Two fingerprints within `radius` bits, cut into `blocks` blocks, agree wholly in some
blocks - radius of these blocks, so for each choice of that many blocks fingerprints are bucketed by
those bits. Inside a bucket the comparison is exact and tiled: numpy exclusive-or and bit counts on
tiles sorted by population count, leaving out tile pairs whose counts differ beyond the radius.
A bucket of over `tile` fingerprints is cut into tiles by hash, and each pair of tiles is a row of its
own. A bucket gives a spanning forest of its links, never all pairs; components join the forests.

similar_documents() finds texts of a shingle similarity of 0.8 and more, which differ in too many of 64 bits for
that: WIDE * 64 bits are made from one hash of each shingle of five words, and fingerprints that agree in one of
their BANDS pieces of 16 bits are compared in the same way. At a similarity of 0.8 two of them differ in 0.1515 of
the bits (the angle of two sets that share 0.8), 78 of 512 with a deviation of 8, and agree in some piece with
probability 0.91, at 0.85 with 0.97, at 0.9 with 0.997. A bucket gives a least spanning tree of what WIDE_RADIUS links;
its edges of over SURE bits are confirmed by the exact similarity of the two texts' shingles.

Copies share a fingerprint and count once. Rows: null and empty texts have fingerprint zero; a null
doc_id gets the component of its fingerprint if a document with an id shares it, else null, and links
nothing; rows of one doc_id are one document with several texts; extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut_lineage, flat, lower_ascii, mix, span_hashes, table, words
from .graph import components

SHINGLE = 4
RADIUS = 4
BLOCKS, MANY, MANY_BLOCKS = 6, 100_000_000, 8
TILE = 2048
#: For similar_documents(): words of a shingle, 64-bit words of a fingerprint, differing bits at most, bits of a band.
SIMILAR, WIDE, WIDE_RADIUS, BAND = 5, 8, 96, 16
#: Links of up to so many bits aren't confirmed; others need this similarity.
SURE, LEAST = 55, 0.8
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a lower-cased text."""
    said = _WORDS(text)
    if not said:
        return 0
    joined, digest = b" ".join(said), xxhash.xxh64_digest
    if len(said) <= shingle:
        hashes = digest(joined, 42)
    else:
        stops = [n + k for k, n in enumerate(accumulate(map(len, said)))]
        starts = [0, *(n + 1 for n in stops)]
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, stops[shingle - 1 :])])
    bits, n, count = np.frombuffer(hashes, np.uint8).reshape(-1, 8), len(hashes) // 8, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 18):
        count += np.unpackbits(bits[k : k + (1 << 18)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in chunks(batches):
            data, ends = flat(batch.column("text"))
            data = lower_ascii(data).tobytes()
            values = [fingerprint(data[a:b], shingle) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, the mask of their bits, as a signed long."""
    cut = [64 * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cut, cut[1:])]
    return [int(np.array(sum(c), np.uint64).view(np.int64)) for c in combinations(parts, blocks - radius)]


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """For each of a and each of b, fingerprints of one or more words (n, words), whether they are within the radius."""
    bits = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for k in range(1, a.shape[1]):
        bits += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return bits <= radius


def having_links(f: np.ndarray, ones: np.ndarray, radius: int, tile: int) -> np.ndarray:
    """Which fingerprints, in order of population count, have any link: tiles against tiles that aren't too far in count."""
    n, some = len(f), np.zeros(len(f), bool)
    for i in range(0, n, tile):
        for j in range(i, n, tile):
            if ones[j] - ones[min(i + tile, n) - 1] > radius:
                break
            near = linked(f[i : i + tile], f[j : j + tile], radius)
            if i == j:
                np.fill_diagonal(near, False)
            some[i : i + tile] |= near.any(axis=1)
            some[j : j + tile] |= near.any(axis=0)
    return some


def least_tree(fp: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Child, parent and differing bits of the edges of least spanning trees of all links (one node is added at a time)."""
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    left = order[having_links(fp[order], ones[order], radius, tile)]
    nearest, parent = np.full(len(left), 1 << 15), np.full(len(left), -1)
    out = []
    while len(left):
        k = int(nearest.argmin())
        now = left[k]
        if nearest[k] <= radius:
            out.append((now, parent[k], nearest[k]))
        keep = np.arange(len(left)) != k
        left, nearest, parent = left[keep], nearest[keep], parent[keep]
        bits = np.bitwise_count(fp[left] ^ fp[now]).sum(axis=1, dtype=np.int64)
        closer = bits < nearest
        nearest[closer], parent[closer] = bits[closer], now
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def forest(fp: np.ndarray, radius: int, tile: int = 512) -> np.ndarray:
    """For each fingerprint the place of its component's root, linking those within the radius."""
    fp = fp.reshape(len(fp), -1)
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    f, ones = fp[order], ones[order]
    n = len(f)
    root = np.arange(n)
    left = np.flatnonzero(having_links(f, ones, radius, tile))
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            now, front = front[:tile], front[tile:]
            hit = np.zeros(len(left), bool)
            for j in range(0, len(left), tile):
                part = left[j : j + tile]
                if ones[part[0]] - ones[now].max() > radius or ones[now].min() - ones[part[-1]] > radius:
                    continue
                hit[j : j + tile] = linked(f[now], f[part], radius).any(axis=0)
            root[left[hit]] = seed
            front = np.concatenate([front, left[hit]])
            left = left[~hit]
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _tiles(keyed: DataFrame, tile: int) -> DataFrame:
    """ids and fps of each bucket (t, k) of keyed (id, fp, t, k) with two and more; of large ones for each pair of tiles."""
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1").withColumn("g", F.ceil(F.col("n") / tile)).select(F.col("t").alias("t2"), F.col("k").alias("k2"), "g")
    rows = keyed.join(shared, (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2"))).withColumn("i", F.expr("pmod(xxhash64(fp), g)"))
    rows = rows.withColumn("j", F.explode(F.expr("filter(sequence(0, g - 1), x -> g = 1 or x <> i)")))
    return rows.groupBy("t", "k", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.collect_list("fp").alias("fps"), F.collect_list("id").alias("ids"))


def close(fp: np.ndarray, ends: np.ndarray, radius: int, most: int = 64, block: int = 1 << 18) -> np.ndarray:
    """Which buckets ends[k]:ends[k + 1] of fp (n, words) hold a pair within the radius; of those over `most` all."""
    size = np.diff(ends)
    out = size > most
    small = np.flatnonzero((size > 1) & ~out)
    pairs = size[small] * (size[small] - 1) // 2
    for part in np.split(small, np.searchsorted(np.cumsum(pairs), np.arange(block, int(pairs.sum()), block))):
        for n in np.unique(size[part]):  # buckets of one size together
            own = part[size[part] == n]
            a, b = np.triu_indices(n, 1)
            left, right = ends[own][:, None] + a, ends[own][:, None] + b
            bits = np.zeros(left.shape, np.uint16)
            for k in range(fp.shape[1]):
                bits += np.bitwise_count(fp[left, k] ^ fp[right, k])
            out[own] = (bits <= radius).any(axis=1)
    return out


def _trees(rows: DataFrame, radius: int, wide: bool) -> DataFrame:
    """Edges (u, v, bits) of a spanning forest of each row's links; bits is 0 unless wide."""

    def run(batches):
        for batch in batches:
            fps, ids = batch.column("fps"), batch.column("ids").flatten().to_numpy()
            ends = np.cumsum([0, *fps.value_lengths().to_pylist()])
            words = flat(fps.flatten())[0].view(np.uint64) if wide else fps.flatten().to_numpy().view(np.uint64)
            words = words.reshape(len(ids), -1)
            out = [np.zeros((3, 0), np.int64)]
            for k in np.flatnonzero(close(words, ends, radius)):
                own = slice(ends[k], ends[k + 1])
                if wide:
                    child, parent, bits = least_tree(words[own], radius)
                else:
                    root = forest(words[own], radius)
                    child = np.flatnonzero(root != np.arange(len(root)))
                    parent, bits = root[child], np.zeros(len(child), np.int64)
                out.append(np.stack([ids[own][child], ids[own][parent], bits]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], ["u", "v", "bits"])

    return rows.select("fps", "ids").mapInArrow(run, "u long, v long, bits long")


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between the ids of nodes (id, fp) that make the same components as all links do."""
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(block_masks(radius, blocks))]
    keyed = nodes.select("id", "fp", F.explode(F.array(*keys)).alias("key")).select("id", "fp", "key.t", "key.k")
    return _trees(_tiles(keyed, tile), radius, False).select("u", "v")


def shingle_hashes(column: pa.Array, shingle: int):
    """Of each text of a column the hashes of its shingles, repeats included; fewer words are one shingle, none give none."""
    data, ends = flat(column)
    data = lower_ascii(data)
    starts, stops, bounds = words(data, ends)
    h = span_hashes(data, starts, stops)
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = max(1, b - a - shingle + 1) if b > a else 0
        whole = np.zeros(n, np.uint64)
        for k in range(min(shingle, b - a)):
            whole = mix(whole * np.uint64(31) + h[a + k : a + k + n])
        yield whole


def wide_fingerprints(docs: DataFrame, shingle: int = SIMILAR) -> DataFrame:
    """doc_id, fp (WIDE * 8 bytes)."""

    def run(batches):
        seeds = mix(np.arange(1, WIDE + 1, dtype=np.uint64))
        for batch in chunks(batches, 1 << 20):
            out = np.zeros((batch.num_rows, WIDE * 8), np.uint8)
            for d, whole in enumerate(shingle_hashes(batch.column("text"), shingle)):
                n, count = len(whole), np.zeros(WIDE * 64, np.int64)
                for k in range(0, n, 1 << 14):
                    bits = mix(whole[k : k + (1 << 14), None] ^ seeds)
                    count += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
                out[d] = np.packbits(2 * count > n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp binary")


def _named(marked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """marked and component_id, the least id of each row's component."""
    roots = components(edges)
    named = nodes.join(roots, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("fp2"), F.coalesce("root", "id").alias("component_id"))
    return marked.join(named, F.col("fp") == F.col("fp2"), "left").drop("fp2")


def confirmed(docs: DataFrame, edges: DataFrame, shingle: int, least: float) -> DataFrame:
    """The edges (u, v) whose documents share at least that part of all their shingles, in the best of their rows' texts."""

    def run(batches):
        for batch in chunks(batches, 1 << 20):
            sets = [np.unique(x).view(np.int64) for x in shingle_hashes(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi").mapInArrow(run, "id long, s array<long>")
    rows = edges.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return rows.where(shared >= least * (F.size("a") + F.size("b") - shared)).select("u", "v")


def similar_documents(docs: DataFrame, shingle: int = SIMILAR, radius: int = WIDE_RADIUS, tile: int = TILE, least: float = LEAST) -> DataFrame:
    """doc_id, component_id for each row of docs, linking texts of similarity 0.8 and more."""
    marked = cut_lineage(wide_fingerprints(docs, shingle))
    nodes = marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"))
    size = BAND // 8
    keys = [F.struct(F.lit(t).alias("t"), F.substring("fp", t * size + 1, size).alias("k")) for t in range(WIDE * 64 // BAND)]
    keyed = nodes.select("id", "fp", F.explode(F.array(*keys)).alias("key")).select("id", "fp", "key.t", "key.k")
    found = _trees(_tiles(keyed, tile), radius, True).where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("bits").alias("bits"))
    found = cut_lineage(found)
    edges = found.where(F.col("bits") <= SURE).select("u", "v").unionByName(confirmed(docs, found.where(F.col("bits") > SURE).select("u", "v"), shingle, least))
    return _named(marked, nodes, edges).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs. More blocks make more, smaller buckets, and
    the same links: up to MANY rows 6 blocks, with 15 keys of 21 bits, over that 8, with 70 keys of 32 bits."""
    marked = cut_lineage(fingerprints(docs, shingle))
    blocks = blocks or (BLOCKS if marked.count() <= MANY else MANY_BLOCKS)
    nodes = marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"))
    out = _named(marked, nodes, links(nodes, radius, blocks, tile))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
