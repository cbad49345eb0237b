"""Operator 7, mixing sources to target weights.

Each source's documents, in a pseudorandom order, form one stream of words, which is packed into
blocks of a fixed length, whatever the source's size; only its last block may be shorter. Each source gets slots for the words
of its target, in passes over its stream: a whole pass takes every block, the last one as many as are still
lacking, whole blocks before the short one, so that the words taken are those of the target. The number of slots that a source has in each output shard is a multinomial draw, one for each
pass; a shard's slots are those that follow the slots of the shards before it. The k-th slot of a pass holds
the block that the pass's permutation gives for k (ROUNDS rounds of swap-or-not with keyed numbers, a
permutation of any number of blocks), and slots are joined with blocks by index. All random numbers are
digests of keys, so reruns agree.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; they share the sum of all
sizes by weight, at most `most` times the source's own size, and what exceeds it is shared again.
Water filling gives that in one step: with sources by cap / weight, the level is
(total - caps before) / (weights left) at the first source that lies above it.

Skew: a source's stream is cut into (source, bucket) groups by a digest of doc_id and text; running sums
within a group and over the groups' sums take the place of a window over a whole source. Draws are made
for CHUNK slots at a time, slots for each draw; both are dealt over all tasks. Windows over sources, and
over the shards of a source, hold a row for each.

Rows: null text has size 0; a null source is a source; a null doc_id hashes as an empty text, with its text; each
repeated row is a row of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut_lineage, shuffle_partitions, table

BLOCK = 64
BUCKETS = 4096
#: Slots of one chunk: a pass's slots are first listed as chunks, then within them.
CHUNK = 65536
SHARD_SLOTS = 16384
ROUNDS = 12


def digest(*parts: Column) -> Column:
    """60 bits of md5 over the parts, the same in any SQL engine."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def row_digest(doc: Column, text: Column) -> Column:
    return digest(F.coalesce(doc.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sized_documents(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.col("source").cast("string"), size.alias("size"), row_digest(doc, F.col("text")).alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK) -> DataFrame:
    """source, source_size to source, sid, source_size, target, block, n_blocks, n_words, n_slots."""
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    by_ratio = every.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.withColumn("sid", F.row_number().over(by_name).cast("long")).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("rank", F.row_number().over(by_ratio)).withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(every)["level"]
    rows = rows.withColumn("target", F.least(F.col("weight") * F.coalesce(first, F.lit(0.0)), F.col("cap")))
    rows = rows.withColumn("block", F.lit(block).cast("long"))
    rows = rows.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    rows = rows.withColumn("n_words", F.floor(F.col("target") + 0.5).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.expr("n_words div source_size * n_blocks + ceil(n_words % source_size / block)")).otherwise(0).cast("long")
    return rows.select("source", "sid", "source_size", "target", "block", "n_blocks", "n_words", slots.alias("n_slots"))


def _swap(key: str) -> str:
    """A round of swap-or-not, in any dialect of SQL: x and its partner change places if a keyed bit of the greater says so."""
    partner = f"(({key} % modulus + modulus - x) % modulus)"
    bit = f"((greatest(x, {partner}) % 1000003) * ({key} % 999999999989 + 1) + {key} % 1000033) % 998244353 % 2"
    return f"CASE WHEN {bit} = 1 THEN {partner} ELSE x END"


def output_slots(targets: DataFrame, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, slot (k of the source), sid, index (of the block), take (words, of which a short block has less)."""
    tasks = shuffle_partitions(targets.sparkSession)
    rows = targets.where("n_slots > 0").withColumn("n_shards", F.ceil(F.sum("n_slots").over(W.partitionBy(F.lit(0))) / shard_slots).cast("long"))
    # own slots of a pass; of those before the modulus the blocks are permuted, and what they may take together is rest
    passes = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (n_words - 1) div source_size)")))
    passes = passes.withColumn("rest", F.expr("least(source_size, n_words - epoch * source_size)")).withColumn("own", F.expr("ceil(rest / block)"))
    passes = passes.withColumn("modulus", F.expr("if(rest = source_size, n_blocks, source_size div block)"))
    # how many of a pass's slots each shard has
    drawn = passes.select("sid", "epoch", "own", "n_shards", F.explode(F.expr(f"sequence(0L, (own - 1) div {CHUNK})")).alias("chunk")).repartition(tasks, "sid", "epoch", "chunk")
    drawn = drawn.withColumn("j", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least((chunk + 1) * {CHUNK}, own) - 1)")))
    shard = digest(F.lit(seed), F.lit("shard"), F.col("sid"), F.col("epoch"), F.col("j")) % F.col("n_shards")
    counts = drawn.groupBy("sid", "epoch", shard.alias("shard")).agg(F.count("*").alias("n"))
    before = W.partitionBy("sid", "epoch").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the slots themselves
    keys = F.array(*[digest(F.lit(seed), F.col("sid"), F.col("epoch"), F.lit(r)) for r in range(ROUNDS)])
    passes = passes.select(F.col("sid").alias("sid2"), F.col("epoch").alias("epoch2"), F.col("source_size").alias("whole"), "block", "n_blocks", "modulus", "rest", keys.alias("keys"))
    rows = counts.repartition(tasks, "sid", "epoch", "shard").join(passes, (F.col("sid") == F.col("sid2")) & (F.col("epoch") == F.col("epoch2")))
    rows = rows.withColumn("j", F.explode(F.expr("sequence(`from`, `from` + n - 1)"))).withColumn("x", F.expr(f"if(j < modulus, aggregate(keys, j, (x, key) -> {_swap('key')}), j)"))
    slot = F.col("epoch") * F.col("n_blocks") + F.col("j")
    take = F.expr("if(rest = whole, block, least(block, rest - j * block))")
    return rows.select("shard", slot.alias("slot"), "sid", F.col("x").alias("index"), take.alias("take"))


def packed_blocks(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents' pieces of blocks: seq and bucket name the row within its source; index the block,
    at the piece's first word in it, n its words and first the first word's place in the document.
    A document without words has one piece of no block."""
    rows = sized.withColumn("bucket", F.col("h") % BUCKETS)
    order = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    groups = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    groups = groups.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    groups = groups.join(targets, groups["s"].eqNullSafe(targets["source"])).drop("source")
    rows = rows.join(groups, rows["source"].eqNullSafe(groups["s"]) & (rows["bucket"] == groups["b"])).drop("s", "b")
    rows = rows.withColumn("start", F.expr("offset + upto - size"))
    rows = rows.withColumn("index", F.expr("explode_outer(if(size > 0, sequence(start div block, (start + size - 1) div block), null))"))
    rows = rows.withColumn("at", F.expr("greatest(start, index * block) - index * block"))
    rows = rows.withColumn("n", F.expr("coalesce(least(start + size, (index + 1) * block) - greatest(start, index * block), 0)"))
    return rows.withColumn("first", F.expr("index * block + at - start"))


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mix: pieces of documents in slots of output shards. Pieces that no slot takes stay, with a null
    slot and words 0. Columns: shard, slot, sid, source, source_size, target, index, bucket, seq, h, doc_id, size, first, words."""
    sized = cut_lineage(sized_documents(docs))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, block)
    pieces, slots = packed_blocks(sized, targets), output_slots(targets, seed)
    slots = slots.withColumnsRenamed({"sid": "slot_sid", "index": "slot_index"}).hint("merge")  # as many as blocks: never broadcast
    rows = pieces.join(slots, (pieces["sid"] == slots["slot_sid"]) & (pieces["index"] == slots["slot_index"]), "left")
    words = F.when(F.col("take").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("take") - F.col("at"), F.col("n")))).cast("long")
    return rows.select("shard", "slot", "sid", "source", "source_size", "target", "index", "bucket", "seq", "h", "doc_id", "size", "first", words.alias("words"))


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """shard, slot, source, text: the words of each slot. Pieces find their text by the digest of id and text, so that null
    and repeated ids are no different from others."""
    split = docs.select(row_digest(F.col("doc_id").cast("long"), F.col("text")).alias("id"), "text").dropDuplicates(["id"])
    split = split.select("id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("all"))
    pieces = mixed.where("words > 0").join(split, mixed["h"] == split["id"])
    pieces = pieces.withColumn("part", F.expr("array_join(slice(all, cast(first + 1 as int), cast(words as int)), ' ')"))
    parts = pieces.groupBy("shard", "sid", "source", "slot").agg(F.array_sort(F.collect_list(F.struct("bucket", "seq", "part"))).alias("parts"))
    return parts.select("shard", "slot", "source", F.array_join(F.col("parts.part"), " ").alias("text"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards (output shards that hold words of it), for each row of docs."""
    rows = mixed_blocks(docs, **parameters)
    taken = rows.groupBy("sid", "bucket", "seq", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.countDistinct(F.when(F.col("words") > 0, F.col("shard"))).alias("n_shards"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_D = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_X = "ranged"
for _r in range(ROUNDS):
    _X = f"(SELECT * REPLACE ({_swap(f'key{_r}')} AS x) FROM {_X})"
OP7_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, {_D.format("coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))")} AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes),
weighted AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM named),
ranked AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, sid) AS rank FROM weighted),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM ranked),
chosen AS (SELECT coalesce((SELECT level FROM levels WHERE level <= ratio ORDER BY rank LIMIT 1), 0.0) AS level),
targets AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS n_words, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks FROM
  (SELECT l.source, l.sid, l.source_size, least(l.weight * c.level, l.cap) AS target, {BLOCK}::BIGINT AS block FROM levels l, chosen c)),
counted AS (SELECT *, CAST(n_words // source_size * n_blocks + ceil(n_words % source_size / block) AS BIGINT) AS n_slots FROM targets WHERE source_size > 0),
passes AS (SELECT *, CAST(ceil(rest / block) AS BIGINT) AS own, CASE WHEN rest = source_size THEN n_blocks ELSE source_size // block END AS modulus, (SELECT CAST(ceil(sum(n_slots) / {SHARD_SLOTS}) AS BIGINT) FROM counted) AS n_shards,
  {", ".join(_D.format(f"'7/' || sid || '/' || epoch || '/{r}'") + f" AS key{r}" for r in range(ROUNDS))}
  FROM (SELECT *, least(source_size, n_words - epoch * source_size) AS rest FROM (SELECT *, unnest(range((n_words - 1) // source_size + 1)) AS epoch FROM counted WHERE n_slots > 0))),
drawn AS (SELECT sid, epoch, {_D.format("'7/shard/' || sid || '/' || epoch || '/' || j")} % n_shards AS shard FROM (SELECT sid, epoch, n_shards, unnest(range(own)) AS j FROM passes)),
shards AS (SELECT sid, epoch, shard, n, coalesce(sum(n) OVER (PARTITION BY sid, epoch ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT sid, epoch, shard, count(*) AS n FROM drawn GROUP BY ALL)),
ranged AS (SELECT p.*, s.shard, j, j AS x FROM (SELECT sid, epoch, shard, unnest(range(CAST(start AS BIGINT), CAST(start + n AS BIGINT))) AS j FROM shards) s JOIN passes p ON p.sid = s.sid AND p.epoch = s.epoch),
placed AS (SELECT sid, shard, CASE WHEN rest = source_size THEN block ELSE least(block, rest - j * block) END AS take, CASE WHEN j < modulus THEN x ELSE j END AS index FROM {_X}),
ordered AS (SELECT *, row_number() OVER w AS seq, CAST(sum(size) OVER (PARTITION BY source ORDER BY h % {BUCKETS}, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM sized WINDOW w AS (PARTITION BY source ORDER BY h % {BUCKETS}, h, doc_id, size)),
pieces AS (SELECT *, greatest(start, index * block) - index * block AS at, least(start + size, (index + 1) * block) - greatest(start, index * block) AS n FROM
  (SELECT o.*, t.sid, t.block, unnest(range(start // block, (start + size - 1) // block + 1)) AS index FROM ordered o JOIN targets t ON o.source IS NOT DISTINCT FROM t.source WHERE size > 0)),
taken AS (SELECT p.sid, p.seq, sum(greatest(0, least(s.take - p.at, p.n))) AS taken, count(DISTINCT CASE WHEN s.take > p.at THEN s.shard END) AS n_shards FROM pieces p JOIN placed s ON p.sid = s.sid AND p.index = s.index GROUP BY p.sid, p.seq)
SELECT o.doc_id, o.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken, coalesce(k.n_shards, 0) AS n_shards
FROM ordered o JOIN targets t ON o.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON k.sid = t.sid AND k.seq = o.seq
"""
