"""Operator 10, WARC derivatives.

From each response record two records are made: a plain-text conversion of its page and a metadata
record with the page's title, HTTP headers, digests and outlinks. Both keep the response's target,
date and payload digest, and name it in WARC-Refers-To; the metadata record also names the conversion.
Record ids are digests of what they name, so that reruns give the same records.

Rows: a null html is an empty page and a null url leaves out WARC-Target-URI; repeated rows give
repeated records (with the same ids); a null page_id is kept; extra columns are ignored; an empty
table gives no records. Pages are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

DATE = "1970-01-01T00:00:00Z"
UNSEEN = ("script", "style", "noscript", "template")
BREAKS = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|title|head|body|html|header|footer|main|aside|form|pre|blockquote|hr"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Pattern and replacement, in order; the same for Java's and RE2's engines.
TEXT_RULES = (
    ("(?is)<!--.*?-->|" + "|".join(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in UNSEEN), ""),
    (r"[ \t\r\n\f]+", " "),
    (rf"(?i)</?(?:{BREAKS})\b[^>]*>", "\n"),
    (r"<[/!?a-zA-Z][^>]*>", ""),
)
TIDY_RULES = ((r"[ \t]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"(?i)<a[ \t\r\n\f][^>]*?href[ \t\r\n\f]*=[ \t\r\n\f]*(\"[^\"]*\"|'[^']*'|[^ \t\r\n\f>\"']+)"
QUOTES = "^[\"']|[\"']$"
MARK = "WARC/1."
HEAD = re.compile(rb"[0-9]\r\n[A-Za-z-]+: ")


def _uuid(*parts: Column) -> Column:
    m = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(m, a, n)]], F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri, date, http_header, payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long"), _uuid(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), payload.alias("payload"))


def with_text(rows: DataFrame, html: str = "payload", text: str = "text") -> DataFrame:
    """rows and their pages' text: unseen elements dropped, a line per block element, entities decoded, white
    space tidied. Each step that is used twice is a column of its own, so that it runs once."""
    raw = F.col(html)
    for pattern, by in TEXT_RULES:
        raw = F.regexp_replace(raw, pattern, by)
    rows = rows.withColumn("_raw", raw)
    number = F.regexp_extract_all("_raw", F.lit(r"&#[0-9]{1,7};"), F.lit(0))
    code = lambda e: F.regexp_replace(e, "[^0-9]", "").cast("int")
    char = lambda e: F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")
    fill = lambda t, e: F.when(code(e).between(1, 55295) | code(e).between(57344, 1114111), F.replace(t, e, char(e))).otherwise(t)
    done = F.when(F.contains("_raw", F.lit("&#")), F.aggregate(F.array_distinct(number), F.col("_raw"), fill)).otherwise(F.col("_raw"))
    for entity, by in ENTITIES:
        done = F.replace(done, F.lit(entity), F.lit(by))
    for pattern, by in TIDY_RULES:
        done = F.regexp_replace(done, pattern, by)
    return rows.withColumn(text, done).drop("_raw")


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: page_id, record_type, record_id, refers_to, related_to, target_uri, date,
    content_type, content_length (bytes), block_digest, source_payload_digest, block."""
    rows = with_text(records).withColumns({
        "source_digest": _digest(F.col("payload")),
        "title": F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n\f]+", " ")),
        "links": F.array_distinct(F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(x, QUOTES, ""))),
        "conversion_id": _uuid(F.lit("conversion"), F.col("record_id")),
        "metadata_id": _uuid(F.lit("metadata"), F.col("record_id")),
    })
    header = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.col("http_header"), r"\r\n", "\n")), r"\n+$", ""), r"\n", "\r\nhttp-header: ")
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), "")
    fields = F.concat(F.lit("title: "), F.col("title"), F.lit("\r\nhttp-header: "), header, F.lit("\r\nsource-payload-digest: "), F.col("source_digest"), F.lit("\r\ntext-digest: "), _digest(F.col("text")), F.lit("\r\n"), links)
    rows = rows.withColumn("fields", fields).drop("payload")

    def record(kind: str, own: str, other: str, content_type: str, block: str) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.col(own).alias("record_id"), F.col("record_id").alias("refers_to"), F.col(other).alias("related_to"), "target_uri", "date", F.lit(content_type).alias("content_type"), F.octet_length(block).cast("long").alias("content_length"), _digest(F.col(block)).alias("block_digest"), F.col("source_digest").alias("source_payload_digest"), F.col(block).alias("block"))

    both = F.array(record("conversion", "conversion_id", "metadata_id", "text/plain", "text"), record("metadata", "metadata_id", "conversion_id", "application/warc-fields", "fields"))
    return rows.select("page_id", F.explode(both).alias("r")).select("page_id", "r.*")


def warc_text(records: DataFrame) -> DataFrame:
    """One column, value: each derived record as WARC/1.1 text without the two line ends that close it."""
    line = lambda name, c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")))
    names = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Related-To": "related_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest", "WARC-Source-Payload-Digest": "source_payload_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *[line(n, c) for n, c in names.items()], F.lit("\r\n"), F.coalesce("block", F.lit(""))).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, one for each partition, by Spark's own text writer."""
    warc_text(records).write.option("lineSep", "\r\n\r\n").text(path)


def _headed(piece: bytes) -> bool:
    """Whether a piece behind MARK begins a record: the version's last digit, a line end and a named field."""
    return HEAD.match(piece) is not None


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Header, block and declared length of each record of pieces, cut at MARK, that begin with one; pieces are joined as far as the
    length says, and only that of the last record may be more than its block has."""
    head, block, size, top = None, b"", 0, None
    for piece in pieces:
        if head is not None and len(block) < size:
            block += MARK.encode() + piece  # the mark stood in the block
            continue
        if head is not None:
            yield head, block[:size], size
            head = None
        if _headed(piece):
            top = piece
        elif top is not None:
            top += MARK.encode() + piece  # the mark stood in the header
        if top is not None and b"\r\n\r\n" in top:
            top, _, block = top.partition(b"\r\n\r\n")
            head = {k.lower(): v for k, v in (x.split(": ", 1) for x in top.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)}
            number = head.get("content-length", "0").strip()
            size, top = int(number) if number.isdecimal() else 0, None
    if head is not None:
        yield head, block[:size], size


_RECORD = ["record_type", "record_id", "refers_to", "target_uri", "date", "header", "block", "truncated"]


def _record(head: dict[str, str], block: bytes, size: int) -> list[pa.Array]:
    names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date"]
    return [*[pa.array([head.get(k)], pa.string()) for k in names], pa.array([list(head.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary()), pa.array([len(block) < size], pa.bool_())]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or (by their name) gzipped: record_type, record_id, refers_to, target_uri, date, header
    (map, lower-case names), block (binary), truncated. Files are read record by record, plain ones in splits. Where a block holds the
    mark of a record, a split may end inside of it: what splits begin with before a record's head goes to the
    split where that record began, a record for each split at most. Of a record that the file cuts off the block holds what is there, and
    truncated says so; one without a whole header is left out."""
    pieces = spark.read.text(path, lineSep=MARK).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))

    def splits(batches):
        rows = ((file, split, value) for batch in batches for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value")))
        for key, own in groupby(rows, key=itemgetter(0, 1)):
            values = (value.as_py() for _, _, value in own)
            lead = []  # up to the first head
            for value in values:
                if _headed(value):
                    yield key, lead, parsed(chain([value], values))
                    break
                lead.append(value)
            else:
                yield key, lead, iter(())

    def whole(batches):
        for _, _, found in splits(batches):
            for head, block, size in found:
                if len(block) >= size:
                    yield pa.RecordBatch.from_arrays(_record(head, block, size), _RECORD)

    def ends(batches):
        for (file, split), lead, found in splits(batches):
            last = None
            for last in found:
                pass
            open_ = last is not None and len(last[1]) < last[2]
            text = MARK.encode() + MARK.encode().join(lead) if lead else b""
            arrays = [pa.array([file]), pa.array([split], pa.int64()), pa.array([text], pa.binary()), pa.array([last is not None]), *(_record(*last) if open_ else _record({}, b"", 0))[5:7], pa.array([last[2] if open_ else 0], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "split", "lead", "headed", "header", "block", "size"])

    def joined(key, own):
        own = own.sort_by("split")
        head, block, size = dict(own.column("header")[0].as_py() or []), own.column("block")[0].as_py(), own.column("size")[0].as_py()
        block += b"".join(own.column("lead")[k].as_py() for k in range(1, own.num_rows))
        return pa.Table.from_arrays(_record(head, block[:size], size), _RECORD).slice(0, 1 if size else 0)

    schema = "record_type string, record_id string, refers_to string, target_uri string, date string, header map<string,string>, block binary, truncated boolean"
    parts = pieces.mapInArrow(ends, "file string, split long, lead binary, headed boolean, header map<string,string>, block binary, size long")
    # a split's lead belongs to the last split before it that has a head; leads without one are no record
    owner = F.last(F.when(F.col("headed"), F.col("split")), True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    places = parts.select("file", "split", "headed").withColumn("owner", owner)
    rest = parts.join(places.select("file", "split", "owner"), ["file", "split"])
    rest = rest.where("owner IS NOT NULL AND length(lead) > 0").select("file", F.col("owner"), "split", "lead", F.lit(None).cast("map<string,string>").alias("header"), F.lit(None).cast("binary").alias("block"), F.lit(0).cast("long").alias("size"))
    begun = parts.where("size > 0").select("file", F.col("split").alias("owner"), "split", F.lit(b"").alias("lead"), "header", "block", "size")
    cut = begun.unionByName(rest.join(begun.select("file", "owner"), ["file", "owner"], "left_semi").select(begun.columns))
    return pieces.mapInArrow(whole, schema).unionByName(cut.groupBy("file", "owner").applyInArrow(joined, schema))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files as derive() takes them; page_id is null, as files have none."""
    rows = read_warc(spark, path).where("record_type = 'response'")
    rows = rows.withColumn("s", F.decode("block", "UTF-8")).withColumn("cut", F.locate("\r\n\r\n", F.col("s")))
    return rows.select(F.lit(None).cast("long").alias("page_id"), "record_id", "target_uri", "date", F.expr("substr(s, 1, cut + 3)").alias("http_header"), F.expr("substr(s, cut + 4)").alias("payload"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))


def _sql_text() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    by = lambda x: quote(x).replace("\n", "' || chr(10) || '")
    x = "payload"
    for p, r in TEXT_RULES:
        x = f"regexp_replace({x}, {quote(p)}, {by(r)}, 'g')"
    return x, quote, by


def _op10_sql() -> str:
    x, quote, by = _sql_text()
    y = "list_reduce(list_prepend(raw, list_distinct(regexp_extract_all(raw, '&#[0-9]{1,7};'))), lambda t, e: replace(t, e, chr(CAST(regexp_replace(e, '[^0-9]', '', 'g') AS INT))))"
    for e, r in ENTITIES:
        y = f"replace({y}, {quote(e)}, {quote(r)})"
    for p, r in TIDY_RULES:
        y = f"regexp_replace({y}, {quote(p)}, {by(r)}, 'g')"
    uuid = lambda m: f"'<urn:uuid:' || substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-' || substr({m}, 13, 4) || '-' || substr({m}, 17, 4) || '-' || substr({m}, 21, 12) || '>'"
    end = "chr(13) || chr(10)"
    record = lambda kind, own, other, kind_of, block: f"""SELECT page_id, '{kind}' AS record_type, {own} AS record_id, record_id AS refers_to, {other} AS related_to, target_uri, '{DATE}' AS date,
  '{kind_of}' AS content_type, CAST(octet_length(encode({block})) AS BIGINT) AS content_length, 'sha256:' || sha256({block}) AS block_digest, source_digest AS source_payload_digest, {block} AS block FROM made"""  # noqa: E731
    return f"""
WITH source AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, md5('response/' || coalesce(CAST(page_id AS VARCHAR), '') || '/' || coalesce(url, '')) AS m FROM pages),
named AS (SELECT *, {uuid('m')} AS record_id, 'sha256:' || sha256(payload) AS source_digest, {x} AS raw,
  trim(regexp_replace(regexp_extract(payload, {quote(TITLE)}, 1), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS title, list_transform(regexp_extract_all(payload, {quote(LINK)}, 1), lambda x: regexp_replace(x, {quote(QUOTES)}, '', 'g')) AS every FROM source),
texts AS (SELECT *, {y} AS text, md5('conversion/' || record_id) AS c, md5('metadata/' || record_id) AS d,
  list_filter(every, lambda x, i: list_position(every, x) = i) AS links FROM named),
made AS (SELECT *, {uuid('c')} AS conversion_id, {uuid('d')} AS metadata_id, 'title: ' || title || {end} || 'http-header: HTTP/1.1 200 OK' || {end} || 'http-header: Content-Type: text/html; charset=utf-8' || {end}
  || 'http-header: Content-Length: ' || octet_length(encode(payload)) || {end} || 'source-payload-digest: ' || source_digest || {end} || 'text-digest: sha256:' || sha256(text) || {end}
  || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {end}), ''), '') AS fields FROM texts)
{record('conversion', 'conversion_id', 'metadata_id', 'text/plain', 'text')} UNION ALL {record('metadata', 'metadata_id', 'conversion_id', 'application/warc-fields', 'fields')}
"""


OP10_SQL = _op10_sql()
