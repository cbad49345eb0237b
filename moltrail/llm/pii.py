"""Operator 4, personal data.

Regular expressions propose spans; checks confirm them (parts of an IP address, Luhn for cards,
mod 97 for IBANs, digits of phone numbers); words of the same kind within NEAR characters before or after a span,
up to the next span of its kind, raise its score. The base kinds
(email, ip, card, phone) always stay once confirmed. IBANs and social security numbers are added:
an IBAN needs its checksum, a social security number has no checksum and needs a context word.

Positions are code points, end exclusive: a text's matches and the gaps between them, both in order,
give each start as a running sum. The sums are made in two levels of SUMS each, so that a text with
very many matches stays cheap. The patterns use possessive repeats and look-behinds (with \\G, the end
of the last match), which match the same as the plain ones but never try a run of characters twice.

Rows: null text is empty and has no spans; every row gives a row; a null doc_id stays null; extra
columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SUMS, NEAR = 64, 40
ACCEPT = 0.8
LOCAL = "A-Za-z0-9._%+-"
#: kind: pattern, a text that each match holds (to skip other documents), score without and with context, context words.
KINDS = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 1.0, "e-?mail|contact|@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.8, 0.95, "ip|host|server|addr"),
    "card": (r"[0-9](?:[ -]?+[0-9])++", None, 0.8, 1.0, "card|visa|master|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.8, 1.0, "phone|tel|call|fax|mobile|handy"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", None, 0.9, 1.0, "iban|bank|konto|compte|cuenta"),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.3, 0.9, "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
_DIGITS = "regexp_replace(m.text, '[^0-9]', '')"
_PART = "coalesce(try_cast(trim(LEADING '0' FROM p) AS bigint), if(trim(LEADING '0' FROM p) = '', 0, 256)) <= 255"
_MOD97 = "aggregate(split({}, ''), 0, (a, x) -> if(x = '', a, if(x <= '9', (a * 10 + ascii(x) - 48) % 97, (a * 100 + ascii(x) - 55) % 97)))"
CHECKS = {
    "email": "true",
    "ip": f"forall(split(m.text, '[.]'), p -> {_PART})",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN luhn_check({_DIGITS}) ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": "length(replace(m.text, ' ', '')) BETWEEN 15 AND 34 AND " + _MOD97.format("concat(substr(replace(m.text, ' ', ''), 5), substr(m.text, 1, 4))") + " = 1",
    "ssn": "true",
}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0L, (a, x) -> a + x)"


def find(docs: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), accept: float = ACCEPT) -> DataFrame:
    """docs and a column spans (in place of an own one): array of struct(start, rank, kind, end, score), by start, then kind
    as listed."""
    docs = docs.drop("spans")
    own = "_"
    while any(c.startswith(own) for c in docs.columns):  # names that docs doesn't have
        own += "_"
    m, g, t, b = (lambda kind, x=x: f"{own}{x}_{kind}" for x in "mgsb")
    rows = docs.withColumn(f"{own}t", F.coalesce(F.col("text"), F.lit("")))
    for kind in kinds:
        pattern, holds, plain, sure, context = KINDS[kind]
        p, has = _literal(pattern), f"contains({own}t, {_literal(holds)})" if holds else f"{own}t RLIKE '[0-9]'"
        rows = rows.withColumns({m(kind): F.expr(f"if({has}, regexp_extract_all({own}t, {p}, 0), array())"), g(kind): F.expr(f"if({has}, split({own}t, {p}, -1), array())")})
    rows = rows.drop(f"{own}t")

    def steps(kind):
        before = f"zip_with({m(kind)}, slice({g(kind)}, 1, size({m(kind)})), (text, gap) -> named_struct('text', text, 'near', right(gap, {NEAR}), 'skip', length(gap), 'step', length(gap) + length(text)))"
        return F.expr(f"zip_with({before}, slice({g(kind)}, 2, size({m(kind)})), (x, gap) -> named_struct('text', x.text, 'near', concat(x.near, ' ', left(gap, {NEAR})), 'skip', x.skip, 'step', x.step))").alias(t(kind))

    rows = rows.select(*docs.columns, *[steps(kind) for kind in kinds])
    totals = {kind: F.expr(f"transform(sequence(0, size({t(kind)}) div {SUMS}), b -> {_sum(f'slice({t(kind)}.step, b * {SUMS} + 1, {SUMS})')})") for kind in kinds}
    rows = rows.select("*", *[c.alias(b(kind)) for kind, c in totals.items()])
    found = []
    for rank, kind in enumerate(kinds):
        _, _, plain, sure, context = KINDS[kind]
        start = f"{_sum(f'slice({b(kind)}, 1, i div {SUMS})')} + {_sum(f'slice({t(kind)}.step, (i div {SUMS}) * {SUMS} + 1, i % {SUMS})')} + m.skip"
        score = f"if(m.near RLIKE '(?i)(?:{context})', {sure}D, {plain}D)"
        kept = f"transform({t(kind)}, (m, i) -> struct(m.text AS text, m.skip AS skip, m.near AS near, i AS i, {CHECKS[kind]} AS good))"
        kept = f"filter({kept}, m -> m.good" + ("" if kind in BASE else f" AND {score} >= {accept}") + ")"
        found.append(f"transform({kept}, m -> named_struct('start', {start.replace('i div', 'm.i div').replace('i %', 'm.i %')}, 'rank', {rank}, 'kind', '{kind}', 'end', {start.replace('i div', 'm.i div').replace('i %', 'm.i %')} + length(m.text), 'score', {score}))")
    return rows.select(*docs.columns, F.expr(f"array_sort(concat({', '.join(found)}))").alias("spans"))


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def redact(docs: DataFrame, **parameters) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; of overlapping spans the first, then the longest, counts.
    Null texts stay null; columns and rows stay as they are."""
    kept = "_spans"  # a name that docs doesn't have, for its own column spans
    while kept in docs.columns:
        kept += "_"
    rows = find(docs.withColumnRenamed("spans", kept), **parameters)
    step = """aggregate(array_sort(transform(spans, s -> struct(s.start, -s.end AS back, s.kind))), struct(0L AS at, array('') AS parts),
        (a, s) -> if(s.start < a.at, a, struct(-s.back AS at, concat(a.parts, array(substr(text, int(a.at + 1), int(s.start - a.at)), concat('[', s.kind, ']'))) AS parts)),
        a -> concat(array_join(a.parts, ''), substr(text, int(a.at + 1))))"""
    rows = rows.withColumn("text", F.expr(f"if(size(spans) = 0, text, {step})")).drop("spans")
    return rows.withColumnRenamed(kept, "spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    base = joined("filter(spans, s -> s.rank < 4)")
    return rows.select("doc_id", *counts, F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"), F.expr("array_join(transform(spans, s -> cast(s.score AS string)), ',')").alias("scores"))


def _sql_kind(rank: int, kind: str) -> str:
    pattern = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
    }.get(kind, KINDS[kind][0])
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST({digits}[-k] AS INT) WHEN {digits}[-k] >= '5' THEN 2 * CAST({digits}[-k] AS INT) - 9 ELSE 2 * CAST({digits}[-k] AS INT) END)) % 10 = 0"
    letters = "replace(x.m, ' ', '')[5:] || x.m[1:4]"
    rest = f"list_reduce(list_prepend(0, list_transform(string_split({letters}, ''), lambda c: CASE WHEN c <= '9' THEN CAST(c AS INT) ELSE 100 + ascii(c) - 55 END)), lambda a, c: CASE WHEN c < 100 THEN (a * 10 + c) % 97 ELSE (a * 100 + c - 100) % 97 END) = 1"
    check = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) > 3 THEN true ELSE coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255 END)) = 0",
        "card": f"CASE WHEN len({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": f"len(replace(x.m, ' ', '')) BETWEEN 15 AND 34 AND {rest}",
        "ssn": "true",
    }[kind]
    _, _, plain, sure, context = KINDS[kind]
    score = f"CASE WHEN regexp_matches(right(x.g, {NEAR}) || ' ' || left(x.h, {NEAR}), '(?i)(?:{context})') THEN {sure}::DOUBLE ELSE {plain}::DOUBLE END"
    check += "" if kind in BASE else f" AND {score} >= {ACCEPT}"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, x.s AS start, x.s + len(x.m) AS "end", {score} AS score FROM (SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1),
  lambda i: {{'m': ms[i], 'g': gs[i], 'h': gs[i+1], 's': CAST(list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: len(m))), 0) AS BIGINT)}})) AS x
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM documents WHERE text IS NOT NULL)) WHERE {check}"""


OP4_SQL = f"""
WITH found AS ({' UNION ALL '.join(_sql_kind(r, k) for r, k in enumerate(KINDS))}),
lists AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
  coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (rank < 4), '') AS base, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, rank) AS scores FROM found GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id
"""
