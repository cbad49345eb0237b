"""Operator 13, main text of HTML pages.

A page is cut into blocks of text. Markup settles what it declares: scripts, styles, menus, headers, footers, sidebars, forms,
adverts, notices and readers' comments, by element, role or name, go; where a page declares its article, that is its
text, else what is left.

All pages then go through a suffix array of their host: the word streams of a host's distinct texts, with marks between blocks,
are concatenated, and what LONG and more words in a row have in common is found, for pages that declare an article and for
others apart. Of pages that declare none, blocks that runs in LEAST_PAGES and more pages cover by half go, unique runs stay; so
do blocks that are mostly links go. Of declared articles, blocks go that runs in MOST of the host's distinct articles, and in
LEAST_PAGES, cover by half, such as a notice under each story; an article that such runs cover by half as a whole is a copy
and stays as it stands, and what fewer articles share are quotes and stays too.
Pages of one content count once. Texts move once: hosts are dealt out whole, large hosts by page contents over many shards, which
exchange the counts of windows that may be repeated in all of them together. All but small hosts are laid end to end by size and cut
into shards there, as places of one host that a hash puts into one shard would be one text again.

Rows: null and empty html give an empty text; a null url, or one without a host, leaves markup and links alone to judge by;
repeated rows give a row each; a null page_id is kept; extra columns are ignored; an empty table gives no rows. Pages are taken
whole. White space is what Unicode says it is, the no-break space included; a line break inside a block is white space.
What stands in an unclosed comment or script goes, as in a browser. Memory follows the longest page and a shard's size.
"""

from __future__ import annotations

import hashlib
import json
import re
from html import unescape

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running_sums
from .common import cut_lineage, pack, shuffle_partitions, table, unpack
from .enhanced import prefixes, suffix_array

LONG = 8
LEAST_PAGES = 3
COVERED = 0.5
LINKED = 0.5
MOST = 0.5
SHARD_BYTES = 8 << 20
#: Shards of under so many bytes aren't made for the sake of more tasks.
SMALL_BYTES = 64 << 10
#: Hosts of under this share of a shard are dealt by a hash.
SMALL_HOST = 0.125
#: Bytes of text that are dealt at a time.
DEALT_BYTES = 16 << 20
#: Pages of one text in a row; texts of more pages are dealt out again.
COPIES = 256
#: What shards of one host tell each other.
TOLD = {"host": pa.string(), "settled": pa.bool_(), "bucket": pa.int32(), "shard": pa.int32(), "n_pages": pa.int64(), "names": pa.binary(), "counts": pa.binary()}
TOLD_SCHEMA = "host string, settled boolean, bucket int, shard int, n_pages long, names binary, counts binary"

OPEN, MAIN, SOFT, HARD = range(4)
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
GONE = set("nav aside footer menu search template head select button svg canvas object audio video".split())
#: Names (class, id, role) of what goes; a name is cut at - and _, and its first or last part counts.
HINTS = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alertdialog dialog nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar complementary widget widgets footer contentinfo header masthead share sharing social newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar search form".split())
#: And of what goes with articles inside.
TALK = set("comment comments disqus respond replies discussion related recommended recommendations".split())
BODY = set("article articlebody article-body article-content article-text post-content post-body entry-content main-content maincontent story-body content-body main".split())
NOT_HINTS = set("has no with without is".split())
SCOPES = set("caption html table td th object template".split())
#: A start tag of these ends an open one of the same kind, up to one of those.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

MARKUP = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
NAMES = re.compile(r"[\s\"'/](class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _state(name: str, attributes: str, above: int) -> int:
    """What an element makes of the text in it, in a place where text is `above`."""
    if above == HARD or name in GONE:
        return HARD
    names = [x.strip("\"'").lower().split() for _, x in NAMES.findall(attributes)] if "=" in attributes and name not in ("html", "body") else []
    names = [x for own in names for x in own]
    parts = {y for x in names for p in [re.split("[-_]+", x)] if p[0] not in NOT_HINTS for y in (x, p[0], p[-1])}
    if parts & TALK:
        return HARD
    if name in ("article", "main") or BODY.intersection(names) and not parts & HINTS:
        return MAIN
    if name == "form" or parts & HINTS or name == "header" and above != MAIN:
        return HARD if above == MAIN else SOFT
    return above


def blocks(html: str) -> list[tuple[int, str, int]]:
    """State (OPEN or MAIN), text and number of characters in links of each block of a page, in order."""
    out: list[tuple[int, str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    state, own, links, linked, pos, quoted = OPEN, OPEN, 0, 0, 0, True

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((own, text, linked))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal state
        while len(stack) > to:
            name, state = stack.pop()
            open_[name] -= 1

    while True:
        m = MARKUP.search(html, pos)
        if state < SOFT and (m.start() if m else len(html)) > pos:
            text = html[pos : m.start()] if m else html[pos:]
            text = unescape(text) if "&" in text else text
            if not pieces:
                own = state
            pieces.append(text)
            linked += len(text) * (links > 0)
        if not m:
            break
        name = m[2]
        if name is None:
            end = html.find("-->", m.start() + 2) if m[0] == "<!--" else html.find(">", m.end())
            if end < 0:
                break
            pos = end + (3 if m[0] == "<!--" else 1)
            continue
        name = name.lower()
        rest = REST.match(html, m.end()) if quoted else None
        if rest:
            pos = rest.end()
        else:  # a quote that doesn't end: from here on tags end at the first >
            quoted, end = False, html.find(">", m.end())
            if end < 0:
                break
            pos = end + 1
        if m[1]:
            if name in BLOCKS:
                flush()
            if name == "a":
                links = 0
            if open_.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
                    if stack[k][0] in SCOPES or name not in BLOCKS and stack[k][0] in BLOCKS:
                        break
            continue
        if name in RAW:
            end = END_OF[name].search(html, pos)
            if not end:
                break
            pos = html.find(">", end.end()) + 1 or len(html)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if open_.get("p") and name not in ("body", "html"):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in SCOPES)
                if stack[k][0] == "p":
                    pop(k)
            if name == "body":
                if open_.get("head"):
                    pop(next(k for k in range(len(stack)) if stack[k][0] == "head"))
            elif name in SIBLINGS:
                same, stop = SIBLINGS[name]
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in same or stack[k][0] in stop), -1)
                if k >= 0 and stack[k][0] in same:
                    pop(k)
        if name == "a":
            links = 1
        if name in VOID:
            continue
        now = _state(name, html[m.end() : pos], state)
        if name in BLOCKS or now != state:  # inline elements count only where they change what becomes of their text
            stack.append((name, state))
            open_[name] = open_.get(name, 0) + 1
            state = now
    flush()
    return out


def cut_up(html: str | None, declared: bool = True) -> tuple[str, bool]:
    """What the suffix array of a page's host judges, and whether the page declares it as its article; where not, it is all open
    blocks that aren't mostly links. Blocks are parted by two line feeds, which no block has inside."""
    own = blocks(html or "")
    main = [text for state, text, _ in own if state == MAIN] if declared else []
    if main:
        return "\n\n".join(main), True
    return "\n\n".join(text for _, text, linked in own if linked <= LINKED * len(text)), False


def _blob(entries: list) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(json.dumps(entries, ensure_ascii=False).encode())


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def dealt(pages: DataFrame, declared: bool, shard_bytes: int) -> DataFrame:
    """Rows (shard, parts, pages): what a stretch of input has for a shard, as entries (host, settled, text, ids and urls of its
    pages). Pages of one host and text meet in one shard. parts: over how many places their host is dealt; 0 for pages that
    have no host or no text. Hosts take a stretch of a line each, as long as their html, large ones first, and the line is cut into n
    shards of one length, so that a shard gets twice that at most; small hosts are hashed to what is left of the line."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", F.coalesce(host, F.lit("")))
    sizes = cut_lineage(rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size")))
    own = F.col("host") != ""
    size, line = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", F.when(own, F.col("size")))]).first()
    n = max(1, -(-size // shard_bytes), min(shuffle_partitions(spark), -(-size // SMALL_BYTES)))
    part = max(1, -(-size // n))
    laid = running_sums(sizes.where(own & (F.col("size") > part * SMALL_HOST)), [F.col("size").desc(), F.col("host")], {"to": "size"})
    laid = cut_lineage(laid.select("host", "size", (F.col("to") - F.col("size")).alias("at"), F.ceil(F.col("size") / part).cast("long").alias("parts")))
    rest = min(n - 1, laid.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * n // max(1, line))  # the first shard for small hosts

    def run(batches):
        task, seen, held, found = TaskContext.get().partitionId(), 0, 0, {}

        def flush():
            shards: dict[tuple[int, int], list] = {}
            for (shard, parts, *entry), own in found.items():
                shards.setdefault((shard, parts), []).append([*entry, own])
            columns = [pa.array([k for k, _ in shards], pa.int32()), pa.array([k for _, k in shards], pa.int32()), pa.array([_blob(x) for x in shards.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "parts", "pages"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    text, settled = cut_up(row["html"], declared)
                    if row["host"] and text:
                        parts = row["parts"] or 1
                        if row["parts"]:
                            shard = (row["at"] + _digest(text) % parts * row["size"] // parts) * n // line
                        else:
                            shard = rest + _digest(row["host"]) % (n - rest)
                        key = (shard, parts, row["host"], settled, text)
                    else:
                        key = ((task * 7919 + seen) % n, 0, "", settled, text)
                    own = found.setdefault(key, [])
                    held += 64 + (0 if own else len(text))
                    own.append([row["page_id"], row["url"]])
                    seen += 1
                if held > DEALT_BYTES:
                    yield flush()
                    held, found = 0, {}
        if found:
            yield flush()

    return rows.join(F.broadcast(laid), "host", "left").select("page_id", "url", "html", "host", "size", "at", "parts").mapInArrow(run, "shard int, parts int, pages binary")


def opened(rows: pa.Table, least: int, most: int = 1 << 31) -> dict[tuple[str, bool, int], dict[str, list]]:
    """The collections (host, settled, parts) of a shard whose hosts are dealt over least to most places: pages of each text."""
    out: dict[tuple[str, bool, int], dict[str, list]] = {}
    for parts, blob in zip(rows.column("parts").to_pylist(), rows.column("pages")):
        if least <= parts <= most:
            for host, settled, text, own in json.loads(zstandard.ZstdDecompressor().decompress(blob.as_py())):
                out.setdefault((host, settled, parts), {}).setdefault(text, []).extend(own)
    return out


def stream(texts: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The pages' words as numbers, a 0 around each block and a negative number, never twice the same, behind each page; the page
    of each item; the blocks of each page."""
    items: list[int] = []
    sizes, n_blocks = [], []
    for k, text in enumerate(texts):
        before = len(items)
        own = text.split("\n\n") if text else []
        items.append(0)
        for block in own:
            items += [number.setdefault(w, len(number) + 1) for w in block.split(" ")]
            items.append(0)
        items.append(-k - 1)
        sizes.append(len(items) - before)
        n_blocks.append(len(own))
    return np.array(items, np.int64), np.repeat(np.arange(len(texts)), sizes), n_blocks


def window_groups(x: np.ndarray, page: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose window of `long` items lies inside a page, in the order of the suffix array; the group of equal windows
    of each; the number of distinct pages of each group."""
    order, levels = suffix_array(x, 1 << (long - 1).bit_length())
    group = np.cumsum(prefixes(order, levels) < long) - 1
    inside = np.zeros(len(x), bool)
    if len(x) > long:
        inside[:-long] = page[:-long] == page[long:]  # a page ends in an item of its own, outside of its windows
    own = inside[order]
    place, group = order[own], group[own]
    if not len(place):
        return place, group, np.zeros(0, np.int64)
    new = np.append(True, group[1:] != group[:-1])
    group = np.cumsum(new) - 1
    own = page[place]
    new[1:] |= own[1:] != own[:-1]  # equal windows stand in the order of their places, so a page's are neighbours
    return place, group, np.bincount(group[new])


def _first(place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The first place of each group."""
    return place[np.append(True, group[1:] != group[:-1])] if len(place) else place


def _names(x: np.ndarray, first: np.ndarray, words: list[str], long: int) -> np.ndarray:
    """A name of the window at each place, the same in all shards: a digest of its words' digests."""
    if not len(first):
        return np.zeros(0, np.int64)
    digests = np.array([0] + [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words], np.uint64)
    names = np.zeros(len(first), np.uint64)
    for k in range(long):
        names = names * np.uint64(0x9E3779B97F4A7C15) + digests[x[first + k]]
        names ^= names >> np.uint64(29)
    return names.view(np.int64)


def needed(n_pages: int, settled: bool, least_pages: int) -> int:
    """In so many of a collection's distinct pages a run counts as repeated."""
    return max(least_pages, -int(-n_pages * MOST // 1)) if settled else least_pages


def unique_text(texts: list[str], settled: bool, known: np.ndarray | None, long: int, least_pages: int) -> list[str]:
    """The texts of a collection without the blocks that repeated runs cover by half; an article that they cover by half as a
    whole is a copy and stays. known: names of the windows that all shards together repeat, None if this shard has all pages."""
    if known is not None and not len(known):
        return texts
    number: dict[str, int] = {}
    x, page, n_blocks = stream(texts, number)
    place, group, pages = window_groups(x, page, long)
    if known is None:
        repeated = pages >= needed(len(texts), settled, least_pages)
    else:
        repeated = np.isin(_names(x, _first(place, group), list(number), long), known)
    at = place[repeated[group]]
    if not len(at):
        return texts
    covered = np.cumsum(np.bincount(at, minlength=len(x) + long) - np.bincount(at + long, minlength=len(x) + long))[: len(x)] > 0
    word = x > 0
    block = np.cumsum(x == 0) - page - 1  # of the collection; each page has a 0 more than blocks
    total = int(sum(n_blocks))
    share = np.bincount(block[word], covered[word], total) / np.maximum(1, np.bincount(block[word], minlength=total))
    whole = np.bincount(page[word], covered[word], len(texts)) / np.maximum(1, np.bincount(page[word], minlength=len(texts)))
    out, k = [], 0
    for text, n, w in zip(texts, n_blocks, whole):
        copy = settled and w >= COVERED
        out.append(text if copy else "\n\n".join(b for b, s in zip(text.split("\n\n"), share[k : k + n]) if s < COVERED))
        k += n
    return out


def _told(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(TOLD.values())], names=list(TOLD))


def _windows(long: int):
    """Of hosts dealt over several shards: all distinct windows of pages that declare no article, in buckets; of articles those
    that enough of the shard's own have. A window that half of all articles have is among these in one shard at least."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = []
        for (host, settled, parts), own in opened(rows, 2).items():
            number: dict[str, int] = {}
            x, page, _ = stream(list(own), number)
            place, group, pages = window_groups(x, page, long)
            at = np.flatnonzero(pages >= needed(len(own), True, 1)) if settled else np.arange(len(pages))
            names, pages = _names(x, _first(place, group)[at], list(number), long), pages[at]
            if settled:
                told = [(0, np.arange(len(at)))]
            else:
                bucket = names.view(np.uint64) % np.uint64(parts)
                order = np.argsort(bucket, kind="stable")
                told = [(int(bucket[at[0]]), at) for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(at)]
            out += [(host, settled, b, key[0].as_py(), len(own), pack(names[at]), pack(pages[at])) for b, at in told]
        return _told(out)

    return run


def _merged(final: bool, least_pages: int):
    """What shards told of one host (and bucket): to each shard of it go names, those to count or those that are repeated."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        host, settled, bucket = (k.as_py() for k in key)
        told = rows.to_pylist()
        if final and not settled:  # these were counted in full when first merged
            return rows.select(list(TOLD))
        names = np.concatenate([unpack(r["names"], np.int64) for r in told])
        counts = np.concatenate([unpack(r["counts"], np.int64) for r in told])
        names, at = np.unique(names, return_inverse=True)
        n = np.bincount(at, counts, len(names))
        n_pages = sum(r["n_pages"] for r in told)
        if final or not settled:
            names = names[n >= needed(n_pages, settled, least_pages)]
        return _told([(host, settled, bucket, r["shard"], r["n_pages"], pack(names if settled else names[np.isin(names, unpack(r["names"], np.int64))]), pack(np.zeros(0, np.int64))) for r in told])

    return run


def _counted(long: int):
    """In how many of its articles a shard has the windows asked for; names of other collections are handed on."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.to_pylist()
        out = [tuple(r.values()) for r in asked if not r["settled"]]
        articles = [r for r in asked if r["settled"]]
        own = {key[:2]: list(x) for key, x in opened(rows, 2).items()} if any(len(unpack(r["names"], np.int64)) for r in articles) else {}
        for r in articles:
            names = unpack(r["names"], np.int64)
            counts = np.zeros(len(names), np.int64)
            if len(names):
                number: dict[str, int] = {}
                x, page, _ = stream(own[r["host"], True], number)
                place = np.flatnonzero(page[: max(0, len(x) - long)] == page[long:])
                here = _names(x, place, list(number), long)
                at = np.minimum(np.searchsorted(names, here), len(names) - 1)
                hit = names[at] == here
                pairs = np.unique(at[hit] * (int(page[-1]) + 1) + page[place[hit]])
                counts = np.bincount(pairs // (int(page[-1]) + 1), minlength=len(names))
            out.append((r["host"], True, 0, r["shard"], r["n_pages"], r["names"], pack(counts.astype(np.int64))))
        return _told(out)

    return run


def _texts(hot: bool, long: int, least_pages: int):
    """Texts of a shard's pages: ids, urls, text for up to COPIES pages of one text. hot: only of texts of more pages than that,
    which are dealt out from here; else only of the others."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        known: dict[tuple[str, bool], list] = {}
        for r in told.to_pylist():
            known.setdefault((r["host"], r["settled"]), []).append(unpack(r["names"], np.int64))
        out = []
        for (host, settled, parts), own in opened(rows, int(hot)).items():
            if hot and max(map(len, own.values())) <= COPIES:
                continue
            texts = list(own)
            if parts:
                names = np.concatenate([*known.get((host, settled), []), np.zeros(0, np.int64)]) if parts > 1 else None
                texts = unique_text(texts, settled, names, long, least_pages)
            for text, pages in zip(texts, own.values()):
                if not parts or hot == (len(pages) > COPIES):
                    for k in range(0, len(pages), COPIES):
                        ids, urls = zip(*pages[k : k + COPIES])
                        out.append((ids, urls, text))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.string()), pa.string()))], names=["ids", "urls", "text"])

    return run


def main_text(pages: DataFrame, declared: bool = True, long: int = LONG, least_pages: int = LEAST_PAGES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, url, text of every page. declared=False: articles that pages declare are judged like other text."""
    shards = dealt(pages, declared, shard_bytes)
    by_shard = lambda: shards.groupBy("shard")
    by_host = ("host", "settled", "bucket")
    told = by_shard().applyInArrow(_windows(long), TOLD_SCHEMA).groupBy(*by_host).applyInArrow(_merged(False, least_pages), TOLD_SCHEMA)
    counted = by_shard().cogroup(told.groupBy("shard")).applyInArrow(_counted(long), TOLD_SCHEMA)
    known = counted.groupBy(*by_host).applyInArrow(_merged(True, least_pages), TOLD_SCHEMA)

    def texts(hot: bool) -> DataFrame:
        return by_shard().cogroup(known.groupBy("shard")).applyInArrow(_texts(hot, long, least_pages), "ids array<long>, urls array<string>, text string")

    found = texts(False).unionByName(texts(True).repartition(shuffle_partitions(pages.sparkSession)))
    return found.select(F.explode(F.arrays_zip("ids", "urls")).alias("page"), "text").select(F.col("page.ids").alias("page_id"), F.col("page.urls").alias("url"), "text")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
