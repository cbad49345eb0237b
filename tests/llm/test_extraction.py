"""Operator 13 against plain-Python versions: markup on handwritten pages, hosts' repeats by brute force."""

import random
import re
from collections import Counter, defaultdict
from html import escape, unescape

import pyarrow as pa
import pytest

from moltrail.llm import extraction
from moltrail.llm.extraction import blocks, cut_up

LONG, PAGES = extraction.LONG, extraction.LEAST_PAGES


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("<", "<"), ("<a", ""), ("<p>x<!-- y", "x"), ("1 &lt; 2 &amp; 3 &#65;&#x42; &copy &am", "1 < 2 & 3 AB \xa9 &am"),
        ('<p title="a>b">c</p>d', "c\n\nd"), ('<p title="no end>c</p>d', "c\n\nd"), ("<p>a<br>b \n\t c&nbsp;d<p>e<b>f</b>g", "a b c d\n\nefg"),
        ("<SCRIPT>x</p></ScRiPt >y<style>z", "y"), ("<nav>n</nav><article>m</article>z", "m"), ("<nav>n<article>m</article></nav>z", "z"),
        ("<body class='has-sidebar'><div id=menu>Home</div><div><p>One<ul><li>a<li>b</ul></div><div class='cookie-notice'>We</div><footer>f</footer>", "One\n\na\n\nb"),
        ("<header>top</header><main><article><header><h1>T</h1></header><p>a<aside>s</aside><form>q</form><div class='ad-slot'>buy</div><table><tr><td>1<td>2</table><footer>f</footer></article><div class=related><article>r</article></div></main>", "T\n\na\n\n1\n\n2"),
        ("<article><p>main</p></article><section id=comments><article class=comment>talk</article></section>", "main"),
        ("<form id=page><article>inside a form</article></form>", "inside a form"), ("<p class=notice>n<p>kept", "kept"), ("<div><a href=x>Only</a> <a>links</a> x</div><p>text <a>l</a>", "text l"),
        ("<div role=main><p>said &amp;amp; done</div><div>else</div>", "said &amp; done"), ("<p>a</p></div></b>b<textarea>t</textarea><select><option>o</select><button>k</button>", "a\n\nb"),
    ],
)
def test_blocks(html, want):
    text, settled = cut_up(html)
    assert text == want
    assert settled == any(state == extraction.MAIN for state, _, _ in blocks(html or ""))


def test_time_of_odd_pages():
    for page in ("<div><b>" * 50_000, '<p "' * 50_000, "<div>" * 50_000 + "<p>x</span>" * 50_000 + "<li>" * 50_000, "<!--" * 50_000, "&" * 200_000):
        blocks(page)


def brute_unique(pages):
    """Of (host, text) distinct pages the texts without blocks that windows of LEAST_PAGES pages cover by half."""
    out = {}
    hosts = defaultdict(list)
    for host, text in pages:
        hosts[host].append(text)
    for host, texts in hosts.items():
        streams, seen = [], defaultdict(set)
        for k, text in enumerate(texts):
            s = [("", -1)]
            for b, block in enumerate(text.split("\n\n")):
                s += [(w, b) for w in block.split(" ")] + [("", -1)]
            streams.append(s)
            for i in range(len(s) - LONG + 1):
                seen[tuple(w for w, _ in s[i : i + LONG])].add(k)
        for s, text in zip(streams, texts):
            hit = set()
            for i in range(len(s) - LONG + 1):
                if len(seen[tuple(w for w, _ in s[i : i + LONG])]) >= PAGES:
                    hit |= set(range(i, i + LONG))
            sums = defaultdict(lambda: [0, 0])
            for i, (w, b) in enumerate(s):
                sums[b][0] += i in hit
                sums[b][1] += 1
            out[host, text] = "\n\n".join(block for b, block in enumerate(text.split("\n\n")) if sums[b][0] < 0.5 * sums[b][1])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    out = []
    for host, n in (("big.example", 60), ("one.example", 1), ("two.example", 2), ("mid.example", 9), ("", 5)):
        menu, notice = [say(1) for _ in range(6)], say(25)
        for k in range(n):
            story = [say(rng.randint(1, 40)) for _ in range(3)]
            body = "".join(f"<div>{x}</div>" for x in menu) + f"<p>{story[0]}</p><div>{notice if k % 4 else notice[:30]}</div>" + "".join(f"<p>{x}</p>" for x in story[1:])
            url = f"https://{host}/p/{k}" if host else [None, "no host", "", "mailto:x", "http://"][k]
            out.append((len(out), url, f"<html><body>{body}</body></html>"))
    out += [(900 + k, "HTTP://Big.example:80/copy", out[0][2]) for k in range(4)]  # one content under many addresses
    out += [(None, "https://big.example/", None), (None, None, None), (7, "https://big.example/x", ""), (8, "https://big.example/y", "<article><h1>A &amp; b</h1><p>" + escape(say(30)) + "</article>")]
    return out + [out[-1]]


def host_of(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def expected(rows):
    cut = [(i, url, host_of(url), *cut_up(html)) for i, url, html in rows]
    found = brute_unique({(host, text) for _, _, host, text, settled in cut if not settled and host and text})
    return Counter((i, url, t := text if settled else found.get((host, text), text), len(t)) for i, url, host, text, settled in cut)


@pytest.mark.parametrize("shard_bytes", [1 << 24, 1500])
def test_hosts(spark, rows, shard_bytes):
    pages = spark.createDataFrame([(*r, "h", "d", 1) for r in rows], "page_id long, url string, html string, host string, digest string, shard int")
    got = Counter((r["page_id"], r["url"], r["text"], len(r["text"])) for r in extraction.main_text(pages, shard_bytes=shard_bytes).collect())
    want = expected(rows)
    assert got == want
    judged = [cut_up(html)[0] for _, _, html in rows]
    assert sum(len(t) for t in judged) > 1.3 * sum(len(r[2]) * n for r, n in want.items())  # something is repeated


def test_query(spark, rows, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    df = extraction.op13_html_extraction(spark, folder)
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(tuple(r) for r in df.collect()) == expected(rows)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/none/pages.parquet")
    assert extraction.op13_html_extraction(spark, f"{folder}/none").collect() == []


def test_articles_of_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in extraction.op13_html_extraction(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def brute_articles(articles):
    """Of (host, text) distinct articles the texts without blocks that windows of half of the host's articles cover by half;
    articles that these cover by half as a whole stay."""
    out = {}
    hosts = defaultdict(list)
    for host, text in articles:
        hosts[host].append([block.split(" ") for block in text.split("\n\n")])
    for host, texts in hosts.items():
        streams = [[x for block in text for x in ("|", *block)] + ["|"] for text in texts]
        seen = Counter(w for s in streams for w in {tuple(s[i : i + LONG]) for i in range(len(s) - LONG + 1)})
        for text, s in zip(texts, streams):
            hit = {j for i in range(len(s) - LONG + 1) if (n := seen[tuple(s[i : i + LONG])]) >= PAGES and 2 * n >= len(texts) for j in range(i, i + LONG)}
            at, kept, n_hit = 0, [], 0
            for block in text:
                own = sum(at + 1 + k in hit for k in range(len(block)))
                n_hit += own
                at += 1 + len(block)
                if 2 * own < len(block):
                    kept.append(" ".join(block))
            whole = "\n\n".join(" ".join(block) for block in text)
            out[host, whole] = whole if 2 * n_hit >= sum(map(len, text)) else "\n\n".join(kept)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 24, 4000])
def test_articles_go_through_the_hosts_suffix_array(spark, shard_bytes):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") * rng.randint(0, 3) for _ in range(n))
    rows, notice, quote, rare = [], say(14), say(20), say(16)
    for host, n in (("big.example", 60), ("mid.example", 9), ("few.example", 2)):
        for k in range(n):
            own = [say(rng.randint(20, 60)) for _ in range(2)] + [notice] * (k % 3 > 0) + [quote] * (k % 5 == 0) + [rare] * (k % 2)
            rows.append((len(rows), f"https://{host}/{k}", "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in own) + "</article>"))
    story = say(80)
    rows += [(len(rows) + k, f"http://copies.example/{k}", f"<article><p>{story}<p>{say(10)}</article>") for k in range(8)]  # near copies, whole
    cut = {i: (host_of(url), cut_up(html)[0]) for i, url, html in rows}
    want = brute_articles(set(cut.values()))
    got = {r["page_id"]: r["text"] for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_bytes=shard_bytes).collect()}
    assert got == {i: want[key] for i, key in cut.items()}
    for i, (host, text) in cut.items():
        if host in ("big.example", "mid.example"):
            assert notice not in got[i] and (quote in got[i]) == (quote in text)
        else:
            assert got[i] == text


@pytest.mark.parametrize("shard_bytes", [1 << 24, 4000])
def test_many_copies(spark, shard_bytes):
    page = lambda x: f"<article><p>{x}</p></article>"
    rows = [(k, f"http://a.example/{k}", page("same words again")) for k in range(900)] + [(1000 + k, f"http://a.example/{k}", page(f"own words {k}")) for k in range(50)] + [(2000, None, page("alone"))] * 600
    got = Counter(tuple(r) for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_bytes=shard_bytes).collect())
    assert got == Counter((i, url, cut_up(html)[0]) for i, url, html in rows)


def test_shards_of_large_hosts_are_of_one_size(spark):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    # names of 9, 12 and 20 letters: by CRC-32 of place and name their first ten places met in a few shards
    hosts = [("a.example", 200), ("four.example", 300), ("collides.example.com", 900), ("mid.example", 40)] + [(f"{k}.small.example", 1) for k in range(60)]
    rows = [(k, f"https://{host}/{k}", f"<article><p>{say(1000)}</article>") for k, host in enumerate(h for h, n in hosts for _ in range(n))]
    rows += [(None, None, f"<p>{say(1000)}") for _ in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    loads, places, n_rows = Counter(), defaultdict(set), 0
    for r in extraction.dealt(pages, True, 50_000).collect():
        one = pa.table({"parts": pa.array([r["parts"]], pa.int32()), "pages": pa.array([bytes(r["pages"])], pa.binary())})
        for (host, _, parts), texts in extraction.opened(one, 0).items():
            loads[r["shard"]] += sum(map(len, texts))
            places[host, parts].add(r["shard"])
            n_rows += sum(map(len, texts.values()))
    assert n_rows == len(rows)
    large = {key: len(x) for key, x in places.items() if key[1] > 1}
    assert set(large) == {("a.example", 5), ("four.example", 7), ("collides.example.com", 19)}
    assert all(n >= parts - 1 for (_, parts), n in large.items())  # places are shorter than shards, so that two may begin in one
    assert max(loads.values()) < 2 * sum(loads.values()) / len(loads)
