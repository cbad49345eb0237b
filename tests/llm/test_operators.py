"""Each operator against a brute-force version, on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from moltrail.llm import decontaminate, lm, mixing, pii, quality, rules, simhash, suffixes, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def got(df):
    return [tuple(r) for r in df.collect()]


# --- 1


def brute_repeats(rows, length=50):
    first, out = {}, Counter()
    docs = [(math.inf if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in docs:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, math.inf), i)
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[None if i == math.inf else i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot,block", [(1000, 1 << 22), (2, 3000)])
def test_repeats(edge, edge_rows, hot, block):
    assert Counter(got(suffixes.repeats_removed(edge, hot=hot, block=block))) == brute_repeats(edge_rows)


def test_repeats_of_repetitive_texts(spark):
    """Long runs, repeated lines and tables of dashes, in one document and in several, also where places are many and documents few."""
    rng = random.Random(6)
    line = "This line of a licence stands here again and again, w/o end.\n"
    texts = ["a" * 9000, "-" * 700 + "x" + "-" * 900, line * 40, "".join(rng.choice(["-----+", "----+-"]) for _ in range(400)), "ab" * 2000 + "c" + "ab" * 500]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10, "start " + line * 5 + "end"), (11, "-" * 60), (12, "a" * 200 + "b" * 60), (13, texts[3][90:700]), (14, "ba" * 40), (14, line * 3), (None, line * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1000, 20):
        assert Counter(got(suffixes.repeats_removed(docs, hot=hot))) == brute_repeats(rows)


def test_windows_go_on_once():
    """2 MB of one byte, and of one line, in two documents: the shard sends each distinct window once."""
    from moltrail.llm.shards import as_table

    for text in (b"-" * (2 << 20), b"A line of sixty bytes or so that stands in a text repeatedly\n" * 30_000):
        docs = as_table([(0, suffixes.pack(np.array([1, 2])), suffixes.pack(np.array([len(text), 60])), suffixes.pack(np.frombuffer(text + text[:60], np.uint8)))], ["shard", "ids", "sizes", "text"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()])
        key = (pa.scalar(0),)
        entries = suffixes._entries(1, 1000)(key, docs)
        answers = suffixes._answers(1000)(key, entries.append_column("x", [[0] * entries.num_rows]))
        out = suffixes._pieces(1)(key, docs, answers)
        assert sum(len(suffixes.unpack(r["text"], np.uint8)) for r in out.to_pylist() if r["kind"] == 0) < 20_000
        assert sum(len(r["first"]) + len(r["more"]) for r in out.to_pylist()) < 100_000


def test_repeats_empty(empty):
    assert got(suffixes.repeats_removed(empty)) == []


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for n in (1, 7, 300, 3000):
        t = bytes(rng.choice(b"ab") for _ in range(n)) + b"abc" * 50
        text = np.frombuffer(t, np.uint8)
        order = suffixes.suffix_array(text)
        assert [t[k : k + 50] for k in order] == sorted(t[k : k + 50] for k in range(len(t)))
        prefix = suffixes.common_prefixes(text, order, lanes=5)
        for s in range(1, len(t)):
            a, b = t[order[s - 1] :], t[order[s] :]
            k = 0
            while k < min(len(a), len(b), 50) and a[k] == b[k]:
                k += 1
            assert prefix[s] == k


# --- 2


def brute_quality(docs, labels):
    """The model in plain Python: dictionaries, sizes with the other half's, a curve by gradient steps."""

    def sizes(d, t):
        kind = zstandard.DICT_TYPE_AUTO if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(t))

    def features(good, bad, t):
        a, b = sizes(good, t), sizes(bad, t)
        return [1.0, math.tanh(10 * (b - a) / len(t)), math.log(min(1, min(a, b) / len(t)))]

    def dictionary(texts):
        return quality.dictionary([t[k : k + 2000] for t in texts for k in range(0, len(t), 2000)])

    known = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 5}
    side = [[t.encode() for i, t in sorted(docs) if known.get(i) == q] for q in (0, 1)]
    x, y = [], []
    for half in (0, 1):
        good, bad = dictionary(side[1][1 - half :: 2]), dictionary(side[0][1 - half :: 2])
        for q in (0, 1):
            x += [features(good, bad, t) for t in side[q][half::2]]
            y += [q] * len(side[q][half::2])
    x, y, w = np.array(x), np.array(y), np.zeros(3)
    for _ in range(200_000):
        g = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 0.01 * w
        w += 0.02 * g
        if np.abs(g).max() < 1e-9:
            break
    good, bad = dictionary(side[1]), dictionary(side[0])
    return {i: 1 / (1 + math.exp(-np.dot(features(good, bad, t.encode()), w))) for i, t in docs}


def test_quality(edge, empty, spark):
    rng = random.Random(2)
    some = [rng.choice(["the", "of", "and", "river", "stone"]) for _ in range(3000)]
    docs = [(k, " ".join(rng.choice(some) for _ in range(rng.randint(40, 700))) if k % 2 else "### buy$$$ now%%% " * rng.randint(5, 20) + " ".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for k in range(120)]
    labels = [(k, k % 2) for k in range(90)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(df.repartition(3), known)
    rows = quality.score(df, model).collect()
    want = brute_quality(docs, labels)
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-4 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["doc_id"] >= 90 or r["held_out"])
    rows = quality.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if not r["text"]} == {model.share} and 0.3 < model.share < 0.7
    assert quality.score(edge.withColumn("_score", F.lit(1)).withColumn("held_out", F.lit("x")), model).where("held_out").count() == sum(r["held_out"] for r in rows)
    assert quality.score(empty, model).count() == 0
    assert Counter(got(quality.accepted(edge, model, 0.0))) == Counter(got(edge))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(edge, none).scores([b"x"]).tolist() == [1.0]
    again = quality.train(df.unionByName(df), known)  # repeated rows teach nothing more
    assert again == model


def test_pieces(spark):
    """Pieces make up the whole text, also what stands at the end of a long one; a lower bound on them draws among all."""
    text = bytes(range(256)) * 100
    assert b"".join(quality.pieces_of(text)) == text and quality.pieces_of(b"") == []
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    ends = " ".join(word() for _ in range(300))  # what all good texts have behind 60,000 bytes of their own
    docs = [(k, " ".join(word() for _ in range(9000)) + (ends if k % 2 else "")) for k in range(12)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    model = quality.train(df, known)
    plain = lambda d, t: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(t.encode()))
    assert plain(model.good, ends) < 0.5 * plain(model.bad, ends)
    assert quality.train(df, known, pieces=30).good != model.good


# --- 3


def brute_fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(edge, edge_rows, empty):
    fps = [brute_fingerprint(t) for _, t, *_ in edge_rows]
    ids = [i for i, *_ in edge_rows]
    near = defaultdict(set)
    for a, x in enumerate(fps):
        for b, y in enumerate(fps):
            if (x ^ y).bit_count() <= 4 and ids[a] is not None and ids[b] is not None:
                near[ids[a]].add(ids[b])
    root = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[i] = min(seen)
    by_fp = {f: root[i] for f, i in zip(fps, ids) if i is not None}
    want = Counter((i, f"{f:016x}", root[i] if i is not None else by_fp.get(f)) for f, i in zip(fps, ids))
    assert Counter(got(simhash.near_duplicates(edge))) == want
    assert Counter(got(simhash.near_duplicates(edge, tile=2))) == want
    assert got(simhash.near_duplicates(empty)) == []


def shingles(t, n=5):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def brute_similar(rows, least=0.8):
    """The least id of each id's component, linking texts by the exact similarity of their shingles."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    links = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if i == j or x == y or len(x & y) >= least * len(x | y)]
    for _ in sets:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_similar_documents(spark, edge, edge_rows, empty):
    """Against exact similarities, of texts that are far from the border on either side."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(60):
        t = [word() for _ in range(rng.choice([60, 150, 400]))]
        rows.append((len(rows), " ".join(t)))
        for share in rng.sample([0, 0.01, 0.015, 0.3, 0.5], 3):
            x = [word() if rng.random() < share else w for w in t]
            rows.append((len(rows), " ".join(x).title() if share == 0 else " ".join(x)))
    sets = dict((i, shingles(t)) for i, t in rows)
    values = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in range(i)]
    assert sum(v >= 0.86 for v in values) > 40 and sum(0.05 < v < 0.6 for v in values) > 40
    rows = [(i, t) for i, t in rows if not any(0.6 < len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.86 for j in range(i))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()} == want
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, tile=8).collect()} == want
    want = brute_similar([(i, t) for i, t, *_ in edge_rows])
    assert all(r["doc_id"] is None or r["component_id"] == want[r["doc_id"]] for r in simhash.similar_documents(edge).collect())
    assert simhash.similar_documents(edge).count() == edge.count() and got(simhash.similar_documents(empty)) == []


def test_close():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    at = rng.integers(0, 399, 60)
    fp[at + 1] = fp[at]
    ends = np.cumsum([0, *rng.choice([1, 2, 3, 5, 9], 80)])
    ends = ends[ends <= 400]
    want = [simhash.linked(fp[a:b], fp[a:b], 3).sum() > b - a for a, b in zip(ends[:-1], ends[1:])]
    assert simhash.close(fp, ends, 3, block=7).tolist() == want and any(want) and not all(want)


def test_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    fp = np.array([int(rng.choice(base)) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for _ in range(300)], np.uint64)
    root = simhash.forest(fp, 4, tile=16)
    label = np.arange(300)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    for _ in range(300):
        new = np.array([label[near[k]].min() for k in range(300)])
        if (new == label).all():
            break
        label = new
    assert len(set(zip(root, label))) == len(set(label)) == len(set(root))


# --- 4

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def odd_texts():
    rng = random.Random(6)
    parts = ["a@b.c", "_d@e.f", ".", "@", " ", "-", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "001.2.3.4", "4539 1488 0343 6467", "4539-1488-0343-6467", "79927398713", "+1 (555) 123-4567", "+12", "é", "\U0001f600", "0000 0000 0000", "\n", "12345678901234567890"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["1 " * 3000, "9." * 5000, "a." * 20_000 + "@b." + "c." * 20_000 + "d", "7" * 50_000]


def test_pii(spark, edge, edge_rows, empty):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find(df).collect():
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"] if s["rank"] < 4] == brute_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:200]
    found = {s["kind"]: r["text"][s["start"] : s["end"]] for r in pii.find(edge).where("doc_id = 12").collect() for s in r["spans"]}
    assert found == {"email": "a.b@c.de", "phone": "+49 30 123456789", "card": "4539 1488 0343 6467", "ip": "10.0.0.255", "iban": "DE89 3704 0044 0532 0130 00"}
    assert got(pii.find(empty)) == []


def test_redact(edge, edge_rows):
    rows = pii.redact(edge)
    assert rows.columns == edge.columns and rows.count() == len(edge_rows)
    text = rows.where("doc_id = 12").first()["text"]
    assert text == "Mail [email], [phone], [card], [ip], [iban] \U0001f600 10.0.0.256"
    assert rows.where("text IS NULL").count() == 1


def test_redact_leaves_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "s", "t", "u")], "doc_id long, text string, spans string, _spans string, _spans_before string")
    assert tuple(pii.redact(df).first()) == (1, "[email]", "s", "t", "u") and pii.redact(df).columns == df.columns


def test_social_security_numbers_need_context(spark):
    df = spark.createDataFrame([(1, "my SSN is 078-05-1120"), (2, "part 078-05-1120"), (3, "078-05-1120, social security"), (4, "ssn" + " " * 50 + "078-05-1120"), (5, "a@b.cd 1.2.3.4 x; host 1.2.3.5")], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    assert {k: len(v) for k, v in rows.items()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 3}
    assert [s["score"] for s in rows[5]] == [0.9, 0.95, 0.95]  # host stands before the one and behind the other


def test_names_of_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", 1, 2, 3)], "doc_id long, text string, _m_email int, _t int, __t_ip int")
    r = pii.find(df).first()
    assert (r["_m_email"], r["_t"], r["__t_ip"], len(r["spans"])) == (1, 2, 3, 1) and len(r) == 6


# --- 5


def edit_distance_in(pattern, text):
    cost = [0] * (len(text) + 1)
    for k, c in enumerate(pattern):
        new = [k + 1]
        for j, d in enumerate(text):
            new.append(min(cost[j] + (c != d), cost[j + 1] + 1, new[j] + 1))
        cost = new
    return min(cost)


def brute_leaks(docs, items):
    """document, item, matched characters, most edits: every window of every item by the whole alignment table."""
    out = []
    clean = lambda t: decontaminate._clean([t.encode()])[0]
    for d, text in docs:
        for i, item in items:
            text_, item_ = clean("x" + text + "x")[1:-1], clean(item)  # blanks at a document's ends stay
            n = min(decontaminate.WINDOW, len(item_))
            if not n:
                continue
            covered, most = [False] * len(item_), None
            for a in range(len(item_) - n + 1):
                w = item_[a : a + n]
                if n < decontaminate.SHORT:
                    e = 0 if b" " + w + b" " in b" " + text_ + b" " else None
                else:
                    e = edit_distance_in(w, text_)
                    e = e if e <= int(decontaminate.EDITS * n) else None
                if e is not None:
                    most = max(most or 0, e)
                    covered[a : a + n] = [True] * n
            if most is not None:
                out.append((d, i, sum(covered), most))
    return sorted(out)


def test_banded():
    rng = random.Random(8)
    for _ in range(60):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 20)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        one = lambda x: np.array([x])
        e, a, b = decontaminate.banded(np.frombuffer(p, np.uint8), one(0), len(p), np.frombuffer(t, np.uint8), one(-len(p)), one(0), one(len(t)), 62)
        assert e[0] == edit_distance_in(p, t) and edit_distance_in(p, t[a[0] : b[0]]) == e[0]


def test_decontaminate_against_brute_force(spark, monkeypatch):
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rng.choice([3, 7, 10, 14, 18, 24]))) for k in range(12)] + [(20, "a b"), (21, "Éc ô"), (22, "..."), (23, "")]
    docs = []
    for k in range(60):
        x = list(rng.choice(items[:12])[1])
        x = x[rng.randint(0, 25) :][: rng.randint(70, 140)]
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(x) + 1)
            x[at : at + 1] = rng.choice([[], ["q"], x[at : at + 1] + ["q"]])
        docs.append((k, prose(rng.randint(0, 6)) + rng.choice([" ", ", ", ""]) + "".join(x).title() + rng.choice([" ", "-"]) + prose(rng.randint(0, 6)) + rng.choice(["", " a  b", " ÉC Ô."])))
    want = brute_leaks(docs, items)
    assert len(want) > 40 and any(0 < w[3] for w in want)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for kept, size in ((4, 1000), (1, 3)):
        monkeypatch.setattr(decontaminate, "KEPT_BLOCKS", kept)
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        rows = decontaminate.matches(*frames).collect()
        assert sorted((r["doc_id"], r["item_id"], r["matched_chars"], r["edits"]) for r in rows) == want
    texts = dict(docs)
    assert all(edit_distance_in(decontaminate._clean([texts[r["doc_id"]][r["start"] : r["end"]].encode()])[0], decontaminate._clean([texts[r["doc_id"]].encode()])[0]) == 0 for r in rows)
    assert {r["doc_id"] for r in decontaminate.without_leaks(*frames).collect()} == set(texts) - {w[0] for w in want}


def test_whole_copies_are_found_wherever_they_start(monkeypatch):
    rng = random.Random(2)
    item = "".join(rng.choice("etaoin shr") for _ in range(400))
    known = decontaminate.index([(1, item)])
    monkeypatch.setattr(decontaminate, "PIECE", 1 << 10)  # counts in pieces of the text
    for a in range(0, 300, 7):
        doc = ("x" * rng.randint(0, 3000) + " " + item[a : a + 90] + " " + "y" * 500).encode()
        assert [i for _, i, *_ in decontaminate.search(known, np.frombuffer(doc, np.uint8), np.array([0, len(doc)]))] == [0]


def test_decontaminate(spark, edge, edge_rows, empty, monkeypatch):
    passage = next(t for i, t, *_ in edge_rows if i == 9)
    far = "quite different words that occur nowhere else in the table and go on for a while longer than needed"
    items = spark.createDataFrame([(1, passage), (2, far), (3, None), (4, "shortest"), (5, passage.upper() + "!")], "item_id long, text string")
    want = {(8, 1), (9, 1), (8, 5), (9, 5)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(edge, items).collect()} == want
    whole = [r for r in decontaminate.matches(edge, items).collect() if (r["doc_id"], r["item_id"]) == (9, 1)][0]
    assert whole["start"] == 0 and whole["end"] == len(passage) and whole["edits"] == 0 and whole["matched_chars"] == whole["item_chars"]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)  # blocks give the same
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(edge, items).collect()} == want
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 300)  # and so do parts, one of which is gathered at a time
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(edge, items).collect()} == want
    assert len(list(decontaminate.passes(items))) > 2
    kept = decontaminate.without_leaks(edge, items)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in edge_rows if i not in (8, 9))
    assert got(decontaminate.matches(empty, items)) == [] and decontaminate.without_leaks(empty, items).count() == 0
    assert got(decontaminate.matches(edge, items.where("item_id > 9"))) == []


def test_edited_passages_are_found():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(30)]
    known = decontaminate.index(items)
    for k, t in items:
        x = list(t)
        for _ in range(int(len(t) * 0.03)):
            p = rng.randrange(len(x))
            x[p : p + 1] = rng.choice([[], ["q"], [x[p], "q"]])
        doc = (" ".join(word() for _ in range(200)) + " " + "".join(x) + " " + " ".join(word() for _ in range(100))).encode()
        hits = decontaminate.search(known, np.frombuffer(doc, np.uint8), np.array([0, len(doc)]))
        assert {known.ids[i] for _, i, *_ in hits} == {k}


# --- 6


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(spark, edge, edge_rows, empty, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    want = Counter((i, len((s or "").encode()), count(s or ""), count(s or "") > 1024) for i, s, *_ in edge_rows)
    rows = tokens.token_counts(edge, vocabulary).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert tokens.token_counts(empty, vocabulary).count() == 0


def test_prefix_counts(spark, vocabulary):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(vocabulary), tokens.PrefixCounter(vocabulary)
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    for piece in (" thtionhein", "international", "1234567", "!!!???", " é中"):
        raw = piece.encode()
        for n, k in enumerate(c.counts(piece)):
            try:
                assert k == count(raw[:n].decode())
            except UnicodeDecodeError:
                pass
    rng = random.Random(3)
    alphabet = ["a", "b", "the", "'s", "ll", " ", "  ", "\n", "12", "é", "中", "\U0001f600", ".", "<|endoftext|>", "\x85", "\x1c"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 15)))
        assert c.total(s) == count(s)
        pieces = c.pieces(s)
        every = [count(s[:n]) for n in range(len(s) + 1)]
        assert c.prefix_counts(s) == every
        for limit in (0, 1, 2, 3, 6):
            kept = c.budget(pieces, np.cumsum(c.tokens(pieces)), limit)
            assert s.startswith(kept) and len(kept) == max(n for n, k in enumerate(every) if k <= limit)
    df = spark.createDataFrame([(1, "one two  three")], "doc_id long, text string")
    r = tokens.token_counts(df, vocabulary, prefixes=True).first()
    assert r["prefix_tokens"] == [count("one two  three"[:n]) for n in range(15)] and r["prefix_tokens"][-1] == r["n_tokens"]


# --- 7


def test_mixing(edge, edge_rows, empty):
    rows = mixing.mix(edge).collect()
    again = mixing.mix(edge.repartition(7)).collect()
    assert all((r["n_shards"] > 0) == (r["taken"] > 0) for r in rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    size = lambda t: len(WORD.findall(t or ""))
    total = defaultdict(int)
    for _, t, _, source, *_ in edge_rows:
        total[source] += size(t)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in rows) == Counter((i, size(t), total[s]) for i, t, _, s, *_ in edge_rows)
    level, fixed = dict(zip(sorted(total, key=lambda s: (s is None, s)), [1, 2, 3])), {}
    target = {}
    for _ in range(5):
        left = {s: w for s, w in level.items() if s not in fixed}
        rest = sum(total.values()) - sum(fixed.values())
        target = fixed | {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = {s: 3.0 * total[s] for s in left if target[s] > 3 * total[s]}
        if not over:
            break
        fixed |= over
    taken = defaultdict(int)
    for r in rows:
        source = next(s for s in total if total[s] == r["source_size"])
        assert math.isclose(r["target"], target[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s in total:
        assert taken[s] == math.floor(target[s] + 0.5)
    assert mixing.mix(empty).count() == 0


def test_mixing_small_sources(spark):
    """Sources of less than a block, of some blocks and of whole ones get just the words of their targets, in blocks of one length."""
    sizes = {"a": 3, "b": 64, "c": 100, "d": 704, "e": 5000, "f": 0, None: 130}
    rows = [(k * 10 + j, " ".join(["w"] * (n // 4 + (j < n % 4))), s) for k, (s, n) in enumerate(sizes.items()) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got_ = mixing.mix(df).collect()
    taken, target = defaultdict(int), {}
    for r in got_:
        s = list(sizes)[r["doc_id"] // 10]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"]
    assert all(taken[s] == math.floor(target[s] + 0.5) for s in sizes)
    blocks = mixing.mixed_blocks(df).where("words > 0").groupBy("sid", "shard", "slot").agg(F.sum("words").alias("n")).collect()
    assert max(r["n"] for r in blocks) == mixing.BLOCK and sum(r["n"] == mixing.BLOCK for r in blocks) > 80


def test_mixed_texts(spark):
    """Every slot's words are those of its documents, also where ids are null or repeated."""
    rows = [(None if k % 5 == 0 else k // 2, " ".join(f"w{k}x{j}" for j in range(100)), "ab"[k % 2]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks = mixing.mixed_blocks(df)
    texts = mixing.mixed_texts(df, blocks).collect()
    assert sum(len(r["text"].split()) for r in texts) == blocks.groupBy().sum("words").first()[0]
    times = Counter(w for r in texts for w in r["text"].split())
    assert set(times) <= {w for _, t, _ in rows for w in t.split()} and max(times.values()) <= 3
    taken = Counter()
    for w, n in times.items():
        taken[int(w[1:].split("x")[0])] += n
    assert Counter(taken[k] for k in range(20)) == Counter(r["taken"] for r in mixing.mix(df).collect())


def test_slots(spark):
    """Each pass over a source is a permutation of its blocks, not in order; the counts drawn for the shards decide which slots
    they have; slots are made in many tasks."""
    targets = spark.createDataFrame([("a", 1, 64 * 900, 64, 900, 64 * 2100, 2100), ("b", 2, 640, 40, 16, 640, 16)], "source string, sid long, source_size long, block long, n_blocks long, n_words long, n_slots long")
    slots = mixing.output_slots(targets, shard_slots=100)
    assert slots.rdd.getNumPartitions() >= 4 and slots.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 3
    rows = slots.collect()
    for sid, n, total in ((1, 900, 2100), (2, 16, 16)):
        own = sorted((r for r in rows if r["sid"] == sid), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(total))
        for epoch in range(0, total, n):
            index = [r["index"] for r in own[epoch : epoch + n]]
            assert len(set(index)) == len(index) and set(index) <= set(range(n)) and index != sorted(index)
            shards = [r["shard"] for r in own[epoch : epoch + n]]
            assert shards == sorted(shards)
    passes = [[r["index"] for r in sorted(rows, key=lambda r: r["slot"]) if r["sid"] == 1][k : k + 900] for k in (0, 900)]
    assert abs(np.corrcoef(*passes)[0, 1]) < 0.15 and abs(np.corrcoef(range(900), passes[0])[0, 1]) < 0.15
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 22 and 50 < min(sizes.values()) and max(sizes.values()) < 160  # about 96 each, not all alike
    assert len(set(sizes.values())) > 5


# --- 8


def test_lm(edge, edge_rows, empty):
    tok = [(i, WORD.findall(lower(t)) + [None]) for i, t, *_ in edge_rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter()
    for i, w in tok:
        if not out(i):
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), out(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 3)) for i, w in tok)
    rows = lm.lm_scores(edge).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert lm.lm_scores(empty).count() == 0


@pytest.fixture()
def small_model():
    """Weights away from the start and a vocabulary of 60 frequent words with rarer ones beside them."""
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(1, 400, 60))[::-1]
    top = [(int(n), int(c), int(f)) for n, c, f in zip([0, *rng.integers(1, 1 << 60, 59)], counts, [0, *rng.integers(1, lm.FORMS, 59)])]
    tokens, distinct = rng.integers(0, 50, lm.FORMS), rng.integers(1, 9, lm.FORMS)
    for _, c, f in top:
        tokens[f] += c
        distinct[f] += 1
    known = lm.Vocabulary.build(top, tokens, distinct)
    return {k: rng.standard_normal(v.shape) * 0.3 for k, v in lm.start_weights().items()}, known


def tokens_of(rng, known, shape):
    """Random tokens: input, class, place among the frequent words."""
    place = np.where(rng.random(shape) < 0.6, rng.integers(0, 60, shape), -1)
    form = rng.integers(1, lm.FORMS, shape)
    return np.where(place >= 0, place, lm.TOP + form), np.where(place >= 0, np.searchsorted(known.cuts, place, side="right") - 1, lm.TOP_CLASSES + form), place


def test_lm_probabilities(small_model):
    """All words of the vocabulary and all forms together have probability 1 in any state; the untrained network gives the counts'."""
    w, known = small_model
    state = np.random.default_rng(3).standard_normal((1, lm.STATE))
    place = np.arange(60)
    frequent = lm.log_probabilities(w, known, state.repeat(60, 0), np.searchsorted(known.cuts, place, side="right") - 1, place)
    rare = lm.log_probabilities(w, known, state.repeat(lm.FORMS, 0), lm.TOP_CLASSES + np.arange(lm.FORMS), np.full(lm.FORMS, -1))
    assert math.isclose(np.exp(frequent).sum() + np.exp(rare).sum(), 1, rel_tol=1e-5)
    start = lm.log_probabilities(lm.start_weights(), known, state.repeat(60, 0), np.searchsorted(known.cuts, place, side="right") - 1, place)
    total = known.total + 0.1 * (known.words + lm.FORMS)
    assert np.allclose(np.exp(start), (known.counts + 0.1) / total, rtol=1e-4)


def test_lm_gradients(small_model):
    w, known = small_model
    rng = np.random.default_rng(1)
    seen, kind, place = tokens_of(rng, known, (5, 30))
    first, valid = rng.random((5, 30)) < 0.3, rng.random((5, 30)) < 0.8
    h = rng.standard_normal((30, lm.STATE))
    arrays = (h, seen, kind, place, first, valid)
    g, _, loss = lm.gradients(w, known, *arrays)
    states = lm.forward(w, h, seen, first).astype(float).reshape(-1, lm.STATE)
    assert math.isclose(loss, -(lm.log_probabilities(w, known, states, kind.ravel(), place.ravel()) * valid.ravel()).sum() / valid.sum(), rel_tol=1e-3)
    some = int(place[place >= 0][0])
    for k, at in (("E", (int(seen[1, 1]), 5)), ("U", (3, 7)), ("W", (2, int(kind[0, 0]))), ("b", (int(kind[0, 0]),)), ("V", (some, 4)), ("c", (some,))):
        keep, step = w[k][at], 1e-2
        w[k][at] = keep + step
        up = lm.gradients(w, known, *arrays)[2]
        w[k][at] = keep - step
        down = lm.gradients(w, known, *arrays)[2]
        w[k][at] = keep
        assert abs((up - down) / (2 * step) - g[k][at]) < 1e-3, k


def text_of(rng, bounds, out):
    n = int(bounds[-1])
    names = np.sort(rng.integers(1, 1 << 60, 200)).astype(np.uint64)
    names[0] = 0
    word = rng.integers(1, 200, n).astype(np.uint32)
    word[np.asarray(bounds[1:]) - 1] = 0
    text = lm.Text(np.arange(len(bounds) - 1), np.asarray(bounds), names, np.where(np.arange(200) == 0, 0, rng.integers(1, lm.FORMS, 200)).astype(np.uint8), word)
    text.out = np.asarray(out)
    counts = text.counts()
    rows = sorted(zip(counts.tolist(), names.astype(np.int64).tolist(), text.forms.tolist()), key=lambda r: (-r[0], r[1]))
    sums = [np.bincount(text.forms, x, lm.FORMS).astype(np.int64) for x in (counts, counts > 0)]
    return text, lm.Vocabulary.build([(i, c, f) for c, i, f in rows[:60] if c], *sums)


def test_lm_scores_whole_documents(small_model):
    """Lanes and windows don't change a document's score: one lane, step by step, gives the same."""
    text, known = text_of(np.random.default_rng(1), [0, 40, 41, 141, 150], [False] * 4)
    w = {k: v.astype(np.float32) for k, v in small_model[0].items()}
    inputs, kinds, places = known.inputs(text)
    scores = lm.network_scores(text, known, w)
    for a, b in zip(text.bounds[:-1], text.bounds[1:]):
        h, before = np.zeros((1, lm.STATE), np.float32), inputs[0]
        for k in range(a, b):
            s = lm.forward(w, h, np.array([[before]]), np.array([[k == a]]))
            h, x = s[-1], text.word[k]
            before = inputs[x]
            p = lm.log_probabilities(w, known, s[0], kinds[x : x + 1], places[x : x + 1])[0]
            assert abs(p / np.log(10) - scores[k]) < 1e-4


@pytest.mark.parametrize("sizes", [[700] * 900, [100_000], [40_000, *[3] * 200], [1], [700_000]])
def test_lm_trains_on_every_token(sizes, monkeypatch):
    """All rounds together read all tokens of the training documents, be they many, or few and long, and no other."""
    text, known = text_of(np.random.default_rng(2), np.cumsum([0, *sizes, 500]), [False] * len(sizes) + [True])
    inputs, _, places = known.inputs(text)
    seen_places, starts = np.zeros(61, np.int64), 0

    def gradients(w, known, h, seen, kind, place, first, valid):
        nonlocal seen_places, starts
        seen_places = seen_places + np.bincount(place[valid] + 1, minlength=61)
        starts += int(first[valid].sum())
        return {k: np.zeros_like(x) for k, x in w.items()}, h, 0.0

    monkeypatch.setattr(lm, "gradients", gradients)
    read = [lm.train(text, known, lm.flatten(lm.start_weights()), turn)[1] for turn in range(lm.ROUNDS)]
    want = np.bincount(places[text.word[:-500]] + 1, minlength=61)
    passes = seen_places.sum() // want.sum()
    assert passes >= 1 and sum(read) in (sum(sizes), lm.ROUNDS * sum(sizes))
    assert (seen_places == passes * want).all() and starts == passes * len(sizes)


def test_lm_stretches():
    text = object.__new__(lm.Text)
    text.bounds, text.out = np.array([0, 4, 6, 9]), np.array([False, True, False])
    text.word = np.array([5, 6, 7, 0, 1, 0, 8, 9, 0])
    first, valid, seen, target = (x.T.ravel() for x in lm.stretches(text, 2, np.arange(10), np.arange(10)))
    pairs = list(zip(first[valid], seen[valid], target[valid]))
    a, b = [(True, 0, 5), (False, 5, 6), (False, 6, 7), (False, 7, 0)], [(True, 0, 8), (False, 8, 9), (False, 9, 0)]
    assert pairs in (a + b, b + a) and len(valid) == 8


def test_lm_does_not_depend_on_partitions(spark):
    """Whatever the number of partitions; and what documents say of each other is learnt: held-out ones score over the base."""
    rng = random.Random(11)
    said = [[f"{p}{k}" for k in range(40)] for p in "abc"]
    rows = [(k, " ".join(rng.choice(said[k % 3]) for _ in range(rng.randint(20, 60)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, lm.lm_scores(df.repartition(n), shard_bytes=20_000).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    held = [r for r in found[0] if r[1]]
    assert len(held) > 20 and all(r[6] > r[5] + 0.2 * r[2] for r in held)


# --- 9


COMMON = {"en": "the of and to in is that it for was on are as".split(), "de": "der die und in den von zu das mit sich".split(), "xx": "ba ko lu mi".split(), "fr": "de la le et les des en un du".split()}


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed


def test_rules(spark, edge, edge_rows, empty):
    known = rules.references(edge)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = rules.apply_rules(edge, known).collect()
    assert Counter((r["doc_id"], *(r[k] for k in names)) for r in rows) == Counter((i, *brute_rules(t)) for i, t, *_ in edge_rows)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bé", "\n", " ", "x y", "#", "\t", "\x0b", "q\n", "w1 w2 w3 w4 w5 "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    for r in rules.apply_rules(df, known).collect():
        assert tuple(r[k] for k in names) == brute_rules(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert rules.apply_rules(empty, rules.references(empty)).count() == 0


def brute_kept(rows):
    """The whole verdict of (text, lang) rows in plain Python: references, distances, guards."""
    bins, shares = [], lambda c: {k: v / max(1, sum(c.values())) for k, v in c.items()}
    held = defaultdict(Counter)
    for t, lang in rows:
        held[lang or ""].update({lower(w) for w in WORD.findall(t or "")})
    key = lambda w: int(rules.hash_words([w]).view(np.int64)[0])
    listed = {w for c in held.values() for w in sorted(c, key=lambda w: (-c[w], key(w)))[: rules.EACH]}
    for t, _ in rows:
        words = [lower(w) for w in WORD.findall(t or "")]
        bins.append((shares(Counter(int(rules.CLASSES[b]) for b in (t or "").encode())), shares(Counter(w if w in listed else "" for w in words)), len(words)))
    sums = defaultdict(lambda: (Counter(), Counter()))
    for (chars, said, n), (_, lang) in zip(bins, rows):
        if n >= rules.GUARD_COMMON:
            for key in {lang or "", None}:
                for total, own in zip(sums[key], (chars, said)):
                    total.update({k: int(1e6 * v) for k, v in own.items()})

    def far(p, q):
        q, d = shares(q), 0.0
        for k in {*p, *q}:
            a, b = p.get(k, 0), q.get(k, 0)
            d += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
        return math.sqrt(max(0, d))

    out = []
    for (chars, said, n), (t, lang) in zip(bins, rows):
        own = sums.get(lang) if lang and lang in sums else sums.get(None)
        off = own and (n >= rules.GUARD_CHARS and far(chars, own[0]) > rules.FAR_CHARS or n >= rules.GUARD_COMMON and far(said, own[1]) > rules.FAR_COMMON)
        out.append(not brute_rules(t)[-1] and not off)
    return out


def test_kept_against_brute_force(spark):
    rng = random.Random(23)
    rows = []
    for k in range(240):
        lang = rng.choice(["en", "de", "xx", "", None])
        said = COMMON.get(lang, COMMON["fr"]) if rng.random() < 0.7 else ["Qx", "0101", "###", "ÀÀ", "zz"]
        word = lambda: rng.choice(said) if rng.random() < 0.6 else "".join(rng.choice("abcdefgé7-") for _ in range(rng.randint(1, 8)))
        rows.append((" ".join(word() for _ in range(rng.choice([5, 20, 40, 70, 150]))), lang))
    rows += [(None, "en"), ("", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    want = brute_kept(rows)
    assert 40 < sum(want) < 200 and any(not w and not brute_rules(t)[-1] for w, (t, _) in zip(want, rows))
    assert [r["kept"] for r in sorted(rules.apply_rules(df, rules.references(df)).collect(), key=lambda r: r["doc_id"])] == want


def test_references_of_all_documents_and_languages(spark, monkeypatch):
    """The common reference sums every row, and each language has its own, be it joined or not."""
    rng = random.Random(6)
    text = lambda s, n=80: " ".join("".join(rng.choice(s) for _ in range(4)) for _ in range(n))
    rows = [(k, text(s), lang) for k, (lang, s) in enumerate(4 * [("aa", "abcd"), ("bb", "efgh"), ("cc", "ijkl"), ("", "mnop"), (None, "qrst")] + [("aa", "abcd")])]
    df = spark.createDataFrame([*rows, (99, text("uvwx", 40), "dd")], "doc_id long, text string, lang string")
    whole = rules.apply_rules(df, rules.references(df)).collect()
    monkeypatch.setattr(rules, "KNOWN_LANGUAGES", 1)
    known = rules.references(df)
    assert sorted(r["lang"] for r in known.rest.collect()) == ["aa", "bb", "cc"] and known.names == [""]
    chars = sum(rules.measure(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), known.words)["chars"][0] / len(t) for _, t, _ in rows)
    assert np.abs(known.common[None][0] - chars / chars.sum()).max() < 1e-5
    assert Counter(got(rules.apply_rules(df, known))) == Counter(map(tuple, whole))
    assert all(r["kept"] and r["far_chars"] < 0.2 for r in whole if r["doc_id"] < 99 and rows[r["doc_id"]][2])


def test_common_words_of_a_fifth_language(spark):
    """Words of any language are learned, and a document of another language, or of its words shuffled away, stands out."""
    rng = random.Random(8)
    every = {"q1": ["xalo", "brin", "te", "uk", "mosh"], "q2": ["ptar", "ol", "ged", "nu", "ssi"], "q3": ["wex", "yib", "zoa", "cli", "vum"]}
    rare = lambda: "".join(rng.choice("aeioulnrtbg") for _ in range(7))
    text = lambda lang, n=90: " ".join(rng.choice(every[lang]) if rng.random() < 0.6 else rare() for _ in range(n))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["q1", "q2", "q3"] * 30)] + [(100, " ".join(rare() for _ in range(90)), "q1"), (101, text("q2"), "q1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = rules.references(df)
    assert set(rules.hash_words([w for x in every.values() for w in x])) <= set(known.words) and len(known.words) <= 3 * rules.EACH
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_rules(df, known).collect()}
    assert not kept[100] and not kept[101] and all(kept[k] for k in range(90))


def test_references_may_be_missing(spark):
    prose = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    for lang, t in ((None, prose), ("", prose), ("en", " ".join(prose.split()[:45]))):
        df = spark.createDataFrame([(k, t, lang) for k in range(3)], "doc_id long, text string, lang string")
        assert all(r["kept"] for r in rules.apply_rules(df, rules.references(df)).collect())


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([[0.0, 0.5, 0.5]])
    assert rules.distance(p, p)[0] == 0 and abs(rules.distance(p, q)[0] - math.sqrt(0.5)) < 1e-12
    assert rules.distance(np.array([1.0, 0.0]), np.array([0.0, 1.0])) == 1


# --- 10


def test_warc(spark, tmp_path):
    html = '<html><head><title> A\n b </title><script>x="<p>"</script></head><body><!-- no --><p>One &amp; two&#233;</p><a class="c" href="http://a/b">l</a><A HREF = \'c d\'></a><a href=e/f></a><a href="">z</a><br>3 &lt; 4</body></html>'
    pages = spark.createDataFrame([(1, "http://x/y", html, "k"), (1, "http://x/y", html, "k"), (2, None, None, None), (None, "u", "", "z")], "page_id long, url string, html string, record_id string")
    out = warc.derive(warc.responses(pages))
    rows = [r for r in out.collect() if r["page_id"] == 1]
    assert out.count() == 8 and len(rows) == 4
    text = next(r for r in rows if r["record_type"] == "conversion")
    meta = next(r for r in rows if r["record_type"] == "metadata")
    assert text["block"] == "A b\nOne & twoé\nlz\n3 < 4"
    assert text["refers_to"] == meta["refers_to"] and text["related_to"] == meta["record_id"] and meta["related_to"] == text["record_id"]
    assert text["content_length"] == len(text["block"].encode()) and text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest()
    assert text["source_payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert "title: A b\r\n" in meta["block"] and meta["block"].endswith("outlink: http://a/b\r\noutlink: c d\r\noutlink: e/f\r\noutlink: \r\n") and "http-header: HTTP/1.1 200 OK" in meta["block"]
    warc.write_warc(out, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w" / "part-*")).collect()
    assert Counter((r["record_id"], bytes(r["block"]).decode()) for r in back) == Counter((r["record_id"], r["block"]) for r in out.collect())
    assert warc.derive(warc.responses(pages.where("page_id > 5"))).count() == 0


def test_warc_records_longer_than_splits(spark, tmp_path):
    """Blocks that quote the mark of a record, cut by splits of 4 KB; one runs over several splits, and the file ends inside the last."""
    rng = random.Random(4)
    blocks, text = [], b""
    for k in range(30):
        block = b" ".join(rng.choice([b"WARC/1.0", b"WARC/1.1\r\n", b"word", b"x" * 50]) for _ in range(rng.choice([5, 200, 900])))
        blocks.append((f"<urn:{k}>", block))
        text += b"WARC/1.%d\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k % 2, k, len(block), block)
    text += b"WARC/1.0\r\nWARC-Record-ID: <urn:cut>\r\nContent-Length: 90000\r\n\r\n" + b"WARC/1.0 " * 2000
    (tmp_path / "a.warc").write_bytes(text)
    (tmp_path / "b.warc").write_bytes(text)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "4096")
    spark.conf.set(keys[1], "1")
    try:
        rows = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    got_ = Counter((r["record_id"], bytes(r["block"]), r["truncated"]) for r in rows)
    want = Counter([(i, b, False) for i, b in blocks * 2] + [("<urn:cut>", b"WARC/1.0 " * 2000, True)] * 2)
    assert got_ == want


def test_warc_responses_from_files(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://h/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"uuid:1", b"uuid:2")))
    rows = warc.derive(warc.read_responses(spark, str(tmp_path / "a.warc.gz"))).collect()
    marked = record.replace(block, block[:-4] + b"WARC/1.0\r\n\r\n").replace(b"Content-Length: %d" % len(block), b"Content-Length: %d" % (len(block) + 8))
    (tmp_path / "b.warc").write_bytes(marked + record + record[:-20])
    (tmp_path / "c.warc").write_bytes(record[:60])
    (tmp_path / "d.warc").write_bytes(record)
    got_ = Counter((bytes(r["block"]), len(r["header"])) for r in warc.read_warc(spark, str(tmp_path / "*.warc")).collect())
    assert got_ == Counter([(block[:-4] + b"WARC/1.0\r\n\r\n", 5), (block, 5), (block[:-16], 5), (block, 5)])
    assert len(rows) == 4 and {r["refers_to"] for r in rows} == {"<urn:uuid:1>", "<urn:uuid:2>"}
    assert all(r["date"] == "2020-01-01T00:00:00Z" for r in rows) and any(r["block"] == "hello" for r in rows)
