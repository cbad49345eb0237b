"""Operators 11 and 12 against plain-Python versions, on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from moltrail.llm import audit, enhanced, periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs, out = [], []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        docs.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    for part in {d[0] for d in docs}:
        own, shapley, steps = [d for d in docs if d[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                shapley[x] += len(gone)
                failing = sum(d[1][x] for d in own)
                lone = sum(d[1][x] and sum(d[1].values()) == 1 for d in own)
                steps.append((part, "".join(order), k, len(left), len(gone), failing - len(gone), lone, sum(d[2] for d in gone), sum(d[3] for d in gone), x))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark, edge, edge_rows, empty):
    rng = random.Random(5)
    rows = [(r[0], r[1], r[2]) for r in edge_rows]
    long_ = " ".join(rng.choice("abcdefgh") * rng.randint(1, 40) for _ in range(260))
    rows += [(100 + k, rng.choice([long_, long_ + " #", long_.upper(), "a " * 300, "Some TEXT", "", None]), rng.choice(["en", "de", None, ""])) for k in range(60)]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.7] + [(101, 0, 0), (101, 1, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "doc_id long, text string, lang string, n long, mask int, digest string, quality string")
    known = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    seen, conditions = audit.failing(docs)
    assert sorted(map(tuple, audit.audit(audit.cells(seen, conditions, known), "ABCDE").collect())) == brute_audit(rows, labels)
    seen, conditions = audit.failing(empty)
    assert audit.audit(audit.cells(seen, conditions, known), "ABCDE").collect() == []


def test_gray_walk():
    rng = np.random.default_rng(2)
    masks, counts = np.arange(16), rng.integers(0, 50, (16, 3))
    states = audit.gray_walk(masks, counts, 4)
    for s in range(16):
        assert (states[s] == counts[masks & s == 0].sum(axis=0)).all()


# --- 12


def brute_runs(x, least=6, most=4):
    found = {}
    for q in range(1, len(x) // most + 1):
        k = 0
        while k + q < len(x):
            if x[k] == x[k + q]:
                start = k
                while k + q < len(x) and x[k] == x[k + q]:
                    k += 1
                if k + q - start >= max(least, most * q):
                    found.setdefault((start, k + q), q)
            k += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(rng):
    n, kinds = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
    x = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        p, b = rng.randint(1, max(1, n // 5)), rng.randrange(n)
        x = x[:b] + (x[b : b + p] * n)[: n - b] + [rng.randrange(kinds) for _ in range(rng.choice([0, 9]))]
    return x


def test_runs():
    rng = random.Random(3)
    for _ in range(600):
        x = made(rng)
        want = brute_runs(x)
        assert periods.runs(np.array(x, np.int64)) == want
        assert not want or periods.may_repeat(np.array(x, np.int64))
    a, b = [0], [1]
    for _ in range(11):  # Thue-Morse: no run of more than two periods
        a, b = a + b, b + a
    assert periods.runs(np.array(a, np.int64)) == []
    assert periods.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]  # work doesn't grow with the square


def test_enhanced_suffix_array():
    rng = random.Random(8)
    for _ in range(60):
        x = made(rng)
        order, levels = enhanced.suffix_array(np.array(x, np.int64))
        assert order.tolist() == sorted(range(len(x)), key=lambda k: x[k:])
        common = enhanced.prefixes(order, levels)
        for k in range(1, len(x)):
            a, b = x[order[k - 1] :], x[order[k] :]
            assert common[k] == next((i for i, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
        first, behind = enhanced.intervals(common)
        for k in range(1, len(x)):
            assert common[first[k] + 1 : behind[k]].min() == common[k]
            assert first[k] == 0 or common[first[k]] <= common[k]
            assert behind[k] == len(x) or common[behind[k]] < common[k]


def brute_document(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    numbers = {x: k for k, x in enumerate(dict.fromkeys(w))}
    runs = brute_runs([numbers[x] for x in w]) if n < 3000 else periods.runs(np.array([numbers[x] for x in w]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


@pytest.fixture
def run_rows(edge_rows):
    rng = random.Random(6)
    line = "same old line here "
    texts = ["na " * 9, "x y " * 6, line * 12 + "tail", "a b a b a b a b " + "c " * 7 + "end", "\n\n", " one"]
    rows = [(r[0], r[1]) for r in edge_rows] + [(200 + k, t) for k, t in enumerate(texts)] + [(None, "na " * 9)]
    return rows + [(300 + k, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 200)))) for k in range(80)]


def test_periodic_runs(spark, tmp_path, run_rows, empty):
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, 1, "r", 3) for i, t in run_rows], "doc_id long, text string, n_runs int, runs string, start int").write.parquet(f"{folder}/documents.parquet")
    got = Counter(tuple(r) for r in periods.op12_periodic_runs(spark, folder).collect())
    assert got == Counter(brute_document(i, t) for i, t in run_rows)
    assert sum(r[1] > 0 for r in got) > 8
    assert periods.periodic_runs(empty).collect() == []
