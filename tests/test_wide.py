"""Operators of wide and crowded inputs against numpy and brute force."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from moltrail.operators import components as W
from moltrail.operators import contacts as C
from moltrail.operators import correlations as R
from moltrail.operators import learning as L
from moltrail.operators import lipids as Z
from moltrail.operators import series as S
from moltrail.operators import trees as T


def exact(x, k):
    c = x - x.mean(axis=0)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    sign = np.array([1.0 if a[np.abs(np.round(a, 9)).argmax()] > 0 else -1.0 for a in v[:k]])
    return u[:, :k] * s[:k] * sign, v[:k].T * sign, (s**2 / (s**2).sum())[:k]


def sparse(spark, x, rng):
    rows = [(f"r{i}", int(j), float(v)) for (i, j), v in np.ndenumerate(x) if v]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "frame string, contact long, w double"), spark.createDataFrame([(f"r{i}",) for i in range(len(x))], "frame string")


@pytest.mark.parametrize("shape,share,rounds,far", [((30, 9), 0.5, 2, 0), ((8, 400), 0.1, 1, 0), ((200, 120), 1.0, 8, 1e4)])
def test_components(spark, shape, share, rounds, far):
    """Exact where rows or columns are few; else as close as shares stand out, and with an origin far away."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((shape[0], 4)) @ (rng.standard_normal((4, shape[1])) * np.array([[9], [6], [4], [2.5]])) + 0.3 * rng.standard_normal(shape) + far
    x *= rng.random(shape) < share
    x[3] = 0
    rows, frames = sparse(spark, x, rng)
    got = W.wide_components(rows, "frame", "contact", "w", 3, frames, rounds=rounds)
    scores, loadings, shares = exact(x, 3)
    assert np.allclose(got.shares, shares, rtol=1e-6)
    p = {r["frame"]: [r[f"PC_{k}"] for k in range(3)] for r in got.projections.collect()}
    assert len(p) == shape[0] and np.allclose([p[f"r{i}"] for i in range(shape[0])], scores, rtol=1e-4, atol=1e-4 * np.abs(scores).max())
    c = {r["contact"]: [r[f"PC_{k}"] for k in range(3)] for r in got.loadings.collect()}
    assert np.allclose([c.get(j, [0, 0, 0]) for j in range(shape[1])], loadings, atol=1e-4)


def test_components_equal_those_of_the_library(spark):
    from pyspark.ml.feature import PCA
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 12)) * np.arange(1, 13) * (rng.random((40, 12)) < 0.7)
    rows, frames = sparse(spark, x, rng)
    model = PCA(k=4, inputCol="v", outputCol="p").fit(spark.createDataFrame([(Vectors.dense(r),) for r in x], ["v"]))
    assert np.allclose(W.wide_components(rows, "frame", "contact", "w", 4, frames).shares, model.explainedVariance.toArray())


def test_components_of_little(spark):
    one = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0)], "frame string, contact long, w double")
    assert W.wide_components(one, "frame", "contact", "w", 2).shares == []  # no variance
    two = spark.createDataFrame([("a", 1, 2.0), ("b", 1, -2.0), ("b", 1, 1.0)], "frame string, contact long, w double")
    got = W.wide_components(two, "frame", "contact", "w", 2)
    assert np.allclose(got.shares, 1) and np.allclose(sorted(r["PC_0"] for r in got.projections.collect()), [-1.5, 1.5])
    assert W.wide_components(one.where("w < 0"), "frame", "contact", "w", 2).shares == []


# --- pairs


@pytest.fixture(scope="module")
def cloud(spark):
    """Points of two frames, of which the first crowds one cell and has repeated points."""
    rng = np.random.default_rng(9)
    rows = [(0, k, *map(float, p)) for k, p in enumerate(rng.random((90, 3)) * 0.9)] + [(0, 90 + k, 0.5, 0.5, 0.5) for k in range(9)]
    rows += [(1, 200 + k, *map(float, p)) for k, p in enumerate(rng.random((60, 3)) * 6 - 3)]
    return rows, spark.createDataFrame(rows, "frame int, id int, x double, y double, z double")


def near(rows, cutoff, own=lambda a, b: True):
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) ** 0.5
    return sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and d(a, b) <= cutoff and own(a[1], b[1]))


@pytest.mark.parametrize("tile", [None, 1024, 16])
def test_pairs_in_crowded_cells(cloud, tile):
    rows, df = cloud
    got = C.self_pairs(df, 1.0, ["frame"], "id", tile=tile).select("frame", "id_a", "id_b").collect()
    assert sorted(map(tuple, got)) == near(rows, 1.0, lambda a, b: a < b)
    even, odd = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = C.near_pairs(even, odd, 1.0, ["frame"], ["id"], tile=tile).select("frame", "id_a", "id_b").collect()
    assert sorted(map(tuple, got)) == near(rows, 1.0, lambda a, b: a % 2 == 0 and b % 2 == 1)
    got = C.all_pairs(even, odd, ["frame"], ["id"], tile=tile).select("frame", "id_a", "id_b").collect()
    assert sorted(map(tuple, got)) == near(rows, 1e9, lambda a, b: a % 2 == 0 and b % 2 == 1)
    assert C.all_pairs(even.where("id < 0"), odd, ["frame"], ["id"], tile=tile).count() == 0


def test_tiles_spread_a_product(cloud):
    """No tile of the joined rows is much over its size, however large the group; repeated rows of one side share a block."""
    _, df = cloud
    one = df.where("frame = 0 AND id < 90").withColumn("one", F.lit(1))
    left, right = C._named(one, "a", ["one", "id"]), C._named(one, "b", ["one", "id"])
    blocks = C._blocks(left, right, ["one"], 8)
    assert blocks.first()[1:] == (12, 12)
    tiles = C._dealt(left, "a", ["one"], blocks).groupBy("_t_a_a", "_t_b_a").count().collect()
    assert len(tiles) > 130 and max(r["count"] for r in tiles) < 24


def test_large_products_are_not_copied(cloud):
    """of a key of many tiles no row is dealt to them; each stands once, in one block, and the product is whole."""
    rows, df = cloud
    one = df.where("frame = 0 AND id < 90").withColumn("one", F.lit(1)).withColumn("name", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    left, right = C._named(one, "a", ["one", "id", "name"]), C._named(one, "b", ["one", "id", "name"])
    blocks = C._blocks(left, right, ["one"], 8)
    assert C._dealt(left, "a", ["one"], blocks, C.DEALT).count() == 0
    sizes = [len(r["id_a"]) for r in C._packed(left, "a", ["one"], blocks).collect()]
    assert sum(sizes) == 90 and len(sizes) == 12 and max(sizes) < 24
    got = C.all_pairs(one, one, ["one"], ["id", "name"], tile=8)
    points = [r for r in rows if r[0] == 0 and r[1] < 90]
    want = sorted((1, a[1], b[1], *[str(p[1]) if p[1] % 3 else None for p in (a, b)], round(sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) ** 0.5, 9)) for a in points for b in points)
    assert sorted(((r["one"], r["id_a"], r["id_b"], r["name_a"], r["name_b"], round(r["d"], 9)) for r in got.collect()), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])


@pytest.mark.parametrize("tile", [4, 16, 40])
def test_crowded_and_other_cells_together(spark, cloud, tile):
    """cells that are packed, dealt and whole in one join, for each pair once."""
    rows, df = cloud
    far = [(2, 300 + k, 10.0 + k % 3 / 4, 20.0, -5.0) for k in range(30)]
    both = df.unionByName(spark.createDataFrame(far, df.schema)).withColumn("w", F.col("id") / 2)
    got = C.self_pairs(both, 0.7, ["frame"], "id", ["w"], tile=tile).collect()
    assert sorted((r["frame"], r["id_a"], r["id_b"]) for r in got) == near(rows + far, 0.7, lambda a, b: a < b)
    assert all((r["w_a"], r["w_b"]) == (r["id_a"] / 2, r["id_b"] / 2) for r in got)
    assert C.near_pairs(both, both, 0.7, ["frame"], ["id"], tile=tile).count() == len(near(rows + far, 0.7))


def brute_sums(pairs):
    """by: n, least and mean of the distances that are there."""
    out = {}
    for by, d in pairs:
        out.setdefault(by, []).append(d)
    known = {k: [d for d in v if d is not None] for k, v in out.items()}
    return sorted((str(k), len(v), round(min(known[k]), 9) if known[k] else None, round(sum(known[k]) / len(known[k]), 9) if known[k] else None) for k, v in out.items())


def as_sums(df):
    assert df.columns == ["by", "n", "least", "mean"]
    return sorted((str(r["by"]), r["n"], *[None if r[c] is None else round(r[c], 9) for c in ("least", "mean")]) for r in df.collect())


@pytest.mark.parametrize("tile", [1024, 16, 8])
def test_sums_of_pairs(spark, cloud, tile):
    """sums of packed, dealt and whole keys, with coordinates and keys that are null, against brute force."""
    rows, _ = cloud
    rows = [*rows, (0, 97, None, 0.1, 0.1), (0, 98, 0.1, None, 0.1), (3, 400, 1.0, 1.0, 1.0)]
    by = lambda p: p[1] % 3 if p[1] % 11 else None
    df = spark.createDataFrame([(*p, by(p)) for p in rows], "frame int, id int, x double, y double, z double, by int")
    d = lambda a, b: None if None in (*a, *b) else sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) ** 0.5
    got = C.pair_sums(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["frame"], "id", "by", tile)
    assert as_sums(got) == brute_sums((by(a), d(a, b)) for a in rows for b in rows if a[0] == b[0] and a[1] % 2 == 0 and b[1] % 2)
    got = C.self_pair_sums(df.where("id <> 97 OR x IS NULL"), 0.7, ["frame"], "id", "by", tile)
    left = [p for p in rows if p[1] != 97 or p[2] is None]
    assert as_sums(got) == brute_sums((by(a), d(a, b)) for a in left for b in left if a[0] == b[0] and a[1] < b[1] and d(a, b) is not None and d(a, b) <= 0.7)


# --- many columns


@pytest.mark.parametrize("block,fan_in,tiles_bytes", [(256, 32, 1 << 28), (7, 2, 8 * 49 * 3)])
def test_correlated_pairs(spark, monkeypatch, block, fan_in, tiles_bytes):
    monkeypatch.setattr(R, "FAN_IN", fan_in)
    monkeypatch.setattr(R, "TILES_BYTES", tiles_bytes)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((120, 20))
    x[:, 5] = x[:, 1] * 2 + 0.1 * rng.standard_normal(120)
    x[:, 19] = -x[:, 5] + 0.1 * rng.standard_normal(120)
    x[:, 7], x[:, 8] = 3.0, x[:, 3]
    names = [f"c{k}" for k in range(20)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x + 1e3], ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in R.correlated_pairs(df, names, 0.85, block).collect()}
    with np.errstate(invalid="ignore"):
        r = np.corrcoef(x.T)
    want = {(names[i], names[j]): r[i, j] for i in range(20) for j in range(i + 1, 20) if abs(r[i, j]) > 0.85}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    left = dict.fromkeys(range(20), True)
    for i in range(20):  # the rule in full
        for j in range(i + 1, 20):
            if left[i] and left[j] and abs(r[i, j]) > 0.85:
                left[i] = False
    assert R.uncorrelated(df, names, 0.85) == [names[k] for k in range(20) if left[k]]


def test_correlations_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0)], "a double, b double")
    assert [tuple(r)[:2] for r in R.correlated_pairs(df, ["a", "b"], 0.9).collect()] == [("a", "b")]
    assert R.uncorrelated(df.where("a > 9"), ["a", "b"]) == ["a", "b"]


def test_many_columns_never_meet_in_one_place(spark):
    names = [f"c{k}" for k in range(1200)]
    e = spark.range(30).select(*[(F.sin(F.col("id") * (k % 600 + 1)) + k).alias(c) for k, c in enumerate(names)])
    got = R.correlated_pairs(e, names, 0.999)
    assert {f"c{k}" for k in range(600)} <= {r["a"] for r in got.where("r > 0.999").collect()}


def brute_importances(rows, n_features, trees, depth, seed):
    varying = [f for f in range(n_features) if len({x[f] for _, x in rows}) > 1]
    k = max(1, int(len(varying) ** 0.5))
    classes = sorted({y for y, _ in rows})
    out = [0.0] * n_features

    def impurity(own):
        return len(own) - sum(sum(y == c for y, _ in own) ** 2 for c in classes) / max(1, len(own))

    for t in range(trees):
        gains = [0.0] * n_features

        def grow(own, node, left):
            if not left or len({y for y, _ in own}) < 2:
                return
            best = (0.0, None, None)
            for f in sorted(sorted(varying, key=lambda f: (T.chance(seed, t, node, f, 0)[0], f))[:k]):
                lo, hi = min(x[f] for _, x in own), max(x[f] for _, x in own)
                if lo == hi:
                    continue
                cut = min(lo + T.chance(seed, t, node, f, 1)[0] * (hi - lo), np.nextafter(hi, -np.inf))
                gain = impurity(own) - sum(impurity([r for r in own if (r[1][f] > cut) == side]) for side in (False, True))
                if gain > best[0]:
                    best = (gain, f, cut)
            if best[1] is not None:
                gains[best[1]] += best[0]
                for side in (0, 1):
                    grow([r for r in own if (r[1][best[1]] > best[2]) == bool(side)], 2 * node + side, left - 1)

        grow(rows, 1, depth)
        if sum(gains):
            out = [o + g / sum(gains) / trees for o, g in zip(out, gains)]
    return [o / sum(out) for o in out]


@pytest.mark.parametrize("n_features,depth", [(2, 5), (10, 4), (10, 1)])
def test_importances_of_trees(spark, n_features, depth):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((150, n_features)).round(2)
    x[:, -1] = 1.0
    y = (x[:, 0] + 0.3 * rng.standard_normal(150) > 0).astype(int) + 2 * (x[:, 1] > 1)
    names = [f"c{k}" for k in range(n_features)]
    df = spark.createDataFrame([(f"k{c}", *map(float, r)) for c, r in zip(y, x)] + [("k0", *[None] * n_features)], "label string, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    got = T.importances(df, names, "label", trees=4, depth=depth, seed=3)
    want = brute_importances([(int(c), list(map(float, r))) for c, r in zip(y, x)], n_features, 4, depth, 3)
    assert np.allclose([got[n] for n in names], want)
    assert got[names[-1]] == 0 and np.isclose(sum(got.values()), 1)


def test_importances_of_one_class(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "y int, a double")
    assert T.importances(df, ["a"], "y") == {"a": 0.0}


def test_mutual_information_of_all_pairs(spark):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((300, 3))
    x[:, 2] += x[:, 0]
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["a"], r["b"]): r for r in S.mutual_information_matrix(df, ["a", "b", "c"], 6).collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    entropy = lambda h: -sum(p * np.log(p) for p in h.ravel() / h.sum() if p)
    for (p, q), r in got.items():
        i, j = "abc".index(p), "abc".index(q)
        col = lambda k: np.array([t[k] for t in rows if t[k] is not None])
        both = np.array([(t[i], t[j]) for t in rows if None not in (t[i], t[j])])
        h = np.histogram2d(*both.T, bins=[np.linspace(col(k).min(), col(k).max(), 7) for k in (i, j)])[0]
        want = [entropy(h.sum(axis=1)), entropy(h.sum(axis=0)), entropy(h)]
        assert np.allclose([r["hx"], r["hy"], r["hxy"], r["mi"]], [*want, want[0] + want[1] - want[2]])


def test_split_by_digests(spark):
    df = spark.range(5000).withColumn("key", F.concat(F.lit("k"), "id"))
    a, b = L.split(df, "key", 0.7, 3), L.split(df.repartition(7), "key", 0.7, 3)
    first = {r["key"] for r in a.where("first").collect()}
    assert len(first) == 3500 and first == {r["key"] for r in b.where("first").collect()} and a.count() == 5000
    assert first != {r["key"] for r in L.split(df, "key", 0.7, 4).where("first").collect()}
    assert L.split(df, "key", 1.0).where("not first").isEmpty() and L.split(df, "key", 0.0).where("first").isEmpty()
    one = df.withColumn("key", F.lit("same"))
    assert L.split(one, "key", 0.5).where("first").isEmpty()  # a key's rows stay together
    assert L.split(df.where("id < 0"), "key", 0.5).count() == 0


def test_bilayer_without_protein(spark):
    heads = spark.createDataFrame([(f, z) for f in (0, 1) for z in (0.0, 1.0, 9.0, 10.0)], "frame int, z double")
    protein = spark.createDataFrame([(0, x, y, z) for x in (0.0, 2.0) for y in (0.0, 2.0) for z in (0.4, 5.0)], "frame int, x double, y double, z double")
    boxes = spark.createDataFrame([(0, 10.0, 5.0), (1, 10.0, 5.0)], "frame int, lx double, ly double")
    got = {r["frame"]: r for r in Z.bilayer_areas(heads, protein, boxes, "frame", layer=1.0, radius=1.0).collect()}
    assert got[0]["protein_up"] == 0 and got[0]["protein_low"] == 14.0  # an octagon 4 wide without its corners
    assert (got[0]["lower"], got[0]["upper"], got[0]["mean"]) == (18.0, 25.0, 21.5)
    assert got[1]["mean"] == 25.0 and got[1]["area"] == 50.0


def test_times_of_rows(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "v double")
    assert sorted((r["v"], r["frame"], r["time"]) for r in S.timed(df, "v", 0.5).collect()) == [(1.0, 0, 0.0), (2.0, 1, 0.5), (3.0, 2, 1.0)]


def test_cleaning_chain(spark):
    """P10 against plain Python: zero columns, scaling, importances, decorrelation, components."""
    rng = np.random.default_rng(15)
    n, names = 160, ["z", "a", "b", "c", "d", "e", "f"]
    x = rng.standard_normal((n, 7))
    x[:, 0] = 0
    x[:, 2] = x[:, 1] + 0.05 * rng.standard_normal(n)
    y = (x[:, 1] + 0.5 * x[:, 4] > 0).astype(int)
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], "label int, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    out, parts, shares = L.clean(df, names, "label", keep=4, limit=0.85, k=2, trees=5, depth=4, seed=1)
    s = (x[:, 1:] - x[:, 1:].mean(axis=0)) / np.ptp(x[:, 1:], axis=0)
    importance = brute_importances([(int(c), list(map(float, r))) for c, r in zip(y, s)], 6, 5, 4, 1)
    limit = sorted(importance, reverse=True)[4]
    chosen = [k for k in range(6) if importance[k] > limit]
    r = np.corrcoef(s[:, chosen].T)
    left = [k for i, k in enumerate(chosen) if not any(abs(r[i, j]) > 0.85 for j in range(i + 1, len(chosen)))]
    assert 0 not in left and 1 in left  # a goes for b
    scores, _, want = exact(s[:, left], 2)
    assert np.allclose(shares, want) and len(parts[0]) == len(left)
    by = {round(v, 9): (p, q) for v, p, q in zip(s[:, 3], scores[:, 0], scores[:, 1])}
    assert all(np.allclose(np.abs(by[round(t["d"], 9)]), np.abs((t["PC_0"], t["PC_1"]))) for t in out.collect())
