"""Operators against independently computed values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moltrail.functions import geometry as G
from moltrail.functions import parameters as P
from moltrail.operators import contacts as C
from moltrail.operators import docking as D
from moltrail.operators import features as B
from moltrail.operators import learning as L
from moltrail.operators import ranges
from moltrail.operators import lipids as Z
from moltrail.operators import matrix as M
from moltrail.operators import network as N
from moltrail.operators import series as S
from moltrail.operators import structure as A


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_scalars(spark):
    assert value(spark, G.switch(F.lit(7.0))) == 0.5 and value(spark, G.switch(F.lit(0.0))) == 1
    assert value(spark, G.switch(F.lit(7.0), 7.0, 10, 6)) == 0.6
    assert math.isclose(value(spark, G.switch(F.lit(G.switch_reach(0.2, 8.0)), 8.0)), 0.2)
    assert math.isclose(value(spark, G.angle(lits(1, 0, 0), lits(0, 0, 0), lits(0, 2, 0))), math.pi / 2)
    assert value(spark, G.angle_between(lits(1, 0, 0), lits(-1, 0, 0))) == math.pi
    assert math.isclose(abs(value(spark, G.dihedral(lits(1, 0, 0), lits(0, 0, 0), lits(0, 1, 0), lits(-1, 1, 0)))), math.pi)
    assert math.isclose(value(spark, G.dihedral(lits(1, 0, 0), lits(0, 0, 0), lits(0, 1, 0), lits(0, 1, -1))), math.pi / 2)
    s = 0.34
    assert abs(value(spark, G.lennard_jones(*lits(s, 1, s, 1, s)))) < 1e-12
    assert math.isclose(value(spark, G.lennard_jones(*lits(s, 1, s, 1, s * 2 ** (1 / 6)))), -1)
    assert math.isclose(value(spark, G.coulomb(*lits(1, -1, 10), 1.0)), -138.935485)
    assert [value(spark, G.wrap(F.lit(float(c)), 0, 10)) for c in (-1, 0, 5, 10, 12)] == [9, 10, 5, 0, 2]


@pytest.fixture(scope="module")
def box(spark):
    rng = random.Random(1)
    rows = [(f, k, *(rng.uniform(0, 20) for _ in range(3))) for f in range(4) for k in range(60)]
    return rows, spark.createDataFrame(rows, "frame int, id int, x double, y double, z double")


def test_cells_equal_brute_force(box):
    rows, df = box
    want = {(a[0], a[1], b[1]) for a, b in itertools.permutations(rows, 2) if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= 3.5}
    assert {tuple(r) for r in C.self_pairs(df, 3.5, ["frame"], "id").select("frame", "id_a", "id_b").collect()} == want
    left, right = df.where("id < 2"), df.where("id >= 2 AND id < 5")
    assert C.all_pairs(left, right, ["frame"], ["id"]).count() == 4 * 2 * 3


def test_frames_without_contacts(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 0.0), (1, 2, 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame int, id int, x double, y double, z double")
    pairs = C.self_pairs(df, 2.0, ["frame"], "id")
    assert {tuple(r) for r in C.coordination_number(pairs, df, ["frame"]).collect()} == {(0, 1), (1, 0)}
    assert C.contact_mean(pairs, ["id_a", "id_b"], 2).first()["p"] == 0.5
    kinds = C.frame_types(pairs.withColumn("donor", F.lit(0)), df, "frame", "donor")
    assert {tuple(r) for r in kinds.collect()} == {(0, 2)}


def test_grid_and_first_cell(spark):
    bounds = spark.createDataFrame([("c", 0.0, 2.0, 0.0, 1.0, 0.0, 3.0)], "complex_id string, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    grid = C.grid(bounds, 1.0)
    assert [tuple(r)[1:] for r in grid.orderBy("cell").collect()] == [(k, *p) for k, p in enumerate((x, 0.0, z) for x in (0.0, 1.0) for z in (0.0, 1.0, 2.0))]
    atoms = spark.createDataFrame([("c", 1, 1.1, 0.0, 1.0), ("c", 2, 9.0, 9.0, 9.0)], "complex_id string, atom long, x double, y double, z double")
    assert {(r["atom"], r["cell"]) for r in C.first_cell(grid, atoms, 0.5, ["complex_id"], "atom").collect()} == {(1, 4), (2, -1)}


def test_residue_features(spark):
    cols = "complex_id string, role string, res int, atom_name string, atom_type string, charge double, x double, y double, z double"
    atoms = [("c", "R", 1, "CA", "C", 0.1, 0.0, 0.0, 0.0), ("c", "R", 1, "CB", "C", 0.2, 3.0, 0.0, 0.0), ("c", "R", 2, "N", "N", -0.3, 50.0, 0.0, 0.0), ("c", "L", 9, "O1", "O", -0.5, 4.0, 0.0, 0.0), ("c", "L", 9, "X1", "??", 0.5, 0.0, 6.0, 0.0)]
    df = B.with_parameters(spark.createDataFrame(atoms, cols), P.lennard_jones(spark))
    rows = {r["res"]: r for r in B.residue_features(df, ["res"]).collect()}
    lj = {t: (s, e) for t, _, s, e in P.LENNARD_JONES}

    def energy(a, b):
        (sa, ea), (sb, eb), d = lj.get(a[4], lj["DU"]), lj.get(b[4], lj["DU"]), math.dist(a[6:], b[6:]) / 10
        s6 = ((sa + sb) / 2 / d) ** 6
        return 4 * math.sqrt(ea * eb) * (s6 * s6 - s6), 138.935485 * a[5] * b[5] / (d * 4), 1 / (1 + (d * 10 / 7) ** 6)

    for part, a in (("bb", atoms[0]), ("sc", atoms[1])):
        e = [energy(a, b) for b in atoms[3:]]
        assert math.isclose(rows[1][f"vdw_{part}"], min(10, sum(x[0] for x in e)), rel_tol=1e-9)
        assert math.isclose(rows[1][f"coulomb_{part}"], sum(x[1] for x in e)) and math.isclose(rows[1][f"count_{part}"], sum(x[2] for x in e))
    assert rows[1]["vdw_sc"] == 10 and rows[2]["count_bb"] == 0 and rows[2]["vdw_bb"] == 0
    long = B.feature_table(B.residue_features(df, ["res"]), ["res"])
    wide = B.wide(long).first()
    assert wide["vdwside_1"] == 10 and wide["countback_2"] == 0
    assert B.type_contacts(df, ["C", "O"]).first()["C_O"] == 2
    assert B.net_charge(df).first()["net_charge"] == 0


def test_histograms(spark):
    df = spark.createDataFrame([(float(k), 3.0) for k in range(11)], "v double, c double")
    assert [r["n"] for r in S.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    flat = S.histogram(df, "c", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0, 0, 11, 0] and flat[0]["edge"] == 2.5
    gap = spark.createDataFrame([(0.0,), (0.0,), (3.0,)], "v double")
    assert [round(r["energy"], 6) for r in S.pmf(S.histogram(gap, "v", 3)).orderBy("bin").collect()] == [0, round(-2.5 * math.log(0.5), 6), round(-2.5 * math.log(0.5), 6)]
    assert S.pmf_tool(S.histogram(gap, "v", 4)).where("bin = 1").first()["energy"] == math.inf
    assert S.pmf_tool(S.histogram(gap, "v", 4), finite=True).where("bin = 1").first()["energy"] is None
    two = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    assert math.isclose(S.mutual_information(two, "x", "y", 2).first()["mi"], math.log(2))
    shared = S.shared_histogram(spark.createDataFrame([("a", 0.0), ("b", 3.0)], "s string, v double"), "v", "s", 4, parity=True)
    assert {tuple(r) for r in shared.collect()} == {("a", 0, 1)}


def test_series(spark):
    df = spark.range(10).select(F.col("id").alias("t"), F.lit(0).alias("z"), F.lit(None).cast("int").alias("n"))
    assert S.time_subset(df, "t", 3, 2).count() == 7 and S.time_subset(df, "t", 0, 4).count() == 5
    assert [r["time_ps"] for r in S.stride(df, "t", 4, 2.0).orderBy("t").collect()] == [0, 2, 4]
    assert S.drop_zero_columns(df, ["t", "z"]).columns == ["t", "n"] and S.drop_all_null(df).columns == ["t", "z"]


def test_matrix_and_networks(spark):
    m = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    wide = M.to_wide(m, [0, 1, 2, 3])
    assert {tuple(r) for r in M.from_wide(wide, "row", ["0", "1", "2", "3"]).collect()} == {tuple(r) for r in m.collect()}
    merged = {(r["row"], r["col"]): r["value"] for r in M.merged(m, m.withColumn("value", -F.col("value"))).collect()}
    assert merged[0, 1] == 1 and merged[1, 0] == -10 and merged[2, 2] == -22
    domains = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 3, 3), ("b", 0, 1, 2), ("c", 0, 8, 9)], "name string, part int, lo int, hi int")
    got = {(r["a"], r["b"]): r["value"] for r in M.domain_average(m, domains).collect()}
    assert got["a", "b"] == np.mean([10 * r + c for r in (0, 1, 3) for c in (1, 2)]) and got["a", "c"] is None and len(got) == 9
    a = [1.0, 2.0, 4.0, 8.0]
    t = M.paired_t(m.where("row = 0"), m.where("row = 0").withColumn("value", F.element_at(F.array(*map(F.lit, a)), F.col("col") + 1))).first()
    d = np.arange(4.0) - a
    assert math.isclose(t["t"], d.mean() / (d.std(ddof=1) / 2)) and t["df"] == 3
    p = spark.createDataFrame([(2.228139, 10)], "t double, df int").select(M.t_probability("t", "df").alias("p")).first()["p"]
    assert abs(p - 0.05) < 1e-6
    com = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 3)], "comm_id int, residue int")
    edges = {(r["c1"], r["c2"]): r["weight"] for r in N.community_edges(m, com).collect()}
    assert edges == {(1, 1): 0, (1, 2): 2 + 3 + 12 + 13, (2, 1): 20 + 21 + 30 + 31, (2, 2): 0}
    share = {(r["comm_id"], r["name"]): (r["of_community"], r["of_domain"]) for r in N.domain_shares(com, domains).collect()}
    assert share[1, "a"] == (1, 2 / 3) and share[2, "c"] == (0, 0)


def test_docking(spark):
    rows = [("p", 1, "x", -3.0), ("p", 2, "x", 5.0), ("p", 3, "y", 5.0), ("q", 1, "y", 1.0), ("q", 2, "z", 0.5)]
    df = spark.createDataFrame(rows, "list_id string, line_no int, ligand string, score double")
    last = D.last_wins(df, ["list_id", "ligand"], "line_no")
    assert {(r["list_id"], r["ligand"]): r["score"] for r in last.collect()} == {("p", "x"): 5, ("p", "y"): 5, ("q", "y"): 1, ("q", "z"): 0.5}
    assert [r["ligand"] for r in D.ranked(last, "score", "ligand", ["list_id"]).where("list_id = 'p'").orderBy("rank").collect()] == ["x", "y"]
    assert [r["ligand"] for r in D.common_top(last, 2, "score", "ligand", "list_id").collect()] == ["y"]
    assert value(spark, D.property_number(F.lit(">1,200.5"))) == 1200.5 and value(spark, D.property_number(F.lit("none"))) == 9999


def test_metrics(spark):
    rows = [(k, s, y) for k, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1), (0.1, 0)])]
    df = spark.createDataFrame(rows, "id int, score double, label int")
    pairs = [1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0 for a in rows for b in rows if a[2] == 1 and b[2] == 0]
    assert math.isclose(L.auc(df, "score", "label").first()["auc"], np.mean(pairs))
    assert tuple(L.confusion(df, "score", "label", 0.3).first()) == (2, 1, 2, 1)
    assert L.metrics(L.confusion(df.where("label = 1"), "score", "label", 9)).first()["specificity"] is None
    assert math.isclose(L.enrichment(df, "score", "label", "id", 0.5).first()["enrichment"], 2 / 3 * 2)


def test_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "k").repartition(5)
    folds = L.k_fold(df, "k", 5).orderBy("k").collect()
    assert [r["fold"] for r in folds] == [0] * 21 + [1] * 21 + [2] * 21 + [3] * 20 + [4] * 20
    parts = [r["count"] for r in L.random_groups(df, "k", 4).groupBy("part").count().orderBy("part").collect()]
    assert parts == [25, 25, 25, 28]
    assert L.bootstrap(df, "k", 250).count() == 250


def test_pca_of_the_five_by_two_example(spark):
    x = [(-1.0, -1.0), (-2.0, -1.0), (-3.0, -2.0), (1.0, 1.0), (2.0, 1.0), (3.0, 2.0)]
    df = spark.createDataFrame(x, "a double, b double")
    out, parts, share = L.pca(df, ["a", "b"], 5, "mean")
    c = np.array(x) - np.mean(x, axis=0)
    w, v = np.linalg.eigh(c.T @ c)
    assert np.allclose(share, w[::-1] / w.sum()) and np.allclose(np.abs(parts), np.abs(v[:, ::-1].T))
    got = np.array([[r["PC_0"], r["PC_1"]] for r in out.collect()])
    assert np.allclose(np.sort(np.abs(got), axis=0), np.sort(np.abs(c @ v[:, ::-1]), axis=0))
    z = S.scaled(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"], "zscore").collect()
    assert sorted(tuple(r) for r in z) == [(-1, 0), (1, 0)]


def wide_rows(spark, n):
    return spark.range(0, n, 1, 64).select(F.xxhash64("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))


def test_row_numbers_of_wide_tables(spark):
    """No row is lost or numbered twice, whatever the width and the number of partitions."""
    df = wide_rows(spark, 200_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        rows = ranges.dense_index(df, "k")
        assert tuple(rows.agg(F.count("*"), F.countDistinct("_i"), F.min("_i"), F.max("_i"), F.countDistinct("k")).first()) == (200_000, 200_000, 0, 199_999, 200_000)
        assert rows.where("_i < 5").orderBy("_i").select("k").collect() == df.orderBy("k").select("k").limit(5).collect()
        folds = L.k_fold(df, "k", 5).groupBy("fold").count().collect()
        assert sorted(map(tuple, folds)) == [(k, 40_000) for k in range(5)]
        sums = ranges.running_sums(df.select("k", F.lit(1).alias("one")), [F.desc("k")], {"n": "one"})
        assert tuple(sums.agg(F.count("*"), F.max("n"), F.countDistinct("n")).first()) == (200_000, 200_000, 200_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def projections(x, k):
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return np.abs(u[:, :k] * s[:k]), (s**2 / (s**2).sum())[:k]


def test_components_of_frames(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((7, 3)) * 4
    moved, rows = [], []
    for f in range(12):
        x = base + rng.standard_normal((7, 3)) * [0.8, 0.3, 0.1]
        q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
        q *= np.sign(np.linalg.det(q))
        rows += [(f, k, *map(float, p @ q.T + f)) for k, p in enumerate(x)] + [(f, 99, 0.0, 0.0, 0.0)]
        a, b = x - x.mean(axis=0), base - base.mean(axis=0)
        u, _, v = np.linalg.svd(a.T @ b)
        u[:, 2] *= np.sign(np.linalg.det(u @ v))
        moved.append((a @ u @ v + base.mean(axis=0)).ravel())
    df = spark.createDataFrame(rows, "frame int, atom int, x double, y double, z double")
    ref = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(base)], "atom int, x double, y double, z double")
    out, share = L.xyz_pca(df, ref, "frame", "atom", 3)
    want, part = projections(np.array(moved), 3)
    got = np.array([[r[f"PC_{k}"] for k in range(3)] for r in out.orderBy("frame").collect()])
    assert np.allclose(np.abs(got), want, atol=1e-6) and np.allclose(share, part)


def test_components_of_contacts_and_angles(spark):
    rng = np.random.default_rng(7)
    x = rng.random((15, 6)) * (rng.random((15, 6)) < 0.6)
    x[:, 2], x[4] = 0, 0
    rows = [(f, f"c{k}", float(v)) for f, r in enumerate(x) for k, v in enumerate(r) if v or k == 2]
    frames = spark.range(15).select(F.col("id").cast("int").alias("frame"))
    out, share = L.contact_pca(spark.createDataFrame([r for r in rows if r[0] != 4], "frame int, pair string, w double"), frames, "frame", "pair", "w", 2)
    want, part = projections(np.delete(x, 2, axis=1), 2)
    got = np.array([[r["PC_0"], r["PC_1"]] for r in out.orderBy("frame").collect()])
    assert np.allclose(np.abs(got), want) and np.allclose(share, part)
    a = rng.random((15, 4)) * 6 - 3
    angles = spark.createDataFrame([(f, k, float(v)) for f, r in enumerate(a) for k, v in enumerate(r)], "frame int, t int, angle double")
    out, _, share = L.dihedral_pca(angles, "frame", "t", "angle", [0, 1, 2, 3], 2)
    want, part = projections(np.concatenate([np.cos(a), np.sin(a)], axis=1), 2)
    got = np.array([[r["PC_0"], r["PC_1"]] for r in out.orderBy("frame").collect()])
    assert np.allclose(np.abs(got), want) and np.allclose(share, part)


def test_feature_choice_and_cleaning(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    x = np.stack([y + 0.1 * rng.standard_normal(400), y + 0.1 * rng.standard_normal(400) * 2, rng.standard_normal(400), np.zeros(400), rng.standard_normal(400)], axis=1)
    df = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(y, x)], "label int, a double, b double, c double, zero double, d double")
    columns = ["a", "b", "c", "d"]
    assert set(L.most_important(df, columns, "label", 2, trees=20)) == {"a", "b"}
    assert L.most_important(df, columns, "label", 9, trees=20) == columns
    out, parts, share = L.clean(df, ["a", "b", "c", "zero", "d"], "label", 3, 0.85, 5)
    assert out.count() == 400 and len(parts) == len(share) == 2  # a and b correlate, one of three is left out before


def test_decorrelation(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal(200)
    df = spark.createDataFrame([(float(x), float(x + 0.01 * y), float(y)) for x, y in zip(a, rng.standard_normal(200))], "a double, b double, c double")
    assert L.uncorrelated(df, ["a", "b", "c"]) == ["b", "c"]


def test_superposition_and_axes(spark):
    rng = np.random.default_rng(2)
    ref = rng.standard_normal((12, 3))
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved = ref @ q.T + [3, -1, 2]
    coords = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(moved)], "frame int, atom int, x double, y double, z double")
    base = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(ref)], "atom int, x double, y double, z double")
    got = np.array([[r["x"], r["y"], r["z"]] for r in A.superposed(coords, base, ["frame"], "atom").orderBy("atom").collect()])
    assert np.allclose(got, ref)
    axis = A.axis_fit(coords, ["frame"]).first()["axis"]
    c = moved - moved.mean(axis=0)
    v = np.linalg.svd(c)[2][0]
    assert np.allclose(np.abs(axis), np.abs(v))
    shifted = A.shifted_along_axis(coords, coords, ["frame"], 10.0).orderBy("atom").collect()
    assert np.allclose([r["x"] for r in shifted] - moved[:, 0], 10 * axis[0])
    turned = A.rotated_about_axis(coords, coords, ["frame"], 0.7).orderBy("atom").collect()
    t = np.array([[r["x"], r["y"], r["z"]] for r in turned])
    assert np.allclose(np.linalg.norm(t[:, None] - t[None], axis=-1), np.linalg.norm(moved[:, None] - moved[None], axis=-1))
    plane = A.plane_fit(coords, ["frame"]).first()
    m = np.c_[moved[:, :2], np.ones(12)]
    sol, res, *_ = np.linalg.lstsq(m, moved[:, 2], rcond=None)
    assert np.allclose([plane["a"], plane["b"], plane["c"]], sol) and math.isclose(plane["residual"], math.sqrt(res[0]))


def test_sequences(spark):
    res = spark.createDataFrame([("A", n, c) for n, c in [(3, "G"), (4, "A"), (5, "S"), (8, "T"), (9, "C"), (10, None)]], "chain string, res_seq int, code1 string")
    assert A.chain_sequences(res, ["chain"]).first()["sequence"] == "GAS--TC-"
    gaps = A.missing_ranges(res, ["chain"])
    assert [tuple(r) for r in gaps.collect()] == [("A", 6, 7)]
    assert A.with_letters(gaps, "GASPVTCL", 3, 1).first()["letters"] == "SPVT"


def atoms(spark):
    rows = []
    for r, name in [(1, "ALA"), (2, "GLY"), (4, "SER"), (5, "HOH")]:
        for a in ("N", "CA", "C", "CB") if name != "HOH" else ("O",):
            rows.append(("s", len(rows), len(rows) + 1, "HETATM" if name == "HOH" else "ATOM", a, name, "A", r, a[0], float(r), 0.0, float(len(rows))))
    return spark.createDataFrame(rows, "struct_id string, atom_idx int, serial int, record string, atom_name string, res_name string, chain string, res_seq int, element string, x double, y double, z double")


def test_structures(spark):
    df = atoms(spark)
    quads = {(r["res_seq"], r["kind"]): (r["a"], r["b"], r["c"], r["d"]) for r in A.backbone_dihedrals(df, ["struct_id"]).collect()}
    assert quads == {(2, "phi"): (3, 5, 6, 7), (1, "psi"): (1, 2, 3, 5)}  # residue 3 is missing
    assert A.select_atoms(df, ["A"], 2, 4, "mainchain").count() == 6 and A.select_atoms(df, kind=["CB"]).count() == 3
    assert A.without_hetero(df, []).count() == 12 and A.without_hetero(df, ["HOH"]).count() == 13
    numbers = A.renumbered(df, "struct_id", "atom_idx", chain="Z").orderBy("atom_idx").collect()
    assert [r["res_no"] for r in numbers] == [1] * 4 + [2] * 4 + [3] * 4 + [4] and numbers[-1]["atom_no"] == 13
    assert [r["res_idx"] for r in A.residue_numbers(df, ["struct_id"]).orderBy("atom_idx").collect()] == [0] * 4 + [1] * 4 + [2] * 4 + [3]
    assert {r["res_seq"] for r in A.residues_in_box(df, (4.5, 1, 6.0), 1.0).collect()} == {1}
    spliced = A.spliced(df, df.withColumn("res_seq", F.col("res_seq") + 10), "A", (2, 2), (11, 12))
    assert spliced.count() == 13 - 4 + 8


def test_lipids(spark):
    heads = spark.createDataFrame([(0, z) for z in (0.0, 1.0, 9.0, 10.0)], "frame int, z double")
    assert tuple(Z.leaflets(heads, "frame").first()) == (0, 5, 2, 2, 9)
    pts = spark.createDataFrame([(0, float(x), float(y)) for x in range(4) for y in range(3)], "frame int, x double, y double").repartition(3)
    assert Z.cross_section(pts, "frame").first()["area"] == 6 and Z.cross_section(pts, "frame", parity=True).first()["area"] == 10
    area = spark.createDataFrame([(100.0, 10.0, 20.0, 9, 8)], "area double, protein_up double, protein_low double, n_up int, n_low int")
    assert tuple(Z.area_per_lipid(area).select("upper", "lower", "mean").first()) == (10, 10, 10)
