"""Readers and writers on small files of each format."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from moltrail.operators import contacts as C
from moltrail.sources import files as S
from moltrail.sources import sinks as K
from moltrail.streaming import frames

ATOM = "ATOM  {:5d}  {:<3s} ALA {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           {:1s}"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_models(spark, tmp_path):
    text = "".join(f"MODEL {m}\n" + "".join(ATOM.format(k + 1, n, " ", 1, m, k, 0.5, n[0]) + "\n" for k, n in enumerate(("N", "CA", "C"))) + "ENDMDL\n" for m in (3, 5, 9))
    df = S.read_models(spark, write(tmp_path / "m.pdb", text + "END\n"))
    assert sorted((r["frame"], r["atom_idx"], r["x"], r["chain"]) for r in df.collect()) == [(m, k, float(m), "") for m in (3, 5, 9) for k in range(3)]
    K.write_models(df, str(tmp_path / "out"), "frame", "atom_idx")
    back = S.read_models(spark, str(tmp_path / "out"))
    assert sorted((r["frame"], r["serial"], r["z"]) for r in back.collect()) == [(m, k + 1, 0.5) for m in (3, 5, 9) for k in range(3)]


def test_structures(spark, tmp_path):
    line = "ATOM      1  N   TYR A1021      -1.500   2.250  10.000  1.00  0.00    -0.350 NA"
    r = S.read_pdb(spark, write(tmp_path / "a.pdbqt", "CRYST1   84.160   71.808   87.051  90.00\nROOT\n" + line + "\n"), charges=True).first()
    assert (r["res_seq"], r["x"], r["charge"], r["atom_type"], r["res_name"]) == (1021, -1.5, -0.35, "NA", "TYR")
    assert tuple(S.read_box(spark, str(tmp_path / "a.pdbqt")).first())[1:] == (84.16, 71.808, 87.051)


def test_mol2(spark, tmp_path):
    one = "@<TRIPOS>MOLECULE\n{0}\n1 0\nSMALL\n@<TRIPOS>ATOM\n1 C1 0.5 1.0 2.0 C.3 1 LIG 0.1\n@<TRIPOS>BOND\n"
    m = S.read_mol2(spark, write(tmp_path / "a.mol2", "".join(one.format(n) for n in ("x", "y", "x"))))
    assert [(r["mol_no"], r["name"]) for r in S.mol2_property(m, "MOLECULE", 1).orderBy("mol_no").collect()] == [(0, "x"), (1, "y"), (2, "x")]
    assert {(r["mol_no"], r["x"], r["element"], r["charge"]) for r in S.mol2_atoms(m).collect()} == {(k, 0.5, "C", 0.1) for k in range(3)}


def test_sections(spark, tmp_path):
    path = write(tmp_path / "g.ndx", "[ one ]\n 1 2 3\n4\n\n[ two ]\n7 ; note\n")
    groups = S.read_groups(spark, path)
    assert sorted((r["group"], r["pos"], r["atom_no"]) for r in groups.collect()) == [("one", 0, 1), ("one", 1, 2), ("one", 2, 3), ("one", 3, 4), ("two", 0, 7)]
    lines = {(r["group"], r["line"]): r["text"].split() for r in K.index_lines(groups, 3).collect()}
    assert lines[("one", 1)] == ["1", "2", "3"] and lines[("one", 2)] == ["4"] and lines[("two", 0)] == ["[", "two", "]"]
    itp = write(tmp_path / "l.itp", "[ atoms ]\n; x\n1 c3 1 LIG C1 1 -0.1 12\n2 c3 1 LIG C1 1 0.9 12\n[ bonds ]\n1 2\n")
    assert [tuple(r)[1:] for r in S.read_charges(spark, itp).collect()] == [("LIG", "C1", -0.1)]


def test_small_formats(spark, tmp_path):
    series = S.read_series(spark, write(tmp_path / "a.xvg", "# c\n@ t\n0 1.5 2\n4 2.5 3\n"), [0, 2], ["t", "v"])
    assert [(r["t"], r["v"]) for r in series.orderBy("t").collect()] == [(0, 2), (4, 3)]
    m = S.read_xyz_matrix(spark, write(tmp_path / "m.xyz", "1_ALA 2_GLY 0.5\n"), (1, 0))
    assert tuple(m.first()) == (2, 2, 0.5)
    d = S.read_domains(spark, write(tmp_path / "d.dat", "# x\nA 1 5 9 12\nB 5 7\nbad 3\n"))
    assert sorted(map(tuple, d.collect())) == [("A", 0, 1, 5), ("A", 1, 9, 12), ("B", 0, 5, 7)]
    members, info = S.read_communities(spark, write(tmp_path / "c", "The optimum number of communities is 2 and modularity value is 0.75\nThe residues in community 1 are: 0 1 2 \nThe residues in community 2 are: 9 \n"))
    assert members.count() == 4 and tuple(info.first())[1:] == (2, 0.75)
    r = S.read_rankings(spark, write(tmp_path / "b.lst", "# head\n\n-5.5 1 2 pose.mol2 lig1\n"))
    assert (r.first()["ligand_id"], r.first()["score"], r.first()["pose_path"]) == ("lig1", -5.5, "pose.mol2")
    v = S.read_docking_logs(spark, write(tmp_path / "v.log", " 1 9.9 0 0\nmode | affinity | rmsd\n-----+----\n 1 -7.5 0.0 0.0\n 2 -7.0 1 2\n 3 -6.5 1 2\n 4 -6.0 1 2\n"))
    assert v.first()["scores"] == [-7.5, -7.0, -6.5]
    e = S.read_energy_summary(spark, write(tmp_path / "s", "van der Waal energy = -10.5 +/- 1.5 kJ/mol\nBinding energy = -20 +/- 2.0 kJ/mol\n")).first()
    assert (e["vdw_value"], e["total_std"], e["sasa_value"]) == (-10.5, 2.0, None)
    x = S.read_secondary_structure(spark, write(tmp_path / "x.xpm", 'static char *x[] = {\n/* c */\n"HHE",\n"C~E"\n'))
    assert sorted((r["res_idx"], r["frame"], r["code"]) for r in x.collect()) == [(0, 0, "H"), (0, 1, "H"), (0, 2, "E"), (1, 0, "C"), (1, 1, "~"), (1, 2, "E")]
    assert S.secondary_structure_part(x, (0, 0), 0, -1, 2).count() == 2
    f = S.read_fasta(spark, write(tmp_path / "f.fa", ">a\nMK\nLV\n>b\nGG\n"))
    assert sorted((r["name"], r["sequence"]) for r in f.collect()) == [("a", "MKLV"), ("b", "GG")]
    t = S.read_atom_types(spark, write(tmp_path / "t.dat", "; c\r\nC 6 12.01 0.0 A 3.4e-01 3.6e-01\r\n"))
    assert (t.first()["sigma_nm"], t.first()["eps"]) == (0.34, 0.36)
    frame = S.read_frame_matrices(spark, write(tmp_path / "map_12", "1 2\n3 4\n"))
    assert sorted(map(tuple, frame.collect())) == [(12, 0, 0, 1.0), (12, 0, 1, 2.0), (12, 1, 0, 3.0), (12, 1, 1, 4.0)]
    ids = spark.createDataFrame([("m1",), ("m3",)], "id string")
    p = S.read_properties(spark, write(tmp_path / "p.csv", "id,mw\nm1,5\nm1,6\nm2,7\n"), ids, "id", "mw")
    assert [tuple(r) for r in p.collect()] == [("m1", "6")]


def test_line_readers_of_split_files(spark, tmp_path):
    """Lines read one by one keep their order in a file that is cut into many splits."""
    path = write(tmp_path / "long.xvg", "# t v\n" + "".join(f"{k} {k % 7}\n" for k in range(900_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        rows = S.read_series(spark, path, [0, 1], ["t", "v"])
        assert rows.rdd.getNumPartitions() > 3
        w = Window.partitionBy("file").orderBy("line_no")
        assert tuple(rows.withColumn("d", F.col("t") - F.lag("t").over(w)).agg(F.count("*"), F.min("d"), F.max("d")).first()) == (900_000, 1, 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sections_and_lists(spark, tmp_path):
    rows = S.read_sections(spark, write(tmp_path / "t.top", "; c\n[ atoms ]\n1 C ; x\n\n[ bonds ]\n1 2\n"))
    assert sorted((r["section"], r["text"]) for r in rows.collect()) == [("atoms", "1 C"), ("bonds", "1 2")]
    got = S.read_structure_list(spark, write(tmp_path / "l", "# c\n1abc 2.0 LIG Ki=5nM x\nshort 1\n")).collect()
    assert [tuple(r) for r in got] == [("1abc", 2.0, "LIG", "Ki", "5nM")]
    spark.createDataFrame([(f, 1.0) for f in range(10)], "frame int, x double").write.parquet(str(tmp_path / "trj"))
    assert sorted(r["frame"] for r in S.read_trajectory(spark, str(tmp_path / "trj"), 3, 2, 9).collect()) == [3, 6, 9]


def test_edge_and_restraint_writers(spark, tmp_path):
    K.write_edges(spark.createDataFrame([(0, 1, 2.5)], "a int, b int, w double"), str(tmp_path / "e"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()} == {"0,1,2.5", "a,b,w"}
    rows = K.restraint_lines(spark.createDataFrame([(0, 7)], "pos int, atom_no int")).collect()
    assert [r["text"] for r in rows] == ["     7   1    1000.0    1000.0    1000.0"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.23456), (4, 2.0)], "t int, v double")
    K.write_series(df.coalesce(1), str(tmp_path / "s"), "t")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()) == ["0,1.235", "4,2.000", "t,v"]
    contacts = spark.createDataFrame([(0, 1, 1.0)], "frame int, pair int, w double")
    rows = K.wide_contacts(contacts, spark.range(2).select(F.col("id").cast("int").alias("frame")), "frame", "pair", [0, 1])
    assert sorted(map(tuple, rows.collect())) == [(0, 0.0, 1.0), (1, 0.0, 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f, k, float(k % 3), float(f), 0.0) for f in range(6) for k in range(5)]
    df = spark.createDataFrame(rows, "frame int, id int, x double, y double, z double")
    df.repartition("frame").write.parquet(str(tmp_path / "coords"))
    count = lambda b: C.coordination_number(C.self_pairs(b, 1.0, ["frame"], "id"), b, ["frame"])
    q = frames.each_batch(frames.read_frames(spark, str(tmp_path / "coords"), 1), count, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("frame", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, count(df).collect()))


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of 300 bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "300")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def test_lines_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(2)
    for f in "ab":
        (tmp_path / f).write_text("".join(f"{f}{k} " + "x" * rng.randint(0, 60) + rng.choice(["\n", "\r\n"]) for k in range(200)))
    rows = S.lines(spark, str(tmp_path)).collect()
    assert len({(r["file"], r["split"]) for r in rows}) > 30
    for f in "ab":
        own = sorted((r["split"], r["line_no"], r["text"].split(" ")[0]) for r in rows if r["file"].endswith(f))
        assert [t for _, _, t in own] == [f"{f}{k}" for k in range(200)]


def test_state_goes_over_splits(spark, tmp_path, small_splits):
    """Sections, groups, models, sequences, logs and grids longer than a split, against plain Python."""
    rng = random.Random(3)
    text, want, group, at = "7 8\n", [], None, {}
    for k in range(400):
        if k % 97 == 5:
            group = f"g{k // 97 % 3}"
            text += f"[ {group} ]\n"
        numbers = [rng.randrange(1000) for _ in range(rng.randint(0, 15))]
        text += " ".join(map(str, numbers)) + (" ; note\n" if k % 7 == 0 else "\n")
        for n in numbers if group else []:
            want.append((group, at.get(group, 0), n))
            at[group] = at.get(group, 0) + 1
    got = S.read_groups(spark, write(tmp_path / "g.ndx", text))
    assert sorted((r["group"], r["pos"], r["atom_no"]) for r in got.collect()) == sorted(want)

    models = "".join((f"MODEL {100 + m}\n" if m % 3 else "") + "".join(ATOM.format(k + 1, "CA", "A", k, m, k, 0.5, "C") + "\n" for k in range(9)) + "ENDMDL\n" for m in range(5, 17))
    got = S.read_models(spark, write(tmp_path / "m.pdb", "REMARK\nENDMDL\n" + models))
    assert sorted((r["frame"], r["atom_idx"], r["x"]) for r in got.collect()) == sorted((100 + m if m % 3 else m - 4, k, float(m)) for m in range(5, 17) for k in range(9))
    K.write_models(got.where("frame < 112"), str(tmp_path / "again"), "frame", "atom_idx")
    back = S.read_models(spark, str(tmp_path / "again"))
    assert sorted((r["frame"], r["serial"], r["x"]) for r in back.collect()) == sorted((r["frame"], r["serial"], r["x"]) for r in got.collect() if r["frame"] < 112)
    atoms = S.read_pdb(spark, write(tmp_path / "s.pdb", models)).collect()
    assert sorted((r["atom_idx"], r["x"]) for r in atoms) == [(k, float(5 + k // 9)) for k in range(108)]

    sequence = "".join(rng.choice("ACGT") for _ in range(2000))
    fasta = ">one  of them\n" + "\n".join(sequence[k : k + 60] for k in range(0, 2000, 60)) + "\n>two\nAC\n"
    assert sorted((r["record"], r["name"], r["sequence"]) for r in S.read_fasta(spark, write(tmp_path / "f.fa", fasta)).collect()) == [(1, "one  of them", sequence), (2, "two", "AC")]
    log = " 1 9.9\n" * 80 + "mode | affinity\n" + "note\n" * 80 + " 1 -7.5\n 2 -7.0\n"
    assert S.read_docking_logs(spark, write(tmp_path / "v.log", log)).first()["scores"] == [-7.5, -7.0]
    grid = ["".join(rng.choice("HEC") for _ in range(30)) for _ in range(40)]
    got = S.read_secondary_structure(spark, write(tmp_path / "x.xpm", "/* c */\n" + "".join(f'"{g}",\n' for g in grid))).collect()
    assert {(r["res_idx"], r["frame"]): r["code"] for r in got} == {(i, j): c for i, g in enumerate(grid) for j, c in enumerate(g)}


#: Numbers about the ends of decimals and of both cases, and what five columns hold then.
SERIALS = {-9999: "-9999", 0: "0", 99_999: "99999", 100_000: "A0000", 100_035: "A000Z", 100_036: "A0010", 7_200_000: "E86E8", 43_770_015: "ZZZZZ", 43_770_016: "a0000", 87_440_031: "zzzzz"}


def test_models_of_long_serials(spark, tmp_path):
    """serials past 99999 and residues past 9999 come back as they were."""
    rows = [(k % 3, i, n, 9_990 + 300_000 * i if i < 9 else None) for i, n in enumerate(SERIALS) for k in range(3)]
    atoms = spark.createDataFrame(rows, "frame int, place int, serial int, res_seq int").select("*", *[F.lit(v).alias(c) for c, v in (("record", "ATOM"), ("atom_name", "CA"), ("res_name", "ALA"), ("chain", "A"), ("element", "C"))], *[F.lit(0.5).alias(c) for c in "xyz"])
    texts = {r["serial"]: r["text"][6:11].strip() for r in K.pdb_lines(atoms).collect()}
    assert texts == SERIALS
    atoms = atoms.where("res_seq < 2436112 OR res_seq IS NULL")
    K.write_models(atoms, str(tmp_path / "m"), "frame", "place")
    got = S.read_models(spark, str(tmp_path / "m"))
    key = lambda df: sorted(map(str, df.select("frame", "serial", "res_seq").collect()))
    assert key(got) == key(atoms)
    with pytest.raises(Exception, match="doesn't fit 5 columns"):
        K.pdb_lines(atoms.withColumn("serial", F.lit(87_440_032))).collect()


def test_long_serials_of_structures(spark):
    """as in models."""
    atoms = spark.createDataFrame([("f", i, n) for i, n in enumerate(SERIALS)], "file string, line_no long, serial int").select("*", *[F.lit(v).alias(c) for c, v in (("record", "HETATM"), ("atom_name", "CA"), ("res_name", "ALA"), ("chain", "A"), ("element", "C"), ("res_seq", 7))], *[F.lit(0.5).alias(c) for c in "xyz"])
    got = S.read_pdb(spark, K.pdb_lines(atoms)).orderBy("atom_idx").collect()
    assert [r["serial"] for r in got] == list(SERIALS) and {(r["record"], r["atom_name"], r["res_seq"], r["z"]) for r in got} == {("HETATM", "CA", 7, 0.5)}


def test_long_serials_with_charges(spark, tmp_path):
    """a serial that fills its columns stands beside the record's name; text that is no number is none."""
    line = "HETATM{0:>5s}  N   TYR A{1:>4s}      -1.500   2.250  10.000  1.00  0.00    -0.350 NA"
    path = write(tmp_path / "a.pdbqt", "".join(line.format(*t) + "\n" for t in (("A0001", "A000"), ("99999", "9999"), ("b0", "null"), ("*****", "-12"), ("aZ000", "a00Z"))))
    got = S.read_pdb(spark, path, charges=True).orderBy("atom_idx").collect()
    assert [r["serial"] for r in got] == [100_001, 99_999, None, None, None]
    assert [r["res_seq"] for r in got][:2] == [10_000, 9_999] and got[3]["res_seq"] == -12 and got[4]["res_seq"] is None
    assert {(r["charge"], r["atom_type"]) for r in got} == {(-0.35, "NA")}


def test_index_files_of_many_parts(spark, tmp_path):
    """numbers of seven digits, and groups that are as long as the parts that Spark writes."""
    rows = spark.range(600).select((F.col("id") % 3).cast("string").alias("group"), F.expr("id div 3").alias("pos"), (F.col("id") + 999_900).alias("atom_no"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        K.write_index(rows, str(tmp_path / "i"))
    finally:
        spark.conf.set(key, before)
    files = [p.read_text() for p in (tmp_path / "i").glob("part-*.txt")]
    assert sum("[" in f for f in files) > 1 and all(f.startswith("[") for f in files if f)
    got = S.read_groups(spark, str(tmp_path / "i"))
    assert sorted((r["group"], r["pos"], r["atom_no"]) for r in got.collect()) == sorted(map(tuple, rows.collect()))
