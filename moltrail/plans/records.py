"""Registered queries of readers and writers: lines of each format are made from the driver tables by column
functions and read by the readers, which take a table of lines as well as a path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docking as D
from ..sources import files as R
from ..sources import sinks as K
from .queries import query, table


def _part(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), F.col("p_brand").alias("file"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def _lines(rows, *texts):
    """Each row's texts as lines, in the order of k."""
    n = len(texts)
    return rows.select("file", F.posexplode(F.array(*texts)).alias("_j", "text"), "k").select("file", (F.col("k") * n + F.col("_j") + 1).alias("line_no"), "text")


def _text(pattern, *columns):
    return F.format_string(pattern, *columns)


def _atoms(spark, d):
    pick = lambda key, *v: F.element_at(F.array(*map(F.lit, v)), (F.expr(key) + 1).cast("int"))
    rows = _part(spark, d)
    return rows.select("file", "k", (F.col("k") + 1).alias("serial"), pick("k % 3", "ATOM", "ATOM", "HETATM").alias("record"), pick("k % 5", "N", "CA", "C", "O", "HB12").alias("atom_name"), pick("size % 3", "ALA", "GLY", "HOH").alias("res_name"), pick("k % 2", "A", "B").alias("chain"), F.col("size").alias("res_seq"), *[((F.col("k") % m - 100) / 8).alias(c) for c, m in (("x", 777), ("y", 555), ("z", 333))], pick("k % 5", "N", "C", "C", "O", "H").alias("element"))


ATOMS = """SELECT p_brand AS file, p_partkey AS k, p_partkey + 1 AS serial, ['ATOM','ATOM','HETATM'][p_partkey % 3 + 1] AS record, ['N','CA','C','O','HB12'][p_partkey % 5 + 1] AS atom_name, ['ALA','GLY','HOH'][p_size % 3 + 1] AS res_name,
 ['A','B'][p_partkey % 2 + 1] AS chain, p_size AS res_seq, (p_partkey % 777 - 100) / 8.0::DOUBLE AS x, (p_partkey % 555 - 100) / 8.0::DOUBLE AS y, (p_partkey % 333 - 100) / 8.0::DOUBLE AS z, ['N','C','C','O','H'][p_partkey % 5 + 1] AS element FROM part"""
ATOM = "record, serial, atom_name, res_name, chain, res_seq, x, y, z, element"


@query(f"SELECT file AS struct_id, {ATOM}, row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS atom_idx FROM ({ATOMS})")
def pdb_atoms(spark, d):
    """Atoms written as PDB lines and read."""
    rows = K.pdb_lines(_atoms(spark, d)).select("file", F.col("k").alias("line_no"), "text")
    other = _lines(_part(spark, d).where("k % 10 = 0"), _text("REMARK %d", "k"), F.lit("TER"))
    return R.read_pdb(spark, rows.unionByName(other.withColumn("line_no", F.col("line_no") * 0 - 1))).select("struct_id", *ATOM.split(", "), "atom_idx")


@query(f"SELECT file AS struct_id, serial, (k % 9 - 4) / 8.0::DOUBLE AS charge, ['CT','N','OS'][k % 3 + 1] AS atom_type FROM ({ATOMS})")
def pdbqt_atoms(spark, d):
    """The last two fields of a PDBQT line are charge and type."""
    kind = F.element_at(F.array(*map(F.lit, ("CT", "N", "OS"))), (F.col("k") % 3 + 1).cast("int"))
    rows = K.pdb_lines(_atoms(spark, d)).select("file", F.col("k").alias("line_no"), F.concat(F.substring("text", 1, 66), F.lit("    "), ((F.col("k") % 9 - 4) / 8).cast("string"), F.lit(" "), kind).alias("text"))
    return R.read_pdb(spark, rows, charges=True).select("struct_id", "serial", "charge", "atom_type")


@query(f"SELECT 'all' AS struct_id, res_seq AS frame, {ATOM} FROM ({ATOMS})")
def model_frames(spark, d):
    """A frame for each residue number, written as MODEL records and read."""
    texts = K.model_lines(_atoms(spark, d).withColumn("frame", F.col("res_seq")), "frame", "k")
    rows = texts.select(F.lit("all").alias("file"), ((F.col("frame") * 4 + F.col("part")) * (1 << 40) + F.coalesce("order", F.lit(0))).alias("line_no"), "text")
    return R.read_models(spark, rows).select("struct_id", "frame", *ATOM.split(", "))


@query("SELECT p_brand AS file, mol_no, 'lig' || p_partkey AS name, u AS serial, ['C1','N2'][u] AS atom_name, ['C.3','N.am'][u] AS atom_type, ['C','N'][u] AS element, p_partkey / 8.0::DOUBLE AS x, p_size / 4.0::DOUBLE AS y, u::DOUBLE AS z, u / 4.0::DOUBLE AS charge FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS mol_no FROM part), (SELECT unnest([1, 2]) AS u)")
def mol2_molecules(spark, d):
    """Molecules of two atoms."""
    text = F.concat(F.lit("\n"), _text("lig%d\n 2 1 1\nSMALL\n\n@<TRIPOS>ATOM\n", "k"), *[_text(f"  {u} {name} %.4f %.4f {u}.0000 {kind} 1 LIG {u / 4}\n", F.col("k") / 8, F.col("size") / 4) for u, name, kind in ((1, "C1", "C.3"), (2, "N2", "N.am"))], F.lit("@<TRIPOS>BOND\n 1 1 2 1\n"))
    mol2 = R.read_mol2(spark, _part(spark, d).select("file", F.col("k").alias("place"), text.alias("value")))
    return R.mol2_atoms(mol2).select("file", "mol_no", "name", "serial", "atom_name", "atom_type", "element", "x", "y", "z", "charge")


@query("SELECT p_brand AS file, 'lig' || p_partkey AS name, p_retailprice::VARCHAR AS value FROM part WHERE p_size > 25")
def mol2_values(spark, d):
    """A property's line, changed and read, of chosen molecules."""
    text = F.concat(F.lit("\n"), _text("lig%d\n@<TRIPOS>PROPERTY\nscore none\n", "k"))
    rows = _part(spark, d).select("file", F.col("k").alias("place"), text.alias("value"))
    chosen = _part(spark, d).where("size > 25").select(_text("lig%d", "k").alias("name"), F.col("price").cast("string").alias("new"))
    mol2 = D.select_molecule(R.read_mol2(spark, rows), chosen, "name").join(chosen, "name")
    changed = D.replace_field(mol2, "PROPERTY", 1, 1, F.col("new"))
    return R.mol2_property(changed, "PROPERTY", 1).select("file", "name", F.substring_index("value", " ", -1).alias("value"))


@query("SELECT 'e' AS file, 'g' || label AS \"group\", row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id AS atom_no FROM embeddings")
def index_groups(spark, d):
    """Groups written as an index file, with its headers, and read."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("l"), F.col("vec_id").alias("atom_no"))
    pos = e.groupBy("l").agg(F.array_sort(F.collect_list("atom_no")).alias("a")).select(F.concat(F.lit("g"), "l").alias("group"), F.posexplode("a").alias("pos", "atom_no"))
    lines = K.index_lines(pos).select(F.lit("e").alias("file"), (F.expr("cast(substr(group, 2) as int) * 1000000L") + F.col("line")).alias("line_no"), "text")
    return R.read_groups(spark, lines)


@query("SELECT p_brand AS file, 'position_restraints' AS section, lpad((p_partkey)::VARCHAR, 6, ' ') AS atom, '1000.0' AS force FROM part")
def restraint_records(spark, d):
    """Position restraints, written as a section and read."""
    part = _part(spark, d)
    rows = K.restraint_lines(part.select(F.col("k").alias("pos"), F.col("k").alias("atom_no"))).join(part.select(F.col("k").alias("pos"), "file"), "pos")
    heads = part.select("file").distinct().select("file", F.posexplode(F.array(F.lit("; made by hand"), F.lit("[ position_restraints ]"), F.lit(""))).alias("j", "text")).select("file", (F.col("j") - 9).cast("long").alias("line_no"), "text")
    got = R.read_sections(spark, heads.unionByName(rows.select("file", F.col("pos").alias("line_no"), F.concat("text", F.lit(" ; x")).alias("text"))))
    f = R.fields("text")
    return got.select("file", "section", F.lpad(f[0], 6, " ").alias("atom"), f[2].alias("force"))


@query("SELECT p_brand AS file, 'R' || p_size AS res_name, 'A' || p_partkey % 4 AS atom_name, min_by(p_partkey % 11 / 8.0::DOUBLE, p_partkey) AS charge FROM part GROUP BY 1, 2, 3")
def itp_charges(spark, d):
    """Charges of [ atoms ], not of [ bonds ]; the first of equal keys."""
    part = _part(spark, d)
    body = _lines(part, _text("%d  CT  1  R%d  A%d  1  %.3f  12.01", "k", "size", F.col("k") % 4, F.col("k") % 11 / 8))
    head = part.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("line_no"), F.lit("[ atoms ]").alias("text")), F.struct(F.lit(1 << 40).alias("line_no"), F.lit("[ bonds ]").alias("text")), F.struct(F.lit((1 << 40) + 1).alias("line_no"), F.lit("1 2 1 R1 A1 1 9.0").alias("text"))))).select("file", "col.*")
    return R.read_charges(spark, body.unionByName(head))


@query("SELECT event_id::DOUBLE AS time, round(value, 3) AS value FROM events")
def series_values(spark, d):
    """The first and third columns of lines with comments between them."""
    rows = table(spark, d, "events").select(F.lit("f").alias("file"), F.col("event_id").alias("k"), "value", "user_id")
    return R.read_series(spark, _lines(rows, F.lit("# note"), F.lit("@ legend"), F.concat_ws(" ", F.lit(""), F.col("k"), F.col("user_id"), F.round("value", 3))), [0, 2], ["time", "value"]).select("time", "value")


@query("SELECT p_partkey + 1.0::DOUBLE AS \"row\", p_size::DOUBLE AS col, p_partkey % 9 / 8.0::DOUBLE AS value FROM part")
def xyz_cells(spark, d):
    """Labelled cells, shifted."""
    return R.read_xyz_matrix(spark, _lines(_part(spark, d), F.lit("# cells"), _text("%d_ALA %d_GLY %.3f", "k", "size", F.col("k") % 9 / 8)), (1, 0))


@query("SELECT 'd' || p_partkey AS name, u AS part, CASE u WHEN 0 THEN p_size ELSE p_size + 100 END AS lo, CASE u WHEN 0 THEN p_size + 5 ELSE p_size + 120 END AS hi FROM part, (SELECT unnest([0, 1]) AS u) WHERE u = 0 OR p_partkey % 2 = 0")
def domain_lines(spark, d):
    """One range, or two."""
    k, s = F.col("k"), F.col("size")
    return R.read_domains(spark, _lines(_part(spark, d), F.lit("# name lo hi"), F.when(k % 2 == 0, _text("d%d %d %d %d %d", k, s, s + 5, s + 100, s + 120)).otherwise(_text("d%d %d %d", k, s, s + 5)), F.lit("short 1")))


@query("SELECT p_brand AS file, p_size AS comm_id, p_partkey AS residue FROM part")
def community_members(spark, d):
    """Members of communities."""
    rows = _part(spark, d).groupBy("file", "size").agg(F.array_join(F.array_sort(F.collect_list("k")), " ").alias("m"))
    rows = rows.select("file", F.col("size").alias("k"), F.concat(_text("The residues in community %d are: ", "size"), "m").alias("t"))
    return R.read_communities(spark, _lines(rows, F.col("t"), F.lit("")))[0]


@query("SELECT p_brand AS file, count(*)::INT AS communities, round(max(p_size) / 64.0::DOUBLE, 6) AS modularity FROM part GROUP BY 1")
def community_modularity(spark, d):
    """The line of the best division."""
    rows = _part(spark, d).groupBy("file").agg(F.count("*").alias("k"), F.max("size").alias("m"))
    return R.read_communities(spark, _lines(rows, _text("The optimum number of communities is %d and modularity value is %.6f", "k", F.col("m") / 64)))[1]


@query("SELECT o_orderstatus AS list_id, o_custkey::VARCHAR AS ligand_id, max_by(o_totalprice, o_orderkey) AS score, max_by('p' || o_orderkey, o_orderkey) AS pose_path FROM orders GROUP BY 1, 2")
def ranking_lists(spark, d):
    """Lists of scores, of repeated ligands the last line."""
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice")
    got = R.read_rankings(spark, _lines(rows, F.lit("# score"), F.lit(""), F.concat_ws("  ", F.col("o_totalprice"), F.lit("0.1"), F.concat(F.lit("p"), "k"), F.col("o_custkey"))))
    return D.last_wins(got, ["list_id", "ligand_id"], "line_no").select("list_id", "ligand_id", "score", "pose_path")


@query("SELECT p_partkey::VARCHAR AS file, [-p_size / 4.0::DOUBLE, -p_size / 8.0::DOUBLE, -1.0::DOUBLE] AS scores FROM part")
def docking_logs(spark, d):
    """The first three modes after the affinity header."""
    part = _part(spark, d).withColumn("file", F.col("k").cast("string"))
    s = F.col("size")
    return R.read_docking_logs(spark, _lines(part, F.lit("1 99 0 0"), F.lit("mode |   affinity | dist"), F.lit("-----+----"), _text("   1  %.3f 0 0", -s / 4), _text("   2  %.3f 1 2", -s / 8), F.lit("   3  -1.000 1 2"), F.lit("   4  -0.5 1 2")))


@query("SELECT p_partkey::VARCHAR AS file, p_size / 8.0::DOUBLE AS vdw_value, 0.5::DOUBLE AS vdw_std, -p_retailprice AS total_value, p_size / 4.0::DOUBLE AS total_std FROM part")
def energy_summaries(spark, d):
    """Terms with deviations."""
    part = _part(spark, d).withColumn("file", F.col("k").cast("string"))
    rows = R.read_energy_summary(spark, _lines(part, _text(" van der Waal energy  = %.3f +/- 0.5 kJ/mol", F.col("size") / 8), F.concat(F.lit(" Binding energy = "), -F.col("price"), F.lit(" +/- "), F.col("size") / 4, F.lit(" kJ/mol")), F.lit(" Total = 3")))
    return rows.select("file", "vdw_value", "vdw_std", "total_value", "total_std")


@query("SELECT file, res_idx, frame, ['H','E','C','~'][(k + frame) % 4 + 1] AS code FROM (SELECT p_brand AS file, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS res_idx FROM part), (SELECT unnest(range(1, 6, 2))::INT AS frame) WHERE res_idx BETWEEN 1 AND 6")
def secondary_structure(spark, d):
    """Residues 1 to 6 and every second frame from 1 to 5 of grids of seven frames."""
    codes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.element_at(F.array(*map(F.lit, "HEC~")), ((F.col("k") + j) % 4 + 1).cast("int"))), "")
    grid = R.read_secondary_structure(spark, _lines(_part(spark, d), F.lit("/* x-axis: 1 2 */"), F.concat(F.lit('"'), codes, F.lit('",'))))
    return R.secondary_structure_part(grid, (1, 6), 1, 5, 2).select("file", "res_idx", "frame", "code")


@query("SELECT 'c' || p_partkey AS code, p_size / 8.0::DOUBLE AS resolution, 'L' || p_size AS ligand, ['Ki','Kd','IC'][p_partkey % 3 + 1] AS k_type, p_size || 'nM' AS k_value FROM part")
def structure_list(spark, d):
    """Structures with affinities."""
    kind = F.element_at(F.array(*map(F.lit, ("Ki=", "Kd<", "IC~"))), (F.col("k") % 3 + 1).cast("int"))
    return R.read_structure_list(spark, _lines(_part(spark, d), F.lit("# code resolution ligand affinity"), F.concat(_text("c%d %.3f L%d ", "k", F.col("size") / 8, "size"), kind, _text("%dnM", "size"))))


@query("SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS record, 's' || p_partkey AS name, repeat('AC', p_size) || 'G' AS sequence FROM part")
def fasta_records(spark, d):
    """Sequences over two lines."""
    return R.read_fasta(spark, _lines(_part(spark, d), _text(">s%d", "k"), F.repeat(F.lit("AC"), F.col("size")), F.lit("G"))).select("file", F.col("record").cast("long").alias("record"), "name", "sequence")


@query("SELECT 'T' || p_partkey AS atom_type, p_size AS z_number, p_size * 2.0::DOUBLE AS mass, 0.0::DOUBLE AS charge, p_size / 128.0::DOUBLE AS sigma_nm, p_size / 64.0::DOUBLE AS eps FROM part")
def atom_type_lines(spark, d):
    """Lennard-Jones parameters."""
    s = F.col("size")
    return R.read_atom_types(spark, _lines(_part(spark, d), F.lit("; type"), _text(" T%d %d %.1f 0.0 A %.7f %.7f", "k", s, s * 2.0, s / 128, s / 64)))


@query("SELECT p_size AS z_number, 'E' || p_partkey AS element, 'name' || p_partkey AS name, p_size / 16.0::DOUBLE AS electronegativity FROM part")
def element_lines(spark, d):
    """Elements."""
    return R.read_elements(spark, _lines(_part(spark, d), F.lit("# z"), _text("%d E%d name%d %.4f", "size", "k", "k", F.col("size") / 16)))


@query("SELECT 'C' || p_partkey AS code3, ['A','B'][p_partkey % 2 + 1] AS code1 FROM part")
def residue_code_lines(spark, d):
    """Residue codes beside atom lines."""
    one = F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("k") % 2 + 1).cast("int"))
    return R.read_residue_codes(spark, _lines(_part(spark, d), F.concat(_text("RES 1 C%d ", "k"), one), F.lit("ATOM base N1")))


@query("SELECT 'N' || p_partkey AS atom_name, ['base','sugar'][p_partkey % 2 + 1] AS subgroup FROM part")
def atom_part_lines(spark, d):
    """Parts of nucleic acids beside residue lines."""
    part = F.element_at(F.array(F.lit("base"), F.lit("sugar")), (F.col("k") % 2 + 1).cast("int"))
    return R.read_atom_parts(spark, _lines(_part(spark, d), F.concat(F.lit("ATOM "), part, _text(" N%d", "k")), F.lit("RES 1 ADE A")))


@query("SELECT p_partkey::VARCHAR AS file, p_size / 8.0::DOUBLE AS lx, p_size / 4.0::DOUBLE AS ly, p_size::DOUBLE AS lz FROM part")
def box_lines(spark, d):
    """Boxes."""
    s = F.col("size")
    return R.read_box(spark, _lines(_part(spark, d).withColumn("file", F.col("k").cast("string")), _text("CRYST1 %8.3f %8.3f %8.3f  90.00  90.00  90.00 P 1", s / 8, s / 4, s * 1.0), F.lit("ATOM")))


@query("SELECT frame, \"row\", c AS col, (k + c) / 8.0::DOUBLE AS value FROM (SELECT p_size AS frame, p_partkey AS k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS \"row\" FROM part), (SELECT unnest([0, 1, 2]) AS c)")
def frame_matrices(spark, d):
    """A matrix of three columns for each frame, named by its file."""
    part = _part(spark, d).withColumn("file", _text("/x/map_1_%d.dat", "size"))
    return R.read_frame_matrices(spark, _lines(part, F.lit("# map"), _text("%.3f %.3f  %.3f", *[(F.col("k") + c) / 8 for c in range(3)])))


@query("SELECT id, max_by(v, o_orderkey)::VARCHAR AS value FROM (SELECT 'c' || o_custkey AS id, o_orderkey, o_orderkey % 97 AS v FROM orders) WHERE id IN (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1")
def csv_properties(spark, d):
    """A named column for ids, of repeated ones the last line."""
    rows = table(spark, d, "orders").select(F.lit("p.csv").alias("file"), F.col("o_orderkey").alias("k"), "o_custkey")
    body = _lines(rows, _text("c%d, x, %d", "o_custkey", F.col("k") % 97)).withColumn("line_no", F.col("line_no") + 1)
    head = spark.range(1).select(F.lit("p.csv").alias("file"), F.lit(1).cast("long").alias("line_no"), F.lit("id,other, wanted").alias("text"))
    ids = table(spark, d, "customer").where("c_nationkey < 12").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return R.read_properties(spark, head.unionByName(body), ids, "id", "wanted")
