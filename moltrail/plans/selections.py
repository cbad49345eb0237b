"""Registered queries of selections, joins of structures and ligands, lists, splits and coordinate functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import parameters as P
from ..operators import contacts as C
from ..operators import docking as D
from ..operators import features as B
from ..operators import learning as L
from ..operators import lipids as Z
from ..operators import series as S
from ..operators import structure as A
from ..sources import files as R
from .queries import COMPLEX, LABELLED, LJ_VALUES, PAIRS, POINTS, complexes, labelled, points, query, rounded, table
from .structures import ATOMS, atoms, pick

RECORD = "rec AS (SELECT *, ['ATOM','ATOM','HETATM'][atom_idx % 3 + 1] AS record, CASE WHEN atom_idx % 11 = 0 THEN 'XXA' ELSE atom_name END AS atom_name_x FROM atm)"


def recorded(spark, d):
    return atoms(spark, d).withColumn("record", pick("atom_idx % 3", ["ATOM", "ATOM", "HETATM"]))


# --- atoms and frames


@query("SELECT label AS frame, vec_id, embedding[1]::DOUBLE AS x FROM embeddings WHERE label BETWEEN 1 AND 8 AND label % 2 = 0")
def strided_scan(spark, d):
    """S3."""
    return R.read_trajectory(spark, f"{d}/embeddings.parquet", 2, 1, 8, "label").select(F.col("label").alias("frame"), "vec_id", F.col("embedding")[0].cast("double").alias("x"))


@query(f"WITH {ATOMS} SELECT serial, chain, x, y, z FROM atm WHERE serial IN (SELECT o_custkey FROM orders)")
def atoms_by_serial(spark, d):
    """F5."""
    return A.by_serials(atoms(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("serial"))).select("serial", "chain", "x", "y", "z")


@query(f"WITH {ATOMS} SELECT chain, serial, row_number() OVER (PARTITION BY chain ORDER BY atom_idx) - 1 AS pos FROM atm")
def atom_positions(spark, d):
    """0-based places and original serials."""
    return A.positions(atoms(spark, d), ["chain"]).select("chain", "serial", "pos")


@query(f"WITH {ATOMS} SELECT chain, CASE WHEN res_name = 'SER' THEN 'L' ELSE 'R' END AS role, count(*) AS n FROM atm GROUP BY 1, 2")
def receptor_ligand(spark, d):
    """F6."""
    return B.split_roles(atoms(spark, d), "SER").groupBy("chain", "role").agg(F.count("*").alias("n"))


@query(f"WITH {ATOMS}, {RECORD} SELECT serial, chain, res_name, record FROM rec WHERE (chain IN ('Brand#1', 'Brand#2') AND record = 'ATOM') OR (res_name = 'HOH' AND chain = 'Brand#3')")
def chains_and_ligand(spark, d):
    """F7."""
    return A.keep_chains_and_ligand(recorded(spark, d), ["Brand#1", "Brand#2"], "HOH", "Brand#3").select("serial", "chain", "res_name", "record")


@query(f"WITH {ATOMS}, {RECORD} SELECT serial, 'kept' AS mode FROM rec WHERE NOT (record = 'HETATM' AND res_name <> 'GLY') UNION ALL SELECT serial, 'water' FROM rec WHERE NOT (record = 'HETATM' AND res_name = 'HOH') AND chain IN ('Brand#1', 'Brand#4')")
def cleaned_hetero(spark, d):
    """F8: both ways."""
    kept = A.without_hetero(recorded(spark, d), ["GLY"]).select("serial", F.lit("kept").alias("mode"))
    return kept.unionByName(A.without_hetero(recorded(spark, d), [], ["Brand#1", "Brand#4"], True).select("serial", F.lit("water").alias("mode")))


@query(f"WITH {ATOMS}, {RECORD} SELECT serial, atom_name_x AS atom_name FROM rec WHERE atom_name_x NOT LIKE '%XX%'")
def real_atoms(spark, d):
    """F9."""
    rows = atoms(spark, d).withColumn("atom_name", F.when(F.col("atom_idx") % 11 == 0, "XXA").otherwise(F.col("atom_name")))
    return A.without_lone_pairs(rows).select("serial", "atom_name")


@query(f"WITH {ATOMS} SELECT serial, CASE WHEN chain <> 'Brand#1' OR res_seq < 10 THEN 0 ELSE 2 END AS part FROM atm WHERE chain <> 'Brand#1' OR res_seq < 10 OR res_seq > 20 UNION ALL SELECT serial, 1 FROM atm WHERE chain = 'Brand#2' AND res_seq BETWEEN 12 AND 18")
def spliced_residues(spark, d):
    """residues of a chain replaced by those of a model."""
    a = atoms(spark, d)
    return A.spliced(a, a.where("chain = 'Brand#2'"), "Brand#1", (10, 20), (12, 18)).select("serial", "part")


@query(f"WITH {ATOMS} SELECT serial FROM atm WHERE (chain, res_seq) NOT IN (SELECT p_brand, p_size FROM part WHERE p_partkey % 5 = 0)")
def without_residues(spark, d):
    """F10."""
    gone = table(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_brand").alias("chain"), F.col("p_size").alias("res_seq"))
    return A.without_residues(atoms(spark, d), gone).select("serial")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS some FROM orders")
def null_columns(spark, d):
    """F16."""
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("double").alias("none"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("some"))
    return S.drop_all_null(S.drop_all_null(rows), "rows")


@query(f"WITH {ATOMS} SELECT serial, z FROM atm WHERE res_name IN ('ALA', 'GLY', 'SER') AND z > 5 AND z < 20")
def slab_atoms(spark, d):
    """F18."""
    return A.in_slab(atoms(spark, d), 5, 20).select("serial", "z")


@query(f"WITH {ATOMS} SELECT chain, serial, z FROM atm WHERE res_name IN ('HOH', 'SER') AND atom_name IN ('N', 'CB')")
def lipid_heads(spark, d):
    """F19."""
    return Z.head_atoms(atoms(spark, d), ["HOH", "SER"], ["N", "CB"]).select("chain", "serial", "z")


@query(f"WITH {ATOMS}, out AS (SELECT DISTINCT chain, res_seq FROM atm WHERE res_name IN ('HOH', 'SER') AND atom_name = 'CA' AND NOT (x BETWEEN 0 AND 12 AND y BETWEEN 0 AND 60)) SELECT serial FROM atm WHERE res_name IN ('HOH', 'SER') AND NOT EXISTS (SELECT 1 FROM out WHERE out.chain = atm.chain AND out.res_seq = atm.res_seq)")
def lipids_in_box(spark, d):
    """F21."""
    return A.lipids_in_box(atoms(spark, d), (12, 60), "CA", ["HOH", "SER"]).select("serial")


@query(f"WITH {POINTS} SELECT id, frame, 'list' AS how FROM pts WHERE frame IN (1, 4, 7) UNION ALL SELECT id, frame, 'first' FROM pts WHERE frame < 3")
def chosen_frames(spark, d):
    """F22."""
    p = points(spark, d)
    return A.frames(p, [1, 4, 7]).select("id", "frame", F.lit("list").alias("how")).unionByName(A.frames(p, first=3).select("id", "frame", F.lit("first").alias("how")))


# --- pairs


@query(f"WITH {POINTS} SELECT a.frame, count(*) AS n, round(avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 6) + 0.0 AS d FROM pts a JOIN pts b ON a.frame = b.frame AND a.id % 5 = 0 AND b.id % 5 = 1 GROUP BY 1")
def group_distances(spark, d):
    """Every pair of two groups within a frame."""
    p = points(spark, d)
    rows = C.all_pairs(p.where("id % 5 = 0"), p.where("id % 5 = 1"), ["frame"], ["id"])
    return rounded(rows.groupBy("frame").agg(F.count("*").alias("n"), F.avg("d").alias("d")), "d")


@query(f"WITH {POINTS}, {PAIRS} SELECT frame, count(*) AS n, round(sum(1.0 / (1.0 + pow(d / 0.2, 6))), 6) + 0.0 AS w FROM prs GROUP BY frame")
def soft_contact_all(spark, d):
    """Soft contacts of all pairs, however far."""
    p = points(spark, d)
    rows = C.all_soft_pairs(p, p, 0.1, ["frame"], ["id"]).where("id_a < id_b")
    return rounded(rows.groupBy("frame").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "w")


@query(f"WITH {COMPLEX} SELECT complex_id, count(*) AS n, round(min(d), 6) + 0.0 AS nearest FROM cp GROUP BY 1")
def complex_pairs(spark, d):
    """Every pair of receptor and ligand atoms of a complex."""
    a = complexes(spark, d)
    rows = C.all_pairs(a.where("role = 'R'"), a.where("role = 'L'"), ["complex_id"], ["vec_id"])
    return rounded(rows.groupBy("complex_id").agg(F.count("*").alias("n"), F.min("d").alias("nearest")), "nearest")


@query(f"WITH lj(t, s, e) AS (VALUES {LJ_VALUES}), a AS (SELECT vec_id, ['N1+', 'CL', 'BR', 'Q', 'C'][vec_id % 5 + 1] AS atom_type, ['N', 'Cl', 'Br', 'DU', 'C'][vec_id % 5 + 1] AS t FROM embeddings) SELECT vec_id, atom_type, s::DOUBLE AS sigma_nm, e::DOUBLE AS eps FROM a JOIN lj USING (t)")
def aliased_parameters(spark, d):
    """Other spellings of types, and unknown ones."""
    rows = table(spark, d, "embeddings").select("vec_id", pick("vec_id % 5", ["N1+", "CL", "BR", "Q", "C"]).alias("atom_type"))
    return B.with_parameters(rows, P.lennard_jones(spark)).select("vec_id", "atom_type", "sigma_nm", "eps")


KINDS = [("ALA", "protein"), ("GLY", "protein"), ("SER", "protein")]
PARTS = [("N", "protein", "backbone"), ("CA", "protein", "backbone"), ("CB", "protein", "sidechain")]


@query(f"WITH {ATOMS} SELECT serial, coalesce(CASE WHEN res_name <> 'HOH' THEN 'protein' END, 'Unknown') AS mol_type, CASE WHEN res_name = 'HOH' THEN 'Unknown' WHEN atom_name IN ('N', 'CA') THEN 'backbone' WHEN atom_name = 'CB' THEN 'sidechain' ELSE 'Unknown' END AS subgroup, CASE element WHEN 'N' THEN 7 WHEN 'C' THEN 6 END AS z_number, element = 'H' AS is_h FROM atm")
def annotated_atoms(spark, d):
    """J10."""
    kinds, parts = spark.createDataFrame(KINDS, "res_name string, mol_type string"), spark.createDataFrame(PARTS, "atom_name string, mol_type string, subgroup string")
    elements = spark.createDataFrame([("N", 7), ("C", 6)], "element string, z_number int")
    return A.annotated(atoms(spark, d), kinds, parts, elements).select("serial", "mol_type", "subgroup", "z_number", "is_h")


@query(f"WITH {ATOMS}, t(atom_name, position) AS (VALUES ('O', 0), ('N', 1), ('CB', 2)) SELECT chain, serial, row_number() OVER (PARTITION BY chain ORDER BY position, atom_idx)::INT AS atom_no, count(*) OVER (PARTITION BY chain) AS n_atoms, 3 AS n_template FROM atm JOIN t USING (atom_name)")
def template_order(spark, d):
    """J12."""
    template = spark.createDataFrame([("O", 0), ("N", 1), ("CB", 2)], "atom_name string, position int")
    return A.in_template_order(atoms(spark, d), template, "chain").select("chain", "serial", "atom_no", "n_atoms", F.col("n_template").cast("int").alias("n_template"))


@query(f"WITH {ATOMS}, lig AS (SELECT label AS ligand_id, vec_id AS serial FROM embeddings) SELECT l.ligand_id, a.serial, 0 AS part FROM (SELECT serial FROM atm WHERE chain = 'Brand#1') a, (SELECT DISTINCT ligand_id FROM lig) l UNION ALL SELECT ligand_id, serial, 1 FROM lig")
def receptor_with_poses(spark, d):
    """J14."""
    poses = table(spark, d, "embeddings").select(F.col("label").alias("ligand_id"), F.col("vec_id").alias("serial"))
    return D.complexes(atoms(spark, d).where("chain = 'Brand#1'").select("serial"), poses).select("ligand_id", "serial", "part")


# --- series and lists


@query("WITH h AS (SELECT (event_id % 37)::INT AS bin, count(*) FILTER (value > 60) AS n FROM events GROUP BY 1), v AS (SELECT *, CASE WHEN n < 5 THEN 2.5 ELSE n END::DOUBLE AS v FROM h) SELECT bin, n, round(-2.5 * ln(v / max(v) OVER ()), 6) + 0.0 AS energy FROM v")
def pmf_plot(spark, d):
    """A33 of a histogram."""
    h = table(spark, d, "events").groupBy((F.col("event_id") % 37).cast("int").alias("bin")).agg(F.count_if(F.col("value") > 60).alias("n"))
    return rounded(S.pmf_plot(h, 5.0), "energy")


@query("SELECT event_id, value, round(-2.5 * ln(value / (SELECT max(value) FROM events)), 6) + 0.0 AS energy FROM events WHERE value > 0")
def series_energy(spark, d):
    """A33 of a series."""
    return rounded(S.series_energy(table(spark, d, "events").where("value > 0").select("event_id", "value"), "value"), "energy")


@query("WITH s AS (SELECT DISTINCT o_custkey, (o_orderkey % 200)::INT AS res_seq FROM orders), n AS (SELECT *, lead(res_seq) OVER (PARTITION BY o_custkey ORDER BY res_seq) AS nx FROM s) SELECT o_custkey, greatest(res_seq + 1 - 2, 1) AS lo, least(nx - 1 + 2, 208) AS hi, substr(repeat('ACDEFGHIKLMNP', 16), greatest(res_seq - 1, 1), least(nx + 1, 208) - greatest(res_seq - 1, 1) + 1) AS letters FROM n WHERE nx - res_seq > 1")
def widened_ranges(spark, d):
    """Missing ranges with their letters, two residues wider on both sides."""
    seen = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 200).cast("int").alias("res_seq"))
    return A.with_letters(A.missing_ranges(seen, ["o_custkey"]), F.lit("ACDEFGHIKLMNP" * 16), 1, 2)


SCORES = "sc AS (SELECT 'o' || o_custkey AS ligand_id, o_totalprice AS score, 'p' || o_orderkey AS pose FROM orders UNION ALL SELECT 'c' || c_custkey, c_acctbal, 'q' || c_custkey FROM customer)"


def score_lists(spark, d):
    a = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("ligand_id"), F.col("o_totalprice").alias("score"), F.concat(F.lit("p"), "o_orderkey").alias("pose"))
    b = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("ligand_id"), F.col("c_acctbal").alias("score"), F.concat(F.lit("q"), "c_custkey").alias("pose"))
    return [a, b]


@query(f"WITH {SCORES} SELECT ligand_id, score, pose, (row_number() OVER (ORDER BY score DESC, pose) - 1) AS place FROM sc")
def merged_scores(spark, d):
    """Score lists merged and sorted; the place of every row."""
    return D.placed(D.concatenated(score_lists(spark, d)), "score", "pose").select("ligand_id", "score", "pose", "place")


@query(f"WITH {SCORES} SELECT ligand_id, score, pose FROM sc ORDER BY score DESC, pose LIMIT 25")
def top_poses(spark, d):
    """O2: the first 25 with their poses."""
    return D.top(D.concatenated(score_lists(spark, d)), 25, "score", "pose").select("ligand_id", "score", "pose")


@query("SELECT o_custkey AS file, list_sort(list(o_totalprice)) AS scores, row_number() OVER (ORDER BY list_sort(list(o_totalprice)), o_custkey) - 1 AS place FROM orders GROUP BY 1")
def sorted_score_lists(spark, d):
    """O3: files by their lists of scores, element by element."""
    files = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.array_sort(F.collect_list("o_totalprice")).alias("scores"))
    return D.placed(files, "scores", "file", descending=False)


@query("SELECT s_suppkey AS id, 0 AS part, 'all' AS \"group\", NULL::INT AS label FROM supplier UNION ALL SELECT c_custkey, 1, 'all', 1 FROM customer")
def joined_groups(spark, d):
    """Two groups under one name."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    return D.concatenated([a, table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit(1).alias("label"))], "all")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3/' || o_orderkey), o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, least(i // greatest(n // 7, 1), 6)::INT AS part FROM r")
def random_groups(spark, d):
    """Seven groups of a random order, with all columns carried along."""
    return L.random_groups(table(spark, d, "orders"), "o_orderkey", 7, 3).select("o_orderkey", "part")


@query("WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), w AS (SELECT k AS draw, CAST('0x' || substr(md5('5/' || k), 1, 15) AS BIGINT) % (SELECT count(*) FROM orders) AS i FROM range(3000) t(k)) SELECT draw, o_orderkey, o_totalprice FROM w JOIN r USING (i)")
def bootstrap(spark, d):
    """3000 draws with replacement."""
    return L.bootstrap(table(spark, d, "orders"), "o_orderkey", 3000, 5).select("draw", "o_orderkey", "o_totalprice")


@query(f"WITH {LABELLED}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM lab GROUP BY 1) SELECT score, pos, neg, (sum(pos) OVER (ORDER BY score DESC))::BIGINT AS tp, (sum(neg) OVER (ORDER BY score DESC))::BIGINT AS fp FROM g")
def roc_points(spark, d):
    """A46."""
    return L.roc(labelled(spark, d), "score", "label")


# --- coordinates and names


@query("SELECT event_id, round(2.0 * pow(abs(value) + 1.5, 0.75) - 3.0, 6) + 0.0 AS v FROM events")
def power_law(spark, d):
    """M2."""
    return rounded(table(spark, d, "events").select("event_id", G.power_law(F.abs("value"), 2.0, 1.5, 0.75, -3.0).alias("v")), "v")


@query("SELECT event_id, round(degrees(value / 50), 6) + 0.0 AS degrees, round(cos(value / 50), 6) + 0.0 AS cos, round(sin(value / 50), 6) + 0.0 AS sin FROM events WHERE event_id BETWEEN 10 AND 5000")
def angle_outputs(spark, d):
    """M7: a time range of angles, in degrees and as cosine and sine."""
    rows = S.time_subset(table(spark, d, "events").select("event_id", "value"), "event_id", 10, 5000)
    a = F.col("value") / 50
    cos, sin = G.angle_output(a, "cossin")
    return rounded(rows.select("event_id", G.angle_output(a, "degrees")[0].alias("degrees"), cos.alias("cos"), sin.alias("sin")), "degrees", "cos", "sin")


@query(f"WITH {POINTS} SELECT id, round(x + dx * 1.4, 6) + 0.0 AS x, round(y + dy * 1.4, 6) + 0.0 AS y FROM pts, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)")
def boundary_points(spark, d):
    """M16."""
    return rounded(Z.boundary_points(points(spark, d)).select("id", "x", "y"), "x", "y")


CODES = ", ".join(f"('{three}', '{one}')" for three, one in P.RESIDUES.items() if three not in P.PROTONATED)


@query(f"WITH {ATOMS}, c(three, one) AS (VALUES {CODES}), k AS (SELECT DISTINCT chain || '_' || res_name || '_' || res_seq AS key, res_name FROM atm) SELECT key, split_part(key, '_', 1) AS chain, split_part(key, '_', 2) AS res_name, split_part(key, '_', 3)::INT AS res_seq, one, CASE WHEN one IS NOT NULL THEN res_name END AS three FROM k LEFT JOIN c ON three = res_name")
def residue_keys(spark, d):
    """Keys built and split, three letters to one and back."""
    keys = atoms(spark, d).select(P.residue_key("chain", "res_name", "res_seq").alias("key")).distinct()
    rows = keys.select("key", *P.key_parts("key"))
    return rows.withColumn("one", P.one_letter("res_name")).withColumn("three", P.three_letters("one"))
