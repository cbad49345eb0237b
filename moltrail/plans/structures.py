"""More registered queries: structures, residues, selections and writers' records. part stands in for atoms
(p_brand the chain, p_size the residue), embeddings for coordinates, orders and customer for lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import contacts as C
from ..operators import docking as D
from ..operators import features as B
from ..operators import lipids as Z
from ..operators import series as S
from ..operators import structure as A
from ..sources import sinks as K
from .queries import COMPLEX, CUTOFF, DOMAIN, PAIRS, POINTS, TRAJECTORY, TYPES, complexes, domain_table, points, query, rounded, table, trajectory

ATOMS = """atm AS (SELECT p_partkey AS atom_idx, p_partkey + 1 AS serial, p_brand AS chain, p_size AS res_seq, ['N','CA','C','O','CB'][p_partkey % 5 + 1] AS atom_name, ['ALA','GLY','HOH','SER'][p_size % 4 + 1] AS res_name,
 ['N','C','C','O','C'][p_partkey % 5 + 1] AS element, p_retailprice / 100 AS x, (p_partkey % 97)::DOUBLE AS y, (p_partkey % 31)::DOUBLE AS z FROM part)"""


def pick(key, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(key) + 1).cast("int"))


def atoms(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("atom_idx"), (k + 1).alias("serial"), F.col("p_brand").alias("chain"), F.col("p_size").alias("res_seq"), pick("p_partkey % 5", ["N", "CA", "C", "O", "CB"]).alias("atom_name"), pick("p_size % 4", ["ALA", "GLY", "HOH", "SER"]).alias("res_name"), pick("p_partkey % 5", ["N", "C", "C", "O", "C"]).alias("element"), (F.col("p_retailprice") / 100).alias("x"), (k % 97).cast("double").alias("y"), (k % 31).cast("double").alias("z"))


@query(f"WITH {ATOMS} SELECT serial, atom_name, res_name, chain, res_seq FROM atm WHERE res_seq BETWEEN 5 AND 40 AND res_name IN ('ALA', 'GLY', 'SER') AND atom_name IN ('N', 'CA', 'C', 'O')")
def select_mainchain(spark, d):
    return A.select_atoms(atoms(spark, d), None, 5, 40, "mainchain").select("serial", "atom_name", "res_name", "chain", "res_seq")


@query(f"WITH {ATOMS} SELECT chain, res_seq, avg(CASE WHEN x BETWEEN 0 AND 12 AND y BETWEEN 0 AND 90 AND z BETWEEN 0 AND 29 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM atm GROUP BY chain, res_seq HAVING share >= 0.5")
def residues_in_box(spark, d):
    return A.residues_in_box(atoms(spark, d), (12, 90, 29), 0.5)


@query(f"WITH {ATOMS}, r AS (SELECT chain, res_seq, row_number() OVER (ORDER BY min(atom_idx)) - 1 AS res_idx FROM atm GROUP BY chain, res_seq) SELECT atom_idx, chain, res_seq, res_idx FROM atm JOIN r USING (chain, res_seq)")
def residue_numbers(spark, d):
    return A.residue_numbers(atoms(spark, d), []).select("atom_idx", "chain", "res_seq", "res_idx")


@query(f"WITH {ATOMS} SELECT chain, res_seq, res_name, min(atom_idx) AS first FROM atm GROUP BY ALL")
def residue_list(spark, d):
    return A.residue_list(atoms(spark, d), [])


@query(f"""WITH {ATOMS}, r AS (SELECT DISTINCT chain, res_seq, res_name[1] AS c FROM atm WHERE res_seq % 7 <> 0), e AS (SELECT chain, min(res_seq) AS lo, max(res_seq) AS hi FROM r GROUP BY chain),
 n AS (SELECT chain, unnest(range(lo, hi + 1)) AS res_seq FROM e) SELECT n.chain, string_agg(coalesce(c, '-'), '' ORDER BY n.res_seq) AS sequence FROM n LEFT JOIN r ON r.chain = n.chain AND r.res_seq = n.res_seq GROUP BY n.chain""")
def chain_sequences(spark, d):
    residues = atoms(spark, d).where("res_seq % 7 <> 0").select("chain", "res_seq", F.substring("res_name", 1, 1).alias("code1")).distinct()
    return A.chain_sequences(residues, ["chain"])


@query(f"""WITH {ATOMS}, r AS (SELECT chain, res_seq, min(serial) FILTER (atom_name = 'N') AS n, min(serial) FILTER (atom_name = 'CA') AS ca, min(serial) FILTER (atom_name = 'C') AS c FROM atm WHERE atom_name IN ('N', 'CA', 'C') GROUP BY 1, 2),
 w AS (SELECT r.*, p.c AS before, q.n AS after FROM r LEFT JOIN r p ON p.chain = r.chain AND p.res_seq = r.res_seq - 1 LEFT JOIN r q ON q.chain = r.chain AND q.res_seq = r.res_seq + 1),
 t AS (SELECT chain, res_seq, 'phi' AS kind, before AS a, n AS b, ca AS c, c AS d FROM w UNION ALL SELECT chain, res_seq, 'psi', n, ca, c, after FROM w) SELECT * FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""")
def backbone_dihedrals(spark, d):
    return A.backbone_dihedrals(atoms(spark, d), [])


@query(f"WITH {ATOMS}, f AS (SELECT atom_name, res_seq, min(serial) AS serial FROM atm GROUP BY 1, 2) SELECT o.p_partkey AS id, a.serial AS serial_0, b.serial AS serial_1 FROM part o JOIN f a ON a.atom_name = 'CA' AND a.res_seq = o.p_size + 1 JOIN f b ON b.atom_name = 'CB' AND b.res_seq = o.p_size + 3")
def restraints(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("CA").alias("name_0"), F.col("p_size").alias("res_0"), F.lit("CB").alias("name_1"), (F.col("p_size") + 2).alias("res_1"))
    return A.restraints(rows, atoms(spark, d), 2, 1).select("id", "serial_0", "serial_1")


@query(f"WITH {ATOMS}, {DOMAIN} SELECT name, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM atm JOIN res ON residue = res_seq GROUP BY name")
def domain_centres(spark, d):
    return rounded(A.domain_centres(atoms(spark, d), domain_table(spark)), "x", "y", "z")


@query(f"WITH {POINTS}, {DOMAIN}, h AS (SELECT DISTINCT name, unnest(range(lo, hi)) AS res_idx FROM dom) SELECT name, round(sum(x) * 2, 6) + 0.0 AS vx, round(sum(y) * 2, 6) + 0.0 AS vy, round(sum(z) * 2, 6) + 0.0 AS vz FROM pts JOIN h ON res_idx = id % 25 GROUP BY name")
def domain_vectors(spark, d):
    v = points(spark, d).select((F.col("id") % 25).alias("res_idx"), *[F.col(c).alias(f"v{c}") for c in "xyz"])
    return rounded(A.domain_vectors(v, domain_table(spark), 2.0), "vx", "vy", "vz")


@query(f"WITH {POINTS}, st AS (SELECT i AS step, 3.0 * cos(2 * pi() * i / 4 - pi()) AS f FROM range(4) t(i)) SELECT id, step, round(x + y * f, 6) + 0.0 AS x, round(y + z * f, 6) + 0.0 AS y, round(z + x * f, 6) + 0.0 AS z FROM pts, st")
def ensemble(spark, d):
    p = points(spark, d).withColumnRenamed("id", "atom_idx")
    v = p.select("atom_idx", F.col("y").alias("vx"), F.col("z").alias("vy"), F.col("x").alias("vz"))
    rows = A.displaced(p, v, A.ensemble_factors(spark, 3.0, 4))
    return rounded(rows.select(F.col("atom_idx").alias("id"), "step", "x", "y", "z"), "x", "y", "z")


@query(f"""WITH {POINTS}, c AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x,x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,y) AS yy, covar_pop(y,z) AS yz FROM pts GROUP BY frame),
 f AS (SELECT frame, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS a, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS b, mx, my, mz FROM c), g AS (SELECT *, mz - a*mx - b*my AS c FROM f)
 SELECT p.frame, id, round((a*x + b*y - z + c) / sqrt(a*a + b*b + 1), 6) + 0.0 AS d FROM pts p JOIN g ON g.frame = p.frame WHERE (a*x + b*y - z + c) / sqrt(a*a + b*b + 1) > 0.05""")
def beyond_plane(spark, d):
    p = points(spark, d)
    return rounded(A.beyond_plane(p, A.plane_fit(p, ["frame"]), ["frame"], 0.05).select("frame", "id", "d"), "d")


@query(f"""WITH {TRAJECTORY}, {POINTS} SELECT atom, frame, round(x * 2 + 1, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z * -1 + 3, 6) + 0.0 AS z FROM trj WHERE atom % 2 = 0""")
def moved_subset(spark, d):
    rows = A.moved(trajectory(spark, d), F.col("atom") % 2 == 0, (1, 0, 3), (2, 1, -1), only=True)
    return rounded(rows.select("atom", "frame", "x", "y", "z"), "x", "y", "z")


# --- contacts and features


@query(f"WITH {POINTS}, {PAIRS}, n AS (SELECT frame, count(*) FILTER (id_a % 2 = 0) AS n0, count(*) FILTER (id_a % 2 = 1) AS n1 FROM prs WHERE d <= {CUTOFF} GROUP BY frame), f AS (SELECT DISTINCT frame FROM pts) SELECT CASE WHEN coalesce(n0, 0) = 1 AND coalesce(n1, 0) = 1 THEN 1 WHEN coalesce(n0, 0) = 2 OR coalesce(n1, 0) = 2 THEN 2 ELSE 0 END AS kind, count(*) AS n FROM f LEFT JOIN n USING (frame) GROUP BY 1")
def frame_types(spark, d):
    p = points(spark, d)
    pairs = C.self_pairs(p, CUTOFF, ["frame"], "id").withColumn("donor", F.col("id_a") % 2)
    return C.frame_types(pairs, p, "frame", "donor")


@query(f"WITH {POINTS}, {PAIRS}, e AS (SELECT frame, avg(x) * 10 AS energy FROM pts GROUP BY frame), v AS (SELECT (id_a % 100) // 10 AS res_a, (id_b % 100) // 10 AS res_b, sum(exp(-energy / 2.5)) AS v FROM prs JOIN e USING (frame) WHERE d <= {CUTOFF} GROUP BY 1, 2) SELECT res_a, res_b, round(v / max(v) OVER (), 6) + 0.0 AS v FROM v")
def energy_weighted(spark, d):
    p = points(spark, d)
    pairs = C.self_pairs(p, CUTOFF, ["frame"], "id").withColumns({f"res_{s}": F.expr(f"(id_{s} % 100) div 10") for s in "ab"}).withColumn("w", F.lit(1.0))
    energies = p.groupBy("frame").agg((F.avg("x") * 10).alias("energy"))
    return rounded(C.energy_weighted_map(pairs, energies, "frame", ["res_a", "res_b"]), "v")


@query(f"WITH {POINTS}, bx AS (SELECT frame, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM pts GROUP BY frame), c AS (SELECT frame, (i * 6 + j) * 6 + k AS cell, x0 + i * 0.1 AS x, y0 + j * 0.1 AS y, z0 + k * 0.1 AS z FROM bx, range(6) a(i), range(6) b(j), range(6) e(k)) SELECT p.frame, p.id, coalesce(min(cell), -1) AS cell FROM pts p LEFT JOIN c ON c.frame = p.frame AND sqrt((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z)) <= 0.08 GROUP BY p.frame, p.id")
def first_cell(spark, d):
    p = points(spark, d)
    steps = F.sequence(F.lit(0), F.lit(5))
    cells = p.groupBy("frame").agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"])
    for c in "xyz":
        cells = cells.withColumn(f"i_{c}", F.explode(steps))
    cells = cells.select("frame", ((F.col("i_x") * 6 + F.col("i_y")) * 6 + F.col("i_z")).cast("long").alias("cell"), *[(F.col(f"lo_{c}") + F.col(f"i_{c}") * 0.1).alias(c) for c in "xyz"])
    return C.first_cell(cells, p, 0.08, ["frame"], "id")


PARTS = [("count", "w", "coalesce({}, 0)"), ("vdw", "v", "least(coalesce({}, 0), 10)"), ("columb", "c", "coalesce({}, 0)")]


@query(f"WITH {COMPLEX}, s AS (SELECT complex_id, res, " + ", ".join(f"sum({v}) FILTER ({'' if side == 'back' else 'NOT '}bb) AS {n}{side}" for n, v, _ in PARTS for side in ("back", "side")) + " FROM en GROUP BY 1, 2), r AS (SELECT DISTINCT complex_id, res FROM ap WHERE NOT lig) " + " UNION ALL ".join(f"SELECT r.complex_id, '{n}{side}_' || r.res AS feature, round({how.format(n + side)}, 6) + 0.0 AS value FROM r LEFT JOIN s USING (complex_id, res)" for n, _, how in PARTS for side in ("back", "side"))
  + "".join(f" UNION ALL SELECT c.complex_id, 'atomTCount_{p}_{q}', (count(*) FILTER (t_a = '{p}' AND t_b = '{q}' AND d <= 7))::DOUBLE FROM (SELECT DISTINCT complex_id FROM ap) c LEFT JOIN en ON en.complex_id = c.complex_id GROUP BY 1" for p in TYPES for q in TYPES))
def feature_table(spark, d):
    a = complexes(spark, d)
    return rounded(B.feature_table(B.residue_features(a, ["res"]), ["res"], B.type_contacts(a, list(TYPES))), "value")


@query(f"WITH {COMPLEX} SELECT complex_id, count(*) FILTER (t = 'C') AS \"C\", count(*) FILTER (t = 'N') AS \"N\", count(*) FILTER (t = 'O') AS \"O\", count(*) FILTER (t NOT IN ('C', 'N', 'O')) AS \"DU\" FROM atm WHERE lig GROUP BY 1")
def element_counts(spark, d):
    return B.element_counts(complexes(spark, d).where("role = 'L'").withColumnRenamed("atom_type", "element"), ["C", "N", "O"])


@query(f"WITH {COMPLEX} SELECT complex_id, round(sum(q))::INT AS net_charge FROM atm GROUP BY 1")
def net_charge(spark, d):
    return B.net_charge(complexes(spark, d).withColumn("charge", F.col("charge").cast("decimal(10,2)")))


@query(f"WITH {COMPLEX}, m(t, mass) AS (VALUES ('C', 12.01::DOUBLE), ('N', 14.01), ('O', 16.0), ('S', 32.06), ('H', 1.0)) SELECT complex_id, round(sum(mass), 4) + 0.0 AS weight, count(*) AS heavy_atoms FROM atm LEFT JOIN m USING (t) GROUP BY 1")
def molecular_weight(spark, d):
    masses = spark.createDataFrame([("C", 12.01), ("N", 14.01), ("O", 16.0), ("S", 32.06), ("H", 1.0)], "element string, mass double")
    return rounded(B.molecular_weight(complexes(spark, d).withColumnRenamed("atom_type", "element"), masses, ["complex_id"]), "weight", digits=4)


# --- series, lists, records


@query("SELECT event_id, value * 2 + 1 AS value FROM events WHERE event_id >= 50")
def shifted_series(spark, d):
    return S.shifted(table(spark, d, "events").select("event_id", "value"), "event_id", 50, {"value": (2.0, 1.0)})


@query("SELECT user_id, event_id, event_type, (value > 100)::INT AS w FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING sum((value > 100)::INT) > 0)")
def contact_residues(spark, d):
    e = table(spark, d, "events").withColumn("w", (F.col("value") > 100).cast("int"))
    kept = S.contact_residues(e, e.select("user_id").distinct(), "user_id", "event_id", "w").select("user_id", "event_id", "w")
    return kept.join(e.select("event_id", "event_type"), "event_id")


@query("SELECT event_type, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM (SELECT event_type, n::DOUBLE / sum(n) OVER (PARTITION BY event_type) AS p FROM (SELECT event_type, user_id % 10 AS bin, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1")
def entropy_by_type(spark, d):
    h = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("bin")).agg(F.count("*").alias("n"))
    return rounded(S.entropy(h, keys=["event_type"]), "entropy")


@query("SELECT p_partkey, p_name, coalesce(TRY_CAST(regexp_replace(p_type || p_retailprice, '[^0-9.]', '', 'g') AS DOUBLE), 9999) AS v FROM part WHERE coalesce(TRY_CAST(regexp_replace(p_type || p_retailprice, '[^0-9.]', '', 'g') AS DOUBLE), 9999) >= 905")
def by_property(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("> "), F.col("p_retailprice").cast("string")).alias("text"))
    return D.by_property(rows, "text", 905.0).select("p_partkey", "p_name", D.property_number(F.col("text")).alias("v"))


@query("SELECT ligand_id FROM (SELECT DISTINCT c_custkey AS ligand_id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def unscored_ligands(spark, d):
    return D.difference(table(spark, d, "customer").select(F.col("c_custkey").alias("ligand_id")), table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("ligand_id")))


@query("SELECT label AS \"group\", line, string_agg(lpad(atom_no::VARCHAR, 6, ' '), ' ' ORDER BY pos) AS text FROM (SELECT label, vec_id AS atom_no, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 15 + 1) AS line FROM embeddings) GROUP BY 1, 2 UNION ALL SELECT DISTINCT label, 0, '[ ' || label || ' ]' FROM embeddings")
def index_lines(spark, d):
    w = W.partitionBy("label").orderBy("vec_id")
    groups = table(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("atom_no"), (F.row_number().over(w) - 1).alias("pos"))
    return K.index_lines(groups.withColumn("group", F.col("group").cast("string"))).withColumn("group", F.col("group").cast("int"))


@query(f"WITH {POINTS}, {PAIRS} SELECT f.frame, " + ", ".join(f"coalesce(sum(CASE WHEN (id_a + id_b) % 4 = {k} THEN 1.0::DOUBLE END), 0.0) AS p{k}" for k in range(4)) + f" FROM (SELECT DISTINCT frame FROM pts) f LEFT JOIN (SELECT * FROM prs WHERE d <= {CUTOFF}) p USING (frame) GROUP BY f.frame")
def wide_contacts(spark, d):
    p = points(spark, d)
    pairs = C.self_pairs(p, CUTOFF, ["frame"], "id").select("frame", F.concat(F.lit("p"), ((F.col("id_a") + F.col("id_b")) % 4).cast("string")).alias("pair"), F.lit(1.0).alias("w"))
    return K.wide_contacts(pairs, p, "frame", "pair", ["p0", "p1", "p2", "p3"])
