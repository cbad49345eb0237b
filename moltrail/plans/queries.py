"""The registered queries: each applies operators to whole driver tables that stand in for simulation
data (embeddings as points and trajectories, events as a series, lineitem as a feature matrix, orders
as score lists), beside the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parameters as P
from ..operators import contacts as C
from ..operators import docking as D
from ..operators import features as B
from ..operators import learning as L
from ..operators import lipids as Z
from ..operators import matrix as M
from ..operators import network as N
from ..operators import series as S
from ..operators import structure as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


# --- points: the first three values of a vector; the label is the frame

POINTS = "pts AS (SELECT vec_id AS id, label AS frame, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
PAIRS = "prs AS (SELECT a.frame, a.id AS id_a, b.id AS id_b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM pts a JOIN pts b ON a.frame = b.frame AND a.id < b.id)"
CUTOFF = 0.1


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("frame"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])


@query(f"WITH {POINTS}, {PAIRS} SELECT frame, id_a, id_b, round(d, 6) + 0.0 AS d FROM prs WHERE d <= {CUTOFF}")
def contact_pairs(spark, d):
    return rounded(C.self_pairs(points(spark, d), CUTOFF, ["frame"], "id").select("frame", "id_a", "id_b", "d"), "d")


@query(f"WITH {POINTS}, {PAIRS} SELECT f.frame, count(p.d) AS n FROM (SELECT DISTINCT frame FROM pts) f LEFT JOIN (SELECT * FROM prs WHERE d <= {CUTOFF}) p ON f.frame = p.frame GROUP BY f.frame")
def coord_number(spark, d):
    p = points(spark, d)
    return C.coordination_number(C.self_pairs(p, CUTOFF, ["frame"], "id"), p, ["frame"])


#: Residue of a point: a tenth of its number's last two digits.
@query(f"WITH {POINTS}, {PAIRS} SELECT (id_a % 100) // 10 AS res_a, (id_b % 100) // 10 AS res_b, round(count(*)::DOUBLE / (SELECT count(DISTINCT frame) FROM pts), 6) + 0.0 AS p FROM prs WHERE d <= {CUTOFF} GROUP BY 1, 2")
def contact_mean(spark, d):
    p = points(spark, d)
    pairs = C.self_pairs(p, CUTOFF, ["frame"], "id").withColumns({f"res_{s}": F.expr(f"(id_{s} % 100) div 10") for s in "ab"})
    n = p.agg(F.countDistinct("frame").alias("n_frames"))
    return rounded(C.contact_mean(pairs.crossJoin(F.broadcast(n)), ["res_a", "res_b"], F.first("n_frames")), "p")


@query(f"WITH {POINTS}, {PAIRS}, w AS (SELECT *, 1.0 / (1.0 + pow(d / 0.1, 6)) AS w FROM prs) SELECT frame, count(*) AS n, round(sum(w), 6) + 0.0 AS w FROM w WHERE w >= 0.2 GROUP BY frame")
def soft_contact(spark, d):
    p = points(spark, d)
    rows = C.soft_pairs(p, p, 0.1, 0.2, ["frame"], ["id"]).where("id_a < id_b")
    return rounded(rows.groupBy("frame").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "w")


@query(f"""WITH {POINTS}, {PAIRS}, r AS (SELECT frame, (id % 100) // 10 AS res, count(*) AS size FROM pts GROUP BY 1, 2),
 c AS (SELECT frame, (id_a % 100) // 10 AS res_a, (id_b % 100) // 10 AS res_b, count(*) AS n FROM prs WHERE d <= {CUTOFF} GROUP BY 1, 2, 3)
 SELECT c.*, a.size AS size_a, b.size AS size_b, round(n::DOUBLE / (a.size * b.size), 6) + 0.0 AS w FROM c JOIN r a ON a.frame = c.frame AND a.res = res_a JOIN r b ON b.frame = c.frame AND b.res = res_b""")
def nbyn_contacts(spark, d):
    p = points(spark, d).withColumn("res", F.expr("(id % 100) div 10"))
    pairs = C.self_pairs(p, CUTOFF, ["frame"], "id", ["res"])
    return rounded(C.scaled_contacts(pairs, p, "frame", "res"), "w")


@query(f"""WITH {POINTS}, {PAIRS}, c AS (SELECT frame, (id_a % 100) // 10 AS res_a, (id_b % 100) // 10 AS res_b, count(*) AS n FROM prs WHERE d <= {CUTOFF} GROUP BY 1, 2, 3),
 s AS (SELECT res_a, res_b, l.level::DOUBLE AS level, count(*) FILTER (n > l.level)::DOUBLE / (SELECT count(DISTINCT frame) FROM pts) AS share FROM c, (SELECT unnest(range(0, 4)) AS level) l GROUP BY 1, 2, 3)
 SELECT res_a, res_b, level, round(share, 6) + 0.0 AS share, CASE WHEN share >= 0.48 THEN 1 ELSE 0 END AS critical FROM s""")
def critical_map(spark, d):
    p = points(spark, d).withColumn("res", F.expr("(id % 100) div 10"))
    counts = C.contacts_by(C.self_pairs(p, CUTOFF, ["frame"], "id", ["res"]), ["frame", "res_a", "res_b"])
    n = p.agg(F.countDistinct("frame").alias("n_frames"))
    return rounded(C.critical_map(counts.crossJoin(F.broadcast(n)), ["res_a", "res_b"], "n", F.first("n_frames"), [0, 1, 2, 3]), "share")


LJ_VALUES = ", ".join(f"('{t}', {s}, {e})" for t, _, s, e in P.LENNARD_JONES)


def complexes(spark, d):
    """Points in a box of tens of Angstrom: each label a complex, each seventh point its ligand, types and charges by number."""
    e = table(spark, d, "embeddings")
    types = F.element_at(F.array(*[F.lit(t) for t in ("C", "N", "O", "S", "X")]), (F.col("vec_id") % 5 + 1).cast("int"))
    names = F.element_at(F.array(*[F.lit(t) for t in ("N", "CA", "C", "O", "CB", "CG")]), (F.col("vec_id") % 6 + 1).cast("int"))
    rows = e.select(F.col("label").alias("complex_id"), "vec_id", F.when(F.col("vec_id") % 7 == 0, "L").otherwise("R").alias("role"), F.expr("vec_id div 11").alias("res"), names.alias("atom_name"), types.alias("atom_type"), ((F.col("vec_id") % 9 - 4) / 10.0).alias("charge"), *[(F.col("embedding")[k].cast("double") * 60).alias(c) for k, c in enumerate("xyz")])
    return B.with_parameters(rows, P.lennard_jones(spark))


COMPLEX = f"""lj(t, s, e) AS (VALUES {LJ_VALUES}),
 atm AS (SELECT label AS complex_id, vec_id, vec_id % 7 = 0 AS lig, vec_id // 11 AS res, ['N','CA','C','O','CB','CG'][vec_id % 6 + 1] AS atom_name, ['C','N','O','S','X'][vec_id % 5 + 1] AS t, (vec_id % 9 - 4) / 10.0::DOUBLE AS q,
  embedding[1]::DOUBLE * 60 AS x, embedding[2]::DOUBLE * 60 AS y, embedding[3]::DOUBLE * 60 AS z FROM embeddings),
 ap AS (SELECT atm.*, lj.s::DOUBLE AS s, lj.e::DOUBLE AS e FROM atm JOIN lj ON lj.t = CASE WHEN atm.t = 'X' THEN 'DU' ELSE atm.t END),
 cp AS (SELECT r.complex_id, r.res, r.atom_name IN ('C','N','O','CA') AS bb, r.t AS t_a, l.t AS t_b, r.s AS sr, r.e AS er, r.q AS qr, l.s AS sl, l.e AS el, l.q AS ql, sqrt((r.x-l.x)*(r.x-l.x)+(r.y-l.y)*(r.y-l.y)+(r.z-l.z)*(r.z-l.z)) AS d FROM ap r JOIN ap l ON r.complex_id = l.complex_id AND NOT r.lig AND l.lig),
 en AS (SELECT *, 1.0 / (1.0 + pow(d / 7.0, 6)) AS w, 4.0 * sqrt(er * el) * (pow((sr + sl) / 2.0 / (d * 0.1), 6) * pow((sr + sl) / 2.0 / (d * 0.1), 6) - pow((sr + sl) / 2.0 / (d * 0.1), 6)) AS v, 138.935485 * qr * ql / (d * 0.1 * 4.0) AS c FROM cp WHERE d <= 12)"""
ENERGY = ["count_bb", "count_sc", "vdw_bb", "vdw_sc", "coulomb_bb", "coulomb_sc"]


@query(f"""WITH {COMPLEX}, sums AS (SELECT complex_id, res, sum(CASE WHEN bb THEN w END) AS a, sum(CASE WHEN NOT bb THEN w END) AS b, sum(CASE WHEN bb THEN v END) AS c, sum(CASE WHEN NOT bb THEN v END) AS d, sum(CASE WHEN bb THEN c END) AS e, sum(CASE WHEN NOT bb THEN c END) AS f FROM en GROUP BY 1, 2)
 SELECT r.complex_id, r.res, round(coalesce(a, 0), 6) + 0.0 AS count_bb, round(coalesce(b, 0), 6) + 0.0 AS count_sc, round(least(coalesce(c, 0), 10), 6) + 0.0 AS vdw_bb, round(least(coalesce(d, 0), 10), 6) + 0.0 AS vdw_sc, round(coalesce(e, 0), 6) + 0.0 AS coulomb_bb, round(coalesce(f, 0), 6) + 0.0 AS coulomb_sc
 FROM (SELECT DISTINCT complex_id, res FROM ap WHERE NOT lig) r LEFT JOIN sums s ON s.complex_id = r.complex_id AND s.res = r.res""")
def group_energy(spark, d):
    return rounded(B.residue_features(complexes(spark, d), ["res"]), *ENERGY)


TYPES = ("C", "N", "O", "S", "X")


@query(f"WITH {COMPLEX} SELECT r.complex_id, " + ", ".join(f"count(*) FILTER (t_a = '{a}' AND t_b = '{b}' AND d <= 7) AS {a}_{b}" for a in TYPES for b in TYPES) + " FROM (SELECT DISTINCT complex_id FROM ap) r LEFT JOIN en ON en.complex_id = r.complex_id GROUP BY r.complex_id")
def type_contacts(spark, d):
    return B.type_contacts(complexes(spark, d), list(TYPES))


# --- trajectories: 21 frames, the k-th three values of a vector each

TRAJECTORY = "trj AS (SELECT vec_id AS atom, k AS frame, embedding[3*k+1]::DOUBLE AS x, embedding[3*k+2]::DOUBLE AS y, embedding[3*k+3]::DOUBLE AS z FROM embeddings, (SELECT unnest(range(0, 21)) AS k))"


def trajectory(spark, d):
    e = table(spark, d, "embeddings").withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return e.select(F.col("vec_id").alias("atom"), "frame", *[F.get("embedding", F.col("frame") * 3 + k).cast("double").alias(c) for k, c in enumerate("xyz")])


def atom_tuples(spark, d, n):
    rows = table(spark, d, "embeddings").groupBy(F.expr(f"vec_id div {n}").alias("tuple_id")).agg(F.count("*").alias("m")).where(F.col("m") == n)
    return rows.select("tuple_id", *[(F.col("tuple_id") * n + k).alias("abcd"[k]) for k in range(n)])


@query(f"""WITH {TRAJECTORY}, t AS (SELECT a.frame, a.atom // 3 AS tuple_id, a.x-b.x AS ux, a.y-b.y AS uy, a.z-b.z AS uz, c.x-b.x AS vx, c.y-b.y AS vy, c.z-b.z AS vz FROM trj a JOIN trj b ON a.frame = b.frame AND a.atom % 3 = 0 AND b.atom = a.atom + 1 JOIN trj c ON c.frame = a.frame AND c.atom = a.atom + 2)
 SELECT frame, tuple_id, round(acos(greatest(-1.0, least(1.0, (ux*vx+uy*vy+uz*vz) / (sqrt(ux*ux+uy*uy+uz*uz) * sqrt(vx*vx+vy*vy+vz*vz))))), 6) + 0.0 AS angle FROM t""")
def angle_series(spark, d):
    return rounded(A.angles(trajectory(spark, d), atom_tuples(spark, d, 3), ["frame"], "atom"), "angle")


DIHEDRALS = f"""{TRAJECTORY}, t AS (SELECT a.frame, a.atom // 4 AS tuple_id, b.x-a.x AS px, b.y-a.y AS py, b.z-a.z AS pz, c.x-b.x AS qx, c.y-b.y AS qy, c.z-b.z AS qz, d.x-c.x AS rx, d.y-c.y AS ry, d.z-c.z AS rz
  FROM trj a JOIN trj b ON a.frame = b.frame AND a.atom % 4 = 0 AND b.atom = a.atom + 1 JOIN trj c ON c.frame = a.frame AND c.atom = a.atom + 2 JOIN trj d ON d.frame = a.frame AND d.atom = a.atom + 3),
 n AS (SELECT *, py*qz-pz*qy AS mx, pz*qx-px*qz AS my, px*qy-py*qx AS mz, qy*rz-qz*ry AS nx, qz*rx-qx*rz AS ny, qx*ry-qy*rx AS nz FROM t),
 dh AS (SELECT frame, tuple_id, atan2(sqrt(qx*qx+qy*qy+qz*qz) * (px*nx+py*ny+pz*nz), mx*nx+my*ny+mz*nz) AS angle FROM n)"""


@query(f"WITH {DIHEDRALS} SELECT frame, tuple_id, round(degrees(angle), 5) + 0.0 AS angle FROM dh")
def dihedral_series(spark, d):
    rows = A.angles(trajectory(spark, d), atom_tuples(spark, d, 4), ["frame"], "atom")
    return rounded(rows.withColumn("angle", F.degrees("angle")), "angle", digits=5)


# --- series

@query("SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id <= 5000")
def time_subset(spark, d):
    return S.time_subset(table(spark, d, "events").select("event_id", "value"), "event_id", 100, 5000)


@query("SELECT event_id, value, event_id / 5 * 2.0::DOUBLE AS time_ps FROM events WHERE event_id % 5 = 0")
def stride(spark, d):
    return S.stride(table(spark, d, "events").select("event_id", "value"), "event_id", 5, 2.0)


@query("SELECT event_id, user_id, value FROM events WHERE value > 20 AND value < 120 AND user_id > 3 AND user_id < 60")
def basin_select(spark, d):
    return S.basin(table(spark, d, "events").select("event_id", "user_id", "value"), {"value": (20, 120), "user_id": (3, 60)})


BINS = 20
HIST = f"""lim AS (SELECT min(value) AS lo, max(value) AS hi FROM events), cnt AS (SELECT least(floor((value - lo) * {BINS}.0::DOUBLE / (hi - lo)), {BINS - 1})::INT AS bin, count(*) AS n FROM events, lim GROUP BY 1),
 hist AS (SELECT b.bin::INT AS bin, lo + b.bin * ((hi - lo) / {BINS}) AS edge, (hi - lo) / {BINS} AS width, coalesce(n, 0) AS n FROM lim, (SELECT unnest(range(0, {BINS})) AS bin) b LEFT JOIN cnt ON cnt.bin = b.bin)"""
HIST2 = f"""lim AS (SELECT min(l_quantity) AS xlo, max(l_quantity) AS xhi, min(l_extendedprice) AS ylo, max(l_extendedprice) AS yhi FROM lineitem),
 cnt AS (SELECT least(floor((l_quantity - xlo) * {BINS}.0::DOUBLE / (xhi - xlo)), {BINS - 1})::INT AS bx, least(floor((l_extendedprice - ylo) * {BINS}.0::DOUBLE / (yhi - ylo)), {BINS - 1})::INT AS by, count(*) AS n FROM lineitem, lim GROUP BY 1, 2),
 hist AS (SELECT g.bx::INT AS bx, g."by"::INT AS by, xlo + g.bx * ((xhi - xlo) / {BINS}) AS edge_x, ylo + g."by" * ((yhi - ylo) / {BINS}) AS edge_y, coalesce(n, 0) AS n FROM lim, (SELECT a.b AS bx, c.b AS by FROM (SELECT unnest(range(0, {BINS})) AS b) a, (SELECT unnest(range(0, {BINS})) AS b) c) g LEFT JOIN cnt ON cnt.bx = g.bx AND cnt."by" = g."by")"""


def histogram(spark, d):
    return S.histogram(table(spark, d, "events").select("value"), "value", BINS)


def histogram2(spark, d):
    return S.histogram2d(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", BINS)


@query(f"WITH {HIST} SELECT bin, round(edge, 6) + 0.0 AS edge, n FROM hist")
def hist_1d(spark, d):
    return rounded(histogram(spark, d).select("bin", "edge", "n"), "edge")


@query(f"WITH {HIST2} SELECT bx, \"by\", round(edge_x, 6) + 0.0 AS edge_x, round(edge_y, 6) + 0.0 AS edge_y, n FROM hist")
def hist_2d(spark, d):
    return rounded(histogram2(spark, d), "edge_x", "edge_y")


@query("""WITH lim AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_type, least(floor((value - lo) * 20.0::DOUBLE / (hi - lo)), 19)::INT AS bin, count(*) AS n FROM events, lim GROUP BY 1, 2""")
def hist_shared(spark, d):
    return S.shared_histogram(table(spark, d, "events").select("event_type", "value"), "value", "event_type", BINS)


@query(f"WITH {HIST} SELECT bin, round(n::DOUBLE / max(n) OVER (), 6) + 0.0 AS p FROM hist")
def probability(spark, d):
    return rounded(S.probability(histogram(spark, d)).select("bin", "p"), "p")


@query(f"WITH {HIST}, p AS (SELECT bin, n::DOUBLE / max(n) OVER () AS p FROM hist) SELECT bin, round(-2.5 * ln(CASE WHEN p = 0 THEN 0.5 ELSE p END), 6) + 0.0 AS energy FROM p")
def pmf_1d(spark, d):
    return rounded(S.pmf(histogram(spark, d)).select("bin", "energy"), "energy")


@query(f"WITH {HIST2}, v AS (SELECT bx, \"by\", CASE WHEN n = 0 THEN 0.5 ELSE n::DOUBLE END AS v FROM hist) SELECT bx, \"by\", round(-2.5 * ln(v / max(v) OVER ()), 6) + 0.0 AS energy FROM v")
def pmf_2d(spark, d):
    return rounded(S.pmf2d(histogram2(spark, d)).select("bx", "by", "energy"), "energy")


@query(f"WITH {HIST}, r AS (SELECT n, row_number() OVER (ORDER BY n) AS r FROM hist) SELECT bin, round(-2.5 * ln(CASE WHEN n = 0 THEN (SELECT n FROM r WHERE r = 2) / 2.5 ELSE n::DOUBLE END / max(n) OVER ()), 6) + 0.0 AS energy FROM hist")
def pmf_cli_1d(spark, d):
    return rounded(S.pmf_tool(histogram(spark, d)).select("bin", "energy"), "energy")


@query(f"WITH {HIST2} SELECT bx, \"by\", round(-2.5 * log2(CASE WHEN n = 0 THEN 0.16 ELSE n::DOUBLE END / max(n) OVER ()), 6) + 0.0 AS energy FROM hist")
def pmf_cli_2d(spark, d):
    return rounded(S.pmf_tool2d(histogram2(spark, d)).select("bx", "by", "energy"), "energy")


@query(f"WITH {HIST}, p AS (SELECT n::DOUBLE / sum(n) OVER () AS p FROM hist WHERE n > 0) SELECT round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM p")
def entropy(spark, d):
    return rounded(S.entropy(histogram(spark, d)), "entropy")


def _h(source: str) -> str:
    return f"(SELECT -sum(p * ln(p)) FROM (SELECT n::DOUBLE / sum(n) OVER () AS p FROM ({source}) WHERE n > 0))"


@query(f"WITH {HIST2} SELECT round(hx, 6) + 0.0 AS hx, round(hy, 6) + 0.0 AS hy, round(hxy, 6) + 0.0 AS hxy, round(hx + hy - hxy, 6) + 0.0 AS mi FROM (SELECT {_h('SELECT sum(n) AS n FROM hist GROUP BY bx')} AS hx, {_h('SELECT sum(n) AS n FROM hist GROUP BY \"by\"')} AS hy, {_h('SELECT n FROM hist')} AS hxy)")
def mutual_info(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return rounded(S.mutual_information(df, "l_quantity", "l_extendedprice"), "hx", "hy", "hxy", "mi")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a in FEATURES for b in FEATURES))
def corr_matrix(spark, d):
    return rounded(L.correlations(lineitem(spark, d), FEATURES), "r")


def _scale_sql(expr: str, stats: str) -> str:
    stat = ", ".join(f"{stats.format(c=c)}" for c in FEATURES)
    return f"WITH s AS (SELECT {stat} FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({expr.format(c=c)}, 6) + 0.0 AS {c}" for c in FEATURES) + " FROM lineitem, s"


@query(_scale_sql("{c} - m_{c}", "avg({c}) AS m_{c}"))
def scale_mean(spark, d):
    return rounded(S.scaled(lineitem(spark, d), FEATURES, "mean"), *FEATURES)


@query(_scale_sql("CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END", "avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"))
def scale_zscore(spark, d):
    return rounded(S.scaled(lineitem(spark, d), FEATURES, "zscore"), *FEATURES)


@query(_scale_sql("CASE WHEN h_{c} = l_{c} THEN 0 ELSE ({c} - l_{c}) / (h_{c} - l_{c}) END", "min({c}) AS l_{c}, max({c}) AS h_{c}"))
def scale_minmax(spark, d):
    return rounded(S.scaled(lineitem(spark, d), FEATURES, "minmax"), *FEATURES)


@query(_scale_sql("({c} - m_{c}) / nullif(h_{c} - l_{c}, 0)", "avg({c}) AS m_{c}, min({c}) AS l_{c}, max({c}) AS h_{c}"))
def scale_range(spark, d):
    return rounded(S.scaled(lineitem(spark, d), FEATURES, "range"), *FEATURES)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def drop_zero_cols(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", (F.col("l_tax") * 0).alias("zero"))
    return S.drop_zero_columns(df, ["l_quantity", "l_tax", "zero"])


# --- matrices

MTX = "mtx AS (SELECT (l_suppkey % 12)::INT AS row, (l_partkey % 12)::INT AS col, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2), mty AS (SELECT (l_suppkey % 12)::INT AS row, (l_partkey % 12)::INT AS col, round(avg(l_tax) * 100, 6) AS value FROM lineitem GROUP BY 1, 2)"
DOMAINS = [("a", 0, 0, 3), ("b", 0, 4, 6), ("b", 1, 9, 10), ("c", 0, 3, 8), ("d", 0, 20, 22)]
DOMAIN = "dom(name, part, lo, hi) AS (VALUES " + ", ".join(str(x) for x in DOMAINS) + "), res AS (SELECT DISTINCT name, unnest(range(lo, hi + 1)) AS residue FROM dom)"


def matrices(spark, d):
    df = table(spark, d, "lineitem")
    keys = [(F.col("l_suppkey") % 12).cast("int").alias("row"), (F.col("l_partkey") % 12).cast("int").alias("col")]
    return tuple(df.groupBy(*keys).agg(F.round(v, 6).alias("value")) for v in (F.avg("l_quantity"), F.avg("l_tax") * 100))


def domain_table(spark):
    return spark.createDataFrame(DOMAINS, "name string, part int, lo int, hi int")


@query("SELECT CAST(l_orderkey * 10 + l_linenumber + 1 AS BIGINT) AS row, c + 1 AS col, [l_quantity, l_discount, l_tax][c + 1] + 0.0 AS value FROM lineitem, (SELECT unnest(range(0, 3))::INT AS c)")
def matrix_unpivot(spark, d):
    df = table(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return M.from_wide(df, "row", ["l_quantity", "l_discount", "l_tax"], 1)


@query(f"WITH {MTX} SELECT row, " + ", ".join(f"max(value) FILTER (col = {k}) AS c{k}" for k in range(12)) + " FROM mtx GROUP BY row")
def matrix_pivot(spark, d):
    return M.to_wide(matrices(spark, d)[0], list(range(12))).withColumnsRenamed({str(k): f"c{k}" for k in range(12)})


@query(f"WITH {MTX} SELECT row, col, CASE WHEN col > row THEN a.value ELSE b.value END AS value FROM mtx a FULL JOIN mty b USING (row, col)")
def merge_upper_lower(spark, d):
    return M.merged(*matrices(spark, d))


@query(f"WITH {MTX} SELECT row + 1 AS row, col + 1 AS col, round(CASE WHEN abs(row - col) <= 4 THEN 0 ELSE value * 2 END, 6) + 0.0 AS value FROM mtx")
def near_diag_zero(spark, d):
    return rounded(M.near_diagonal_zero(matrices(spark, d)[0], 4, (1, 1, 0), 2.0), "value")


@query(f"WITH {MTX} SELECT row, col, CASE WHEN value >= 25 AND value < 26 THEN value ELSE 0.0 END AS value FROM mtx WHERE row BETWEEN 2 AND 9 AND col BETWEEN 0 AND 7")
def matrix_window(spark, d):
    return M.in_range(M.window(matrices(spark, d)[0], (2, 9), (0, 7)), 25, 26)


@query(f"WITH {MTX} SELECT row, col, round(avg(value), 7) + 0.0 AS value FROM (SELECT * FROM mtx UNION ALL SELECT * FROM mty) GROUP BY row, col")
def matrix_average(spark, d):
    return rounded(M.average(list(matrices(spark, d))), "value", digits=7)


@query(f"""WITH {MTX}, {DOMAIN}, p AS (SELECT a.name AS a, b.name AS b, avg(value) AS value FROM mtx JOIN res a ON a.residue = row JOIN res b ON b.residue = col GROUP BY 1, 2)
 SELECT x.name AS a, y.name AS b, round(p.value, 10) + 0.0 AS value FROM (SELECT DISTINCT name FROM dom) x CROSS JOIN (SELECT DISTINCT name FROM dom) y LEFT JOIN p ON p.a = x.name AND p.b = y.name""")
def domain_average(spark, d):
    return rounded(M.domain_average(matrices(spark, d)[0], domain_table(spark)), "value", digits=10)  # averages of 16 end in a half at 7


@query(f"WITH {MTX}, j AS (SELECT a.value - b.value AS d FROM mtx a JOIN mty b USING (row, col)) SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS t, count(d) - 1 AS df FROM j")
def ttest_paired(spark, d):
    return rounded(M.paired_t(*matrices(spark, d)), "t")


@query(f"WITH {MTX}, s AS (SELECT avg(value) AS ma, var_samp(value) AS va, count(value) AS na FROM mtx), u AS (SELECT avg(value) AS mb, var_samp(value) AS vb, count(value) AS nb FROM mty) SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)), 6) + 0.0 AS t, na + nb - 2 AS df FROM s, u")
def ttest_ind(spark, d):
    return rounded(M.independent_t(*matrices(spark, d)), "t")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept FROM lineitem GROUP BY l_returnflag")
def linear_fit(spark, d):
    return rounded(rounded(M.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "slope"), "intercept", digits=4)


# --- networks

COMM = "com AS (SELECT label AS comm_id, (vec_id % 50)::INT AS residue FROM embeddings GROUP BY 1, 2), btw AS (SELECT (l_suppkey % 50)::INT AS row, (l_partkey % 50)::INT AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def communities(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("comm_id"), (F.col("vec_id") % 50).cast("int").alias("residue")).distinct()


def betweenness(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).cast("int").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("col")).agg(F.sum("l_quantity").alias("value"))


@query(f"WITH {COMM}, e AS (SELECT a.comm_id AS c1, b.comm_id AS c2, CASE WHEN a.comm_id = b.comm_id THEN 0.0 ELSE sum(value) END AS weight FROM btw JOIN com a ON a.residue = row JOIN com b ON b.residue = col GROUP BY a.comm_id, b.comm_id) SELECT c1, c2, weight + 0.0 AS weight FROM e")
def community_edges(spark, d):
    return N.community_edges(betweenness(spark, d), communities(spark, d))


@query(f"WITH {COMM}, e AS (SELECT a.comm_id AS c1, b.comm_id AS c2, sum(value) AS weight FROM btw JOIN com a ON a.residue = row JOIN com b ON b.residue = col WHERE a.comm_id < b.comm_id GROUP BY a.comm_id, b.comm_id) SELECT c1, c2, weight FROM e WHERE weight > 0")
def node_edges(spark, d):
    return N.node_edges(N.community_edges(betweenness(spark, d), communities(spark, d)))


@query("WITH com AS (SELECT DISTINCT p_size AS comm_id, (p_partkey % 40)::INT AS residue FROM part) SELECT comm_id, residue FROM com WHERE comm_id IN (SELECT comm_id FROM com GROUP BY comm_id HAVING count(*) >= 6)")
def large_communities(spark, d):
    return N.large_communities(table(spark, d, "part").select(F.col("p_size").alias("comm_id"), (F.col("p_partkey") % 40).cast("int").alias("residue")).distinct())


@query(f"""WITH com AS (SELECT DISTINCT p_size AS comm_id, (p_partkey % 40)::INT AS residue FROM part), {DOMAIN}, b AS (SELECT comm_id, name, count(*) AS n FROM com JOIN res USING (residue) GROUP BY 1, 2),
 s AS (SELECT comm_id, count(*) AS cs FROM com GROUP BY 1), t AS (SELECT name, count(*) AS ds FROM res GROUP BY 1)
 SELECT s.comm_id, t.name, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / cs, 6) + 0.0 AS of_community, round(coalesce(n, 0)::DOUBLE / ds, 6) + 0.0 AS of_domain FROM s CROSS JOIN t LEFT JOIN b ON b.comm_id = s.comm_id AND b.name = t.name""")
def domain_share(spark, d):
    com = table(spark, d, "part").select(F.col("p_size").alias("comm_id"), (F.col("p_partkey") % 40).cast("int").alias("residue"))
    return rounded(N.domain_shares(com, domain_table(spark)), "of_community", "of_domain")


@query(f"WITH {DOMAIN} SELECT p_partkey, p_size, name FROM part JOIN res ON residue = p_size")
def interval_join(spark, d):
    return N.in_domains(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", domain_table(spark))


# --- docking: orders as score lists

SCORES = "scores AS (SELECT o_orderpriority AS list_id, o_custkey AS ligand_id, max_by(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2)"


def scores(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderpriority").alias("list_id"), F.col("o_custkey").alias("ligand_id"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("line_no"))
    return D.last_wins(df, ["list_id", "ligand_id"], "line_no").select("list_id", "ligand_id", "score")


@query(f"WITH {SCORES} SELECT * FROM scores")
def last_wins_dedupe(spark, d):
    return scores(spark, d)


@query(f"WITH {SCORES} SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, ligand_id) AS rank FROM scores")
def topn_ranked(spark, d):
    return D.ranked(scores(spark, d), "score", "ligand_id", ["list_id"])


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, ligand_id) AS rank FROM scores) SELECT ligand_id FROM r WHERE rank <= 300 GROUP BY 1 HAVING count(DISTINCT list_id) = (SELECT count(DISTINCT list_id) FROM scores)")
def common_top(spark, d):
    return D.common_top(scores(spark, d), 300, "score", "ligand_id", "list_id")


@query(f"WITH {SCORES} SELECT c_custkey AS ligand_id, list_id, score, c_name AS pose_path FROM scores JOIN customer ON c_custkey = ligand_id")
def pose_lookup(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("ligand_id"), F.col("c_name").alias("pose_path"))
    return D.with_poses(ids, scores(spark, d), "ligand_id", "ligand_id").select("ligand_id", "list_id", "score", "pose_path")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def first_molecule(spark, d):
    return D.first_of_name(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), "p_name", ["p_partkey"])


# --- model metrics: the number of characters as the score of quality

LABELLED = "lab AS (SELECT doc_id, n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id))"
CONF = f"{LABELLED}, c AS (SELECT count(*) FILTER (score > 1000 AND label = 1) AS tp, count(*) FILTER (score > 1000 AND label <> 1) AS fp, count(*) FILTER (score <= 1000 AND label <> 1) AS tn, count(*) FILTER (score <= 1000 AND label = 1) AS fn FROM lab)"


def labelled(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "score", F.col("quality").alias("label"))


@query(f"WITH {CONF} SELECT * FROM c")
def confusion(spark, d):
    return L.confusion(labelled(spark, d), "score", "label", 1000)


@query(f"""WITH {CONF} SELECT round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 AS mcc, round(tp::DOUBLE / (tp + fn), 6) + 0.0 AS sensitivity, round(tn::DOUBLE / (tn + fp), 6) + 0.0 AS specificity,
 round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) + 0.0 AS accuracy, round(fp::DOUBLE / (fp + tn), 6) + 0.0 AS fallout, round(2.0 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM c""")
def metrics(spark, d):
    return rounded(L.metrics(L.confusion(labelled(spark, d), "score", "label", 1000)), "mcc", "sensitivity", "specificity", "accuracy", "fallout", "f1")


@query(f"WITH {LABELLED}, p AS (SELECT a.score AS s, b.score AS t FROM lab a, lab b WHERE a.label = 1 AND b.label <> 1) SELECT round(avg(CASE WHEN s > t THEN 1.0 WHEN s = t THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS auc FROM p")
def roc_auc(spark, d):
    return rounded(L.auc(labelled(spark, d), "score", "label"), "auc")


@query(f"WITH {LABELLED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n, sum(label) OVER () AS hits FROM lab) SELECT round((sum(label) FILTER (r <= floor(n * 0.1)))::DOUBLE / any_value(hits) * (any_value(n) / (any_value(n) * 0.1::DOUBLE)), 6) + 0.0 AS enrichment FROM r")
def enrichment(spark, d):
    return rounded(L.enrichment(labelled(spark, d), "score", "label", "doc_id", 0.1), "enrichment")


@query("SELECT *, (ntile(5) OVER (ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def kfold(spark, d):
    return L.k_fold(table(spark, d, "orders"), "o_orderkey", 5)


# --- structures

@query("WITH s AS (SELECT DISTINCT o_custkey, (o_orderkey % 200)::INT AS res_seq FROM orders), n AS (SELECT *, lead(res_seq) OVER (PARTITION BY o_custkey ORDER BY res_seq) AS nx FROM s) SELECT o_custkey, res_seq + 1 AS lo, nx - 1 AS hi FROM n WHERE nx - res_seq > 1")
def missing_ranges(spark, d):
    return A.missing_ranges(table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 200).cast("int").alias("res_seq")), ["o_custkey"])


@query("""WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), w AS (SELECT *, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS before FROM u)
 SELECT l_orderkey, l_linenumber, l_suppkey, (row_number() OVER o)::INT AS atom_no, CAST(1 + sum(CASE WHEN l_suppkey <> before THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS res_no FROM w WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey)""")
def renumber(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct().withColumn("o", F.struct("l_linenumber", "l_suppkey"))
    return A.renumbered(rows, "l_orderkey", "o", "l_suppkey").drop("o")


@query(f"WITH {POINTS} SELECT frame, " + ", ".join(f"round(min({c}) - 1, 6) + 0.0 AS lo_{c}, round(max({c}) + 1, 6) + 0.0 AS hi_{c}" for c in "xyz") + " FROM pts GROUP BY frame")
def bounding_box(spark, d):
    return rounded(C.bounding_box(points(spark, d), ["frame"], 1.0), *[f"{p}_{c}" for c in "xyz" for p in ("lo", "hi")])


@query(f"WITH {POINTS} SELECT frame, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS c_{c}, round(2.0 * greatest(max({c}) - avg({c}), avg({c}) - min({c})), 6) + 0.0 AS size_{c}" for c in "xyz") + " FROM pts GROUP BY frame")
def centre_and_size(spark, d):
    return rounded(C.centre(points(spark, d), ["frame"]), *[f"{p}_{c}" for c in "xyz" for p in ("c", "size")])


COV = "cov AS (SELECT frame, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x,x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,y) AS yy, covar_pop(y,z) AS yz, covar_pop(z,z) AS zz FROM pts GROUP BY frame)"


@query(f"WITH {POINTS}, {COV}, f AS (SELECT *, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS a, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS b FROM cov) SELECT frame, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(mz - a*mx - b*my, 6) + 0.0 AS c, round(sqrt(greatest(n * (zz + a*a*xx + b*b*yy - 2*a*xz - 2*b*yz + 2*a*b*xy), 0)), 6) + 0.0 AS residual FROM f")
def plane_fit(spark, d):
    return rounded(A.plane_fit(points(spark, d), ["frame"]), "a", "b", "c", "residual")


@query(f"WITH {POINTS}, {COV} SELECT frame, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in ("mx", "my", "mz", "xx", "xy", "xz", "yy", "yz", "zz")) + " FROM cov")
def axis_covariance(spark, d):
    return rounded(A.covariance(points(spark, d), ["frame"]), "mx", "my", "mz", "xx", "xy", "xz", "yy", "yz", "zz", digits=8)


#: A grid of cells a tenth wide over each frame's points, with the sum of weights of the points around.
@query(f"""WITH {POINTS}, bb AS (SELECT frame, min(x) AS x0, min(y) AS y0, min(z) AS z0, ceil((max(x) - min(x)) / 0.1)::BIGINT AS nx, ceil((max(y) - min(y)) / 0.1)::BIGINT AS ny, ceil((max(z) - min(z)) / 0.1)::BIGINT AS nz FROM pts GROUP BY frame),
 g AS (SELECT bb.frame, (i * ny + j) * nz + k AS cell, x0 + i * 0.1 AS x, y0 + j * 0.1 AS y, z0 + k * 0.1 AS z FROM bb, unnest(range(nx)) a(i), unnest(range(ny)) b(j), unnest(range(nz)) c(k)),
 w AS (SELECT g.frame, cell, p.id, 1.0 / (1.0 + pow(sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)+(g.z-p.z)*(g.z-p.z)) / 0.08, 6)) AS w FROM g JOIN pts p ON p.frame = g.frame)
 SELECT frame, cell, round(sum(w * (id % 9 + 1)), 5) + 0.0 AS q FROM w WHERE w >= 0.2 GROUP BY frame, cell""")
def grid_features(spark, d):
    p = points(spark, d)
    box = p.groupBy("frame").agg(*[e for c in "xyz" for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    atoms = p.withColumn("q", (F.col("id") % 9 + 1).cast("double"))
    return rounded(C.cell_features(C.grid(box, 0.1), atoms, ["frame"], ["q"], 0.08), "q", digits=5)


@query(f"""WITH {POINTS}, m AS (SELECT frame, min(z) + 10 * ((max(z) - min(z)) / 20) AS middle FROM pts GROUP BY frame)
 SELECT p.frame, round(any_value(middle), 6) + 0.0 AS middle, count(*) FILTER (z > middle) AS n_up, count(*) FILTER (z < middle) AS n_low, round(avg(z) FILTER (z > middle) - avg(z) FILTER (z < middle), 6) + 0.0 AS thickness FROM pts p JOIN m ON m.frame = p.frame GROUP BY p.frame""")
def leaflet_thickness(spark, d):
    return rounded(Z.leaflets(points(spark, d), "frame"), "middle", "thickness")


@query(f"WITH {POINTS} SELECT p.frame, p.id, round(CASE WHEN x <= -0.1 THEN x + 0.2 WHEN x >= 0.1 THEN x - 0.2 ELSE x END, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM pts p")
def wrap_box(spark, d):
    return rounded(A.wrapped(points(spark, d), {"x": (-0.1, 0.1)}).select("frame", "id", "x", "y", "z"), "x", "y", "z")


# --- eigenvectors: SQL squares a matrix over and over, which leaves the projection on its leading vector


def leading_sql(name: str, source: str, n: int, key: str = "frame") -> str:
    """Recursive CTEs: of source (key, m) the projection p on the leading eigenvector and that vector v, its largest part positive."""
    square = f"[[list_dot_product(a, b) / t / t FOR b IN p] FOR a IN p]"
    top = "list_max([abs(x) FOR x IN w])"
    return f"""{name}_s AS (SELECT {key}, 0 AS k, m AS p FROM {source} UNION ALL SELECT {key}, k + 1, {square} FROM (SELECT *, list_sum([p[i][i] FOR i IN range(1, {n + 1})]) AS t FROM {name}_s WHERE k < 40)),
 {name}_d AS (SELECT {key}, p, [p[i][i] FOR i IN range(1, {n + 1})] AS d FROM {name}_s WHERE k = 40), {name}_w AS (SELECT {key}, p, list_sum(d) AS t, p[list_position(d, list_max(d))] AS w FROM {name}_d),
 {name} AS (SELECT {key}, [[x / t FOR x IN r] FOR r IN p] AS p, [x / sqrt(list_dot_product(w, w)) * sign(w[list_position([abs(x) FOR x IN w], {top})]) FOR x IN w] AS v FROM {name}_w)"""


AXES = f"WITH RECURSIVE {POINTS}, {COV}, mat AS (SELECT frame, [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]] AS m FROM cov), {leading_sql('ax', 'mat', 3)}"


@query(f"{AXES} SELECT frame, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my, round(mz, 6) + 0.0 AS mz, round(v[1], 6) + 0.0 AS ax, round(v[2], 6) + 0.0 AS ay, round(v[3], 6) + 0.0 AS az FROM cov JOIN ax USING (frame)")
def axis_fit(spark, d):
    rows = A.axis_fit(points(spark, d), ["frame"])
    return rounded(rows.select("frame", "mx", "my", "mz", *[F.col("axis")[k].alias(f"a{c}") for k, c in enumerate("xyz")]), "mx", "my", "mz", "ax", "ay", "az")


@query(f"{AXES} SELECT frame, id, " + ", ".join(f"round({c} + 2.5 * v[{k}], 6) + 0.0 AS {c}" for k, c in enumerate("xyz", 1)) + " FROM pts JOIN ax USING (frame)")
def shift_along_axis(spark, d):
    """M13."""
    p = points(spark, d)
    return rounded(A.shifted_along_axis(p, p, ["frame"], 2.5).select("frame", "id", "x", "y", "z"), "x", "y", "z")


#: Rodrigues' formula about axis u, once the points' own and once one at right angles to it.
_TURN = "SELECT frame, id, {across} AS across, " + ", ".join(f"round(p{c} * cos(0.7::DOUBLE) + (u{a} * p{b} - u{b} * p{a}) * sin(0.7::DOUBLE) + u{c} * (ux * px + uy * py + uz * pz) * (1 - cos(0.7::DOUBLE)), 6) + 0.0 AS {c}" for a, b, c in ("yzx", "zxy", "xyz")) + " FROM (SELECT pts.frame, id, x - mx AS px, y - my AS py, z - mz AS pz, {u} FROM pts JOIN cov USING (frame) JOIN ax USING (frame))"


@query(f"{AXES} " + _TURN.format(across=0, u="v[1] AS ux, v[2] AS uy, v[3] AS uz") + " UNION ALL " + _TURN.format(across=1, u="-v[2] / sqrt(v[1] * v[1] + v[2] * v[2]) AS ux, v[1] / sqrt(v[1] * v[1] + v[2] * v[2]) AS uy, 0.0::DOUBLE AS uz"))
def rotate_about_axis(spark, d):
    """About the points' axis, and about one at right angles to it."""
    p = points(spark, d)
    both = [A.rotated_about_axis(p, p, ["frame"], 0.7, bool(k)).select("frame", "id", F.lit(k).alias("across"), "x", "y", "z") for k in (0, 1)]
    return rounded(both[0].unionByName(both[1]), "x", "y", "z")


_S = "sxx + syy + szz + u, syz - szy, szx - sxz, sxy - syx; syz - szy, sxx - syy - szz + u, sxy + syx, szx + sxz; szx - sxz, sxy + syx, syy - sxx - szz + u, syz + szy; sxy - syx, szx + sxz, syz + szy, szz - sxx - syy + u"
_R = "v[1]*v[1]+v[2]*v[2]-v[3]*v[3]-v[4]*v[4], 2*(v[2]*v[3]-v[1]*v[4]), 2*(v[2]*v[4]+v[1]*v[3]); 2*(v[2]*v[3]+v[1]*v[4]), v[1]*v[1]-v[2]*v[2]+v[3]*v[3]-v[4]*v[4], 2*(v[3]*v[4]-v[1]*v[2]); 2*(v[2]*v[4]-v[1]*v[3]), 2*(v[3]*v[4]+v[1]*v[2]), v[1]*v[1]-v[2]*v[2]-v[3]*v[3]+v[4]*v[4]"


#: Frames moved onto the first: mv has their coordinates.
SUPERPOSED = f"""{TRAJECTORY}, fit AS (SELECT t.frame, avg(t.x) AS mx, avg(t.y) AS my, avg(t.z) AS mz, avg(r.x) AS rx, avg(r.y) AS ry, avg(r.z) AS rz, {", ".join(f"covar_pop(t.{p}, r.{q}) AS s{p}{q}" for p in "xyz" for q in "xyz")} FROM trj t JOIN trj r ON r.frame = 0 AND r.atom = t.atom GROUP BY t.frame),
 up AS (SELECT *, sqrt(3.0 * ({" + ".join(f"s{p}{q} * s{p}{q}" for p in "xyz" for q in "xyz")})) AS u FROM fit), mat AS (SELECT frame, [{", ".join(f"[{r}]" for r in _S.split("; "))}] AS m FROM up), {leading_sql("qt", "mat", 4)},
 rot AS (SELECT frame, [{", ".join(f"[{r}]" for r in _R.split("; "))}] AS r FROM qt),
 mv AS (SELECT t.frame, atom, {", ".join(f"r[{k}][1] * (x - mx) + r[{k}][2] * (y - my) + r[{k}][3] * (z - mz) + r{c} AS {c}" for k, c in enumerate("xyz", 1))} FROM trj t JOIN fit USING (frame) JOIN rot USING (frame))"""


@query(f"WITH RECURSIVE {SUPERPOSED} SELECT frame, atom, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM mv")
def superpose(spark, d):
    t = trajectory(spark, d)
    moved = A.superposed(t, t.where("frame = 0").select("atom", "x", "y", "z"), ["frame"], "atom")
    return rounded(moved.select("frame", "atom", "x", "y", "z"), "x", "y", "z")


#: A hull's edges are the pairs of points with no point on their right, and none beyond them on their line.
@query(f"""WITH {POINTS}, p AS (SELECT DISTINCT frame, x, y FROM pts), e AS (SELECT a.frame, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.frame = b.frame AND (a.x <> b.x OR a.y <> b.y)),
 c AS (SELECT e.*, (bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax) AS side, (bx - ax) * (p.x - ax) + (by_ - ay) * (p.y - ay) AS along, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS len FROM e JOIN p ON p.frame = e.frame),
 h AS (SELECT frame, ax, ay, bx, by_ FROM c GROUP BY ALL HAVING min(side) >= 0 AND count(*) FILTER (side = 0 AND (along < 0 OR along > len)) = 0)
 SELECT frame, round(sum(ax * by_ - bx * ay) / 2, 6) + 0.0 AS area FROM h GROUP BY frame""")
def hull_area(spark, d):
    return rounded(Z.cross_section(points(spark, d), "frame"), "area")


#: The correlation matrix of the features, as scaled by z-scores.
CORRELATED = "WITH RECURSIVE mat1 AS (SELECT 0 AS frame, [" + ", ".join("[" + ", ".join(f"corr({a}, {b})" for b in FEATURES) + "]" for a in FEATURES) + "] AS m FROM lineitem)"


def deflated_sql(k: int, source: str = "mat", n: int = 4) -> str:
    """Leading eigenvectors pc1, pc2, ... of mat1, and their eigenvalues ev1, ...: each is taken out of the matrix before the next."""
    out = []
    for i in range(1, k + 1):
        out += [leading_sql(f"pc{i}", f"{source}{i}", n), f"ev{i} AS (SELECT frame, m, p, list_sum([list_dot_product(p[i], m[i]) FOR i IN range(1, {n + 1})]) AS ev FROM {source}{i} JOIN pc{i} USING (frame))"]
        out.append(f"{source}{i + 1} AS (SELECT frame, [[m[i][j] - ev * p[i][j] FOR j IN range(1, {n + 1})] FOR i IN range(1, {n + 1})] AS m FROM ev{i})")
    return ", ".join(out)


@query(f"{CORRELATED}, {deflated_sql(3)} SELECT component, round(ev / 4, 6) + 0.0 AS share FROM (SELECT 0 AS component, ev FROM ev1 UNION ALL SELECT 1, ev FROM ev2 UNION ALL SELECT 2, ev FROM ev3)")
def pca_explained(spark, d):
    _, _, shares = L.pca(lineitem(spark, d), FEATURES, 3, "zscore")
    return rounded(spark.createDataFrame(list(enumerate(shares)), "component int, share double"), "share")


_Z = {c: f"(({c} - m_{c}) / s_{c})" for c in FEATURES}


@query(f"{CORRELATED}, {deflated_sql(2)}, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({_Z[c]}, 6) + 0.0 AS {c}" for c in FEATURES) + ", " + ", ".join(f"round({' + '.join(f'{_Z[c]} * pc{i + 1}.v[{k}]' for k, c in enumerate(FEATURES, 1))}, 5) + 0.0 AS PC_{i}" for i in (0, 1)) + " FROM lineitem, st, pc1, pc2")
def pca_project(spark, d):
    out = rounded(L.pca(lineitem(spark, d), FEATURES, 2, "zscore")[0], *FEATURES)
    return rounded(out, "PC_0", "PC_1", digits=5)


@query()
def rf_importance(spark, d):
    df = lineitem(spark, d).withColumn("y", (F.col("l_extendedprice") > 40000).cast("int"))
    return spark.createDataFrame(sorted(L.importances(df, FEATURES, "y", trees=10).items()), "feature string, importance double")
