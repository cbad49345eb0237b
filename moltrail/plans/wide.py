"""Registered queries of wide tables, large groups and crowded cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as W
from ..operators import contacts as C
from ..operators import correlations as R
from ..operators import learning as L
from ..operators import lipids as Z
from ..operators import matrix as M
from ..operators import series as S
from ..operators.ranges import shared_folder
from ..sources import files
from ..sources import sinks as K
from ..functions import geometry as G
from ..operators import structure as A
from .queries import DIHEDRALS, FEATURES, POINTS, SUPERPOSED, TRAJECTORY, atom_tuples, deflated_sql, lineitem, points, query, rounded, table, trajectory

DISTANCE = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"

# --- components: parts by line number are contacts, twelve groups of suppliers the frames

FRAMES = 12


def shares_sql(n: int) -> str:
    """Of g (i, j, v), the products of n frames' rows with each other, the shares of the first three components: centring the
    frames centres the products in both directions."""
    return f"""k AS (SELECT unnest(range({n}))::INT AS i), sq AS (SELECT k.i, l.i AS j, coalesce(v, 0) AS v FROM k CROSS JOIN k l LEFT JOIN g ON g.i = k.i AND g.j = l.i),
 ce AS (SELECT i, j, v - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j) + avg(v) OVER () AS v FROM sq),
 cen1 AS (SELECT 0 AS frame, list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM ce GROUP BY i)), {deflated_sql(3, "cen", n)}, tr AS (SELECT sum(v) AS t FROM ce WHERE i = j)
 SELECT component, round(ev / t, 6) + 0.0 AS share FROM (SELECT 0 AS component, ev FROM ev1 UNION ALL SELECT 1, ev FROM ev2 UNION ALL SELECT 2, ev FROM ev3), tr"""


def shares_table(spark, shares):
    return rounded(spark.createDataFrame(list(enumerate(shares)), "component int, share double"), "share")


@query(f"""WITH RECURSIVE e AS (SELECT (l_suppkey % {FRAMES})::INT AS f, l_partkey * 7 + l_linenumber AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
 g AS (SELECT a.f AS i, b.f AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.c = b.c GROUP BY 1, 2), {shares_sql(FRAMES)}""")
def contact_components(spark, d):
    """P5: shares of the first components of a contact map of as many columns as there are parts and line numbers."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % FRAMES).alias("frame"), (F.col("l_partkey") * 7 + F.col("l_linenumber")).alias("contact"), "l_quantity")
    frames = spark.range(FRAMES).withColumnRenamed("id", "frame")  # some may have no contact
    found = W.wide_components(rows, "frame", "contact", "l_quantity", 3, frames)
    return shares_table(spark, found.shares)


#: So few frames that their components are exact.
FEW = 10


@query(f"WITH RECURSIVE {SUPERPOSED}, g AS (SELECT a.frame::INT AS i, b.frame::INT AS j, sum(a.x * b.x + a.y * b.y + a.z * b.z) AS v FROM mv a JOIN mv b ON a.atom = b.atom AND a.frame < {FEW} AND b.frame < {FEW} GROUP BY 1, 2), {shares_sql(FEW)}")
def xyz_components(spark, d):
    """Frames moved onto the first, then components of all coordinates."""
    t = trajectory(spark, d).where(F.col("frame") < FEW)
    return shares_table(spark, L.xyz_pca(t, t.where("frame = 0").select("atom", "x", "y", "z"), "frame", "atom", 3)[1])


@query(f"WITH RECURSIVE {DIHEDRALS}, g AS (SELECT a.frame::INT AS i, b.frame::INT AS j, sum(cos(a.angle) * cos(b.angle) + sin(a.angle) * sin(b.angle)) AS v FROM dh a JOIN dh b ON a.tuple_id = b.tuple_id AND a.frame < {FEW} AND b.frame < {FEW} GROUP BY 1, 2), {shares_sql(FEW)}")
def dihedral_components(spark, d):
    """Components of the cosines and sines of all dihedrals."""
    angles = A.angles(trajectory(spark, d).where(F.col("frame") < FEW), atom_tuples(spark, d, 4), ["frame"], "atom")
    return shares_table(spark, L.wide_dihedral_pca(angles, "frame", "tuple_id", "angle", 3)[1])


_AB = "(a.x*b.x+a.y*b.y+a.z*b.z) / (sqrt(a.x*a.x+a.y*a.y+a.z*a.z) * sqrt(b.x*b.x+b.y*b.y+b.z*b.z))"


@query(f"WITH {POINTS} SELECT a.id, round(a.x / sqrt(a.x*a.x+a.y*a.y+a.z*a.z), 6) + 0.0 AS ux, round(a.y / sqrt(a.x*a.x+a.y*a.y+a.z*a.z), 6) + 0.0 AS uy, round(acos(greatest(-1.0, least(1.0, {_AB}))), 6) + 0.0 AS next, round(acos(greatest(-1.0, least(1.0, (a.x*a.x+a.y*a.y+a.z*a.z) / (sqrt(a.x*a.x+a.y*a.y+a.z*a.z) * sqrt(a.x*a.x+a.y*a.y+a.z*a.z))))), 6) + 0.0 AS self FROM pts a JOIN pts b ON b.id = a.id + 1")
def vector_angles(spark, d):
    """M8: unit vectors, angles between vectors, and that of a vector with itself, whose cosine may come out over 1."""
    p = points(spark, d)
    rows = p.join(p.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"b{c}") for c in "xyz"]), "id")
    a, b = G.vector(), G.vector("b")
    u = G.unit(a)
    return rounded(rows.select("id", u[0].alias("ux"), u[1].alias("uy"), G.angle_between(a, b).alias("next"), G.angle_between(a, a).alias("self")), "ux", "uy", "next", "self")


# --- pairs


@query(f"""WITH {TRAJECTORY}, p AS (SELECT a.atom % 10 AS part, {DISTANCE} AS d FROM trj a JOIN trj b ON a.frame = 0 AND b.frame > 0)
 SELECT part, count(*) AS n, round(min(d), 6) + 0.0 AS nearest, round(avg(d), 6) + 0.0 AS d FROM p GROUP BY part""")
def large_group_pairs(spark, d):
    """The product of two large groups of one frame, cut into tiles."""
    t = trajectory(spark, d).withColumns({"one": F.lit(1), "part": F.col("atom") % 10})
    sums = C.pair_sums(t.where("frame = 0"), t.where("frame > 0"), ["one"], "atom", "part")
    return rounded(sums.select("part", "n", F.col("least").alias("nearest"), F.col("mean").alias("d")), "nearest", "d")


@query(f"""WITH {TRAJECTORY}, q AS (SELECT atom * 4 + frame AS id, (x + 1) * 0.05 AS x, (y + 1) * 0.05 AS y, (z + 1) * 0.05 AS z FROM trj WHERE frame < 4), p AS (SELECT a.id % 10 AS part, {DISTANCE} AS d FROM q a JOIN q b ON a.id < b.id)
 SELECT part, count(*) AS n, round(avg(d), 8) + 0.0 AS d FROM p WHERE d <= 0.1 GROUP BY part""")
def crowded_contacts(spark, d):
    """Contacts where all points stand in one cell of the grid."""
    t = trajectory(spark, d).where("frame < 4")
    p = t.select((F.col("atom") * 4 + F.col("frame")).alias("id"), F.lit(0).alias("frame"), *[((F.col(c) + 1) * 0.05).alias(c) for c in "xyz"])
    sums = C.self_pair_sums(p.withColumn("part", F.col("id") % 10), 0.1, ["frame"], "id", "part")
    return rounded(sums.select("part", "n", F.col("mean").alias("d")), "d", digits=8)


# --- features of many columns

BINS = 20


@query(f"""WITH b AS (SELECT {", ".join(f"least(floor(({c} - min({c}) OVER ()) * {BINS}.0::DOUBLE / (max({c}) OVER () - min({c}) OVER ())), {BINS - 1})::INT AS {c}" for c in FEATURES)} FROM lineitem),
 j AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y, count(*) AS n FROM b GROUP BY 3, 4" for k, a in enumerate(FEATURES) for b in FEATURES[k + 1 :])}),
 h AS (SELECT a, b, 'hx' AS h, n / sum(n) OVER (PARTITION BY a, b) AS p FROM (SELECT a, b, x, sum(n) AS n FROM j GROUP BY 1, 2, 3) UNION ALL SELECT a, b, 'hy', n / sum(n) OVER (PARTITION BY a, b) FROM (SELECT a, b, y, sum(n) AS n FROM j GROUP BY 1, 2, 3) UNION ALL SELECT a, b, 'hxy', n / sum(n) OVER (PARTITION BY a, b) FROM j),
 e AS (SELECT a, b, sum(-p * ln(p)) FILTER (h = 'hx') AS hx, sum(-p * ln(p)) FILTER (h = 'hy') AS hy, sum(-p * ln(p)) FILTER (h = 'hxy') AS hxy FROM h GROUP BY 1, 2)
 SELECT a, b, round(hx, 6) + 0.0 AS hx, round(hy, 6) + 0.0 AS hy, round(hxy, 6) + 0.0 AS hxy, round(hx + hy - hxy, 6) + 0.0 AS mi FROM e""")
def mutual_info_matrix(spark, d):
    """Every pair of columns from one pass."""
    return rounded(S.mutual_information_matrix(lineitem(spark, d), FEATURES, BINS), "hx", "hy", "hxy", "mi")


#: Columns of embeddings: 64 values, then each mixed with the next one so that it follows the first or doesn't.
WIDE = [(k, m) for m in (0.0, 0.3, 1.5) for k in range(64)]


def wide_table(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(*[(e[k].cast("double") + m * e[(k + 1) % 64].cast("double")).alias(f"f{i}") for i, (k, m) in enumerate(WIDE)])


WIDE_SQL = "w AS (SELECT vec_id AS r, m.i * 64 + k AS f, embedding[k + 1]::DOUBLE + m.m * embedding[(k + 1) % 64 + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS k), (VALUES (0, 0.0::DOUBLE), (1, 0.3::DOUBLE), (2, 1.5::DOUBLE)) m(i, m)), pr AS (SELECT a.f AS fa, b.f AS fb, corr(a.v, b.v) AS r FROM w a JOIN w b ON a.r = b.r AND a.f < b.f GROUP BY 1, 2)"


@query(f"WITH {WIDE_SQL} SELECT 'f' || fa AS a, 'f' || fb AS b, round(r, 6) + 0.0 AS r FROM pr WHERE abs(r) > 0.85")
def correlated_pairs(spark, d):
    """Pairs of columns over the limit, by tiles of columns."""
    return rounded(R.correlated_pairs(wide_table(spark, d), [f"f{i}" for i in range(len(WIDE))], 0.85, block=64), "r")


@query(f"WITH {WIDE_SQL} SELECT DISTINCT 'f' || f AS feature FROM w WHERE f NOT IN (SELECT fa FROM pr WHERE abs(r) > 0.85)")
def uncorrelated_features(spark, d):
    """The columns that stay."""
    left = R.uncorrelated(wide_table(spark, d), [f"f{i}" for i in range(len(WIDE))], 0.85)
    return spark.createDataFrame([(c,) for c in left], "feature string")


@query()
def cleaned_features(spark, d):
    """P10: zero columns out, scaling, importance, decorrelation and components of lineitem's features and sums of them."""
    f = lineitem(spark, d)
    f = f.withColumns({"none": F.lit(0.0), "gross": F.col("l_extendedprice") * (1 + F.col("l_tax")), "net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "label": (F.col("l_extendedprice") > 40000).cast("int")})
    return L.clean(f, [*FEATURES, "none", "gross", "net"], "label", keep=5, k=2, trees=10)[0]


# --- t-tests with their probabilities

HALF = "avg(l_quantity) FILTER (l_linenumber % 2 = {k})"


def _halves(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).cast("int").alias("row"), (F.col("l_partkey") % 7).cast("int").alias("col"), "l_quantity", (F.col("l_linenumber") % 2).alias("k"))
    return [rows.where(F.col("k") == k).groupBy("row", "col").agg(F.avg("l_quantity").alias("value")) for k in (0, 1)]


#: The tail by Simpson's rule on the density.
TAIL = """s AS (SELECT *, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS c, abs(t) / 2000 AS h FROM t), i AS (SELECT kind, sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * c * pow(1 + (k * h) * (k * h) / df, -(df + 1) / 2.0)) * any_value(h) / 3 AS area FROM s, (SELECT unnest(range(0, 2001)) AS k) GROUP BY kind)
 SELECT kind, round(t, 6) + 0.0 AS t, df, round(1 - 2 * area, 6) + 0.0 AS p FROM s JOIN i USING (kind)"""


@query(f"""WITH m AS (SELECT l_suppkey % 7 AS r, l_partkey % 7 AS c, {HALF.format(k=0)} AS a, {HALF.format(k=1)} AS b FROM lineitem GROUP BY 1, 2),
 t AS (SELECT 'paired' AS kind, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM m UNION ALL SELECT 'independent', (avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2 * (2.0::DOUBLE / count(*))), 2 * count(*) - 2 FROM m), {TAIL}""")
def ttest_probabilities(spark, d):
    """T, degrees of freedom and two-sided probability of two matrices."""
    a, b = _halves(spark, d)
    rows = M.paired_t(a, b).select(F.lit("paired").alias("kind"), "t", "df").unionByName(M.independent_t(a, b).select(F.lit("independent").alias("kind"), "t", "df"))
    return rounded(rows.withColumn("p", M.t_probability(F.col("t"), F.col("df").cast("double"))), "t", "p")


# --- bilayers: of a frame's points a third are heads, a third protein; the box is as wide as the points

LAYER, RADIUS = 0.05, 0.014


@query(f"""WITH {POINTS}, hd AS (SELECT * FROM pts WHERE id % 3 = 0), m AS (SELECT frame, min(z) + 10 * ((max(z) - min(z)) / 20) AS middle FROM hd GROUP BY frame),
 l AS (SELECT frame, any_value(middle) AS middle, count(*) FILTER (z > middle) AS n_up, count(*) FILTER (z < middle) AS n_low, avg(z) FILTER (z > middle) AS up, avg(z) FILTER (z < middle) AS low FROM hd JOIN m USING (frame) GROUP BY frame),
 sd AS (SELECT frame, 'up' AS side, up AS mid FROM l UNION ALL SELECT frame, 'low', low FROM l),
 p AS (SELECT DISTINCT q.frame, side, x + o.dx * {RADIUS} AS x, y + o.dy * {RADIUS} AS y FROM pts q JOIN sd ON sd.frame = q.frame AND q.id % 3 = 1 AND z > mid - {LAYER} AND z < mid + {LAYER}, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)),
 e AS (SELECT a.frame, a.side, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.frame = b.frame AND a.side = b.side AND (a.x <> b.x OR a.y <> b.y)),
 c AS (SELECT e.*, (bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax) AS cross_, (bx - ax) * (p.x - ax) + (by_ - ay) * (p.y - ay) AS along, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS len FROM e JOIN p ON p.frame = e.frame AND p.side = e.side),
 h AS (SELECT frame, side, ax, ay, bx, by_ FROM c GROUP BY ALL HAVING min(cross_) >= 0 AND count(*) FILTER (cross_ = 0 AND (along < 0 OR along > len)) = 0),
 ar AS (SELECT frame, sum(ax * by_ - bx * ay) FILTER (side = 'up') / 2 AS pu, sum(ax * by_ - bx * ay) FILTER (side = 'low') / 2 AS pl FROM h GROUP BY frame),
 bx AS (SELECT frame, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM pts GROUP BY frame),
 r AS (SELECT l.*, area, coalesce(pu, 0) AS pu, coalesce(pl, 0) AS pl FROM l JOIN bx USING (frame) LEFT JOIN ar USING (frame))
 SELECT frame, n_up, n_low, round(up - low, 6) + 0.0 AS thickness, round(area, 6) + 0.0 AS area, round(pu, 6) + 0.0 AS protein_up, round(pl, 6) + 0.0 AS protein_low, round((area - pu) / n_up, 6) + 0.0 AS upper, round((area - pl) / n_low, 6) + 0.0 AS lower, round((2 * area - pu - pl) / (n_up + n_low), 6) + 0.0 AS mean FROM r""")
def lipid_area(spark, d):
    """Box, leaflets, protein sections and areas per lipid."""
    p = points(spark, d)
    boxes = p.groupBy("frame").agg(*[(F.max(c) - F.min(c)).alias(f"l{c}") for c in "xy"])
    rows = Z.bilayer_areas(p.where("id % 3 = 0"), p.where("id % 3 = 1"), boxes, "frame", LAYER, RADIUS)
    numbers = ["thickness", "area", "protein_up", "protein_low", "upper", "lower", "mean"]
    return rounded(rows.select("frame", "n_up", "n_low", *numbers), *numbers)


# --- splits, times, writers


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('7/' || o_orderkey)) <= floor((SELECT count(*) FROM orders) * 0.8) AS \"first\" FROM orders")
def ratio_split(spark, d):
    """Four fifths of the orders, by digests of their keys."""
    return L.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 7)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS frame, (row_number() OVER (ORDER BY ts, event_id) - 1) * 2.0::DOUBLE AS time FROM events")
def row_times(spark, d):
    """Frames and times of rows that have no frame key."""
    return S.timed(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 2.0).select("event_id", "frame", "time")


@query("SELECT event_id::DOUBLE AS time, printf('%.3f', value)::DOUBLE AS value, printf('%.3f', user_id / 7.0::DOUBLE)::DOUBLE AS share FROM events")
def written_series(spark, d):
    """K1: a series written as CSV, and read."""
    folder = shared_folder(spark)
    rows = table(spark, d, "events").select(F.col("event_id").alias("time"), "value", (F.col("user_id") / 7).alias("share"))
    K.write_series(rows, folder, "time")
    return spark.read.schema("time double, value double, share double").csv(folder, header=True)


@query(f"WITH e AS (SELECT (l_suppkey % 12)::INT AS a, (l_partkey % 12)::INT AS b, count(*) AS weight FROM lineitem GROUP BY 1, 2) SELECT a, b, weight FROM e WHERE a <= b")
def written_edges(spark, d):
    """K6: edges written as CSV, and read."""
    folder = shared_folder(spark)
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 12).cast("int").alias("a"), (F.col("l_partkey") % 12).cast("int").alias("b")).agg(F.count("*").alias("weight"))
    K.write_edges(rows.where("a <= b"), folder)
    return spark.read.schema("a int, b int, weight long").csv(folder, header=True)


@query("SELECT p_brand AS \"group\", row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey AS atom_no FROM part")
def written_index(spark, d):
    """An index file written, and read from its splits."""
    folder = shared_folder(spark)
    part = table(spark, d, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("atom_no"))
    groups = part.groupBy("group").agg(F.array_sort(F.collect_list("atom_no")).alias("a")).select("group", F.posexplode("a").alias("pos", "atom_no"))
    K.write_index(groups, folder)
    return files.read_groups(spark, folder).select("group", "pos", "atom_no")
