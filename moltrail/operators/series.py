"""Time series: subsets, histograms and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranges import dense_index



def _one():
    """One window over all rows, for the few rows of a histogram."""
    return W.partitionBy(F.lit(0))


def time_subset(df: DataFrame, time: str, begin: float = 0, end: float = 0) -> DataFrame:
    """from begin if it is over 0, to end if that is over 0 and over begin; both inclusive."""
    if begin > 0:
        df = df.where(F.col(time) >= begin)
    if end > 0 and end > begin:
        df = df.where(F.col(time) <= end)
    return df


def stride(df: DataFrame, frame: str, step: int, dt: float = 1) -> DataFrame:
    """each step-th frame; time_ps = frame / step * dt."""
    return df.where(F.col(frame) % step == 0).withColumn("time_ps", F.col(frame) / step * dt)


def basin(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """rows with lo < value < hi for each column, strictly."""
    for c, (lo, hi) in bounds.items():
        df = df.where((F.col(c) > lo) & (F.col(c) < hi))
    return df


def shifted(df: DataFrame, order: str, skip: int, changes: dict[str, tuple[float, float]]) -> DataFrame:
    """leaves out the first rows by a dense row number `order` and replaces columns by value * scale + shift."""
    return df.where(F.col(order) >= skip).withColumns({c: F.col(c) * k + s for c, (k, s) in changes.items()})


def zero_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are 0 (or null) in every row, by one aggregation."""
    row = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in columns]).first()
    return [c for c in columns if not row[c]]


def drop_zero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """F15."""
    return df.drop(*zero_columns(df, columns))


def drop_zero_features(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """F15 for the long form: features that are not 0 somewhere."""
    kept = long.groupBy(feature).agg(F.max(F.abs(F.col(value))).alias("m")).where("m > 0").select(feature)
    return long.join(kept, feature, "left_semi")


def drop_all_null(df: DataFrame, axis: str = "columns") -> DataFrame:
    """F16: columns, or rows, that hold nulls only."""
    if axis == "rows":
        return df.dropna("all")
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c]])


def contact_residues(contacts: DataFrame, labels: DataFrame, residue: str, time: str, value: str) -> DataFrame:
    """values of residues whose sum over time is above 0, with their labels."""
    kept = contacts.groupBy(residue).agg(F.sum(value).alias("total")).where("total > 0").select(residue)
    return contacts.join(kept, residue, "left_semi").join(labels, residue, "left").select(time, *labels.columns, value)


def ranges(df: DataFrame, columns: Iterable[str], keys: list[str] = ()) -> DataFrame:
    """Least and greatest value (lo_c, hi_c) of each column by keys; equal ones are moved apart by half each way."""
    rows = df.groupBy(*keys).agg(*[e for c in columns for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    same = {c: F.col(f"lo_{c}") == F.col(f"hi_{c}") for c in columns}
    moved = {f"{p}_{c}": F.when(same[c], F.col(f"{p}_{c}") + s).otherwise(F.col(f"{p}_{c}")) for c in columns for p, s in (("lo", -0.5), ("hi", 0.5))}
    return rows.select(*keys, *[v.cast("double").alias(k) for k, v in moved.items()])


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal bins 0, 1, ...; the last is closed. Out of range: null."""
    k = F.floor((value - lo) * float(bins) / (hi - lo)).cast("int")
    return F.when((value >= lo) & (value <= hi), F.least(k, F.lit(bins - 1)))


def histogram(df: DataFrame, column: str, bins: int, keys: list[str] = ()) -> DataFrame:
    """Keys, bin, edge (its lower end), width, n; bins without values have 0."""
    lim = ranges(df, [column], keys)
    rows = df.join(lim, list(keys)) if keys else df.crossJoin(F.broadcast(lim))  # a single row
    rows = rows.withColumn("bin", bin_of(F.col(column), F.col(f"lo_{column}"), F.col(f"hi_{column}"), bins))
    counts = rows.where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = lim.where(F.col(f"lo_{column}").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col(f"hi_{column}") - F.col(f"lo_{column}")) / bins
    every = every.withColumn("width", width).withColumn("edge", F.col(f"lo_{column}") + F.col("bin") * width)
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", "edge", "width", F.coalesce("n", F.lit(0)).alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Bx, by, edge_x, edge_y, n over the whole grid."""
    lim = ranges(df, [x, y])
    rows = df.crossJoin(F.broadcast(lim))
    rows = rows.withColumns({"bx": bin_of(F.col(x), F.col(f"lo_{x}"), F.col(f"hi_{x}"), bins), "by": bin_of(F.col(y), F.col(f"lo_{y}"), F.col(f"hi_{y}"), bins)})
    counts = rows.where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(F.count("*").alias("n"))
    steps = F.sequence(F.lit(0), F.lit(bins - 1))
    every = lim.withColumn("bx", F.explode(steps)).withColumn("by", F.explode(steps))
    edge = lambda c, b: F.col(f"lo_{c}") + F.col(b) * ((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins)
    return every.join(counts, ["bx", "by"], "left").select("bx", "by", edge(x, "bx").alias("edge_x"), edge(y, "by").alias("edge_y"), F.coalesce("n", F.lit(0)).alias("n"))


def shared_histogram(df: DataFrame, column: str, series: str, edges: int, parity: bool = False) -> DataFrame:
    """Counts of each series over bins that all series share. With parity there is one bin less than
    edges and the greatest value isn't counted."""
    bins = edges - 1 if parity else edges
    lim = ranges(df, [column])
    rows = df.crossJoin(F.broadcast(lim)).withColumn("bin", bin_of(F.col(column), F.col(f"lo_{column}"), F.col(f"hi_{column}"), bins))
    if parity:
        rows = rows.where(F.col(column) < F.col(f"hi_{column}"))
    return rows.groupBy(series, "bin").agg(F.count("*").alias("n"))


def probability(hist: DataFrame, kind: str = "relative") -> DataFrame:
    """p = n / max(n) or, for "absolute", n / sum(n)."""
    return hist.withColumn("p", F.col("n") / (F.max("n") if kind == "relative" else F.sum("n")).over(_one()))


def pmf(hist: DataFrame, least: float = 0.5, kt: float = 2.5) -> DataFrame:
    """Free energy -kT ln(n / max n); empty bins count as `least` after the division."""
    p = F.col("n") / F.max("n").over(_one())
    return hist.withColumn("energy", -kt * F.log(F.when(p == 0, least).otherwise(p)))


def pmf2d(hist: DataFrame, least: float = 0.5, kt: float = 2.5) -> DataFrame:
    """Empty cells count as `least`; then divided by the maximum."""
    v = F.when(F.col("n") == 0, least).otherwise(F.col("n").cast("double"))
    rows = hist.withColumn("_v", v)
    return rows.withColumn("energy", -kt * F.log(F.col("_v") / F.max("_v").over(_one()))).drop("_v")


def pmf_tool(hist: DataFrame, rt: float = -2.5, finite: bool = False) -> DataFrame:
    """RT ln(h / max h); an empty bin counts as the second least count / 2.5. That may be 0: infinite, or null if finite."""
    second = F.element_at(F.array_sort(F.collect_list("n").over(_one())), 2)
    v = F.when(F.col("n") == 0, second / 2.5).otherwise(F.col("n").cast("double"))
    p = v / F.max("n").over(_one())
    return hist.withColumn("energy", F.when(p > 0, rt * F.log(p)).otherwise(F.lit(None if finite else float("inf")).cast("double")))


def pmf_tool2d(hist: DataFrame, rt: float = -2.5) -> DataFrame:
    """With the logarithm to base 2; an empty cell counts as 0.4 / 2.5."""
    v = F.when(F.col("n") == 0, 0.4 / 2.5).otherwise(F.col("n").cast("double"))
    return hist.withColumn("energy", rt * F.log2(v / F.max("n").over(_one())))


def pmf_plot(hist: DataFrame, least: float = 1.0, kt: float = 2.5) -> DataFrame:
    """A33 for histograms: counts under `least` count as half of it."""
    rows = hist.withColumn("_v", F.when(F.col("n") < least, least / 2).otherwise(F.col("n").cast("double")))
    return rows.withColumn("energy", -kt * F.log(F.col("_v") / F.max("_v").over(_one()))).drop("_v")


def series_energy(df: DataFrame, column: str, kt: float = 2.5) -> DataFrame:
    """A33 for series: -kT ln(y / max y)."""
    top = df.agg(F.max(column).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("energy", -kt * F.log(F.col(column) / F.col("_top"))).drop("_top")


def entropy(hist: DataFrame, kt: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """-kT sum p ln p over bins that aren't empty."""
    total = F.sum("n").over(W.partitionBy(*keys) if keys else _one())
    rows = hist.where("n > 0").withColumn("p", F.col("n") / total)
    return rows.groupBy(*keys).agg((-kt * F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """H(x) + H(y) - H(x, y), from one two-dimensional histogram."""
    joint = histogram2d(df, x, y, bins)
    parts = [("hx", joint.groupBy("bx").agg(F.sum("n").alias("n"))), ("hy", joint.groupBy("by").agg(F.sum("n").alias("n"))), ("hxy", joint)]
    out = None
    for name, h in parts:
        e = entropy(h).withColumnRenamed("entropy", name)
        out = e if out is None else out.crossJoin(F.broadcast(e))  # single rows
    return out.withColumn("mi", F.col("hx") + F.col("hy") - F.col("hxy"))


def mutual_information_matrix(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """A35 of all pairs: a, b (a before b in columns), hx, hy, hxy, mi. One pass bins every column and sends, for each row, the bins of
    each pair, which are counted before they are shuffled; what is left are bins x bins counts a pair. Of a pair the rows count
    where neither is null."""
    lim = ranges(df, columns)
    bin_ = F.array(*[bin_of(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins) for c in columns])
    rows = df.crossJoin(F.broadcast(lim)).select(bin_.alias("bins"))  # a single row of limits
    rows = rows.select("bins", F.posexplode("bins").alias("i", "x")).where("x IS NOT NULL")
    rest = F.expr("slice(bins, i + 2, size(bins))")
    rows = rows.select("i", "x", F.posexplode(rest).alias("j", "y")).where("y IS NOT NULL")
    joint = rows.groupBy("i", "j", "x", "y").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(W.partitionBy("i", "j", *by))
    joint = joint.withColumns({"t": total(), "nx": total("x"), "ny": total("y")})
    part = lambda n: F.sum(-F.col("n") / F.col("t") * F.log(F.col(n) / F.col("t")))  # noqa: E731  of a marginal each cell has its share
    out = joint.groupBy("i", "j").agg(part("nx").alias("hx"), part("ny").alias("hy"), part("n").alias("hxy"))
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(names[F.col("i")].alias("a"), names[F.col("i") + F.col("j") + 1].alias("b"), "hx", "hy", "hxy", (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"))


def timed(df: DataFrame, order: str | list[str], dt: float = 1.0) -> DataFrame:
    """Frame (0, 1, ... in the order of the keys) and time for rows of a source that has no frame key."""
    rows = dense_index(df, *([order] if isinstance(order, str) else order))
    return rows.withColumnRenamed("_i", "frame").withColumn("time", F.col("frame") * float(dt))


def scaled(df: DataFrame, columns: list[str], method: str = "zscore") -> DataFrame:
    """Mean, zscore (population deviation), minmax or none; a constant column gives 0. P2 is "range"
    ((x - mean) / (max - min); null for a constant column). Statistics come from one aggregation."""
    if method == "none":
        return df
    stats = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in columns]
    rows = df.crossJoin(F.broadcast(df.agg(*stats)))
    v = lambda c: F.col(c) - F.col(f"_{c}.m")
    span = lambda c: F.col(f"_{c}.hi") - F.col(f"_{c}.lo")
    how = {
        "mean": v,
        "zscore": lambda c: F.when(F.col(f"_{c}.s") == 0, 0.0).otherwise(v(c) / F.col(f"_{c}.s")),
        "minmax": lambda c: F.when(span(c) == 0, 0.0).otherwise((F.col(c) - F.col(f"_{c}.lo")) / span(c)),
        "range": lambda c: F.when(span(c) != 0, v(c) / span(c)),
    }[method]
    return rows.withColumns({c: how(c) for c in columns}).drop(*[f"_{c}" for c in columns])
