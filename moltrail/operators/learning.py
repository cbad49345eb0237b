"""Model metrics, splits, feature selection and principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import long_coordinates, wide_components
from .correlations import uncorrelated
from .ranges import dense_index, running_sums
from .series import scaled, zero_columns
from .structure import superposed
from .trees import importances


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """A, b, r for each pair of columns, by one pass."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a in columns for b in columns]
    return df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Tp, fp, tn, fn; a score over the threshold is positive."""
    yes, true = F.col(score) > threshold, F.col(label) == 1
    return df.agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & ~true).alias("tn"), F.count_if(~yes & true).alias("fn"))


def metrics(c: DataFrame) -> DataFrame:
    """A45 from A44; undefined ones are null."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), F.try_divide(fp, fp + tn).alias("fallout"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """For each distinct score, from the highest, positives and negatives at it (pos, neg) and up to it (tp, fp).
    Ties are merged first; distinct scores stand in ranged partitions."""
    g = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running_sums(g, [F.desc(score)], {"tp": "pos", "fp": "neg"})


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """The area by trapezoids."""
    return roc(df, score, label).agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def enrichment(df: DataFrame, score: str, label: str, tie: str, share: float) -> DataFrame:
    """The first floor(N * share) by score; their share of hits over N / (N * share). The cut is the score of
    the last row taken, found by a count for each distinct score; rows tied at the cut are numbered by `tie`."""
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("hits"))
    counts = df.groupBy(score).agg(F.count("*").alias("c"), F.count_if(F.col(label) == 1).alias("h"))
    cum = running_sums(counts, [F.desc(score)], {"upto": "c"}).crossJoin(F.broadcast(n)).withColumn("take", F.floor(F.col("n") * share))
    whole = cum.agg(F.sum(F.when(F.col("upto") <= F.col("take"), F.col("h"))).alias("whole"), F.min(F.when(F.col("upto") > F.col("take"), F.struct(F.col("upto"), F.col(score).alias("s"), (F.col("take") - F.col("upto") + F.col("c")).alias("more")))).alias("cut"), F.first("n").alias("n"), F.first("hits").alias("hits"))
    edge = df.join(F.broadcast(whole), df[score] == F.col("cut.s"))  # rows tied at the cut
    edge = dense_index(edge.select(F.col(tie).alias("t"), F.col(label).alias("l"), F.col("cut.more").alias("more")), "t").where("_i < more").agg(F.count_if(F.col("l") == 1).alias("tied"))
    rows = whole.crossJoin(edge)
    return rows.select((F.try_divide(F.coalesce("whole", F.lit(0)) + F.col("tied"), F.col("hits")) * (F.col("n") / (F.col("n") * share))).alias("enrichment"))


def k_fold(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    """Contiguous folds 0.., the first n % k one longer. Row numbers come from sorted partitions' sizes."""
    rows = dense_index(df, order)
    total = df.agg(F.count("*").alias("_n"))
    rows = rows.crossJoin(F.broadcast(total))
    size, more = F.expr(f"_n div {k}"), F.col("_n") % k
    cut = more * (size + 1)
    fold = F.when(F.col("_i") < cut, F.expr(f"_i div (_n div {k} + 1)")).otherwise(more + F.floor((F.col("_i") - cut) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_i", "_n")


def random_groups(df: DataFrame, order: str, n: int, seed: int = 0) -> DataFrame:
    """N equal groups in a random order that the key decides; the last takes the remainder."""
    rows = dense_index(df.withColumn("_r", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(order).cast("string")).cast("binary"))), "_r", order)
    rows = rows.crossJoin(F.broadcast(df.agg(F.greatest(F.floor(F.count("*") / n), F.lit(1)).alias("_c"))))
    return rows.withColumn("part", F.least(F.floor(F.col("_i") / F.col("_c")), F.lit(n - 1)).cast("int")).drop("_r", "_i", "_c")


def split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """A column first, true for floor(n * ratio) rows that a digest of the key and the seed chooses, whatever the partitions. The digest
    of the last row taken is found by counting prefixes, four digits more a round, until few rows share one. Rows of one key
    stay together: where the cut would part them, they are all left out."""
    rows = df.withColumn("_d", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    digests = rows.select("_d")
    take = int(digests.count() * ratio)
    prefix, limit = "", None
    while limit is None:
        own = digests.where(F.col("_d").startswith(prefix)) if prefix else digests
        counts = own.groupBy(F.substring("_d", 1, len(prefix) + 4).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # 65,536 at most
        for r in counts:
            if r["n"] > take:
                prefix = r["p"]
                break
            take -= r["n"]
        else:
            limit = "g"  # all digests are below
        if limit is None and len(prefix) == 32:
            limit = prefix
    return rows.withColumn("first", F.col("_d") < limit).drop("_d")


def bootstrap(df: DataFrame, order: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows drawn with replacement; draws are hashes of the draw's number."""
    rows = dense_index(df, order)
    size = df.agg(F.count("*").alias("_n"))
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(size)).select(F.col("id").alias("draw"), F.expr(f"cast(conv(substring(md5(concat('{seed}/', id)), 1, 15), 16, 10) as bigint) % _n").alias("_i"))
    return draws.join(rows, "_i").drop("_i")


def assembled(df: DataFrame, columns: list[str], method: str = "none") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(scaled(df, columns, method))


def signed_components(model) -> list[list[float]]:
    """Components with their largest loading positive."""
    pc = model.pc.toArray().T
    return [[float(v) * (1.0 if c[abs(c).argmax()] > 0 else -1.0) for v in c] for c in pc]


def pca(df: DataFrame, columns: list[str], k: int, method: str = "mean") -> tuple[DataFrame, list[list[float]], list[float]]:
    """Rows with PC_0.., the components and the explained shares; k is at most the number of columns. The
    projection is of scaled data, as ML's transform doesn't centre."""
    k = min(k, len(columns))
    rows = assembled(df, columns, method)
    model = PCA(k=k, inputCol="features", outputCol="_p").fit(rows)
    parts = signed_components(model)
    mean = rows.agg(*[F.avg(c).alias(c) for c in columns]).first() if method == "none" else None
    for i, c in enumerate(parts):
        total = sum((F.col(n) - (mean[n] if mean else 0.0)) * w for n, w in zip(columns, c))
        rows = rows.withColumn(f"PC_{i}", total)
    return rows.drop("features"), parts, [float(v) for v in model.explainedVariance.toArray()]


def angle_features(angles: DataFrame, frame: str, tuple_id: str, angle: str, ids: list) -> DataFrame:
    """Cos and sin of each angle, a column each."""
    rows = angles.groupBy(frame).pivot(tuple_id, ids).agg(F.first(F.cos(angle)).alias("cos"), F.first(F.sin(angle)).alias("sin"))
    return rows


def xyz_pca(coords: DataFrame, reference: DataFrame, frame: str, atom: str, k: int) -> tuple[DataFrame, list[float]]:
    """Frames moved onto the reference (the atoms to take, of which every frame has a place), then components of their coordinates."""
    chosen = coords.join(reference.select(atom), atom, "left_semi")
    rows = long_coordinates(superposed(chosen, reference, [frame], atom), frame, atom)
    found = wide_components(rows, frame, "feature", "value", k)
    return found.projections, found.shares


def contact_pca(contacts: DataFrame, frames: DataFrame, frame: str, feature: str, value: str, k: int) -> tuple[DataFrame, list[float]]:
    """P5: components of contact maps, however many contacts there are; a frame's contacts that aren't listed are 0."""
    found = wide_components(contacts, frame, feature, value, k, all_rows=frames)
    return found.projections, found.shares


def dihedral_pca(angles: DataFrame, frame: str, tuple_id: str, angle: str, ids: list, k: int) -> tuple[DataFrame, list[list[float]], list[float]]:
    """Components of the angles' cosines and sines."""
    rows = angle_features(angles, frame, tuple_id, angle, ids)
    return pca(rows, [c for c in rows.columns if c != frame], k)


def wide_dihedral_pca(angles: DataFrame, frame: str, tuple_id: str, angle: str, k: int) -> tuple[DataFrame, list[float]]:
    """P6 for any number of angles: each stands in long form by its cosine and its sine."""
    both = F.explode(F.array(*[F.struct(F.struct(F.col(tuple_id).alias("tuple"), F.lit(name).alias("part")).alias("feature"), f(F.col(angle)).alias("value")) for name, f in (("cos", F.cos), ("sin", F.sin))])).alias("_c")
    found = wide_components(angles.select(frame, both).select(frame, "_c.*"), frame, "feature", "value", k)
    return found.projections, found.shares


def most_important(df: DataFrame, columns: list[str], label: str, k: int, **parameters) -> list[str]:
    """Columns whose importance is over the (k + 1)-th; all if there are no more than k."""
    v = importances(df, columns, label, **parameters)
    if k >= len(columns):
        return columns
    limit = sorted(v.values(), reverse=True)[k]
    return [c for c in columns if v[c] > limit]


def clean(df: DataFrame, columns: list[str], label: str, keep: int = 800, limit: float = 0.85, k: int = 20, **parameters):
    """P10: zero columns out, range scaling, importance (with parameters of the trees), decorrelation, components."""
    columns = [c for c in columns if c not in set(zero_columns(df, columns))]
    rows = scaled(df, columns, "range")
    columns = uncorrelated(rows, most_important(rows, columns, label, keep, **parameters), limit)
    return pca(rows, columns, k)
