"""Pair and range joins of points, and what is counted over them.

Points: struct_id (optional), frame, an id, x, y, z. Ranges are joined on a grid of cells as wide as
the cutoff: one side stands in its own cell, the other in its 27 neighbours (14 where both sides are one group), so that
the join is an equality join on (frame, cell) whose size follows the number of near pairs. A frame, or a cell, that holds
very many points of both sides is cut into tiles, so that its product spreads over tasks; where the tiles are many, blocks are packed
into arrays and stay where they are, so that what is written grows with the points, not with their product."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import geometry as G


#: Rows of one side of a key that a task joins with as many of the other.
TILE = 1024
#: Tiles of one key up to which its rows are dealt to tiles, each once a block of the other side. Of a key with more, blocks are packed.
DEALT = 16


def _named(points: DataFrame, side: str, keep: list[str]) -> DataFrame:
    return points.select(*[F.col(c).alias(f"{c}_{side}") for c in dict.fromkeys([*keep, "x", "y", "z"])])


def _blocks(left: DataFrame, right: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """The keys, named as in keys, whose product is over tile x tile rows: how many blocks each side is cut into there (_n_a, _n_b)."""
    size = lambda rows, side: rows.groupBy(*[F.col(f"{c}_{side}").alias(c) for c in keys]).agg(F.count("*").alias(f"_n_{side}"))
    both = size(left, "a").join(size(right, "b"), keys).where(F.col("_n_a") * F.col("_n_b") > tile * tile)
    return both.select(*keys, *[F.ceil(F.col(f"_n_{side}") / tile).cast("int").alias(f"_n_{side}") for side in "ab"])


def _with_blocks(rows: DataFrame, side: str, keys: list[str], blocks: DataFrame, how: str) -> DataFrame:
    """Rows, their digests (_h) and the numbers of blocks of their keys, of which there are at most one in 2 * tile rows: they are
    broadcast, so that rows don't move for them."""
    cut = blocks.withColumnsRenamed({c: f"{c}_{side}" for c in keys})
    return rows.withColumn("_h", F.xxhash64(*rows.columns)).join(F.broadcast(cut), [f"{c}_{side}" for c in keys], how)


def _tiles() -> Column:
    return F.col("_n_a").cast("long") * F.col("_n_b")


def _dealt(rows: DataFrame, side: str, keys: list[str], blocks: DataFrame, most: int | None = None) -> DataFrame:
    """Rows with the tiles (_t_a, _t_b) that they stand in: one block of their own side, which their values choose, by every block of the
    other. Keys that are not cut have the tile 0, 0; keys of more tiles than most are left out."""
    own, other = side, "ba"["ab".index(side)]
    rows = _with_blocks(rows, side, keys, blocks, "left")
    rows = rows.where(F.coalesce(_tiles(), F.lit(1)) <= most) if most else rows
    block = F.pmod("_h", F.coalesce(f"_n_{own}", F.lit(1))).cast("int").alias(f"_t_{own}_{side}")
    rest = [c for c in rows.columns if c not in ("_h", "_n_a", "_n_b")]
    return rows.select(*rest, block, F.explode(F.sequence(F.lit(0), F.coalesce(f"_n_{other}", F.lit(1)) - 1)).alias(f"_t_{other}_{side}"))


def _parts(rows: DataFrame) -> int:
    """Partitions of packs of one side: a product of two has four tasks a shuffle partition."""
    return ceil((4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5)


def _in_blocks(rows: DataFrame, side: str, keys: list[str], blocks: DataFrame) -> DataFrame:
    """Rows of keys of more than DEALT tiles, with their block (_g)."""
    rows = _with_blocks(rows, side, keys, blocks.where(_tiles() > DEALT), "inner")
    return rows.withColumn("_g", F.xxhash64(*[f"{c}_{side}" for c in keys], F.pmod("_h", f"_n_{side}"))).drop("_h", "_n_a", "_n_b")


def _packed(rows: DataFrame, side: str, keys: list[str], blocks: DataFrame) -> DataFrame:
    """Of keys of more than DEALT tiles a row for each block: the keys, and an array for each other column."""
    own = [f"{c}_{side}" for c in keys]
    rest = [c for c in rows.columns if c not in own]
    packs = _in_blocks(rows, side, keys, blocks).repartition(_parts(rows), "_g").groupBy("_g", *own).agg(F.collect_list(F.struct(*rest)).alias("_p"))
    return packs.select(*own, *[F.col("_p")[c].alias(c) for c in rest])


def _unpacked(rows: DataFrame, arrays: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in arrays]
    rows = rows.select("*", F.posexplode(arrays[0]).alias("_i", "_v"))
    return rows.select(*rest, F.col("_v").alias(arrays[0]), *[F.col(c)[F.col("_i")].alias(c) for c in arrays[1:]])


def _equal(keys: list[str]) -> list[Column]:
    return [F.col(f"{c}_a") == F.col(f"{c}_b") for c in keys]


def _by_tiles(left: DataFrame, right: DataFrame, keys: list[str], blocks: DataFrame) -> DataFrame:
    """Joined rows of keys of up to DEALT tiles."""
    rows = _dealt(left, "a", keys, blocks, DEALT).join(_dealt(right, "b", keys, blocks, DEALT), _equal([*keys, "_t_a", "_t_b"]))
    return rows.select(*left.columns, *right.columns)


def _by_packs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Packs of both sides, a row for each tile."""
    return left.hint("shuffle_replicate_nl").join(right, _equal(keys))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], tile: int | None) -> DataFrame:
    """Rows of left and right, whose columns end in _a and _b, that agree in the keys. Where a key has many rows on both sides, its
    product is cut into tiles, blocks of one side by blocks of the other, which spread over tasks as if they were keys. Where these are
    many, tasks read partitions of packed blocks of both sides, all of one by all of the other, and no row is written twice."""
    if not tile:
        return left.join(right, _equal(keys))
    blocks = _blocks(left, right, keys, tile)
    packs = _by_packs(_packed(left, "a", keys, blocks), _packed(right, "b", keys, blocks), keys)
    for side, own in (("b", right), ("a", left)):
        packs = _unpacked(packs, [c for c in own.columns if c not in [f"{k}_{side}" for k in keys]])
    return _by_tiles(left, right, keys, blocks).unionByName(packs.select(*left.columns, *right.columns))


def all_pairs(a: DataFrame, b: DataFrame, on: list[str], keep: list[str], tile: int | None = TILE) -> DataFrame:
    """The true product of two groups within each key, with the distance d. Columns of the sides end in _a and _b. The product of one key
    is cut into tiles of tile x tile rows; None joins by key alone."""
    left, right = _named(a, "a", [*on, *keep]), _named(b, "b", [*on, *keep])
    rows = _joined(left, right, on, tile)
    return rows.withColumn("d", G.distance(G.vector("", "_a"), G.vector("", "_b"))).drop(*[f"{c}_b" for c in on]).withColumnsRenamed({f"{c}_a": c for c in on})


def _in_cells(points: DataFrame, side: str, cutoff: float, on: list[str], keep: list[str]) -> DataFrame:
    return _named(points, side, [*on, *keep]).withColumns({f"c{c}_{side}": F.floor(F.col(f"{c}_{side}") / cutoff) for c in "xyz"})


def _shifted(rows: DataFrame, side: str, shifts: list[tuple[int, int, int]], named: str | None = None) -> DataFrame:
    """Rows once for each shift of their cell; named keeps the shift's number."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, "xyz")], F.lit(k).alias("k")) for k, s in enumerate(shifts)])
    rows = rows.withColumn("_s", F.explode(steps)).withColumns({f"c{c}_{side}": F.col(f"c{c}_{side}") + F.col(f"_s.{c}") for c in "xyz"})
    return (rows.withColumn(named, F.col("_s.k")) if named else rows).drop("_s")


AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
#: The cell itself, then one of each two that lie opposite.
HALF_AROUND = [(0, 0, 0), *[s for s in AROUND if s > (0, 0, 0)]]


def near_pairs(a: DataFrame, b: DataFrame, cutoff: float, on: list[str], keep: list[str], tile: int | None = TILE) -> DataFrame:
    """Pairs within the cutoff, by cells; otherwise as all_pairs(). A crowded cell's product is cut into tiles."""
    left = _in_cells(a, "a", cutoff, on, keep)
    right = _shifted(_in_cells(b, "b", cutoff, on, keep), "b", AROUND)
    rows = _joined(left, right, [*on, "cx", "cy", "cz"], tile)
    rows = rows.withColumn("d", G.distance(G.vector("", "_a"), G.vector("", "_b"))).where(F.col("d") <= cutoff)
    return rows.drop(*[f"{c}_b" for c in on], *[f"c{c}_{s}" for c in "xyz" for s in "ab"]).withColumnsRenamed({f"{c}_a": c for c in on})


def _halves(points: DataFrame, cutoff: float, on: list[str], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two sides of near pairs of one group: half of the cells around are enough, as a pair of two cells meets in one of them."""
    return _in_cells(points, "a", cutoff, on, keep), _shifted(_in_cells(points, "b", cutoff, on, keep), "b", HALF_AROUND, "_k_b")


def _each_once(rows: DataFrame, cutoff: float, on: list[str], id_: str, keep: list[str]) -> DataFrame:
    """Near pairs of joined halves, their sides named by their ids."""
    rows = rows.withColumn("d", G.distance(G.vector("", "_a"), G.vector("", "_b"))).where(F.col("d") <= cutoff)
    first = F.col(f"{id_}_a") < F.col(f"{id_}_b")
    rows = rows.where(F.when(F.col("_k_b") == 0, first).otherwise(F.col(f"{id_}_a") != F.col(f"{id_}_b")))
    sides = dict.fromkeys([*keep, "x", "y", "z"])
    named = [F.when(first, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}")).alias(f"{c}_{s}") for s, t in ("ab", "ba") for c in sides if c not in on]
    return rows.select(*[F.col(f"{c}_a").alias(c) for c in on], *named, "d")


def self_pairs(points: DataFrame, cutoff: float, on: list[str], id_: str, keep: list[str] = (), tile: int | None = TILE) -> DataFrame:
    """Near pairs of one group, each once: id_a < id_b."""
    keep = [id_, *keep]
    return _each_once(_joined(*_halves(points, cutoff, on, keep), [*on, "cx", "cy", "cz"], tile), cutoff, on, id_, keep)


def _arrow_packs(rows: DataFrame, side: str, keys: list[str], blocks: DataFrame) -> DataFrame:
    """As _packed(), but with the block as an Arrow table of its other columns in a binary (_p_a, _p_b)."""
    own = [f"{c}_{side}" for c in keys]
    rest = [c for c in rows.columns if c not in own]

    def pack(table):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select(rest).schema) as out:
            out.write_table(table.select(rest).combine_chunks())
        return table.select(own).slice(0, 1).append_column("_p", pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    rows = _in_blocks(rows, side, keys, blocks)
    packs = rows.groupBy("_g").applyInArrow(pack, T.StructType([*[rows.schema[c] for c in own], T.StructField("_p", T.BinaryType())]))
    return packs.withColumnRenamed("_p", f"_p_{side}").repartition(_parts(rows))


def _tile_sums(kind: str, by: str, id_: str, cutoff: float | None = None):
    """A function of two blocks: for each value of by its pairs, those that have a distance, and the least and the sum of distances. With a
    cutoff of near pairs alone, each once, and for the value of the point of the smaller id."""

    def sums(block_a, block_b):
        import numpy as np
        import pyarrow as pa

        left, right = (pa.ipc.open_stream(bytes(p)).read_all() for p in (block_a, block_b))
        axes = [[t[f"{c}_{s}"].combine_chunks() for c in "xyz"] for t, s in ((left, "a"), (right, "b"))]
        known_a, known_b = (np.flatnonzero(np.logical_and.reduce([c.is_valid().to_numpy(False) for c in cs])) for cs in axes)
        n_a, n_b = len(left), len(right)
        n, m, total, least = (np.full(n_a + n_b, v) for v in (0, 0, 0.0, np.inf))  # of the rows of the left block, then of the right
        keys, first = left[f"{by}_a"].to_pylist(), 0
        if cutoff is None:
            n[:n_a] = n_b
            keys += keys[:1] * n_b
        else:  # by ids, and on the right the points of the same cell first: of these the ones behind a point in order are enough
            keys += right[f"{by}_b"].to_pylist()
            ids_a, ids_b, across = left[f"{id_}_a"].to_numpy(), right[f"{id_}_b"].to_numpy(), right["_k_b"].to_numpy() != 0
            known_a = known_a[np.argsort(ids_a[known_a])]
            known_b = known_b[np.lexsort((ids_b[known_b], across[known_b]))]
            ids_a, ids_b, same = ids_a[known_a], ids_b[known_b], int((~across[known_b]).sum())
        a, b = (np.array([c.to_numpy(False) for c in cs])[:, k] for cs, k in zip(axes, (known_a, known_b)))
        for k in range(0, len(known_a), 32):
            at = known_a[k : k + 32]
            if cutoff is not None:
                first = int(np.searchsorted(ids_b[:same], ids_a[k], "right"))
            d = np.square(a[0, k : k + 32, None] - b[0, first:])
            for c in (1, 2):
                d += np.square(a[c, k : k + 32, None] - b[c, first:])
            np.sqrt(d, out=d)
            if cutoff is None:
                m[at], total[at], least[at] = len(known_b), d.sum(axis=1), np.fmin.reduce(d, axis=1, initial=np.inf)
                continue
            near, ids = d <= cutoff, ids_a[k : k + 32, None]
            own = near & (ids < ids_b[first:])
            n[at], total[at], least[at] = own.sum(axis=1), np.where(own, d, 0).sum(axis=1), np.where(own, d, np.inf).min(axis=1, initial=np.inf)
            if same < len(known_b):
                d, at = d[:, same - first :], n_a + known_b[same:]
                own = near[:, same - first :] & (ids > ids_b[same:])
                n[at], total[at] = n[at] + own.sum(axis=0), total[at] + np.where(own, d, 0).sum(axis=0)
                least[at] = np.minimum(least[at], np.where(own, d, np.inf).min(axis=0, initial=np.inf))
        m = m if cutoff is None else n
        place = {v: k for k, v in enumerate(dict.fromkeys(keys))}
        of = np.array([place[v] for v in keys])
        low = np.full(len(place), np.inf)
        np.fmin.at(low, of, least)
        pairs, measured, whole = (np.bincount(of, v, len(place)) for v in (n, m, total))
        return [(v, int(pairs[k]), int(measured[k]), float(low[k]) if measured[k] else None, float(whole[k])) for v, k in place.items() if pairs[k]]

    return F.udf(sums, f"array<struct<by: {kind}, n: long, m: long, least: double, total: double>>", useArrow=False)


def _sums(left: DataFrame, right: DataFrame, keys: list[str], by: str, id_: str, tile: int, rows_of, cutoff: float | None = None) -> DataFrame:
    """by, n, least, mean: of joined rows, which rows_of gives a distance d, and of tiles of packs."""
    blocks = _blocks(left, right, keys, tile)
    rows = rows_of(_by_tiles(left, right, keys, blocks)).groupBy(F.col(f"{by}_a").alias("by"))
    rows = rows.agg(F.count("*").alias("n"), F.count("d").alias("m"), F.min("d").alias("least"), F.sum("d").alias("total"))
    packs = _by_packs(_arrow_packs(left, "a", keys, blocks), _arrow_packs(right, "b", keys, blocks), keys)
    tiles = packs.select(F.explode(_tile_sums(dict(left.dtypes)[f"{by}_a"], by, id_, cutoff)("_p_a", "_p_b")).alias("s")).select("s.*")
    sums = rows.unionByName(tiles).groupBy(F.col("by").alias(by))
    return sums.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.try_divide(F.sum("total"), F.sum("m")).alias("mean"))


def pair_sums(a: DataFrame, b: DataFrame, on: list[str], id_: str, by: str, tile: int = TILE) -> DataFrame:
    """all_pairs() summed up for each value of a's column by: pairs (n), the least and the mean distance. Tiles of packed blocks become
    sums in one step of array arithmetic, without a row for each pair."""
    rows_of = lambda rows: rows.withColumn("d", G.distance(G.vector("", "_a"), G.vector("", "_b")))
    return _sums(_named(a, "a", [*on, id_, by]), _named(b, "b", [*on, id_]), on, by, id_, tile, rows_of)


def self_pair_sums(points: DataFrame, cutoff: float, on: list[str], id_: str, by: str, tile: int = TILE) -> DataFrame:
    """self_pairs() summed up, as by pair_sums(), for each value of the column by of the point of the smaller id."""
    left, right = _halves(points.where(F.col(id_).isNotNull()), cutoff, on, [id_, by])
    rows_of = lambda rows: _each_once(rows, cutoff, on, id_, [id_, by])
    return _sums(left, right, [*on, "cx", "cy", "cz"], by, id_, tile, rows_of, cutoff)


def soft_pairs(a: DataFrame, b: DataFrame, d0: float, least: float, on: list[str], keep: list[str]) -> DataFrame:
    """Pairs whose switched weight w is at least `least`, which bounds their distance."""
    rows = near_pairs(a, b, G.switch_reach(least, d0) * (1 + 1e-9), on, keep)
    return rows.withColumn("w", G.switch(F.col("d"), d0)).where(F.col("w") >= least)


def all_soft_pairs(a: DataFrame, b: DataFrame, d0: float, on: list[str], keep: list[str]) -> DataFrame:
    """All pairs with their switched weight w, whose length is twice d0, however far they are: the true product of
    groups that are chosen small."""
    return all_pairs(a, b, on, keep).withColumn("w", G.switch(F.col("d"), 2 * d0))


def coordination_number(pairs: DataFrame, frames: DataFrame, on: list[str], weight: Column | None = None) -> DataFrame:
    """Contacts of each frame, zero where it has none. Pairs are summed before they meet the frame list."""
    sums = pairs.groupBy(*on).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))
    return frames.select(*on).distinct().join(sums, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def contacts_by(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Contacts for each frame and pair of residues (A2)."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"))


def scaled_contacts(pairs: DataFrame, atoms: DataFrame, frame: str, residue: str) -> DataFrame:
    """Contacts of a residue pair divided by the product of its residues' numbers of atoms (A3)."""
    size = atoms.groupBy(frame, residue).agg(F.count("*").alias("size"))
    rows = contacts_by(pairs, [frame, f"{residue}_a", f"{residue}_b"])
    for side in "ab":
        named = size.select(frame, F.col(residue).alias(f"{residue}_{side}"), F.col("size").alias(f"size_{side}"))
        rows = rows.join(named, [frame, f"{residue}_{side}"])
    return rows.withColumn("w", F.col("n") / (F.col("size_a") * F.col("size_b")))


def contact_mean(pairs: DataFrame, keys: list[str], n_frames: Column | int, weight: Column | None = None) -> DataFrame:
    """Contact probability: the sum over frames divided by the number of frames, also those without the contact (A4)."""
    total = F.sum(weight) if weight is not None else F.count("*")
    return pairs.groupBy(*keys).agg((total / n_frames).alias("p"))


def critical_map(values: DataFrame, keys: list[str], value: str, n_frames: int | Column, levels: list[float], cutoff: float = 0.48) -> DataFrame:
    """For each level the share of frames over it, and whether that reaches the cutoff."""
    shares = [F.struct(F.lit(float(v)).alias("level"), (F.sum((F.col(value) > v).cast("int")) / n_frames).alias("share")) for v in levels]
    rows = values.groupBy(*keys).agg(F.array(*shares).alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")
    return rows.withColumn("critical", (F.col("share") >= cutoff).cast("int"))


def frame_types(pairs: DataFrame, frames: DataFrame, frame: str, donor: str) -> DataFrame:
    """1 if each of the two donor sets (0, 1) has exactly one contact, 2 if either has two, else 0; with counts."""
    sums = pairs.groupBy(frame).agg(*[F.count_if(F.col(donor) == k).alias(f"n{k}") for k in (0, 1)])
    rows = frames.select(frame).distinct().join(sums, frame, "left").na.fill(0, ["n0", "n1"])
    kind = F.when((F.col("n0") == 1) & (F.col("n1") == 1), 1).when((F.col("n0") == 2) | (F.col("n1") == 2), 2).otherwise(0)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def energy_weighted_map(contacts: DataFrame, energies: DataFrame, frame: str, keys: list[str], kt: float = G.KT) -> DataFrame:
    """Sum of contacts * exp(-E / kT) over frames, divided by its maximum."""
    rows = contacts.join(energies, frame).groupBy(*keys).agg(F.sum(F.col("w") * F.exp(-F.col("energy") / kt)).alias("v"))
    return rows.withColumn("v", F.col("v") / F.max("v").over(W.partitionBy(F.lit(0))))


def grid(bounds: DataFrame, spacing: float) -> DataFrame:
    """Points at lo + k * spacing below hi on three axes, numbered x-major. bounds: keys and lo_x, hi_x, ..."""
    keys = [c for c in bounds.columns if c[:3] not in ("lo_", "hi_")]
    rows = bounds
    for c in "xyz":
        rows = rows.withColumn(f"n_{c}", F.ceil((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / spacing).cast("long"))
    for c in "xyz":
        rows = rows.withColumn(f"i_{c}", F.explode(F.expr(f"sequence(0L, n_{c} - 1)")))
    cell = (F.col("i_x") * F.col("n_y") + F.col("i_y")) * F.col("n_z") + F.col("i_z")
    return rows.select(*keys, cell.alias("cell"), *[(F.col(f"lo_{c}") + F.col(f"i_{c}") * spacing).alias(c) for c in "xyz"])


def first_cell(cells: DataFrame, atoms: DataFrame, cutoff: float, on: list[str], atom: str) -> DataFrame:
    """For each atom the first cell within the cutoff, else -1."""
    hits = near_pairs(cells.withColumn(atom, F.lit(None).cast("long")), atoms.withColumn("cell", F.lit(None).cast("long")), cutoff, on, ["cell", atom])
    least = hits.groupBy(*on, F.col(f"{atom}_b").alias(atom)).agg(F.min("cell_a").alias("cell"))
    return atoms.select(*on, atom).join(least, [*on, atom], "left").withColumn("cell", F.coalesce("cell", F.lit(-1)))


def cell_features(cells: DataFrame, atoms: DataFrame, on: list[str], properties: list[str], d0: float = 8.0, least: float = 0.2) -> DataFrame:
    """For each cell the sum of weight * property over atoms whose weight is at least `least`."""
    blank = reduce(lambda df, p: df.withColumn(p, F.lit(None).cast("double")), properties, cells)
    rows = soft_pairs(blank, atoms.withColumn("cell", F.lit(None).cast("long")), d0, least, on, ["cell", *properties])
    return rows.groupBy(*on, F.col("cell_a").alias("cell")).agg(*[F.sum(F.col("w") * F.col(f"{p}_b")).alias(p) for p in properties])


def bounding_box(atoms: DataFrame, on: list[str], extension: float = 0.0) -> DataFrame:
    """Least and greatest coordinates, widened."""
    return atoms.groupBy(*on).agg(*[e for c in "xyz" for e in ((F.min(c) - extension).alias(f"lo_{c}"), (F.max(c) + extension).alias(f"hi_{c}"))])


def centre(atoms: DataFrame, on: list[str]) -> DataFrame:
    """Unweighted centre and the symmetric box size 2 * max(max - c, c - min) of each axis."""
    rows = atoms.groupBy(*on).agg(*[e for c in "xyz" for e in (F.avg(c).alias(f"c_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    return rows.select(*on, *[f"c_{c}" for c in "xyz"], *[(2.0 * F.greatest(F.col(f"hi_{c}") - F.col(f"c_{c}"), F.col(f"c_{c}") - F.col(f"lo_{c}"))).alias(f"size_{c}") for c in "xyz"])
