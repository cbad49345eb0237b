"""Atoms, residues and chains: selection, numbering, superposition, fits.

Atoms: struct_id, atom_idx, serial, record, atom_name, res_name, chain, res_seq, element, x, y, z."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import linear as L
from ..functions.parameters import RESIDUES
from .ranges import dense_index

MAINCHAIN = ("N", "CA", "C", "O")
WATER = ("HOH", "WAT", "SOL", "TIP3")


def selection(kind: str | list[str]) -> Column:
    """all, CA, heavy, mainchain, sidechain, protein, water, or a list of atom names."""
    name, res = F.col("atom_name"), F.col("res_name")
    if not isinstance(kind, str):
        return name.isin(*kind)
    protein = res.isin(*RESIDUES)
    return {"all": F.lit(True), "CA": name == "CA", "heavy": F.col("element") != "H", "mainchain": protein & name.isin(*MAINCHAIN), "sidechain": protein & ~name.isin(*MAINCHAIN) & (F.col("element") != "H"), "protein": protein, "water": res.isin(*WATER)}[kind]


def select_atoms(atoms: DataFrame, chains: list[str] | None = None, first: int | None = None, last: int = -1, kind: str | list[str] = "all") -> DataFrame:
    """by chain, residue range (last -1: to the end) and kind."""
    if chains:
        atoms = atoms.where(F.col("chain").isin(*chains))
    if first is not None:
        atoms = atoms.where(F.col("res_seq") >= first)
    if last >= 0:
        atoms = atoms.where(F.col("res_seq") <= last)
    return atoms.where(selection(kind))


def by_serials(atoms: DataFrame, serials: DataFrame) -> DataFrame:
    """F5."""
    return atoms.join(serials.select("serial").distinct(), "serial", "left_semi")


def positions(atoms: DataFrame, on: list[str]) -> DataFrame:
    """pos, the 0-based place of each atom in its structure, beside the serial of the file."""
    if on:
        return atoms.withColumn("pos", F.row_number().over(W.partitionBy(*on).orderBy("atom_idx")).cast("long") - 1)
    return dense_index(atoms, "atom_idx").withColumnRenamed("_i", "pos")


def keep_chains_and_ligand(atoms: DataFrame, chains: list[str], ligand: str, ligand_chain: str) -> DataFrame:
    """F7."""
    own = F.col("chain").isin(*chains) & (F.col("record") == "ATOM")
    return atoms.where(own | ((F.col("res_name") == ligand) & (F.col("chain") == ligand_chain)))


def without_hetero(atoms: DataFrame, keep: list[str], chains: list[str] | None = None, water_only: bool = False) -> DataFrame:
    """F8: HETATM rows go unless their residue is kept; with water_only only water goes."""
    gone = (F.col("record") == "HETATM") & ~F.col("res_name").isin(*(keep or [""]))
    if water_only:
        gone = gone & F.col("res_name").isin(*WATER)
    rows = atoms.where(~gone)
    return rows.where(F.col("chain").isin(*chains)) if chains else rows


def without_lone_pairs(atoms: DataFrame) -> DataFrame:
    """F9."""
    return atoms.where(~F.col("atom_name").contains("XX"))


def without_residues(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    """residues: chain, res_seq."""
    return atoms.join(residues.select("chain", "res_seq").distinct(), ["chain", "res_seq"], "left_anti")


def spliced(base: DataFrame, model: DataFrame, chain: str, gone: tuple[int, int], taken: tuple[int, int]) -> DataFrame:
    """the base with a residue range of a chain replaced by residues of a model; `part` gives the order."""
    own = F.col("chain") == chain
    before = base.where(~own | (F.col("res_seq") < gone[0]))
    after = base.where(own & (F.col("res_seq") > gone[1]))
    new = model.where(F.col("res_seq").between(*taken))
    return before.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)), True).unionByName(after.withColumn("part", F.lit(2)), True)


def in_slab(atoms: DataFrame, lo: float, hi: float) -> DataFrame:
    """protein atoms with lo < z < hi."""
    return atoms.where(selection("protein") & (F.col("z") > lo) & (F.col("z") < hi))


def residues_in_box(atoms: DataFrame, box: tuple[float, float, float], ratio: float = 1.0) -> DataFrame:
    """residues of which at least a share of atoms lies in 0..L on each axis."""
    inside = F.col("x").between(0, box[0]) & F.col("y").between(0, box[1]) & F.col("z").between(0, box[2])
    return atoms.groupBy("chain", "res_seq").agg(F.avg(inside.cast("double")).alias("share")).where(F.col("share") >= ratio)


def lipids_in_box(atoms: DataFrame, box: tuple[float, float], head: str, lipids: list[str]) -> DataFrame:
    """lipid atoms of residues whose head atom lies in the box's x and y."""
    rows = atoms.where(F.col("res_name").isin(*lipids))
    out = rows.where((F.col("atom_name") == head) & ~(F.col("x").between(0, box[0]) & F.col("y").between(0, box[1])))
    return rows.join(out.select("chain", "res_seq").distinct(), ["chain", "res_seq"], "left_anti")


def frames(coords: DataFrame, wanted: list[int] | None = None, first: int | None = None) -> DataFrame:
    """F22."""
    if wanted is not None:
        coords = coords.where(F.col("frame").isin(*wanted))
    return coords.where(F.col("frame") < first) if first is not None else coords


def annotated(atoms: DataFrame, molecules: DataFrame, parts: DataFrame, elements: DataFrame) -> DataFrame:
    """Molecule type by residue name, subgroup by residue type and atom name, atomic number by element; else Unknown.
    All three are small tables."""
    rows = atoms.join(molecules.select("res_name", "mol_type"), "res_name", "left").join(parts.select("atom_name", "mol_type", "subgroup"), ["atom_name", "mol_type"], "left").join(elements.select("element", "z_number"), "element", "left")
    return rows.withColumns({"mol_type": F.coalesce("mol_type", F.lit("Unknown")), "subgroup": F.coalesce("subgroup", F.lit("Unknown")), "is_h": F.col("element") == "H"})


def in_template_order(atoms: DataFrame, template: DataFrame, on: str = "complex_id") -> DataFrame:
    """Atoms of each complex in the template's order of names (atom_name, position), renumbered; n_atoms and
    n_template tell whether all were found."""
    size = template.agg(F.count("*").alias("n_template"))
    rows = atoms.join(template, "atom_name")
    w = W.partitionBy(on)
    return rows.withColumns({"atom_no": F.row_number().over(w.orderBy("position", "atom_idx")), "n_atoms": F.count("*").over(w)}).crossJoin(F.broadcast(size))


def restraints(rows: DataFrame, atoms: DataFrame, ends: int, offset: int = 0) -> DataFrame:
    """Rows with name_k and res_k for k < ends get serial_k; incomplete ones go."""
    first = atoms.groupBy("atom_name", "res_seq").agg(F.min("serial").alias("serial"))
    for k in range(ends):
        key = first.select(F.col("atom_name").alias(f"name_{k}"), (F.col("res_seq") - offset).alias(f"res_{k}"), F.col("serial").alias(f"serial_{k}"))
        rows = rows.join(key, [f"name_{k}", f"res_{k}"])
    return rows


def displaced(atoms: DataFrame, vectors: DataFrame, factors: DataFrame) -> DataFrame:
    """Coordinates plus vector * factor for each step of factors(step, factor)."""
    rows = atoms.join(vectors.select("atom_idx", "vx", "vy", "vz"), "atom_idx").crossJoin(F.broadcast(factors))
    return rows.withColumns({c: F.col(c) + F.col(f"v{c}") * F.col("factor") for c in "xyz"})


def ensemble_factors(spark, delta: float, n: int) -> DataFrame:
    """Delta * cos(2 pi i / n - pi) for i < n."""
    return spark.range(n).select(F.col("id").alias("step"), (delta * F.cos(2 * math.pi * F.col("id") / n - math.pi)).alias("factor"))


def residue_numbers(atoms: DataFrame, on: list[str]) -> DataFrame:
    """res_idx, 0-based, residues by their first atom. Residues are numbered, not atoms; a single structure's, which
    may be large, in ranged partitions."""
    res = atoms.groupBy(*on, "chain", "res_seq").agg(F.min("atom_idx").alias("first"))
    if on:
        res = res.withColumn("res_idx", F.row_number().over(W.partitionBy(*on).orderBy("first")).cast("long") - 1)
    else:
        res = dense_index(res, "first").withColumnRenamed("_i", "res_idx")
    return atoms.join(res.drop("first"), [*on, "chain", "res_seq"])


def residue_list(atoms: DataFrame, on: list[str]) -> DataFrame:
    """Residues of each chain with the place where each is first seen."""
    return atoms.groupBy(*on, "chain", "res_seq", "res_name").agg(F.min("atom_idx").alias("first"))


def renumbered(atoms: DataFrame, on: str, order: str, res_seq: str = "res_seq", atom_start: int = 1, res_start: int = 1, chain: str | None = None) -> DataFrame:
    """Atoms from atom_start on; the residue number goes up where the source's changes."""
    w = W.partitionBy(on).orderBy(order)
    rows = atoms.withColumn("_c", F.coalesce((F.col(res_seq) != F.lag(res_seq).over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumns({"atom_no": F.row_number().over(w) + (atom_start - 1), "res_no": F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) + res_start}).drop("_c")
    return rows.withColumn("chain", F.lit(chain)) if chain else rows


def chain_sequences(residues: DataFrame, on: list[str]) -> DataFrame:
    """Residues (keys, res_seq, code1) as one string with - for missing numbers."""
    ends = residues.groupBy(*on).agg(F.min("res_seq").alias("lo"), F.max("res_seq").alias("hi"))
    every = ends.select(*on, F.explode(F.sequence("lo", "hi")).alias("res_seq"))
    rows = every.join(residues, [*on, "res_seq"], "left").withColumn("c", F.coalesce("code1", F.lit("-")))
    return rows.groupBy(*on).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res_seq", "c"))), lambda s: s["c"]), "").alias("sequence"))


def missing_ranges(residues: DataFrame, on: list[str], number: str = "res_seq") -> DataFrame:
    """Lo, hi of numbers that lack between two that are there."""
    seen = residues.select(*on, number).distinct()
    after = F.lead(number).over(W.partitionBy(*(on or [F.lit(0)])).orderBy(number))
    return seen.withColumn("_n", after).where(F.col("_n") - F.col(number) > 1).select(*on, (F.col(number) + 1).alias("lo"), (F.col("_n") - 1).alias("hi"))


def with_letters(ranges: DataFrame, fasta: str | Column, start: int = 1, extend: int = 0) -> DataFrame:
    """Letters of each range, widened by `extend` on both sides within the sequence."""
    fasta = F.lit(fasta) if isinstance(fasta, str) else fasta
    lo, hi = F.greatest(F.col("lo") - extend, F.lit(start)), F.least(F.col("hi") + extend, F.length(fasta) + start - 1)
    rows = ranges.withColumns({"lo": lo, "hi": hi})
    return rows.withColumn("letters", F.substr(fasta, (F.col("lo") - start + 1).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int")))


def backbone_dihedrals(atoms: DataFrame, on: list[str]) -> DataFrame:
    """phi = (C of the residue before, N, CA, C) and psi = (N, CA, C, N of the next) as serials; residues must follow
    each other in number, incomplete ones are left out."""
    res = atoms.where(F.col("atom_name").isin("N", "CA", "C")).groupBy(*on, "chain", "res_seq").agg(*[F.min(F.when(F.col("atom_name") == n, F.col("serial"))).alias(n) for n in ("N", "CA", "C")])
    w = W.partitionBy(*on, "chain").orderBy("res_seq")
    near = lambda f, c, step: F.when(f("res_seq").over(w) == F.col("res_seq") + step, f(c).over(w))
    rows = res.withColumns({"before": near(F.lag, "C", -1), "after": near(F.lead, "N", 1)})
    four = lambda kind, *c: F.struct(F.lit(kind).alias("kind"), *[F.col(x).alias(y) for x, y in zip(c, "abcd")])
    rows = rows.select(*on, "chain", "res_seq", F.explode(F.array(four("phi", "before", "N", "CA", "C"), four("psi", "N", "CA", "C", "after"))).alias("t"))
    return rows.select(*on, "chain", "res_seq", "t.*").where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")


def angles(coords: DataFrame, tuples: DataFrame, on: list[str], atom: str) -> DataFrame:
    """Angles of three or dihedrals of four atoms. tuples: tuple_id, a, b, c(, d). Each tuple's atoms are rows,
    joined to coordinates once and gathered by frame and tuple: one join whatever the number of atoms."""
    places = [c for c in "abcd" if c in tuples.columns]
    long = tuples.select("tuple_id", F.posexplode(F.array(*places)).alias("k", "_atom"))
    rows = coords.join(long, coords[atom] == long["_atom"])
    got = rows.groupBy(*on, "tuple_id").agg(*[F.max(F.when(F.col("k") == k, F.struct("x", "y", "z"))).alias(p) for k, p in enumerate(places)])
    got = got.where(" AND ".join(f"{p} IS NOT NULL" for p in places))
    v = [tuple(F.col(f"{p}.{c}") for c in "xyz") for p in places]
    return got.select(*on, "tuple_id", (G.angle(*v) if len(v) == 3 else G.dihedral(*v)).alias("angle"))


def plane_fit(points: DataFrame, on: list[str]) -> DataFrame:
    """A, b, c of z = ax + by + c by the normal equations, and the norm of the residuals, from grouped sums of
    coordinates less their means."""
    means = points.groupBy(*on).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count("*").alias("n"), *[F.covar_pop(p, q).alias(p + q) for p, q in ("xx", "xy", "yy", "xz", "yz", "zz")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    rows = means.withColumns({"a": a, "b": b}).withColumn("c", F.expr("mz - a * mx - b * my"))
    left = F.expr("zz + a * a * xx + b * b * yy - 2 * a * xz - 2 * b * yz + 2 * a * b * xy")
    return rows.select(*on, "a", "b", "c", F.sqrt(F.greatest(F.col("n") * left, F.lit(0.0))).alias("residual"))


def beyond_plane(points: DataFrame, planes: DataFrame, on: list[str], cutoff: float) -> DataFrame:
    """Points on the side of the plane that the cutoff's sign names, farther than it."""
    rows = points.join(planes, on) if on else points.crossJoin(F.broadcast(planes))
    rows = rows.withColumn("d", G.plane_distance(F.col("a"), F.col("b"), F.col("c"), G.vector()))
    return rows.where(F.col("d") > cutoff if cutoff > 0 else F.col("d") < cutoff)


def covariance(points: DataFrame, on: list[str]) -> DataFrame:
    """Centre and the 3 x 3 covariance of each group."""
    return points.groupBy(*on).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), *[F.covar_pop(p, q).alias(p + q) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")])


def axis_fit(points: DataFrame, on: list[str]) -> DataFrame:
    """Centre and direction of the line through each group, the direction's largest part positive."""
    rows = covariance(points, on)
    matrix = L.symmetric({c: F.col(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")}, "xyz")
    return rows.select(*on, "mx", "my", "mz", L.leading_vector(matrix, 3).alias("axis"))


def shifted_along_axis(atoms: DataFrame, chosen: DataFrame, on: list[str], length: float) -> DataFrame:
    """All atoms moved by `length` along the axis of the chosen ones."""
    fit = axis_fit(chosen, on).select(*on, "axis")
    rows = atoms.join(fit, on) if on else atoms.crossJoin(F.broadcast(fit))
    return rows.withColumns({c: F.col(c) + F.col("axis")[k] * length for k, c in enumerate("xyz")}).drop("axis")


def rotated_about_axis(atoms: DataFrame, chosen: DataFrame, on: list[str], theta: float, across: bool = False) -> DataFrame:
    """Centred on the chosen atoms and turned about their axis, or about one at right angles to it."""
    fit = axis_fit(chosen, on)
    rows = atoms.join(fit, on) if on else atoms.crossJoin(F.broadcast(fit))
    axis = tuple(F.col("axis")[k] for k in range(3))
    p = G.minus(G.vector(), tuple(F.col(f"m{c}") for c in "xyz"))
    new = G.rotate(p, G.perpendicular(axis) if across else axis, theta)
    return rows.select(*[c for c in atoms.columns if c not in "xyz"], *[v.alias(c) for v, c in zip(new, "xyz")])


def moved(atoms: DataFrame, where: Column, shift: tuple[float, float, float] = (0, 0, 0), scale: tuple[float, float, float] = (1, 1, 1), only: bool = False) -> DataFrame:
    """Coordinates of some atoms times scale plus shift; with `only` the others are left out."""
    rows = atoms.where(where) if only else atoms
    return rows.withColumns({c: F.when(where, F.col(c) * scale[k] + shift[k]).otherwise(F.col(c)) for k, c in enumerate("xyz")})


def wrapped(atoms: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """M11."""
    return atoms.withColumns({c: G.wrap(F.col(c), *box[c]) for c in box})


def superposed(coords: DataFrame, reference: DataFrame, on: list[str], atom: str) -> DataFrame:
    """Each frame moved onto the reference (atom, x, y, z): sums give the centres and the cross-covariance, whose
    quaternion is the proper rotation that fits best."""
    ref = reference.select(F.col(atom), *[F.col(c).alias(f"r{c}") for c in "xyz"])
    rows = coords.join(ref, atom)
    fit = rows.groupBy(*on).agg(*[F.avg(c).alias(f"m_{c}") for c in ("x", "y", "z", "rx", "ry", "rz")], *[F.covar_pop(p, f"r{q}").alias(f"h_{p}{q}") for p in "xyz" for q in "xyz"])
    matrix = L.quaternion_matrix({p + q: F.col(f"h_{p}{q}") for p in "xyz" for q in "xyz"})
    fit = fit.select(*on, *[f"m_{c}" for c in ("x", "y", "z", "rx", "ry", "rz")], L.leading_vector(matrix, 4).alias("q"))
    rows = coords.join(fit, on)
    p = [F.col(c) - F.col(f"m_{c}") for c in "xyz"]
    new = [sum((r[j] * p[j] for j in (1, 2)), r[0] * p[0]) + F.col(f"m_r{c}") for r, c in zip(L.quaternion_rotation(F.col("q")), "xyz")]
    return rows.select(*[c for c in coords.columns if c not in "xyz"], *[v.alias(c) for v, c in zip(new, "xyz")])


def domain_centres(atoms: DataFrame, domains: DataFrame) -> DataFrame:
    """A14."""
    from .network import in_domains

    return in_domains(atoms, "res_seq", domains).groupBy("name").agg(*[F.avg(c).alias(c) for c in "xyz"])


def domain_vectors(vectors: DataFrame, domains: DataFrame, scale: float = 1.0, mode: str = "sum") -> DataFrame:
    """Vectors of residues (0-based) summed, or averaged, over domains lo <= r + least residue < hi."""
    least = domains.agg(F.min("lo").alias("least"))
    half = domains.crossJoin(F.broadcast(least)).where("hi > lo").select("name", F.explode(F.sequence(F.col("lo") - F.col("least"), F.col("hi") - F.col("least") - 1)).alias("res_idx")).distinct()
    how = F.sum if mode == "sum" else F.avg
    return vectors.join(half, "res_idx").groupBy("name").agg(*[(how(f"v{c}") * scale).alias(f"v{c}") for c in "xyz"])
