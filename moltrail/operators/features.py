"""Binding features of receptor-ligand complexes.

Atoms: complex_id, role (R or L), residue key columns, atom_name, atom_type, charge, x, y, z. Residue
sums of all kinds come from one pass over the near pairs: one join, one grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.parameters import TYPE_ALIAS
from .contacts import near_pairs

BACKBONE = ("C", "N", "O", "CA")
COUNT_CUTOFF, COUNT_D0, TYPE_CUTOFF, ENERGY_CUTOFF = 12.0, 7.0, 7.0, 12.0


def split_roles(atoms: DataFrame, ligand: str) -> DataFrame:
    """role L for the ligand's residue name, else R."""
    return atoms.withColumn("role", F.when(F.col("res_name") == ligand, "L").otherwise("R"))


def with_parameters(atoms: DataFrame, parameters: DataFrame, alias: dict[str, str] = TYPE_ALIAS, default: str = "DU") -> DataFrame:
    """sigma_nm and eps by atom type, types renamed by alias, unknown ones take the default's. The parameters
    are a small table that Spark may broadcast by its size."""
    kind = F.col("atom_type")
    for old, new in alias.items():
        kind = F.when(F.col("atom_type") == old, new).otherwise(kind)
    p = parameters.select(F.col("atom_type").alias("p_type"), "sigma_nm", "eps")
    d = parameters.where(F.col("atom_type") == default).select(F.col("sigma_nm").alias("d_sigma"), F.col("eps").alias("d_eps"), F.lit(1).alias("one"))
    rows = atoms.withColumn("p_type_wanted", kind).join(p, F.col("p_type_wanted") == F.col("p_type"), "left")
    rows = rows.withColumn("one", F.lit(1)).join(d, "one", "left")
    return rows.withColumns({"sigma_nm": F.coalesce("sigma_nm", "d_sigma"), "eps": F.coalesce("eps", "d_eps")}).drop("p_type", "p_type_wanted", "d_sigma", "d_eps", "one")


def residue_features(atoms: DataFrame, residue: list[str], cutoff: float = COUNT_CUTOFF, dielectric: float = 4.0, cap: float = 10.0) -> DataFrame:
    """A5-A7 in one grouping: counts, Lennard-Jones energy (capped) and Coulomb energy of each residue with the ligand,
    backbone (_bb) and side chain (_sc); residues without a pair give 0."""
    keep = [*residue, "atom_name", "sigma_nm", "eps", "charge"]
    receptor, ligand = atoms.where("role = 'R'"), atoms.where("role = 'L'")
    pairs = near_pairs(receptor, ligand, cutoff, ["complex_id"], keep)
    back = F.col("atom_name_a").isin(*BACKBONE)
    nm = F.col("d") * 0.1
    e = G.lennard_jones(F.col("sigma_nm_a"), F.col("eps_a"), F.col("sigma_nm_b"), F.col("eps_b"), nm)
    q = G.coulomb(F.col("charge_a"), F.col("charge_b"), F.col("d"), dielectric)
    sums = [F.sum(F.when(part, v)).alias(f"{name}_{side}") for name, v in (("count", G.switch(F.col("d"), COUNT_D0)), ("vdw", e), ("coulomb", q)) for side, part in (("bb", back), ("sc", ~back))]
    got = pairs.groupBy("complex_id", *[F.col(f"{c}_a").alias(c) for c in residue]).agg(*sums)
    rows = receptor.select("complex_id", *residue).distinct().join(got, ["complex_id", *residue], "left")
    names = [f"{n}_{s}" for n in ("count", "vdw", "coulomb") for s in ("bb", "sc")]
    rows = rows.na.fill(0.0, names)
    return rows.withColumns({f"vdw_{s}": F.least(F.col(f"vdw_{s}"), F.lit(cap)) for s in ("bb", "sc")})


def type_contacts(atoms: DataFrame, types: list[str], cutoff: float = TYPE_CUTOFF) -> DataFrame:
    """Contacts by pair of atom types within the cutoff, a column for each pair, zero-filled."""
    pairs = near_pairs(atoms.where("role = 'R'"), atoms.where("role = 'L'"), cutoff, ["complex_id"], ["atom_type"])
    names = [f"{a}_{b}" for a in types for b in types]
    rows = pairs.withColumn("t", F.concat_ws("_", "atom_type_a", "atom_type_b")).groupBy("complex_id").pivot("t", names).agg(F.count(F.lit(1)))
    return atoms.select("complex_id").distinct().join(rows, "complex_id", "left").na.fill(0, names)


def feature_table(residues: DataFrame, residue: list[str], contacts: DataFrame | None = None) -> DataFrame:
    """A9 in long form: complex_id, feature, value, with the names countback_..., countside_..., vdwback_..., and so on, and, from
    the contacts of type_contacts(), atomTCount_..._..."""
    key = F.concat_ws("_", *residue)
    names = {"count": "count", "vdw": "vdw", "coulomb": "columb"}
    entries = [F.struct(F.concat(F.lit(f"{short}{part}_"), key).alias("feature"), F.col(f"{name}_{side}").alias("value")) for name, short in names.items() for side, part in (("bb", "back"), ("sc", "side"))]
    rows = residues.select("complex_id", F.explode(F.array(*entries)).alias("e")).select("complex_id", "e.*")
    if contacts is None:
        return rows
    counts = [F.struct(F.lit(f"atomTCount_{c}").alias("feature"), F.col(c).cast("double").alias("value")) for c in contacts.columns if c != "complex_id"]
    return rows.unionByName(contacts.select("complex_id", F.explode(F.array(*counts)).alias("e")).select("complex_id", "e.*"))


def wide(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Feature columns, zero-filled; names fixes them, else those of all complexes are taken."""
    rows = features.groupBy("complex_id").pivot("feature", names).agg(F.first("value"))
    return rows.na.fill(0.0)


def element_counts(atoms: DataFrame, elements: list[str], on: str = "complex_id") -> DataFrame:
    """A10: atoms by element, those not listed as DU."""
    kind = F.when(F.col("element").isin(*elements), F.col("element")).otherwise("DU")
    return atoms.withColumn("e", kind).groupBy(on).pivot("e", [*elements, "DU"]).agg(F.count(F.lit(1))).na.fill(0)


def net_charge(atoms: DataFrame, on: str = "complex_id") -> DataFrame:
    """The sum of charges, rounded."""
    return atoms.groupBy(on).agg(F.round(F.sum("charge")).cast("int").alias("net_charge"))


def molecular_weight(atoms: DataFrame, masses: DataFrame, on: list[str]) -> DataFrame:
    """Mass and number of heavy atoms of each molecule. masses: element, mass."""
    rows = atoms.join(masses, "element", "left")
    return rows.groupBy(*on).agg(F.sum("mass").alias("weight"), F.count_if(F.col("element") != "H").alias("heavy_atoms"))
