"""Small parameter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Three-letter and one-letter codes of amino acids, with the usual names of protonation states.
RESIDUES = {
    "GLY": "G", "ALA": "A", "SER": "S", "THR": "T", "CYS": "C", "VAL": "V", "LEU": "L", "ILE": "I", "MET": "M", "PRO": "P", "PHE": "F", "TYR": "Y",
    "ASP": "D", "TRP": "W", "GLU": "E", "ASN": "N", "GLN": "Q", "HIS": "H", "LYS": "K", "ARG": "R", "HIE": "H", "HIP": "H", "HID": "H", "CYX": "C",
}

#: Type, mass, sigma in nm, epsilon in kJ/mol of a general force field; DU is the default.
LENNARD_JONES = [
    ("H", 1.0, 0.106908, 0.0656888),
    ("Br", 79.90, 0.0, 0.0),
    ("C", 12.01, 0.339967, 0.359824),
    ("F", 19.00, 0.311815, 0.255224),
    ("I", 126.9, 0.418722, 1.67360),
    ("Cl", 35.45, 0.440104, 0.418400),
    ("IB", 131.0, 0.890899, 0.418400),
    ("N", 14.01, 0.325000, 0.711280),
    ("O", 16.00, 0.295992, 0.878640),
    ("P", 30.97, 0.374177, 0.836800),
    ("S", 32.06, 0.356359, 1.04600),
    ("DU", 12.01, 0.339967, 0.359824),
]
#: Spellings of types in structure files, and the type each stands for.
TYPE_ALIAS = {"N1+": "N", "L": "Cl", "CL": "Cl", "B": "Br", "BR": "Br", "R": "Br"}


#: Of the codes above, names of protonation states: no one-letter code stands for them.
PROTONATED = ("HIE", "HIP", "HID", "CYX")


def _lookup(column: str, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def one_letter(res_name: str) -> Column:
    """Null for an unknown residue."""
    return _lookup(res_name, RESIDUES)


def three_letters(code: str) -> Column:
    return _lookup(code, {one: three for three, one in RESIDUES.items() if three not in PROTONATED})


def residue_key(chain: str, res_name: str, res_seq: str, mark: str = "_") -> Column:
    """Chain, name and number as one key."""
    return F.concat_ws(mark, F.col(chain), F.col(res_name), F.col(res_seq).cast("string"))


def key_parts(key: str, mark: str = "_") -> list[Column]:
    """Chain, res_name and res_seq of a key."""
    part = lambda k: F.split_part(F.col(key), F.lit(mark), F.lit(k))
    return [part(1).alias("chain"), part(2).alias("res_name"), part(3).try_cast("int").alias("res_seq")]


def lennard_jones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LENNARD_JONES, "atom_type string, mass double, sigma_nm double, eps double")


def residue_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESIDUES.items()), "code3 string, code1 string")
