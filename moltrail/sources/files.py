"""Readers of the text formats of simulation and docking, many files to one table.

Every reader takes a path, or a table of lines (file, line_no, text) from elsewhere. Files are read in splits, line by
line, whatever their size. Where lines stand for themselves, line_no only orders them. Where a line's meaning hangs on
those before it (the section it stands in, the number of atoms before), a split's lines are gone through in order, and what one split
hands on to the next, a row each, is summed up over the file: carried() and counted(). Only a record of MOL2 molecules is one value
of Spark's text source. Fields are cut by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .numbers import from_hybrid

FILE = "_metadata.file_path"


def _split(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


#: Lines of a table of lines that count as one split.
TABLE_SPLIT = 1 << 20


def _place() -> Column:
    """Grows along a file: the MB where the line's split starts, then the row."""
    return F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 20), 33).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, split, line_no, text: lines that hang on each other; split orders the splits of a file, and line_no its lines, as in
    loose_lines(). Carriage returns go. Of a table its line_no are taken, and ranges of them are its splits."""
    if isinstance(path, DataFrame):
        return path.select("file", F.floor(F.col("line_no") / TABLE_SPLIT).alias("split"), "line_no", "text")
    return spark.read.text(path).select(F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("split"), _place().alias("line_no"), F.regexp_replace("value", "\r", "").alias("text"))


def carried(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """For each name the last value that isn't null among a line and those before it in its file. The last of each split, found without
    moving lines, go to the splits behind, a row for each split; the lines themselves are shuffled once, by split."""
    own = W.partitionBy("file", "split").orderBy("line_no")
    ends = rows.groupBy("file", "split").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col("line_no"))).alias(f"_e_{n}") for n, c in values.items()])
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("file", "split", *[F.last(f"_e_{n}", True).over(earlier).alias(f"_e_{n}") for n in values])
    here = rows.withColumns({n: F.last(c, True).over(own) for n, c in values.items()})
    return here.join(ends, ["file", "split"], "left").withColumns({n: F.coalesce(n, f"_e_{n}") for n in values}).drop(*[f"_e_{n}" for n in values])


def counted(rows: DataFrame, name: str, amount: Column, keys: list[str] = ()) -> DataFrame:
    """A column: the sum of amount over the lines before this one, of its file and keys. Splits' sums go, a row for each split and
    key, to the splits behind."""
    rows = rows.withColumn("_a", amount.cast("long"))
    keys = ["file", *keys]
    own = W.partitionBy(*keys, "split").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "split").agg(F.sum("_a").alias("_t"))
    sums = sums.select(*keys, "split", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_b"))
    here = rows.withColumn(name, F.coalesce(F.sum("_a").over(own), F.lit(0)))
    return here.join(sums, [*keys, "split"]).withColumn(name, F.col(name) + F.col("_b")).drop("_a", "_b")


def loose_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, line_no, text line by line; line_no grows along a file: the MB where the split starts, then the row."""
    if isinstance(path, DataFrame):
        return path
    return spark.read.text(path).select(F.col(FILE).alias("file"), _place().alias("line_no"), F.regexp_replace("value", "\r", "").alias("text"))


def records(spark: SparkSession, path: str | DataFrame, separator: str, wanted: Column) -> DataFrame:
    """file, rec_no (0, 1, ... in the file), value of a file's wanted records; a table has file, place and value. Places
    alone are numbered, so that no task holds a file's texts."""
    if isinstance(path, DataFrame):
        rows = path.where(wanted)
    else:
        rows = spark.read.text(path, lineSep=separator).select(F.col(FILE).alias("file"), _place().alias("place"), "value").where(wanted)
    numbers = rows.select("file", "place").withColumn("rec_no", F.row_number().over(W.partitionBy("file").orderBy("place")) - 1)
    return rows.join(numbers, ["file", "place"]).select("file", "rec_no", "value")


def fields(text: Column | str) -> Column:
    """Blank-separated fields, without empty ones."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _cut(first: int, last: int) -> Column:
    return F.trim(F.substring("text", first, last - first + 1))


ATOM_FIELDS = {"record": (1, 6), "serial": (7, 11), "atom_name": (13, 16), "res_name": (18, 20), "chain": (22, 22), "res_seq": (23, 26), "x": (31, 38), "y": (39, 46), "z": (47, 54), "element": (77, 78)}


def _atoms(rows: DataFrame, keys: list[str], charges: bool) -> DataFrame:
    """Fixed columns, as fields may be fused; serials and residues may be hybrid-36. PDBQT files have charge and type as their last two
    fields."""
    rows = counted(rows.where(F.col("text").rlike("^(ATOM|HETATM)")), "atom_idx", F.lit(1), keys)
    got = [_cut(*at).alias(name) for name, at in ATOM_FIELDS.items()]
    if charges:
        f = fields("text")
        got += [F.element_at(f, -2).try_cast("double").alias("charge"), F.element_at(f, -1).alias("atom_type")]
    rows = rows.select("file", *keys, "line_no", *got, "atom_idx")
    rows = rows.withColumns({"serial": from_hybrid(F.col("serial"), 5), "res_seq": from_hybrid(F.col("res_seq"), 4), **{c: F.col(c).try_cast("double") for c in "xyz"}})
    guess = F.regexp_extract("atom_name", "[A-Za-z]", 0)
    rows = rows.withColumn("element", F.when(F.col("element") == "", guess).otherwise(F.col("element")))
    return rows.select(F.col("file").alias("struct_id"), *keys, "line_no", *[c for c in rows.columns if c not in ("file", *keys, "line_no")])


def read_pdb(spark: SparkSession, path: str | DataFrame, charges: bool = False) -> DataFrame:
    """Atoms of PDB or PDBQT files; struct_id is the file."""
    return _atoms(lines(spark, path), [], charges)


def read_models(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Frames of multi-model PDB files: the number on the MODEL line, else the place among the file's models that have atoms."""
    rows = counted(lines(spark, path), "_model", F.col("text").startswith("ENDMDL"))
    number = F.regexp_extract("text", r"^MODEL\s+(\d+)", 1).try_cast("int")
    rows = carried(rows, {"_named": F.when(number.isNotNull(), F.struct("_model", number.alias("frame")))}).where(F.col("text").rlike("^(ATOM|HETATM)"))
    own = F.when(F.col("_named._model") == F.col("_model"), F.col("_named.frame"))
    places = rows.select("file", "_model").distinct().withColumn("_place", F.row_number().over(W.partitionBy("file").orderBy("_model")))
    rows = rows.withColumn("frame", own).join(places, ["file", "_model"]).withColumn("frame", F.coalesce("frame", "_place"))
    return _atoms(rows, ["frame"], False)


def read_trajectory(spark: SparkSession, path: str, step: int = 1, begin: int | None = None, end: int | None = None, frame: str = "frame") -> DataFrame:
    """S3: the coords table, strided; frame bounds reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col(frame) >= begin) if begin is not None else rows
    rows = rows.where(F.col(frame) <= end) if end is not None else rows
    return rows.where(F.col(frame) % step == 0) if step > 1 else rows


def read_mol2(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """File, mol_no, name, section, line_no (within the section), text of multi-molecule files."""
    rows = records(spark, path, "@<TRIPOS>MOLECULE", F.col("value").rlike(r"\S") & F.col("value").contains("@<TRIPOS>")).withColumnRenamed("rec_no", "mol_no")
    rows = _split(rows.withColumn("value", F.concat(F.lit("@<TRIPOS>MOLECULE"), "value")), ["file", "mol_no"]).withColumnRenamed("line_no", "at")
    w = W.partitionBy("file", "mol_no").orderBy("at")
    head = F.when(F.col("text").startswith("@<TRIPOS>"), F.col("at"))
    rows = rows.withColumns({"section": F.last(F.when(head.isNotNull(), F.substring_index("text", ">", -1)), True).over(w), "line_no": F.col("at") - F.last(head, True).over(w)})
    rows = rows.withColumn("name", F.first(F.when((F.col("section") == "MOLECULE") & (F.col("line_no") == 1), F.trim("text")), True).over(W.partitionBy("file", "mol_no")))
    return rows.where("line_no > 0").select("file", "mol_no", "name", "section", "line_no", "text")


def mol2_property(mol2: DataFrame, section: str, line_no: int) -> DataFrame:
    """The value at a line of a section for each molecule."""
    return mol2.where((F.col("section") == section) & (F.col("line_no") == line_no)).select("file", "mol_no", "name", F.trim("text").alias("value"))


def mol2_atoms(mol2: DataFrame) -> DataFrame:
    f = fields("text")
    names = {"serial": (0, "int"), "atom_name": (1, "string"), "x": (2, "double"), "y": (3, "double"), "z": (4, "double"), "atom_type": (5, "string"), "charge": (8, "double")}
    rows = mol2.where("section = 'ATOM'").withColumn("f", f).where(F.size("f") >= 6)
    rows = rows.select("file", "mol_no", "name", *[F.get("f", F.lit(k)).try_cast(t).alias(n) for n, (k, t) in names.items()])
    return rows.withColumn("element", F.substring_index("atom_type", ".", 1))


def _sections(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    name = F.nullif(F.regexp_extract("text", r"^\s*\[\s*(.*?)\s*\]", 1), F.lit(""))
    rows = carried(lines(spark, path), {"section": name}).where(name.isNull() & F.col("section").isNotNull())
    return rows.where(F.col("text").rlike(r"^\s*[^\s;]")).withColumn("text", F.trim(F.substring_index("text", ";", 1)))


def read_sections(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """File, section, line_no, text of files with [ section ] headers; comments and empty lines go."""
    return _sections(spark, path).select("file", "section", "line_no", "text")


def read_groups(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """File, group, pos, atom_no of index files; groups of one name are one group."""
    rows = _sections(spark, path).withColumn("f", fields("text"))
    rows = counted(rows, "before", F.size("f"), ["section"])
    rows = rows.select("file", F.col("section").alias("group"), "before", F.posexplode("f").alias("k", "v"))
    return rows.select("file", "group", (F.col("before") + F.col("k")).cast("int").alias("pos"), F.col("v").try_cast("int").alias("atom_no"))


def read_charges(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """res_name, atom_name, charge of [ atoms ]; the first of equal keys counts."""
    f = fields("text")
    rows = _sections(spark, path).where("section = 'atoms'").select("file", "split", "line_no", F.get(f, F.lit(3)).alias("res_name"), F.get(f, F.lit(4)).alias("atom_name"), F.get(f, F.lit(6)).try_cast("double").alias("charge"))
    return rows.groupBy("file", "res_name", "atom_name").agg(F.min_by("charge", F.struct("split", "line_no")).alias("charge"))


def read_series(spark: SparkSession, path: str | DataFrame, columns: list[int], names: list[str]) -> DataFrame:
    """Chosen columns (from 0) of blank- or comma-separated files, without # and @ lines; line_no orders the rows."""
    rows = loose_lines(spark, path).where(F.col("text").rlike(r"^\s*[^#@\s]"))
    f = F.filter(F.split(F.trim("text"), r"[\s,]+"), lambda x: x != "")
    return rows.select("file", "line_no", *[F.get(f, F.lit(k)).try_cast("double").alias(n) for k, n in zip(columns, names)]).where(F.col(names[0]).isNotNull())


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table with a header; numbers are typed."""
    return spark.read.csv(path, header=True, sep=separator, inferSchema=True)


def read_xyz_matrix(spark: SparkSession, path: str | DataFrame, shift: tuple[float, float] = (0, 0)) -> DataFrame:
    """Row, col, value; labels are cut at an underscore and shifted once."""
    f = fields("text")
    rows = loose_lines(spark, path).where(F.col("text").rlike(r"^\s*[^#\s]")).select(*[F.get(f, F.lit(k)).alias(n) for k, n in enumerate(("row", "col", "value"))])
    label = lambda c, s: F.split_part(F.col(c), F.lit("_"), F.lit(1)).try_cast("double") + s
    return rows.select(label("row", shift[0]).alias("row"), label("col", shift[1]).alias("col"), number(F.col("value")).alias("value"))


def read_domains(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Name, part, lo, hi; lines have a name and pairs of numbers."""
    f = fields("text")
    rows = loose_lines(spark, path).where(~F.col("text").startswith("#")).withColumn("f", f).where(F.size("f") >= 3)
    rows = rows.select(F.col("f")[0].alias("name"), "f", F.explode(F.expr("sequence(0, (size(f) - 1) div 2 - 1)")).alias("part"))
    at = lambda k: F.get("f", F.col("part") * 2 + k).try_cast("int")
    return rows.select("name", "part", at(1).alias("lo"), at(2).alias("hi"))


def read_communities(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (file, comm_id, residue) and files (file, communities, modularity)."""
    rows = loose_lines(spark, path)
    said = rows.where(F.col("text").rlike("residues in community"))
    members = said.select("file", F.regexp_extract("text", r"community\s+(\d+)", 1).cast("int").alias("comm_id"), F.explode(fields(F.substring_index("text", ":", -1))).alias("r")).select("file", "comm_id", F.col("r").try_cast("int").alias("residue"))
    best = rows.where(F.col("text").rlike("optimum number of communities"))
    return members, best.select("file", F.regexp_extract("text", r"communities is\s+(\d+)", 1).cast("int").alias("communities"), F.regexp_extract("text", r"modularity value is\s+([-\d.]+)", 1).cast("double").alias("modularity"))


def read_rankings(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """list_id (file), line_no, ligand_id (the last field), score (the first), pose_path (the one before the last)."""
    f = fields("text")
    rows = loose_lines(spark, path).where(F.col("text").rlike(r"^\s*[^#\s]")).withColumn("fields", f)
    return rows.select(F.col("file").alias("list_id"), "line_no", F.element_at("fields", -1).alias("ligand_id"), F.col("fields")[0].try_cast("double").alias("score"), F.try_element_at("fields", F.lit(-2)).alias("pose_path"), "fields")


def read_docking_logs(spark: SparkSession, path: str | DataFrame, modes: int = 3) -> DataFrame:
    """File and the scores of its first modes, in order; only rows after the affinity header count."""
    heads = F.col("text").contains("affinity")
    rows = counted(lines(spark, path), "after", heads).withColumn("after", (F.col("after") > 0).cast("int"))
    f = fields("text")
    rows = rows.where("after = 1").select("file", F.get(f, F.lit(0)).try_cast("int").alias("mode"), F.get(f, F.lit(1)).try_cast("double").alias("score")).where(F.col("mode").between(1, modes) & F.col("score").isNotNull())
    return rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "score"))), lambda s: s["score"]).alias("scores"))


#: Terms of an energy summary and what their lines begin with.
SUMMARY_TERMS = {"vdw": "van der Waa", "ele": "Electrostat", "polar": "Polar solvation", "sasa": "SASA", "total": "Binding"}


def read_energy_summary(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """File and, for each term, its value and deviation from lines "<term> energy = value +/- deviation"."""
    rows = loose_lines(spark, path).where(F.col("text").contains("+/-"))
    term = F.coalesce(*[F.when(F.trim("text").startswith(t), F.lit(k)) for k, t in SUMMARY_TERMS.items()])
    value = lambda k: F.regexp_extract("text", r"=\s*([-+\d.eE]+)\s*\+/-\s*([-+\d.eE]+)", k).try_cast("double")
    rows = rows.select("file", term.alias("term"), value(1).alias("value"), value(2).alias("std")).where("term IS NOT NULL")
    return rows.groupBy("file").pivot("term", list(SUMMARY_TERMS)).agg(F.first("value").alias("value"), F.first("std").alias("std"))


def read_secondary_structure(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """File, res_idx, frame, code of .xpm grids: quoted lines of at most two fields without comments."""
    rows = lines(spark, path).where(~F.col("text").contains("/*") & F.col("text").startswith('"') & (F.size(fields("text")) <= 2))
    rows = counted(rows, "res_idx", F.lit(1)).withColumn("res_idx", F.col("res_idx").cast("int"))
    codes = F.regexp_extract("text", '"([^"]*)"', 1)
    return rows.select("file", "res_idx", F.posexplode(F.split(codes, "")).alias("frame", "code")).where("code <> ''")


def secondary_structure_part(grid: DataFrame, residues: tuple[int, int], begin: int = 0, end: int = -1, step: int = 1) -> DataFrame:
    """residues and frames from begin, to end (-1: the last), every step-th."""
    rows = grid.where(F.col("res_idx").between(*residues) & (F.col("frame") >= begin) & ((F.col("frame") - begin) % step == 0))
    return rows.where(F.col("frame") <= end) if end >= 0 else rows


def read_structure_list(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Code, resolution, ligand, k_type (two characters), k_value."""
    f = fields("text")
    rows = loose_lines(spark, path).where(F.col("text").rlike(r"^\s*[^#\s]")).withColumn("f", f).where(F.size("f") >= 4)
    k = F.element_at("f", 4)
    return rows.select(F.col("f")[0].alias("code"), F.col("f")[1].try_cast("double").alias("resolution"), F.col("f")[2].alias("ligand"), F.substring(k, 1, 2).alias("k_type"), F.regexp_replace(k, "^..[=<>~]*", "").alias("k_value"))


def read_fasta(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """File, record, name, sequence."""
    head = F.col("text").startswith(">")
    rows = counted(lines(spark, path), "record", head).withColumn("record", F.col("record") + head.cast("int"))
    name = F.max(F.when(head, F.expr("substr(text, 2)")))
    parts = F.collect_list(F.when(~head, F.struct("split", "line_no", F.regexp_replace("text", r"\s", "").alias("s"))))
    return rows.groupBy("file", "record").agg(name.alias("name"), F.array_join(F.transform(F.array_sort(parts), lambda p: p["s"]), "").alias("sequence"))


def read_atom_types(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """atom_type, z_number, mass, charge, sigma_nm, eps."""
    f = fields("text")
    names = {"atom_type": (0, "string"), "z_number": (1, "int"), "mass": (2, "double"), "charge": (3, "double"), "sigma_nm": (5, "double"), "eps": (6, "double")}
    return loose_lines(spark, path).where(F.col("text").rlike(r"^\s*[^;\s]")).select(*[F.get(f, F.lit(k)).try_cast(t).alias(n) for n, (k, t) in names.items()])


def read_elements(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """z_number, element, name, electronegativity."""
    f = fields("text")
    names = {"z_number": (0, "int"), "element": (1, "string"), "name": (2, "string"), "electronegativity": (3, "double")}
    return loose_lines(spark, path).where(F.col("text").rlike(r"^\s*[^#\s]")).select(*[F.get(f, F.lit(k)).try_cast(t).alias(n) for n, (k, t) in names.items()])


def read_residue_codes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """code3, code1."""
    f = fields("text")
    return loose_lines(spark, path).where(F.col("text").startswith("RES")).select(F.get(f, F.lit(2)).alias("code3"), F.get(f, F.lit(3)).alias("code1"))


def read_atom_parts(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """atom_name, subgroup of nucleic acids."""
    f = fields("text")
    return loose_lines(spark, path).where(F.col("text").startswith("ATOM")).select(F.get(f, F.lit(2)).alias("atom_name"), F.get(f, F.lit(1)).alias("subgroup"))


def read_box(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """File and the box's edges."""
    f = fields("text")
    return loose_lines(spark, path).where(F.col("text").startswith("CRYST1")).select("file", *[F.get(f, F.lit(k)).try_cast("double").alias(n) for k, n in ((1, "lx"), (2, "ly"), (3, "lz"))])


def read_frame_matrices(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Frame (the last number of the file's name), row, col, value of dense matrix files, in long form."""
    rows = lines(spark, path).where(F.col("text").rlike(r"^\s*[^#\s]"))
    frame = F.regexp_extract(F.substring_index("file", "/", -1), r"(\d+)(?!.*\d)", 1).try_cast("int")
    rows = counted(rows, "row", F.lit(1)).withColumn("row", F.col("row").cast("int"))
    return rows.select(frame.alias("frame"), "row", F.posexplode(fields("text")).alias("col", "v")).select("frame", "row", "col", F.col("v").try_cast("double").alias("value"))


def read_properties(spark: SparkSession, path: str | DataFrame, ids: DataFrame, key: str, column: str | int) -> DataFrame:
    """A column of a CSV, by name or place, for each id; the last match counts."""
    rows = lines(spark, path)
    at = F.struct("split", "line_no")
    rows = rows.withColumn("at", at)
    heads = rows.groupBy("file").agg(F.split(F.min_by("text", "at"), ",").alias("head"), F.min("at").alias("first"))
    cells = F.split("text", ",")
    cell = F.lit(column) if isinstance(column, int) else F.array_position(F.transform("head", lambda x: F.trim(x)), column).cast("int") - 1
    rows = rows.join(heads, "file").where("at > first AND text <> ''").select("at", F.trim(cells[0]).alias(key), F.trim(F.get(cells, cell)).alias("value"))
    return ids.select(key).join(rows.groupBy(key).agg(F.max_by("value", "at").alias("value")), key)
