"""Readers of structure files. A file is one small row; its lines become atom and bond rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed


def _texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("value"))


def _cut(line: str, start: int, length: int) -> Column:
    return F.trim(F.substring(line, start, length))


def _pdb_atoms(texts: DataFrame, keep: Column | None = None) -> DataFrame:
    """Atom rows of PDB text up to the end of the first model."""
    first = texts.select("path", F.substring_index(F.concat(F.lit("\n"), "value"), "\nENDMDL", 1).alias("value"))
    lines = first.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    if keep is not None:
        lines = lines.withColumn("line", keep)
    record = F.trim(F.substring("line", 1, 6))
    return lines.where(record.isin("ATOM", "HETATM")).select(
        "path", "line_no", record.alias("record"),
        _cut("line", 7, 5).cast("int").alias("serial"), _cut("line", 13, 4).alias("atom"),
        _cut("line", 18, 3).alias("resname"), _cut("line", 22, 1).alias("chain"),
        _cut("line", 23, 4).cast("int").alias("resseq"), _cut("line", 27, 1).alias("icode"),
        _cut("line", 31, 8).cast("double").alias("x"), _cut("line", 39, 8).cast("double").alias("y"),
        _cut("line", 47, 8).cast("double").alias("z"),
        F.expr("try_cast(trim(substring(line, 61, 6)) AS double)").alias("bfactor"),
        _cut("line", 77, 2).alias("element"),
    )


def read_pdb_atoms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Atoms of the first model of every PDB file."""
    return _pdb_atoms(_texts(spark, path))


LIGAND_SUFFIXES = ["mol2", "sdf", "pdbqt", "pdb"]


def read_ligand_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Atom table ``path, idx, symbol, x, y, z`` and bond table ``path, begin, end, kind``.

    The format follows the suffix; an unknown one raises. Of an SDF the first molecule
    counts; PDBQT lines are cut after column 66.
    """
    return parse_ligands(_texts(spark, path))


def parse_ligands(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atom and bond tables of whole files given as ``path, value``.

    The files are read once: their texts are stored, put together in few partitions, since every
    format and table takes a pass of its own.
    """
    texts = checkpointed(texts.sparkSession, texts.select("path", "value").hint("rebalance"))
    texts = texts.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    message = F.concat(F.lit("unknown structure suffix: "), "path")
    texts = texts.withColumn("suffix", F.when(F.col("suffix").isin(LIGAND_SUFFIXES), F.col("suffix")).otherwise(
        F.raise_error(message).cast("string")))
    sdf_atoms, sdf_bonds = _sdf(texts.where("suffix = 'sdf'"))
    mol2_atoms, mol2_bonds = _mol2(texts.where("suffix = 'mol2'"))
    pdbqt = _pdb_atoms(texts.where("suffix = 'pdbqt'"), F.substring("line", 1, 66))
    pdb_texts = texts.where("suffix = 'pdb'")
    atoms = sdf_atoms.unionByName(mol2_atoms).unionByName(_numbered(pdbqt)).unionByName(_numbered(_pdb_atoms(pdb_texts)))
    return atoms, sdf_bonds.unionByName(mol2_bonds).unionByName(_conect(pdb_texts))


def _numbered(atoms: DataFrame) -> DataFrame:
    # Cut lines have no element field; the letters of the atom name stand in.
    symbol = F.when(F.col("element") != "", F.col("element")).otherwise(F.regexp_extract("atom", "([A-Za-z]+)", 1))
    return atoms.select("path", F.col("serial").alias("idx"), symbol.alias("symbol"), "x", "y", "z")


def _conect(texts: DataFrame) -> DataFrame:
    lines = texts.select("path", F.explode(F.split("value", "\n")).alias("line")).where("startswith(line, 'CONECT')")
    tails = F.array(*[_cut("line", s, 5) for s in (12, 17, 22, 27)])
    pairs = lines.select("path", _cut("line", 7, 5).cast("int").alias("begin"), F.explode(tails).alias("end"))
    pairs = pairs.where("end <> ''").select("path", "begin", F.col("end").cast("int").alias("end"))
    return pairs.where("begin < end").distinct().withColumn("kind", F.lit("UNSPECIFIED"))


def _sdf(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = F.split(F.substring_index("value", "$$$$", 1), "\n")
    held = texts.select("path", lines.alias("lines"))
    held = held.withColumn("n_atoms", _cut_of(F.get("lines", F.lit(3)), 1, 3).cast("int"))
    held = held.withColumn("n_bonds", _cut_of(F.get("lines", F.lit(3)), 4, 3).cast("int"))
    numbered = held.select("path", "n_atoms", "n_bonds", F.posexplode("lines").alias("no", "line"))
    atoms = numbered.where("no >= 4 AND no < 4 + n_atoms").select(
        "path", (F.col("no") - 3).alias("idx"), _cut("line", 32, 3).alias("symbol"),
        _cut("line", 1, 10).cast("double").alias("x"), _cut("line", 11, 10).cast("double").alias("y"),
        _cut("line", 21, 10).cast("double").alias("z"))
    kind = _cut("line", 7, 3)
    bonds = numbered.where("no >= 4 + n_atoms AND no < 4 + n_atoms + n_bonds").select(
        "path", _cut("line", 1, 3).cast("int").alias("begin"), _cut("line", 4, 3).cast("int").alias("end"),
        _kind(kind).alias("kind"))
    return atoms, bonds


def _cut_of(line: Column, start: int, length: int) -> Column:
    return F.trim(F.substring(line, start, length))


def _kind(code: Column) -> Column:
    return (F.when(code == "1", "SINGLE").when(code == "2", "DOUBLE").when(code == "3", "TRIPLE")
            .when(code.isin("4", "ar"), "AROMATIC").when(code == "am", "SINGLE").otherwise("UNSPECIFIED"))


def _mol2(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Only the first molecule of a file counts.
    first = F.get(F.split("value", "@<TRIPOS>MOLECULE"), F.lit(1))
    held = texts.select("path", first.alias("value"))

    def section(name: str) -> DataFrame:
        after = F.get(F.split("value", f"@<TRIPOS>{name}\n"), F.lit(1))
        lines = F.split(F.substring_index(after, "@<TRIPOS>", 1), "\n")
        rows = held.where(F.col("value").contains(f"@<TRIPOS>{name}\n"))
        rows = rows.select("path", F.explode(lines).alias("line")).where("trim(line) <> ''")
        return rows.select("path", F.split(F.trim("line"), r"\s+").alias("t"))

    atom, bond = section("ATOM"), section("BOND")
    atoms = atom.select(
        "path", F.col("t")[0].cast("int").alias("idx"), F.substring_index(F.col("t")[5], ".", 1).alias("symbol"),
        F.col("t")[2].cast("double").alias("x"), F.col("t")[3].cast("double").alias("y"), F.col("t")[4].cast("double").alias("z"))
    bonds = bond.select("path", F.col("t")[1].cast("int").alias("begin"), F.col("t")[2].cast("int").alias("end"),
                        _kind(F.col("t")[3]).alias("kind"))
    return atoms, bonds
