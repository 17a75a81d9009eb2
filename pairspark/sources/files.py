"""Readers. Rows keep their place in the input as ``ord``: file, block start, row in block."""

from __future__ import annotations

import csv
import io
import itertools
import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import nan_to_null


def _file_order() -> Column:
    """Comparable place of a row: ids grow inside a block, blocks grow inside a file."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``protein_id, sequence``. The id is the first token of the header; on a repeated id the last record wins.

    Records are cut at the header mark by the line reader, so files stay splittable. Text
    before the first header is dropped, blank lines and line ends are removed, and a header
    without an id raises.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select("value", _file_order().alias("ord"))
    headed = F.col("value").startswith(">")
    # A file's first record keeps its mark. One without it is text before any header.
    stray = (
        records.where((F.col("ord.block") == 0) & ~headed)
        .groupBy(F.col("ord.file").alias("__file")).agg(F.min("ord.row").alias("__first"))
    )
    led = records.where((F.col("ord.block") == 0) & headed).groupBy(F.col("ord.file").alias("__file")).agg(
        F.min("ord.row").alias("__led"))
    # Only files that open with stray text are left, by comparing their first records.
    stray = stray.join(led, "__file", "left").where("__led IS NULL OR __first < __led").select("__file", "__first")
    kept = records.join(stray, (F.col("ord.file") == F.col("__file")) & (F.col("ord.row") == F.col("__first")), "left_anti")
    body = F.regexp_replace("value", "^>", "")
    header = F.regexp_replace(F.substring_index(body, "\n", 1), "\r", "")
    first = F.split(F.ltrim(F.regexp_replace(header, r"\s", " ")), " ")[0]
    name = F.when(first == "", F.raise_error(F.lit("FASTA header without an id")).cast("string")).otherwise(first)
    lines = F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise(F.lit(""))
    # Line ends and the blanks around them go; blanks inside a line stay.
    sequence = F.regexp_replace(F.trim(F.regexp_replace(lines, r"\s*[\r\n]+\s*", "")), r"^\s+|\s+$", "")
    parsed = kept.where(F.trim(F.regexp_replace(body, r"\s", " ")) != "").select(
        name.alias("protein_id"), sequence.alias("sequence"), "ord")
    return parsed.groupBy("protein_id").agg(F.max_by("sequence", "ord").alias("sequence"))


def _distinct_ligands(rows: DataFrame) -> DataFrame:
    return rows.where("smiles IS NOT NULL AND smiles <> ''").groupBy("smiles").agg(F.min("ord").alias("ord"))


def ligand_column(columns: list[str]) -> str:
    """First column with a known ligand header, in any case; else the first column."""
    for name in columns:
        if name.strip().lower() in fv.LIGAND_HEADERS:
            return name
    return columns[0]


def read_smiles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ligand strings ``smiles, ord`` of a CSV with a header."""
    table = spark.read.option("header", True).csv(path)
    if not table.columns:
        raise ValueError(f"empty CSV file: {path}")
    column = ligand_column(table.columns)
    return _distinct_ligands(table.select(F.trim(F.col(f"`{column}`")).alias("smiles"), _file_order().alias("ord")))


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first tokens of the lines; ``#`` comments and blank lines are skipped."""
    line = F.trim(F.regexp_replace("value", r"\s", " "))
    rows = spark.read.text(path).select(line.alias("line"), _file_order().alias("ord"))
    rows = rows.where("line <> '' AND NOT startswith(line, '#')")
    return _distinct_ligands(rows.select(F.split("line", " ")[0].alias("smiles"), "ord"))


def read_smiles_auto(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix; an unknown suffix is tried as CSV, then as SMI."""
    lower = path.lower()
    if lower.endswith((".tar.gz", ".tgz")):
        return read_smiles_archives(spark, path)
    if lower.endswith(".csv"):
        return read_smiles_csv(spark, path)
    if lower.endswith((".smi", ".smiles")):
        return read_smi(spark, path)
    try:
        return read_smiles_csv(spark, path)
    except (ValueError, AnalysisException):
        return read_smi(spark, path)


def _choose_member(archive: tarfile.TarFile) -> tarfile.TarInfo | None:
    """First CSV, else first SMI, else first file; unsafe and resource-fork names are passed over."""
    usable = []
    for member in archive.getmembers():
        parts = member.name.split("/")
        if member.isfile() and not member.name.startswith("/") and ".." not in parts and not parts[-1].startswith("._"):
            usable.append(member)
    for suffix in (".csv", ".smi", ""):
        for member in usable:
            if member.name.endswith(suffix):
                return member
    return None


def _member_ligands(archive: tarfile.TarFile, member: tarfile.TarInfo) -> Iterator[str]:
    text = io.TextIOWrapper(archive.extractfile(member), encoding="utf-8", newline="")
    if member.name.endswith((".smi", ".smiles")):
        for line in text:
            tokens = line.split()
            if tokens and not tokens[0].startswith("#"):
                yield tokens[0]
        return
    rows = csv.reader(text)
    header = next(rows, None)
    if header is None:
        raise ValueError(f"empty CSV file: {member.name}")
    place = header.index(ligand_column(header))
    for row in rows:
        if place < len(row) and row[place].strip():
            yield row[place].strip()


def read_smiles_archives(spark: SparkSession, path: str) -> DataFrame:
    """Ligands of ``.tar.gz`` archives; many archives are read side by side."""
    return archive_ligands(spark.read.format("binaryFile").load(path).select("path", "content"))


def archive_ligands(archives: DataFrame) -> DataFrame:
    """Distinct ligands of archives given as ``path, content``, streamed in batches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                    member = _choose_member(archive)
                    if member is None:
                        raise ValueError(f"archive without a usable file: {name}")
                    numbered = enumerate(_member_ligands(archive, member))
                    while batch := [(name, row, smiles) for row, smiles in itertools.islice(numbered, 10_000)]:
                        yield pd.DataFrame(batch, columns=["file", "row", "smiles"])

    rows = archives.mapInPandas(run, "file string, row long, smiles string")
    return _distinct_ligands(rows.select("smiles", F.struct("file", F.lit(0).cast("long").alias("block"), "row").alias("ord")))


LABELS = {"regression_label": "double", "classification_label": "int", "multiclass_label": "int"}


def read_pairs(spark: SparkSession, folder: str, sampling_col: str | None = None) -> DataFrame:
    """Labelled pairs of ``train.csv``, ``test.csv`` and, when present, ``valid.csv``.

    Label columns are optional; missing ones are NULL, and NaN is read as NULL. Other columns are
    kept as text, but for ``sampling_col``, the weights of the training rows, which become
    doubles and must be there. A column named ``split`` gives way to the name of the file.
    """
    out = None
    for split in ("train", "test", "valid"):
        try:
            raw = spark.read.option("header", True).csv(os.path.join(folder, f"{split}.csv"))
        except AnalysisException:
            if split == "valid":
                continue
            raise
        if split == "train" and sampling_col is not None and sampling_col not in raw.columns:
            raise ValueError(f"no column {sampling_col} in the training pairs")
        columns = [F.col(c).alias(c) for c in ("ID", "Protein", "Ligand") if c in raw.columns]
        for name, kind in LABELS.items():
            value = nan_to_null(F.col(name).cast("double")).cast(kind) if name in raw.columns else F.lit(None).cast(kind)
            columns.append(value.alias(name))
        for name in raw.columns:
            if name not in ("ID", "Protein", "Ligand", *LABELS) and name.lower() != "split":
                value = F.col(f"`{name}`")
                columns.append((nan_to_null(value.cast("double")) if name == sampling_col else value).alias(name))
        part = raw.select(*columns, F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``id, value`` of JSON objects mapping ids to numbers."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("id", "value"))
