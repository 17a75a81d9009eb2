"""Structure-file jobs: sequences, score annotation, coordinate joins, fingerprint maps."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import residue_code

RESIDUE = ["path", "chain", "resseq", "icode", "resname"]


def residues(atoms: DataFrame) -> DataFrame:
    """Residues with a full backbone in file order: ``path, chain, ..., code, res_index``.

    Waters are passed over. The running index counts inside one structure file.
    """
    flags = [F.bool_or(F.col("atom") == name).alias(f"has_{name}") for name in ("CA", "N", "C")]
    grouped = atoms.where("resname <> 'HOH'").groupBy(*RESIDUE).agg(F.min("line_no").alias("first_line"), *flags)
    whole = grouped.where("has_CA AND has_N AND has_C")
    index = F.row_number().over(Window.partitionBy("path").orderBy("first_line")) - 1
    return whole.select(*RESIDUE, "first_line", residue_code(F.col("resname")).alias("code"), index.alias("res_index"))


def extract_sequence(atoms: DataFrame) -> DataFrame:
    """``path, sequence, chains``: one letter per residue and its chain, aligned."""
    rows = residues(atoms).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("res_index", "code", "chain"))).alias("r"))
    return rows.select(
        "path", F.concat_ws("", F.col("r.code")).alias("sequence"), F.concat_ws("", F.col("r.chain")).alias("chains"))


def annotate_structure(atoms: DataFrame, scores: DataFrame) -> DataFrame:
    """Atoms with the score of their residue (``path, res_index, code, score``); 0 where there is none.

    A residue letter differing from the scored one raises.
    """
    joined = residues(atoms).join(
        scores.select("path", "res_index", F.col("code").alias("scored_code"), "score"), ["path", "res_index"], "left")
    message = F.concat(F.lit("residue letter differs at "), F.col("res_index").cast("string"))
    agrees = F.col("scored_code").isNull() | (F.col("scored_code") == F.col("code"))
    checked = joined.withColumn("score", F.when(agrees, F.col("score")).otherwise(F.raise_error(message).cast("double")))
    keyed = checked.select(*RESIDUE, "score")
    return atoms.join(keyed, RESIDUE, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def coordinate_join(atoms: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by exact coordinates; an atom without one must be a hydrogen and gets 0."""
    unique = scores.groupBy("x", "y", "z").agg(F.max("score").alias("score"))
    joined = atoms.join(unique, ["x", "y", "z"], "left")
    message = F.concat(F.lit("atom without score is not a hydrogen: "), "symbol")
    value = F.when(F.col("score").isNotNull(), F.col("score")).when(F.col("symbol") == "H", F.lit(0.0)).otherwise(
        F.raise_error(message).cast("double"))
    return joined.withColumn("score", value)


def family_flags(atoms: DataFrame, features: DataFrame) -> DataFrame:
    """One 0/1 column per feature family from ``g, family, atoms`` (array of atom ids)."""
    hits = features.where(F.col("family").isin(fv.FEATURE_FAMILIES)).select("g", "family", F.explode("atoms").alias("node"))
    wide = hits.groupBy("g", "node").agg(
        *[F.max((F.col("family") == name).cast("int")).alias(name) for name in fv.FEATURE_FAMILIES])
    joined = atoms.join(wide, ["g", "node"], "left")
    return joined.fillna(0, subset=fv.FEATURE_FAMILIES)


def fingerprint(mol: Column, prot: Column) -> Column:
    """Pair fingerprint: the two pooled vectors one after the other."""
    return F.concat(mol, prot)


def project_fingerprints(fingerprints: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """Principal-component map of the fingerprints, ``key, xy``.

    The covariance is accumulated over partitions; its size depends on the vector width only.
    An axis points to where its largest loading is positive, so repeated runs give the same map.
    """
    held = fingerprints.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="m").fit(held)
    axes = model.pc.toArray().T
    signs = [1.0 if axis[abs(axis).argmax()] >= 0 else -1.0 for axis in axes]
    turned = F.zip_with(vector_to_array("m"), F.array(*[F.lit(x) for x in signs]), lambda x, sign: x * sign)
    return model.transform(held).select(key, turned.alias("xy"))
