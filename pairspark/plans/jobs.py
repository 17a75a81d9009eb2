"""Whole jobs: screening from files to ranked output, scoring and evaluating given pairs, splitting.

Model and featurizers are plug-ins; everything around them is here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import shift_label
from ..functions.text import sha_key
from ..operators import metrics
from ..operators import screening as sc
from ..operators import splits
from ..operators.featurize import FeatureCache, canonicalize, featurize
from ..operators.windows import minmax_per_group, percentile_rank, top_k
from ..session import checkpointed, stored
from ..sources.files import read_fasta, read_pairs, read_smiles_auto
from ..sources.sinks import write_interpretation, write_scores


@dataclass
class Screening:
    """Settings of one screening run.

    ``protein_features`` and ``ligand_features`` map one string to a feature value of
    ``feature_type``. ``make_scorer`` builds the pair model (see :func:`score_pairs`), which
    reads the columns ``protein_feature`` and ``ligand_feature``. ``explain`` maps survivors
    with their features to ``protein_id, smiles, pos, aa, raw``.
    """

    fasta: str
    ligands: str
    output: str
    cache: str
    protein_features: Callable[[str], object]
    ligand_features: Callable[[str], object]
    make_scorer: Callable[[], sc.Scorer]
    feature_type: str = "array<double>"
    heads: sc.Heads = field(default_factory=sc.Heads)
    top_k: int | None = None
    canonical: Callable[[str], str | None] | None = None
    explain: Callable[[DataFrame], DataFrame] | None = None
    interpretation: str | None = None
    batch_size: int = 128
    max_pairs: int | None = None


def run_screening(spark: SparkSession, job: Screening) -> dict[str, int]:
    """Read, canonicalize, featurize through the caches, score, rank and write. Returns the counters."""
    proteins = read_fasta(spark, job.fasta)
    ligands = read_smiles_auto(spark, job.ligands).select("smiles")
    # Forms and scores are the costly steps: each is made once and stored.
    aliases, unparsed = canonicalize(ligands, "smiles", job.canonical, lambda df: checkpointed(spark, df))
    size = sc.check_scale(proteins, aliases, job.top_k, job.interpretation is not None, max_pairs=job.max_pairs)

    def features(name: str, keys: DataFrame, key: str, fn: Callable[[str], object]):
        cache = FeatureCache(spark, f"{job.cache}/{name}", job.feature_type)
        return cache.get_or_compute(keys, key, lambda missing: featurize(missing, key, fn, job.feature_type))

    ligand_run = features("ligands", aliases.select("canonical"), "canonical", job.ligand_features)
    protein_run = features("proteins", proteins.select("sequence"), "sequence", job.protein_features)
    known = proteins.withColumn("sha", sha_key(F.col("sequence")))
    sc.check_target_coverage(known, protein_run.features, "sha")
    targets = known.join(protein_run.features, "sha").select(
        "protein_id", "sequence", F.length("sequence").alias("protein_length"), F.col("value").alias("protein_feature"))
    # Distinct canonical forms are scored; originals get their scores by a join afterwards.
    forms = aliases.select("canonical", sha_key(F.col("canonical")).alias("sha")).distinct()
    scorable = forms.join(ligand_run.features, "sha").select("canonical", F.col("value").alias("ligand_feature"))
    matrix = sc.screen_matrix(scorable, targets.drop("sequence"), "canonical", "protein_id")
    scored = sc.score_pairs(matrix, job.make_scorer, ["protein_feature", "ligand_feature"],
                            ["protein_id", "canonical", "protein_length"], job.heads, job.batch_size)
    scored = checkpointed(spark, scored)
    if job.top_k is not None:
        # The k best originals lie among the k best forms; ties go by the canonical form, then the original.
        scored = top_k(scored, ["protein_id"], "prediction", job.top_k, ["canonical"]).drop("rank")
    results = sc.fan_out_aliases(scored, aliases)
    if job.top_k is not None:
        results = top_k(results, ["protein_id"], "prediction", job.top_k, ["canonical", "smiles"]).drop("rank")
    write_scores(results, job.output, job.heads, exact_order=job.top_k is not None)
    if job.interpretation is not None and job.explain is not None:
        _interpret(results, targets, scorable, job)
    return {
        "proteins": size.proteins, "ligands": size.ligands, "pairs": size.pairs, "unparsed": unparsed.count(),
        "ligand_misses": ligand_run.counters.get["misses"], "ligand_failed": ligand_run.counters.get["failed"],
        "protein_misses": protein_run.counters.get["misses"], "protein_failed": protein_run.counters.get["failed"],
    }


def _interpret(results: DataFrame, targets: DataFrame, scorable: DataFrame, job: Screening) -> None:
    """Second pass over the survivors: features are joined to them only."""
    survivors = results.select("protein_id", "smiles", "canonical").join(
        targets.select("protein_id", "sequence", "protein_feature"), "protein_id").join(scorable, "canonical")
    rows = job.explain(survivors)
    pair = ["protein_id", "smiles"]
    scaled = minmax_per_group(rows, pair, "raw", "residue_score")
    ranked = percentile_rank(scaled, pair, "raw", "pos", "residue_percentile")
    write_interpretation(ranked.select(
        *pair, (F.col("pos") + 1).alias("Residue_ID"), F.col("aa").alias("Residue_Type"), "residue_score", "residue_percentile"),
        job.interpretation)


@dataclass
class PairScoring:
    """Settings for scoring given pairs; the model's parts are those of :class:`Screening`."""

    cache: str
    protein_features: Callable[[str], object]
    ligand_features: Callable[[str], object]
    make_scorer: Callable[[], sc.Scorer]
    feature_type: str = "array<double>"
    heads: sc.Heads = field(default_factory=sc.Heads)
    batch_size: int = 128


def score_given_pairs(pairs: DataFrame, job: PairScoring) -> DataFrame:
    """``pairs`` with the score columns next to their own ones.

    Features come through the caches and every distinct (Protein, Ligand) is scored once. Pairs
    that can't be featurized, or have no protein or ligand, stay with NULL scores.
    """
    spark = pairs.sparkSession
    taken = set(job.heads.score_columns()) & set(pairs.columns)
    if taken:
        raise ValueError(f"columns named like scores: {sorted(taken)}")

    def features(name: str, key: str, fn: Callable[[str], object], out: str) -> DataFrame:
        keys = stored(spark, pairs.where(F.col(key).isNotNull()).select(key).distinct())
        cache = FeatureCache(spark, f"{job.cache}/{name}", job.feature_type)
        run = cache.get_or_compute(keys, key, lambda missing: featurize(missing, key, fn, job.feature_type))
        return cache.attach(keys, key, run.features).withColumnRenamed("value", out)

    ligands = features("ligands", "Ligand", job.ligand_features, "ligand_feature")
    proteins = features("proteins", "Protein", job.protein_features, "protein_feature")
    unique = pairs.select("Protein", "Ligand").distinct()
    hydrated = sc.hydrate_pairs(unique, ligands, proteins, "Ligand", "Protein")
    scored = stored(spark, sc.score_pairs(
        hydrated, job.make_scorer, ["protein_feature", "ligand_feature"], ["Protein", "Ligand"], job.heads, job.batch_size))
    return sc.attach_predictions(pairs, scored, ["Protein", "Ligand"])


def score_pair_list(spark: SparkSession, path: str, output: str, job: PairScoring) -> dict[str, int]:
    """Score the pairs of a CSV (``Protein``, ``Ligand``, optional ``ID``, other columns kept) into ``output``.

    Rows without an id get ``PAIR_<row>`` in the order of the file. Returns the counters.
    """
    raw = spark.read.option("header", True).csv(path)
    # Stored, so that a row keeps its number whatever reads it.
    placed = stored(spark, raw.withColumn("__place", F.monotonically_increasing_id()))
    pairs = sc.assign_pair_id(placed, "__place", row_ids=True).drop("__place")
    scored = stored(spark, score_given_pairs(pairs, job))
    scored.write.mode("overwrite").option("header", True).csv(output)
    rows, done = scored.agg(F.count(F.lit(1)), F.count("prediction")).first()
    return {"pairs": rows, "scored": done, "unscored": rows - done}


def evaluate_folder(spark: SparkSession, folder: str, output: str, job: PairScoring) -> DataFrame:
    """Score the test pairs of a data folder; write ``predictions.csv`` and ``metrics.csv`` folders.

    Returns the metrics (metric, value) of the heads; pairs that have no score count in none.
    """
    test = stored(spark, read_pairs(spark, folder).where("split = 'test'").drop("split"))
    scored = stored(spark, score_given_pairs(test, job))
    scored.write.mode("overwrite").option("header", True).csv(f"{output}/predictions.csv")
    known, heads = scored.where("prediction IS NOT NULL"), job.heads
    regression = binary = multiclass = None
    if heads.regression:
        regression = known.select(F.col("regression_label").alias("y"), F.col("prediction").alias("p"))
    if heads.classification:
        binary = known.select(F.col("classification_label").alias("y"), F.col("predicted_binary_interaction").alias("p"))
    if heads.multiclass:
        multiclass = known.select(
            shift_label(F.col("multiclass_label")).alias("label"),
            F.array("predicted_antagonist", "predicted_nonbinder", "predicted_agonist").alias("probs"))
    report = checkpointed(spark, metrics.evaluate(regression, binary, multiclass))
    report.write.mode("overwrite").option("header", True).csv(f"{output}/metrics.csv")
    return report


def write_splits(pairs: DataFrame, folder: str, kind: str, column: str | list[str], fractions: list[float], seed: int) -> DataFrame:
    """Split a pair table, write ``train.csv``, ``valid.csv`` and ``test.csv`` folders, return the ratios.

    ``kind`` is ``random`` (column = unique key), ``group`` or ``cold`` (column = entities).
    """
    if kind == "random":
        split = splits.random_split(pairs, column, fractions, seed)
    elif kind == "group":
        split = splits.group_split(pairs, column, fractions, seed)
    elif kind == "cold":
        split = splits.cold_split(pairs, [column] if isinstance(column, str) else column, fractions, seed, check=True)
    else:
        raise ValueError(f"unknown split: {kind}")
    for name in ("train", "valid", "test"):
        part = split.where(F.col("split") == name).drop("split")
        part.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    return splits.split_ratio_check(split)
