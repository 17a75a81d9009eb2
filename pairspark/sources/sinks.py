"""Writers of score and explanation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pair_key, safe_id
from ..operators.screening import Heads, round_scores
from ..operators.windows import rank_output


def score_output(scores: DataFrame, heads: Heads, exact_order: bool = False) -> DataFrame:
    """Output columns of the heads, rounded to four places and ranked."""
    named = scores.select("protein_id", "smiles", *heads.score_columns(), "protein_length")
    others = [c for c in heads.score_columns() if c != "prediction"]
    for name in others:
        named = named.withColumn(name, F.round(name, 4))
    return rank_output(named, "prediction", rounded=not exact_order)


def write_scores(scores: DataFrame, path: str, heads: Heads, exact_order: bool = False) -> None:
    """Replace ``path`` by the ranked CSV table. Files follow the order by name."""
    score_output(scores, heads, exact_order).write.mode("overwrite").option("header", True).csv(path)


def append_scores(scores: DataFrame, path: str, heads: Heads) -> None:
    round_scores(scores, heads).write.mode("append").option("header", True).csv(path)


#: Buckets of an interpretation table: as many files at most, however many pairs there are.
BUCKETS = 64


def _bucket(pair_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(pair_id), F.lit(buckets)).cast("int")


def write_interpretation(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Explanation rows of the surviving pairs, by hash buckets of the pair, sorted by pair.

    ``rows`` are residue, atom or fingerprint rows with ``protein_id`` and ``smiles`` next to their
    own columns. A bucket is one file, so their number does not grow with the pairs. ``path/pairs``
    holds the rows, ``path/lookup`` one row per file: ``buckets, bucket, file, first_pair,
    last_pair, pairs``.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("pair_id", pair_key(F.col("protein_id"), F.col("smiles"))).withColumn("protein_id", safe_id(F.col("protein_id")))
    placed = keyed.drop("smiles").withColumn("bucket", _bucket(F.col("pair_id"), buckets))
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "pair_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pairs")
    written = spark.read.schema("protein_id string, pair_id string, bucket int").parquet(f"{path}/pairs")
    lookup = written.select("bucket", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "pair_id").groupBy("bucket", "file", "pair_id").count()
    lookup.groupBy(F.lit(buckets).alias("buckets"), "bucket", "file").agg(
        F.min("pair_id").alias("first_pair"), F.max("pair_id").alias("last_pair"), F.count(F.lit(1)).alias("pairs")).coalesce(1).write.mode("overwrite").parquet(f"{path}/lookup")


def read_pair(spark: SparkSession, path: str, protein_id: str, smiles: str, schema: str) -> DataFrame:
    """The rows of one pair, from its bucket's file; ``schema`` names its own columns. No such pair gives no rows."""
    pair = pair_key(F.lit(protein_id), F.lit(smiles))
    files = spark.read.parquet(f"{path}/lookup").withColumn("pair", pair).where(
        (F.col("bucket") == F.pmod(F.xxhash64("pair"), "buckets")) & F.col("pair").between(F.col("first_pair"), F.col("last_pair")))
    files = files.select("bucket", "file", "pair").collect()
    kind = f"protein_id string, pair_id string, {schema}"
    if not files:
        return spark.createDataFrame([], kind)
    paths = [f"{path}/pairs/bucket={r['bucket']}/{r['file']}" for r in files]
    return spark.read.schema(kind).parquet(*paths).where(F.col("pair_id") == files[0]["pair"])
