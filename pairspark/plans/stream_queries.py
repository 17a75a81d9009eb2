"""Streaming queries: the given tables are cut into files and arrive chunk by chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screening as sc
from ..operators.featurize import FeatureCache, featurize_sql
from ..session import fresh_dir
from ..streaming import screens
from .registry import query, table
from .views import SCREEN_SQL, centroids, ligand_vectors


def _stream(spark, df, key, label):
    """The table as a stream of four chunks, each of as many files as a quarter of the table's splits and the cores ask for."""
    path = fresh_dir(spark, label)
    files = max(1, -(-max(df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism) // 4))
    df.repartition(4 * files, key).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("stream_top_k", f"""
  WITH {SCREEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY prediction DESC, smiles) AS rank FROM scored)
  SELECT protein_id, smiles, round(prediction, 4) AS prediction, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def stream_top_k_query(spark, folder):
    held = fresh_dir(spark, "proteins")
    centroids(spark, folder).write.parquet(held)
    ligands = ligand_vectors(spark, folder).select("smiles", "ligand_vec")

    def score(chunk):
        matrix = sc.screen_matrix(chunk, spark.read.parquet(held), "smiles", "protein_id")
        return sc.score_dot(matrix, "ligand_vec", "protein_vec").select("protein_id", "smiles", "prediction")

    best = screens.stream_top_k(
        _stream(spark, ligands, "smiles", "ligand-chunks"), score, ["protein_id"], "prediction", 5, ["smiles"], fresh_dir(spark, "checkpoint"))
    return best.select("protein_id", "smiles", F.round("prediction", 4).alias("prediction"), "rank")


@query("stream_scores", """
  SELECT event_id, round(value * 0.5 + user_id % 10, 4) AS prediction FROM events
""")
def stream_scores_query(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    sink = fresh_dir(spark, "stream-scores")

    def score(chunk):
        with_residue = chunk.withColumn("u", F.col("user_id") % 10)
        return sc.score_linear(with_residue, ["value", "u"], [0.5, 1.0]).select("event_id", F.round("prediction", 4).alias("prediction"))

    screens.stream_scores(_stream(spark, events, "event_id", "event-chunks"), score, sink, fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(sink)


@query("stream_distinct", "SELECT DISTINCT text FROM documents")
def stream_distinct_query(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    sink = fresh_dir(spark, "stream-distinct")
    stream = _stream(spark, docs, "doc_id", "document-chunks").select("text")
    screens.stream_distinct(stream, ["text"], sink, fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(sink).select("text")


@query("stream_distinct_within", "SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events")
def stream_distinct_within_query(spark, folder):
    """Users by hour: a key's events all come before it leaves the state, since chunks arrive in order of time."""
    events = table(spark, folder, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))
    path, sink = fresh_dir(spark, "event-chunks"), fresh_dir(spark, "stream-distinct-within")
    # One file per quarter of the time, written one after the other: files arrive by their age.
    first, last = events.agg(F.min("hour"), F.max("hour")).first()
    if first is None:
        return events.select("user_id", "hour")
    quarter = F.floor((F.col("hour") - first) * 4 / (last - first + 1))
    for i in range(4):
        events.where(quarter == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    screens.stream_distinct_within(stream, ["user_id", "hour"], "ts", "2 hours", sink, fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(sink).select("user_id", "hour")


@query("stream_cache_fill", """
  SELECT sha256(text) AS sha, CAST(length(text) AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT text FROM conversations) WHERE length(text) >= 100
  UNION ALL SELECT sha256(text), NULL, 'too short' FROM (SELECT DISTINCT text FROM conversations) WHERE length(text) < 100
""")
def stream_cache_fill_query(spark, folder):
    texts = table(spark, folder, "conversations", "conv_id", "text")
    cache = FeatureCache(spark, fresh_dir(spark, "stream-cache"), "bigint", most_runs=2)

    def lengths(keys):
        return featurize_sql(keys, "text", F.length("text").cast("long"), F.when(F.length("text") < 100, "too short"))

    screens.stream_cache_fill(_stream(spark, texts, "conv_id", "turn-chunks"), "text", cache, lengths, fresh_dir(spark, "checkpoint"))
    stored = cache.table().select("sha", "value", F.lit(None).cast("string").alias("error"))
    return stored.unionByName(cache.failures().select("sha", F.lit(None).cast("long").alias("value"), "error"))
