"""Streams: keyed state, restarts, empty streams, watermarks."""

import datetime
import os

from pairspark.operators.windows import top_k
from pairspark.session import fresh_dir, shared_dir
from pairspark.streaming import screens

SCHEMA = "protein string, smiles string, score double"


def chunk(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    os.makedirs(path, exist_ok=True)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def best(spark, path, checkpoint):
    found = screens.stream_top_k(source(spark, path), lambda c: c, ["protein"], "score", 2, ["smiles"], checkpoint)
    assert found.columns == ["protein", "smiles", "score", "rank"]
    return sorted((r["protein"], r["rank"], r["smiles"], r["score"]) for r in found.collect())


def test_top_k_goes_on_after_a_restart(spark):
    path, checkpoint = fresh_dir(spark, "chunks"), fresh_dir(spark, "checkpoint")
    setting = spark.conf.get(screens.STATE_STORE, None)
    chunk(spark, path, [("p", "a", 1.0), ("p", "b", 3.0), ("p", "c", 2.0), ("q", "a", 5.0)])
    chunk(spark, path, [("p", "d", 3.0), ("q", "b", float("nan")), ("q", "c", None)])
    assert best(spark, path, checkpoint) == [("p", 1, "b", 3.0), ("p", 2, "d", 3.0), ("q", 1, "a", 5.0)]
    # Nothing new, then a new chunk with a repeated row.
    assert best(spark, path, checkpoint) == [("p", 1, "b", 3.0), ("p", 2, "d", 3.0), ("q", 1, "a", 5.0)]
    chunk(spark, path, [("p", "b", 3.0), ("p", "e", 9.0), ("r", "z", -1.0)])
    got = best(spark, path, checkpoint)
    assert got == [("p", 1, "e", 9.0), ("p", 2, "b", 3.0), ("q", 1, "a", 5.0), ("r", 1, "z", -1.0)]
    chunk(spark, path, [("p", "e", 9.0), ("p", "e", 9.0)])
    got = best(spark, path, checkpoint)
    assert got[:2] == [("p", 1, "e", 9.0), ("p", 2, "e", 9.0)]
    whole = top_k(spark.read.schema(SCHEMA).parquet(path), ["protein"], "score", 2, ["smiles"])
    assert got == sorted((r["protein"], r["rank"], r["smiles"], r["score"]) for r in whole.collect())
    assert spark.conf.get(screens.STATE_STORE, None) == setting


def test_an_empty_stream_gives_an_empty_table(spark):
    path, checkpoint = fresh_dir(spark, "chunks"), fresh_dir(spark, "checkpoint")
    assert best(spark, path, checkpoint) == []
    chunk(spark, path, [("p", "a", 1.0)])
    assert best(spark, path, checkpoint) == [("p", 1, "a", 1.0)]


def test_late_rows_are_counted_and_state_shrinks(spark):
    path, sink = fresh_dir(spark, "chunks"), fresh_dir(spark, "sink")
    start = datetime.datetime(2024, 1, 1)
    schema = "key long, ts timestamp"

    def write(rows):
        spark.createDataFrame([(k, start + datetime.timedelta(hours=h)) for k, h in rows], schema).coalesce(1).write.mode("append").parquet(path)

    write([(k, 0) for k in range(100)])
    write([(k, 0) for k in range(100)] + [(1000, 50)])
    write([(1001, 51)])
    write([(1002, 52), (1000, 52), (1, 1)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    report = screens.stream_distinct_within(stream, ["key"], "ts", "5 hours", sink, fresh_dir(spark, "checkpoint"))
    assert sorted(r["key"] for r in spark.read.parquet(sink).collect()) == [*range(100), 1000, 1001, 1002]
    assert sum(report.late) == 1 and max(report.state) >= 100 and report.state[-1] <= 3


def test_chunks_of_a_stream_are_of_several_files(spark):
    """A chunk's rows are no single task's: there are four chunks, each of as many files as a quarter of the cores."""
    import os

    from pairspark.plans import stream_queries

    rows = spark.range(4000).selectExpr("id AS k", "concat('text ', id % 900) AS text")
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    stream = stream_queries._stream(spark, rows, "k", "dealt-chunks")
    made = [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("dealt-chunks") and f not in before]
    files = [f for f in os.listdir(os.path.join(shared_dir(spark).removeprefix("file:"), made[0])) if f.endswith(".parquet")]
    assert len(files) >= spark.sparkContext.defaultParallelism
    sink = fresh_dir(spark, "dealt-sink")
    screens.stream_distinct(stream.select("text"), ["text"], sink, fresh_dir(spark, "checkpoint"))
    assert spark.read.parquet(sink).count() == 900
