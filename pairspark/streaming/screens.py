"""Screening as a stream: ligands arrive in chunks, results equal the batch operators.

Batches may be repeated after a failure. State is kept in the state store, which repeats a batch
from the state before it; a sink by batches is keyed by the batch number, and a repeated batch
overwrites its own folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.featurize import FeatureCache
from ..operators.windows import top_k

Transform = Callable[[DataFrame], DataFrame]


def _run(stream: DataFrame, each, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


#: Keyed state in Python needs this store.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class _Best(StatefulProcessor):
    """The best ``k`` rows of one group, in the state store. Only groups with new rows are touched."""

    def __init__(self, kept: StructType, column: str, k: int, tie: list[str]):
        self.kept, self.column, self.k, self.tie = kept, column, k, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", self.kept)

    def handleInputRows(self, key, rows, timerValues):
        names = self.kept.fieldNames()
        at, ties = names.index(self.column), [names.index(t) for t in self.tie]

        def order(row):
            return (-row[at], *(row[i] for i in ties))

        best = held = [tuple(r) for r in self.best.get()]
        for frame in rows:
            best = heapq.nsmallest(self.k, [*best, *frame[names].itertuples(index=False, name=None)], key=order)
        if best != held:
            self.best.put(best)
        yield pd.DataFrame({"kept": [len(best)]})

    def close(self) -> None:
        pass


def stream_top_k(stream: DataFrame, score: Transform, by: list[str], column: str, k: int, tie: list[str],
                 checkpoint: str) -> DataFrame:
    """Keep the best ``k`` rows per group over all chunks.

    ``score`` turns a chunk of ligands into scored rows, by operators that a stream allows. The
    state is a list of at most k rows per group in the state store, so a chunk reads and writes
    only the groups it has rows for, and only k rows of a group leave a chunk's partition. The
    answer is read from the store. A stream that is started again with the same ``checkpoint``
    goes on from its state; one that never had a row gives an empty table. Null and NaN scores are
    not ranked; ties go to the smaller ``tie``.
    """
    spark = stream.sparkSession
    scored = score(stream)
    kept = StructType([f for f in scored.schema.fields if f.name not in by])

    def best_of_batch(frames):
        for frame in frames:
            # Ties to the smaller values, as in the state.
            yield frame.sort_values([column, *tie], ascending=[False] + [True] * len(tie)).groupby(by, dropna=False, sort=False).head(k)

    ranked = scored.where(F.col(column).isNotNull() & ~F.isnan(column)).mapInPandas(best_of_batch, scored.schema)
    with _setting(spark, STATE_STORE, ROCKS):
        (ranked.groupBy(*by)
         .transformWithStateInPandas(_Best(kept, column, k, tie), "kept long", "Update", "None")
         .writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
        return top_k(state_rows(spark, checkpoint, "best", scored.schema), by, column, k, tie)


def state_rows(spark: SparkSession, checkpoint: str, variable: str, schema: StructType) -> DataFrame:
    """Rows of a list in the state store of a finished stream: key columns and list items side by side."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    try:
        state = reader.load()
    except PySparkException as exc:
        if not (exc.getCondition() or "").startswith("STDS_"):
            raise
        # No batch has been committed.
        return spark.createDataFrame([], schema)
    return state.select("key.*", "list_element.*").select(*schema.fieldNames())


def stream_scores(stream: DataFrame, score: Transform, sink: str, checkpoint: str) -> None:
    """Append every scored row as its chunk arrives; the file sink's log makes it exactly-once."""
    query = (
        score(stream).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_distinct(stream: DataFrame, key: list[str], sink: str, checkpoint: str) -> None:
    """Emit a key the first time it is seen; the keys seen so far are the state."""
    query = (
        stream.dropDuplicates(key).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


@dataclass
class StreamReport:
    """What a finished run of a stream with a watermark did, batch by batch."""

    rows_in: list[int]
    late: list[int]
    state: list[int]


def stream_distinct_within(stream: DataFrame, key: list[str], time: str, delay: str, sink: str, checkpoint: str) -> StreamReport:
    """Emit a key the first time it is seen within ``delay`` of event time; older keys leave the state.

    A key that comes again while the watermark, ``delay`` behind the latest event, hasn't passed its
    first event by ``delay`` is dropped. Rows older than the watermark are late: they are dropped and
    counted in the report, as are the keys held after each batch.
    """
    query = (
        stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
        .writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.stateOperators]
    return StreamReport([p.numInputRows for p in progress], [p.stateOperators[0].numRowsDroppedByWatermark for p in progress],
                        [p.stateOperators[0].numRowsTotal for p in progress])


def stream_cache_fill(stream: DataFrame, key: str, cache: FeatureCache, compute: Transform, checkpoint: str) -> None:
    """Fill a feature cache chunk by chunk; failures are kept there too (:meth:`FeatureCache.failures`).

    A repeated batch finds its keys in the cache; keys that fail again are listed once. The cache
    merges its runs, so the folders don't grow with the chunks.
    """
    def each(chunk: DataFrame, batch: int) -> None:
        cache.get_or_compute(chunk, key, compute)

    _run(stream, each, checkpoint)


def scored_batches(stream: DataFrame, score: Transform, sink: str, checkpoint: str) -> None:
    """Like :func:`stream_scores` for scorers that need batch operators (joins with counts, ranks)."""
    def each(chunk: DataFrame, batch: int) -> None:
        score(chunk).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    _run(stream, each, checkpoint)

