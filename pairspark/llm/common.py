"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir

def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a checkpoint the result has a known size, by which the planner picks its joins.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that :func:`stored` wrote, once all that is made of it is stored too."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of text that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python in small batches, since some are very long.

    A batch of whole texts and what is made of it should stay far below a worker's memory; a
    session that asks for still smaller batches keeps them.
    """
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(conf.get(size).rstrip("b")) <= BATCH_BYTES:
        conf.set(size, f"{BATCH_BYTES}b")
    return df


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % folds


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks.

    Functions of this package reach workers by value, so their own globals last one task only.
    """
    holder = sys.modules.setdefault("_pairspark_worker", types.ModuleType("_pairspark_worker"))
    return holder.__dict__.setdefault(name, {})


def release_memory() -> None:
    """Give what a task freed back to the system, since the worker stays for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator], Iterator]:
    """A ``mapInArrow`` function from one that maps a batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
        release_memory()

    return run


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def table_at(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
