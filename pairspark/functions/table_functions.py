"""Table functions for SQL: windows over texts, batches and best rows of a partitioned table.

They are called as ``f(TABLE(t) PARTITION BY key ORDER BY (column), n)``: Spark brings the rows of a
key together in the given order, and a function sees them one by one and keeps no more than a few
numbers. In DataFrame code the operators of ``operators/windows.py`` stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException

from . import fixed_values as fv


class SlidingWindows:
    """``sliding_windows(text [, window, stride])``: ``chunk_start, chunk``; the last window is clipped."""

    def eval(self, text: str, window: int = fv.WINDOW_LENGTH, stride: int = fv.WINDOW_STRIDE):
        if text is None:
            return
        start = 0
        while True:
            yield start, text[start:start + window]
            if start + window >= len(text):
                return
            start += stride


class _PerRow:
    """A table function that adds one number to the rows of a partition."""

    added = StructField("number", LongType())

    @classmethod
    def _result(cls, rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("a table argument is expected: TABLE(t) PARTITION BY ... ORDER BY (...)")
        return AnalyzeResult(StructType([*rows.dataType.fields, cls.added]))

    def __init__(self):
        self.seen = 0


class BestRows(_PerRow):
    """``best_rows(TABLE(t) PARTITION BY key ORDER BY (score DESC), k)``: the first ``k`` rows of each key with their ``rank``."""

    added = StructField("rank", IntegerType())

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        return BestRows._result(rows)

    def eval(self, rows, k: int):
        if self.seen >= k:
            # The rest of the key's rows is passed over without a call.
            raise SkipRestOfInputTableException()
        self.seen += 1
        yield (*rows, self.seen)


class Batches(_PerRow):
    """``batches(TABLE(t) PARTITION BY bin ORDER BY (length), size)``: every row with its ``batch_no`` in the bin."""

    added = StructField("batch_no", LongType())

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        return Batches._result(rows)

    def eval(self, rows, size: int):
        yield (*rows, self.seen // size)
        self.seen += 1


def register_table_functions(spark: SparkSession) -> list[str]:
    from pyspark.sql.functions import udtf

    spark.udtf.register("sliding_windows", udtf(SlidingWindows, returnType="chunk_start int, chunk string"))
    spark.udtf.register("best_rows", udtf(BestRows))
    spark.udtf.register("batches", udtf(Batches))
    return ["sliding_windows", "best_rows", "batches"]
