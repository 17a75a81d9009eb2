"""Small helpers over keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_table(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Min-max scale a keyed table and add the key ``X`` with the raw mid-range.

    ``X`` is not scaled like the others; published tables have it so.
    """
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    low, high = ends.first()
    scaled = df.select(key, ((F.col(value) - low) / (high - low)).alias(out))
    middle = ends.select(F.lit("X").alias(key), ((F.col("hi") + F.col("lo")) / 2.0).alias(out))
    return scaled.unionByName(middle)
