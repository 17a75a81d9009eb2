"""Connected components of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _pull(pairs: DataFrame) -> DataFrame:
    """``u, v, m`` with ``m`` the smallest of ``u`` and its partners.

    The minimum is folded before the shuffle and stored, so that the join back meets two plain
    tables: small ones are broadcast by size, and a hub's partners can be split by the planner.
    """
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
    return pairs.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select("u", "v", F.least("u", "m").alias("m"))


def component_roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u, v``, long): the smallest node it reaches.

    Every round hangs all larger partners of a node, then all smaller ones, to the smallest of
    them. Paths shrink by halves, so the rounds grow with the logarithm of the longest path.
    Self-links and repeated links are harmless; null ends are ignored; no links give no rows.
    """
    edges = stored(links.where("u <> v").select("u", "v").distinct(), "star-links")
    state = None
    while True:
        both = stored(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "star-both")
        large = _pull(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "star-large")
        down = _pull(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "star-links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
