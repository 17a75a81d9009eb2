"""Stand-ins for the screening tables, derived from the given tables, and their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import pool_vectors
from ..session import checkpointed, dealt, spread
from .registry import table

EMBEDDING_WIDTH = 64

# Letters of the residue alphabet plus B and U, from the whole text.
SEQ_PATTERN = "[^A-Ia-iK-Nk-nP-Yp-y]"
SEQ_SQL = f"seqs AS (SELECT doc_id, upper(regexp_replace(text, '{SEQ_PATTERN}', '', 'g')) AS seq FROM documents)"


# Printable characters that the pattern takes out: translate does so many times as fast, the pattern finds the rare rest.
PLAIN_OTHERS = re.sub("[A-Ia-iK-Nk-nP-Yp-y]", "", "".join(map(chr, range(32, 127)))) + "\t\n\r"


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of every text, taken once per text and after the dealing.

    A filter on a plain column would be planned below the dealing, in the few tasks of the scan, and
    take the letters there again. It stays above an explode, here of one element.
    """
    letters = F.upper(F.regexp_replace(F.translate("text", PLAIN_OTHERS, ""), SEQ_PATTERN, ""))
    docs = dealt(table(spark, folder, "documents", "doc_id", "text"))
    return docs.select("doc_id", F.explode(F.array(letters)).alias("seq"))


CENTROID_SQL = """
  parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  means AS (SELECT label, i, avg(v) AS m FROM parts GROUP BY label, i),
  centroids AS (SELECT label AS protein_id, list(m ORDER BY i) AS protein_vec FROM means GROUP BY label)
"""

SCREEN_SQL = f"""{CENTROID_SQL},
  scored AS (SELECT protein_id, vec_id AS smiles,
                    list_dot_product(embedding::DOUBLE[], protein_vec) AS prediction
             FROM embeddings, centroids)
"""


def ligand_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "embeddings")).select(F.col("vec_id").alias("smiles"), F.col("embedding").alias("ligand_vec"), "label")


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Class means of the embeddings as proteins, stored once like any feature table."""
    means = pool_vectors(
        table(spark, folder, "embeddings"), ["label"], "embedding", EMBEDDING_WIDTH, mean=True, out="protein_vec")
    return checkpointed(spark, means.withColumnRenamed("label", "protein_id"))


def line_key() -> str:
    """Unique row key of lineitem as SQL, the same in both engines."""
    return ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
            "CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT))")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("line_key", F.expr(line_key()))


# Order graphs: parts of an order are nodes 0..n-1 by rank of the part, consecutive ones are linked.
ORDER_NODES_SQL = """
  order_parts AS (SELECT l_orderkey AS g, l_partkey, max(l_quantity) AS x FROM lineitem GROUP BY 1, 2),
  nodes AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY l_partkey) - 1 AS BIGINT) AS node, l_partkey, x FROM order_parts),
  edges AS (SELECT g, src, dst, weight FROM (
      SELECT a.g, a.node AS src, b.node AS dst, (1.0 + (a.l_partkey + b.l_partkey) % 7)::DOUBLE AS weight
      FROM nodes a JOIN nodes b ON a.g = b.g AND a.node <> b.node AND (a.l_partkey + b.l_partkey) % 3 = 0))
"""


def order_graphs(spark: SparkSession, folder: str, placed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes ``g, node, l_partkey, x`` and symmetric edges ``g, src, dst, weight`` of the orders.

    An order holds a handful of parts, so the in-order pairing stays small. With ``placed`` both keep
    lying by ``g``, in splits that the planner doesn't join to larger ones, for work that makes much of a row.
    """
    from pyspark.sql import Window

    # One shuffle by order serves the fold, the ranks and the pairing.
    lines_of = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("g"), "l_partkey", "l_quantity")
    splits = [max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * lines_of.rdd.getNumPartitions())] if placed else []
    lines_of = lines_of.repartition(*splits, "g")
    parts = lines_of.groupBy("g", "l_partkey").agg(F.max("l_quantity").alias("x"))
    node = F.row_number().over(Window.partitionBy("g").orderBy("l_partkey")).cast("long") - 1
    nodes = parts.select("g", node.alias("node"), "l_partkey", "x")
    a = nodes.select("g", F.col("node").alias("src"), F.col("l_partkey").alias("pa"))
    b = nodes.select("g", F.col("node").alias("dst"), F.col("l_partkey").alias("pb"))
    joined = a.join(b, "g").where("src <> dst AND (pa + pb) % 3 = 0")
    weight = (F.lit(1.0) + (F.col("pa") + F.col("pb")) % 7).cast("double")
    return nodes, joined.select("g", "src", "dst", weight.alias("weight"))
