"""Queries for splits, set operations, weights and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import splits as sp
from .registry import query, table
from .views import ORDER_NODES_SQL, line_key, lines, order_graphs


def _random_sql(source: str, key: str, seed: int, valid: float, test: float) -> str:
    return f"""
  a AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || {key})) AS r1, count(*) OVER () AS n FROM {source}),
  t AS (SELECT *, r1 <= round(n * {test}::DOUBLE) AS in_test FROM a),
  v AS (SELECT *, row_number() OVER (PARTITION BY in_test ORDER BY md5('1:' || {key})) AS r2, count(*) OVER (PARTITION BY in_test) AS rest FROM t),
  s AS (SELECT *, CASE WHEN in_test THEN 'test' WHEN r2 <= round(rest * {valid / (1 - test)!r}::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM v)
"""


@query("random_split", f"WITH {_random_sql('documents', 'doc_id', 8, 0.1, 0.2)} SELECT doc_id, split FROM s")
def random_split_query(spark, folder):
    return sp.random_split(table(spark, folder, "documents", "doc_id"), "doc_id", [0.7, 0.1, 0.2], 8)


@query("split_ratio_check", f"""
  WITH {_random_sql('events', 'event_id', 8, 0.1, 0.2)} SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS ratio FROM s GROUP BY split
""")
def split_ratio_check_query(spark, folder):
    split = sp.random_split(table(spark, folder, "events", "event_id"), "event_id", [0.7, 0.1, 0.2], 8)
    return sp.split_ratio_check(split).withColumn("ratio", F.round("ratio", 6))


def _group_sql(source: str, group: str, seed: int, train: float, valid: float) -> str:
    return f"""
  g AS (SELECT {group} AS grp, count(*) AS size FROM {source} GROUP BY 1),
  z AS (SELECT *, CAST(floor(sum(size) OVER () * {train}) AS BIGINT) AS tr, CAST(floor(sum(size) OVER () * {valid}) AS BIGINT) AS va,
               sum(size) OVER () AS n FROM g),
  o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN size > va / 2 OR size > (n - tr - va) / 2 THEN 0 ELSE 1 END, md5('{seed}:' || grp)) AS rn FROM z)
"""


def _prefix_sql(source: str, group: str, seed: int, train: float, valid: float) -> str:
    return f"""{_group_sql(source, group, seed, train, valid)},
  c AS (SELECT *, sum(size) OVER (ORDER BY rn) AS upto FROM o),
  s AS (SELECT grp, CASE WHEN upto <= tr THEN 'train' WHEN upto <= tr + va THEN 'valid' ELSE 'test' END AS split FROM c)
"""


@query("group_split", f"""
  WITH {_prefix_sql('documents', 'source', 3, 0.7, 0.1)} SELECT doc_id, split FROM documents JOIN s ON grp = source
""")
def group_split_query(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "source")
    return sp.group_split(docs, "source", [0.7, 0.1, 0.2], 3).select("doc_id", "split")


@query("group_split_many", f"""
  WITH {_prefix_sql('lineitem', 'l_orderkey', 3, 0.6, 0.2)} SELECT l_orderkey, split, count(*) AS n FROM lineitem JOIN s ON grp = l_orderkey GROUP BY 1, 2
""")
def group_split_many(spark, folder):
    split = sp.group_split(table(spark, folder, "lineitem", "l_orderkey"), "l_orderkey", [0.6, 0.2, 0.2], 3)
    return split.groupBy("l_orderkey", "split").agg(F.count(F.lit(1)).alias("n"))


def _greedy_sql(group: str, seed: int, train: float, valid: float) -> str:
    return f"""
  WITH RECURSIVE {_group_sql('lineitem', group, seed, train, valid)},
  w(rn, t, v, grp, split) AS (
    SELECT CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
    UNION ALL
    SELECT o.rn, CASE WHEN w.t + size <= tr THEN w.t + size ELSE w.t END,
           CASE WHEN w.t + size > tr AND w.v + size <= va THEN w.v + size ELSE w.v END, o.grp,
           CASE WHEN w.t + size <= tr THEN 'train' WHEN w.v + size <= va THEN 'valid' ELSE 'test' END
    FROM w JOIN o ON o.rn = w.rn + 1)
  SELECT {group}, split, count(*) AS n FROM lineitem JOIN w ON grp = {group} GROUP BY 1, 2
"""


@query("group_split_greedy", _greedy_sql("l_suppkey", 3, 0.7, 0.1))
def group_split_greedy_query(spark, folder):
    split = sp.group_split_greedy(table(spark, folder, "lineitem", "l_suppkey"), "l_suppkey", [0.7, 0.1, 0.2], 3)
    return split.groupBy("l_suppkey", "split").agg(F.count(F.lit(1)).alias("n"))


@query("group_split_greedy_cut", _greedy_sql("l_suppkey", 4, 0.5, 0.3))
def group_split_greedy_cut(spark, folder):
    """By rounds down to the last two groups."""
    split = sp.group_split_greedy(table(spark, folder, "lineitem", "l_suppkey"), "l_suppkey", [0.5, 0.3, 0.2], 4, one_task=2)
    return split.groupBy("l_suppkey", "split").agg(F.count(F.lit(1)).alias("n"))


def _draw_sql(name: str, source: str, column: str, fraction: float) -> str:
    return f"""{name} AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY md5('8:' || k)) AS r, count(*) OVER () AS n
        FROM (SELECT DISTINCT {column} AS k FROM {source})) WHERE r <= round(n * {fraction!r}::DOUBLE))"""


@query("cold_split", f"""
  WITH {_draw_sql('tp', 'lineitem', 'l_partkey', 0.3)}, {_draw_sql('ts', 'lineitem', 'l_suppkey', 0.3)},
  m AS (SELECT {line_key()} AS line_key, l_partkey, l_suppkey, l_partkey IN (SELECT k FROM tp) AS p, l_suppkey IN (SELECT k FROM ts) AS s FROM lineitem),
  rest AS (SELECT * FROM m WHERE NOT p AND NOT s),
  {_draw_sql('vp', 'rest', 'l_partkey', 0.2 / 0.7)}, {_draw_sql('vs', 'rest', 'l_suppkey', 0.2 / 0.7)},
  w AS (SELECT line_key, l_partkey IN (SELECT k FROM vp) AS p, l_suppkey IN (SELECT k FROM vs) AS s FROM rest)
  SELECT line_key, 'test' AS split FROM m WHERE p AND s
  UNION ALL SELECT line_key, CASE WHEN p THEN 'valid' ELSE 'train' END FROM w WHERE p = s
""")
def cold_split_query(spark, folder):
    rows = lines(spark, folder).select("line_key", "l_partkey", "l_suppkey")
    return sp.cold_split(rows, ["l_partkey", "l_suppkey"], [0.5, 0.2, 0.3], 8).select("line_key", "split")


@query("temporal_split", """
  WITH e AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('8:' || o_orderkey)) AS r, count(*) OVER () AS n FROM orders WHERE year(o_orderdate) < 1997)
  SELECT o_orderkey, CASE WHEN r <= round(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM e
  UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE year(o_orderdate) >= 1997
""")
def temporal_split_query(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    return sp.temporal_split(orders, "o_orderdate", 1997, "o_orderkey", 0.1, 8).select("o_orderkey", "split")


@query("id_list_split", """
  WITH e AS (SELECT doc_id, row_number() OVER (ORDER BY md5('8:' || doc_id)) AS r, count(*) OVER () AS n FROM documents
             WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
  SELECT doc_id, CASE WHEN r <= round(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM e
  UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def id_list_split_query(spark, folder):
    listed = table(spark, folder, "labels").where("toxic = 1").select(F.concat(F.lit("id_"), "doc_id").alias("id"))
    return sp.id_list_split(table(spark, folder, "documents", "doc_id"), listed, "doc_id", 0.1, 8)


@query("target_subset", """
  SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7') AND l_linenumber <> 1 GROUP BY 1
""")
def target_subset_query(spark, folder):
    targets = table(spark, folder, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("l_partkey"))
    chosen = sp.target_subset(table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_linenumber"), targets, "l_partkey", "l_linenumber", 1)
    return chosen.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("complement", """
  SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY md5('4:' || event_id)) AS r, count(*) OVER () AS n FROM events) WHERE r > round(n * 0.3::DOUBLE)
""")
def complement_query(spark, folder):
    events = table(spark, folder, "events", "event_id")
    drawn = sp.sample_exact(events, "event_id", 0.3, 4, "drawn").where("drawn")
    return sp.complement(events, drawn, ["event_id"])


@query("entity_union", """
  SELECT l_partkey AS entity FROM lineitem UNION SELECT p_partkey FROM part
""")
def entity_union_query(spark, folder):
    lineitem = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "entity")
    part = table(spark, folder, "part").withColumnRenamed("p_partkey", "entity")
    return sp.entity_union([lineitem.where("l_linenumber % 2 = 1"), lineitem.where("l_linenumber % 2 = 0"), part], "entity")


@query("class_balance_weights", """
  SELECT doc_id, round(1.0 / count(*) OVER (PARTITION BY lang) * CASE lang WHEN 'en' THEN 2.0 WHEN 'es' THEN 0.5 ELSE 1.0 END, 10)::DOUBLE AS weight FROM documents
""")
def class_balance_weights_query(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "lang")
    return sp.class_balance_weights(docs, "lang", {"en": 2.0, "es": 0.5}).select("doc_id", F.round("weight", 10).alias("weight"))


@query("interaction_weights", """
  WITH k AS (SELECT p_partkey, p_brand || '_' || (p_size % 3) AS target_activity, p_brand || '_' || (p_size % 3) || '_' || p_type AS joint_space FROM part),
  n AS (SELECT target_activity, count(DISTINCT joint_space) AS n_scaffolds FROM k GROUP BY 1),
  c AS (SELECT joint_space, count(*) AS joint_space_count FROM k GROUP BY 1)
  SELECT p_partkey, target_activity, joint_space, joint_space_count, n_scaffolds, round(sqrt(n_scaffolds), 6) AS target_activity_weight,
         round(sqrt(n_scaffolds) / (n_scaffolds * joint_space_count), 8) AS pretrain_sampling_weight
  FROM k JOIN n USING (target_activity) JOIN c USING (joint_space)
""")
def interaction_weights_query(spark, folder):
    part = table(spark, folder, "part").withColumn("activity", F.col("p_size") % 3)
    out = sp.interaction_weights(part, "p_brand", "activity", "p_type")
    return out.select(
        "p_partkey", "target_activity", "joint_space", "joint_space_count", "n_scaffolds",
        F.round("target_activity_weight", 6).alias("target_activity_weight"),
        F.round("pretrain_sampling_weight", 8).alias("pretrain_sampling_weight"))


@query("weighted_sample", f"""
  WITH r AS (SELECT {line_key()} AS line_key, CAST(round(l_extendedprice * 100) AS BIGINT) AS w FROM lineitem),
  c AS (SELECT line_key, w, CAST(sum(w) OVER (ORDER BY md5('5:' || line_key)) - w AS BIGINT) AS lo FROM r WHERE w > 0),
  t AS (SELECT sum(w)::DOUBLE AS total, count(*) AS n FROM r),
  p AS (SELECT j AS draw, CAST(floor(('0x' || substr(md5('5:point:' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * total) AS BIGINT) AS x
        FROM t, range(0, (SELECT count(*) FROM lineitem)) d(j))
  SELECT draw, line_key FROM p ASOF JOIN c ON p.x >= c.lo
""")
def weighted_sample_query(spark, folder):
    rows = lines(spark, folder).select("line_key", F.round(F.col("l_extendedprice") * 100).cast("long").alias("w"))
    return sp.weighted_sample(rows, "line_key", "w", 5)


@query("weighted_sample_float", """
  WITH r AS (SELECT doc_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS w FROM documents),
  k AS (SELECT pow(2, floor(52 - log2(sum(w)))) AS scale FROM r),
  u AS (SELECT doc_id, greatest(1, CAST(floor(w * scale) AS BIGINT)) AS w FROM r, k),
  c AS (SELECT doc_id, CAST(sum(w) OVER (ORDER BY md5('6:' || doc_id)) - w AS BIGINT) AS lo FROM u),
  t AS (SELECT sum(w)::DOUBLE AS total FROM u),
  p AS (SELECT j AS draw, CAST(floor(('0x' || substr(md5('6:point:' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * total) AS BIGINT) AS x
        FROM t, range(0, (SELECT count(*) FROM documents)) d(j))
  SELECT draw, doc_id FROM p ASOF JOIN c ON p.x >= c.lo
""")
def weighted_sample_float_query(spark, folder):
    """Weights below one, as the class weights are, drawn in proportion."""
    docs = sp.class_balance_weights(table(spark, folder, "documents", "doc_id", "lang"), "lang")
    return sp.weighted_sample(docs, "doc_id", "weight", 6)


UNIFORM_SQL = "('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
EDGE_U = UNIFORM_SQL.format(key="'2:' || concat_ws(':', g, src, dst)")


@query("drop_edges", f"""
  WITH {ORDER_NODES_SQL}
  SELECT 'directed' AS kind, g, src, dst, weight FROM edges WHERE {EDGE_U} >= 0.4
  UNION ALL SELECT 'undirected', g, src, dst, weight FROM edges WHERE src <= dst AND {EDGE_U} >= 0.4
  UNION ALL SELECT 'undirected', g, dst, src, weight FROM edges WHERE src < dst AND {EDGE_U} >= 0.4
""")
def drop_edges_query(spark, folder):
    _, edges = order_graphs(spark, folder)
    directed = gr.drop_edges(edges, 0.4, 2).withColumn("kind", F.lit("directed"))
    return directed.unionByName(gr.drop_edges(edges, 0.4, 2, undirected=True).withColumn("kind", F.lit("undirected")))


@query("drop_nodes", f"""
  WITH {ORDER_NODES_SQL},
  u AS (SELECT g, node, {UNIFORM_SQL.format(key="'2:' || concat_ws(':', g, node)")} AS u FROM nodes),
  k AS (SELECT g, node FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY u DESC, node DESC) AS rn FROM u) WHERE u > 0.6 OR rn = 1),
  e AS (SELECT edges.g, count(*) AS edges FROM edges JOIN k a ON edges.g = a.g AND src = a.node JOIN k b ON edges.g = b.g AND dst = b.node GROUP BY 1),
  n AS (SELECT g, count(*) AS nodes, CAST(sum(node) AS BIGINT) AS node_sum FROM k GROUP BY 1)
  SELECT g, nodes, node_sum, coalesce(edges, 0) AS edges FROM n LEFT JOIN e USING (g)
""")
def drop_nodes_query(spark, folder):
    nodes, edges = order_graphs(spark, folder)
    kept, inside = gr.drop_nodes(nodes.select("g", "node"), edges, 0.6, 2)
    counted = kept.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), F.sum("node").alias("node_sum"))
    joined = counted.join(inside.groupBy("g").agg(F.count(F.lit(1)).alias("edges")), "g", "left")
    return joined.select("g", "nodes", "node_sum", F.coalesce("edges", F.lit(0)).alias("edges"))
