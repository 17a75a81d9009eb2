"""Queries for graph construction, degrees, aggregation, pooling and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import components as cp
from ..operators import graph as gr
from ..session import stored
from .registry import query, table
from .views import CENTROID_SQL, EMBEDDING_WIDTH, ORDER_NODES_SQL, centroids, ligand_vectors, order_graphs

# Contacts between neighbouring vectors of one class: place i of a class with its 12 next.
CONTACT_SQL = """
  v AS (SELECT label AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS e FROM embeddings),
  contacts AS (SELECT a.g, a.i, b.i AS j, round(list_cosine_similarity(a.e, b.e), 6) AS prob FROM v a JOIN v b ON a.g = b.g AND b.i BETWEEN a.i + 1 AND a.i + 12),
  lengths AS (SELECT g, count(*) AS n FROM v GROUP BY g)
"""


def _contacts(spark, folder):
    """Contact probabilities inside a class, by cosine; each vector meets its 12 successors."""
    from ..operators.ordering import global_row_number

    placed = global_row_number(table(spark, folder, "embeddings"), ["vec_id"], "rn", ["label"])
    v = placed.select(F.col("label").alias("g"), (F.col("rn") - 1).alias("i"), F.col("embedding").alias("e"))
    ahead = v.select("g", F.col("e").alias("ea"), "i", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("d"))
    ahead = ahead.select("g", "ea", F.col("i").alias("a"), (F.col("i") + F.col("d")).alias("i"))
    pairs = ahead.join(v, ["g", "i"])
    contacts = pairs.select("g", F.col("a").alias("i"), F.col("i").alias("j"), F.round(cosine(F.col("ea"), F.col("e")), 6).alias("prob"))
    return contacts, v.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("contact_graph", f"""
  WITH {CONTACT_SQL},
  near AS (SELECT g, i, i + d AS j FROM (SELECT g, n, unnest(range(0, n)) AS i FROM lengths), (VALUES (1), (2)) t(d) WHERE i + d < n),
  one AS (SELECT g, i, j, prob AS w FROM contacts WHERE prob >= 0.5 UNION ALL SELECT g, i, j, 0.5 FROM near),
  sides AS (SELECT g, i, j, w FROM one UNION ALL SELECT g, j, i, w FROM one)
  SELECT g, i AS src, j AS dst, max(w)::DOUBLE AS weight FROM sides GROUP BY ALL
  UNION ALL SELECT g, i, i, 1.0 FROM v
""")
def contact_graph_query(spark, folder):
    contacts, lengths = _contacts(spark, folder)
    return gr.contact_graph(contacts, lengths)


@query("edge_primitives", f"""
  WITH raw AS (SELECT l_suppkey AS g, l_linenumber AS src, CAST(l_quantity AS INTEGER) % 8 AS dst, l_discount AS weight FROM lineitem),
  c AS (SELECT g, src, dst, max(weight) AS weight FROM raw GROUP BY ALL),
  u AS (SELECT g, src, dst, max(weight) AS weight FROM (SELECT * FROM c UNION ALL SELECT g, dst, src, weight FROM c) GROUP BY ALL)
  SELECT 'coalesced' AS step, * FROM c UNION ALL SELECT 'undirected', * FROM u UNION ALL SELECT 'no loops', * FROM u WHERE src <> dst
  UNION ALL SELECT 'loops', * FROM u WHERE src <> dst UNION ALL SELECT DISTINCT 'loops', g, src, src, 1.0 FROM raw
""")
def edge_primitives(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("src"), (F.col("l_quantity").cast("int") % 8).alias("dst"), F.col("l_discount").alias("weight"))
    c = gr.coalesce_edges(raw)
    u = gr.to_undirected(c)
    bare = gr.remove_self_loops(u)
    looped = gr.add_self_loops(bare, raw.select("g", F.col("src").alias("node")).distinct())
    steps = {"coalesced": c, "undirected": u, "no loops": bare, "loops": looped}
    out = None
    for name, df in steps.items():
        part = df.select(F.lit(name).alias("step"), "g", "src", "dst", "weight")
        out = part if out is None else out.unionByName(part)
    return out


@query("self_loop_weights", """
  WITH n AS (SELECT DISTINCT l_suppkey AS g, l_linenumber AS node FROM lineitem),
  l AS (SELECT l_suppkey AS g, l_linenumber AS node, max(l_discount) AS weight FROM lineitem WHERE l_linenumber = CAST(l_quantity AS INTEGER) % 9 GROUP BY 1, 2)
  SELECT g, node, coalesce(weight, 0.0) AS weight FROM n LEFT JOIN l USING (g, node)
""")
def self_loop_weights_query(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("src"), (F.col("l_quantity").cast("int") % 9).alias("dst"), F.col("l_discount").alias("weight"))
    return gr.self_loop_weights(gr.coalesce_edges(raw), raw.select("g", F.col("src").alias("node")).distinct())


@query("adjacency_to_edges", """
  SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS src, CAST(dst AS INTEGER) AS dst,
         [l_linenumber % 3, l_partkey % 2, l_suppkey % 4][dst + 1]::DOUBLE AS weight
  FROM lineitem, (VALUES (0), (1), (2)) t(dst) WHERE FALSE
  UNION ALL SELECT * FROM (
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS src FROM lineitem)
    SELECT l_orderkey, src, CAST(dst AS INTEGER), [l_linenumber % 3, l_partkey % 2, l_suppkey % 4][dst + 1]::DOUBLE AS weight
    FROM r, (VALUES (0), (1), (2)) t(dst) WHERE [l_linenumber % 3, l_partkey % 2, l_suppkey % 4][dst + 1] <> 0)
""")
def adjacency_to_edges_query(spark, folder):
    """Lines of an order as the rows of a dense three-column matrix."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("g"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.array((F.col("l_linenumber") % 3).cast("long"), F.col("l_partkey") % 2, F.col("l_suppkey") % 4).alias("row"))
    listed = lines.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "row"))).alias("l"))
    dense = listed.select("g", F.transform("l", lambda r: r["row"]).alias("rows"))
    return gr.adjacency_to_edges(dense).withColumn("src", F.col("src").cast("long"))


DEGREE_SQL = """
  d AS (SELECT n.g, n.node, count(e.src) AS degree FROM nodes n LEFT JOIN edges e ON n.g = e.g AND n.node = e.dst GROUP BY 1, 2)
"""


@query("degree_histogram", f"""
  WITH {ORDER_NODES_SQL}, {DEGREE_SQL}
  SELECT degree, coalesce(cnt, 0) AS cnt FROM (SELECT unnest(range(0, (SELECT max(degree) + 1 FROM d))) AS degree) LEFT JOIN (SELECT degree, count(*) AS cnt FROM d GROUP BY 1) USING (degree)
""")
def degree_histogram_query(spark, folder):
    nodes, edges = order_graphs(spark, folder)
    return gr.degree_histogram(gr.in_degrees(edges, nodes))


@query("degree_histogram_weighted", f"""
  WITH {ORDER_NODES_SQL}, {DEGREE_SQL}, t AS (SELECT o_orderkey AS g, 1 + o_custkey % 5 AS times FROM orders)
  SELECT degree, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM (SELECT unnest(range(0, (SELECT max(degree) + 1 FROM d JOIN t USING (g)))) AS degree)
  LEFT JOIN (SELECT degree, sum(times) AS cnt FROM d JOIN t USING (g) GROUP BY 1) USING (degree)
""")
def degree_histogram_weighted(spark, folder):
    """A graph counted once per pair that uses it."""
    nodes, edges = order_graphs(spark, folder)
    times = table(spark, folder, "orders").select(F.col("o_orderkey").alias("g"), (F.lit(1) + F.col("o_custkey") % 5).alias("times"))
    return gr.degree_histogram(gr.in_degrees(edges, nodes), times)


AVG_SQL = "avgs AS (SELECT avg(degree) AS lin, avg(ln(degree + 1)) AS log, avg(exp(degree)) AS exp FROM d)"


@query("average_degree", f"WITH {ORDER_NODES_SQL}, {DEGREE_SQL}, {AVG_SQL} SELECT round(lin, 6) AS lin, round(log, 6) AS log, round(exp, 4) AS exp FROM avgs")
def average_degree_query(spark, folder):
    nodes, edges = order_graphs(spark, folder)
    avgs = gr.average_degree(gr.degree_histogram(gr.in_degrees(edges, nodes)))
    return avgs.select(F.round("lin", 6).alias("lin"), F.round("log", 6).alias("log"), F.round("exp", 4).alias("exp"))


SCALE_SQL = {"identity": "1", "amplification": "ln(deg + 1) / log", "attenuation": "log / ln(deg + 1)", "linear": "deg / lin", "inverse_linear": "lin / deg"}


@query("neighbor_aggregate", f"""
  WITH m AS (SELECT l_partkey AS dst, sqrt(l_extendedprice) AS v FROM lineitem),
  a AS (SELECT dst, count(*) AS deg, avg(v) AS mean, min(v) AS min, max(v) AS max, stddev_pop(v) AS std FROM m GROUP BY dst),
  d AS (SELECT count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey), {AVG_SQL}
  SELECT dst, {", ".join(f"round({a} * ({f}), 4) AS {s}_{a}" for s, f in SCALE_SQL.items() for a in ("mean", "min", "max", "std"))} FROM a, avgs
""")
def neighbor_aggregate_query(spark, folder):
    lineitem = table(spark, folder, "lineitem", "l_partkey", "l_extendedprice")
    messages = lineitem.select(F.col("l_partkey").alias("dst"), F.sqrt("l_extendedprice").alias("value"))
    nodes = table(spark, folder, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("node"))
    edges = lineitem.select(F.lit(0).alias("g"), F.lit(0).alias("src"), F.col("l_partkey").alias("dst"))
    averages = gr.average_degree(gr.degree_histogram(gr.in_degrees(edges, nodes)))
    out = gr.neighbor_aggregate(messages, averages, ["mean", "min", "max", "std"], list(SCALE_SQL), ["dst"])
    return out.select("dst", *[F.round(c, 4).alias(c) for c in out.columns if c not in ("dst", "degree")])


@query("scatter_mean", """
  WITH m AS (SELECT DISTINCT p_brand AS g, p_partkey AS atom, p_size % 5 AS clique FROM part), v AS (SELECT p_brand AS g, p_partkey AS atom, p_retailprice AS x FROM part WHERE p_size % 3 = 0),
  t AS (SELECT DISTINCT p_brand AS g, c AS clique FROM part, range(0, 6) r(c)), a AS (SELECT m.g, clique, avg(x) AS x FROM m JOIN v USING (g, atom) GROUP BY 1, 2)
  SELECT g, clique, round(coalesce(x, 0), 4) AS value FROM t LEFT JOIN a USING (g, clique)
""")
def scatter_mean_query(spark, folder):
    part = table(spark, folder, "part").withColumnsRenamed({"p_brand": "g", "p_partkey": "atom"})
    members = part.select("g", "atom", (F.col("p_size") % 5).cast("long").alias("clique"))
    values = part.where("p_size % 3 = 0").select("g", "atom", F.col("p_retailprice").alias("value"))
    targets = part.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("clique"))
    return gr.scatter_mean(members, values, targets, "atom", "clique").withColumn("value", F.round("value", 4))


@query("segment_softmax", """
  WITH s AS (SELECT event_id, user_id, exp((value - max(value) OVER (PARTITION BY user_id)) / 50) AS e FROM events)
  SELECT event_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS weight FROM s
""")
def segment_softmax_query(spark, folder):
    scaled = table(spark, folder, "events").select("event_id", "user_id", (F.col("value") / 50).alias("x"))
    return gr.segment_softmax(scaled, ["user_id"], "x", "w").select("event_id", F.round("w", 6).alias("weight"))


@query("attention_pool", """
  WITH p AS (SELECT label, vec_id % 7 + 1 AS w, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT label, CAST(i - 1 AS INTEGER) AS place, round(sum(v * w), 5) + 0.0 AS weighted, round(sum(v), 5) + 0.0 AS added, round(avg(v), 6) + 0.0 AS mean FROM p GROUP BY 1, 2
""")
def attention_pool_query(spark, folder):
    vectors = table(spark, folder, "embeddings")
    weighted = gr.pool_vectors(vectors, ["label"], "embedding", EMBEDDING_WIDTH, F.col("vec_id") % 7 + 1, out="weighted")
    added = gr.pool_vectors(vectors, ["label"], "embedding", EMBEDDING_WIDTH, out="added")
    mean = gr.pool_vectors(vectors, ["label"], "embedding", EMBEDDING_WIDTH, mean=True, out="mean")
    joined = weighted.join(added, "label").join(mean, "label")
    long = joined.select("label", F.posexplode(F.arrays_zip("weighted", "added", "mean")).alias("place", "z"))
    return long.select("label", "place", (F.round("z.weighted", 5) + F.lit(0.0)).alias("weighted"), (F.round("z.added", 5) + F.lit(0.0)).alias("added"),
                       (F.round("z.mean", 6) + F.lit(0.0)).alias("mean"))


@query("group_norm", """
  WITH m AS (SELECT user_id, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1)
  SELECT event_id, round((value - m) / sqrt(v + 1e-5), 5) + 0.0 AS z FROM events JOIN m USING (user_id)
""")
def group_norm_query(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    return gr.group_norm(events, ["user_id"], "value", "z").select("event_id", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query("group_attention", f"""
  WITH {CENTROID_SQL},
  s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], protein_vec) / 8 AS s FROM embeddings JOIN centroids ON protein_id = label),
  w AS (SELECT vec_id, label, e, exp(s) / sum(exp(s)) OVER (PARTITION BY label) AS a FROM s),
  p AS (SELECT label, a, generate_subscripts(e, 1) AS i, unnest(e) AS v FROM w),
  o AS (SELECT label, i, sum(a * v) AS v FROM p GROUP BY 1, 2), t AS (SELECT label, round(sum(v), 6) + 0.0 AS total FROM o GROUP BY 1)
  SELECT vec_id, label, round(a, 6) AS attention, total FROM w JOIN t USING (label)
""")
def group_attention_query(spark, folder):
    queries = centroids(spark, folder).select(F.col("protein_id").alias("label"), F.col("protein_vec").alias("query"))
    keys = ligand_vectors(spark, folder).select("smiles", "label", F.col("ligand_vec").alias("key"), F.col("ligand_vec").alias("value"))
    weighted, pooled = gr.group_attention(queries, keys, ["label"], EMBEDDING_WIDTH)
    total = pooled.select("label", (F.round(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)).alias("total"))
    return weighted.join(total, "label").select(F.col("smiles").alias("vec_id"), "label", F.round("attention", 6).alias("attention"), "total")


@query("propagate", """
  WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem),
  pairs AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e),
  n AS (SELECT DISTINCT src AS node, CAST(src % 10 AS DOUBLE) AS value FROM pairs),
  l AS (SELECT * FROM pairs UNION ALL SELECT node, node FROM n), d AS (SELECT dst AS node, count(*) AS d FROM l GROUP BY 1),
  w AS (SELECT src, dst, 1 / sqrt(a.d::DOUBLE * b.d) AS w FROM l JOIN d a ON a.node = src JOIN d b ON b.node = dst),
  h1 AS (SELECT dst AS node, sum(w * value) AS value FROM w JOIN n ON n.node = src GROUP BY 1), h2 AS (SELECT dst AS node, sum(w * value) AS value FROM w JOIN h1 ON h1.node = src GROUP BY 1),
  a1 AS (SELECT dst AS node, 0.9 * sum(w * n.value) + 0.1 * any_value(z.value) AS value FROM w JOIN n ON n.node = src JOIN n z ON z.node = dst GROUP BY 1),
  a2 AS (SELECT dst AS node, 0.9 * sum(w * a1.value) + 0.1 * any_value(z.value) AS value FROM w JOIN a1 ON a1.node = src JOIN n z ON z.node = dst GROUP BY 1)
  SELECT node, round(h2.value, 6) AS plain, round(a2.value, 6) AS mixed FROM h2 JOIN a2 USING (node)
""")
def propagate_query(spark, folder):
    e = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct()
    edges = gr.mirrored(e.withColumn("g", F.lit(0))).select("src", "dst")
    start = edges.select(F.col("src").alias("node")).distinct().withColumn("value", (F.col("node") % 10).cast("double"))
    plain = gr.propagate(edges, start, 2).select("node", F.round("value", 6).alias("plain"))
    mixed = gr.propagate(edges, start, 2, 0.1).select("node", F.round("value", 6).alias("mixed"))
    return plain.join(mixed, "node")


@query("isolated_share", f"""
  WITH {ORDER_NODES_SQL}, t AS (SELECT DISTINCT g, src AS node FROM edges WHERE src <> dst)
  SELECT g, round(count(*) FILTER (t.node IS NULL) / count(*), 6) AS isolated_share FROM nodes LEFT JOIN t USING (g, node) GROUP BY g
""")
def isolated_share_query(spark, folder):
    nodes, edges = order_graphs(spark, folder)
    return gr.isolated_share(edges, nodes.select("g", "node")).withColumn("isolated_share", F.round("isolated_share", 6))


# --- soft clusters ---------------------------------------------------------------------

# Three clusters per node, scores from the part number.
SOFT_SQL = f"""
  {ORDER_NODES_SQL},
  raw AS (SELECT g, node, CAST(k AS BIGINT) AS k, exp(((l_partkey * (k + 1)) % 11) / 4.0) AS e FROM nodes, range(0, 3) t(k)),
  s AS (SELECT g, node, k, e / sum(e) OVER (PARTITION BY g, node) AS s FROM raw),
  sas AS (SELECT a.g, a.k AS k1, b.k AS k2, sum(a.s * weight * b.s) AS a FROM s a JOIN edges ON a.g = edges.g AND a.node = src JOIN s b ON b.g = edges.g AND b.node = dst GROUP BY ALL),
  ss AS (SELECT a.g, a.k AS k1, b.k AS k2, sum(a.s * b.s) AS ss FROM s a JOIN s b ON a.g = b.g AND a.node = b.node GROUP BY ALL),
  deg AS (SELECT g, dst AS node, sum(weight) AS d FROM edges GROUP BY 1, 2)
"""


def _soft(spark, folder):
    """Nodes, edges and listed assignments, all lying by order from one shuffle of the lines."""
    nodes, edges = order_graphs(spark, folder, placed=True)
    score = lambda k: F.struct(k.alias("k"), (((F.col("l_partkey") * (k + 1)) % 11) / 4).alias("s"))
    scores = nodes.select("g", "node", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), score).alias("v"))
    return nodes, edges, gr.soft_assignments(scores)


@query("soft_cluster_features", f"""
  WITH {SOFT_SQL} SELECT s.g, k, round(sum(s * x), 5) AS value FROM s JOIN nodes ON s.g = nodes.g AND s.node = nodes.node GROUP BY 1, 2
""")
def soft_cluster_features(spark, folder):
    nodes, _, assigned = _soft(spark, folder)
    features = nodes.select("g", "node", F.lit(0).alias("f"), "x")
    return gr.cluster_features(assigned, features).select("g", "k", F.round("value", 5).alias("value"))


@query("soft_cluster_pool", f"""
  WITH {SOFT_SQL}, o AS (SELECT g, k1, k2, CASE WHEN k1 = k2 THEN 0.0 ELSE a END AS a FROM sas), d AS (SELECT g, k1 AS k, sqrt(sum(a)) + 1e-15 AS d FROM o GROUP BY 1, 2)
  SELECT o.g, k1, k2, round(a / x.d / y.d, 5)::DOUBLE AS a FROM o JOIN d x ON x.g = o.g AND x.k = k1 JOIN d y ON y.g = o.g AND y.k = k2
""")
def soft_cluster_pool(spark, folder):
    _, edges, assigned = _soft(spark, folder)
    pooled = gr.normalized_adjacency(gr.cluster_adjacency(assigned, edges, placed=True))
    return pooled.select("g", "k1", "k2", F.round("a", 5).alias("a"))


@query("cluster_losses", f"""
  WITH {SOFT_SQL},
  mc AS (SELECT g, sum(a) AS tr FROM sas WHERE k1 = k2 GROUP BY 1),
  dn AS (SELECT s.g, sum(d * s * s) AS den FROM s JOIN deg ON s.g = deg.g AND s.node = deg.node GROUP BY 1),
  fro AS (SELECT g, sqrt(sum(ss * ss)) AS f FROM ss GROUP BY 1),
  orth AS (SELECT ss.g, sqrt(sum(power(ss / f - CASE WHEN k1 = k2 THEN 1 / sqrt(3) ELSE 0 END, 2))) AS o FROM ss JOIN fro USING (g) GROUP BY 1),
  m AS (SELECT g, sum(d) AS m FROM deg GROUP BY 1), ca AS (SELECT s.g, k, sum(d * s) AS c FROM s JOIN deg ON s.g = deg.g AND s.node = deg.node GROUP BY 1, 2),
  cc AS (SELECT g, sum(c * c) AS cc FROM ca GROUP BY 1), n AS (SELECT g, count(*) AS n FROM nodes GROUP BY 1),
  rs AS (SELECT g, sqrt(sum(r * r)) AS r FROM (SELECT g, k1, sum(ss) AS r FROM ss GROUP BY 1, 2) GROUP BY 1),
  bl AS (SELECT g, sum(sqrt(ss + 1e-15)) AS t FROM ss WHERE k1 = k2 GROUP BY 1)
  SELECT n.g, round(-tr / den, 5) AS mincut_loss, round(o, 5) AS ortho_loss, round(-(tr - cc / 2 / m) / 2 / m, 5) AS modularity_loss,
         round(r / n * sqrt(3) - 1, 5) + 0.0 AS cluster_size_loss, round(-t / sqrt(n * 3), 5) AS balance_loss
  FROM n JOIN mc USING (g) JOIN dn USING (g) JOIN orth USING (g) JOIN m USING (g) JOIN cc USING (g) JOIN rs USING (g) JOIN bl USING (g)
""")
def cluster_losses(spark, folder):
    nodes, edges, assigned = _soft(spark, folder)
    gram = gr.cluster_gram(assigned)
    # One row per order each: the losses take their sums over edges and cells from them.
    linked, cells = stored(spark, gr.edge_sums(assigned, edges, placed=True)), stored(spark, gr.gram_sums(gram))
    out = gr.mincut_loss(assigned, edges, linked)
    for part in (gr.ortho_loss(gram, cells), gr.modularity_loss(assigned, edges, linked), gr.cluster_size_loss(gram, nodes, cells), gr.balance_loss(gram, nodes, cells)):
        out = out.join(part, "g")
    return out.select("g", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in out.columns if c != "g"])


# --- components ------------------------------------------------------------------------

COMPONENT_SQL = """
  reach(g, node, seen) AS (SELECT g, node, node FROM nodes UNION SELECT e.g, r.node, e.dst FROM reach r JOIN edges e ON e.g = r.g AND e.src = r.seen),
  lab AS (SELECT g, node, min(seen) AS label FROM reach GROUP BY 1, 2)
"""


@query("component_labels", f"WITH RECURSIVE {ORDER_NODES_SQL}, {COMPONENT_SQL} SELECT g, node, label FROM lab")
def component_labels_query(spark, folder):
    nodes, edges = order_graphs(spark, folder)
    return cp.component_labels(edges, nodes)


@query("component_labels_global", """
  WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem),
  edges AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e), nodes AS (SELECT DISTINCT src AS node FROM edges),
  hop(node, label, i) AS (SELECT node, node, 0 FROM nodes UNION ALL SELECT node, min(label), any_value(i) + 1 FROM (
      SELECT node, label, i FROM hop UNION ALL SELECT dst, label, i FROM hop JOIN edges ON src = node) WHERE i < 12 GROUP BY node)
  SELECT node, label FROM hop WHERE i = 12
""")
def component_labels_global(spark, folder):
    """One large graph of suppliers and parts."""
    e = table(spark, folder, "lineitem").select(
        F.lit(0).alias("g"), F.col("l_suppkey").alias("src"), (F.lit(1000000) + F.col("l_partkey")).alias("dst")).distinct()
    e = stored(spark, e)
    nodes = e.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return cp.component_labels(e, nodes).select("node", "label")


@query("largest_component_share", f"""
  WITH RECURSIVE {ORDER_NODES_SQL}, {COMPONENT_SQL}, c AS (SELECT g, label, count(*) AS c FROM lab GROUP BY 1, 2)
  SELECT g, round(max(c) / sum(c), 6)::DOUBLE AS largest_share FROM c GROUP BY g
""")
def largest_component_share_query(spark, folder):
    nodes, edges = order_graphs(spark, folder)
    return cp.largest_component_share(edges, nodes).withColumn("largest_share", F.round("largest_share", 6))


@query("max_overlap_tree", f"""
  WITH RECURSIVE {ORDER_NODES_SQL}, {COMPONENT_SQL}, n AS (SELECT g, count(*) AS nodes, count(DISTINCT label) AS parts FROM lab GROUP BY 1)
  SELECT g, CAST(2 * (nodes - parts) AS BIGINT) AS edges FROM n WHERE nodes > parts
""")
def max_overlap_tree_query(spark, folder):
    """Edge count of the spanning forest; the weight is checked against brute force in the tests."""
    nodes, edges = order_graphs(spark, folder)
    return cp.max_overlap_tree(edges, nodes).groupBy("g").agg(F.count(F.lit(1)).alias("edges"))


MEMBER_SQL = """
  members AS (SELECT DISTINCT l_orderkey AS g, l_suppkey % 6 AS clique, l_partkey % 9 AS atom FROM lineitem),
  rings AS (SELECT * FROM members JOIN (SELECT g, clique FROM members GROUP BY 1, 2 HAVING count(*) > 2) USING (g, clique)),
  bridged AS (SELECT a.g, a.clique AS one, b.clique AS other FROM rings a JOIN rings b ON a.g = b.g AND a.atom = b.atom AND a.clique <> b.clique
              GROUP BY 1, 2, 3 HAVING count(*) > 2),
  united(g, clique, seen) AS (SELECT DISTINCT g, clique, clique FROM members
                              UNION SELECT u.g, u.clique, other FROM united u JOIN bridged b ON b.g = u.g AND b.one = u.seen),
  named AS (SELECT g, clique, min(seen) AS name FROM united GROUP BY 1, 2),
  kept AS (SELECT DISTINCT g, name AS clique, atom FROM members JOIN named USING (g, clique)),
  size AS (SELECT g, clique, count(*) AS n FROM kept GROUP BY 1, 2)
"""


@query("clique_overlap_graph", f"""
  WITH RECURSIVE {MEMBER_SQL},
  crowd AS (SELECT g, atom, count(*) AS cs, count(*) FILTER (n = 2) AS bonds, count(*) FILTER (n > 4) AS rings FROM kept JOIN size USING (g, clique) GROUP BY 1, 2),
  link AS (SELECT g, atom, cs, CASE WHEN cs <= 1 THEN NULL WHEN bonds > 2 OR (bonds = 2 AND cs > 2) THEN 1 WHEN rings > 2 THEN 99 END AS link FROM crowd),
  touch AS (SELECT DISTINCT a.g, a.clique AS src, b.clique AS dst FROM kept a JOIN kept b ON a.g = b.g AND a.atom = b.atom AND a.clique < b.clique
            JOIN link l ON l.g = a.g AND l.atom = a.atom WHERE l.cs > 1 AND l.link IS NULL),
  ov AS (SELECT a.g, a.clique AS src, b.clique AS dst, count(*) AS weight FROM kept a JOIN kept b ON a.g = b.g AND a.atom = b.atom AND a.clique < b.clique GROUP BY 1, 2, 3)
  SELECT g, src, dst, least(weight, 99) AS weight FROM touch JOIN ov USING (g, src, dst)
  UNION ALL SELECT k.g, k.clique, -1, CAST(link AS BIGINT) FROM kept k JOIN link l ON l.g = k.g AND l.atom = k.atom WHERE link IS NOT NULL
""")
def clique_overlap_graph_query(spark, folder):
    """Parts of an order as cliques by supplier; those sharing more than two atoms unite, in the twin too."""
    members = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("g"), (F.col("l_suppkey") % 6).alias("clique"), (F.col("l_partkey") % 9).alias("atom")).distinct()
    members = members.withColumn("kind", F.lit(0))
    atoms = members.select("g", "atom").distinct()
    cliques, _, links = cp.clique_overlap_graph(members, atoms)
    # Singleton cliques have numbers of their own; the twin shows them as -1.
    single = cliques.where("kind = 3").select("g", F.col("clique").alias("dst"), F.lit(True).alias("single"))
    marked = links.join(single, ["g", "dst"], "left")
    return marked.select("g", "src", F.when(F.col("single"), F.lit(-1)).otherwise(F.col("dst")).cast("long").alias("dst"), "weight")
