"""Queries for joins, scoring, ranking, batching and explanation tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.table_functions import register_table_functions
from ..operators import screening as sc
from ..operators import structure as st
from ..operators import windows as win
from ..operators.featurize import canonicalize, featurize
from ..operators.graph import connect_graphs
from ..session import fresh_dir
from .jobs import PairScoring, evaluate_folder, score_pair_list
from .registry import CUT, ORACLES, query, table
from .views import (CENTROID_SQL, SCREEN_SQL, SEQ_SQL, centroids, ligand_vectors, line_key, lines,
                    sequences)


def _scored(spark, folder):
    ligands = ligand_vectors(spark, folder).select("smiles", "ligand_vec")
    matrix = sc.screen_matrix(ligands, centroids(spark, folder), "smiles", "protein_id")
    return sc.score_dot(matrix, "ligand_vec", "protein_vec").select("protein_id", "smiles", "prediction")


TOP_FIVE_SQL = f"""
  WITH {SCREEN_SQL},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY prediction DESC, smiles) AS rank FROM scored)
  SELECT protein_id, smiles, round(prediction, 4) AS prediction, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5
"""


@query("screen_top_k", TOP_FIVE_SQL)
def screen_top_k(spark, folder):
    """The flagship: size check, score block against block, keep the best per protein, rank."""
    proteins = centroids(spark, folder)
    ligands = ligand_vectors(spark, folder).select("smiles", "ligand_vec")
    sc.check_scale(proteins, ligands, top_k=5)
    best = sc.screen_blocks(ligands, proteins, "smiles", "protein_id", sc.block_dot("ligand_vec", "protein_vec"), 5)
    return win.rank_output(best, rounded=False)


@query("screen_top_k_rows", TOP_FIVE_SQL)
def screen_top_k_rows(spark, folder):
    """The same screen with a row per pair, as a scorer for single pairs needs it."""
    best = win.top_k(_scored(spark, folder), ["protein_id"], "prediction", 5, ["smiles"])
    return win.rank_output(best, rounded=False)


@query("screen_blocks", f"""
  WITH {SCREEN_SQL},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY prediction DESC, smiles) AS rank FROM scored)
  SELECT protein_id, smiles, round(prediction, 4) AS prediction, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20
""")
def screen_blocks_query(spark, folder):
    """The same screen by matrix blocks: pairs never become rows."""
    ligands = ligand_vectors(spark, folder).select("smiles", "ligand_vec")
    best = sc.screen_blocks(ligands, centroids(spark, folder), "smiles", "protein_id", sc.block_dot("ligand_vec", "protein_vec"), 20)
    return best.withColumn("prediction", F.round("prediction", 4))


@query("screen_vectors", """
  WITH s AS (SELECT a.vec_id AS protein_id, b.vec_id AS smiles, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS prediction
             FROM embeddings a, embeddings b),
  r AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY prediction DESC, smiles) AS rank FROM s)
  SELECT protein_id, smiles, round(prediction, 4) AS prediction, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def screen_vectors(spark, folder):
    """Every vector as a protein against every vector as a ligand."""
    ligands = ligand_vectors(spark, folder).select("smiles", "ligand_vec")
    proteins = ligands.select(F.col("smiles").alias("protein_id"), F.col("ligand_vec").alias("protein_vec"))
    best = sc.screen_blocks(ligands, proteins, "smiles", "protein_id", sc.block_dot("ligand_vec", "protein_vec"), 5)
    return best.withColumn("prediction", F.round("prediction", 4))


@query("screen_matrix", f"""
  WITH {SCREEN_SQL} SELECT protein_id, count(*) AS pairs, round(avg(prediction), 6) + 0.0 AS mean FROM scored GROUP BY protein_id
""")
def screen_matrix_query(spark, folder):
    return _scored(spark, folder).groupBy("protein_id").agg(
        F.count(F.lit(1)).alias("pairs"), (F.round(F.avg("prediction"), 6) + F.lit(0.0)).alias("mean"))


@query("screen_matrix_sliced", f"""
  WITH {SCREEN_SQL} SELECT protein_id, count(*) AS pairs, round(avg(prediction), 6) + 0.0 AS mean FROM scored GROUP BY protein_id
""")
def screen_matrix_sliced(spark, folder):
    """The way without a broadcast, forced by a small bound."""
    ligands = ligand_vectors(spark, folder).select("smiles", "ligand_vec")
    matrix = sc.screen_matrix(ligands, centroids(spark, folder), "smiles", "protein_id", broadcast_bytes=4096)
    scored = sc.score_dot(matrix, "ligand_vec", "protein_vec")
    return scored.groupBy("protein_id").agg(
        F.count(F.lit(1)).alias("pairs"), (F.round(F.avg("prediction"), 6) + F.lit(0.0)).alias("mean"))


@query("score_pairs", f"""
  WITH {SCREEN_SQL}
  SELECT protein_id, smiles, round(prediction, 4) + 0.0 AS prediction, round(1 / (1 + exp(-prediction)), 4) AS predicted_binary_interaction,
         round(exp(2 * prediction) / (1 + exp(prediction) + exp(2 * prediction)), 4) AS predicted_agonist,
         round(1 / (1 + exp(prediction) + exp(2 * prediction)), 4) AS predicted_antagonist,
         round(exp(prediction) / (1 + exp(prediction) + exp(2 * prediction)), 4) AS predicted_nonbinder
  FROM scored
""")
def score_pairs_query(spark, folder):
    """A batch model behind the scorer interface."""
    def make_scorer():
        def score(batch: pd.DataFrame) -> pd.DataFrame:
            left = np.stack(batch["ligand_vec"].to_numpy()).astype("float64")
            right = np.stack(batch["protein_vec"].to_numpy())
            dots = (left * right).sum(axis=1)
            logits = [np.array([0.0, d, 2 * d]) for d in dots]
            return pd.DataFrame({"regression": dots, "class_logit": dots, "class_logits": logits})
        return score

    heads = sc.Heads(regression=True, classification=True, multiclass=True)
    ligands = ligand_vectors(spark, folder).select("smiles", "ligand_vec")
    matrix = sc.screen_matrix(ligands, centroids(spark, folder), "smiles", "protein_id")
    scored = sc.score_pairs(matrix, make_scorer, ["ligand_vec", "protein_vec"], ["protein_id", "smiles"], heads)
    scored = sc.round_scores(scored, heads)
    return scored.withColumn("prediction", F.col("prediction") + F.lit(0.0))


@query("score_linear", f"""
  SELECT {line_key()} AS line_key, round(l_quantity * 0.5 + l_discount * -20 + l_tax * 3 + 1, 4) + 0.0 AS prediction FROM lineitem
""")
def score_linear_query(spark, folder):
    scored = sc.score_linear(lines(spark, folder), ["l_quantity", "l_discount", "l_tax"], [0.5, -20, 3], 1)
    return scored.select("line_key", (F.round("prediction", 4) + F.lit(0.0)).alias("prediction"))


@query("keep_scorable", """
  SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_suppkey
""")
def keep_scorable_query(spark, folder):
    features = table(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    kept = sc.keep_scorable(table(spark, folder, "lineitem", "l_partkey", "l_suppkey"), features, "l_partkey")
    return kept.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("hydrate_pairs", f"""
  SELECT {line_key()} AS line_key, p_size, p_type, s_acctbal FROM lineitem
  JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
""")
def hydrate_pairs_query(spark, folder):
    ligands = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type")
    proteins = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    pairs = lines(spark, folder).select("line_key", "l_partkey", "l_suppkey")
    return sc.hydrate_pairs(pairs, ligands, proteins, "l_partkey", "l_suppkey", strict=True).select("line_key", "p_size", "p_type", "s_acctbal")


@query("alias_join", """
  WITH a AS (SELECT p_partkey, lower(trim(p_name)) AS canonical FROM part),
  c AS (SELECT canonical, length(canonical) * 1.5 AS prediction FROM (SELECT DISTINCT canonical FROM a WHERE canonical <> ''))
  SELECT p_partkey, canonical, prediction::DOUBLE AS prediction FROM a JOIN c USING (canonical)
""")
def alias_join_query(spark, folder):
    parts = table(spark, folder, "part", "p_partkey", "p_name")
    aliases, _ = sc.alias_map(parts, F.nullif(F.lower(F.trim("p_name")), F.lit("")), "p_partkey")
    scores = aliases.select("canonical").distinct().withColumn("prediction", F.length("canonical") * 1.5)
    return sc.fan_out_aliases(scores, aliases).select("p_partkey", "canonical", "prediction")


@query("canonicalize", """
  SELECT CASE WHEN contains(lower(trim(s)), 'e') THEN lower(trim(s)) END AS canonical, count(*) AS n
  FROM (SELECT DISTINCT p_name || ' ' AS s FROM part) GROUP BY 1
""")
def canonicalize_query(spark, folder):
    """A Python callback on the distinct strings; a NULL form goes to the failure list."""
    def form(text):
        text = text.strip().lower()
        return text if "e" in text else None

    names = table(spark, folder, "part").select(F.concat("p_name", F.lit(" ")).alias("smiles"))
    good, failed = canonicalize(names, "smiles", form)
    both = good.select("canonical").unionByName(failed.select(F.lit(None).cast("string").alias("canonical")))
    return both.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query("featurize", """
  SELECT CASE WHEN length(text) % 5 = 0 THEN 'length divisible by five' END AS error, count(*) AS n,
         CAST(sum(CASE WHEN length(text) % 5 <> 0 THEN length(text) END) AS BIGINT) AS total
  FROM (SELECT DISTINCT text FROM conversations) GROUP BY 1
""")
def featurize_query(spark, folder):
    """A Python callback over distinct texts whose errors are kept as rows."""
    def measure(text):
        if len(text) % 5 == 0:
            raise ValueError("length divisible by five")
        return len(text)

    done = featurize(table(spark, folder, "conversations", "text"), "text", measure, "bigint")
    return done.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _pair_scoring(spark):
    """A small model on ids: suppliers as proteins, parts as ligands, every thirteenth part can't be featurized."""
    def protein_features(text):
        return [float(int(text[1:]) % 7), 1.0]

    def ligand_features(text):
        if int(text[1:]) % 13 == 0:
            raise ValueError("cannot featurize")
        return [float(int(text[1:]) % 11), 0.5]

    def make_scorer():
        def score(batch):
            dots = [float(np.dot(p, q)) for p, q in zip(batch["protein_feature"], batch["ligand_feature"])]
            return pd.DataFrame({"regression": dots})
        return score

    return PairScoring(fresh_dir(spark, "pair-cache"), protein_features, ligand_features, make_scorer)


PAIR_SCORE_SQL = "CASE WHEN l_partkey % 13 <> 0 THEN (l_suppkey % 7) * (l_partkey % 11) + 0.5 END::DOUBLE"


@query("score_pair_list", f"""
  SELECT 's' || l_suppkey AS Protein, 'p' || l_partkey AS Ligand, l_returnflag AS note, count(*) AS n, {PAIR_SCORE_SQL} AS prediction,
         CAST(count(DISTINCT row_number) AS BIGINT) AS ids
  FROM (SELECT *, row_number() OVER () AS row_number FROM lineitem) GROUP BY l_suppkey, l_partkey, l_returnflag
""")
def score_pair_list_query(spark, folder):
    """The pair-list job from a CSV to a CSV: all lines as pairs, ids generated, another column kept."""
    pairs, output = fresh_dir(spark, "pair-list"), fresh_dir(spark, "pair-scores")
    table(spark, folder, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("Protein"), F.concat(F.lit("p"), "l_partkey").alias("Ligand"),
        F.col("l_returnflag").alias("note")).write.option("header", True).csv(pairs)
    score_pair_list(spark, pairs, output, _pair_scoring(spark))
    rows = spark.read.option("header", True).csv(output)
    return rows.groupBy("Protein", "Ligand", "note").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("prediction").cast("double")).alias("prediction"), F.countDistinct("ID").alias("ids"))


@query("evaluate_folder", f"""
  WITH t AS (SELECT l_quantity AS y, {PAIR_SCORE_SQL} AS p FROM lineitem WHERE l_linenumber <= 2),
  e AS (SELECT avg(power(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, corr(y, p) AS pearson FROM t WHERE p IS NOT NULL)
  SELECT 'mse' AS metric, round(mse, 4) AS value FROM e UNION ALL SELECT 'mae', round(mae, 4) FROM e UNION ALL SELECT 'pearson', round(pearson, 4) FROM e
""")
def evaluate_folder_query(spark, folder):
    """The evaluation job over a data folder; the first two lines of every order are its test pairs."""
    data, output = fresh_dir(spark, "pair-data"), fresh_dir(spark, "pair-report")
    rows = table(spark, folder, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("Protein"), F.concat(F.lit("p"), "l_partkey").alias("Ligand"),
        F.col("l_quantity").alias("regression_label"), "l_linenumber")
    for name, rule in (("test", "l_linenumber <= 2"), ("train", "l_linenumber > 2")):
        rows.where(rule).drop("l_linenumber").write.option("header", True).csv(f"{data}/{name}.csv")
    report = evaluate_folder(spark, data, output, _pair_scoring(spark))
    return report.where("metric IN ('mse', 'mae', 'pearson')").select("metric", F.round("value", 4).alias("value"))


@query("attach_predictions", """
  WITH p AS (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS prediction FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)
  SELECT l_suppkey, count(*) AS n, count(prediction) AS matched, round(sum(prediction), 2) AS total
  FROM lineitem LEFT JOIN p USING (l_suppkey, l_partkey) GROUP BY l_suppkey
""")
def attach_predictions_query(spark, folder):
    pairs = table(spark, folder, "lineitem")
    predictions = pairs.where("l_quantity > 25").select("l_suppkey", "l_partkey", F.col("l_extendedprice").alias("prediction"))
    joined = sc.attach_predictions(pairs.select("l_suppkey", "l_partkey"), predictions, ["l_suppkey", "l_partkey"])
    return joined.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("prediction").alias("matched"), F.round(F.sum("prediction"), 2).alias("total"))


@query("coordinate_join", f"""
  WITH s AS (SELECT l_orderkey AS x, l_partkey AS y, l_suppkey AS z, max(l_discount) AS score FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL)
  SELECT {line_key()} AS line_key, coalesce(score, 0.0) AS score FROM lineitem
  LEFT JOIN s ON x = l_orderkey AND y = l_partkey AND z = l_suppkey
""")
def coordinate_join_query(spark, folder):
    coords = [F.col(c).cast("double").alias(n) for c, n in (("l_orderkey", "x"), ("l_partkey", "y"), ("l_suppkey", "z"))]
    # Lines numbered 1 and 2 act as hydrogens.
    symbol = F.when(F.col("l_linenumber") <= 2, "H").otherwise("C").alias("symbol")
    atoms = lines(spark, folder).select("line_key", *coords, symbol)
    scores = table(spark, folder, "lineitem").where("l_linenumber > 2").select(*coords, F.col("l_discount").alias("score"))
    return st.coordinate_join(atoms, scores).select("line_key", "score")


@query("connect_graphs", """
  SELECT a.l_orderkey AS g, count(*) AS links, CAST(sum(a.l_linenumber * b.l_suppkey) AS BIGINT) AS mix
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey
""")
def connect_graphs_query(spark, folder):
    atoms = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("atom"))
    residues = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("residue"))
    return connect_graphs(atoms, residues, "g").groupBy("g").agg(
        F.count(F.lit(1)).alias("links"), F.sum(F.col("atom") * F.col("residue")).alias("mix"))


@query("batch_offsets", """
  WITH s AS (SELECT l_orderkey AS g, count(*) AS atoms, count(DISTINCT l_suppkey) AS residues FROM lineitem GROUP BY 1)
  SELECT g, CAST(sum(atoms) OVER w - atoms AS BIGINT) AS atom_offset, CAST(sum(residues) OVER w - residues AS BIGINT) AS residue_offset
  FROM s WINDOW w AS (ORDER BY g)
""")
def batch_offsets_query(spark, folder):
    sizes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(
        F.count(F.lit(1)).alias("atoms"), F.countDistinct("l_suppkey").alias("residues"))
    return sc.batch_offsets(sizes, "g", {"atom_offset": "atoms", "residue_offset": "residues"}).select("g", "atom_offset", "residue_offset")


@query("batch_offsets_cut", ORACLES["batch_offsets"])
def batch_offsets_cut(spark, folder):
    """The same offsets through buckets, as a table too long for one window gets them."""
    sizes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(
        F.count(F.lit(1)).alias("atoms"), F.countDistinct("l_suppkey").alias("residues"))
    offsets = sc.batch_offsets(sizes, "g", {"atom_offset": "atoms", "residue_offset": "residues"}, **CUT)
    return offsets.select("g", "atom_offset", "residue_offset")


@query("unbatch", f"""
  SELECT l_orderkey AS g, CAST(l_linenumber AS BIGINT) AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL
""")
def unbatch_query(spark, folder):
    """Shift edges into one graph and split them again."""
    edges = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("src"), F.col("l_suppkey").alias("dst"))
    sizes = edges.groupBy("g").agg(F.count(F.lit(1)).alias("atoms"), F.countDistinct("dst").alias("residues"))
    offsets = sc.batch_offsets(sizes, "g", {"a": "atoms", "b": "residues"}, hashed=True)
    back = sc.unshift_edges(sc.shift_edges(edges, offsets, "g", "a", "b"), offsets, "g", "a", "b")
    return back.groupBy("g", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("missing_targets", """
  SELECT s_suppkey AS protein_id, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
""")
def missing_targets_query(spark, folder):
    proteins = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("protein_id"), "s_name", F.col("s_nationkey").alias("sequence"))
    features = table(spark, folder, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("sequence"))
    return sc.missing_targets(proteins, features, "sequence").select("protein_id", "s_name")


@query("cache_miss_keys", """
  WITH k AS (SELECT concat_ws('-', p_name, p_brand, p_size % 5) AS key, p_size FROM part)
  SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE p_size % 7 = 0)
""")
def cache_miss_keys(spark, folder):
    part = table(spark, folder, "part").withColumn("key", F.expr("concat_ws('-', p_name, p_brand, p_size % 5)"))
    stored = part.where("p_size % 7 = 0").select(F.sha2("key", 256).alias("sha"))
    wanted = part.select("key").distinct().withColumn("sha", F.sha2("key", 256))
    return wanted.join(stored, "sha", "left_anti").select("key")


# --- windows ---------------------------------------------------------------------------


@query("top_k_per_protein", f"""
  SELECT l_suppkey, line_key, prediction, CAST(rank AS INTEGER) AS rank FROM (
    SELECT l_suppkey, {line_key()} AS line_key, l_extendedprice AS prediction,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {line_key()}) AS rank FROM lineitem) WHERE rank <= 10
""")
def top_k_per_protein(spark, folder):
    scored = lines(spark, folder).select("l_suppkey", "line_key", F.col("l_extendedprice").alias("prediction"))
    return win.top_k(scored, ["l_suppkey"], "prediction", 10, ["line_key"])


@query("minmax_per_pair", """
  WITH m AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
  SELECT event_id, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS score FROM events JOIN m USING (user_id)
""")
def minmax_per_pair(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    return win.minmax_per_group(events, ["user_id"], "value", "score").select("event_id", F.round("score", 6).alias("score"))


@query("percentile_rank", """
  SELECT event_id, round(CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1)::DOUBLE / (n - 1) END, 6) AS pct FROM (
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
""")
def percentile_rank_query(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    return win.percentile_rank(events, ["user_id"], "value", "event_id", "pct").select("event_id", F.round("pct", 6).alias("pct"))


@query("percentile_rank_cut", ORACLES["percentile_rank"])
def percentile_rank_cut(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    ranked = win.percentile_rank(events, ["user_id"], "value", "event_id", "pct", **CUT)
    return ranked.select("event_id", F.round("pct", 6).alias("pct"))


@query("assemble_batches", """
  WITH b AS (SELECT doc_id, n_chars, CASE WHEN n_chars <= 300 THEN 'short_300' WHEN n_chars <= 500 THEN 'medium_500'
                    WHEN n_chars <= 700 THEN 'long_700' ELSE 'sliding' END AS bin FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n_chars, doc_id) - 1 AS rn,
               CASE bin WHEN 'short_300' THEN 8 WHEN 'medium_500' THEN 4 WHEN 'long_700' THEN 2 ELSE 1 END AS size FROM b)
  SELECT bin, CAST(rn // size AS BIGINT) AS batch_no, count(*) AS members, CAST(max(n_chars) * count(*) - sum(n_chars) AS BIGINT) AS waste FROM r GROUP BY 1, 2
""")
def assemble_batches_query(spark, folder):
    batches = win.assemble_batches(table(spark, folder, "documents", "doc_id", "n_chars"), "n_chars", "doc_id")
    return win.padding_waste(batches, "n_chars")


@query("number_batches", """
  SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 128 AS BIGINT) AS batch_no FROM events
""")
def number_batches_query(spark, folder):
    return win.number_batches(table(spark, folder, "events", "event_id"), ["event_id"], 128)


@query("number_batches_cut", ORACLES["number_batches"])
def number_batches_cut(spark, folder):
    return win.number_batches(table(spark, folder, "events", "event_id"), ["event_id"], 128, **CUT)


@query("sliding_chunks", f"""
  WITH {SEQ_SQL}, w AS (SELECT doc_id, seq, unnest(range(0, CASE WHEN length(seq) <= 700 THEN 0
       ELSE CAST(ceil((length(seq) - 700) / 350.0) AS BIGINT) * 350 END + 1, 350)) AS s FROM seqs)
  SELECT doc_id, CAST(s AS INTEGER) AS chunk_start, length(substr(seq, s + 1, 700)) AS n, md5(substr(seq, s + 1, 700)) AS digest FROM w
""")
def sliding_chunks_query(spark, folder):
    chunks = win.sliding_chunks(sequences(spark, folder), "doc_id", "seq")
    return chunks.select("doc_id", "chunk_start", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query("merge_overlaps", f"""
  WITH {SEQ_SQL}, w AS (SELECT doc_id, seq, unnest(range(0, CASE WHEN length(seq) <= 700 THEN 0
       ELSE CAST(ceil((length(seq) - 700) / 350.0) AS BIGINT) * 350 END + 1, 350)) AS s FROM seqs),
  c AS (SELECT doc_id, s, string_split(substr(seq, s + 1, 700), '') AS chunk FROM w WHERE seq <> ''),
  p AS (SELECT doc_id, s, s + generate_subscripts(chunk, 1) AS pos, unnest(chunk) AS aa FROM c),
  m AS (SELECT doc_id, pos, avg(ascii(aa) + s / 350) AS v FROM p GROUP BY 1, 2)
  SELECT doc_id, count(*) AS positions, round(sum(v), 2) AS total FROM m GROUP BY 1
""")
def merge_overlaps_query(spark, folder):
    """Each window values a position by its letter and the window number; overlaps are averaged."""
    chunks = win.sliding_chunks(sequences(spark, folder).where("seq <> ''"), "doc_id", "seq")
    values = F.transform(F.split("chunk", ""), lambda aa: F.ascii(aa) + F.col("chunk_start") / 350)
    merged = win.merge_window_values(chunks.select("doc_id", "chunk_start", values.alias("v")), "doc_id", "chunk_start", "v")
    total = F.aggregate("v", F.lit(0.0), lambda t, x: t + x)
    return merged.groupBy("doc_id").agg(F.sum(F.size("v")).alias("positions"), F.round(F.sum(total), 2).alias("total"))


@query("merge_pair_overlaps", """
  WITH w AS (SELECT p_partkey, p_name AS t, unnest(range(0, CASE WHEN length(p_name) <= 6 THEN 0
       ELSE CAST(ceil((length(p_name) - 6) / 3.0) AS BIGINT) * 3 END + 1, 3)) AS s FROM part WHERE p_name <> ''),
  c AS (SELECT p_partkey, s, substr(t, s + 1, 6) AS chunk FROM w),
  i AS (SELECT p_partkey, s, chunk, unnest(range(0, length(chunk))) AS i FROM c),
  p AS (SELECT p_partkey, s, i, unnest(range(0, length(chunk))) AS j, chunk FROM i),
  m AS (SELECT p_partkey, s + i AS i, s + j AS j, avg(ascii(chunk[i + 1]) * 2.0 + ascii(chunk[j + 1]) + s) AS v FROM p GROUP BY 1, 2, 3)
  SELECT p_partkey, count(*) AS pairs, round(sum(v), 2) AS total, round(sum(v * (i * 7 + j)), 2) AS placed FROM m GROUP BY 1
""")
def merge_pair_overlaps_query(spark, folder):
    """Each window values a pair of letters; pairs that two windows hold are averaged, line by line."""
    names = table(spark, folder, "part", "p_partkey", "p_name").where("p_name <> ''")
    chunks = win.sliding_chunks(names, "p_partkey", "p_name", window=6, stride=3)
    letters = F.split("chunk", "")
    matrix = F.transform(letters, lambda a: F.transform(letters, lambda b: F.ascii(a) * 2.0 + F.ascii(b) + F.col("chunk_start")))
    merged = win.merge_window_pairs(chunks.select("p_partkey", "chunk_start", matrix.alias("rows")), "p_partkey", "chunk_start", "rows", window=6, stride=3)
    # Sums of the lines and of the values by place; lines that begin further right start with nulls.
    known = F.transform("rows", lambda line: F.filter(line, lambda v: v.isNotNull()))
    pairs = F.aggregate(known, F.lit(0), lambda n, line: n + F.size(line))
    total = F.aggregate(known, F.lit(0.0), lambda t, line: t + F.aggregate(line, F.lit(0.0), lambda u, v: u + v))
    placed = F.flatten(F.transform("rows", lambda line, i: F.transform(
        line, lambda v, j: F.coalesce(v, F.lit(0.0)) * ((F.col("chunk_start") + i) * 7 + F.col("first_column") + j))))
    return merged.groupBy("p_partkey").agg(
        F.sum(pairs).alias("pairs"), F.round(F.sum(total), 2).alias("total"), F.round(F.sum(F.aggregate(placed, F.lit(0.0), lambda t, x: t + x)), 2).alias("placed"))


@query("residue_table", """
  WITH m AS (SELECT user_id, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1),
  s AS (SELECT user_id, event_id, n, CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END AS score,
               row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM events JOIN m USING (user_id))
  SELECT user_id AS pair_id, event_id + 1 AS "Residue_ID", ('ACDEFGHIKLMNPQRSTVWY')[event_id % 20 + 1] AS "Residue_Type", round(score, 6) AS residue_score,
         round(CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1)::DOUBLE / (n - 1) END, 6) AS residue_percentile,
         event_id % 3 / 2.0::DOUBLE AS "Layer0_Cluster0", event_id % 5 / 4.0::DOUBLE AS "Layer0_Cluster1", event_id % 7 / 8.0::DOUBLE AS "Layer1_Cluster0"
  FROM s
""")
def residue_table_query(spark, folder):
    """Events of a user as the residues of a pair, placed by their number."""
    e = F.col("event_id")
    scores = table(spark, folder, "events").select(
        F.col("user_id").alias("pair_id"), e.alias("pos"),
        F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (e % 20 + 1).cast("int"), F.lit(1)).alias("aa"), F.col("value").alias("raw"),
        F.array(e % 3 / 2, e % 5 / 4).alias("c0"), F.array(e % 7 / 8).alias("c1"))
    out = win.residue_table(scores, {"c0": 2, "c1": 1})
    return out.withColumn("residue_score", F.round("residue_score", 6)).withColumn("residue_percentile", F.round("residue_percentile", 6))


@query("atom_table", """
  WITH a AS (SELECT l_orderkey AS ligand, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem),
  m AS (SELECT ligand, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM a GROUP BY 1)
  SELECT ligand, CAST(idx AS INTEGER) AS idx, (['C','N','O','S'])[l_partkey % 4 + 1] AS symbol,
         round(CASE WHEN hi = lo THEN 0 ELSE (l_extendedprice - lo) / (hi - lo) END, 6) AS atom_score, 'accepted' AS state
  FROM a JOIN m USING (ligand) WHERE ligand % 10 <> 0 OR ligand NOT IN (SELECT ligand FROM a WHERE l_partkey % 4 <> 3)
  UNION ALL SELECT DISTINCT ligand, NULL, NULL, NULL, 'rejected' FROM a WHERE ligand % 10 = 0 AND l_partkey % 4 <> 3
""")
def atom_table_query(spark, folder):
    """Lines of an order as atoms; every tenth order's stored symbols are overwritten by S."""
    from pyspark.sql import Window

    # An order is one small molecule, so its atoms are numbered in one group.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    atoms = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("ligand"), (F.row_number().over(order) - 1).alias("idx"),
        F.get(F.array(*[F.lit(s) for s in "CNOS"]), (F.col("l_partkey") % 4).cast("int")).alias("symbol"), F.col("l_extendedprice").alias("raw"))
    stored = F.when(F.col("ligand") % 10 == 0, "S").otherwise(F.col("symbol"))
    listed = atoms.groupBy("ligand").agg(F.array_sort(F.collect_list(F.struct("idx", stored.alias("s")))).alias("l"))
    molecules = listed.select("ligand", F.array_join(F.transform("l", lambda x: x["s"]), "|").alias("atom_types"))
    accepted, rejected = win.atom_table(molecules, atoms)
    good = accepted.select("ligand", "idx", "symbol", F.round("atom_score", 6).alias("atom_score"), F.lit("accepted").alias("state"))
    bad = rejected.select("ligand", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("symbol"),
                          F.lit(None).cast("double").alias("atom_score"), F.lit("rejected").alias("state"))
    return good.unionByName(bad)


@query("rank_output", f"""
  WITH {SCREEN_SQL} SELECT protein_id, smiles, round(prediction, 4) + 0.0 AS prediction FROM scored
""")
def rank_output_query(spark, folder):
    ranked = win.rank_output(_scored(spark, folder))
    return ranked.withColumn("prediction", F.col("prediction") + F.lit(0.0))


@query("distinct_first_seen", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_first_seen_query(spark, folder):
    return win.distinct_first_seen(table(spark, folder, "documents", "doc_id", "text"), "text", "doc_id")


@query("project_fingerprints")
def project_fingerprints_query(spark, folder):
    """Ligand and class-mean vectors joined to one fingerprint, mapped to two dimensions."""
    proteins = centroids(spark, folder).withColumnRenamed("protein_id", "label")
    pairs = ligand_vectors(spark, folder).join(proteins, "label")
    prints = pairs.select("smiles", st.fingerprint(F.transform("ligand_vec", lambda x: x.cast("double")), F.col("protein_vec")).alias("vec"))
    return st.project_fingerprints(prints, "smiles", "vec")


@query("fingerprint", f"""
  WITH {CENTROID_SQL}
  SELECT vec_id AS smiles, len(list_concat(embedding::DOUBLE[], protein_vec)) AS width,
         round(list_sum(embedding::DOUBLE[]) + list_sum(protein_vec), 6) + 0.0 AS total FROM embeddings JOIN centroids ON protein_id = label
""")
def fingerprint_query(spark, folder):
    proteins = centroids(spark, folder).withColumnRenamed("protein_id", "label")
    pairs = ligand_vectors(spark, folder).join(proteins, "label")
    prints = pairs.select("smiles", st.fingerprint(F.transform("ligand_vec", lambda x: x.cast("double")), F.col("protein_vec")).alias("vec"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return prints.select("smiles", F.size("vec").cast("long").alias("width"), (F.round(total, 6) + F.lit(0.0)).alias("total"))




@query("scale_verdict", """
  WITH n AS (SELECT (SELECT count(*) FROM supplier) AS proteins, (SELECT count(DISTINCT lower(trim(p_name))) FROM part) AS ligands),
  t(top_k, max_pairs) AS (VALUES (NULL, NULL), (NULL, 1), (5, 1), (NULL, 1000000000000))
  SELECT coalesce(top_k, 0) AS top_k, coalesce(max_pairs, 0) AS max_pairs, proteins, ligands, proteins * ligands AS pairs,
         top_k IS NOT NULL OR max_pairs IS NULL OR proteins * ligands <= max_pairs AS allowed FROM n, t
""")
def scale_verdict(spark, folder):
    """What the check before a screen says of the tables' sizes under several limits."""
    proteins = table(spark, folder, "supplier", "s_suppkey")
    ligands = table(spark, folder, "part").select(F.lower(F.trim("p_name")).alias("smiles")).distinct()
    out = None
    for top_k, limit in ((None, None), (None, 1), (5, 1), (None, 10**12)):
        row = sc.scale_verdict(proteins, ligands, top_k, limit).select(
            F.lit(top_k or 0).alias("top_k"), F.lit(limit or 0).cast("long").alias("max_pairs"), "proteins", "ligands", "pairs", "allowed")
        out = row if out is None else out.unionByName(row)
    return out


@query("head_columns", f"""
  WITH {SCREEN_SQL}, h(heads, metric, columns) AS (VALUES
    ('r', 'rmse', 1), ('c', 'roc', 2), ('m', 'macro_f1', 4), ('rc', 'rmse', 2), ('rm', 'rmse', 4), ('cm', 'roc', 5), ('rcm', 'rmse', 5))
  SELECT heads, metric, columns, (SELECT count(*) FROM scored) AS scored, CASE WHEN contains(heads, 'r') THEN (SELECT round(sum(prediction), 2) FROM scored) ELSE 0 END AS total FROM h
""")
def head_columns(spark, folder):
    """What each choice of heads makes of the scored pairs: the metric that selects, the columns, the predictions."""
    pairs = sc.score_dot(sc.screen_matrix(ligand_vectors(spark, folder), centroids(spark, folder), "smiles", "protein_id"), "ligand_vec", "protein_vec")
    raw = pairs.select("protein_id", "smiles", F.col("prediction").alias("__reg"), F.col("prediction").alias("__logit"),
                       F.array(F.lit(0.0), F.col("prediction"), 2 * F.col("prediction")).alias("__logits"))
    out = None
    for names in ("r", "c", "m", "rc", "rm", "cm", "rcm"):
        heads = sc.Heads("r" in names, "c" in names, "m" in names)
        scored = sc.apply_heads(raw, ["protein_id", "smiles"], heads)
        columns = [c for c in heads.score_columns() if c in scored.columns]
        row = scored.agg(F.count(F.lit(1)).alias("scored"), F.round(F.sum("prediction"), 2).alias("total")).select(
            F.lit(names).alias("heads"), F.lit(heads.selection_metric).alias("metric"), F.lit(len(columns)).alias("columns"), "scored", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("sql_sliding_windows", f"""
  WITH {SEQ_SQL}, w AS (SELECT doc_id, seq, unnest(range(0, CASE WHEN length(seq) <= 700 THEN 0
       ELSE CAST(ceil((length(seq) - 700) / 350.0) AS BIGINT) * 350 END + 1, 350)) AS s FROM seqs)
  SELECT doc_id, CAST(s AS INTEGER) AS chunk_start, md5(substr(seq, s + 1, 700)) AS digest FROM w
""")
def sql_sliding_windows(spark, folder):
    register_table_functions(spark)
    sequences(spark, folder).createOrReplaceTempView("sequences_of_documents")
    return spark.sql("SELECT doc_id, chunk_start, md5(chunk) AS digest FROM sequences_of_documents, LATERAL sliding_windows(seq)")


@query("sql_best_rows", """
  SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5
""")
def sql_best_rows(spark, folder):
    register_table_functions(spark)
    table(spark, folder, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").createOrReplaceTempView("lines_by_supplier")
    return spark.sql("""
      SELECT * FROM best_rows(TABLE(lines_by_supplier) PARTITION BY l_suppkey ORDER BY (l_extendedprice DESC, l_orderkey, l_linenumber), 5)
    """)


@query("sql_batches", """
  SELECT lang, doc_id, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 8 AS batch_no FROM documents
""")
def sql_batches(spark, folder):
    register_table_functions(spark)
    table(spark, folder, "documents", "lang", "doc_id", "n_chars").createOrReplaceTempView("documents_by_length")
    return spark.sql("SELECT * FROM batches(TABLE(documents_by_length) PARTITION BY lang ORDER BY (n_chars, doc_id), 8)")
