"""Queries for evaluation metrics and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export
from ..operators import metrics as m
from ..operators import screening as sc
from .registry import CUT, ORACLES, query, table
from .views import SCREEN_SQL, centroids, ligand_vectors

REG_SQL = """
  reg AS (SELECT CASE WHEN l_linenumber < 7 THEN l_extendedprice / 1000 END AS y, l_quantity * 1.5 + l_discount * 10 AS p,
                 l_partkey, l_suppkey, l_quantity FROM lineitem),
  known AS (SELECT * FROM reg WHERE y IS NOT NULL)
"""


def _regression(spark, folder):
    """Prices against quantities; lines numbered 7 have no label, given as NaN."""
    y = F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice") / 1000).otherwise(F.lit(float("nan")))
    return table(spark, folder, "lineitem").select(
        y.alias("y"), (F.col("l_quantity") * 1.5 + F.col("l_discount") * 10).alias("p"), "l_partkey", "l_suppkey", "l_quantity")


ERROR_SQL = """
  count(*) AS n, round(avg(power(y - p, 2)), 5) AS mse, round(sqrt(avg(power(y - p, 2))), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae,
  round(sqrt(regr_syy(y, p) * (1 - regr_r2(y, p)) / (count(*) - 1)), 5) AS sd, round(corr(y, p), 6) AS pearson,
  round(power(corr(y, p), 2) * (1 - sqrt(abs(power(corr(y, p), 4) - power(
    1 - (sum(y * y) - power(sum(y * p), 2) / sum(p * p)) / (var_pop(y) * count(*)), 2)))), 5) AS rm2
"""
ERROR_DIGITS = {"mse": 5, "rmse": 5, "mae": 5, "sd": 5, "pearson": 6, "rm2": 5}


def _rounded(df, digits):
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


@query("error_metrics", f"WITH {REG_SQL} SELECT {ERROR_SQL} FROM known")
def error_metrics_query(spark, folder):
    return _rounded(m.error_metrics(m.labelled(_regression(spark, folder))), ERROR_DIGITS)


@query("error_metrics_by_group", f"WITH {REG_SQL} SELECT l_suppkey, {ERROR_SQL} FROM known GROUP BY l_suppkey")
def error_metrics_by_group(spark, folder):
    return _rounded(m.error_metrics(m.labelled(_regression(spark, folder), by=["l_suppkey"]), ["l_suppkey"]), ERROR_DIGITS)


@query("metrics_by_stratum", f"""
  WITH {REG_SQL}, j AS (SELECT y, p, CASE WHEN p_size <= 10 THEN 'fine' WHEN p_size <= 30 THEN 'medium' ELSE 'coarse' END AS stratum
                        FROM known JOIN part ON p_partkey = l_partkey)
  SELECT stratum, {ERROR_SQL} FROM j GROUP BY stratum
""")
def metrics_by_stratum_query(spark, folder):
    covariate = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    stratum = F.when(F.col("p_size") <= 10, "fine").when(F.col("p_size") <= 30, "medium").otherwise("coarse")
    return _rounded(m.metrics_by_stratum(_regression(spark, folder), covariate, "l_partkey", stratum), ERROR_DIGITS)


RANK_SQL = """
  ranks AS (SELECT {by} rank() OVER (PARTITION BY {part} ORDER BY y) + (count(*) OVER (PARTITION BY {part}, y) - 1) / 2.0 AS ry,
                   rank() OVER (PARTITION BY {part} ORDER BY p) + (count(*) OVER (PARTITION BY {part}, p) - 1) / 2.0 AS rp FROM known)
"""


@query("spearman", f"WITH {REG_SQL}, {RANK_SQL.format(by='', part='1')} SELECT round(corr(ry, rp), 6) AS spearman FROM ranks")
def spearman_query(spark, folder):
    return _rounded(m.spearman(m.labelled(_regression(spark, folder))), {"spearman": 6})


@query("spearman_by_group", f"""
  WITH {REG_SQL}, {RANK_SQL.format(by='l_suppkey,', part='l_suppkey')} SELECT l_suppkey, round(corr(ry, rp), 6) AS spearman FROM ranks GROUP BY l_suppkey
""")
def spearman_by_group(spark, folder):
    return _rounded(m.spearman(m.labelled(_regression(spark, folder), by=["l_suppkey"]), ["l_suppkey"]), {"spearman": 6})


@query("spearman_cut", ORACLES["spearman"])
def spearman_cut(spark, folder):
    """The ``_cut`` queries go through buckets, as tables too long for one window do."""
    return _rounded(m.spearman(m.labelled(_regression(spark, folder)), **CUT), {"spearman": 6})


CI_SQL = """
  c AS (SELECT {by} y, p, count(*) AS w FROM (SELECT user_id, floor(value / 4) AS y, event_id % 97 + floor(value / 6) AS p FROM events) GROUP BY {by} y, p),
  s AS (SELECT {a} sum(CASE WHEN a.p < b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END * a.w * b.w) / sum(a.w * b.w) AS ci
        FROM c a JOIN c b ON a.y < b.y {on} {group})
"""


@query("concordance_index", f"WITH {CI_SQL.format(by='', a='', on='', group='')} SELECT round(ci, 8)::DOUBLE AS ci FROM s")
def concordance_index_query(spark, folder):
    return _rounded(m.concordance_index(_event_pairs(spark, folder)), {"ci": 8})


@query("concordance_index_by_group", f"""
  WITH {CI_SQL.format(by='user_id,', a='a.user_id,', on='AND a.user_id = b.user_id', group='GROUP BY a.user_id')}
  SELECT u.user_id, round(ci, 8)::DOUBLE AS ci FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id
""")
def concordance_index_by_group(spark, folder):
    return _rounded(m.concordance_index(_event_pairs(spark, folder), ["user_id"]), {"ci": 8})


@query("concordance_index_cut", ORACLES["concordance_index"])
def concordance_index_cut(spark, folder):
    return _rounded(m.concordance_index(_event_pairs(spark, folder), **CUT), {"ci": 8})


def _event_pairs(spark, folder):
    return table(spark, folder, "events").select(
        "user_id", F.floor(F.col("value") / 4).cast("double").alias("y"),
        (F.col("event_id") % 97 + F.floor(F.col("value") / 6)).cast("double").alias("p"))


BIN_SQL = "b AS (SELECT quality AS y, n_chars % 1000 / 1000.0 AS p, lang FROM labels JOIN documents USING (doc_id))"


def _binary(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "n_chars", "lang")
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("y"), (F.col("n_chars") % 1000 / 1000).alias("p"), "lang")


AUC_SQL = """
  r AS (SELECT {by} y, rank() OVER (PARTITION BY {part} ORDER BY p) + (count(*) OVER (PARTITION BY {part}, p) - 1) / 2.0 AS r FROM b),
  auc AS (SELECT {by} round(CASE WHEN sum(y) BETWEEN 1 AND count(*) - 1 THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END, 6)::DOUBLE AS roc FROM r {group})
"""


@query("roc_auc", f"WITH {BIN_SQL}, {AUC_SQL.format(by='', part='1', group='')} SELECT roc FROM auc")
def roc_auc_query(spark, folder):
    return _rounded(m.roc_auc(m.labelled(_binary(spark, folder))), {"roc": 6})


@query("roc_auc_by_group", f"WITH {BIN_SQL}, {AUC_SQL.format(by='lang,', part='lang', group='GROUP BY lang')} SELECT lang, roc FROM auc")
def roc_auc_by_group(spark, folder):
    return _rounded(m.roc_auc(m.labelled(_binary(spark, folder), by=["lang"]), ["lang"]), {"roc": 6})


@query("roc_auc_cut", ORACLES["roc_auc_by_group"])
def roc_auc_cut(spark, folder):
    return _rounded(m.roc_auc(m.labelled(_binary(spark, folder), by=["lang"]), ["lang"], **CUT), {"roc": 6})


AP_SQL = """
  t AS (SELECT {by} p, sum(y) AS pos, count(*) AS n FROM b GROUP BY {by} p),
  c AS (SELECT {by} pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS ({partition} ORDER BY p DESC)),
  ap AS (SELECT {by} round(sum(pos * tp::DOUBLE / seen) / nullif(sum(pos), 0), 6) AS prc FROM c {group})
"""


@query("average_precision", f"WITH {BIN_SQL}, {AP_SQL.format(by='', partition='', group='')} SELECT prc FROM ap")
def average_precision_query(spark, folder):
    return _rounded(m.average_precision(m.labelled(_binary(spark, folder))), {"prc": 6})


@query("average_precision_by_group", f"""
  WITH {BIN_SQL}, {AP_SQL.format(by='lang,', partition='PARTITION BY lang', group='GROUP BY lang')} SELECT lang, prc FROM ap
""")
def average_precision_by_group(spark, folder):
    return _rounded(m.average_precision(m.labelled(_binary(spark, folder), by=["lang"]), ["lang"]), {"prc": 6})


@query("average_precision_cut", ORACLES["average_precision"])
def average_precision_cut(spark, folder):
    return _rounded(m.average_precision(m.labelled(_binary(spark, folder)), **CUT), {"prc": 6})


THRESHOLD_SQL = """
  h AS (SELECT count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn FROM b),
  f AS (SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1,
               round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS recall,
               round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6)::DOUBLE AS precision FROM h)
"""


@query("threshold_metrics", f"WITH {BIN_SQL}, {THRESHOLD_SQL} SELECT * FROM f")
def threshold_metrics_query(spark, folder):
    return _rounded(m.threshold_metrics(m.labelled(_binary(spark, folder))), {"f1": 6, "recall": 6, "precision": 6})


# Rounded to six places before ranking, so that both engines see the same ties.
MULTI_SQL = f"""
  {SCREEN_SQL},
  long AS (SELECT smiles, label, protein_id AS cls, round(prediction, 6) AS p FROM scored JOIN embeddings ON vec_id = smiles),
  ovr AS (SELECT cls, p, CASE WHEN label = cls THEN 1 ELSE 0 END AS y FROM long)
"""


def _multiclass(spark, folder):
    """Class scores by the dot product with every class mean, as one array per vector."""
    ligands = ligand_vectors(spark, folder)
    matrix = sc.screen_matrix(ligands, centroids(spark, folder), "smiles", "protein_id")
    scored = sc.score_dot(matrix, "ligand_vec", "protein_vec")
    listed = scored.groupBy("smiles", "label").agg(
        F.array_sort(F.collect_list(F.struct("protein_id", F.round("prediction", 6).alias("p")))).alias("l"))
    return listed.select("smiles", "label", F.transform("l", lambda s: s["p"]).alias("probs"))


@query("multiclass_ranking", f"""
  WITH {MULTI_SQL},
  r AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS r FROM ovr),
  auc AS (SELECT cls, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS roc FROM r GROUP BY cls),
  t AS (SELECT cls, p, sum(y) AS pos, count(*) AS n FROM ovr GROUP BY cls, p),
  c AS (SELECT cls, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (PARTITION BY cls ORDER BY p DESC)),
  ap AS (SELECT cls, sum(pos * tp::DOUBLE / seen) / sum(pos) AS prc FROM c GROUP BY cls)
  SELECT round(avg(roc), 6)::DOUBLE AS multiclass_roc, round(avg(prc), 6)::DOUBLE AS multiclass_prc FROM auc JOIN ap USING (cls)
""")
def multiclass_ranking_query(spark, folder):
    classes = m.valid_classes(_multiclass(spark, folder), "label", "probs", 10)
    return _rounded(m.multiclass_ranking(classes, 10), {"multiclass_roc": 6, "multiclass_prc": 6})


HAT_SQL = """
  best AS (SELECT smiles, any_value(label) AS label, arg_min(cls, (-p, cls)) AS hat FROM long GROUP BY smiles),
  g AS (SELECT label AS cls, label = hat AS hit, 1 AS side FROM best UNION ALL SELECT hat, label = hat, 2 FROM best),
  per AS (SELECT cls, count(*) FILTER (hit AND side = 1) AS tp, count(*) AS n FROM g GROUP BY cls)
"""


@query("multiclass_confusion", f"""
  WITH {MULTI_SQL}, {HAT_SQL}
  SELECT round((SELECT avg(CASE WHEN label = hat THEN 1.0 ELSE 0 END) FROM best), 6)::DOUBLE AS multiclass_accuracy,
         round(avg(2 * tp / n), 6)::DOUBLE AS macro_f1 FROM per
""")
def multiclass_confusion_query(spark, folder):
    classes = m.valid_classes(_multiclass(spark, folder), "label", "probs", 10)
    return _rounded(m.multiclass_confusion(classes), {"multiclass_accuracy": 6, "macro_f1": 6})


@query("masked_mse", f"WITH {REG_SQL} SELECT round(avg(power(y - p, 2)), 5) AS masked_mse FROM known")
def masked_mse_query(spark, folder):
    return _rounded(m.masked_mse(_regression(spark, folder)), {"masked_mse": 5})


@query("masked_ce", """
  WITH l AS (SELECT CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN 1000 ELSE label % 3 END AS y,
                    [embedding[1]::DOUBLE * 9, embedding[2]::DOUBLE * 9, embedding[3]::DOUBLE * 9] AS x FROM embeddings),
  s AS (SELECT y, x, exp(x[1]) + exp(x[2]) + exp(x[3]) AS z FROM l)
  SELECT round(avg(ln(z) - x[CAST(y AS INTEGER) + 1]) FILTER (y < 1000)
             + avg(-greatest(-100, ln((exp(x[1]) + exp(x[3])) / z))) FILTER (y = 1000), 6) AS masked_ce FROM s
""")
def masked_ce_query(spark, folder):
    label = F.when(F.col("vec_id") % 11 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 4 == 0, F.lit(1000.0)).otherwise(F.col("label") % 3)
    logits = F.array(*[F.get("embedding", F.lit(i)).cast("double") * 9 for i in range(3)])
    rows = table(spark, folder, "embeddings").select(label.alias("label"), logits.alias("logits"))
    return _rounded(m.masked_ce(rows, "label", "logits"), {"masked_ce": 6})


@query("bce_logits", """
  SELECT round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS bce FROM (SELECT quality AS y, (n_chars % 100 - 50) / 10.0 AS x FROM labels JOIN documents USING (doc_id))
""")
def bce_logits_query(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents", "doc_id", "n_chars"), "doc_id")
    return _rounded(m.bce_logits(rows.select(F.col("quality").alias("y"), ((F.col("n_chars") % 100 - 50) / 10).alias("x"))), {"bce": 6})


@query("evaluate", f"""
  WITH {MULTI_SQL}, {HAT_SQL},
  known AS (SELECT floor(value / 4) AS y, event_id % 97 + floor(value / 6) AS p FROM events WHERE event_id % 9 <> 0),
  {RANK_SQL.format(by='', part='1')},
  e AS (SELECT {ERROR_SQL} FROM known),
  k AS (SELECT y, p, count(*) AS w FROM known GROUP BY y, p),
  ci AS (SELECT sum(CASE WHEN a.p < b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END * a.w * b.w) / sum(a.w * b.w) AS ci FROM k a JOIN k b ON a.y < b.y),
  {BIN_SQL}, br AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM b),
  {AP_SQL.format(by='', partition='', group='')}, {THRESHOLD_SQL},
  mr AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS r FROM ovr),
  mauc AS (SELECT cls, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS roc FROM mr GROUP BY cls),
  mt AS (SELECT cls, p, sum(y) AS pos, count(*) AS n FROM ovr GROUP BY cls, p),
  mc AS (SELECT cls, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM mt WINDOW w AS (PARTITION BY cls ORDER BY p DESC)),
  map AS (SELECT cls, sum(pos * tp::DOUBLE / seen) / sum(pos) AS prc FROM mc GROUP BY cls),
  out AS (
    SELECT 'mse' AS metric, mse AS value FROM e UNION ALL SELECT 'rmse', rmse FROM e UNION ALL SELECT 'mae', mae FROM e UNION ALL SELECT 'sd', sd FROM e
    UNION ALL SELECT 'pearson', pearson FROM e UNION ALL SELECT 'rm2', rm2 FROM e UNION ALL SELECT 'spearman', corr(ry, rp) FROM ranks
    UNION ALL SELECT 'ci', ci FROM ci UNION ALL SELECT 'masked_mse', mse FROM e
    UNION ALL SELECT 'roc', (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) FROM br
    UNION ALL SELECT 'prc', prc FROM ap UNION ALL SELECT 'f1', f1 FROM f UNION ALL SELECT 'recall', recall FROM f UNION ALL SELECT 'precision', precision FROM f
    UNION ALL SELECT 'multiclass_roc', avg(roc) FROM mauc UNION ALL SELECT 'multiclass_prc', avg(prc) FROM map
    UNION ALL SELECT 'multiclass_accuracy', avg(CASE WHEN label = hat THEN 1.0 ELSE 0 END) FROM best
    UNION ALL SELECT 'macro_f1', avg(2 * tp / n) FROM per)
  SELECT metric, round(value, 4)::DOUBLE AS value FROM out
""")
def evaluate_query(spark, folder):
    y = F.when(F.col("event_id") % 9 != 0, F.floor(F.col("value") / 4).cast("double"))
    regression = table(spark, folder, "events").select(y.alias("y"), (F.col("event_id") % 97 + F.floor(F.col("value") / 6)).alias("p"))
    return m.evaluate(regression, _binary(spark, folder), _multiclass(spark, folder), n_classes=10, digits=4)


@query("best_checkpoint", """
  WITH l AS (SELECT user_id AS run, (['rmse','roc','macro_f1'])[event_id % 3 + 1] AS metric, event_id AS step, value FROM events)
  SELECT run, metric, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run, metric
    ORDER BY CASE WHEN metric = 'rmse' THEN value ELSE -value END, step) AS rn FROM l) WHERE rn = 1
""")
def best_checkpoint_query(spark, folder):
    """Events as an evaluation log, one run per user."""
    names = F.array(F.lit("rmse"), F.lit("roc"), F.lit("macro_f1"))
    log = table(spark, folder, "events").select(
        F.col("user_id").alias("run"), F.get(names, (F.col("event_id") % 3).cast("int")).alias("metric"), F.col("event_id").alias("step"), "value")
    return m.best_checkpoint(log)


@query("element_score_check", """
  WITH a AS (SELECT upper(p_type) AS symbol, list_sort(list(DISTINCT round(p_size / 50.0, 2))) AS s FROM part GROUP BY 1),
       b AS (SELECT upper(p_type) AS symbol, list_sort(list(DISTINCT round(p_size / 50.0, 2))) AS s FROM part WHERE p_size <= 25 OR p_type <> 'LARGE' GROUP BY 1)
  SELECT symbol, len(a.s) AS n_left, len(b.s) AS n_right FROM a FULL JOIN b USING (symbol) WHERE a.s IS DISTINCT FROM b.s
""")
def element_score_check_query(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_type").alias("symbol"), (F.col("p_size") / 50).alias("score"), "p_size", "p_type")
    checked = m.element_score_check(part, part.where("p_size <= 25 OR p_type <> 'LARGE'"))
    return checked.select("symbol", F.size("left_scores").cast("long").alias("n_left"), F.size("right_scores").cast("long").alias("n_right"))


@query("selectivity_profile", """
  WITH a AS (SELECT p_name AS ligand, p_type AS target, max(p_size) / 5.0 AS a FROM part GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY ligand ORDER BY a DESC, target) AS rn FROM a WHERE target IN ('LARGE', 'ECONOMY', 'SMALL'))
  SELECT ligand, max(a) FILTER (target = 'LARGE')::DOUBLE AS "LARGE", max(a) FILTER (target = 'ECONOMY')::DOUBLE AS "ECONOMY", max(a) FILTER (target = 'SMALL')::DOUBLE AS "SMALL",
         max(target) FILTER (rn = 1) AS best_target, round(max(a) FILTER (rn = 1) - max(a) FILTER (rn = 2), 6)::DOUBLE AS gap,
         CAST(count(*) FILTER (a >= 9) AS INTEGER) AS active_targets
  FROM (SELECT DISTINCT ligand FROM a) LEFT JOIN r USING (ligand) GROUP BY ligand
""")
def selectivity_profile_query(spark, folder):
    scores = table(spark, folder, "part").select(
        F.col("p_name").alias("ligand"), F.col("p_type").alias("target"), (F.col("p_size") / 5).alias("affinity"))
    return _rounded(m.selectivity_profile(scores, ["LARGE", "ECONOMY", "SMALL"], active_at=9.0), {"gap": 6})


@query("export_predictions", f"""
  WITH {SCREEN_SQL}
  SELECT protein_id, smiles, round(prediction, 4) + 0.0 AS prediction, CASE WHEN label = protein_id THEN 1 END AS classification_truth
  FROM scored JOIN embeddings ON vec_id = smiles
""")
def export_predictions_query(spark, folder):
    ligands = ligand_vectors(spark, folder)
    scored = sc.score_dot(sc.screen_matrix(ligands, centroids(spark, folder), "smiles", "protein_id"), "ligand_vec", "protein_vec")
    labels = ligands.select(F.col("label").alias("protein_id"), "smiles", F.lit(1).alias("classification_truth"))
    exported = m.export_predictions(scored.select("protein_id", "smiles", "prediction"), labels, ["protein_id", "smiles"])
    return exported.withColumn("prediction", F.round("prediction", 4) + F.lit(0.0))


def _order_bundle(spark, folder):
    """Orders as pairs of a customer and an order, their lines as residues, atoms and cliques."""
    keys = [F.col("l_orderkey").alias("ligand")]
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    number = F.col("l_linenumber").alias("position")
    pairs = orders.select(F.col("o_orderkey").alias("ligand"), F.col("o_custkey").cast("double").alias("regression_prediction"),
                          ((F.col("o_custkey") % 100) / 100).alias("classification_prediction"))
    labels = orders.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("ligand"), (F.col("o_custkey") + F.col("o_orderkey") % 5).cast("double").alias("regression_truth"),
        (F.col("o_orderkey") % 2).alias("classification_truth"))
    whole = F.col("l_quantity").cast("long")
    return export.prediction_bundle(
        pairs, ["ligand"], labels,
        lines.where("l_linenumber <= 3").select(*keys, number, whole.alias("score"), F.array(whole, whole % 7).alias("layers")),
        lines.where("l_linenumber > 3").select(*keys, number, whole.alias("score")),
        lines.where("l_linenumber % 2 = 0").select(*keys, number, F.array(whole % 5).alias("layers")),
        orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("ligand"), F.array(F.col("o_custkey").cast("double")).alias("mol_feature")))


@query("prediction_bundle", """
  WITH l AS (SELECT l_orderkey AS ligand, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
  e AS (SELECT ligand, coalesce(string_agg(q::VARCHAR, ',' ORDER BY n, q) FILTER (n <= 3), '') AS residue_score,
          coalesce(string_agg(q || ':' || q % 7, ',' ORDER BY n, q) FILTER (n <= 3), '') AS residue_layer,
          coalesce(string_agg(q::VARCHAR, ',' ORDER BY n, q) FILTER (n > 3), '') AS atom_score,
          coalesce(string_agg((q % 5)::VARCHAR, ',' ORDER BY n, q % 5) FILTER (n % 2 = 0), '') AS clique_layer FROM l GROUP BY ligand)
  SELECT o_orderkey AS ligand, o_custkey::DOUBLE AS regression_prediction, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey + o_orderkey % 5)::DOUBLE END AS regression_truth,
         CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 2)::DOUBLE END AS classification_truth,
         coalesce(residue_score, '') AS residue_score, coalesce(residue_layer, '') AS residue_layer, coalesce(atom_score, '') AS atom_score, coalesce(clique_layer, '') AS clique_layer,
         CASE WHEN o_orderkey % 4 = 0 THEN o_custkey::DOUBLE END AS mol_feature
  FROM orders LEFT JOIN e ON ligand = o_orderkey
""")
def prediction_bundle_query(spark, folder):
    def told(name):
        return F.array_join(F.transform(f"explanation.{name}", lambda x: x.cast("long").cast("string")), ",").alias(name)

    def layers(name):
        return F.array_join(F.transform(f"explanation.{name}", lambda x: F.array_join(F.transform(x, lambda v: v.cast("long").cast("string")), ":")), ",").alias(name)

    return _order_bundle(spark, folder).select(
        "ligand", F.col("regression.prediction").alias("regression_prediction"), F.col("regression.truth").alias("regression_truth"),
        F.col("classification.truth").alias("classification_truth"), told("residue_score"), layers("residue_layer"), told("atom_score"), layers("clique_layer"),
        F.get("explanation.mol_feature", F.lit(0)).alias("mol_feature"))


@query("bundle_report", """
  WITH r AS (SELECT o_custkey::DOUBLE AS p, (o_custkey + o_orderkey % 5)::DOUBLE AS y, (o_custkey % 100) / 100.0 AS c, o_orderkey % 2 AS t FROM orders WHERE o_orderkey % 3 <> 0),
  f AS (SELECT sum(CASE WHEN c > 0.5 AND t = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN c > 0.5 THEN 1.0 ELSE 0 END) AS said, sum(t) AS pos FROM r)
  SELECT 'regression' AS family, 'mse' AS metric, round(avg((y - p) * (y - p)), 6)::DOUBLE AS value, false AS failed FROM r
  UNION ALL SELECT 'regression', 'mae', round(avg(abs(y - p)), 6), false FROM r
  UNION ALL SELECT 'regression', 'pearson', round(corr(y, p), 6), false FROM r
  UNION ALL SELECT 'classification', 'precision', round(tp / said, 6), false FROM f
  UNION ALL SELECT 'classification', 'recall', round(tp / pos, 6), false FROM f
  UNION ALL SELECT 'multiclass', NULL, NULL, true
""")
def bundle_report_query(spark, folder):
    """The multiclass family fails on purpose; the others are as they would be without it."""
    bundle = _order_bundle(spark, folder)
    failing = bundle.select(F.lit("any").alias("metric"), F.raise_error(F.lit("no multiclass head")).cast("double").alias("value"))
    report = export.isolated_report(spark, {**export.bundle_families(bundle), "multiclass": lambda: failing})
    shown = report.where("metric IS NULL OR metric IN ('mse', 'mae', 'pearson', 'precision', 'recall')")
    return shown.select("family", "metric", F.round("value", 6).alias("value"), F.col("error").isNotNull().alias("failed"))
