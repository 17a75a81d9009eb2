"""Evaluation metrics over (group?, y, p). All lazy, one row per group.

Rank metrics first compress rows to distinct values, which removes the weight of tied
scores before anything is ordered, and then use bucketed running totals. Their keyword
arguments ``cut`` (``buckets``, ``hot_rows``) go to :func:`running_totals`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import bce_with_logits, is_valid_class, missing
from ..functions.vectors import argmax, log_sum_exp, softmax
from ..session import checkpointed
from .ordering import average_ranks, null_safe_join, running_totals, value_buckets

REGRESSION = ["mse", "rmse", "mae", "sd", "pearson", "spearman", "rm2", "ci"]
BINARY = ["roc", "prc", "f1", "recall", "precision"]
MULTICLASS = ["multiclass_roc", "multiclass_prc", "multiclass_accuracy", "macro_f1"]


def labelled(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Rows with a label, as double columns ``y`` and ``p``."""
    return df.where(~missing(F.col(y))).select(
        *by, F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))


# --- regression ------------------------------------------------------------------------


def error_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, sd, pearson, rm2 and the row count in one aggregation."""
    y, p = F.col("y"), F.col("p")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.corr(y, p).alias("pearson"),
        F.var_pop(y).alias("var_y"),
        F.sum(p * p).alias("pp"),
        F.sum(y * p).alias("yp"),
        F.sum(y * y).alias("yy"),
    )
    n, var_y = F.col("n"), F.col("var_y")
    r2 = F.col("pearson") * F.col("pearson")
    k = F.col("yp") / F.col("pp")
    residual = F.col("yy") - F.lit(2.0) * k * F.col("yp") + k * k * F.col("pp")
    r02 = F.lit(1.0) - residual / (var_y * n)
    return sums.select(
        *by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
        F.sqrt(var_y * n * (F.lit(1.0) - r2) / (n - 1)).alias("sd"),
        "pearson",
        (r2 * (F.lit(1.0) - F.sqrt(F.abs(r2 * r2 - r02 * r02)))).alias("rm2"),
    )


def spearman(df: DataFrame, by: Sequence[str] = (), **cut) -> DataFrame:
    """Pearson correlation of average ranks."""
    by = list(by)
    pairs = df.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("w"))
    ranked = pairs
    for column, rank in (("y", "ry"), ("p", "rp")):
        ranks = average_ranks(df, column, rank, by=by, **cut)
        ranked = null_safe_join(ranked, ranks, [*by, column], "inner")
    w, ry, rp = F.col("w"), F.col("ry"), F.col("rp")
    sums = ranked.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * ry).alias("sy"), F.sum(w * rp).alias("sp"),
        F.sum(w * ry * ry).alias("syy"), F.sum(w * rp * rp).alias("spp"), F.sum(w * ry * rp).alias("syp"),
    )
    mean_y, mean_p = F.col("sy") / F.col("n"), F.col("sp") / F.col("n")
    cov = F.col("syp") / F.col("n") - mean_y * mean_p
    var_y = F.col("syy") / F.col("n") - mean_y * mean_y
    var_p = F.col("spp") / F.col("n") - mean_p * mean_p
    value = F.when((var_y > 0) & (var_p > 0), cov / F.sqrt(var_y * var_p))
    return sums.select(*by, value.alias("spearman"))


def _concordance(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted pairs with smaller y and smaller p, and with smaller y and equal p.

    Ranks of p are split bit by bit from the top. At each level the pairs parting there
    share all higher bits; running weights count them in O(n) per level.
    """
    order = np.argsort(y, kind="stable")
    y, p, w = y[order], np.unique(p[order], return_inverse=True)[1], w[order].astype(np.float64)
    below = 0.0
    bits = max(1, int(p.max()).bit_length())
    for bit in range(bits):
        block = p >> (bit + 1)
        rows = np.argsort(block, kind="stable")  # y order kept inside a block
        zeros = np.where((p[rows] >> bit) & 1 == 0, w[rows], 0.0)
        below += _smaller_y(block[rows], y[rows], zeros, w[rows] - zeros)
    rows = np.argsort(p, kind="stable")
    return below, _smaller_y(p[rows], y[rows], w[rows], w[rows])


def _smaller_y(block: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    """Sum of left * right over pairs of one block whose left y is strictly smaller."""
    before = np.concatenate([[0.0], np.cumsum(left)])
    new_block = np.concatenate([[True], block[1:] != block[:-1]])
    new_value = new_block | np.concatenate([[True], y[1:] != y[:-1]])
    places = np.arange(len(y))
    block_start = np.maximum.accumulate(np.where(new_block, places, 0))
    value_start = np.maximum.accumulate(np.where(new_value, places, 0))
    return float(np.sum(right * (before[value_start] - before[block_start])))


def concordance_index(df: DataFrame, by: Sequence[str] = (), **cut) -> DataFrame:
    """Exact share of concordant pairs among pairs with different y; equal p counts half.

    Both axes are cut into buckets. Pairs in different buckets on both axes are counted
    from the bucket histogram; pairs sharing a p-bucket (and not a y-bucket) and pairs
    sharing a y-bucket are counted inside that bucket in O(n log n). A frequent value has
    a bucket of its own where every pair is a tie, so no bucket grows with the hot value.
    """
    wanted = list(by)
    df = df.withColumn("__all", F.lit(0))
    by = ["__all", *wanted]
    cells = df.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("w"))
    cells = value_buckets(cells, "y", "by_", by, **cut)
    # Written once: the counts below read it several times.
    cells = checkpointed(df.sparkSession, value_buckets(cells, "p", "bp_", by, **cut))
    out = "below double, tied double"
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in by] + [out])

    def inside(y: str, p: str):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            below, tied = _concordance(frame[y].to_numpy(), frame[p].to_numpy(), frame["w"].to_numpy())
            head = {name: [frame[name].iloc[0]] for name in by}
            return pd.DataFrame({**head, "below": [below], "tied": [tied]})
        return run

    # Odd buckets hold several values; even ones a single value.
    same_y = cells.where("by_ % 2 = 1").select(*by, "by_", "y", "p", "w")
    same_y = same_y.groupBy(*by, "by_").applyInPandas(inside("y", "p"), shape)
    coarse = cells.groupBy(*by, "bp_", "by_", "p").agg(F.sum("w").alias("w"))
    same_p = coarse.where("bp_ % 2 = 1").groupBy(*by, "bp_").applyInPandas(inside("by_", "p"), shape)
    # Histogram: at most (2 * buckets + 1)^2 cells per hot group, one for any other.
    grid = checkpointed(df.sparkSession, cells.groupBy(*by, "bp_", "by_").agg(F.sum(F.col("w").cast("double")).alias("w")))
    lower = Window.partitionBy(*by, "bp_").orderBy("by_").rowsBetween(Window.unboundedPreceding, -1)
    tied = grid.where("bp_ % 2 = 0").select(
        *by, F.lit(0.0).alias("below"), (F.col("w") * F.coalesce(F.sum("w").over(lower), F.lit(0.0))).alias("tied"))
    # Running weight along y inside each p-bucket, then summed over all lower p-buckets.
    tops = grid.groupBy(*by).agg(F.max("bp_").alias("top"))
    lattice = null_safe_join(grid.select(*by, "by_").distinct(), tops, by, "inner").select(
        *by, "by_", F.explode(F.sequence(F.lit(1), "top")).alias("bp_"))
    dense = null_safe_join(lattice, grid, [*by, "bp_", "by_"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    dense = dense.withColumn("col", F.coalesce(F.sum("w").over(lower), F.lit(0.0)))
    left = Window.partitionBy(*by, "by_").orderBy("bp_").rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.withColumn("quadrant", F.coalesce(F.sum("col").over(left), F.lit(0.0)))
    cross = dense.where("w > 0").select(*by, (F.col("w") * F.col("quadrant")).alias("below"), F.lit(0.0).alias("tied"))
    counted = same_y.unionByName(same_p).unionByName(tied).unionByName(cross)
    counted = counted.groupBy(*by).agg(F.sum("below").alias("below"), F.sum("tied").alias("tied"))
    sizes = df.groupBy(*by, "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    sizes = sizes.groupBy(*by).agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("comparable"))
    value = F.when(F.col("comparable") > 0, (F.col("below") + F.col("tied") / 2) / F.col("comparable"))
    return null_safe_join(sizes, counted, by, "left").select(*wanted, value.alias("ci"))


# --- binary ----------------------------------------------------------------------------


def binary_ranking(df: DataFrame, by: Sequence[str] = (), **cut) -> DataFrame:
    """``roc`` and ``prc`` per group from one ordering of the distinct scores.

    roc is the rank statistic with half credit for ties, NULL unless both classes occur.
    prc sums recall steps times precision over distinct thresholds, best score first, NULL
    without positives.
    """
    by = list(by)
    positive = F.col("y") == 1
    steps = df.groupBy(*by, "p").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    steps = running_totals(steps, ["p"], {"pos_before": F.col("pos"), "neg_before": F.col("neg")}, by, **cut)
    keyed = [*by, "__all"]
    sizes = df.withColumn("__all", F.lit(0)).groupBy(*keyed).agg(
        F.count_if(positive).alias("all_pos"), F.count_if(~positive).alias("all_neg"))
    steps = null_safe_join(steps.withColumn("__all", F.lit(0)), sizes, keyed, "inner")
    # Products of counts leave the range of a long on large inputs.
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # At a threshold everything at or above it counts: the totals minus what lies below.
    hits = F.col("all_pos") - F.col("pos_before")
    seen = hits + F.col("all_neg") - F.col("neg_before")
    sums = steps.groupBy(*keyed).agg(
        F.first("all_pos").cast("double").alias("all_pos"), F.first("all_neg").cast("double").alias("all_neg"),
        F.sum(pos * (F.col("neg_before") + neg / 2)).alias("wins"), F.sum(pos * hits / seen).alias("area"))
    both = F.col("all_pos") * F.col("all_neg")
    return sums.select(
        *by, F.when(both > 0, F.col("wins") / both).alias("roc"),
        F.when(F.col("all_pos") > 0, F.col("area") / F.col("all_pos")).alias("prc"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), **cut) -> DataFrame:
    return binary_ranking(df, by, **cut).drop("prc")


def average_precision(df: DataFrame, by: Sequence[str] = (), **cut) -> DataFrame:
    return binary_ranking(df, by, **cut).drop("roc")


def threshold_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall and f1 of p > threshold; an empty denominator gives 0."""
    hit, true = F.col("p") > threshold, F.col("y") == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return counts.select(
        *by, ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + fp).alias("precision"))


# --- multiclass ------------------------------------------------------------------------


def valid_classes(df: DataFrame, label: str, probs: str, n_classes: int) -> DataFrame:
    """Rows whose label is a known class, as ``label`` int and ``probs``."""
    return df.where(is_valid_class(F.col(label), n_classes)).select(
        F.col(label).cast("int").alias("label"), F.col(probs).alias("probs"))


def multiclass_ranking(df: DataFrame, n_classes: int) -> DataFrame:
    """One-vs-rest macro AUC and AP over ``label, probs``.

    AP skips classes without positives. When any class lacks positives or negatives both
    values are the undefined score.
    """
    long = df.select("label", F.posexplode("probs").alias("cls", "p")).select(
        "cls", (F.col("label") == F.col("cls")).cast("double").alias("y"), F.col("p").cast("double").alias("p"))
    per_class = binary_ranking(long, ["cls"])
    sums = per_class.agg(
        F.count("roc").alias("defined"), F.avg("roc").alias("roc"), F.avg("prc").alias("prc"))
    ok = F.col("defined") == n_classes
    return sums.select(
        F.when(ok, F.col("roc")).otherwise(F.lit(fv.UNDEFINED_SCORE)).alias("multiclass_roc"),
        F.when(ok, F.col("prc")).otherwise(F.lit(fv.UNDEFINED_SCORE)).alias("multiclass_prc"))


def multiclass_confusion(df: DataFrame) -> DataFrame:
    """accuracy, and macro f1 over the classes present in labels or predictions."""
    grid = df.groupBy("label", argmax(F.col("probs")).alias("hat")).agg(F.count(F.lit(1)).alias("c"))
    hit = F.col("label") == F.col("hat")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.when(hit, F.col("c")).otherwise(0).alias("tp"), F.col("c").alias("n")),
        F.struct(F.col("hat").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("c").alias("n")))
    per_class = grid.select(F.inline(sides)).groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    return per_class.agg(
        (F.sum("tp") / (F.sum("n") / 2)).alias("multiclass_accuracy"),
        F.avg(2 * F.col("tp") / F.col("n")).alias("macro_f1"))


# --- losses ----------------------------------------------------------------------------


def masked_mse(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    gap = F.col(y).cast("double") - F.col(p).cast("double")
    return df.agg(F.coalesce(F.avg(F.when(~missing(F.col(y)), gap * gap)), F.lit(0.0)).alias("masked_mse"))


def masked_ce(df: DataFrame, label: str, logits: str, negative_class: int = 1) -> DataFrame:
    """Softmax cross-entropy of known classes plus the binder likelihood of unknown effects."""
    known = ~missing(F.col(label)) & (F.col(label) != fv.UNKNOWN_EFFECT_LABEL)
    unknown = ~missing(F.col(label)) & (F.col(label) == fv.UNKNOWN_EFFECT_LABEL)
    ce = log_sum_exp(F.col(logits)) - F.get(F.col(logits), F.col(label).cast("int")).cast("double")
    held = df.select(label, logits, softmax(F.col(logits)).alias("__p"))
    others = F.filter("__p", lambda x, i: i != negative_class)
    mass = F.aggregate(others, F.lit(0.0), lambda s, x: s + x)
    mass = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.isnan(mass), F.lit(0.0)).otherwise(mass)))
    # The published loss floors the logarithm at -100.
    nll = -F.when(mass <= 0, F.lit(-100.0)).otherwise(F.greatest(F.lit(-100.0), F.log(mass)))
    return held.agg(
        (F.coalesce(F.avg(F.when(known, ce)), F.lit(0.0)) + F.coalesce(F.avg(F.when(unknown, nll)), F.lit(0.0)))
        .alias("masked_ce"))


def bce_logits(df: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    return df.agg(F.avg(bce_with_logits(F.col(x).cast("double"), F.col(y).cast("double"))).alias("bce"))


# --- reports ---------------------------------------------------------------------------


def to_long(row: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row metric table to (metric, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return row.select(F.inline(pairs))


def regression_report(df: DataFrame) -> DataFrame:
    parts = [to_long(error_metrics(df), ["mse", "rmse", "mae", "sd", "pearson", "rm2"]),
             to_long(spearman(df), ["spearman"]), to_long(concordance_index(df), ["ci"])]
    return _union(parts)


def binary_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    parts = [to_long(binary_ranking(df), ["roc", "prc"]),
             to_long(threshold_metrics(df, threshold), ["f1", "recall", "precision"])]
    return _union(parts)


def multiclass_report(df: DataFrame, n_classes: int) -> DataFrame:
    parts = [to_long(multiclass_ranking(df, n_classes), ["multiclass_roc", "multiclass_prc"]),
             to_long(multiclass_confusion(df), ["multiclass_accuracy", "macro_f1"])]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(regression: DataFrame | None = None, binary: DataFrame | None = None,
             multiclass: DataFrame | None = None, n_classes: int = 3, threshold: float = 0.5,
             digits: int | None = None) -> DataFrame:
    """Metrics of the heads that exist, as (metric, value); losses are means over rows.

    ``regression`` and ``binary`` have ``y, p``; ``multiclass`` has ``label, probs``. With a column
    ``logit`` or ``logits`` next to them the losses ``bce`` and ``masked_ce`` are reported too.
    """
    parts = []
    if regression is not None:
        parts += [regression_report(labelled(regression)), to_long(masked_mse(regression), ["masked_mse"])]
    if binary is not None:
        parts.append(binary_report(labelled(binary), threshold))
        if "logit" in binary.columns:
            parts.append(to_long(bce_logits(binary.where(~missing(F.col("y"))), "y", "logit"), ["bce"]))
    if multiclass is not None:
        parts.append(multiclass_report(valid_classes(multiclass, "label", "probs", n_classes), n_classes))
        if "logits" in multiclass.columns:
            parts.append(to_long(masked_ce(multiclass, "label", "logits"), ["masked_ce"]))
    if not parts:
        raise ValueError("nothing to evaluate: no head given")
    report = _union(parts)
    return report if digits is None else report.withColumn("value", F.round("value", digits))


def metrics_by_stratum(predictions: DataFrame, covariate: DataFrame, key: str, stratum: Column) -> DataFrame:
    """Error metrics per bucket of a per-id covariate."""
    joined = predictions.join(covariate, key).withColumn("stratum", stratum)
    return error_metrics(labelled(joined, by=["stratum"]), ["stratum"])


def best_checkpoint(log: DataFrame) -> DataFrame:
    """First best step per (run, metric): errors are minimised, all else maximised."""
    signed = F.when(F.col("metric").isin("rmse", "mse", "mae"), F.col("value")).otherwise(-F.col("value"))
    usable = log.where(~missing(F.col("value")))
    best = F.min(F.struct(signed.alias("s"), F.col("step"), F.col("value")))
    return usable.groupBy("run", "metric").agg(best.alias("b")).select("run", "metric", "b.step", "b.value")


def element_score_check(left: DataFrame, right: DataFrame, digits: int = 2) -> DataFrame:
    """Element symbols whose score sets differ between two tables (``symbol, score``)."""

    def sets(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select(F.upper("symbol").alias("symbol"), F.round("score", digits).alias("score")).distinct()
        return distinct.withColumn(name, F.lit(True))

    # Sets are compared member by member; only those of differing symbols are listed.
    members = sets(left, "in_left").join(sets(right, "in_right"), ["symbol", "score"], "full")
    odd = members.groupBy("symbol").agg(F.count("in_left").alias("l"), F.count("in_right").alias("r"), F.count(F.lit(1)).alias("n"))
    odd = odd.where("l < n OR r < n").select("symbol", "l", "r")
    listed = members.join(odd, "symbol").groupBy("symbol", "l", "r").agg(
        *[F.array_sort(F.collect_list(F.when(F.col(f"in_{side}"), F.col("score")))).alias(f"{side}_values") for side in ("left", "right")])
    return listed.select("symbol", *[F.when(F.col(n) > 0, F.col(f"{side}_values")).alias(f"{side}_scores") for n, side in (("l", "left"), ("r", "right"))])


def selectivity_profile(scores: DataFrame, targets: Sequence[str], ligand: str = "ligand", target: str = "target",
                        affinity: str = "affinity", active_at: float = 6.0) -> DataFrame:
    """Affinity per target side by side, best target, gap to the next best, number of active targets."""
    best = scores.groupBy(ligand, target).agg(F.max(affinity).alias("a"))
    wide = best.groupBy(ligand).pivot(target, list(targets)).agg(F.first("a"))
    listed = F.filter(
        F.array(*[F.struct(F.col(f"`{t}`").alias("a"), F.lit(t).alias("t")) for t in targets]),
        lambda s: s["a"].isNotNull())
    ordered = F.array_sort(listed, lambda l, r: F.when(l["a"] > r["a"], -1).when(l["a"] < r["a"], 1)
                           .when(l["t"] < r["t"], -1).when(l["t"] > r["t"], 1).otherwise(0))
    held = wide.withColumn("__o", ordered)
    first, second = F.get("__o", F.lit(0)), F.get("__o", F.lit(1))
    return held.select(
        ligand, *[F.col(f"`{t}`") for t in targets],
        first["t"].alias("best_target"), (first["a"] - second["a"]).alias("gap"),
        F.size(F.filter("__o", lambda s: s["a"] >= active_at)).alias("active_targets"))


def export_predictions(predictions: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truth next to prediction per pair; pairs without a label keep NULL truth."""
    return predictions.join(labels, list(keys), "left")
