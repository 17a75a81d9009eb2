"""Export of scored pairs: truth and prediction of every head with all explanations, and the metrics.

One row per prediction, one struct per head, one struct with everything that explains the pair. The
element tables (residues, atoms, cliques, one row per element) are put under each other and folded
by pair in one aggregation, so the export costs one shuffle of the elements whatever their kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics

#: Heads of a model and the type of their prediction and truth.
HEADS = {"regression": ("double", "double"), "classification": ("double", "double"), "multiclass": ("array<double>", "double")}

#: What explains a pair by elements: the table's name, its column and whether an element has a list.
ELEMENTS = {
    "residue_score": ("residues", "score", False), "residue_layer": ("residues", "layers", True),
    "atom_score": ("atoms", "score", False), "clique_layer": ("cliques", "layers", True),
}

#: What explains a pair as a whole.
VECTORS = ("mol_feature", "prot_feature", "interaction_fingerprint")


def _folded(keys: Sequence[str], tables: Mapping[str, DataFrame | None]) -> DataFrame | None:
    """``keys`` and one array per explanation, in order of ``position``; the elements of a pair form one row."""
    long = None
    for name, (source, column, listed) in ELEMENTS.items():
        elements = tables.get(source)
        if elements is None or column not in elements.columns:
            continue
        value = F.col(column).cast("array<double>") if listed else F.array(F.col(column).cast("double"))
        part = elements.select(*keys, F.lit(name).alias("__kind"), F.struct(F.col("position").cast("long").alias("at"), value.alias("v")).alias("__e"))
        long = part if long is None else long.unionByName(part)
    if long is None:
        return None

    def folded(name: str, listed: bool) -> Column:
        # Equal positions are ordered by their values.
        own = F.sort_array(F.collect_list(F.when(F.col("__kind") == name, F.col("__e"))))
        return F.transform(own, lambda e: e["v"] if listed else F.get(e["v"], F.lit(0))).alias(name)

    return long.groupBy(*keys).agg(*[folded(name, listed) for name, (_, _, listed) in ELEMENTS.items()])


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"__{k}"])
    return left.join(renamed, match, "left").drop(*[f"__{k}" for k in keys])


def prediction_bundle(predictions: DataFrame, keys: Sequence[str], labels: DataFrame | None = None,
                      residues: DataFrame | None = None, atoms: DataFrame | None = None,
                      cliques: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """``keys``, a struct ``truth, prediction`` per head, and ``explanation``.

    ``predictions`` has ``<head>_prediction`` columns, ``labels`` has ``<head>_truth`` columns, one
    row per pair. ``residues`` and ``atoms`` have ``position, score``, ``residues`` and ``cliques``
    ``position, layers``; ``vectors`` has the arrays of :data:`VECTORS`, one row per pair. Whatever is missing
    becomes null or, for elements, an empty array. A truth that is NaN is a missing one. Pairs without labels
    or explanations stay; repeated predictions stay and share them.
    """
    out = predictions
    if labels is not None:
        out = _on(out, labels, keys)
    heads = []
    for head, (predicted, true) in HEADS.items():
        prediction, truth = (F.col(f"{head}_{side}").cast(kind) if f"{head}_{side}" in out.columns else F.lit(None).cast(kind)
                             for side, kind in (("prediction", predicted), ("truth", true)))
        heads.append(F.struct(F.when(~F.isnan(truth), truth).alias("truth"), prediction.alias("prediction")).alias(head))
    out = out.select(*keys, *heads)
    folded = _folded(keys, {"residues": residues, "atoms": atoms, "cliques": cliques})
    if folded is not None:
        out = _on(out, folded, keys)
    if vectors is not None:
        out = _on(out, vectors.select(*keys, *[c for c in VECTORS if c in vectors.columns]), keys)
    explained = []
    for name, (_, _, listed) in ELEMENTS.items():
        kind = "array<array<double>>" if listed else "array<double>"
        explained.append(F.coalesce(F.col(name), F.array().cast(kind)).alias(name) if name in out.columns else F.array().cast(kind).alias(name))
    explained += [F.col(c).cast("array<double>").alias(c) if c in out.columns else F.lit(None).cast("array<double>").alias(c) for c in VECTORS]
    return out.select(*keys, *HEADS, F.struct(*explained).alias("explanation"))


def bundle_families(bundle: DataFrame, n_classes: int = 3, threshold: float = 0.5) -> dict[str, Callable[[], DataFrame]]:
    """The metric families of a bundle, by head; heads without a prediction take no part in them."""
    def pairs(head: str) -> DataFrame:
        return bundle.where(F.col(f"{head}.prediction").isNotNull()).select(F.col(f"{head}.truth").alias("y"), F.col(f"{head}.prediction").alias("p"))

    def multiclass() -> DataFrame:
        rows = pairs("multiclass").select(F.col("y").cast("int").alias("label"), F.col("p").alias("probs"))
        return metrics.multiclass_report(metrics.valid_classes(rows, "label", "probs", n_classes), n_classes)

    return {
        "regression": lambda: metrics.regression_report(metrics.labelled(pairs("regression"))),
        "classification": lambda: metrics.binary_report(metrics.labelled(pairs("classification")), threshold),
        "multiclass": multiclass,
    }


def isolated_report(spark: SparkSession, families: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """``family, metric, value, error``: every family is run for itself, and one that fails leaves its error.

    A family is a callable that gives a table ``metric, value``, of which a few rows come to the
    driver. A family that fails has one row with a null metric; the others are not touched.
    """
    rows = []
    for name, family in families.items():
        try:
            rows += [(name, r["metric"], r["value"], None) for r in family().collect()]
        except Exception as exc:  # metrics are best effort
            rows.append((name, None, None, str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__))
    return spark.createDataFrame(rows, "family string, metric string, value double, error string")


def write_bundle(bundle: DataFrame, path: str, n_classes: int = 3, threshold: float = 0.5) -> DataFrame:
    """Write the pairs and the metrics below ``path``; returns the metrics. The pairs are written first and the metrics are taken from them."""
    spark = bundle.sparkSession
    bundle.write.mode("overwrite").parquet(f"{path}/pairs")
    written = spark.read.schema(bundle.schema).parquet(f"{path}/pairs")
    report = isolated_report(spark, bundle_families(written, n_classes, threshold))
    report.write.mode("overwrite").parquet(f"{path}/metrics")
    return report
