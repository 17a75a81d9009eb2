"""The prediction bundle: every head, every explanation, metrics that fail alone."""

import math

from pyspark.sql import functions as F

from pairspark.operators import export
from pairspark.session import fresh_dir


def tables(spark):
    predictions = spark.createDataFrame(
        [("p", "a", 1.5, 0.9, [0.1, 0.2, 0.7]), ("p", "a", 1.5, 0.9, [0.1, 0.2, 0.7]), ("p", "b", 2.0, 0.2, [0.6, 0.3, 0.1]), ("q", None, 3.0, 0.4, None), ("z", "z", 4.0, 0.8, [0.1, 0.8, 0.1])],
        "protein string, ligand string, regression_prediction double, classification_prediction double, multiclass_prediction array<double>")
    labels = spark.createDataFrame([("p", "a", 1.0, 1, 2), ("p", "b", float("nan"), 0, 0), ("q", None, 5.0, 1, None)], "protein string, ligand string, regression_truth double, classification_truth int, multiclass_truth int")
    residues = spark.createDataFrame([("p", "a", 1, 0.5, [1.0, 2.0]), ("p", "a", 0, 0.25, [3.0, 4.0]), ("q", None, 0, 1.0, None), ("other", "x", 0, 1.0, None)], "protein string, ligand string, position int, score double, layers array<double>")
    atoms = spark.createDataFrame([("p", "b", 2, 0.1), ("p", "b", 0, 0.3), ("p", "b", 2, 0.05)], "protein string, ligand string, position int, score double")
    vectors = spark.createDataFrame([("p", "a", [1.0], [2.0, 3.0])], "protein string, ligand string, mol_feature array<double>, interaction_fingerprint array<double>")
    return predictions, labels, residues, atoms, vectors


KEYS = ["protein", "ligand"]


def test_bundle_holds_all_heads_and_explanations(spark):
    predictions, labels, residues, atoms, vectors = tables(spark)
    rows = export.prediction_bundle(predictions, KEYS, labels, residues, atoms, None, vectors).collect()
    by = {(r["protein"], r["ligand"]): r for r in rows}
    assert len(rows) == 5 and len(by) == 4
    a, b, q, z = by["p", "a"], by["p", "b"], by["q", None], by["z", "z"]
    assert tuple(a["regression"]) == (1.0, 1.5) and tuple(a["classification"]) == (1.0, 0.9) and a["multiclass"]["truth"] == 2.0
    assert b["regression"]["truth"] is None and tuple(z["regression"]) == (None, 4.0) and q["multiclass"]["prediction"] is None
    assert a["explanation"]["residue_score"] == [0.25, 0.5] and a["explanation"]["residue_layer"] == [[3.0, 4.0], [1.0, 2.0]]
    assert b["explanation"]["atom_score"] == [0.3, 0.05, 0.1] and a["explanation"]["clique_layer"] == []
    assert q["explanation"]["residue_score"] == [1.0] and q["explanation"]["residue_layer"] == [None]
    assert a["explanation"]["mol_feature"] == [1.0] and a["explanation"]["prot_feature"] is None and z["explanation"]["mol_feature"] is None


def test_bundle_of_predictions_alone(spark):
    (row,) = export.prediction_bundle(spark.createDataFrame([("p", "a", 1.0)], "protein string, ligand string, regression_prediction double"), KEYS).collect()
    assert tuple(row["regression"]) == (None, 1.0) and tuple(row["classification"]) == (None, None) and row["explanation"]["atom_score"] == []
    assert export.prediction_bundle(spark.createDataFrame([], "protein string, ligand string"), KEYS).collect() == []


def test_a_failing_family_leaves_the_others(spark):
    predictions, labels, *_ = tables(spark)
    bundle = export.prediction_bundle(predictions, KEYS, labels)
    families = export.bundle_families(bundle)
    broken = bundle.select(F.raise_error(F.lit("no such score")).cast("double").alias("value"), F.lit("x").alias("metric"))
    report = export.isolated_report(spark, {**families, "multiclass": lambda: broken, "python": lambda: 1 / 0})
    rows = {(r["family"], r["metric"]): r for r in report.collect()}
    assert math.isclose(rows["regression", "mse"]["value"], (2 * 0.25 + 4.0) / 3)
    assert rows["classification", "precision"]["value"] == 1.0
    assert "no such score" in rows["multiclass", None]["error"] and "division" in rows["python", None]["error"]
    assert all(r["error"] is None for (f, m), r in rows.items() if m)


def test_written_bundle(spark):
    predictions, labels, residues, *_ = tables(spark)
    path = fresh_dir(spark, "bundle")
    report = export.write_bundle(export.prediction_bundle(predictions, KEYS, labels, residues), path)
    assert spark.read.parquet(f"{path}/pairs").count() == 5
    assert spark.read.parquet(f"{path}/metrics").count() == report.count() > 10
