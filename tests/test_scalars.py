import math

import pytest
from pyspark.sql import functions as F

from pairspark.functions import chemistry, numeric, text, vectors
from pairspark.operators.screening import Heads


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("raw, safe", [("sp|X|Y", "sp_X_Y"), ("a/b\\c:d*e?f\"g<h>i", "a_b_c_d_e_f_g_h_i"), ("P12", "P12"), ("a.b", "a.b")])
def test_safe_id(spark, raw, safe):
    assert one(spark, text.safe_id(F.col("x")), x=raw) == safe


@pytest.mark.parametrize("raw", ["../a", ".", "", "..", "..."])
def test_unsafe_ids_are_rejected(spark, raw):
    with pytest.raises(Exception, match="unsafe id"):
        one(spark, text.safe_id(F.col("x")), x=raw)
    assert one(spark, text.safe_id(F.col("x"), strict=False), x=raw) is None


def test_keys_are_stable_and_64_long(spark):
    a = one(spark, text.sha_key(F.col("x")), x="CCO")
    assert len(a) == 64 and a == one(spark, text.sha_key(F.col("x")), x="CCO") and a != one(spark, text.sha_key(F.col("x")), x="CCC")
    assert one(spark, text.pair_key(F.lit("A|B"), F.col("x")), x="CCO") == "A_B__" + a


def test_sequence_cleaning(spark):
    assert one(spark, text.clean_sequence(F.col("x")), x="MKUBOJZx*") == "MKXXXXXXX"
    assert one(spark, text.clean_sequence(F.col("x"), "basic"), x="MKUBX") == "MKXXX"
    with pytest.raises(Exception, match="outside the residue alphabet"):
        one(spark, text.clean_sequence(F.col("x"), "basic"), x="MKJ")


def test_complex_strings(spark):
    assert one(spark, text.clean_complex(F.col("x")), x="/mkt//aa:1:") == "MKT:AA"
    for chains, mode in (("AA", "mono"), ("AA:AA", "homo"), ("AA:AC:AA", "hetero")):
        assert one(spark, text.complex_mode(F.col("x")), x=chains) == mode


def test_encoders(spark):
    assert one(spark, vectors.one_hot(F.col("x"), ["a", "b"], "zero"), x="c") == [0, 0]
    assert one(spark, vectors.one_hot(F.col("x"), ["a", "b"], "last"), x="c") == [0, 1]
    with pytest.raises(Exception, match="outside the vocabulary"):
        one(spark, vectors.one_hot(F.col("x"), ["a", "b"]), x="c")
    with pytest.raises(Exception, match="outside the vocabulary"):
        one(spark, chemistry.atom_features(F.col("x"), *[F.lit(0)] * 2, F.lit("SP"), F.lit(True), F.lit("R"), F.lit(False)), x=11)


def test_atom_features_absent_cip(spark):
    flags = one(spark, chemistry.atom_features(F.col("x"), F.lit(12), F.lit(99), F.lit("Q"), F.lit(True), F.lit(None).cast("string"), F.lit(True)), x=0)
    assert len(flags) == 43 and flags[0] == 1 and flags[21] == 1 and flags[32] == 1 and flags[38] == 1
    assert flags[39:] == [1, 0, 0, 1]


def test_residue_vector(spark):
    v = one(spark, chemistry.residue_features(F.col("x")), x="X")
    assert len(v) == 33 and v[20] == 1.0 and v[21:26] == [0.0] * 5
    assert v[26] == pytest.approx((57.05 + 186.22) / 2)  # raw mid-range, not scaled
    assert one(spark, chemistry.residue_features(F.col("x")), x="G")[26] == 0.0


def test_activations(spark):
    p = one(spark, vectors.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.col("x"))), x=-1000.0)
    assert p == [0.5, 0.5, 0.0]
    assert one(spark, vectors.argmax(F.array(F.col("x"), F.lit(2.0), F.lit(2.0))), x=1.0) == 1
    assert one(spark, vectors.sigmoid(F.col("x")), x=0.0) == 0.5
    r = one(spark, vectors.rbf(F.col("x"), 0, 20, 16), x=25.0)
    assert len(r) == 16 and r[-1] == 1.0


def test_numbers(spark):
    assert one(spark, numeric.angle(F.col("x"), F.lit(1.0), F.lit(5.0)), x=1.0) == pytest.approx(math.pi)
    assert one(spark, numeric.score_for_display(F.col("x")), x=1.0) == 0.99
    assert one(spark, numeric.score_for_display(F.col("x")), x=0.0) == 0.01
    assert one(spark, numeric.display_size(F.col("x")), x=12.0) == 68.0
    assert one(spark, numeric.missing(F.col("x")), x=float("nan")) is True


def test_heads():
    with pytest.raises(ValueError):
        Heads(False, False, False)
    assert Heads().selection_metric == "rmse"
    assert Heads(False, True).selection_metric == "roc" and Heads(False, False, True).selection_metric == "macro_f1"
    assert Heads(True, True, True).score_columns()[-1] == "predicted_nonbinder"


def test_table_functions_in_sql(spark):
    from pairspark.functions.table_functions import register_table_functions

    assert register_table_functions(spark) == ["sliding_windows", "best_rows", "batches"]
    spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 0.5)], "k string, v double").createOrReplaceTempView("few_rows")
    best = spark.sql("SELECT * FROM best_rows(TABLE(few_rows) PARTITION BY k ORDER BY (v DESC), 2)").collect()
    assert sorted((r["k"] or "", r["v"], r["rank"]) for r in best) == [("", 0.5, 1), ("a", 2.0, 2), ("a", 3.0, 1), ("b", 5.0, 1)]
    cut = spark.sql("SELECT * FROM batches(TABLE(few_rows) PARTITION BY k ORDER BY (v), 2)").collect()
    assert sorted((r["k"] or "", r["v"], r["batch_no"]) for r in cut) == [("", 0.5, 0), ("a", 1.0, 0), ("a", 2.0, 0), ("a", 3.0, 1), ("b", 5.0, 0)]
    parts = spark.sql("SELECT w.* FROM VALUES ('abcdefg'), (''), (NULL) AS t(x), LATERAL sliding_windows(x, 4, 2) AS w").collect()
    assert sorted((r["chunk_start"], r["chunk"]) for r in parts) == [(0, ""), (0, "abcd"), (2, "cdef"), (4, "efg")]


def test_best_rows_passes_over_the_rest_of_a_key():
    from pyspark.sql.functions import SkipRestOfInputTableException

    from pairspark.functions.table_functions import BestRows

    best = BestRows()
    assert [list(best.eval((v,), 2)) for v in "ab"] == [[("a", 1)], [("b", 2)]]
    with pytest.raises(SkipRestOfInputTableException):
        list(best.eval(("c",), 2))
