"""Texts of every kind as sequences; where the letters are taken."""

import re

import pytest
from pyspark.sql import functions as F

from pairspark.plans import catalog, views

TEXTS = ["", None, "Jo, Zoé: 12 AB!", "ABCé中\U0001f600xu\t\n\r\x00\x1f\x7f", "ozj OZJ", "".join(map(chr, range(1, 400)))]


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_sequences_hold_the_letters_of_the_pattern(spark, folder):
    got = {r["doc_id"]: r["seq"] for r in views.sequences(spark, folder).collect()}
    assert got == {i: None if t is None else re.sub(views.SEQ_PATTERN, "", t).upper() for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", ["residue_features", "merge_overlaps"])
def test_letters_are_taken_once_and_after_the_dealing(spark, folder, name):
    plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_replace(" not in plan[plan.index("Repartition"):]


def test_residues_of_a_text_are_counted_once(spark, folder):
    plan = catalog.QUERIES["residue_features"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(seq") == 21
    counts = {r["doc_id"]: (r["residues"], r["unknown"]) for r in catalog.QUERIES["residue_features"](spark, folder).collect()}
    letters = {i: re.sub(views.SEQ_PATTERN, "", t).upper() for i, t in enumerate(TEXTS) if t}
    assert counts == {i: (len(s), sum(s.count(c) for c in "UBX")) for i, s in letters.items() if s}


def test_texts_of_one_row_group_are_dealt_out(spark, tmp_path):
    """Many splits of one row group are one task's rows."""
    spark.range(4000).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), 20) AS text").coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        docs = views.sequences(spark, str(tmp_path))
        assert docs.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
