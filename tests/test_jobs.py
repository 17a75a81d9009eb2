import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairspark.functions.sql import register_functions, register_tables
from pairspark.__main__ import main
from pairspark.operators import screening
from pairspark.operators.metrics import evaluate
from pairspark.operators.screening import Heads
from pairspark.plans.jobs import PairScoring, Screening, evaluate_folder, run_screening, score_pair_list, write_splits
from pairspark.session import fresh_dir
from pairspark.sources.files import read_pairs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def featurize_ligand(text):
    if "!" in text:
        raise ValueError("cannot featurize")
    return [float(len(text)), 1.0]


def make_scorer():
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        dots = [sum(a * b for a, b in zip(p, q)) for p, q in zip(batch["protein_feature"], batch["ligand_feature"])]
        return pd.DataFrame({"regression": dots, "class_logit": dots})
    return score


def explain(survivors):
    letters = survivors.select("protein_id", "smiles", F.posexplode(F.split("sequence", "")).alias("pos", "aa"))
    return letters.withColumn("raw", F.ascii("aa").cast("double"))


@pytest.fixture
def job(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">P:1 x\nMKT\n>P2\nAA\n")
    (tmp_path / "l.csv").write_text("id,SMILES\n1,CCO\n2,cco\n3,CCCC\n4,C!\n5,C\n")
    return Screening(str(tmp_path / "p.fasta"), str(tmp_path / "l.csv"), fresh_dir(spark, "out"), fresh_dir(spark, "cache"),
                     lambda s: [float(len(s)), 0.5], featurize_ligand, make_scorer, heads=Heads(True, True))


def scores(spark, job):
    return spark.read.option("header", True).csv(job.output).collect()


def test_full_screen_counts_and_fans_out_aliases(spark, job):
    counters = run_screening(spark, job)
    assert counters == {"proteins": 2, "ligands": 5, "pairs": 10, "unparsed": 0, "ligand_misses": 4, "ligand_failed": 1,
                        "protein_misses": 2, "protein_failed": 0}
    rows = scores(spark, job)
    assert len(rows) == 8  # the failed ligand is left out, both spellings of one form are kept
    assert [r["protein_id"] for r in rows] == ["P2"] * 4 + ["P:1"] * 4 or [r["protein_id"] for r in rows] == ["P:1"] * 4 + ["P2"] * 4
    best = {r["smiles"]: float(r["prediction"]) for r in rows if r["protein_id"] == "P:1"}
    assert best == {"CCCC": 12.5, "CCO": 9.5, "cco": 9.5, "C": 3.5}
    again = run_screening(spark, job)
    assert again["ligand_misses"] == 1 and again["protein_misses"] == 0  # only the failure is tried again


def test_top_k_screen_with_interpretation(spark, job):
    job.top_k, job.explain, job.interpretation = 2, explain, fresh_dir(spark, "interpretation")
    run_screening(spark, job)
    rows = [(r["protein_id"], r["smiles"]) for r in scores(spark, job)]
    assert sorted(rows) == [("P2", "CCCC"), ("P2", "CCO"), ("P:1", "CCCC"), ("P:1", "CCO")]
    residues = spark.read.parquet(f"{job.interpretation}/pairs")
    assert residues.count() == 2 * 3 + 2 * 2
    assert {r[0] for r in residues.select("protein_id").distinct().collect()} == {"P_1", "P2"}
    assert residues.where("residue_score < 0 OR residue_score > 1").count() == 0


@pytest.mark.parametrize("k", [None, 2])
def test_every_pair_and_form_is_worked_out_once(spark, job, k):
    pairs, forms = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting_scorer():
        score = make_scorer()

        def run(batch):
            pairs.add(len(batch))
            return score(batch)
        return run

    def canonical(text):
        forms.add(1)
        return text.lower()

    job.make_scorer, job.canonical, job.top_k = counting_scorer, canonical, k
    if k:
        job.explain, job.interpretation = explain, fresh_dir(spark, "interpretation")
    run_screening(spark, job)
    assert pairs.value == 2 * 3 and forms.value == 5


def test_unsafe_ids_fail_in_sql_too(spark):
    register_functions(spark)
    assert spark.sql("SELECT safe_id('a/b') AS x").first()["x"] == "a_b"
    for bad in ("..", "a..b", "."):
        with pytest.raises(Exception, match="unsafe id"):
            spark.sql(f"SELECT safe_id('{bad}') AS x").collect()


def test_screen_beyond_the_pair_limit_needs_top_k(spark, job):
    job.max_pairs = 9
    with pytest.raises(ValueError, match="top-K"):
        run_screening(spark, job)


@pytest.mark.parametrize("kind, column", [("random", "ID"), ("group", "Ligand"), ("cold", "Protein")])
def test_written_splits_read_back_as_pairs(spark, kind, column):
    pairs = spark.range(600).selectExpr("CAST(id AS STRING) AS ID", "concat('P', id % 60) AS Protein", "concat('L', id % 37) AS Ligand", "id / 7 AS regression_label")
    folder = fresh_dir(spark, "splits")
    ratios = {r["split"]: r["ratio"] for r in write_splits(pairs, folder, kind, column, [0.7, 0.1, 0.2], 8).collect()}
    assert set(ratios) == {"train", "valid", "test"} and sum(ratios.values()) == pytest.approx(1.0)
    assert read_pairs(spark, folder).count() == 600


def test_sql_functions_and_views(spark):
    names = register_functions(spark)
    register_tables(pairs=spark.createDataFrame([("a|b", "CC", "MKU", 301)], "protein string, ligand string, seq string, n long"))
    row = spark.sql("SELECT safe_id(protein) AS s, length(pair_key(protein, ligand)) AS k, clean_sequence(seq) AS c, "
                    "length_bin(n) AS b, sigmoid(0) AS g, dot_product(array(1D, 2D), array(3D, 4D)) AS d FROM pairs").first()
    assert tuple(row) == ("a_b", 69, "MKX", "medium_500", 0.5, 11.0)
    assert "edge_angle" in names


def protein_features(text):
    return [float(len(text)), 0.5]


ligand_features = featurize_ligand


def pair_job(spark, heads=Heads(), scorer=make_scorer):
    return PairScoring(fresh_dir(spark, "cache"), protein_features, ligand_features, scorer, heads=heads)


def read_csv(spark, path):
    return spark.read.option("header", True).csv(path)


def test_given_pairs_keep_rows_columns_and_order(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text("ID,Protein,Ligand,note\n,MKT,CCO,a\nx1,MKT,CCO,b\n,AA,C!,c\n,,C,d\n,AA,,e\n")
    scored = spark.sparkContext.accumulator(0)

    def counting_scorer():
        score = make_scorer()

        def run(batch):
            scored.add(len(batch))
            return score(batch)
        return run

    counters = score_pair_list(spark, str(tmp_path / "pairs.csv"), str(tmp_path / "out"), pair_job(spark, scorer=counting_scorer))
    assert counters == {"pairs": 5, "scored": 2, "unscored": 3} and scored.value == 1
    rows = {r["note"]: (r["ID"], r["prediction"]) for r in read_csv(spark, str(tmp_path / "out")).collect()}
    assert rows == {"a": ("PAIR_0", "9.5"), "b": ("x1", "9.5"), "c": ("PAIR_2", None), "d": ("PAIR_3", None), "e": ("PAIR_4", None)}


def test_pair_list_may_be_empty_but_not_hold_scores(spark, tmp_path):
    (tmp_path / "none.csv").write_text("Protein,Ligand\n")
    assert score_pair_list(spark, str(tmp_path / "none.csv"), str(tmp_path / "out"), pair_job(spark)) == {"pairs": 0, "scored": 0, "unscored": 0}
    (tmp_path / "named.csv").write_text("Protein,Ligand,prediction\nMK,CC,1\n")
    with pytest.raises(ValueError, match="prediction"):
        score_pair_list(spark, str(tmp_path / "named.csv"), str(tmp_path / "out"), pair_job(spark))


def data_folder(path):
    path.mkdir()
    (path / "train.csv").write_text("Protein,Ligand,regression_label,w,a.b\nMK,CC,1,0.5,u\nMK,C,2,NaN,v\n")
    (path / "test.csv").write_text("Protein,Ligand,regression_label,classification_label\nMK,CC,5,1\nMK,CCC,6,0\nMKT,C,4,1\nMKT,C!,4,1\n")
    return str(path)


def test_data_folder_is_scored_and_evaluated(spark, tmp_path):
    folder = data_folder(tmp_path / "data")
    report = evaluate_folder(spark, folder, str(tmp_path / "out"), pair_job(spark, Heads(True, True)))
    found = {r["metric"]: r["value"] for r in report.collect()}
    # Scores are 4.5, 6.5 and 3.5; the last pair has none.
    assert found["mae"] == pytest.approx(0.5) and found["ci"] == 1.0 and found["roc"] == 0.0
    assert read_csv(spark, f"{tmp_path}/out/predictions.csv").count() == 4
    assert read_csv(spark, f"{tmp_path}/out/metrics.csv").count() == len(found)


def test_pairs_keep_other_columns_and_weights(spark, tmp_path):
    pairs = read_pairs(spark, data_folder(tmp_path / "data"), sampling_col="w")
    rows = {r["Ligand"]: (r["w"], r["a.b"]) for r in pairs.where("split = 'train'").collect()}
    assert rows == {"CC": (0.5, "u"), "C": (None, "v")}
    with pytest.raises(ValueError, match="no column"):
        read_pairs(spark, str(tmp_path / "data"), sampling_col="nothing")


def test_losses_are_reported_where_logits_are_given(spark):
    binary = spark.createDataFrame([(1.0, 0.5, 0.0), (0.0, 0.5, 0.0), (None, 0.5, 9.0)], "y double, p double, logit double")
    found = {r["metric"]: r["value"] for r in evaluate(binary=binary).collect()}
    assert found["bce"] == pytest.approx(0.6931471805599453)


def test_command_line(spark, tmp_path, capsys):
    data = data_folder(tmp_path / "data")
    model = ["--model", __name__, "--cache", str(tmp_path / "cache")]
    (tmp_path / "p.fasta").write_text(">P1\nMKT\n")
    (tmp_path / "l.csv").write_text("smiles\nCC\nC\n")
    runs = [["score", "--pairs", f"{data}/test.csv", *model], ["evaluate", "--data", data, *model],
            ["screen", "--fasta", str(tmp_path / "p.fasta"), "--ligands", str(tmp_path / "l.csv"), "--top-k", "1", *model],
            ["split", "--pairs", f"{data}/test.csv", "--kind", "group", "--column", "Ligand", "--fractions", "0.5", "0.5", "0"]]
    for i, arguments in enumerate(runs):
        assert main([*arguments, "--output", str(tmp_path / f"out{i}")], spark) == 0
    printed = capsys.readouterr().out
    assert '"scored": 3' in printed and '"mae": 0.5' in printed and '"pairs": 2' in printed
    assert read_csv(spark, str(tmp_path / "out2")).count() == 1


def test_rows_of_a_pair_list_are_numbered_in_order_of_the_file_without_a_sort(spark, tmp_path, monkeypatch):
    def sort(*args, **kwargs):
        raise AssertionError("rows are sorted")

    monkeypatch.setattr(screening, "global_row_number", sort)
    lines = [f"MKT,{'C' * (i % 5 + 1)},{i}" for i in range(300)]
    (tmp_path / "pairs.csv").write_text("\n".join(["Protein,Ligand,my note (x)", *lines]) + "\n")
    assert score_pair_list(spark, str(tmp_path / "pairs.csv"), str(tmp_path / "out"), pair_job(spark)) == {"pairs": 300, "scored": 300, "unscored": 0}
    rows = read_csv(spark, str(tmp_path / "out")).collect()
    assert {(r["ID"], r["my note (x)"], r["prediction"]) for r in rows} == {(f"PAIR_{i}", str(i), str(3.0 * (i % 5 + 1) + 0.5)) for i in range(300)}
