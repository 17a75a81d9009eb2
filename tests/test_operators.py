import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairspark.functions import fixed_values as fv
from pairspark.operators import components, featurize, graph, metrics, ordering, screening, splits, windows
from pairspark.plans import graph_queries
from pairspark.session import fresh_dir, stored


@pytest.fixture
def small_hot(monkeypatch):
    """Treat groups above a few rows as hot, so that their bucketed way runs."""
    monkeypatch.setattr(ordering, "HOT_ROWS", 20)


def skewed(n=6000, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "g": np.where(rng.random(n) < 0.4, 0, rng.integers(0, 40, n)),
        "v": np.where(rng.random(n) < 0.35, 7.0, rng.integers(0, 400, n) / 4),
        "pos": rng.permutation(n),
    })


@pytest.mark.parametrize("by", [[], ["g"]])
def test_row_numbers_with_a_hot_group_and_a_hot_value(spark, small_hot, by):
    pdf = skewed()
    got = ordering.global_row_number(spark.createDataFrame(pdf), ["v", "pos"], "rn", by).toPandas().sort_values(by + ["v", "pos"])
    expected = got.groupby("g").cumcount() + 1 if by else np.arange(1, len(pdf) + 1)
    assert len(got) == len(pdf) and (got["rn"] == expected).all()


def test_row_numbers_do_not_depend_on_partitioning(spark, small_hot):
    pdf = skewed(2000)
    results = []
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(pdf).repartition(parts)
        results.append(ordering.global_row_number(df, ["v", "pos"], "rn", ["g"]).toPandas().sort_values("pos")["rn"].tolist())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1]


def brute_ci(y, p):
    y, p = np.asarray(y), np.asarray(p)
    smaller = y[:, None] < y[None, :]
    total = smaller.sum()
    return ((smaller & (p[:, None] < p[None, :])).sum() + (smaller & (p[:, None] == p[None, :])).sum() / 2) / total if total else None


@pytest.mark.parametrize("by", [[], ["g"]])
def test_concordance_against_brute_force(spark, small_hot, by):
    pdf = skewed(1500)
    pdf["y"], pdf["p"] = pdf["v"], np.round(pdf["v"] + np.random.default_rng(2).normal(0, 20, len(pdf)))
    got = metrics.concordance_index(spark.createDataFrame(pdf[["g", "y", "p"]]), by, buckets=8).toPandas()
    if not by:
        assert got["ci"].tolist() == [pytest.approx(brute_ci(pdf["y"], pdf["p"]), abs=1e-12)]
        return
    expected = {g: brute_ci(part["y"], part["p"]) for g, part in pdf.groupby("g")}
    assert len(got) == len(expected)
    for g, ci in zip(got["g"], got["ci"]):
        assert ci == pytest.approx(expected[g], abs=1e-12)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metrics_of_degenerate_inputs(spark):
    one_class = frame(spark, [(1.0, 0.2), (1.0, 0.4)], "y double, p double")
    assert metrics.roc_auc(one_class).first()["roc"] is None
    none_hit = frame(spark, [(0.0, 0.5), (1.0, 0.5)], "y double, p double")
    row = metrics.threshold_metrics(none_hit).first()
    assert (row["f1"], row["recall"], row["precision"]) == (0.0, 0.0, 0.0)
    assert metrics.roc_auc(none_hit).first()["roc"] == 0.5
    no_label = frame(spark, [(None, 1.0), (float("nan"), 2.0)], "y double, p double")
    assert metrics.masked_mse(no_label).first()["masked_mse"] == 0.0
    assert metrics.labelled(no_label).count() == 0
    flat = frame(spark, [(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert metrics.spearman(flat).first()["spearman"] is None
    assert metrics.concordance_index(flat).first()["ci"] is None


def test_multiclass_undefined_score(spark):
    rows = [(0, [0.9, 0.05, 0.05]), (1, [0.2, 0.7, 0.1]), (1000, [0.1, 0.1, 0.8])]
    valid = metrics.valid_classes(frame(spark, rows, "label int, probs array<double>"), "label", "probs", 3)
    assert valid.count() == 2
    row = metrics.multiclass_ranking(valid, 3).first()
    assert (row[0], row[1]) == (fv.UNDEFINED_SCORE, fv.UNDEFINED_SCORE)
    assert metrics.multiclass_confusion(valid).first()["multiclass_accuracy"] == 1.0


def test_best_checkpoint_first_best_wins(spark):
    log = frame(spark, [("r", 1, "rmse", 2.0), ("r", 2, "rmse", 1.0), ("r", 3, "rmse", 1.0), ("r", 1, "roc", 0.5), ("r", 2, "roc", float("nan"))],
                "run string, step long, metric string, value double")
    best = {r["metric"]: r["step"] for r in metrics.best_checkpoint(log).collect()}
    assert best == {"rmse": 2, "roc": 1}


def test_evaluate_needs_a_head():
    with pytest.raises(ValueError):
        metrics.evaluate()


# --- windows ---


def test_rank_output_order(spark):
    df = frame(spark, [("P2", 5.0), ("P1", 7.0), ("P1", 8.0), ("P2", 6.0)], "protein_id string, prediction double")
    got = [tuple(r) for r in windows.rank_output(df).collect()]
    assert got == [("P1", 8.0), ("P1", 7.0), ("P2", 6.0), ("P2", 5.0)]


def test_zero_span_and_single_row(spark):
    df = frame(spark, [("a", 1, 3.0), ("b", 1, 2.0), ("b", 2, 2.0)], "g string, pos int, v double")
    zero = {(r["g"], r["pos"]): r["s"] for r in windows.minmax_per_group(df, ["g"], "v", "s").collect()}
    assert set(zero.values()) == {0.0}
    nan = [r["s"] for r in windows.minmax_per_group(df, ["g"], "v", "s", "nan").collect()]
    assert all(np.isnan(nan))
    ranks = {(r["g"], r["pos"]): r["p"] for r in windows.percentile_rank(df, ["g"], "v", "pos", "p").collect()}
    assert ranks == {("a", 1): 1.0, ("b", 1): 0.0, ("b", 2): 1.0}


@pytest.mark.parametrize("n, starts", [(0, [0]), (700, [0]), (701, [0, 350]), (1050, [0, 350]), (1051, [0, 350, 700]), (2000, [0, 350, 700, 1050, 1400])])
def test_window_starts(spark, n, starts):
    assert spark.range(1).select(windows.window_starts(F.lit(n)).alias("s")).first()["s"] == starts


def test_top_k_plan_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 5 AS g", "id * 1.0D AS score", "id")
    plan = windows.top_k(df, ["g"], "score", 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_atom_table_rejects_other_symbols(spark):
    molecules = frame(spark, [("m", "C|O"), ("w", "C|N")], "ligand string, atom_types string")
    scores = frame(spark, [("m", 0, "C", 1.0), ("m", 1, "O", 3.0), ("w", 0, "C", 1.0), ("w", 1, "O", 2.0)], "ligand string, idx int, symbol string, raw double")
    good, bad = windows.atom_table(molecules, scores)
    assert sorted(tuple(r) for r in good.collect()) == [("m", 0, "C", 0.0), ("m", 1, "O", 1.0)]
    assert [r["ligand"] for r in bad.collect()] == ["w"]


# --- screening ---


def test_scale_checks(spark):
    five, none = spark.range(5), spark.range(0)
    assert screening.check_scale(five, five).pairs == 25
    with pytest.raises(ValueError, match="top-K"):
        screening.check_scale(five, five, max_pairs=24)
    assert screening.check_scale(five, five, top_k=1, max_pairs=24).pairs == 25
    with pytest.raises(ValueError, match="interpretation"):
        screening.check_scale(five, five, interpret=True)
    with pytest.raises(ValueError, match="without a cache"):
        screening.check_scale(five, five, cached=False, max_uncached=4)
    with pytest.raises(ValueError, match="nothing to screen"):
        screening.check_scale(five, none)


def test_strict_hydration_and_coverage(spark):
    pairs = frame(spark, [("p", "l"), ("p", "x")], "protein_id string, smiles string")
    ligands = frame(spark, [("l", 1)], "smiles string, f int")
    proteins = frame(spark, [("p", 2)], "protein_id string, h int")
    assert screening.hydrate_pairs(pairs, ligands, proteins, "smiles", "protein_id").count() == 1
    with pytest.raises(Exception, match="pair without features"):
        screening.hydrate_pairs(pairs, ligands, proteins, "smiles", "protein_id", strict=True).collect()
    with pytest.raises(ValueError, match="proteins without features: q"):
        screening.check_target_coverage(frame(spark, [("q", "AA")], "protein_id string, sequence string"),
                                        frame(spark, [("CC",)], "sequence string"), "sequence")


def test_missing_regression_head_scores_zero(spark):
    def make():
        return lambda batch: pd.DataFrame({"class_logit": batch["x"].to_numpy()})

    scored = screening.score_pairs(spark.range(3).selectExpr("id", "id * 0.0D AS x"), make, ["x"], ["id"], screening.Heads(False, True))
    assert {tuple(r)[1:] for r in scored.collect()} == {(0.0, 0.5)}


def test_pair_ids_fill_gaps(spark):
    df = frame(spark, [(10, "a"), (11, None), (12, None)], "row long, ID string")
    assert [r["ID"] for r in screening.assign_pair_id(df, "row").orderBy("row").collect()] == ["a", "PAIR_1", "PAIR_2"]
    assert [r["ID"] for r in screening.assign_pair_id(df.drop("ID"), "row").orderBy("row").collect()] == ["PAIR_0", "PAIR_1", "PAIR_2"]


def test_predictions_reach_every_duplicate(spark):
    pairs = frame(spark, [("p", "l"), ("p", "l"), ("p", "m")], "Protein string, Ligand string")
    predictions = frame(spark, [("p", "l", 1.5)], "Protein string, Ligand string, prediction double")
    got = sorted((r["Ligand"], r["prediction"]) for r in screening.attach_predictions(pairs, predictions, ["Protein", "Ligand"]).collect())
    assert got == [("l", 1.5), ("l", 1.5), ("m", None)]


# --- cache ---


def test_cache_round_trip_and_skipped_entries(spark):
    calls = []

    def compute(keys):
        calls.append(keys.count())
        return featurize.featurize(keys, "k", lambda s: s * 2 if s != "bad" else 1 / 0, "string")

    cache = featurize.FeatureCache(spark, fresh_dir(spark, "cache"), "string", max_bytes=60)
    keys = frame(spark, [("a",), ("b",), ("a",), ("bad",), ("long" * 30,)], "k string")
    first = cache.get_or_compute(keys, "k", compute)
    assert {r["k"]: r["value"] for r in cache.attach(keys, "k", first.features).collect()} == {"a": "aa", "b": "bb"}
    assert cache.attach(keys, "k", first.features).count() == 3
    assert {r["error"] for r in first.failed.collect()} == {"division by zero", "oversize entry"}
    assert first.counters.get == {"misses": 4, "failed": 2}
    keys = frame(spark, [("a",), ("c",), ("bad",)], "k string")
    second = cache.get_or_compute(keys, "k", compute)
    assert second.hits.count() == 1 and second.misses.count() == 2
    assert {r["k"]: r["value"] for r in cache.attach(keys, "k", second.features).collect()} == {"a": "aa", "c": "cc"}
    assert second.failed.count() == 1 and cache.table().count() == 3
    assert calls == [4, 2]
    assert {(r["error"]) for r in cache.failures().collect()} == {"division by zero", "oversize entry"}


def lengths(keys):
    return featurize.featurize_sql(keys, "k", F.length("k"), F.when(F.col("k") == "bad", "bad key"))


def test_a_half_written_run_is_not_seen(spark, monkeypatch):
    cache = featurize.FeatureCache(spark, fresh_dir(spark, "cache"), "int")
    keys = frame(spark, [("a",), ("bb",)], "k string")
    with monkeypatch.context() as lost:
        lost.setattr(cache, "_commit", lambda run, replaces: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cache.get_or_compute(keys, "k", lengths)
    # The data are there, the commit is not.
    assert len(cache._folders.names()) == 1 and cache.table().count() == 0
    again = cache.get_or_compute(keys, "k", lengths)
    assert again.misses.count() == 2 and cache.table().count() == 2


def test_runs_are_merged_and_folders_bounded(spark):
    cache = featurize.FeatureCache(spark, fresh_dir(spark, "cache"), "int", most_runs=3)
    held = None
    for i in range(12):
        result = cache.get_or_compute(frame(spark, [(f"k{i}",), ("k0",), ("bad",)], "k string"), "k", lengths)
        assert result.hits.count() == (i > 0)
        # What a reader opened before a merge can still be read after it.
        if held is not None:
            assert held.count() == i
        held = cache.table()
    assert cache.table().count() == 12 and cache.failures().count() == 1
    assert len(cache._visible()[0]) <= 4 and len(cache._folders.names()) <= 9 and len(cache._commits.names()) <= 9


def test_lookups_read_only_the_prefixes_they_need(spark):
    cache = featurize.FeatureCache(spark, fresh_dir(spark, "cache"), "int")
    many = spark.range(200).selectExpr("concat('key', id) AS k")
    cache.get_or_compute(many, "k", lengths)
    assert cache._wanted_prefixes(many.selectExpr("sha2(k, 256) AS sha")) is None
    some = cache._wanted_prefixes(many.limit(2).selectExpr("sha2(k, 256) AS sha"))
    plan = cache._read(cache._visible()[0], some)
    assert 0 < len(plan.inputFiles()) and plan.count() < 200
    assert all(f"prefix={r[0][0]}" in r[1] for r in plan.select("sha", F.input_file_name()).collect())


# --- splits ---


def test_random_split_sizes_and_repeatability(spark):
    df = spark.range(101)
    split = splits.random_split(df, "id", [0.7, 0.1, 0.2], 8)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"test": 20, "valid": 10, "train": 71}
    again = splits.random_split(df.repartition(7), "id", [0.7, 0.1, 0.2], 8)
    assert split.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        splits.random_split(df, "id", [0.7, 0.1, 0.3], 8)


def test_group_splits_keep_groups_whole(spark):
    df = spark.range(1000).selectExpr("id", "CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS INT) AS scaffold")
    for fn in (splits.group_split, splits.group_split_greedy):
        for fractions in ([0.6, 0.2, 0.2], [0.8, 0.2, 0.0]):
            out = fn(df, "scaffold", fractions, 5)
            assert out.count() == 1000
            assert out.groupBy("scaffold").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
            sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
            assert sizes["train"] <= fractions[0] * 1000
            if fn is splits.group_split_greedy and fractions[2] == 0:
                assert "test" not in sizes


def walked(sizes, room):
    """Places that a bin takes, item by item."""
    taken = []
    for place, size in sorted(sizes):
        if size <= room:
            room -= size
            taken.append(place)
    return taken


@pytest.mark.parametrize("one_task", [0, 3, 100])
def test_filling_by_rounds_takes_what_a_walk_takes(spark, one_task):
    rng = random.Random(4)
    for _ in range(3):
        sizes = [(f"{rng.randrange(16**8):08x}", rng.choice([1, 2, 3, rng.randrange(1, 40), rng.randrange(1, 400)])) for _ in range(120)]
        room = rng.randrange(1, sum(n for _, n in sizes))
        items = spark.createDataFrame(sizes, "place string, size long")
        got = splits.fill(items, "place", "size", room, one_task).where("filled").collect()
        assert sorted(r["place"] for r in got) == walked(sizes, room)


def test_filling_alternating_large_and_small_items(spark):
    """Every second item is just too large: rounds must not be spent on each."""
    sizes = [(f"{i:04x}", 1 if i % 2 == 0 else 1000 - i) for i in range(200)]
    items = spark.createDataFrame(sizes, "place string, size long")
    got = splits.fill(items, "place", "size", 500, 0).where("filled").collect()
    assert sorted(r["place"] for r in got) == walked(sizes, 500)


def test_greedy_split_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id int, g string")
    assert splits.group_split_greedy(empty, "g", [0.6, 0.2, 0.2], 1).collect() == []
    only_null = spark.createDataFrame([(1, None), (2, None)], "id int, g string")
    assert splits.group_split_greedy(only_null, "g", [0.6, 0.2, 0.2], 1).collect() == []
    one = spark.createDataFrame([(i, "a") for i in range(10)], "id int, g string")
    assert {r["split"] for r in splits.group_split_greedy(one, "g", [0.5, 0.3, 0.2], 1, one_task=0).collect()} == {"test"}



def test_cold_split_never_shares_an_entity(spark):
    df = spark.range(2000).selectExpr("id", "id % 40 AS p", "(id * 7) % 30 AS l")
    out = splits.cold_split(df, ["p", "l"], [0.5, 0.2, 0.3], 8, check=True)
    for entity in ("p", "l"):
        assert out.groupBy(entity).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="no test samples"):
        splits.cold_split(spark.range(3).selectExpr("id AS p"), ["p"], [0.6, 0.3, 0.1], 8, check=True)


def test_weighted_sample_with_one_heavy_row(spark):
    rows = [(f"k{i}", 0 if i % 10 == 0 else 1) for i in range(300)] + [("heavy", 300)]
    out = splits.weighted_sample(frame(spark, rows, "k string, w long"), "k", "w", 3, n=20000)
    counts = {r["k"]: r["count"] for r in out.groupBy("k").count().collect()}
    assert sum(counts.values()) == 20000 and out.select("draw").distinct().count() == 20000
    assert abs(counts["heavy"] / 20000 - 300 / 570) < 0.02
    assert not any(k in counts for k, w in rows if w == 0)


def test_weighted_sample_with_fractions(spark):
    rows = [("a", 0.5), ("b", 1.5), ("c", 2.5), ("none", None), ("nan", float("nan")), ("inf", float("inf")), ("minus", -1.0)]
    out = splits.weighted_sample(frame(spark, rows, "k string, w double"), "k", "w", 3, n=20000)
    counts = {r["k"]: r["count"] for r in out.groupBy("k").count().collect()}
    assert set(counts) <= {"a", "b", "c"} and sum(counts.values()) == 20000
    assert all(abs(counts[k] / 20000 - w / 4.5) < 0.02 for k, w in rows[:3])
    tiny = splits.weighted_sample(frame(spark, [("a", 0.01), ("b", 0.01)], "k string, w double"), "k", "w", 3, n=2000)
    assert min(r["count"] for r in tiny.groupBy("k").count().collect()) > 900


def test_undated_rows_are_their_own_part(spark):
    rows = [(i, None if i % 2 else f"{1990 + i % 10}-01-01") for i in range(60)]
    out = splits.temporal_split(frame(spark, rows, "k int, d string").withColumn("d", F.to_date("d")), "d", 1997, "k", 0.2, 1)
    assert {r["split"] for r in out.where("d IS NULL").collect()} == {"undated"}
    assert {r["split"] for r in out.where("year(d) >= 1997").collect()} == {"test"}


def test_missing_scores_take_no_place(spark):
    rows = [("p", f"l{i}", float("nan") if i < 3 else None if i == 3 else float(i)) for i in range(10)]
    best = windows.top_k(frame(spark, rows, "p string, l string, s double"), ["p"], "s", 3, ["l"])
    assert [r["l"] for r in best.orderBy("rank").collect()] == ["l9", "l8", "l7"]


def test_pooled_vectors_of_another_length_fail(spark):
    rows = frame(spark, [(1, [1.0, 2.0]), (1, [3.0, 4.0, 5.0])], "g int, v array<double>")
    with pytest.raises(Exception, match="vector length is not 2"):
        graph.pool_vectors(rows, ["g"], "v", 2).collect()


def test_ranking_of_very_frequent_scores(spark):
    # 5e9 rows of one score and class would overflow a product of longs; the sums stand in for them.
    rows = frame(spark, [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    got = metrics.binary_ranking(rows).first()
    assert got["roc"] == 0.875 and dict(metrics.binary_ranking(rows).dtypes)["prc"] == "double"


# --- graphs ---


def test_drop_probability_outside_range(spark):
    edges = frame(spark, [(1, 0, 1)], "g int, src int, dst int")
    with pytest.raises(ValueError):
        graph.drop_edges(edges, 1.5)
    nodes = frame(spark, [(1, 0), (1, 1), (2, 0)], "g int, node int")
    kept, inside = graph.drop_nodes(nodes, edges, 1.0)
    assert kept.groupBy("g").count().where("count = 1").count() == 2 and inside.count() == 0


def test_unknown_scaler_raises(spark):
    averages = frame(spark, [(1.0, 1.0, 1.0)], "lin double, log double, exp double")
    with pytest.raises(ValueError, match="unknown scaler"):
        graph.neighbor_aggregate(frame(spark, [(1, 1.0)], "dst int, value double"), averages, ["mean"], ["none"], ["dst"])


def test_contact_graph_of_short_chains(spark):
    contacts = frame(spark, [("a", 0, 2, 0.9), ("a", 1, 0, 0.2)], "g string, i long, j long, prob double")
    lengths = frame(spark, [("a", 3), ("b", 1)], "g string, n long")
    got = sorted(tuple(r) for r in graph.contact_graph(contacts, lengths).collect())
    assert got == sorted([("a", i, i, 1.0) for i in range(3)] + [("b", 0, 0, 1.0)] + [
        ("a", 0, 1, 0.5), ("a", 1, 0, 0.5), ("a", 1, 2, 0.5), ("a", 2, 1, 0.5), ("a", 0, 2, 0.9), ("a", 2, 0, 0.9)])


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(1, i, i + 1) for i in range(0, 60)]
    star = [(2, 100, i) for i in range(40)]
    edges = frame(spark, chain + star, "g int, src int, dst int")
    nodes = frame(spark, [(1, i) for i in range(61)] + [(2, i) for i in range(40)] + [(2, 100), (2, 200)], "g int, node int")
    labels = {(r["g"], r["node"]): r["label"] for r in components.component_labels(edges, nodes).collect()}
    assert all(labels[1, i] == 0 for i in range(61)) and labels[2, 100] == 0 and labels[2, 200] == 200
    shares = {r["g"]: r["largest_share"] for r in components.largest_component_share(edges, nodes).collect()}
    assert shares == {1: 1.0, 2: 41 / 42}


def test_spanning_tree_weight_against_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(1, *sorted(map(int, rng.choice(9, 2, replace=False)))) for _ in range(25)})
    rows = [(g, a, b, int(rng.integers(1, 6))) for g, a, b in edges]
    nodes = frame(spark, [(1, i) for i in range(9)], "g int, node int")
    tree = components.max_overlap_tree(frame(spark, rows, "g int, src int, dst int, weight int"), nodes).collect()
    parent = list(range(9))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    best = 0
    for _, a, b, w in sorted(rows, key=lambda r: -r[3]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            best += w
    assert sum(r["weight"] for r in tree) == 2 * best


def test_clique_graph_merges_bridged_rings_and_adds_singletons(spark):
    rings = [(1, 0, a, 0) for a in (0, 1, 2, 3, 4)] + [(1, 1, a, 0) for a in (1, 2, 3, 5, 6)]
    bonds = [(1, c, a, 1) for c, (a, b) in {2: (6, 7), 3: (7, 8), 4: (7, 9)}.items() for a in (a, b)]
    members = frame(spark, rings + bonds, "g int, clique int, atom int, kind int")
    atoms = frame(spark, [(1, i) for i in range(10)] + [(2, 0), (2, 1)], "g int, atom int")
    cliques, membership, links = components.clique_overlap_graph(members, atoms)
    kinds = {(r["g"], r["clique"]): r["kind"] for r in cliques.collect()}
    single = next(c for (g, c), kind in kinds.items() if g == 1 and kind == 3)
    assert kinds == {(1, 0): 2, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, single): 3, (2, 0): 3, (2, 1): 3}
    assert {(r["atom"], r["clique"]) for r in membership.where("g = 1 AND atom = 6").collect()} == {(6, 0), (6, 2)}
    assert {tuple(r) for r in links.collect()} == {(1, 0, 2, 1), (1, 2, single, 1), (1, 3, single, 1), (1, 4, single, 1)}


def test_screen_matrix_ways_agree(spark):
    ligands = spark.range(30).withColumnRenamed("id", "smiles")
    proteins = spark.range(7).withColumnRenamed("id", "protein_id")
    small = screening.screen_matrix(ligands, proteins, "smiles", "protein_id")
    large = screening.screen_matrix(ligands, proteins, "smiles", "protein_id", broadcast_bytes=20, slices=3)
    assert small.count() == large.count() == 210 and small.exceptAll(large).count() == 0


def test_block_screen_equals_row_screen_with_ties(spark):
    ligands = spark.range(500).selectExpr("id AS smiles", "array(CAST(id % 5 AS DOUBLE), 1.0D) AS lv")
    proteins = spark.range(9).selectExpr("id AS protein_id", "array(CAST(id % 3 AS DOUBLE), 2.0D) AS pv")
    rows = screening.score_dot(screening.screen_matrix(ligands, proteins, "smiles", "protein_id"), "lv", "pv")
    expected = windows.top_k(rows.select("protein_id", "smiles", "prediction"), ["protein_id"], "prediction", 7, ["smiles"])
    got = screening.screen_blocks(ligands, proteins, "smiles", "protein_id", screening.block_dot("lv", "pv"), 7,
                                  slice_rows=60, block_bytes=200, matrix_cells=100)
    assert got.count() == 63 and expected.exceptAll(got).count() == 0


# --- overlapping windows as arrays, models held by workers ---


@pytest.mark.parametrize("n", [1, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20])
def test_windows_are_stitched_like_dense_matrices(spark, n):
    rng = np.random.default_rng(n)
    window, stride = 6, 3
    starts = range(0, 1 if n <= window else -(-(n - window) // stride) * stride + 1, stride)
    parts = {s: rng.integers(0, 50, (min(window, n - s),) * 2).astype(float) for s in starts}
    total, count = np.zeros((n, n)), np.zeros((n, n))
    for s, m in parts.items():
        total[s:s + len(m), s:s + len(m)] += m
        count[s:s + len(m), s:s + len(m)] += 1
    want = np.where(count > 0, total / np.maximum(count, 1), np.nan)
    rows = frame(spark, [("k", s, m.tolist(), m[0].tolist()) for s, m in parts.items()], "k string, s int, m array<array<double>>, v array<double>")
    got = np.full((n, n), np.nan)
    for r in windows.merge_window_pairs(rows, "k", "s", "m", window, stride).collect():
        for i, line in enumerate(r["m"]):
            for j, v in enumerate(line):
                if v is not None:
                    got[r["s"] + i, r["first_column"] + j] = v
    assert np.array_equal(got, want, equal_nan=True)
    sums, seen = np.zeros(n), np.zeros(n)
    for s, m in parts.items():
        sums[s:s + len(m)] += m[0]
        seen[s:s + len(m)] += 1
    flat = [x for r in sorted(windows.merge_window_values(rows, "k", "s", "v", False, window, stride).collect(), key=lambda r: r["s"]) for x in r["v"]]
    assert flat == (sums / seen).tolist()
    vectors = rows.withColumn("x", F.transform("v", lambda v: F.array(v, -v)))
    both = [x for r in sorted(windows.merge_window_values(vectors, "k", "s", "x", True, window, stride).collect(), key=lambda r: r["s"]) for x in r["x"]]
    assert both == [[x, -x] for x in (sums / seen).tolist()]


def test_a_model_is_built_once_per_worker(spark, tmp_path):
    built = str(tmp_path)

    def make_scorer():
        import os
        import uuid

        open(f"{built}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda batch: pd.DataFrame({"regression": batch["x"] * 2})

    pairs = spark.range(64).selectExpr("id", "CAST(id AS DOUBLE) AS x").repartition(32)
    for _ in range(2):
        scored = screening.score_pairs(pairs, make_scorer, ["x"], ["id"], model=f"twice {built}")
        assert {r["id"]: r["prediction"] for r in scored.collect()} == {i: 2.0 * i for i in range(64)}
    builds = [name.split("-")[0] for name in __import__("os").listdir(built)]
    assert len(builds) == len(set(builds)) and len(builds) < 32


def test_models_in_use_are_kept():
    made = []

    def get(name):
        return screening.held_model(f"kept {name}", lambda: made.append(name) or name, most=2)

    for name in "abacab":
        get(name)
    assert made == ["a", "b", "c", "b"]


def test_projection_equals_plain_eigenvectors(spark):
    from pairspark.operators import structure

    rows = np.random.default_rng(6).normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.2] + [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<double>").repartition(3)
    got = {r["id"]: r["xy"] for r in structure.project_fingerprints(df, "id", "vec").collect()}
    values, vectors = np.linalg.eigh(np.cov(rows.T))
    axes = vectors[:, np.argsort(values)[::-1][:2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose([got[i] for i in range(60)], rows @ axes, atol=1e-8)


def plain_components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for g, a, b in edges:
            if a != b and (g, a) in label and (g, b) in label and label[g, a] != label[g, b]:
                label[g, a] = label[g, b] = min(label[g, a], label[g, b])
                changed = True
    return {n: v[1] for n, v in label.items()}


@pytest.mark.parametrize("small", [100_000, 12])
def test_components_and_trees_whole_and_in_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(3)
    nodes = [(f"g{g}", f"n{i:02}") for g in range(12) for i in range(2 + 2 * g)]
    edges = [(g, f"n{rng.integers(30):02}", n) for g, n in nodes for _ in range(2) if rng.random() < 0.6]
    frame_n = frame(spark, [*nodes, (None, "n01"), ("g1", None)], "g string, node string").repartition(3)
    frame_e = frame(spark, [*edges, (None, "n01", "n02"), ("g1", None, "n01"), ("zz", "n01", "n02")], "g string, src string, dst string").repartition(3)
    jobs = []
    got = components.component_labels(frame_e, frame_n, lambda df: jobs.append(1) or df.localCheckpoint()).collect()
    labels = {(r["g"], r["node"]): r["label"] for r in got}
    assert labels == plain_components(nodes, edges) and len(got) == len(nodes)
    # Graphs that are solved whole need no rounds.
    assert small == 12 or len(jobs) == 3
    weighted = [(*e, int(rng.integers(1, 6))) for e in edges]
    jobs.clear()
    tree = components.max_overlap_tree(frame(spark, weighted, "g string, src string, dst string, weight int"), frame_n,
                                       lambda df: jobs.append(1) or df.localCheckpoint()).collect()
    assert small == 12 or len(jobs) == 3
    best = {}
    for g, a, b, w in weighted:
        if a != b and (g, a) in labels and (g, b) in labels:
            key = (g, *sorted((a, b)))
            best[key] = max(best.get(key, 0), w)
    label, expected = {n: n for n in nodes}, set()
    for (g, a, b), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if label[g, a] != label[g, b]:
            expected |= {(g, a, b, w), (g, b, a, w)}
            old, new = label[g, b], label[g, a]
            label = {n: new if v == old else v for n, v in label.items()}
    assert {tuple(r) for r in tree} == expected and len(tree) == len(expected)


def test_cluster_adjacency_and_trace_against_numpy(spark):
    rng = np.random.default_rng(8)
    scores = {(g, n): rng.normal(size=3) for g in (1, 2) for n in range(5)}
    rows = [(g, n, k, float(s)) for (g, n), v in scores.items() for k, s in enumerate(v)]
    edges = [(g, a, b, float(rng.integers(1, 5))) for g in (1, 2) for a in range(5) for b in range(5) if a != b and rng.random() < 0.5]
    assigned = graph.soft_assignments(frame(spark, rows, "g int, node int, k int, s double"))
    links = frame(spark, edges, "g int, src int, dst int, weight double")
    # A cluster's row per node never moves by itself: the join's sides are one row per node and per edge.
    plan = graph.cluster_trace(assigned, links)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and plan.count("Aggregate [g") <= 5
    soft = {at: np.exp(v) / np.exp(v).sum() for at, v in scores.items()}
    pooled = {g: sum(w * np.outer(soft[h, a], soft[h, b]) for h, a, b, w in edges if h == g) for g in (1, 2)}
    cells = graph.cluster_adjacency(assigned, links).collect()
    assert len(cells) == 18 and all(abs(r["a"] - pooled[r["g"]][r["k1"], r["k2"]]) < 1e-9 for r in cells)
    traces = {r["g"]: r["num"] for r in graph.cluster_trace(assigned, links).collect()}
    assert all(abs(traces[g] - np.trace(pooled[g])) < 1e-9 for g in (1, 2))


def shuffles(df):
    """The planner's own shuffles, without those a query asks for."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def order_lines(tmp_path):
    """Lines of 40 orders of up to 9 parts as ``lineitem``, with repeated lines and a null order; returns the parts by order."""
    rng = np.random.default_rng(11)
    rows = [(int(g), int(p), float(q)) for g in range(40) for p, q in zip(rng.integers(1, 60, g % 10), rng.integers(1, 50, 9))]
    rows += rows[:20] + [(None, 5, 1.0), (None, 7, 1.0)]
    table = pa.table({"l_orderkey": [r[0] for r in rows], "l_partkey": [r[1] for r in rows], "l_quantity": [r[2] for r in rows]})
    pq.write_table(table, tmp_path / "lineitem.parquet")
    return {g: sorted({p for h, p, _ in rows if h == g}) for g in range(40)}


def soft_orders(parts):
    """Assignments and weights of the orders, dense, by order with at least one edge."""
    for g, own in parts.items():
        p = np.array(own, float)
        e = np.exp((np.outer(p, np.arange(1, 4)) % 11) / 4)
        w = np.array([[1.0 + (a + b) % 7 if a != b and (a + b) % 3 == 0 else 0.0 for b in own] for a in own])
        if w.any():
            yield g, e / e.sum(axis=1, keepdims=True), w


def test_cluster_losses_of_orders_from_one_shuffle(spark, tmp_path):
    """Losses against numpy; what the edges and cells give is folded where the orders lie, and no row by node or edge is stored."""
    want = {}
    for g, s, w in soft_orders(order_lines(tmp_path)):
        ss, m = s.T @ s, w.sum()
        trace = np.trace(s.T @ w @ s)
        want[g] = (-trace / (w.sum(axis=1) @ (s * s).sum(axis=1)), np.linalg.norm(ss / np.linalg.norm(ss) - np.eye(3) / 3 ** 0.5),
                   -(trace - ((w.sum(axis=0) @ s) ** 2).sum() / 2 / m) / 2 / m, np.linalg.norm(ss.sum(axis=1)) / len(s) * 3 ** 0.5 - 1,
                   -np.sqrt(np.diag(ss) + 1e-15).sum() / (len(s) * 3) ** 0.5)
    got = {r["g"]: tuple(r)[1:] for r in graph_queries.cluster_losses(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g], atol=1e-5) for g in want)
    _, edges, assigned = graph_queries._soft(spark, str(tmp_path))
    assert shuffles(graph.edge_sums(assigned, edges, placed=True)) == 0 and shuffles(graph.gram_sums(graph.cluster_gram(assigned))) == 0


def test_pooled_orders_from_one_shuffle(spark, tmp_path):
    want = {}
    for g, s, w in soft_orders(order_lines(tmp_path)):
        a = s.T @ w @ s
        np.fill_diagonal(a, 0)
        d = np.sqrt(a.sum(axis=1)) + 1e-15
        want[g] = a / d[:, None] / d
    pooled = graph_queries.soft_cluster_pool(spark, str(tmp_path))
    assert shuffles(pooled) == 0
    cells = pooled.collect()
    assert len(cells) == 9 * len(want) and all(abs(r["a"] - want[r["g"]][r["k1"], r["k2"]]) < 1e-4 for r in cells)


def test_degrees_of_cells_without_a_row_of_their_column(spark):
    cells = frame(spark, [(1, 0, 1, 4.0), (1, 1, 0, 4.0), (1, 0, 2, 5.0), (1, 1, 1, 9.0), (2, 0, 0, 3.0), (None, 0, 0, 1.0), (3, None, 0, 1.0)], "g int, k1 int, k2 int, a double")
    got = {(r["g"], r["k1"], r["k2"]): r["a"] for r in graph.normalized_adjacency(cells).collect()}
    assert set(got) == {(1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0)}
    assert abs(got[1, 0, 1] - 4 / 3 / 2) < 1e-9 and abs(got[1, 1, 0] - 4 / 3 / 2) < 1e-9 and got[1, 1, 1] == got[2, 0, 0] == 0


@pytest.mark.parametrize("listed", [False, True])
def test_edge_sums_by_joins_and_where_graphs_lie(spark, listed):
    """Ends without clusters, unknown ends, missing numbers and weights; sums against plain loops."""
    clusters = {(1, 0): {0: 0.5, 1: 0.5}, (1, 1): {0: 0.2, 1: 0.8}, (1, 2): {0: None, 1: 1.0}, (2, 0): {0: 1.0}, (2, 1): {1: 1.0}, (3, 0): {0: 1.0}, (3, 1): {0: 0.5}}
    links = [(1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 0, 3.0), (1, 0, 2, 4.0), (1, 2, 0, None), (1, 0, 9, 5.0), (1, 9, 1, 6.0), (1, 0, None, 7.0), (1, None, 1, 8.0),
             (2, 0, 1, 1.0), (3, 0, 1, 2.0), (None, 0, 1, 1.0)]
    want = {}
    for g in (1, 3):
        num = den = m = 0.0
        c = {}
        for a, b, w in [(clusters.get((g, x), {}), clusters.get((g, y), {}), w or 0.0) for h, x, y, w in links if h == g]:
            num += w * sum((a[k] or 0) * (b[k] or 0) for k in a if k in b)
            den += w * sum((s or 0) ** 2 for s in a.values())
            m += w
            for k, s in b.items():
                c[k] = c.get(k, 0) + w * (s or 0)
        want[g] = (num, den, m, sum(x * x for x in c.values()))
    rows = frame(spark, [(g, n, k, s) for (g, n), v in clusters.items() for k, s in v.items()] + [(None, 0, 0, 1.0), (1, None, 0, 1.0)], "g int, node int, k int, s double")
    assigned = graph._listed(rows) if listed else rows
    edges = frame(spark, links, "g int, src int, dst int, weight double")
    for placed in (False, True):
        got = {r["g"]: (r["num"], r["den"], r["m"], r["cc"]) for r in graph.edge_sums(assigned, edges, placed).collect()}
        assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)
        cells = graph.cluster_adjacency(assigned, edges, placed).where("g = 1 AND k1 = 1 AND k2 = 1").collect()
        assert len(cells) == 1 and abs(cells[0]["a"] - (2 * 0.5 * 0.8 + 6 * 0.8 * 0.5 + 4 * 0.5)) < 1e-9


def test_overlaps_are_not_cut_out_anew_for_every_position(spark):
    rows = frame(spark, [("k", 0, [[1.0]], [1.0])], "k string, s int, m array<array<double>>, v array<double>")
    for merged in (windows.merge_window_values(rows, "k", "s", "v"), windows.merge_window_pairs(rows, "k", "s", "m")):
        assert "get(slice(" not in merged._jdf.queryExecution().optimizedPlan().toString()


# --- tables stored between steps ---


def test_stored_tables_keep_rows_names_and_types(spark):
    rows = [(1, "a", [1.0, None], (2, "x")), (None, None, None, None), (1, "a", [1.0, None], (2, "x"))]
    df = frame(spark, rows, "`a b (c)` int, s string, v array<double>, t struct<n: int, m: string>")
    kept = stored(spark, df.repartition(2))
    assert kept.dtypes == df.dtypes and kept.exceptAll(df).count() == df.exceptAll(kept).count() == 0
    # A reader of one column takes no other.
    assert "ReadSchema: struct<s:string>" in kept.select("s")._jdf.queryExecution().executedPlan().toString()
    assert stored(spark, df.where("s = 'none'")).collect() == []


def test_large_graphs_are_stored_by_columns_between_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 3)
    edges = frame(spark, [(1, i, i + 1) for i in range(9)] + [(1, 0, 1)], "g int, src int, dst int")
    labels = components.component_labels(edges, frame(spark, [(1, i) for i in range(10)], "g int, node int"))
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan
    assert {tuple(r) for r in labels.collect()} == {(1, i, 0) for i in range(10)}


def plain_clique_graph(members):
    """Cliques and links of one molecule, step by step."""
    size = {c: sum(m[0] == c for m in members) for c, _, _ in members}
    atoms = {c: {a for d, a, _ in members if d == c} for c in size}
    label = {c: c for c in size}
    for c in sorted(size) * len(size):
        for d in size:
            if c != d and size[c] > 2 and size[d] > 2 and len(atoms[c] & atoms[d]) > 2:
                label[c] = label[d] = min(label[c], label[d])
    kept, kind = {}, {}
    for c, a, k in members:
        kept.setdefault(label[c], set()).add(a)
        kind.setdefault((label[c], a), set()).add(2 if list(label.values()).count(label[c]) > 1 else k)
    cliques = {(c, max(ks)) for (c, _), ks in kind.items()}
    links, plain = set(), set()
    for a in {m[1] for m in members}:
        own = [c for c in kept if a in kept[c]]
        bonds, rings = sum(len(kept[c]) == 2 for c in own), sum(len(kept[c]) > 4 for c in own)
        weight = None if len(own) <= 1 else 1 if bonds > 2 or (bonds == 2 and len(own) > 2) else 99 if rings > 2 else None
        if weight:
            single = max(kept) + 1 + a
            cliques.add((single, 3))
            links |= {(c, single, weight) for c in own}
        else:
            plain |= {(c, d) for c in own for d in own if c < d}
    return cliques, links | {(c, d, min(99, len(kept[c] & kept[d]))) for c, d in plain}


@pytest.mark.parametrize("small", [100_000, 12])
def test_clique_graphs_whole_and_by_joins_against_a_plain_model(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(11)
    rows = []
    for g in range(40):
        cliques = [rng.choice(7, rng.integers(1, 7), replace=False).tolist() for _ in range(rng.integers(1, 7))]
        rows += [(g, c, int(a), int(len(atoms) == 2)) for c, atoms in enumerate(cliques) for a in atoms]
    members = frame(spark, [*rows, (None, 0, 1, 0), (3, None, 1, 0)], "g int, clique int, atom int, kind int").repartition(3)
    found, membership, links = components.clique_overlap_graph(members, members.select("g", "atom").distinct())
    expected = {g: plain_clique_graph([m[1:] for m in rows if m[0] == g]) for g in range(40)}
    assert {tuple(r) for r in links.collect()} == {(g, *link) for g in expected for link in expected[g][1]}
    got = {tuple(r) for r in found.where("g IS NOT NULL").collect()}
    assert got == {(g, *c) for g in expected for c in expected[g][0]}
    assert any(k == 2 for _, _, k in got) and any(k == 3 for _, _, k in got)


def test_molecules_move_once_for_all_steps_of_their_cliques(spark):
    rows = frame(spark, [(1, c, a, 0) for c in (0, 1) for a in range(4)], "g int, clique int, atom int, kind int")
    saved = []
    components.clique_overlap_graph(rows, rows.select("g", "atom"), lambda df: saved.append(df) or stored(spark, df))
    placed = saved[-1]._jdf.queryExecution().executedPlan().toString()
    # The rows, and the labels of the few rings that unite.
    assert "Window" in placed and placed.count("Exchange hashpartitioning") <= 2


def test_stored_row_ids_are_numbered_without_a_sort(spark):
    rows = spark.range(0, 500, 1, 7).where("id % 3 <> 1").withColumn("at", F.monotonically_increasing_id())
    kept = stored(spark, rows)
    got = ordering.row_id_number(kept, "at", "n")
    assert sorted((r["n"], r["id"]) for r in got.collect()) == list(enumerate([i for i in range(500) if i % 3 != 1], 1))
    ids = screening.assign_pair_id(kept, "at", row_ids=True).exceptAll(screening.assign_pair_id(kept, "at"))
    assert ids.count() == 0
    with pytest.raises(Exception, match="row ids are missing"):
        ordering.row_id_number(kept.where("id <> 0"), "at", "n").collect()
    assert ordering.row_id_number(kept.where("id < 0"), "at", "n").collect() == []


def test_scores_of_all_batches_leave_as_one_frame(spark):
    def make():
        def score(batch):
            out = pd.DataFrame({"regression": batch["x"].to_numpy() * 2})
            if len(batch) == 4:  # the last batch has no other heads
                out["class_logit"] = batch["x"].to_numpy()
            return out
        return score

    pairs = spark.range(0, 10, 1, 1).withColumn("x", F.col("id").cast("double"))
    heads = screening.Heads(True, True)
    got = sorted(screening.score_pairs(pairs, make, ["x"], ["id"], heads, 4).collect())
    assert [(r["id"], r["prediction"]) for r in got] == [(i, 2.0 * i) for i in range(10)]
    logits = [r["predicted_binary_interaction"] for r in got]
    assert logits[8:] == [None, None] and logits[0] == 0.5 and None not in logits[:8]
    with pytest.raises(Exception, match="3 scores for 4 pairs"):
        screening.score_pairs(pairs, lambda: lambda batch: pd.DataFrame({"regression": [1.0] * 3}), ["x"], ["id"], heads, 4).collect()
