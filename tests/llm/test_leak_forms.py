"""Leaks in other case, of number-rich items, and beside inconsistent variants."""

from pairspark.llm import decontam

ITEM = "the quick brown fox jumps over the lazy dog near the old river bank"
NAMED = "Say, Tom has 3 apples and 12 km to go, then Tom eats 3 apples."


def found(spark, docs, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()
    return {(r["doc_id"], r["item_id"]): r for r in got}


def test_copies_in_other_case(spark):
    items = [ITEM, NAMED, "Die Straße führt über den großen Fluß nach Köln, Bonn und Mainz.", "where is Rome"]
    cases = [str.upper, str.title, str.lower, lambda t: f"and then {t[0].upper()}{t[1:]}"]
    got = found(spark, [f"so it is: {case(t)}" for case in cases for t in items], items)
    for n in range(len(cases) * len(items)):
        r = got[n, n % len(items)]
        assert (r["coverage"], r["consistency"], r["reparameterised"]) == (1.0, 1.0, False)


def test_number_rich_items_find_their_copies(spark):
    items = ["Compute 12 + 7 + 9 + 14 + 3 and give the sum.", "1 2 3 4 5 6 7 8", "12 + 30 = 42", "is 7 8", "Ask Anna, Bob, Carl, Dora, Emil, Fred: 3 km, 4 km, 5 km, 6 km?"]
    got = found(spark, [f"Well. {t} Yes." for t in items], items)
    assert all(got[n, n]["coverage"] == got[n, n]["consistency"] == 1.0 for n in range(len(items)))
    assert (1, 0) not in found(spark, ["1 2 3 4 5 6 7 8", "8 7 6 5 4 3 2 1"], items[1:2])


def test_one_consistent_alignment_is_enough(spark):
    other = "Say, Ann has 5 apples and 9 miles to go, then Bob eats 6 apples."
    got = found(spark, [f"{NAMED} {other}", f"{other} {NAMED} {other} {other}", other, NAMED.replace("apples and", "apples left and") + " " + other], [NAMED])
    assert sorted(got) == [(0, 0), (1, 0), (3, 0)] and all(r["consistency"] >= 0.8 for r in got.values())
    assert (got[0, 0]["coverage"], got[0, 0]["consistency"], got[0, 0]["reparameterised"]) == (1.0, 1.0, False)
