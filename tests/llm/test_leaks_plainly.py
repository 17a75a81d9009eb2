"""Leaks against a plain model of the rules, without Spark: regex words, loops over all windows."""

import random
import regex

from pairspark.llm import decontam

SIGN = {"$": "dollar", "€": "euro", "£": "pound", "¥": "yen"}


def words_of(text):
    """``(typed with names, typed, raw)`` per word."""
    text = regex.sub(r"(?<=\p{Nd}),(?=\p{Nd}{3}(?!\p{Nd}))", "", text)
    text = regex.sub(r"(?<=\p{Nd}) ?%", " percent ", text)
    text = regex.sub(r"([$€£¥]) ?(?=\p{Nd})", lambda m: f" {SIGN[m[1]]} ", text)
    found = list(regex.finditer(r"(?:(?<=\p{Nd})[.,/](?=\p{Nd})|[\p{L}\p{M}\p{N}])+", text))
    raw = [m[0].lower().replace("ß", "ss") for m in found]
    names = [m.start() >= 2 and text[m.start() - 1] == " " and regex.match(r"[\p{Ll}\p{Nd},;:]", text[m.start() - 2]) is not None
             and regex.match(r"\p{Lu}", m[0]) is not None for m in found]

    def typed(i, named):
        number = lambda j: 0 <= j < len(raw) and raw[j][0].isdecimal()
        if number(i):
            return "#n"
        if named and names[i]:
            return "#p"
        after = number(i - 1) and raw[i] in decontam.UNITS.split()
        return "#u" if after or number(i + 1) and raw[i] in SIGN.values() else raw[i]

    return [(typed(i, True), typed(i, False), raw[i]) for i in range(len(raw))]


def keys(part):
    names, low, raw = zip(*part)
    plain = lambda ws: sum(not w.startswith("#") for w in ws) >= 2
    out = {low} if plain(low) else {("raw", *raw)}
    return out | ({names} if "#p" in names and plain(names) else set())


def verdicts(item, text, size=5):
    """The best of all alignments as ``(consistency, coverage, kept)``, or None."""
    item, text = words_of(item), words_of(text)
    size = min(size, len(item))
    if not size:
        return None
    windows = [keys(text[a:a + size]) for a in range(len(text) - size + 1)]
    hits = [(a - p, p) for p in range(len(item) - size + 1) for a, k in enumerate(windows) if k & keys(item[p:p + size])]
    shifts, runs = sorted({s for s, _ in hits}), []
    for s in shifts:
        runs = [*runs[:-1], [*runs[-1], s]] if runs and s - runs[-1][-1] <= size else [*runs, [s]]
    best = None
    for chosen in [[s] for s in shifts] + runs + [shifts]:
        mine = [(s, p) for s, p in hits if s in chosen]
        covered = {p + i for _, p in mine for i in range(size)}
        good = total = changed = 0
        for s in chosen:
            slots = {(p + i, item[p + i][2], text[s + p + i][2]) for t, p in mine if t == s for i in range(size) if item[p + i][0].startswith("#")}
            for _, a, b in slots:
                same = {y for _, x, y in slots if x == a} == {b} and {x for _, x, y in slots if y == b} == {a}
                good, total, changed = good + same, total + 1, changed or a != b
        mark = (good / total if total else 1.0, len(covered) / len(item) if item else 0, not changed)
        if mark[0] >= 0.8 and mark[1] >= 0.8:
            best = max(best or mark, mark)
    return best


def compare(spark, docs, items, least=3):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench, least_words=least).collect()
    got = {(r["doc_id"], r["item_id"]): (r["consistency"], r["coverage"], not r["reparameterised"]) for r in rows}
    want = {(d, i): verdicts(b, t) for d, t in enumerate(docs) for i, b in enumerate(items) if len(words_of(b)) >= least}
    assert got == {k: v for k, v in want.items() if v}
    return got


def test_leaks_equal_the_plain_model(spark):
    rng = random.Random(8)
    pool = ["has", "walks", "to", "the", "old", "river", "and", "buys", "apples", "Tom", "Anna", "3", "12", "1,200", "2.5", "3/4", "km", "kilometres",
            "5%", "$40", "£ 7", "days,", "then.", "Köln", "7, 8", "is"]
    items = [" ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 4, 6, 9, 14]))) for _ in range(40)]
    docs = []
    for item in items * 3:
        words = item.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(pool)
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words) + 1), rng.choice(pool))
        docs.append(" ".join([*rng.choices(pool, k=rng.randrange(6)), *words, *rng.choices(pool, k=rng.randrange(6))]))
    assert len(compare(spark, docs, items)) > 40
    assert len(compare(spark, docs[:40], items, least=1)) > 40


def test_numbers_units_and_slots(spark):
    item = "What is 3/4 of 1,200 kilometres when Anna walks 2.5 km each day?"
    tall = "Add 12 apples and 7 pears and 12 plums to the basket of fruit"
    docs = ["What is 5/8 of 900 kilometres when Bob walks 4 km each day?", "Add 5 apples and 5 pears and 5 plums to the basket of fruit",
            "Add 5 apples and 8 pears and 5 plums to the basket of fruit", "It costs $ 50 or 8% of the yearly sum of money", "1.2.3,4/5 \x02 6"]
    got = compare(spark, docs, [item, tall, "It costs $20 or 5 percent of the yearly sum of money"])
    assert set(got) == {(0, 0), (2, 1), (3, 2)} and not any(kept for _, _, kept in got.values())


def test_short_items_by_their_words(spark):
    docs = ["yes", "Say YES or no", "or yes say", "no", None, ""]
    bench = spark.createDataFrame([(0, "Yes"), (1, "say yes"), (2, ""), (3, None)], "item_id long, text string")
    rows = decontam.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench, least_words=1).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(0, 0), (1, 0), (1, 1), (2, 0)]
