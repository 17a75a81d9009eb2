"""The training-data operators against plain Python, and their defined results for odd input."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pairspark.llm import chat, decontam, langid, lattice_lm, license_scan, linking, near_copies, packing, queries, rp_forest, simhash, token_counts, weak_quality

SMALL = "/root/testdata/sf0.001"
LICENSE = "Released under the MIT License."
ITEM = "the quick brown fox jumps over the lazy dog near the old river bank"

ROWS = [
    (1, "Hello the world and all of it. " + LICENSE), (1, "Hello the world and all of it. " + LICENSE), (None, "so " + ITEM + " today"), (3, None), (4, ""), (5, "..."),
    (6, "word " * 30_000), (7, "x" * 100_000), (8, "a b  c\t\n d <|endoftext|> é 日本語"), (9, "The Quick Brown fox"),
]
EXTRA = "fp long, digest string, block int, word string, root string, point int, pattern int, score string, h int, part int, n int, t string, lang string, source string, language string, quality string, __digest string, __language string, __quality string, __leak string, __id string, sid string, size string, wins string"


def odd_docs(spark, rows=ROWS):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    values = [(*r, *["en" if c == "lang" and (r[0] or 0) % 2 else "s" if c == "source" else None for c in names]) for r in rows]
    return spark.createDataFrame(values, f"doc_id long, text string, {EXTRA}").repartition(2)


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


PER_ROW = {
    "op2": lambda d: lattice_lm.score_documents(d, queries.PIECES), "op3": weak_quality.judge, "op4": simhash.near_duplicates,
    "op5": langid.identify, "op9": lambda d: token_counts.count_tokens(d, queries.BYTE_BPE),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_rows_give_one_row_each(spark, name):
    got = PER_ROW[name](odd_docs(spark)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in ROWS)
    assert PER_ROW[name](odd_docs(spark, [])).collect() == []


def test_empty_tables_for_the_others(spark):
    none, bench = odd_docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert license_scan.scan(none).collect() == [] and packing.pack(none, queries.WORD_BPE).collect() == []
    assert decontam.leaks(odd_docs(spark), bench).collect() == [] and decontam.leaks(none, bench).collect() == []
    assert chat.chat_digest(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
    vectors = rp_forest.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert rp_forest.search(vectors, vectors).collect() == []


def test_license_spans(spark):
    got = license_scan.scan(odd_docs(spark)).collect()
    assert [(r["doc_id"], r["template"], r["coverage"], r["first_word"], r["end_word"]) for r in got] == [(1, "MIT", 1.0, 7, 12)] * 2
    index = license_scan.Index(license_scan.TEMPLATES)
    grant = license_scan.TEMPLATES["MIT-grant"]
    changed = grant.replace("free of charge", "without any charge").replace("dealing", "")
    (found,) = license_scan.scan_text(f"one two three {changed} four".encode(), index)
    assert found[0] == "MIT-grant" and 0.9 < found[1] < 1 and found[2] == 3
    assert license_scan.scan_text(b"the work is free and the file is under the old bridge", index) == []


def plain_lattice(lattice, word):
    text = lattice._text(word)
    ends = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        ends[j] = ends[j - 1] * math.exp(lattice._char(ord(text[j - 1])))
        for i in range(max(0, j - lattice.longest), j):
            if text[i:j] in lattice.piece:
                ends[j] += ends[i] * math.exp(lattice.piece[text[i:j]])
    return math.log(ends[-1])


def test_lattice_sums_all_segmentations():
    lattice = lattice_lm.Lattice(queries.PIECES, {300: 50, 301: 7})
    words = ["the", "onanerha", "é", "日本語", "a▁b", "😀", "zzqx", "mentation"]
    got = lattice.log_probs(words)
    assert np.allclose(got, [plain_lattice(lattice, w) for w in words]) and np.allclose(got, [lattice.long_word(w) for w in words])
    x = np.array([1e-6, 0.5, 1.0, 3.3, 100.0])
    assert np.allclose(lattice_lm.lgamma(x), [math.lgamma(v) for v in x])


def test_scores_against_plain_python(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in lattice_lm.score_documents(docs, queries.PIECES, block_bytes=50_000).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    total = sum(c.values()) + ends + len(c) + 1 + 1
    for i, ws in texts.items():
        base = sum(math.log10((c[w] + 1) / total) for w in ws) + math.log10((ends + 1) / total)
        r = got[i]
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(ws) + 1 and r["held_out"] == held[i]
        assert r["n_known"] == sum(w in c for w in ws) + 1 and r["train_tokens"] == sum(c.values()) + ends and r["score"] < 0
    whole = {r["doc_id"]: r["score"] for r in lattice_lm.score_documents(docs, queries.PIECES).collect()}
    assert all(math.isclose(whole[i], got[i]["score"], rel_tol=1e-9) for i in texts)


def test_labellers_are_told_apart():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.6]
    v = [np.where(rng.random(20_000) < r, good, ~good) for r in right]
    patterns = collections.Counter((sum((2 if x else 1) * 3**j for j, x in enumerate(row))) for row in zip(*v))
    post, accuracy = weak_quality.fit_labellers(patterns, m=3)
    assert all(abs(a - r) < 0.06 for (a, _), r in zip(accuracy, right))
    assert post[2 + 6 + 18] > 0.9 > 0.1 > post[1 + 3 + 9]


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["keep"] for r in weak_quality.judge(documents(spark, folder)).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    right = [kept[r["doc_id"]] == bool(r["quality"]) for r in labels]
    good = [kept[r["doc_id"]] for r in labels if r["quality"] and not r["toxic"]]
    assert np.mean(right) > 0.97 and np.mean(good) > 0.98


def linked(keys, near):
    label = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_simhash_against_brute_force(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    label = linked([int(r["fingerprint"], 16) for r in got], lambda a, b: (a ^ b).bit_count() <= 2)
    least = {x: min(r["doc_id"] for r, y in zip(got, label) if y == x) for x in label}
    assert [r["component_id"] for r in got] == [least[x] for x in label]
    odd = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(odd_docs(spark)).collect()}
    assert odd[3] == odd[4] == "0" * 16 != odd[5]


@pytest.mark.parametrize("tile", [7, 4096])
def test_no_link_is_lost_in_tiles(spark, tile):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**62, 20)]
    for _ in range(250):
        fps.append(fps[rng.integers(len(fps))] ^ sum(1 << int(b) for b in set(rng.integers(0, 62, 3))))
    fps = sorted(set(fps))
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, tile)
    roots = {r["node"]: r["root"] for r in linking.component_roots(links).collect()}
    label = linked(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [roots.get(f, f) for f in fps] == [fps[x] for x in label]


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(5, 5), (None, 3)]
    roots = {r["node"]: r["root"] for r in linking.component_roots(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


def test_language_is_found_in_held_out_texts(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd_docs(spark)).collect()}
    assert odd[3] == odd[4] == odd[5] == ("und", 0.0) and odd[9][0] == "en"


def test_forest_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype("f4")
    x[200:400] = x[200]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[7].tolist(), 0), (9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0], 0), (None, [1.0] * 16, 0)]
    vectors = rp_forest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"))
    got = collections.defaultdict(list)
    for r in rp_forest.search(vectors, vectors.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    y, found = x.astype("f8"), []
    for q, rows in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s.round(9)))[:10]
        assert [r for r, _, _ in rows] == list(range(1, 11)) and all(math.isclose(v, s[i], rel_tol=1e-12) for _, i, v in rows)
        found.append(len({i for _, i, _ in rows} & set(best.tolist())) / 10)
    assert np.mean(found) >= 0.9
    assert [i for _, i, _ in got[300]] == list(range(200, 210))


def test_packing_round_trip(spark):
    docs = odd_docs(spark).select("doc_id", "text").union(documents(spark).selectExpr("doc_id + 100", "text"))
    tool = Tokenizer.from_file(queries.WORD_BPE)
    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(np.array(tool.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4"))
    rows = packing.pack(docs, queries.WORD_BPE, length=256).collect()
    fill, tokens = collections.defaultdict(list), collections.Counter()
    for r in rows:
        whole = next(x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"])
        assert zlib.crc32(whole[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["cut_before"] == (r["start"] > 0) and r["cut_after"] == (r["start"] + r["length"] < len(whole))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {i: sum(map(len, xs)) for i, xs in ids.items()}
    for s, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or s == max(fill)


def test_leaks_by_template(spark):
    bench = spark.createDataFrame([(1, "Say, Tom has 3 apples and 12 km to go, then Tom eats 3 apples."), (2, ITEM), (2, ITEM), (3, "no"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Well. Say, Ann has 5 apples and 9 miles to go, then Ann eats 5 apples. Yes."),
        (2, "Say, Ann has 5 apples and 9 miles to go, then Bob eats 6 apples."),
        (3, ITEM.upper() + "!"), (3, ITEM.replace("river", "mill")), (4, "no"), (5, None), (6, "the quick brown fox jumps over nothing at all"), (None, "x " + ITEM),
    ], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["reparameterised"]) for r in decontam.leaks(docs, bench).collect())
    assert [x for x in got if x[0] in (1, 2)] == [(1, 1, True)]
    assert {(i, j) for i, j, _ in got} - {(1, 1)} == {(3, 2), (0, 2)}
    kept = [r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()]
    assert {2, 4, 5, 6} <= set(kept) and 1 not in kept and None not in kept


def test_leaks_find_every_planted_item(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    items = bench.collect()
    planted = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in items if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert planted <= got and len(got - planted) <= 2


def test_resynchronised_counts():
    tool = Tokenizer.from_file(queries.BYTE_BPE)
    rng = np.random.default_rng(4)
    words = ["the", "don't", "x1", "<|endoftext|>", "éa", "日本語", "\n\n", "  ", "\t", "12345", "!!", "😀", "'s", "|", " ", "\x1c"]
    for _ in range(150):
        text = "".join(words[rng.integers(len(words))] + ["", " ", "\n"][rng.integers(3)] for _ in range(rng.integers(0, 120)))
        want = len(tool.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((20, 4), (7, 2), (64, 16)):
            assert token_counts.resync_count(text, lambda p: tool.encode(p, add_special_tokens=False).offsets, chunk, overlap) == want
        pieces = token_counts.pieces_of(text.encode())
        assert sum(len(tool.encode(p.decode(), add_special_tokens=False).ids) for p in pieces) == want
    assert token_counts.resync_count("a" * 3000, lambda p: tool.encode(p, add_special_tokens=False).offsets, 50, 5) == len(tool.encode("a" * 3000).ids)


def test_counts_of_odd_texts(spark):
    tool = Tokenizer.from_file(queries.BYTE_BPE)
    got = token_counts.count_tokens(odd_docs(spark), queries.BYTE_BPE, huge=1000, chunk=500, overlap=20).collect()
    texts = dict(ROWS)
    for r in got:
        n = len(tool.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 1024)


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "<|im_end|> a<\\|b\\"), (1, 1, "assistant", "<|im_sep|>x\n"), (1, 1, "assistant", "y <\\\\|"), (1, 2, None, None), (2, None, "assistant", "z"), (2, None, "assistant", "z"),
            (None, 5, "us%<\ner", "é😀"), (3, 0, "user", "w" * 50_000)]
    turns = spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, mask int, formatted string")
    got = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(turns)).collect()}
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    for i, said in by.items():
        loss = "".join(t for role, t in said if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for role, t in said)
        r = got[i]
        assert (r["n_turns"], r["loss_chars"]) == (len(said), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_stages_keep_rows_and_columns(spark):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        assert not set(r["doc_id"] for r in kept.collect()) - {i for i, _ in ROWS}
        assert stage(spark, odd_docs(spark, []), SMALL).collect() == [], name
    one = collections.Counter(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert one[1] == 1 and one[None] == 1 and one[3] == 1 and one[4] == 0


def test_pipeline_against_plain_python(spark):
    """Each stage's decision is made again for each document, the near copies by brute force."""
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.train(docs)
    known = {i for i, t in texts.items() if model.predict(t)[1] >= langid.LEAST_SCORE}
    stay = docs.where(docs["doc_id"].isin(sorted(known)))
    weights, _ = weak_quality.train(stay)

    def good(raw):
        used, found = weak_quality.features(raw, weak_quality.signals(raw))
        return weights[used] @ found + weights[-1] >= 0

    left = sorted(i for i in known if good(texts[i].encode()))
    label = linked([five_words(texts[i]) for i in left], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    firsts = {i for n, i in enumerate(left) if label.index(label[n]) == n}
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    leaking = {r["doc_id"] for r in decontam.leaks(docs, bench).collect()}
    assert {i for i in firsts for b in bench.collect() if b["text"] in texts[i]} <= leaking
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()}
    assert got == firsts - leaking


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_repeated_rows_with_other_columns(spark):
    """Of rows with one id and text the first by its other columns stays, whatever the partitions."""
    docs = spark.createDataFrame([(1, "a b", "z", {"k": 1}), (1, "a b", "y", {"k": 2}), (2, "a  B", "x", None)], "doc_id long, text string, __digest string, m map<string,int>")
    for parts in (1, 3):
        (row,) = near_copies.one_of_each(docs.repartition(parts)).collect()
        assert (row["doc_id"], row["__digest"], row["m"]) == (1, "y", {"k": 2})
