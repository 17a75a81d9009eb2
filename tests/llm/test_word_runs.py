"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from pairspark.llm import queries, word_runs


def brute(words):
    """All maximal stretches with a period held three times, by trying every period."""
    n, found = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(24, 3 * q) and not any(all(words[j] == words[j + r] for j in range(start, end - r)) for r in range(1, q)):
                found.add((start, end - start, q))
    return sorted(found)


def sequences():
    rng = np.random.default_rng(7)
    out = [[], [0], [1] * 23, [1] * 24, [1] * 700, [1, 2] * 12, [1, 2] * 40 + [1], [1, 2, 3, 4, 5, 6, 7] * 3 + [1, 2], [1, 2, 3, 4, 5, 6, 7] * 3 + [1, 2, 3]]
    for _ in range(150):
        s = []
        while len(s) < rng.integers(10, 400):
            unit = rng.integers(0, rng.integers(1, 6) + 1, rng.integers(1, 45)).tolist()
            s += (unit * rng.integers(1, 9))[:rng.integers(1, 200)]
        if rng.random() < 0.3:
            s = (s * 4)[:900]
        out.append(s)
    out += [rng.integers(0, 2, 800).tolist(), rng.integers(0, 2**30, 300).tolist() * 4]
    # Runs inside runs: a long period whose unit holds short runs.
    out.append(([1] * 30 + [2, 3] * 15 + [4] * 25 + [5]) * 5)
    return out


def test_runs_against_brute_force(monkeypatch):
    rows = sequences()
    want = [brute(s) for s in rows]
    assert sum(map(len, want)) > 150 and max(q for w in want for _, _, q in w) > 80
    arrays = [np.array(s, np.int64) for s in rows]
    assert word_runs.runs_of(arrays) == want
    monkeypatch.setattr(word_runs, "CELLS", 64)
    assert word_runs.runs_of(arrays) == want
    with pytest.raises(ValueError):
        word_runs.runs_of(arrays, times=2)


def test_transform_gives_exact_products():
    rng = np.random.default_rng(1)
    for size in (16, 64, 512):
        a, b = (rng.integers(0, word_runs.PRIME, (size, 3)) for _ in range(2))
        got = word_runs.inverse(word_runs.transform(a.astype(np.uint64)) * word_runs.transform(b.astype(np.uint64)) % np.uint64(word_runs.PRIME))
        for c in range(3):
            want = [sum(int(a[i, c]) * int(b[(k - i) % size, c]) for i in range(size)) * size % word_runs.PRIME for k in range(size)]
            assert got[:, c].tolist() == want


def test_long_sequences_take_few_steps():
    rng = np.random.default_rng(2)
    same = np.zeros(60_000, np.int64)
    mixed = np.concatenate([np.tile(rng.integers(0, 50, 7_001), 4), rng.integers(0, 9, 9_000), np.tile([1, 2, 3], 4_000)])
    got = word_runs.runs_of([same, mixed])
    assert got[0] == [(0, 60_000, 1)] and any(q == 7_001 for _, _, q in got[1]) and any(q == 3 and n >= 12_000 for _, n, q in got[1])


def digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    told = sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode())
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, told, sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op13_word_runs"](spark, folder)
    assert got.columns == COLUMNS
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    short = {i for i, t in texts.items() if len((t or "").split()) < 1500}
    assert len(short) > 150 and set(rows) == set(texts) and sum(rows[i][1] > 0 for i in rows) > 5
    assert [rows[i] for i in sorted(short)] == [digest(i, texts[i]) for i in sorted(short)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, " a" * 30 + "\n"), (4, " a" * 30 + "\n"), (None, "b c " * 24), (5, "x" * 100_000), (6, "\x1c \x85 " * 30)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = word_runs.run_digest(word_runs.with_runs(docs.repartition(2), word_runs.planted_repeat)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(map(tuple, got), key=key) == sorted((digest(*r) for r in rows), key=key)
    assert word_runs.run_digest(word_runs.with_runs(docs.where("false"))).collect() == []
