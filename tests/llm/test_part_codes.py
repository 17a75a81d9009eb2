"""Vector codes against plain Python."""

import hashlib

import numpy as np
import pytest

from pairspark.llm import part_codes


def plain(rows, parts, entries, rounds):
    """``{(id, vector): (code, error)}`` and the codebooks by the rule, part by part."""
    vectors = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows]
    width = len(vectors[0][1]) // parts
    first = {}
    for (i, v), (_, raw) in sorted(zip(vectors, rows), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1][1])):
        if i is not None:
            first.setdefault(i, v)
    start = [first[i] for i in sorted(first)[:entries]]
    books = [[list(v[p * width:(p + 1) * width]) for v in start] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            by = {}
            for _, v in vectors:
                part = v[p * width:(p + 1) * width]
                by.setdefault(near(p, part)[1], []).append(part)
            for k, members in by.items():
                new[p][k] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    out = {}
    for i, v in vectors:
        found = [near(p, v[p * width:(p + 1) * width]) for p in range(parts)]
        out[i, v] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block", [3, 4096])
def test_codes_against_plain_python(spark, block, monkeypatch):
    monkeypatch.setattr(part_codes, "BLOCK", block)
    rng = np.random.default_rng(6)
    values = [tuple(float(x) for x in rng.normal(0, 0.02, 12).astype("f4")) for _ in range(300)]
    rows = [(int(i), v) for i, v in zip(rng.permutation(400)[:300] - 50, values)]
    rows += rows[:40] + [(rows[0][0], values[5]), (None, values[7]), (500, values[9]), (501, values[9])]
    odd = [(900, None), (901, (None, *values[0][1:])), (902, (float("nan"), *values[0][1:])), (903, (float("-inf"), *values[0][1:])), (-999, None)]
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(rows) + len(odd))]
    table = spark.createDataFrame([(i, v, y, "x", 1) for (i, v), y in zip(rows + odd, labels)], "vec_id long, embedding array<float>, label int, code string, error int")
    got = part_codes.code_digest(table.repartition(3), 4, 10, 2).collect()
    want, sha = plain(rows, 4, 10, 2)
    keyed = sorted((i is None, i or 0, *want[i, tuple(int(np.floor(256 * x)) for x in v)], y) for (i, v), y in zip(rows, labels))
    sums = {}
    for *_, e, y in keyed:
        sums[y] = sums.get(y, 0) + e
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == sorted((a, b, c, e, sums[y]) for a, b, c, e, y in keyed)
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert part_codes.code_digest(spark.createDataFrame([], schema)).collect() == []
    (row,) = part_codes.code_digest(spark.createDataFrame([(3, [0.5, -0.001, 2.0], None)], schema)).collect()
    assert (row["code"], row["error"], row["label_error"]) == ("00" * 16, 0, 0)
    with pytest.raises(Exception, match="can't be coded"):
        part_codes.code_digest(spark.createDataFrame([(3, [2.0**21], None)], schema)).collect()
