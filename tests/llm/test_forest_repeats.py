"""Repeated rows and ids with several vectors take no places of others."""

import collections

import numpy as np

from pairspark.llm import rp_forest


def answers(spark, rows, asked, k):
    vectors = rp_forest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for r in rp_forest.search(vectors, vectors.where(f"vec_id IN ({asked})"), k=k, opened=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_all_rows_three_times(spark):
    x = np.random.default_rng(4).normal(size=(300, 8)).astype("f4")
    x[1:11] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    once = answers(spark, rows, "0, 1, 50", 20)
    assert answers(spark, rows * 3, "0, 1, 50", 20) == once and all(len(r) == 20 for r in once.values())


def test_ids_with_several_vectors():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(60, 4)), rng.normal(size=(1, 4))
    import pyarrow as pa

    ids = np.repeat(np.arange(6), 10)
    table = lambda name, i, v: pa.table({name: i, "v": pa.array([r.astype("<f8").tobytes() for r in v])})
    got = rp_forest._search(5)(table("vec_id", ids, x), table("query_id", [99], q)).to_pydict()
    best = (x @ q[0]).reshape(6, 10).max(axis=1)
    assert got["vec_id"] == np.argsort(-best)[:5].tolist() and np.allclose(got["score"], np.sort(best)[::-1][:5])
