"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from pairspark.operators.featurize import FeatureCache, featurize_sql
from pairspark.plans import catalog
from pairspark.plans.views import lines
from pairspark.session import build_session, checkpointed, fresh_dir, spread

HEADLINE = [
    "screen_top_k", "screen_vectors", "score_pairs", "top_k_per_protein", "hydrate_pairs", "feature_cache", "read_fasta",
    "residue_features", "merge_overlaps", "percentile_rank", "error_metrics", "spearman", "concordance_index",
    "roc_auc_by_group", "evaluate", "contact_graph", "neighbor_aggregate", "segment_softmax", "soft_cluster_pool",
    "component_labels", "random_split", "group_split_many", "cold_split", "weighted_sample", "stream_top_k",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    # One unmeasured run starts the executors' code generation and Python workers.
    catalog.QUERIES["score_pairs"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    hits, keys = cache_hits(spark, folder)
    seconds["cache_hits"] = round(hits, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "rates": {
            "screened_pairs_per_sec": round(vectors * vectors / seconds["screen_vectors"]),
            "model_scored_pairs_per_sec": round(vectors * 10 / seconds["score_pairs"]),
            "cached_keys_per_sec": round(keys / hits),
        },
    }))
    spark.stop()


def cache_hits(spark, folder: str) -> tuple[float, int]:
    """Seconds to serve features of all line keys from a filled cache, and their number."""
    keys = checkpointed(spark, spread(lines(spark, folder).select("line_key")))
    cache = FeatureCache(spark, fresh_dir(spark, "bench-cache"), "int")

    def lengths(missing):
        return featurize_sql(missing, "line_key", F.length("line_key"), F.lit(None).cast("string"))

    cache.get_or_compute(keys, "line_key", lengths)
    start = time.perf_counter()
    cache.get_or_compute(keys, "line_key", lengths).features.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, keys.count()


if __name__ == "__main__":
    main()
