"""User callbacks on distinct keys, the content-addressed feature cache, counters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import sha_key
from ..session import Folder


def featurize(keys: DataFrame, key: str, fn: Callable[[str], object], value_type: str,
              chunk: int = fv.FEATURIZE_CHUNK) -> DataFrame:
    """Run ``fn`` once per distinct key: ``key, value, error``.

    A raising key yields a NULL value and the message; the rest goes on. The distinct
    below the Python stage also spreads the keys evenly over the tasks.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), chunk):
                values, errors = [], []
                part = frame[key].iloc[start:start + chunk]
                for text in part:
                    try:
                        values.append(fn(text))
                        errors.append(None)
                    except Exception as exc:  # the callback is the user's
                        values.append(None)
                        errors.append(str(exc))
                yield pd.DataFrame({key: part.to_numpy(), "value": pd.Series(values, dtype=object), "error": errors})

    kind = keys.schema[key].dataType.simpleString()
    return keys.select(key).distinct().mapInPandas(run, f"`{key}` {kind}, value {value_type}, error string")


def featurize_sql(keys: DataFrame, key: str, value: Column, error: Column) -> DataFrame:
    """Same contract with SQL expressions; ``error`` non-null quarantines the key."""
    checked = keys.select(key).distinct().withColumn("error", error)
    return checked.select(key, F.when(F.col("error").isNull(), value).alias("value"), "error")


def quarantine(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and failed rows with their error."""
    return results.where("error IS NULL").drop("error"), results.where("error IS NOT NULL").drop("value")


def canonicalize(strings: DataFrame, key: str, fn: Callable[[str], str | None] | None = None,
                 save: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``key, canonical`` and the keys without a canonical form. Default: trimmed lower case.

    Both tables come from one mapping; ``save`` stores it, so that ``fn`` runs once per key.
    """
    if fn is None:
        form = F.lower(F.trim(F.col(key)))
        mapped = strings.select(key).distinct().select(key, F.when(form != "", form).alias("canonical"))
    else:
        mapped = featurize(strings, key, fn, "string").select(key, F.col("value").alias("canonical"))
    mapped = mapped if save is None else save(mapped)
    return mapped.where("canonical IS NOT NULL"), mapped.where("canonical IS NULL").select(key)


class RunCounters:
    """Misses and failures of a written run, counted when they are asked for."""

    def __init__(self, run: DataFrame):
        self._run = run

    @cached_property
    def get(self) -> dict[str, int]:
        return self._run.agg(F.count(F.lit(1)).alias("misses"), F.count("error").alias("failed")).first().asDict()


@dataclass
class CacheResult:
    """Tables keyed by ``sha``, and the counters of the run."""

    features: DataFrame
    failed: DataFrame
    hits: DataFrame
    misses: DataFrame
    counters: RunCounters


class FeatureCache:
    """Parquet table of features under the SHA-256 of their key, made of committed runs.

    A run hashes the keys, splits the distinct hashes into hits and misses by joins on the hash
    alone, and computes the misses only, so the long keys of hits never move. Its results are
    written once, by one job, below ``runs/run=<id>`` in folders by hash prefix, and become visible by
    one rename of its commit file; what a lost run wrote is never read. A commit names the run it
    adds and the runs it replaces. With more than ``most_runs`` visible runs they are merged into
    one, so the number of folders stays bounded; replaced runs are removed one merge later, when no
    reader that began before can still need them. Failed and oversize entries are stored with
    their error and not served, so they are tried again next time.
    """

    def __init__(self, spark: SparkSession, path: str, value_type: str, max_bytes: int | None = None,
                 prefix: int = 1, most_runs: int = 16):
        self.spark, self.path, self.value_type, self.max_bytes = spark, path, value_type, max_bytes
        self.prefix, self.most_runs = prefix, most_runs
        self._commits, self._folders = Folder(spark, f"{path}/commits"), Folder(spark, f"{path}/runs")

    def _visible(self) -> tuple[list[str], list[str]]:
        """Runs that are committed and not replaced, and runs that are replaced."""
        commits = [json.loads(text) for name in self._commits.names() if not name.startswith(".") and (text := self._commits.read(name))]
        gone = {run for c in commits for run in c["replaces"]}
        return sorted(c["run"] for c in commits if c["run"] not in gone), sorted(gone)

    def _read(self, runs: list[str], prefixes: list[str] | None = None) -> DataFrame:
        """Entries of some runs; only the wanted prefixes are read."""
        schema = f"sha string, value {self.value_type}, error string, run string, prefix string"
        if not runs:
            return self.spark.createDataFrame([], schema).drop("run", "prefix")
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/runs")
        found = reader.parquet(*[f"{self.path}/runs/run={run}" for run in runs])
        if prefixes is not None:
            found = found.where(F.col("prefix").isin(prefixes))
        return found.drop("run", "prefix")

    def _commit(self, run: str, replaces: list[str]) -> None:
        self._commits.publish(f"{run}.json", json.dumps({"run": run, "replaces": replaces}))

    def _write(self, entries: DataFrame, replaces: Sequence[str] = ()) -> str:
        """One run: few files per prefix, visible as a whole."""
        run = uuid.uuid4().hex
        placed = entries.withColumn("prefix", F.substring("sha", 1, self.prefix)).hint("rebalance", F.col("prefix"))
        placed.write.partitionBy("prefix").parquet(f"{self.path}/runs/run={run}")
        self._commit(run, list(replaces))
        return run

    def table(self) -> DataFrame:
        """Usable entries ``sha, value``; two runs may have computed the same key."""
        return self._read(self._visible()[0]).where("error IS NULL").select("sha", "value").dropDuplicates(["sha"])

    def failures(self) -> DataFrame:
        """``sha, error`` of keys that have failed and have no usable entry."""
        stored = self._read(self._visible()[0])
        failed = stored.where("error IS NOT NULL").select("sha", "error").dropDuplicates(["sha", "error"])
        return failed.join(stored.where("error IS NULL").select("sha"), "sha", "left_anti")

    def _wanted_prefixes(self, wanted: DataFrame) -> list[str] | None:
        """Prefixes among the wanted hashes (at most 16 for each digit), or none if they are all there."""
        seen = [r[0] for r in wanted.select(F.substring("sha", 1, self.prefix).alias("p")).distinct().collect() if r[0] is not None]
        return seen if len(seen) < 16**self.prefix else None

    def split(self, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Distinct hashes found and not found in the cache."""
        wanted = keys.select(sha_key(F.col(key)).alias("sha")).distinct()
        stored = self._read(self._visible()[0], self._wanted_prefixes(wanted)).where("error IS NULL").select("sha")
        return wanted.join(stored, "sha", "left_semi"), wanted.join(stored, "sha", "left_anti")

    def get_or_compute(self, keys: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> CacheResult:
        """Features of all keys. ``compute`` maps missing ``key`` rows to ``key, value, error``."""
        runs, _ = self._visible()
        wanted = keys.select(sha_key(F.col(key)).alias("sha"))
        # An empty cache has nothing to look up.
        stored = self._read(runs, self._wanted_prefixes(wanted) if runs else None).where("error IS NULL").select("sha", "value")
        wanted = wanted.distinct()
        hits, missing = (wanted.join(stored.select("sha"), "sha", how) for how in ("left_semi", "left_anti"))
        # Duplicates are dropped after the join, so only served entries move.
        found = stored.join(hits, "sha", "left_semi").dropDuplicates(["sha"])
        addressed = keys.select(key, sha_key(F.col(key)).alias("sha"))
        lacking = addressed.join(missing, "sha", "left_semi").dropDuplicates(["sha"]).select(key)
        computed = compute(lacking).withColumn("sha", sha_key(F.col(key)))
        if self.max_bytes is not None:
            size = F.octet_length(F.to_json(F.struct("value")))
            over = F.col("error").isNull() & (size > F.lit(self.max_bytes))
            computed = computed.withColumn("error", F.when(over, "oversize entry").otherwise(F.col("error")))
            computed = computed.withColumn("value", F.when(F.col("error").isNull(), F.col("value")))
        done = self._read([self._write(computed.select("sha", "value", "error"))])
        good, failed = quarantine(done)
        if len(runs) >= self.most_runs:
            self.merge()
        return CacheResult(found.unionByName(good), failed, hits, done.select("sha"), RunCounters(done))

    def merge(self) -> None:
        """Put all visible runs into one and remove what the merge before has replaced.

        Usable entries are kept once per key, failures once per message. Runs that are written at
        the same time are not touched; readers see the old runs or the new one.
        """
        runs, replaced = self._visible()
        if len(runs) > 1:
            stored = self._read(runs)
            # The key is in the grouping, so copies of an entry are folded before they move.
            usable = stored.where("error IS NULL").groupBy("sha").agg(F.first("value").alias("value")).withColumn("error", F.lit(None).cast("string"))
            failed = stored.where("error IS NOT NULL").dropDuplicates(["sha", "error"])
            self._write(usable.unionByName(failed.select("sha", "value", "error")), runs)
        for run in replaced:
            self._folders.remove(f"run={run}")
            self._commits.remove(f"{run}.json")

    def attach(self, rows: DataFrame, key: str, features: DataFrame) -> DataFrame:
        """Features given back to every row with that key."""
        return rows.withColumn("sha", sha_key(F.col(key))).join(features, "sha").drop("sha")


def count_stages(**stages: DataFrame) -> DataFrame:
    """One row per named stage with its row count: ``stage, n``."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out
