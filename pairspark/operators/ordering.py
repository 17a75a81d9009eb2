"""Global order without a single-task window.

Ranks, running totals and threshold draws all need a total order. A window without
``partitionBy`` would run in one task, and one partitioned by a hot group would put
that whole group into one. The helpers here cut the order into buckets first:

* value order: buckets between quantile cut points; a value that *is* a cut point gets
  its own bucket, so a very frequent value never drags its neighbours along;
* hash order: buckets are hash prefixes, uniform by construction.

Only the totals per bucket (bounded by the bucket count, not by the data) are broadcast.
Buckets depend on values alone, never on task ids, so a retried task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

MAX_BUCKETS = 4096
HOT_ROWS = 1_000_000  # a hot group has more rows than one task sorts with ease
HOT_GROUPS = 1024  # cut points of up to this many hot groups are broadcast, of more they are joined
_STEP = 64


def bucket_count(df: DataFrame, buckets: int | None = None, rows: int = 0) -> int:
    """Cut points to use: one per HOT_ROWS rows and at least the session's shuffle partitions, bounded."""
    if buckets is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(partitions, -(-rows // HOT_ROWS))
    return max(2, min(MAX_BUCKETS, buckets))


def _cut_points(value: Column, n: int) -> Column:
    probabilities = [i / n for i in range(n + 1)]
    return F.array_sort(F.array_distinct(F.percentile_approx(value, probabilities, F.lit(max(1000, 10 * n)))))


def _coarse(cuts: Column) -> Column:
    """Every _STEP-th cut point, the upper level of the two-level lookup."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / _STEP).cast("int")),
        lambda i: F.element_at(cuts, i * _STEP + 1),
    )


def _place(df: DataFrame, cuts: Column, coarse: Column, value: Column, out: str) -> DataFrame:
    """Add the bucket of a value: 2k at cut point k, 2k+1 strictly after it (k counted from 1).

    The steps are columns of their own, so each lookup runs once per row.
    """
    df = df.withColumn("__skip", (F.greatest(F.size(F.filter(coarse, lambda c: c <= value)), F.lit(1)) - 1) * _STEP)
    fine = F.slice(cuts, F.col("__skip") + 1, F.lit(_STEP))
    df = df.withColumn("__k", F.col("__skip") + F.size(F.filter(fine, lambda c: c <= value)))
    k = F.col("__k")
    bucket = F.when(k == 0, F.lit(1)).when(F.get(cuts, k - 1) == value, 2 * k).otherwise(2 * k + 1).cast("int")
    return df.withColumn(out, bucket).drop("__skip", "__k")


def value_buckets(
    df: DataFrame,
    value: str,
    out: str,
    by: Sequence[str] = (),
    buckets: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add an order-preserving bucket number for a numeric column (non-null).

    Only hot groups are cut (without ``by`` the table is one group), those of more than ``hot_rows``
    rows; every other group is small enough to stay one bucket (number 1). Even bucket numbers
    hold a single value each.
    """
    cut = _cut(df, value, out, list(by), buckets, hot_rows=hot_rows)
    return df.withColumn(out, F.lit(1)) if cut is None else cut


def _cut(df: DataFrame, value: str, out: str, by: list[str], buckets: int | None,
         splittable: Column | None = None, hot_rows: int | None = None) -> DataFrame | None:
    """``df`` with buckets, or None when no group is hot. ``splittable`` limits the groups looked at."""
    point = F.col(value).cast("double")
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if not by:
        rows = df.count()
        if rows <= hot_rows:
            return None
        cuts = df.agg(_cut_points(point, bucket_count(df, buckets, rows))).first()[0]
        # At most MAX_BUCKETS + 1 numbers, computed once, become a constant of the plan.
        coarse = F.lit(np.array(cuts[::_STEP]))
        return _place(df, F.lit(np.array(cuts)), coarse, point, out)
    candidates = df if splittable is None else df.where(splittable)
    counts = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    hot = checkpointed(df.sparkSession, counts.where(F.col("__n") > F.lit(hot_rows)))
    groups, largest = hot.agg(F.count(F.lit(1)), F.max("__n")).first()
    if not groups:
        return None
    side = F.broadcast if groups <= HOT_GROUPS else lambda table: table
    hot_cuts = (
        null_safe_join(candidates.select(*by, value), side(hot.select(*by)), by, "left_semi")
        .groupBy(*by)
        .agg(_cut_points(point, bucket_count(df, buckets, largest)).alias("__cuts"))
    )
    hot_cuts = checkpointed(df.sparkSession, hot_cuts.withColumn("__coarse", _coarse(F.col("__cuts"))))
    joined = null_safe_join(df, side(hot_cuts), by, "left")
    placed = _place(joined, F.col("__cuts"), F.col("__coarse"), point, out)
    whole = F.when(F.col("__cuts").isNull(), F.lit(1)).otherwise(F.col(out))
    return placed.withColumn(out, whole).drop("__cuts", "__coarse")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where NULL matches NULL; the keys of the left side are kept."""
    keys = list(keys)
    marked = right
    for key in keys:
        marked = marked.withColumnRenamed(key, f"__r_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(marked[f"__r_{key}"])
    return left.join(marked, condition, how).drop(*[f"__r_{key}" for key in keys])


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: dict[str, Column],
    by: Sequence[str] = (),
    buckets: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add exclusive running sums along ``order`` (ascending, numeric columns).

    ``totals`` names each output and the expression it sums. Rows must be unique per
    (by, order); compress ties with a ``groupBy`` before, or add a tie-break column.
    A later ordering column cuts only the single-value buckets of the one before it.
    ``buckets`` and ``hot_rows`` (HOT_ROWS by default) set how finely and from which size a
    group is cut; they change the plan and never the result.
    """
    by, order = list(by), list(order)
    bucketed, places = df, []
    for i, column in enumerate(order):
        tied = F.col(places[-1]) % 2 == 0 if places else None
        cut = _cut(bucketed, column, f"__b{i}", by + places, buckets, tied, hot_rows)
        if cut is None:
            break
        bucketed = cut
        places.append(f"__b{i}")
    return _running(bucketed, [F.col(c) for c in order], totals, by, places)


def _running(bucketed: DataFrame, order: list[Column], totals: dict[str, Column],
             by: list[str], places: list[str]) -> DataFrame:
    inner = Window.partitionBy(*by, *places).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = {name: F.coalesce(F.sum(expr).over(inner), F.lit(0)) for name, expr in totals.items()}
    if not places:
        return bucketed.withColumns(local)
    per_bucket = bucketed.groupBy(*by, *places).agg(
        *[F.sum(expr).alias(f"__s_{name}") for name, expr in totals.items()]
    )
    # One row per bucket: a plain group has one, a hot group a bounded number.
    outer_order = [F.col(p) for p in places]
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*outer_order)
    outer = outer.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, *places,
        *[F.coalesce(F.sum(f"__s_{name}").over(outer), F.lit(0)).alias(f"__o_{name}") for name in totals],
    )
    # Only hot groups have offsets other than zero. One group has a bounded number of them; of
    # many groups the planner judges the size.
    offsets = offsets.where(" OR ".join(f"__o_{name} <> 0" for name in totals))
    result = null_safe_join(bucketed, offsets if by else F.broadcast(offsets), by + places, "left")
    shifted = {name: total + F.coalesce(F.col(f"__o_{name}"), F.lit(0)) for name, total in local.items()}
    return result.withColumns(shifted).drop(*places, *[f"__o_{name}" for name in totals])


def global_row_number(
    df: DataFrame,
    order: Sequence[str],
    out: str,
    by: Sequence[str] = (),
    buckets: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """1-based row number along unique numeric ``order`` columns, optionally per group."""
    ranked = running_totals(df, order, {out: F.lit(1).cast("long")}, by, buckets, hot_rows)
    return ranked.withColumn(out, (F.col(out) + 1).cast("long"))


def row_id_number(df: DataFrame, row_id: str, out: str) -> DataFrame:
    """1-based row number along the ids of ``monotonically_increasing_id``, stored with all their rows.

    Such an id is a block's number (the upper bits) and the row's place in the block, so only the
    rows per block are counted and broadcast. Raises if a block has lost rows.
    """
    block, place = F.shiftright(row_id, 33), F.col(row_id).bitwiseAND(F.lit((1 << 33) - 1))
    blocks = df.groupBy(block.alias("__block")).agg(F.count(F.lit(1)).alias("__n"), F.max(place).alias("__last"))
    whole = F.when(F.col("__last") + 1 != F.col("__n"), F.raise_error(F.lit("row ids are missing")).cast("long")).otherwise(F.col("__n"))
    # One row per block, as many as the table had splits.
    before = Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("__block", F.coalesce(F.sum(whole).over(before), F.lit(0)).alias("__before"), whole.alias("__n"))
    joined = df.withColumn("__block", block).join(F.broadcast(offsets.where("__n > 0").drop("__n")), "__block")
    return joined.withColumn(out, F.col("__before") + place + 1).drop("__block", "__before")


def hash_running_totals(
    df: DataFrame,
    hashed: str,
    totals: dict[str, Column],
    prefix: int = 3,
) -> DataFrame:
    """Exclusive running sums along a unique hex hash column; buckets are its prefixes."""
    bucketed = df.withColumn("__hash_prefix", F.substring(hashed, 1, prefix))
    return _running(bucketed, [F.col(hashed)], totals, [], ["__hash_prefix"])


def average_ranks(df: DataFrame, value: str, out: str, weight: str | None = None,
                  by: Sequence[str] = (), **cut) -> DataFrame:
    """Average rank of every distinct value: one row per (by, value). ``cut`` as in :func:`running_totals`."""
    by = list(by)
    count = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = df.groupBy(*by, value).agg(count.alias("__c"))
    ranked = running_totals(distinct, [value], {"__before": F.col("__c")}, by, **cut)
    rank = F.col("__before") + (F.col("__c") + 1) / 2
    return ranked.select(*by, value, rank.cast("double").alias(out))


def smallest_hash_cut(df: DataFrame, hashed: str, take: Callable[[int], int], prefix: int = 4) -> str:
    """The n-th smallest value of a unique hex hash column, ``n = take(rows)``.

    Rows are never shuffled as a whole: counts per prefix (at most 16^prefix, a bounded
    collect) locate the bucket of the cut, and only that bucket is ordered. ``n`` <= 0 gives
    an empty string, below every hash. The cut is computed once, here, and is a constant of
    every plan that uses it.
    """
    place = F.substring(hashed, 1, prefix)
    counts = sorted(tuple(r) for r in df.groupBy(place).agg(F.count(F.lit(1))).collect())
    left = take(sum(c for _, c in counts))
    if left <= 0:
        return ""
    for bucket, count in counts:
        if left <= count:
            break
        left -= count
    inside = df.select(F.col(hashed).alias("hash")).where(F.substring("hash", 1, prefix) == bucket)
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("hash")))
    return ranked.where(F.col("r") <= left).agg(F.max("hash")).first()[0]
