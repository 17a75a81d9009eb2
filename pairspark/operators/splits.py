"""Reproducible splits and samples.

Draws are decided by a seeded md5 of the key against a threshold hash. The threshold is
found from counts per hash prefix, so a split of exact size costs aggregations and no
shuffle of the rows, and membership in a drawn set is a comparison, not a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import hash_hex, hash_uniform
from ..session import checkpointed
from .ordering import HOT_ROWS, bucket_count, hash_running_totals, null_safe_join, smallest_hash_cut


def _cut(df: DataFrame, key: str, fraction: float, seed: int) -> str:
    """Hash below or at which round(fraction * n) of the unique keys lie."""
    hashed = df.select(hash_hex(F.col(key), seed).alias("hash"))
    return smallest_hash_cut(hashed, "hash", lambda n: math.floor(n * fraction + 0.5))


def _check_fractions(fractions: Sequence[float]) -> None:
    if len(fractions) != 3 or any(f < 0 for f in fractions) or abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError(f"three fractions summing to one expected, got {fractions}")


def sample_exact(df: DataFrame, key: str, fraction: float, seed: int, out: str) -> DataFrame:
    """Mark round(fraction * n) rows of a table with unique keys."""
    return df.withColumn(out, hash_hex(F.col(key), seed) <= _cut(df, key, fraction, seed))


def random_split(df: DataFrame, key: str, fractions: Sequence[float], seed: int) -> DataFrame:
    """Add ``split``: test of all rows, then valid of the rest, train what remains.

    The second draw always uses seed 1, as published.
    """
    _check_fractions(fractions)
    _, valid, test = fractions
    in_test = hash_hex(F.col(key), seed) <= _cut(df, key, test, seed)
    share = 0.0 if test >= 1 else valid / (1 - test)
    in_valid = hash_hex(F.col(key), 1) <= _cut(df.where(~in_test), key, share, 1)
    return df.withColumn("split", F.when(in_test, "test").when(in_valid, "valid").otherwise("train"))


def group_split(df: DataFrame, group: str, fractions: Sequence[float], seed: int) -> DataFrame:
    """Split whole groups: big ones first, each list in hashed order, cut at cumulative sizes.

    This is the distributed rule: a group goes to train while the running size fits the
    train size, to valid while it fits train + valid, else to test. Rows without a group
    are omitted. Only the big groups (a bounded number: each holds a fixed share of the
    rows) are broadcast; any other row compares its own group's hash with two cuts.
    """
    _check_fractions(fractions)
    rows = df.where(F.col(group).isNotNull())
    sizes = group_sizes(rows, group, fractions, seed)
    ordered = hash_running_totals(sizes, "place", {"before": F.col("size")}, prefix=4)
    upto = F.col("before") + F.col("size")
    cuts = ordered.agg(
        F.max(F.when(upto <= F.col("train_size"), F.col("place"))).alias("train"),
        F.max(F.when(upto <= F.col("train_size") + F.col("valid_size"), F.col("place"))).alias("valid"))
    train, valid = (cut or "" for cut in cuts.first())
    big = sizes.where("place < '1'").select(group, F.lit(True).alias("__big"))
    marked = rows.join(F.broadcast(big), group, "left") if _bounded_big(fractions) else rows.withColumn("__big", F.lit(True))
    place = F.concat(F.when(F.col("__big"), "0").otherwise("1"), hash_hex(F.col(group), seed))
    # Without a test share, what the rounded sizes leave over is valid.
    label = F.when(place <= train, "train").when(place <= valid, "valid").otherwise("test" if fractions[2] else "valid")
    return marked.withColumn("split", label).drop("__big")


def _bounded_big(fractions: Sequence[float]) -> bool:
    # With an empty valid or test share every group counts as big, and no list is needed.
    return fractions[1] > 0 and fractions[2] > 0


def group_sizes(rows: DataFrame, group: str, fractions: Sequence[float], seed: int) -> DataFrame:
    """``group, size, place`` with the target sizes; ``place`` sorts big groups first, then by hash."""
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    n = rows.count()
    train, valid = math.floor(n * fractions[0]), math.floor(n * fractions[1])
    big = (F.col("size") > valid / 2) | (F.col("size") > (n - train - valid) / 2)
    if not _bounded_big(fractions):
        big = F.lit(True)
    place = F.concat(F.when(big, "0").otherwise("1"), hash_hex(F.col(group), seed))
    return counted.select(
        group, "size", place.alias("place"), F.lit(train).cast("long").alias("train_size"), F.lit(valid).cast("long").alias("valid_size"))


#: Groups left over from which on packing goes on in one task.
ONE_TASK = 100_000


def group_split_greedy(df: DataFrame, group: str, fractions: Sequence[float], seed: int, one_task: int = ONE_TASK) -> DataFrame:
    """The published packing: every group goes to train if it still fits, else valid, else test.

    Big groups come first, each list in hashed order. Rows without a group are omitted. A bin is
    filled in rounds that each leave less than half of its room (:func:`fill`), so the (group,
    size) table may have any length.
    """
    _check_fractions(fractions)
    rows = df.where(F.col(group).isNotNull())
    sizes = checkpointed(df.sparkSession, group_sizes(rows, group, fractions, seed))
    ends = sizes.agg(F.max("train_size"), F.max("valid_size")).first()
    if ends[0] is None:
        return rows.withColumn("split", F.lit("test"))
    in_train = fill(sizes, "place", "size", ends[0], one_task)
    if fractions[2] == 0:
        # Without a test share valid takes all the rest.
        labelled = in_train.select(group, F.when(F.col("filled"), "train").otherwise("valid").alias("split"))
    else:
        in_train = checkpointed(df.sparkSession, in_train)
        in_valid = fill(in_train.where("NOT filled").drop("filled"), "place", "size", ends[1], one_task)
        labelled = in_train.where("filled").select(group, F.lit("train").alias("split")).unionByName(
            in_valid.select(group, F.when(F.col("filled"), "valid").otherwise("test").alias("split")))
    return rows.join(labelled, group)


def fill(items: DataFrame, place: str, size: str, room: int, one_task: int = ONE_TASK) -> DataFrame:
    """Mark as ``filled`` the items that a bin takes, walked by the unique text ``place``: each that still fits.

    A round looks at the items after the last decided place that are no larger than the room. Of
    the small ones, up to half the room, a running total tells the place where they use up more
    than half; an item above half the room is taken at the first place where it fits besides the
    small ones before it, and any other before that place can never fit, since the room only falls.
    The round ends at the earlier of the two places, with less than half of the room left. So a
    bin of n rows takes log2(n) rounds at most, each with one running total and one row to the
    driver, and an item's fate is an expression on its place and size. When no more than
    ``one_task`` items are left to look at, one task walks them.
    """
    after, taken, tail = "", F.lit(False), None
    while room > 0:
        left = items.where((F.col(place) > after) & (F.col(size) <= room))
        if left.limit(one_task + 1).count() <= one_task:
            tail = left.select(F.col(place).alias("__place"), F.col(size).cast("long").alias("__size"))
            break
        small = 2 * F.col(size) <= room
        totals = hash_running_totals(left, place, {"__before": F.when(small, F.col(size)).otherwise(0)}, prefix=4)
        used = F.col("__before") + F.col(size)
        ends = totals.where(F.when(small, 2 * used > room).otherwise(used <= room))
        end = ends.agg(F.min(F.struct(F.col(place).alias("place"), used.alias("used"), (~small).alias("large")))).first()[0]
        inside = (F.col(place) > after) & small
        if end is None:
            # All small items fit and no other one does.
            taken = taken | inside
            break
        taken = taken | (inside & (F.col(place) <= end["place"]))
        if end["large"]:
            taken = taken | (F.col(place) == end["place"])
        after, room = end["place"], room - end["used"]
    if tail is None:
        return items.withColumn("filled", taken)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        rest, kept = room, []
        for at, n in sorted(zip(frame["__place"], frame["__size"])):
            if n <= rest:
                rest -= n
                kept.append(at)
        return pd.DataFrame({"__place": pd.Series(kept, dtype=object)})

    walked = tail.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(walk, "__place string").withColumn("__kept", F.lit(True))
    # At most ``one_task`` places.
    marked = items.join(F.broadcast(walked), items[place] == walked["__place"], "left")
    return marked.withColumn("filled", taken | F.coalesce("__kept", F.lit(False))).drop("__place", "__kept")


def cold_split(df: DataFrame, entities: Sequence[str], fractions: Sequence[float], seed: int,
               check: bool = False) -> DataFrame:
    """Rows whose entities were all drawn are test; rows with none are train or valid.

    The valid draw repeats on the entities left over. Mixed rows are dropped. A draw is a
    hash threshold over the distinct entity values, so rows are labelled without a join.
    ``check`` raises when test or valid is empty.
    """
    _check_fractions(fractions)
    _, valid, test = fractions

    def draws(rows: DataFrame, fraction: float) -> list[Column]:
        drawn = []
        for entity in entities:
            cut = _cut(rows.select(entity).distinct(), entity, fraction, seed)
            drawn.append(hash_hex(F.col(entity), seed) <= cut)
        return drawn

    in_test = draws(df, test)
    marked = df.withColumn("__all", _every(in_test)).withColumn("__any", _some(in_test))
    rest = marked.where(~F.col("__any"))
    in_valid = draws(rest.select(*entities), valid / (1 - test))
    label = (
        F.when(F.col("__all"), "test")
        .when(F.col("__any"), F.lit(None))
        .when(_every(in_valid), "valid")
        .when(_some(in_valid), F.lit(None))
        .otherwise("train")
    )
    result = marked.withColumn("split", label).where("split IS NOT NULL").drop("__all", "__any")
    if check:
        found = {r[0] for r in result.groupBy("split").count().collect()}  # three rows at most
        for name in ("test", "valid"):
            if name not in found:
                raise ValueError(f"no {name} samples; use another seed or a larger fraction")
    return result


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _some(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def split_ratio_check(df: DataFrame) -> DataFrame:
    counted = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    # Three rows at most.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counted.select("split", "n", (F.col("n") / total).alias("ratio"))


def temporal_split(df: DataFrame, date: str, cutoff_year: int, key: str, valid_fraction: float, seed: int) -> DataFrame:
    """Rows from the cutoff year on are test; the earlier ones are drawn into train and valid.

    Rows without a date can't be placed in time and are labelled ``undated``.
    """
    early = df.where(F.year(date) < cutoff_year)
    cut = _cut(early, key, valid_fraction, seed)
    label = (F.when(F.col(date).isNull(), "undated").when(F.year(date) >= cutoff_year, "test")
             .when(hash_hex(F.col(key), seed) <= cut, "valid").otherwise("train"))
    return df.withColumn("split", label)


def id_list_split(df: DataFrame, ids: DataFrame, key: str, valid_fraction: float, seed: int) -> DataFrame:
    """Listed ids are test, the rest is drawn into train and valid. List ids carry an ``id_`` prefix."""
    listed = ids.select(F.regexp_replace("id", "^id_", "").alias("__id")).distinct()
    keyed = df.withColumn("__id", F.col(key).cast("string"))
    marked = keyed.join(listed.withColumn("__listed", F.lit(True)), "__id", "left")
    rest = keyed.join(listed, "__id", "left_anti").select(key)
    cut = _cut(rest, key, valid_fraction, seed)
    label = (F.when(F.col("__listed"), "test")
             .when(hash_hex(F.col(key), seed) <= cut, "valid").otherwise("train"))
    return marked.withColumn("split", label).drop("__id", "__listed")


def target_subset(df: DataFrame, targets: DataFrame, key: str, label: str | None = None, nonbinder: int = 0) -> DataFrame:
    """Rows of chosen targets; with ``label`` the non-binders are dropped too."""
    chosen = df.join(targets.select(key).distinct(), key, "left_semi")
    return chosen if label is None else chosen.where(F.col(label) != nonbinder)


def complement(df: DataFrame, sampled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(sampled.select(*keys), list(keys), "left_anti")


def entity_union(splits: Sequence[DataFrame], column: str) -> DataFrame:
    """Distinct entity values over all splits."""
    out = splits[0].select(column)
    for part in splits[1:]:
        out = out.unionByName(part.select(column))
    return out.distinct()


# --- weights and sampling --------------------------------------------------------------


def class_balance_weights(df: DataFrame, label: str, class_weights: dict | None = None, out: str = "weight") -> DataFrame:
    """1 / count of the row's class, times an optional weight per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    weight = F.lit(1.0) / F.col("__c")
    if class_weights:
        table = F.create_map(*[F.lit(v) for kv in class_weights.items() for v in kv])
        weight = weight * F.coalesce(F.try_element_at(table, F.col(label)), F.lit(1.0))
    return null_safe_join(df, counts, [label], "left").withColumn(out, weight).drop("__c")


def interaction_weights(df: DataFrame, target: str, activity: str, scaffold: str) -> DataFrame:
    """Sampling columns of the large interaction table.

    The final weight is our choice (the published text gives no formula): the target
    activity's weight spread evenly over its scaffolds and the rows of each scaffold.
    """
    keyed = df.withColumn("target_activity", F.concat_ws("_", F.col(target), F.col(activity).cast("string")))
    keyed = keyed.withColumn("joint_space", F.concat_ws("_", "target_activity", F.col(scaffold)))
    # One aggregation feeds both counts: joint spaces are the distinct scaffolds of an activity.
    spaces = keyed.groupBy("target_activity", "joint_space").agg(F.count(F.lit(1)).alias("joint_space_count"))
    scaffolds = spaces.groupBy("target_activity").agg(F.count(F.lit(1)).alias("n_scaffolds"))
    joined = keyed.join(spaces, ["target_activity", "joint_space"]).join(scaffolds, "target_activity")
    weight = F.sqrt(F.col("n_scaffolds").cast("double"))
    return joined.withColumn("target_activity_weight", weight).withColumn(
        "pretrain_sampling_weight", F.col("target_activity_weight") / (F.col("n_scaffolds") * F.col("joint_space_count")))


def weighted_sample(df: DataFrame, key: str, weight: str, seed: int, n: int | None = None,
                    cells: int | None = None) -> DataFrame:
    """Draw with replacement, p = weight / sum: ``draw`` (0-based) and the drawn ``key``.

    Whole-number weights are taken as they are; fractional ones are scaled by a power of two, so
    that their sum fills 52 bits, and cut to whole units (one at least for a positive weight).
    Weights that are null, not finite or not positive are never drawn. Rows get cumulative
    weight intervals in hashed order. Hashed points and intervals meet in equal cells of the
    weight axis: a heavy row spans many cells, so its draws spread over many tasks.
    """
    positive = df.where(F.col(weight) > 0).select(F.col(key).alias("__key"), F.col(weight).alias("__w"))
    if not isinstance(df.schema[weight].dataType, IntegralType):
        positive = positive.withColumn("__w", F.col("__w").cast("double")).where("__w < double('infinity')")
        share = positive.agg(F.sum("__w")).first()[0]
        scale = 2.0 ** math.floor(52 - math.log2(share)) if share else 1.0
        positive = positive.withColumn("__w", F.greatest(F.lit(1).cast("long"), F.floor(F.col("__w") * F.lit(scale))))
    positive = positive.withColumn("__w", F.col("__w").cast("long"))
    positive = positive.withColumn("__h", hash_hex(F.col("__key"), seed))
    placed = hash_running_totals(positive, "__h", {"lo": F.col("__w")}, prefix=4)
    placed = placed.withColumn("hi", F.col("lo") + F.col("__w"))
    total = positive.agg(F.sum("__w")).first()[0]
    if not total:
        raise ValueError("no row with a positive weight")
    draws = n if n is not None else df.count()
    parts = cells or max(4 * bucket_count(df), -(-draws // HOT_ROWS))
    width = max(1, -(-total // parts))
    ids = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    x = F.floor(hash_uniform(F.col("draw"), f"{seed}:point") * F.lit(total)).cast("long")
    points = ids.withColumn("x", x).withColumn("cell", F.expr(f"x div {width}"))
    spans = placed.select("__key", "lo", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    # As-of inside a cell: sort interval starts and points together, carry the last start on.
    starts = spans.select("cell", F.col("lo").alias("at"), F.lit(0).alias("kind"), "__key", F.lit(None).cast("long").alias("draw"))
    marks = points.select("cell", F.col("x").alias("at"), F.lit(1).alias("kind"),
                          F.lit(None).cast(df.schema[key].dataType).alias("__key"), "draw")
    window = Window.partitionBy("cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = starts.unionByName(marks).withColumn("__hit", F.last("__key", ignorenulls=True).over(window))
    return merged.where("kind = 1").select("draw", F.col("__hit").alias(key))
