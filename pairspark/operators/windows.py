"""Per-group ranking, scaling, batching and overlapping windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import batch_size_for_length, length_bin
from .grouping import with_group_stats
from .ordering import global_row_number


def top_k(df: DataFrame, by: Sequence[str], score: str, k: int, tie: Sequence[str], rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per group: score descending, then the tie columns ascending.

    A null or NaN score never takes a place. The rank filter is planned as a group limit on both sides of the shuffle, so a map
    task ships at most ``k`` rows per group however large the group is.
    """
    window = Window.partitionBy(*by).orderBy(F.col(score).desc(), *[F.col(c).asc() for c in tie])
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return scored.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def minmax_per_group(df: DataFrame, by: Sequence[str], value: str, out: str, zero_span: str = "zero") -> DataFrame:
    """(x - min) / (max - min) per group. A group without spread gives 0, or NaN with ``zero_span='nan'``."""
    spread = with_group_stats(df, by, __lo=F.min(value), __hi=F.max(value))
    flat = F.lit(0.0) if zero_span == "zero" else F.lit(float("nan"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), flat).otherwise(
        (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    )
    return spread.withColumn(out, scaled).drop("__lo", "__hi")


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, position: str, out: str, **cut) -> DataFrame:
    """Ordinal rank / (n - 1) per group, ties ordered by position; a single row gives 1."""
    ranked = global_row_number(df, [value, position], "__rn", by, **cut)
    sized = with_group_stats(ranked, by, __cnt=F.count(F.lit(1)))
    share = F.when(F.col("__cnt") == 1, F.lit(1.0)).otherwise((F.col("__rn") - 1) / (F.col("__cnt") - 1))
    return sized.withColumn(out, share).drop("__rn", "__cnt")


def assemble_batches(df: DataFrame, length: str, key: str, size: int | None = None) -> DataFrame:
    """Number the batches of every length bin, shortest sequences first.

    The batch size follows from the longest member of the bin, or is ``size`` for all.
    Adds ``bin``, ``batch_size`` and ``batch_no``.
    """
    binned = df.withColumn("bin", length_bin(F.col(length)))
    longest = binned.groupBy("bin").agg(F.max(length).alias("__longest"))  # four rows at most
    sized = F.lit(size) if size else batch_size_for_length(F.col("__longest"))
    ranked = global_row_number(binned, [length, key], "__rn", ["bin"])
    joined = ranked.join(F.broadcast(longest), "bin").withColumn("batch_size", sized)
    number = F.floor((F.col("__rn") - 1) / F.col("batch_size")).cast("long")
    return joined.withColumn("batch_no", number).drop("__rn", "__longest")


def number_batches(df: DataFrame, order: Sequence[str], size: int, out: str = "batch_no", **cut) -> DataFrame:
    """Consecutive batches of ``size`` rows along unique numeric order columns."""
    ranked = global_row_number(df, order, "__rn", **cut)
    return ranked.withColumn(out, F.floor((F.col("__rn") - 1) / size).cast("long")).drop("__rn")


def padding_waste(batches: DataFrame, length: str) -> DataFrame:
    """Cells lost to padding per batch."""
    return batches.groupBy("bin", "batch_no").agg(
        F.count(F.lit(1)).alias("members"),
        (F.max(length) * F.count(F.lit(1)) - F.sum(length)).alias("waste"),
    )


def window_starts(length: Column, window: int = fv.WINDOW_LENGTH, stride: int = fv.WINDOW_STRIDE) -> Column:
    """Zero-based starts of the overlapping windows over one sequence."""
    last = F.when(length <= window, F.lit(0)).otherwise((F.ceil((length - window) / F.lit(stride)) * stride).cast("int"))
    return F.sequence(F.lit(0), last.cast("int"), F.lit(stride))


def sliding_chunks(df: DataFrame, key: str, text: str, window: int = fv.WINDOW_LENGTH, stride: int = fv.WINDOW_STRIDE) -> DataFrame:
    """One row per window: ``key, chunk_start, chunk``; the last window is clipped."""
    return df.select(
        key, text, F.explode(window_starts(F.length(text), window, stride)).alias("chunk_start")
    ).select(key, "chunk_start", F.substring(F.col(text), F.col("chunk_start") + 1, F.lit(window)).alias("chunk"))


def merge_overlaps(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average of the values that overlapping windows give one position, for values that are one row each."""
    return values.groupBy(*by).agg(F.avg(value).alias(value))


def _over_shared(own: Column, shared: Column, both, alone) -> Column:
    """The positions of ``own`` as an array: ``both(x, before)`` of those that ``shared`` has too, ``alone(x)`` of the rest.

    The arrays are paired by ``zip_with``: an expression inside a lambda, a slice as well, is taken
    anew for every element.
    """
    n = F.least(F.size(own), F.size(shared))
    return F.concat(F.zip_with(F.slice(own, F.lit(1), n), F.slice(shared, F.lit(1), n), both), alone(F.slice(own, n + 1, F.size(own))))


def _mean(a: Column, b: Column, vectors: bool) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2) if vectors else (a + b) / 2


def _stitched(windows: DataFrame, key: str, start: str, values: str, window: int, stride: int) -> tuple[DataFrame, Column, Column]:
    """Each window with the one before it, the positions that are its own, and those it shares with that one."""
    if window != 2 * stride:
        raise ValueError("windows must overlap by half")
    order = Window.partitionBy(key).orderBy(start)
    held = windows.withColumns({"__before": F.lag(values).over(order), "__last": F.lead(start).over(order).isNull()})
    # A window has the positions up to the next one's start to itself; the last has all of its own.
    own = F.when(F.col("__last"), F.col(values)).otherwise(F.slice(values, 1, stride))
    shared = F.slice("__before", stride + 1, stride)
    return held, own, shared


def merge_window_values(windows: DataFrame, key: str, start: str, values: str, vectors: bool = False,
                        window: int = fv.WINDOW_LENGTH, stride: int = fv.WINDOW_STRIDE) -> DataFrame:
    """``key, start, values``: the values of a sequence's positions, averaged where two windows overlap.

    ``values`` is an array by position of the window, of numbers or of ``vectors``. A row of the
    result has the positions from its window's start to the next one's, so a sequence is as many
    rows as it has windows, and only whole windows move: neighbours are brought together by one
    shuffle on the sequence, and overlaps are added as arrays.
    """
    held, own, shared = _stitched(windows, key, start, values, window, stride)
    # Only the last window is shorter than the others, and it is longer than a stride.
    both = _over_shared(own, shared, lambda x, before: _mean(x, before, vectors), lambda rest: rest)
    merged = F.when(F.col("__before").isNull(), own).otherwise(both)
    return held.select(key, start, merged.alias(values))


def merge_window_pairs(windows: DataFrame, key: str, start: str, rows: str,
                       window: int = fv.WINDOW_LENGTH, stride: int = fv.WINDOW_STRIDE) -> DataFrame:
    """``key, start, first_column, rows``: values of position pairs, averaged where two windows overlap.

    ``rows`` is the square matrix of a window, an array by position of arrays by position. A
    sequence's matrix is a band: a row of the result holds its lines from a window's start to the
    next one's, each from ``first_column`` on. A line is put together from arrays: columns that
    only the window before has, columns that both have, and columns of the window's own.
    """
    held, own, shared = _stitched(windows, key, start, rows, window, stride)

    def line(x: Column, before: Column) -> Column:
        both = F.least(F.lit(stride), F.size(x))
        return F.concat(F.slice(before, 1, stride), _mean(F.slice(before, F.lit(stride + 1), both), F.slice(x, F.lit(1), both), True),
                        F.slice(x, F.lit(stride + 1), F.greatest(F.size(x) - stride, F.lit(0))))

    # Lines of the last window beyond the overlap lie left of no other window.
    padded = F.when(F.col("__before").isNull(), own).otherwise(
        _over_shared(own, shared, line, lambda rest: F.transform(rest, lambda x: F.concat(F.array_repeat(F.lit(None).cast("double"), stride), x))))
    first = F.when(F.col("__before").isNull(), F.col(start)).otherwise(F.col(start) - stride)
    return held.select(key, start, first.alias("first_column"), padded.alias(rows))


def rank_output(df: DataFrame, score: str = "prediction", rounded: bool = True, digits: int = 4) -> DataFrame:
    """Protein ascending, score descending.

    ``rounded`` sorts by the rounded score as written; otherwise the exact score sorts
    and is rounded afterwards.
    """
    exact = F.col(score)
    if rounded:
        return df.withColumn(score, F.round(exact, digits)).orderBy("protein_id", F.col(score).desc())
    return df.orderBy("protein_id", exact.desc()).withColumn(score, F.round(exact, digits))


def distinct_first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key with the smallest order value."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def residue_table(scores: DataFrame, clusters: dict[str, int] | None = None) -> DataFrame:
    """Explanation rows per residue from ``pair_id, pos, aa, raw`` and cluster arrays.

    ``clusters`` maps an array column to its width; layer l of it becomes the columns
    ``Layer{l}_Cluster{c}``.
    """
    scaled = minmax_per_group(scores, ["pair_id"], "raw", "residue_score")
    # Scaling keeps the order, so the rank can be taken from the raw value.
    ranked = percentile_rank(scaled, ["pair_id"], "raw", "pos", "residue_percentile")
    wide = [
        F.get(F.col(column), F.lit(c)).alias(f"Layer{layer}_Cluster{c}")
        for layer, (column, width) in enumerate((clusters or {}).items())
        for c in range(width)
    ]
    return ranked.select(
        "pair_id", (F.col("pos") + 1).alias("Residue_ID"), F.col("aa").alias("Residue_Type"),
        "residue_score", "residue_percentile", *wide,
    )


def atom_table(molecules: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised atom scores attached by position.

    ``molecules``: ``ligand, atom_types`` ('|'-joined symbols); ``scores``: ``ligand,
    idx, symbol, raw``. Returns the accepted rows and the ligands whose stored symbol
    list differs from the scored one.
    """
    listed = molecules.select("ligand", F.posexplode(F.split("atom_types", r"\|")).alias("idx", "listed_symbol"))
    scaled = minmax_per_group(scores, ["ligand"], "raw", "atom_score")
    paired = scaled.join(listed, ["ligand", "idx"], "full")
    agrees = F.coalesce(F.col("symbol") == F.col("listed_symbol"), F.lit(False))
    rejected = paired.groupBy("ligand").agg(F.count_if(~agrees).alias("mismatches")).where("mismatches > 0")
    accepted = paired.join(rejected, "ligand", "left_anti").select("ligand", "idx", "symbol", "atom_score")
    return accepted, rejected
