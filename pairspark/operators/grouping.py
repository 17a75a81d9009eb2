"""Group statistics attached to rows without a whole-group window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .ordering import null_safe_join


def with_group_stats(df: DataFrame, by: Sequence[str], **stats: Column) -> DataFrame:
    """Join group aggregates back to the rows.

    The aggregate combines map-side, and the join is planned by size at run time
    (broadcast when small, skew-split sort-merge otherwise), so a group holding a third
    of the rows never sits in one task as it would under an unbounded window.
    """
    by = list(by)
    aggregated = df.groupBy(*by).agg(*[c.alias(name) for name, c in stats.items()])
    return null_safe_join(df, aggregated, by, "left")
