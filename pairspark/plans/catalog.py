"""All registered queries."""

from . import (  # noqa: F401
    graph_queries,
    metric_queries,
    scalar_queries,
    screening_queries,
    source_queries,
    split_queries,
    stream_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
