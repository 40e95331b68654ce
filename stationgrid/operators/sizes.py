"""Size checks that decide whether a table may be broadcast."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
#: For searches, whose steps may broadcast a dozen tables at once.
SEARCH_BROADCAST_ROWS = 20_000
TRAINING_ROWS_PER_TASK = 25_000


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; reads at most ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def at_least(df: DataFrame, rows: int) -> bool:
    """Gate used for minimum sizes; stops counting at ``rows``."""
    return df.limit(rows).count() >= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only after its size has been checked."""
    return F.broadcast(df) if at_most(df, rows) else df


def sized_for_iteration(df: DataFrame, rows: int, per_task: int = TRAINING_ROWS_PER_TASK) -> DataFrame:
    """Fewer partitions for a table an iterative fit will scan hundreds of times.

    A few thousand rows in many partitions make every iteration pay for task
    starts; ``coalesce`` only merges, so a large table keeps its parallelism.
    """
    return df.coalesce(max(1, math.ceil(rows / per_task)))
