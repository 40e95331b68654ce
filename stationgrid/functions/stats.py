"""Exact order statistics that never gather a column in one task.

``percentile`` keeps every distinct value in one aggregation buffer. Up to
``BUFFER_ROWS`` rows that buffer is small and the built-in is used. Beyond it the
answer is found by histogram refinement: count rows in equal-width buckets
(partial aggregation, a few thousand rows come back), keep only the bucket that
holds the wanted rank, shrink to that bucket's own minimum and maximum, repeat
until the bucket is a single value. The result is the exact order statistic
whatever the skew or the number of ties.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

BUFFER_ROWS = 1_000_000
BUCKETS = 4096


def _profile(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    parts = []
    for i, c in enumerate(columns):
        parts += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
    row = df.agg(*parts).first()
    return {c: (row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}


def _refined(df: DataFrame, wanted: set[tuple[str, int]], profile: Mapping[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """The values of ``wanted`` (column, 0-based rank among its non-null values), all refined in the same passes."""
    state = {w: (float(profile[w[0]][1]), float(profile[w[0]][2]), 0) for w in wanted}
    while True:
        ranges = sorted({(c, low, high) for (c, _), (low, high, _) in state.items() if low < high})
        if not ranges:
            return {w: low for w, (low, _, _) in state.items()}
        entries = []
        for i, (c, low, high) in enumerate(ranges):
            value, width = F.col(c).cast("double"), (high - low) / BUCKETS
            if width == 0.0 or low + width == low:
                bucket = F.when(value <= low, 0).otherwise(BUCKETS - 1)
            else:
                bucket = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(BUCKETS - 1))
            entry = F.struct(F.lit(i).alias("i"), bucket.cast("int").alias("bucket"), value.alias("value"))
            entries.append(F.when(value.between(low, high), entry))
        rows = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
        counts: dict[int, list] = {}
        found = rows.groupBy("i", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        for entry in found.orderBy("i", "bucket").collect():  # at most BUCKETS rows of each open range
            counts.setdefault(entry["i"], []).append(entry)
        number = {r: i for i, r in enumerate(ranges)}
        for (c, rank), (low, high, before) in list(state.items()):
            for entry in counts.get(number.get((c, low, high), -1), ()):
                if rank < before + entry["n"]:
                    state[c, rank] = (entry["low"], entry["high"], before)
                    break
                before += entry["n"]


def values_at_ranks(df: DataFrame, ranks: Mapping[str, int]) -> dict[str, float | None]:
    """Exact value at the 0-based rank of each column, ``None`` where it has no more values; the columns share their passes."""
    profile = _profile(df, list(ranks))
    found = _refined(df, {(c, r) for c, r in ranks.items() if r < profile[c][0]}, profile)
    return {c: found.get((c, r)) for c, r in ranks.items()}


def value_at_rank(df: DataFrame, column: str, rank: int) -> float | None:
    """Exact value at 0-based ``rank`` of one column."""
    return values_at_ranks(df, {column: rank})[column]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    buffer_rows: int = BUFFER_ROWS,
) -> Mapping[str, list[float | None]]:
    """Linear-interpolated quantiles of each column; ``None`` for an all-null one."""
    profile = _profile(df, columns)
    probabilities = list(probabilities)
    small = [c for c in columns if 0 < profile[c][0] <= buffer_rows]
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if small:
        exprs = [F.percentile(c, F.array(*map(F.lit, probabilities))).alias(f"q{i}") for i, c in enumerate(small)]
        row = df.agg(*exprs).first()
        for i, c in enumerate(small):
            result[c] = list(row[f"q{i}"])
    large = [c for c in columns if profile[c][0] > buffer_rows]
    place = {(c, p): p * (profile[c][0] - 1) for c in large for p in probabilities}
    found = _refined(df, {(c, r) for (c, _), at in place.items() for r in (math.floor(at), math.ceil(at))}, profile)
    for (c, p), at in place.items():
        lower, upper = found[c, math.floor(at)], found[c, math.ceil(at)]
        value = lower + (upper - lower) * (at - math.floor(at))
        result[c] = [value if q == p else known for q, known in zip(probabilities, result[c])]
    return result


def medians(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> dict[str, float]:
    """Exact medians; an all-null column gets ``default``."""
    found = exact_quantiles(df, columns, [0.5])
    return {c: default if found[c][0] is None else float(found[c][0]) for c in columns}
