"""Colour classes of field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bin_of(value: Column, bounds: Column) -> Column:
    """Index of the last of the sorted ``bounds`` (an array) not above ``value``, from 0, by halving; 0 below the first."""
    steps = F.ceil(F.log2(F.greatest(F.size(bounds), F.lit(1)))).cast("int")
    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = value < F.get(bounds, middle)
        low = F.when(below | (middle == state["low"]), state["low"]).otherwise(middle)
        return F.struct(low.alias("low"), F.when(below & (middle > state["low"]), middle).otherwise(state["high"]).alias("high"))

    return F.reduce(F.sequence(F.lit(0), steps), start, halve, lambda s: s["low"])


def color_index(value: Column, bounds: Column) -> Column:
    """Colour number of a value: clipped to the scale, bins spread over all colours."""
    n = F.size(bounds)
    last = F.get(bounds, n - 1)
    clipped = F.greatest(F.get(bounds, F.lit(0)), F.least(last, value))
    bins = n - 1
    spread = F.when(bins > 1, ((n - 1) / F.nullif(bins - 1, F.lit(0)) * bin_of(clipped, bounds)).cast("int")).otherwise(F.floor((n - 1) / 2).cast("int"))
    return F.when(value.isNull() | (n < 1), F.lit(None)).when(n == 1, F.lit(0)).when(clipped >= last, n - 1).otherwise(spread)


def classify(cells: DataFrame, value: str, scale: DataFrame) -> DataFrame:
    """Add ``color_index`` and ``color``.

    The scale, a legend (value, color) of any length, becomes one row with two sorted arrays beside every cell; each cell searches its bin
    by halving. Nothing is collected.
    """
    entries = scale.na.drop().agg(F.sort_array(F.collect_list(F.struct(F.col("value").cast("double").alias("value"), "color"))).alias("_legend"))
    legend = entries.select(F.col("_legend.value").alias("_bounds"), F.col("_legend.color").alias("_colors"))
    found = cells.join(F.broadcast(legend)).withColumn("color_index", color_index(F.col(value).cast("double"), F.col("_bounds")))
    return found.withColumn("color", F.get("_colors", F.col("color_index"))).drop("_bounds", "_colors")
