"""Prediction grid, scattering onto the rectangle, null-aware smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationgrid.functions.crs import with_degrees
from stationgrid.operators.tiles import SPAN, own_cells, with_halo

ROWS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class GridSpec:
    """Cell (r, c) has its centre at ``(min_x + c * step, max_y - r * step)``."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    step: float

    @property
    def width(self) -> int:
        return math.ceil((self.max_x - self.min_x) / self.step)

    @property
    def height(self) -> int:
        return math.ceil((self.max_y - self.min_y) / self.step)


def grid_cells(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Every cell ``(r, c, x, y, lon, lat)``; generated on the executors."""
    n = spec.width * spec.height
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / ROWS_PER_TASK))
    cells = spark.range(0, n, 1, tasks).select(
        F.expr(f"CAST(id DIV {spec.width} AS INT)").alias("r"), (F.col("id") % spec.width).cast("int").alias("c")
    )
    metric = cells.withColumns({
        "x": F.lit(spec.min_x) + F.col("c") * F.lit(spec.step),
        "y": F.lit(spec.max_y) - F.col("r") * F.lit(spec.step),
    })
    return with_degrees(metric)


#: Cells of a row that one task makes at a time.
RUN_CELLS = 100_000


def mask_runs(spark: SparkSession, spec: GridSpec, edges: DataFrame) -> DataFrame:
    """``(r, start, stop, inside)``: every grid row as runs of columns inside or outside the boundary.

    Scanlines: an edge gives the place where it crosses each row it reaches; the crossings of a row are sorted once, and between two of
    them all cells are alike. Only rows and crossings are shuffled.
    """
    spots = (F.col("y1") != F.col("y2"))
    high, low = F.greatest("y1", "y2"), F.least("y1", "y2")
    row_at = lambda y: (F.lit(spec.max_y) - y) / F.lit(spec.step)
    first = F.greatest(F.floor(row_at(high)) - 1, F.lit(0))
    last = F.least(F.ceil(row_at(low)) + 1, F.lit(spec.height - 1))
    reached = edges.filter(spots & (first <= last)).select("x1", "y1", "x2", "y2", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("r"))
    y = F.lit(spec.max_y) - F.col("r") * F.lit(spec.step)
    straddles = ((F.col("y1") <= y) & (y < F.col("y2"))) | ((F.col("y2") <= y) & (y < F.col("y1")))
    crossings = reached.filter(straddles).select("r", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("at"))
    # first column that is not left of the crossing; the neighbours settle rounding
    x_of = lambda c: F.lit(spec.min_x) + c * F.lit(spec.step)
    near = F.ceil((F.col("at") - F.lit(spec.min_x)) / F.lit(spec.step))
    column = F.when(x_of(near - 1) >= F.col("at"), near - 1).when(x_of(near) >= F.col("at"), near).otherwise(near + 1)
    column = F.greatest(F.lit(0), F.least(F.lit(spec.width), column)).cast("int")
    stops = crossings.groupBy("r").agg(F.array_sort(F.collect_list(column)).alias("stops"))  # as many as the row has crossings
    rows = spark.range(spec.height).select(F.col("id").cast("int").alias("r")).join(stops, "r", "left")
    ends = F.concat(F.array(F.lit(0)), F.coalesce("stops", F.array().cast("array<int>")), F.array(F.lit(spec.width)))
    runs = rows.select("r", F.size(F.coalesce("stops", F.array().cast("array<int>"))).alias("n"), ends.alias("ends")).select("r", "n", "ends", F.posexplode("ends").alias("i", "start"))
    # a cell is inside if an odd number of crossings lies right of it
    return runs.filter(F.col("i") <= F.col("n")).select("r", "start", F.col("ends")[F.col("i") + 1].alias("stop"), ((F.col("n") - F.col("i")) % 2 == 1).alias("inside")).filter("start < stop")


def prediction_grid(spark: SparkSession, spec: GridSpec, edges: DataFrame) -> DataFrame:
    """Grid cells with the boundary mask ``inside``; cells are made from their runs and never shuffled."""
    runs = mask_runs(spark, spec, edges)
    blocks = runs.select("r", "stop", "inside", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(RUN_CELLS))).alias("start"))
    blocks = blocks.withColumn("stop", F.least(F.col("stop"), F.col("start") + RUN_CELLS))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(spec.width * spec.height / ROWS_PER_TASK))
    cells = blocks.repartition(tasks, "r", "start").select("r", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("c"), "inside")
    metric = cells.withColumns({
        "x": F.lit(spec.min_x) + F.col("c") * F.lit(spec.step),
        "y": F.lit(spec.max_y) - F.col("r") * F.lit(spec.step),
    })
    return with_degrees(metric).select("r", "c", "x", "y", "lon", "lat", "inside")


def scatter(cells: DataFrame, predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predictions on the full rectangle; NULL outside the mask."""
    return cells.select("r", "c").join(predictions.select("r", "c", *columns), ["r", "c"], "left")


def complete_rectangle(cells: DataFrame) -> DataFrame:
    """All cells of the rectangle that ``cells`` (r, c, ...) spans, with ``present`` telling those that were there.

    A pass along columns needs the result of the pass along rows at every cell, so left-out cells come back
    as NULL ones. A full table is passed on as it is. Cells are sorted and merged, never broadcast: their files say nothing of how many there are.
    """
    row = cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).first()
    if not row["n"] or row["n"] == (row["r1"] - row["r0"] + 1) * (row["c1"] - row["c0"] + 1):
        return cells.withColumn("present", F.lit(True))
    width = row["c1"] - row["c0"] + 1
    every = cells.sparkSession.range((row["r1"] - row["r0"] + 1) * width).select(
        (F.floor(F.col("id") / width) + row["r0"]).cast(cells.schema["r"].dataType).alias("r"), (F.col("id") % width + row["c0"]).cast(cells.schema["c"].dataType).alias("c")
    )
    return every.join(cells.withColumn("present", F.lit(True)).hint("merge"), ["r", "c"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def smooth(cells: DataFrame, columns: Sequence[str], sigma: float, span: int = SPAN) -> DataFrame:
    """Gaussian smoothing that ignores NULL cells and keeps them NULL.

    Two passes of weighted sums, by row then by column; values and weights of all columns share
    the two shuffles, and lines are cut into spans with a halo. Cells that are missing or beyond the rectangle weigh nothing.
    """
    if sigma <= 0:
        return cells
    radius = int(4.0 * sigma + 0.5)
    kernel = {k: math.exp(-k * k / (2.0 * sigma * sigma)) for k in range(-radius, radius + 1)}
    zero = F.lit(0.0)
    work = complete_rectangle(cells).withColumns(
        {f"_num_{c}": F.coalesce(F.col(c), zero) for c in columns}
        | {f"_den_{c}": F.col(c).isNotNull().cast("double") for c in columns}
    )
    parts = [f"{p}{c}" for c in columns for p in ("_num_", "_den_")]
    for axis, order in (("r", "c"), ("c", "r")):
        work, line = with_halo(work, axis, order, radius, span)
        spread = {}
        for name in parts:
            total = None
            for k, weight in kernel.items():
                term = F.coalesce(F.sum(name).over(line.rangeBetween(-k, -k)), zero) * F.lit(weight)
                total = term if total is None else total + term
            spread[name] = total
        work = own_cells(work.withColumns(spread), order, span)
    smoothed = {c: F.when(F.col(c).isNotNull(), F.try_divide(F.col(f"_num_{c}"), F.col(f"_den_{c}"))) for c in columns}
    return work.withColumns(smoothed).filter("present").drop(*parts, "present")
