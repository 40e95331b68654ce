"""Exact distance from every cell of a metric raster to its nearest marked cell.

Squared distances separate: the vertical distance to the nearest marked cell of the own column needs one window by column,
and each raster line then takes the lower envelope of the parabolas that its columns raise. Two shuffles of cells do the
work of a nearest-neighbour search, however many cells are marked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from stationgrid.functions.cleaning import mask_nodata
from stationgrid.operators.grid import complete_rectangle
from stationgrid.sources.tables import RasterMeta


def lower_envelope(at: np.ndarray, height: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``min(height + (x - at) ** 2)`` for every ``x``; ``at`` and ``x`` ascend.

    The parabola that is lowest moves right with ``x``. So the middle ``x`` of a gap needs only the parabolas between those of
    the gap's ends, and halving all gaps at once takes a logarithmic number of passes over the line.
    """
    n, m = len(x), len(at)
    best, value = np.zeros(n, dtype=np.int64), np.empty(n)
    stride = 1 << max(n.bit_length() - 1, 0)
    while stride:
        mid = np.arange(stride - 1, n, 2 * stride)
        low = np.where(mid >= stride, best[np.maximum(mid - stride, 0)], 0)
        high = np.where(mid + stride < n, best[np.minimum(mid + stride, n - 1)], m - 1)
        many = np.maximum(high - low, 0) + 1
        first = np.cumsum(many) - many
        which = np.arange(many.sum()) + np.repeat(low - first, many)
        cost = height[which] + (np.repeat(x[mid], many) - at[which]) ** 2
        value[mid] = np.minimum.reduceat(cost, first)
        hits = np.flatnonzero(cost == np.repeat(value[mid], many))
        best[mid] = which[hits[np.searchsorted(hits, first)]]
        stride >>= 1
    return value


def distance_transform(cells: DataFrame, marked: str, step_x: float, step_y: float) -> DataFrame:
    """``(r, c, distance)`` of all cells ``(r, c, <marked>)``; NULL everywhere if no cell is marked.

    Left-out cells are not marked and give no row; a NULL mark is no mark; an empty table gives no rows.
    """
    step_x, step_y = abs(float(step_x)), abs(float(step_y))
    mark = F.coalesce(F.col(marked), F.lit(False)).alias("_mark")
    full = complete_rectangle(cells.select("r", "c", mark))
    spot = F.when(F.col("_mark"), F.col("r"))
    column = Window.partitionBy("c")
    so_far = (Window.unboundedPreceding, 0)
    above = F.last(spot, ignorenulls=True).over(column.orderBy("r").rowsBetween(*so_far))
    # from the other end: a frame that reaches to the end of the column is read anew for every row of it
    below = F.last(spot, ignorenulls=True).over(column.orderBy(F.desc("r")).rowsBetween(*so_far))
    gap = F.least(F.col("r") - above, below - F.col("r"))
    lines = full.select("r", "c", "present", (gap * F.lit(step_y)).cast("double").alias("gap"))

    def along_line(line):
        import pyarrow as pa

        line = line.sort_by("c")
        c, present = (line.column(name).to_numpy() for name in ("c", "present"))
        gap = line.column("gap").to_numpy()  # missing ones come as NaN
        raised, asked = ~np.isnan(gap), present.astype(bool)
        distance = np.full(int(asked.sum()), np.nan)
        if raised.any() and len(distance):
            distance = np.sqrt(lower_envelope(c[raised] * step_x, gap[raised] ** 2, c[asked] * step_x))
        return pa.table({
            "r": pa.array(line.column("r").to_numpy()[asked], pa.int32()), "c": pa.array(c[asked], pa.int32()),
            "distance": pa.array(distance, pa.float64(), from_pandas=True),
        })

    return lines.groupBy("r").applyInArrow(along_line, "r int, c int, distance double")


def mountain_distance_layer(dem: DataFrame, meta: RasterMeta, height: float) -> DataFrame:
    """``(r, c, dist_mountains)`` in km from cell centre to centre; 0 everywhere when there is no mountain pixel.

    For metric rasters: degrees do not separate, so geographic ones take the nearest-neighbour join.
    """
    if meta.geographic:
        raise ValueError("the distance layer needs a raster in metres")
    high = dem.select("r", "c", (mask_nodata(F.col("value"), meta.nodata) > F.lit(height)).alias("high"))
    found = distance_transform(high, "high", meta.step_x, meta.step_y)
    return found.select("r", "c", F.coalesce(F.col("distance") / 1000, F.lit(0.0)).alias("dist_mountains"))
