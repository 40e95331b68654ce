"""Distances built on the kNN join: nearest feature, buffers and spatial lags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from stationgrid.functions.cleaning import mask_nodata
from stationgrid.functions.crs import with_metres
from stationgrid.operators.knn import nearest
from stationgrid.sources.tables import RasterMeta


def pixel_centres(pixels: DataFrame, meta: RasterMeta) -> DataFrame:
    """Pixels with a BIGINT id and the metric position of their centres."""
    x = F.lit(meta.origin_x) + (F.col("c") + 0.5) * F.lit(meta.step_x)
    y = F.lit(meta.origin_y) + (F.col("r") + 0.5) * F.lit(meta.step_y)
    named = pixels.withColumn("pixel_id", F.col("r").cast("bigint") * meta.width + F.col("c"))
    if meta.geographic:
        return with_metres(named.withColumns({"lon": x, "lat": y}))
    return named.withColumns({"x_pl": x, "y_pl": y})


def mountain_pixels(dem: DataFrame, meta: RasterMeta, height: float) -> DataFrame:
    high = dem.filter(mask_nodata(F.col("value"), meta.nodata) > F.lit(height)).select("r", "c")
    return pixel_centres(high, meta).select("pixel_id", "x_pl", "y_pl")


def mountain_distance(points: DataFrame, mountains: DataFrame, id_col: str = "station_id") -> DataFrame:
    """``(id, dist_mountains)`` in km; 0 everywhere when there is no mountain pixel."""
    if mountains.isEmpty():
        return points.select(id_col, F.lit(0.0).alias("dist_mountains"))
    return nearest(points, mountains, 1, query_id=id_col, base_id="pixel_id", distinct_base=True).select(
        id_col, (F.col("distance") / 1000).alias("dist_mountains")
    )


def remove_buffered(keep: DataFrame, candidates: DataFrame, buffer_km: float, id_col: str = "station_id") -> DataFrame:
    """Candidates at least ``buffer_km`` from every kept point.

    Two points of a half-open cell whose diagonal is the buffer are closer than it, so candidates that
    share a cell with a kept point go without a distance; the others ask for their nearest.
    """
    if buffer_km <= 0:
        return candidates
    side = buffer_km * 1000.0 / math.sqrt(2.0)
    cell = {"_cx": F.floor(F.col("x_pl") / side), "_cy": F.floor(F.col("y_pl") / side)}
    taken = keep.withColumns(cell).select("_cx", "_cy").distinct()
    apart = candidates.withColumns(cell).join(taken, ["_cx", "_cy"], "left_anti").drop("_cx", "_cy")
    close = nearest(apart, keep, 1, query_id=id_col, base_id=id_col, distinct_base=True).filter(
        F.col("distance") < F.lit(buffer_km * 1000.0)
    )
    return apart.join(close.select(id_col), id_col, "left_anti").select(*candidates.columns)


def spatial_lag(stations: DataFrame, k: int, id_col: str = "station_id") -> DataFrame:
    """Inverse-distance weighted neighbour temperature, nearest and mean distance."""
    neighbours = nearest(
        stations, stations, k, query_id=id_col, base_id=id_col, payload=("temp",), exclude_self=True, distinct_base=True
    )
    weight = F.lit(1.0) / (F.col("distance") + 1.0)
    return neighbours.groupBy(id_col).agg(
        (F.sum(F.col("nbr_temp") * weight) / F.sum(weight)).alias("spatial_lag_temp"),
        F.min("distance").alias("spatial_lag_min_dist"),
        F.avg("distance").alias("spatial_lag_mean_dist"),
    )
