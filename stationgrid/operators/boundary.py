"""Point-in-polygon tests and extents.

The boundary's edges are keyed by horizontal band. A boundary of checked size is
collected per band into arrays and broadcast, so each point is tested in place by
a hash lookup and an array count: the point table is neither shuffled nor
multiplied. A larger boundary takes an equi-join on the band and counts crossings
with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.operators.sizes import BROADCAST_ROWS, at_most


def _crosses(x: Column, y: Column, e) -> Column:
    straddles = ((e("y1") <= y) & (y < e("y2"))) | ((e("y2") <= y) & (y < e("y1")))
    at = e("x1") + (y - e("y1")) * (e("x2") - e("x1")) / F.nullif(e("y2") - e("y1"), F.lit(0.0))
    return F.coalesce(straddles & (x < at), F.lit(False))


def _within(x: Column, y: Column, e, tolerance: float) -> Column:
    dx, dy = e("x2") - e("x1"), e("y2") - e("y1")
    length = dx * dx + dy * dy
    along = F.coalesce(((x - e("x1")) * dx + (y - e("y1")) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ox, oy = x - (e("x1") + along * dx), y - (e("y1") + along * dy)
    return ox * ox + oy * oy <= F.lit(tolerance * tolerance)


def mark_inside(
    points: DataFrame,
    edges: DataFrame,
    x: str = "x_pl",
    y: str = "y_pl",
    point_id: list[str] | str = "station_id",
    tolerance: float = 0.0,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add BOOLEAN ``inside``; with ``tolerance`` also true within that distance."""
    span = edges.agg(
        F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"), F.count("*").alias("n")
    ).first()
    if span["n"] == 0:
        return points.withColumn("inside", F.lit(False))
    low = span["low"] - tolerance
    bands = max(1, span["n"] // 2)
    step = max((span["high"] + tolerance - low) / bands, 1e-9)
    band_of = lambda v: F.floor((v - F.lit(low)) / F.lit(step))
    first = band_of(F.least("y1", "y2") - F.lit(tolerance))
    last = band_of(F.greatest("y1", "y2") + F.lit(tolerance))
    banded = edges.select(F.explode(F.sequence(first, last)).alias("_band"), "x1", "y1", "x2", "y2")
    keyed = points.withColumn("_band", band_of(F.col(y)))
    px, py = F.col(x), F.col(y)

    if at_most(banded, broadcast_rows):
        arrays = banded.groupBy("_band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
        joined = keyed.join(F.broadcast(arrays), "_band", "left")
        inside = F.size(F.filter("_edges", lambda s: _crosses(px, py, lambda n: s[n]))) % 2 == 1
        if tolerance > 0:
            inside = inside | F.exists("_edges", lambda s: _within(px, py, lambda n: s[n], tolerance))
        return joined.withColumn("inside", F.coalesce(inside, F.lit(False))).drop("_band", "_edges")

    ids = [point_id] if isinstance(point_id, str) else list(point_id)
    hits = keyed.select(*ids, "_band", px.alias("_x"), py.alias("_y")).join(banded, "_band")
    fx, fy = F.col("_x"), F.col("_y")
    inside = F.count_if(_crosses(fx, fy, F.col)) % 2 == 1
    if tolerance > 0:
        inside = inside | F.bool_or(_within(fx, fy, F.col, tolerance))
    marks = hits.groupBy(*ids).agg(inside.alias("inside"))
    return points.join(marks, ids, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def extent(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(min_x, min_y, max_x, max_y)``."""
    return points.agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y")
    )


def map_aspect(bounds: DataFrame) -> DataFrame:
    """Width over height of a geographic extent, corrected by the mid latitude."""
    mid = F.radians((F.col("min_y") + F.col("max_y")) / 2)
    return bounds.withColumn(
        "aspect",
        F.try_divide((F.col("max_x") - F.col("min_x")) * F.cos(mid), F.col("max_y") - F.col("min_y")),
    )
