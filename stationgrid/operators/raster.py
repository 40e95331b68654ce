"""Sampling rasters at points and resampling gridded products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.functions.cleaning import mask_nodata
from stationgrid.functions.crs import to_metres
from stationgrid.sources.tables import RasterMeta


def pixel_of(meta: RasterMeta) -> tuple[Column, Column, Column]:
    """(row, column, in-bounds) of a point; bounds are inclusive, cells half-open."""
    x, y = (F.col("lon"), F.col("lat")) if meta.geographic else (F.col("x_pl"), F.col("y_pl"))
    r = F.floor((y - F.lit(meta.origin_y)) / F.lit(meta.step_y))
    c = F.floor((x - F.lit(meta.origin_x)) / F.lit(meta.step_x))
    inside = x.between(meta.origin_x, meta.right) & y.between(meta.bottom, meta.origin_y)
    inside = inside & r.between(0, meta.height - 1) & c.between(0, meta.width - 1)
    return r.cast("int"), c.cast("int"), inside


def sample_bands(points: DataFrame, pixels: DataFrame, metas: list[RasterMeta], id_col: str = "station_id") -> DataFrame:
    """Add one column per band with the masked pixel value under each point.

    One equi-join on ``(band, r, c)`` for all bands, then one row per point by
    conditional aggregation. Points off a band, or on nodata, get NULL. Pixels are sorted and
    merged: their files say nothing of how many pixels they unfold to, so they are never broadcast.
    """
    wanted = []
    for m in metas:
        r, c, inside = pixel_of(m)
        wanted.append(F.when(inside, F.struct(F.lit(m.band).alias("band"), r.alias("r"), c.alias("c"))))
    keys = points.select(id_col, F.explode(F.filter(F.array(*wanted), lambda s: s.isNotNull())).alias("k")).select(
        id_col, "k.*"
    )
    nodata = {m.band: m.nodata for m in metas}
    values = pixels.filter(F.col("band").isin([m.band for m in metas])).select("band", "r", "c", "value")
    hits = keys.join(values.hint("merge"), ["band", "r", "c"])
    picked = hits.groupBy(id_col).agg(
        *[
            F.max(F.when(F.col("band") == b, mask_nodata(F.col("value"), nodata[b]))).alias(b)
            for b in (m.band for m in metas)
        ]
    )
    clashing = [m.band for m in metas if m.band in points.columns]
    return points.drop(*clashing).join(picked, id_col, "left")


def sample_layers(points: DataFrame, layers: DataFrame, meta: RasterMeta, columns: list[str]) -> DataFrame:
    """Add the named layer columns of a wide ``(r, c, ...)`` table sharing one grid.

    Points off the raster get negative keys, which match nothing and spread over tasks. As in
    :func:`sample_bands` pixels are never broadcast.
    """
    r, c, inside = pixel_of(meta)
    off = (-1 - F.pmod(F.xxhash64(*[c for c, t in points.dtypes if "map<" not in t and "variant" not in t]), F.lit(1_000_003))).cast("int")
    keyed = points.drop(*[n for n in columns if n in points.columns]).withColumns(
        {"_pr": F.when(inside, r).otherwise(off), "_pc": F.when(inside, c).otherwise(-1)}
    )
    pixels = layers.select(F.col("r").alias("_pr"), F.col("c").alias("_pc"), *columns)
    return keyed.join(pixels.hint("merge"), ["_pr", "_pc"], "left").drop("_pr", "_pc")


def regrid_to_degrees(
    cells: DataFrame,
    origin_x: float,
    origin_y: float,
    step: float,
    target: DataFrame,
    value: str = "value",
) -> DataFrame:
    """Bilinear values of a metric grid at geographic target cells ``(r, c, lon, lat)``.

    ``origin_x, origin_y`` is the centre of source cell (0, 0), rows run south.
    Every valid source cell is sent to the four quads it is a corner of; one
    aggregation assembles the quads and one equi-join hands each target cell its
    quad, so targets are neither multiplied nor regrouped. NULL corners drop out
    of the weights.
    """
    corner = F.explode(F.array(*[
        F.struct((F.col("r") - i).alias("qr"), (F.col("c") - j).alias("qc"), F.lit(2 * i + j).alias("k"))
        for i in (0, 1) for j in (0, 1)
    ])).alias("q")
    quads = (
        cells.filter(F.col(value).isNotNull()).select(corner, F.col(value).alias("v"))
        .groupBy("q.qr", "q.qc")
        .agg(*[F.max(F.when(F.col("q.k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    )
    x, y = to_metres("lon", "lat")
    placed = target.withColumns({"_fr": (F.lit(origin_y) - y) / step, "_fc": (x - F.lit(origin_x)) / step})
    placed = placed.withColumns({"qr": F.floor("_fr").cast("int"), "qc": F.floor("_fc").cast("int")})
    a, b = F.col("_fr") - F.col("qr"), F.col("_fc") - F.col("qc")
    weights = [(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b]
    zero = F.lit(0.0)
    total, mass = zero, zero
    for k, w in enumerate(weights):
        total = total + F.coalesce(w * F.col(f"v{k}"), zero)
        mass = mass + F.when(F.col(f"v{k}").isNotNull(), w).otherwise(zero)
    joined = placed.join(quads, ["qr", "qc"], "left")
    return joined.select(*target.columns, F.when(mass > 0, total / mass).alias(value))


def geographic_target(spark, lon_min: float, lat_max: float, step_deg: float, height: int, width: int) -> DataFrame:
    """Cell centres of a north-up geographic grid."""
    cells = spark.range(height * width)
    return cells.select(
        F.expr(f"CAST(id DIV {width} AS INT)").alias("r"), (F.col("id") % width).cast("int").alias("c")
    ).withColumns({
        "lon": F.lit(lon_min) + (F.col("c") + 0.5) * F.lit(step_deg),
        "lat": F.lit(lat_max) - (F.col("r") + 0.5) * F.lit(step_deg),
    })
