"""Terrain layers from a height raster with separable window functions.

Everything along a raster row needs one shuffle by row, everything along a column
one shuffle by column: gradients, second gradients and the focal sums of every
window size share those two. A window partition is a span of a row or column with a
halo, so its size is fixed by ``span`` and not by the raster's shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from stationgrid.functions.cleaning import mask_nodata, null_if_nan
from stationgrid.functions.stats import medians
from stationgrid.operators.grid import complete_rectangle
from stationgrid.operators.tiles import SPAN, own_cells, with_halo
from stationgrid.sources.tables import RasterMeta


def _gradient(value: Column, along: WindowSpec, step: float) -> Column:
    """Central difference inside, one-sided difference at both ends and beside missing pixels."""
    before, after = (F.min(value).over(along.rangeBetween(k, k)) for k in (-1, 1))
    return (
        F.when(before.isNull(), (after - value) / step)
        .when(after.isNull(), (value - before) / step)
        .otherwise((after - before) / (2.0 * step))
    )


def terrain_layers(
    dem: DataFrame,
    meta: RasterMeta,
    windows: tuple[int, ...] = (3, 9, 27),
    pixel_size: float | None = None,
    mask: bool = True,
    focal_only: bool = False,
    gradient_only: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """``(r, c, dem, slope, aspect, curvature, tpi_w..., roughness_w...)``.

    ``dem`` holds pixels ``(r, c, value)``; rows may be left out. Heights without a value
    take the raster median for the gradients and give NULL slope, aspect,
    curvature and TPI; roughness ignores them. Neighbours are found by position, not by the order of rows.
    """
    step = pixel_size or meta.pixel_size
    height = mask_nodata(F.col("value"), meta.nodata) if mask else null_if_nan(F.col("value"))
    pixels = complete_rectangle(dem.select("r", "c", height.alias("dem")))
    middle = medians(pixels, ["dem"])["dem"]
    # a missing pixel is no neighbour; one without a height counts as a middling one
    pixels = pixels.withColumns({"_z": F.when(F.col("present"), F.coalesce("dem", F.lit(middle))), "_d": F.col("dem") - F.lit(middle)})
    sizes = () if gradient_only else windows
    slopes = not focal_only
    # a second gradient looks two cells away
    reach = max([2 * slopes, *(w // 2 for w in sizes)])

    pixels, along_row = with_halo(pixels, "r", "c", reach, span)
    if slopes:
        pixels = pixels.withColumn("_dx", _gradient(F.col("_z"), along_row, step))
        pixels = pixels.withColumn("_dxx", _gradient(F.col("_dx"), along_row, step))
    sums = {}
    for w in sizes:
        frame = along_row.rangeBetween(-(w // 2), w // 2)
        sums |= {
            f"_s{w}": F.sum("_d").over(frame),
            f"_q{w}": F.sum(F.col("_d") * F.col("_d")).over(frame),
            f"_n{w}": F.count("_d").over(frame),
        }
    pixels = own_cells(pixels.withColumns(sums) if sums else pixels, "c", span)

    pixels, along_col = with_halo(pixels, "c", "r", reach, span)
    if slopes:
        pixels = pixels.withColumn("_dy", _gradient(F.col("_z"), along_col, step))
        pixels = pixels.withColumn("_dyy", _gradient(F.col("_dy"), along_col, step))
    totals = {}
    for w in sizes:
        frame = along_col.rangeBetween(-(w // 2), w // 2)
        totals |= {f"_{k}{w}": F.sum(f"_{k}{w}").over(frame) for k in "sqn"}
    pixels = own_cells(pixels.withColumns(totals) if totals else pixels, "r", span)

    valid = F.col("dem").isNotNull()
    layers: dict[str, Column] = {}
    if slopes:
        dx, dy = F.col("_dx"), F.col("_dy")
        layers["slope"] = F.when(valid, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))
        layers["aspect"] = F.when(valid, F.pmod(F.degrees(F.atan2(-dx, dy)) + 360.0, F.lit(360.0)))
        layers["curvature"] = F.when(valid, F.col("_dxx") + F.col("_dyy"))
    for w in sizes:
        s, q, n = F.col(f"_s{w}"), F.col(f"_q{w}"), F.col(f"_n{w}")
        layers[f"tpi_{w}"] = F.when(valid, F.col("_d") - F.try_divide(s, n))
        spread = F.try_divide(q - F.try_divide(s * s, n), n)
        layers[f"roughness_{w}"] = F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(F.lit(0.0))
    return pixels.filter("present").select("r", "c", "dem", *[v.alias(k) for k, v in layers.items()])


def encode_aspect(df: DataFrame) -> DataFrame:
    """Replace the circular angle by its sine and cosine."""
    angle = F.radians("aspect")
    return df.withColumns({"aspect_sin": F.sin(angle), "aspect_cos": F.cos(angle)}).drop("aspect")


def terrain_columns(windows: tuple[int, ...]) -> list[str]:
    return ["slope", "aspect", "curvature", *[f"{k}_{w}" for w in windows for k in ("tpi", "roughness")]]


def has_valid_heights(dem: DataFrame, meta: RasterMeta) -> bool:
    """Terrain layers are skipped for a raster without any usable height."""
    return not dem.filter(mask_nodata(F.col("value"), meta.nodata).isNotNull()).isEmpty()
