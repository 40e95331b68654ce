"""Raster masking, sampling, terrain layers and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import (
    BANDS,
    SQL_BANDS,
    SQL_DEM,
    SQL_PIXEL,
    WITH_METRIC,
    bands,
    dem_pixels,
    metas,
    metric_stations,
    r,
    sql_metres,
    table,
)
from stationgrid.functions.cleaning import mask_nodata
from stationgrid.operators.grid import smooth
from stationgrid.operators.raster import geographic_target, regrid_to_degrees, sample_bands, sample_layers
from stationgrid.operators.terrain import encode_aspect, terrain_layers

STEP = 0.2


@query("PRJ7", f"WITH {SQL_BANDS} SELECT band, r, c, CASE WHEN band = 'dem' AND value = -9999E0 THEN NULL ELSE value END AS value FROM bands")
def masked_bands(spark, sf):
    nodata = F.when(F.col("band") == "dem", F.lit(-9999.0))
    return bands(spark, sf).select("band", "r", "c", mask_nodata(F.col("value"), nodata).alias("value"))


@query("PRJ8", """SELECT p_partkey, round(sin(radians(p_size * 7.2E0)), 6) AS aspect_sin, round(cos(radians(p_size * 7.2E0)), 6) AS aspect_cos FROM part""")
def cyclic_aspect(spark, sf):
    angles = table(spark, sf, "part").selectExpr("p_partkey", "p_size * 7.2E0 AS aspect")
    return encode_aspect(angles).select("p_partkey", r("aspect_sin"), r("aspect_cos"))


@query("JN4", f"""{WITH_METRIC}, {SQL_BANDS}, keyed AS (SELECT station_id, {SQL_PIXEL} FROM proj)
    SELECT station_id, {", ".join(f"max(CASE WHEN b.band = '{b}' AND b.value <> -9999E0 THEN b.value END) AS {b}" for b in BANDS)}
    FROM keyed LEFT JOIN bands b ON b.r = keyed.pr AND b.c = keyed.pc GROUP BY station_id""")
def sampled_bands(spark, sf):
    points = metric_stations(spark, sf).drop("dem")
    return sample_bands(points, bands(spark, sf), metas(spark, sf)).select("station_id", *BANDS)


# ---------------------------------------------------------------- terrain
_FILL = f"""{SQL_DEM}, mid AS (SELECT median(v) AS m FROM dem), z AS (SELECT r, c, v, coalesce(v, m) AS z FROM dem, mid)"""


def _gradient_sql(source: str, out: str, value: str, name: str, axis: str) -> str:
    """Neighbours by self-join; central inside, one-sided at the edges."""
    other = "c" if axis == "r" else "r"
    on = lambda d: f"n.{other} = a.{other} AND n.{axis} = a.{axis} {d} 1"
    return f"""{out} AS (SELECT a.*, CASE WHEN p.{value} IS NULL THEN (q.{value} - a.{value}) / 0.2E0
        WHEN q.{value} IS NULL THEN (a.{value} - p.{value}) / 0.2E0 ELSE (q.{value} - p.{value}) / 0.4E0 END AS {name}
        FROM {source} a LEFT JOIN {source} p ON {on('-').replace('n.', 'p.')} LEFT JOIN {source} q ON {on('+').replace('n.', 'q.')})"""


_GRADIENTS = ", ".join([
    _FILL,
    _gradient_sql("z", "g1", "z", "dx", "c"),
    _gradient_sql("g1", "g2", "z", "dy", "r"),
    _gradient_sql("g2", "g3", "dx", "dxx", "c"),
    _gradient_sql("g3", "g4", "dy", "dyy", "r"),
])


def _layers(spark, sf, **options):
    return terrain_layers(dem_pixels(spark, sf), metas(spark, sf)[0], pixel_size=STEP, **options)


@query("WIN1", f"WITH {_GRADIENTS} SELECT r, c, round(CASE WHEN v IS NOT NULL THEN degrees(atan(sqrt(dx * dx + dy * dy))) END, 6) AS slope FROM g2")
def slope(spark, sf):
    return _layers(spark, sf, gradient_only=True).select("r", "c", r("slope"))


@query("WIN2", f"""WITH {_GRADIENTS} SELECT r, c, round(CASE WHEN v IS NOT NULL THEN fmod(degrees(atan2(-dx, dy)) + 360, 360) END, 6) AS aspect FROM g2""")
def aspect(spark, sf):
    return _layers(spark, sf, gradient_only=True).select("r", "c", r("aspect"))


@query("WIN3", f"WITH {_GRADIENTS} SELECT r, c, round(CASE WHEN v IS NOT NULL THEN dxx + dyy END, 3) AS curvature FROM g4")
def curvature(spark, sf):
    return _layers(spark, sf, gradient_only=True).select("r", "c", r("curvature", 3))


def _focal_sql(w: int) -> str:
    h = w // 2
    return f"""f{w} AS (SELECT a.r, a.c, avg(b.v) AS mean{w}, CASE WHEN count(b.v) > 1 THEN stddev_pop(b.v) ELSE 0E0 END AS std{w}
        FROM dem a LEFT JOIN dem b ON b.r BETWEEN a.r - {h} AND a.r + {h} AND b.c BETWEEN a.c - {h} AND a.c + {h} GROUP BY a.r, a.c)"""


_FOCAL = f"{SQL_DEM}, {_focal_sql(3)}, {_focal_sql(9)}, {_focal_sql(27)}"
_FOCAL_FROM = "FROM dem JOIN f3 USING (r, c) JOIN f9 USING (r, c) JOIN f27 USING (r, c)"


@query("WIN4", f"WITH {_FOCAL} SELECT r, c, {', '.join(f'round(v - mean{w}, 6) AS tpi_{w}' for w in (3, 9, 27))} {_FOCAL_FROM}")
def topographic_position(spark, sf):
    return _layers(spark, sf, focal_only=True).select("r", "c", *[r(f"tpi_{w}") for w in (3, 9, 27)])


@query("WIN5", f"WITH {_FOCAL} SELECT r, c, {', '.join(f'round(std{w}, 6) AS roughness_{w}' for w in (3, 9, 27))} {_FOCAL_FROM}")
def roughness(spark, sf):
    return _layers(spark, sf, focal_only=True).select("r", "c", *[r(f"roughness_{w}") for w in (3, 9, 27)])


_STACK = ("slope", "curvature", *(f"{layer}_{w}" for w in (3, 9, 27) for layer in ("tpi", "roughness")))


@query("WIN6", f"""{WITH_METRIC}, {SQL_BANDS}, {_GRADIENTS}, {', '.join(_focal_sql(w) for w in (3, 9, 27))}, keyed AS (SELECT station_id, {SQL_PIXEL} FROM proj),
    layer AS (SELECT g4.r, g4.c, CASE WHEN v IS NOT NULL THEN degrees(atan(sqrt(dx * dx + dy * dy))) END AS slope, CASE WHEN v IS NOT NULL THEN dxx + dyy END AS curvature,
      CASE WHEN v IS NOT NULL THEN radians(fmod(degrees(atan2(-dx, dy)) + 360, 360)) END AS angle,
      {', '.join(f'v - mean{w} AS tpi_{w}, std{w} AS roughness_{w}' for w in (3, 9, 27))}
      FROM g4 {' '.join(f'JOIN f{w} ON f{w}.r = g4.r AND f{w}.c = g4.c' for w in (3, 9, 27))})
    SELECT station_id, round(sin(angle), 6) AS aspect_sin, round(cos(angle), 6) AS aspect_cos, {', '.join(f'round({c}, {3 if c == "curvature" else 6}) AS {c}' for c in _STACK)}
    FROM keyed LEFT JOIN layer ON layer.r = pr AND layer.c = pc""")
def sampled_terrain(spark, sf):
    sampled = sample_layers(metric_stations(spark, sf), _layers(spark, sf), metas(spark, sf)[0], [*_STACK, "aspect"])
    return encode_aspect(sampled).select("station_id", r("aspect_sin"), r("aspect_cos"), *[r(c, 3 if c == "curvature" else 6) for c in _STACK])


@query("WIN7", f"""WITH {SQL_DEM} SELECT a.r, a.c, round(CASE WHEN any_value(a.v) IS NOT NULL THEN
      sum(b.v * exp(-(power(a.r - b.r, 2) + power(a.c - b.c, 2)) / 2E0)) / sum(CASE WHEN b.v IS NOT NULL THEN exp(-(power(a.r - b.r, 2) + power(a.c - b.c, 2)) / 2E0) END) END, 6) AS value
    FROM dem a LEFT JOIN dem b ON b.r BETWEEN a.r - 4 AND a.r + 4 AND b.c BETWEEN a.c - 4 AND a.c + 4 GROUP BY a.r, a.c""")
def smoothed(spark, sf):
    cells = dem_pixels(spark, sf).select("r", "c", mask_nodata(F.col("value"), -9999.0).alias("value"))
    return smooth(cells, ["value"], 1.0).select("r", "c", r("value"))


# ---------------------------------------------------------------- resampling
@query("RGD1", f"""WITH {SQL_DEM}, n AS (SELECT max(r) + 1 AS h FROM dem),
    target AS (SELECT CAST(i // 50 AS INT) AS r, CAST(i % 50 AS INT) AS c, 14.5E0 + (i % 50 + 0.5E0) * 0.1E0 AS lon, 54E0 - (i // 50 + 0.5E0) * 0.1E0 AS lat
      FROM n, LATERAL (SELECT unnest(range(h * 50)) AS i) g), {sql_metres('target', 'tm', x='x', y='y')},
    pos AS (SELECT r, c, (700000E0 - y) / 10000E0 AS fr, (x - 180000E0) / 10000E0 AS fc FROM tm),
    corner AS (SELECT p.r, p.c, d.v, (CASE WHEN d.r = floor(fr) THEN 1 - (fr - floor(fr)) ELSE fr - floor(fr) END)
      * (CASE WHEN d.c = floor(fc) THEN 1 - (fc - floor(fc)) ELSE fc - floor(fc) END) AS w
      FROM pos p LEFT JOIN dem d ON d.r BETWEEN floor(fr) AND floor(fr) + 1 AND d.c BETWEEN floor(fc) AND floor(fc) + 1)
    SELECT r, c, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 4) AS value FROM corner GROUP BY r, c""")
def regridded(spark, sf):
    source = dem_pixels(spark, sf).select("r", "c", mask_nodata(F.col("value"), -9999.0).alias("value"))
    target = geographic_target(spark, 14.5, 54.0, 0.1, metas(spark, sf)[0].height, 50)
    return regrid_to_degrees(source, 180_000.0, 700_000.0, 10_000.0, target).select("r", "c", r("value", 4))
