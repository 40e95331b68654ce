"""Feature derivation, screening, imputation, splits and the prediction grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import (
    ALL_BANDS,
    SQL_ALL_BANDS,
    SQL_BANDS,
    SQL_EDGES,
    SQL_PIXEL,
    WITH_GRID,
    WITH_METRIC,
    WITH_STATIONS,
    WITH_UNIQUE,
    bands,
    grid_spec,
    metas,
    metric_stations,
    r,
    ring_edges,
    sql_inside,
    sql_key_number,
    stations,
    table,
    unique_stations,
)
from registry.places import _MOUNTAIN_DIST, _MOUNTAINS
from registry.rasters import _GRADIENTS, _focal_sql
from stationgrid.config import AnalysisConfig
from stationgrid.functions.stats import exact_quantiles, medians
from stationgrid.models.trend import RobustScale, column_or_default
from stationgrid.operators.features import (
    FeatureModel,
    RasterSet,
    align_to_training,
    bind_blocks,
    coast_distance,
    drop_sparse_rows,
    elevation_features,
    engineer_features,
    impute,
    interactions,
    usable_features,
    valid_percent,
)
from stationgrid.operators.grid import grid_cells, prediction_grid, scatter
from stationgrid.operators.kriging import clamp_residual, jittered
from stationgrid.operators.split import bags, split_stations
from stationgrid.plans.analysis import grid_features

CONFIG = AnalysisConfig()


# ---------------------------------------------------------------- scalar features
@query("PRJ11", f"""{WITH_UNIQUE}, lim AS (SELECT min(dem) AS lo, max(dem) AS hi FROM uniq) SELECT station_id,
    round((dem - lo) / (hi - lo), 6) AS elevation_percentile, round(power(dem / 1000, 2), 6) AS elevation_squared FROM uniq, lim""")
def elevation(spark, sf):
    s = unique_stations(spark, sf)
    low, high = s.agg(F.min("dem"), F.max("dem")).first()
    return elevation_features(s, low, high).select("station_id", r("elevation_percentile"), r("elevation_squared"))


def featured(spark, sf):
    """Stations with a few plain feature columns; each lacks values in its own way."""
    return unique_stations(spark, sf).selectExpr(
        "station_id", "station", "source", "temp", "lat", "lon",
        "CASE WHEN station_id % 6 <> 0 THEN dem END AS dem",
        "CASE WHEN station_id % 4 <> 1 THEN sin(radians(station_id % 360)) END AS aspect_sin",
        "CASE WHEN station_id % 4 <> 1 THEN cos(radians(station_id % 360)) END AS aspect_cos",
        "CASE WHEN station_id % 12 = 0 THEN dem / 10 END AS slope",
        "CASE WHEN station_id % 5 < 2 THEN CAST(station_id % 19 AS DOUBLE) END AS ecostress",
        "CASE WHEN station_id % 2 = 0 THEN CAST(station_id % 7 AS DOUBLE) END AS settlement",
    )


_FEATURED = """feat AS (SELECT station_id, station, source, temp, lat, lon, CASE WHEN station_id % 6 <> 0 THEN dem END AS dem,
    CASE WHEN station_id % 4 <> 1 THEN sin(radians(station_id % 360)) END AS aspect_sin,
    CASE WHEN station_id % 4 <> 1 THEN cos(radians(station_id % 360)) END AS aspect_cos,
    CASE WHEN station_id % 12 = 0 THEN dem / 10 END AS slope,
    CASE WHEN station_id % 5 < 2 THEN CAST(station_id % 19 AS DOUBLE) END AS ecostress,
    CASE WHEN station_id % 2 = 0 THEN CAST(station_id % 7 AS DOUBLE) END AS settlement FROM uniq)"""
FEATURES = ["dem", "aspect_sin", "aspect_cos", "slope", "ecostress", "settlement"]
KEPT = [c for c in FEATURES if c != "slope"]
WITH_FEATURED = f"{WITH_UNIQUE}, {_FEATURED}"


@query("PRJ12", f"""{WITH_FEATURED} SELECT station_id, round(dem * aspect_sin, 6) AS dem_x_aspect_sin, round(dem * aspect_cos, 6) AS dem_x_aspect_cos,
    round(dem * slope, 6) AS dem_x_slope, round(ecostress * settlement, 6) AS ecostress_x_settlement, dem * dem AS dem_squared FROM feat""")
def products_of_features(spark, sf):
    made = interactions(featured(spark, sf))
    return made.select("station_id", *[r(c) for c in ("dem_x_aspect_sin", "dem_x_aspect_cos", "dem_x_slope", "ecostress_x_settlement")], "dem_squared")


@query("PRJ13", """SELECT c_custkey AS station_id, greatest(least((c_acctbal - 4500E0) / 500E0, 5E0), -5E0) AS residual FROM customer""")
def clamped(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("station_id"), clamp_residual((F.col("c_acctbal") - 4500.0) / 500.0, 5.0).alias("residual")
    )


@query("PRJ14", f"""{WITH_METRIC} SELECT station_id, round(({sql_key_number('station_id', '42')} / 4503599627370496E0 * 2 - 1) * 0.1E0, 6) AS dx,
    round(({sql_key_number('station_id', '43')} / 4503599627370496E0 * 2 - 1) * 0.1E0, 6) AS dy FROM proj""")
def jitter(spark, sf):
    base = metric_stations(spark, sf).select("station_id", F.lit(0.0).alias("x_pl"), F.lit(0.0).alias("y_pl"))
    return jittered(base, 42).select("station_id", r("x_pl", 6, "dx"), r("y_pl", 6, "dy"))


@query("PRJ15", f"""{WITH_METRIC}, q AS (SELECT quantile_cont(dem, 0.5) AS m, quantile_cont(dem, 0.75) - quantile_cont(dem, 0.25) AS w,
      quantile_cont(y_pl, 0.5) AS my, quantile_cont(y_pl, 0.75) - quantile_cont(y_pl, 0.25) AS wy FROM proj)
    SELECT station_id, round((dem - m) / w, 6) AS dem, round((y_pl - my) / wy, 6) AS y_pl FROM proj, q""")
def robust_scaled(spark, sf):
    s = metric_stations(spark, sf)
    scale = RobustScale.fit(s, ["dem", "y_pl"])
    return s.select("station_id", *[F.round(scale.column(F.col(c), c), 6).alias(c) for c in ("dem", "y_pl")])


@query("PRJ19", f"{WITH_FEATURED} SELECT station_id, dem, round(aspect_sin, 6) AS aspect_sin, ecostress, settlement FROM feat")
def feature_roles(spark, sf):
    model = FeatureModel(("temp", "lat", "lon", "dem", "aspect_sin", "ecostress", "settlement"))
    trend, env = model.roles(["dem"])
    return featured(spark, sf).select("station_id", *trend, *env).withColumn("aspect_sin", F.round("aspect_sin", 6))


@query("PRJ20", f"""{WITH_UNIQUE}, m AS (SELECT median(dem) AS dem FROM uniq) SELECT station_id, m.dem AS dem, 0E0 AS unseen FROM uniq, m""")
def missing_columns(spark, sf):
    s = unique_stations(spark, sf)
    fills = medians(s, ["dem"])
    bare = s.drop("dem")
    return bare.select("station_id", *[column_or_default(bare, c, fills).alias(c) for c in ("dem", "unseen")])


# ---------------------------------------------------------------- screening
_SHARE = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 0E0 ELSE 1E0 END) * 100 AS pct FROM feat" for c in FEATURES)


@query("AGG2", f"{WITH_FEATURED}, s AS ({_SHARE}) SELECT feature, round(pct, 6) AS valid_pct FROM s")
def validity(spark, sf):
    return valid_percent(featured(spark, sf), FEATURES).select("feature", r("valid_pct"))


_KEPT_ROWS = f"""kept AS (SELECT * FROM feat WHERE {" + ".join(f"CAST({c} IS NULL AS INT)" for c in KEPT)} < {len(KEPT)} * 0.5)"""


@query("FLT4", f"{WITH_FEATURED} SELECT station_id, {', '.join(f'round({c}, 6) AS {c}' for c in KEPT)} FROM feat")
def screened_columns(spark, sf):
    rows = featured(spark, sf)
    return rows.select("station_id", *[r(c) for c in usable_features(rows, FEATURES, CONFIG.min_valid_fraction)])


@query("FLT5", f"{WITH_FEATURED}, {_KEPT_ROWS} SELECT station_id FROM kept")
def screened_rows(spark, sf):
    return drop_sparse_rows(featured(spark, sf), KEPT, CONFIG.max_null_fraction).select("station_id")


@query("AGG3", f"""{WITH_FEATURED}, m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in KEPT)} FROM feat)
    SELECT station_id, {", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in KEPT)} FROM feat, m""")
def imputed(spark, sf):
    rows = featured(spark, sf)
    return impute(rows, medians(rows, KEPT)).select("station_id", *[r(c) for c in KEPT])


@query("AGG3_quantiles", """SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
    round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem""")
def refined_quantiles(spark, sf):
    """The bounded-memory path of the exact quantiles, forced by a small buffer."""
    rows = table(spark, sf, "lineitem")
    q = exact_quantiles(rows, ["l_extendedprice"], [0.25, 0.5, 0.75], buffer_rows=1000)["l_extendedprice"]
    return rows.agg(*[F.round(F.lit(v), 6).alias(n) for n, v in zip(("q25", "q50", "q75"), q)])


@query("JN9", f"""{WITH_METRIC} SELECT station_id, dem, round(x_pl, 3) AS x_pl, round(greatest(600000E0 - y_pl, 0) / 1000, 6) AS dist_coast FROM proj""")
def bound_blocks(spark, sf):
    s = metric_stations(spark, sf)
    place = s.select("station_id", r("x_pl", 3))
    coast = s.select("station_id", F.round(coast_distance(F.col("y_pl"), CONFIG.coast_northing), 6).alias("dist_coast"))
    return bind_blocks(s.select("station_id", "dem"), place, coast, on=["station_id"])


@query("JN10", f"""{WITH_FEATURED}, m AS (SELECT median(dem) AS dem, median(slope) AS slope FROM feat)
    SELECT station_id, coalesce(feat.dem, m.dem) AS dem, m.slope AS slope, 0E0 AS water FROM feat, m""")
def aligned(spark, sf):
    rows = featured(spark, sf)
    fills = medians(rows, ["dem", "slope"])
    return align_to_training(rows.select("station_id", "dem"), ["dem", "slope", "water"], fills)


# ---------------------------------------------------------------- whole feature step
def raster_set(spark, sf):
    """All seven bands, with the default terrain windows."""
    return RasterSet.prepare(bands(spark, sf, ALL_BANDS), metas(spark, sf, ALL_BANDS), CONFIG)


_TERRAIN_SQL = f"""{_GRADIENTS}, {_focal_sql(3)}, {_focal_sql(9)}, {_focal_sql(27)},
    layer AS (SELECT g4.r, g4.c, CASE WHEN v IS NOT NULL THEN degrees(atan(sqrt(dx * dx + dy * dy))) END AS slope,
      CASE WHEN v IS NOT NULL THEN radians(fmod(degrees(atan2(-dx, dy)) + 360, 360)) END AS angle,
      CASE WHEN v IS NOT NULL THEN dxx + dyy END AS curvature, v - mean3 AS tpi_3, std3 AS roughness_3, v - mean9 AS tpi_9, std9 AS roughness_9,
      v - mean27 AS tpi_27, std27 AS roughness_27
      FROM g4 JOIN f3 ON f3.r = g4.r AND f3.c = g4.c JOIN f9 ON f9.r = g4.r AND f9.c = g4.c JOIN f27 ON f27.r = g4.r AND f27.c = g4.c)"""
_PLAIN_BANDS = [b for b in ALL_BANDS if b != "dem"]
_FEA_COLUMNS = ["dem", *_PLAIN_BANDS, "slope", "curvature", "tpi_3", "roughness_3", "tpi_9", "roughness_9", "tpi_27", "roughness_27", "aspect_sin", "aspect_cos",
                "x_pl", "y_pl", "dist_coast", "dist_mountains", "dem_x_aspect_sin", "dem_x_aspect_cos", "dem_squared", "dem_x_slope", "dist_coast_x_dem", "ecostress_x_settlement"]
_FEA_SQL = f"""{WITH_METRIC}, {_MOUNTAINS.replace(SQL_BANDS, SQL_ALL_BANDS)}, {_TERRAIN_SQL}, keyed AS (SELECT station_id, temp, x_pl, y_pl, {SQL_PIXEL} FROM proj),
    raw AS (SELECT k.station_id, k.temp, k.x_pl, k.y_pl, d.value AS dem0, {", ".join(f"b_{b}.value AS {b}" for b in _PLAIN_BANDS)}, layer.* EXCLUDE (r, c, angle),
      sin(angle) AS aspect_sin, cos(angle) AS aspect_cos, greatest(600000E0 - k.y_pl, 0) / 1000 AS dist_coast, {_MOUNTAIN_DIST.replace('p.', 'k.')} AS dist_mountains
      FROM keyed k LEFT JOIN bands d ON d.band = 'dem' AND d.r = pr AND d.c = pc AND d.value <> -9999E0
      {" ".join(f"LEFT JOIN bands b_{b} ON b_{b}.band = '{b}' AND b_{b}.r = pr AND b_{b}.c = pc AND b_{b}.value <> -9999E0" for b in _PLAIN_BANDS)}
      LEFT JOIN layer ON layer.r = pr AND layer.c = pc),
    fx AS (SELECT *, dem0 AS dem, dem0 * aspect_sin AS dem_x_aspect_sin, dem0 * aspect_cos AS dem_x_aspect_cos, dem0 * dem0 AS dem_squared,
      dem0 * slope AS dem_x_slope, dist_coast * dem0 AS dist_coast_x_dem, ecostress * settlement AS ecostress_x_settlement FROM raw),
    fk AS (SELECT * FROM fx WHERE {" + ".join(f"CAST({c} IS NULL AS INT)" for c in _FEA_COLUMNS)} < {len(_FEA_COLUMNS)} * 0.5),
    fm AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _FEA_COLUMNS)} FROM fk)"""


@query("FEA1", f"""{_FEA_SQL} SELECT station_id, {", ".join(f"round(coalesce({c}, m_{c}), 5) AS {c}" for c in _FEA_COLUMNS)} FROM fk, fm""")
def feature_step(spark, sf):
    s = metric_stations(spark, sf).drop("dem")
    rows, model = engineer_features(s, raster_set(spark, sf), CONFIG)
    return rows.select("station_id", *[r(c, 5) for c in model.features])


# ---------------------------------------------------------------- split and bags
def _split_sql(buffer_m: int) -> str:
    far = lambda a, b: f"NOT EXISTS (SELECT 1 FROM {b} b WHERE sqrt(power(a.x_pl - b.x_pl, 2) + power(a.y_pl - b.y_pl, 2)) < {buffer_m})"
    order = "md5(CAST(station_id AS VARCHAR) || '|42'), station_id"
    return f"""{WITH_METRIC}, rk AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM proj),
      test AS (SELECT * FROM rk WHERE rn <= ceil(n * 0.15E0)), rest0 AS (SELECT * FROM rk a WHERE rn > ceil(n * 0.15E0) AND {far('a', 'test')}),
      rest AS (SELECT * EXCLUDE (rn, n), row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM rest0),
      val AS (SELECT * FROM rest WHERE rn <= ceil(n * (0.15E0 / (1E0 - 0.15E0)))), train AS (SELECT * FROM rest a WHERE rn > ceil(n * (0.15E0 / (1E0 - 0.15E0))) AND {far('a', 'val')})
      SELECT station_id, CASE WHEN station_id IN (SELECT station_id FROM test) THEN 'test' WHEN station_id IN (SELECT station_id FROM val) THEN 'val'
        WHEN station_id IN (SELECT station_id FROM train) THEN 'train' ELSE 'buffer' END AS part FROM proj"""


@query("SPL1", _split_sql(2000))
def spatial_split(spark, sf):
    return split_stations(metric_stations(spark, sf), AnalysisConfig(buffer_km=2.0))


@query("SPL1_wide", _split_sql(20000))
def spatial_split_default_buffer(spark, sf):
    return split_stations(metric_stations(spark, sf), AnalysisConfig(), allow_empty=True)


@query("SPL2", f"""{WITH_UNIQUE}, s AS (SELECT unnest([42, 123, 456, 789, 101112]) AS seed), k AS (SELECT station_id, seed,
      row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(station_id AS VARCHAR) || '|' || CAST(seed AS VARCHAR)), station_id) AS rn,
      count(*) OVER (PARTITION BY seed) AS n FROM uniq, s)
    SELECT station_id, seed FROM k WHERE rn <= round(n * 0.95E0)""")
def bagged(spark, sf):
    return bags(unique_stations(spark, sf).select("station_id"), CONFIG.ensemble_seeds, CONFIG.bag_fraction)


# ---------------------------------------------------------------- grid
@query("GRD1", f"{WITH_GRID} SELECT r, c, round(x, 3) AS x, round(y, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM cells")
def regular_grid(spark, sf):
    return grid_cells(spark, grid_spec(spark, sf)).select("r", "c", r("x", 3), r("y", 3), r("lon"), r("lat"))


@query("JN8", f"{WITH_GRID}, {SQL_EDGES} SELECT r, c, {sql_inside('cells', 'r', 'x', 'y')} AS inside FROM cells")
def masked_grid(spark, sf):
    return prediction_grid(spark, grid_spec(spark, sf), ring_edges(spark)).select("r", "c", "inside")


@query("GRD3", f"""{WITH_GRID}, {SQL_EDGES} SELECT r, c, CASE WHEN {sql_inside('cells', 'r', 'x', 'y')} THEN round(x / 1000 + r, 6) END AS value FROM cells""")
def scattered(spark, sf):
    cells = prediction_grid(spark, grid_spec(spark, sf), ring_edges(spark))
    predicted = cells.filter("inside").select("r", "c", F.round(F.col("x") / 1000 + F.col("r"), 6).alias("value"))
    return scatter(cells, predicted, ["value"])


_GRID_LAYERS = ["slope", "curvature", *(f"{k}_{w}" for w in (3, 9, 27) for k in ("tpi", "roughness"))]
#: ``snow`` is a feature that training had and the grid has not.
_GRID_NEEDED = ["dem", "y_pl", "x_pl", *_PLAIN_BANDS, *_GRID_LAYERS, "aspect_sin", "aspect_cos", "dist_coast", "dist_mountains", "dist_coast_x_dem", "snow"]
_GRID_FILLS = {"landscan": 21.5, "snow": 7.0, "forests": 1.0}


@query("GRD2", f"""{WITH_GRID}, {_MOUNTAINS.replace(SQL_BANDS, SQL_ALL_BANDS)}, {SQL_EDGES}, {_TERRAIN_SQL}, med AS (SELECT median(dem) AS dem FROM uniq),
    g AS (SELECT r AS gr, c AS gc, x AS x_pl, y AS y_pl, {SQL_PIXEL} FROM cells WHERE {sql_inside('cells', 'r', 'x', 'y')}),
    f AS (SELECT gr, gc, x_pl, y_pl, coalesce(d.value, med.dem) AS dem, {", ".join(f"coalesce(b_{b}.value, {_GRID_FILLS.get(b, 0.0)}) AS {b}" for b in _PLAIN_BANDS)},
      {", ".join(f"coalesce(layer.{c}, 0) AS {c}" for c in _GRID_LAYERS)}, coalesce(sin(angle), 0) AS aspect_sin, coalesce(cos(angle), 0) AS aspect_cos, {_MOUNTAIN_DIST.replace('p.', 'g.')} AS dist_mountains
      FROM g, med LEFT JOIN bands d ON d.band = 'dem' AND d.r = pr AND d.c = pc AND d.value <> -9999E0
      {" ".join(f"LEFT JOIN bands b_{b} ON b_{b}.band = '{b}' AND b_{b}.r = pr AND b_{b}.c = pc AND b_{b}.value <> -9999E0" for b in _PLAIN_BANDS)}
      LEFT JOIN layer ON layer.r = pr AND layer.c = pc)
    SELECT gr AS r, gc AS c, dem, round(y_pl, 3) AS y_pl, round(x_pl, 3) AS x_pl, {", ".join(f"round({c}, 5) AS {c}" for c in [*_PLAIN_BANDS, *_GRID_LAYERS, "aspect_sin", "aspect_cos", "dist_mountains"])},
      round(greatest(600000E0 - y_pl, 0) / 1000, 6) AS dist_coast, round(greatest(600000E0 - y_pl, 0) / 1000 * dem, 3) AS dist_coast_x_dem, 7E0 AS snow FROM f""")
def grid_feature_table(spark, sf):
    """All station features at the cells inside the boundary: seven bands, terrain in three windows, mountains."""
    cells = prediction_grid(spark, grid_spec(spark, sf), ring_edges(spark)).filter("inside")
    model = FeatureModel(tuple(_GRID_NEEDED), {"dem": medians(unique_stations(spark, sf), ["dem"])["dem"], **_GRID_FILLS})
    ready = grid_features(cells, raster_set(spark, sf), model, CONFIG)
    plain = [*_PLAIN_BANDS, *_GRID_LAYERS, "aspect_sin", "aspect_cos", "dist_mountains"]
    return ready.select("r", "c", "dem", r("y_pl", 3), r("x_pl", 3), *[r(c, 5) for c in plain], r("dist_coast"), r("dist_coast_x_dem", 3), "snow")


@query("AGG19", f"""{WITH_METRIC}, {SQL_EDGES} SELECT 'feeds' AS step, 'rows' AS metric, count(*) AS value FROM stations
    UNION ALL SELECT 'prepare', 'duplicates', (SELECT count(*) FROM stations) - count(*) FROM uniq
    UNION ALL SELECT 'boundary', 'inside', count(*) FROM proj WHERE {sql_inside('proj', 'station_id')}""")
def step_counts(spark, sf):
    from stationgrid.operators.boundary import mark_inside
    from stationgrid.plans.analysis import run_report

    raw, kept = stations(spark, sf), metric_stations(spark, sf)
    return run_report(spark, [
        ("feeds", "rows", raw),
        ("prepare", "duplicates", raw.join(kept.select("station_id"), "station_id", "left_anti")),
        ("boundary", "inside", mark_inside(kept, ring_edges(spark)).filter("inside")),
    ])
