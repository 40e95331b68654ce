"""Projection, geocoding, boundary tests, neighbourhoods and quality control."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import (
    SQL_BANDS,
    SQL_DEM,
    SQL_EDGES,
    WITH_METRIC,
    WITH_SNAPSHOTS,
    WITH_STATIONS,
    WITH_UNIQUE,
    dem_pixels,
    metas,
    metric_stations,
    r,
    ring_edges,
    snapshots,
    sql_degrees,
    sql_inside,
    sql_metres,
    stations,
    unique_stations,
)
from stationgrid.config import AnalysisConfig
from stationgrid.functions.crs import to_degrees, with_degrees, with_metres
from stationgrid.operators.boundary import mark_inside
from stationgrid.operators.geocode import locate_stations, lookup_cached, resolve_names
from stationgrid.operators.distance import mountain_distance_layer
from stationgrid.operators.features import coast_distance
from stationgrid.operators.knn import nearest
from stationgrid.operators.proximity import mountain_distance, mountain_pixels, remove_buffered, spatial_lag
from stationgrid.operators.qc import dynamic_lapse_rate, dynamic_lapse_rates, judge_stations, lapse_gate, neighbour_consensus, spatial_qc, worst_outliers
from stationgrid.session import scratch_path
from stationgrid.sinks.geocache import upsert_geocode_cache
from stationgrid.sources.tables import read_geocode_cache

CONFIG = AnalysisConfig()
REFERENCE_SIGN = AnalysisConfig(elev_sign=-1)


# ---------------------------------------------------------------- projection
@query("PRJ1", f"{WITH_METRIC} SELECT station_id, round(x_pl, 3) AS x_pl, round(y_pl, 3) AS y_pl FROM proj")
def projected(spark, sf):
    return metric_stations(spark, sf).select("station_id", r("x_pl", 3), r("y_pl", 3))


@query("PRJ2", f"""{WITH_METRIC}, moved AS (SELECT station_id, floor(x_pl) AS x, floor(y_pl) AS y FROM proj), {sql_degrees('moved', 'back')}
    SELECT station_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM back""")
def unprojected(spark, sf):
    whole = metric_stations(spark, sf).select("station_id", F.floor("x_pl").cast("double").alias("x"), F.floor("y_pl").cast("double").alias("y"))
    return with_degrees(whole).select("station_id", r("lon", 8), r("lat", 8))


@query("PRJ2_roundtrip", f"{WITH_UNIQUE} SELECT station_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM uniq")
def projection_round_trip(spark, sf):
    lon, lat = to_degrees("x_pl", "y_pl")
    return metric_stations(spark, sf).select("station_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("PRJ9", f"{WITH_METRIC} SELECT station_id, lat, lon, round(x_pl, 3) AS x_pl, round(y_pl, 3) AS y_pl FROM proj")
def coordinate_features(spark, sf):
    return with_metres(unique_stations(spark, sf)).select("station_id", "lat", "lon", r("x_pl", 3), r("y_pl", 3))


@query("PRJ10", f"{WITH_METRIC} SELECT station_id, round(greatest(600000E0 - y_pl, 0) / 1000, 6) AS dist_coast FROM proj")
def distance_to_coast(spark, sf):
    return metric_stations(spark, sf).select(
        "station_id", F.round(coast_distance(F.col("y_pl"), CONFIG.coast_northing), 6).alias("dist_coast")
    )


# ---------------------------------------------------------------- geocoding
def unlocated(spark, sf):
    """Every third station already has coordinates; the rest must be looked up.
    Every tenth name is written with national letters."""
    return stations(spark, sf).select(
        "station_id",
        F.when(F.col("station_id") % 10 == 0, F.replace("station", F.lit("Customer"), F.lit("Łódź"))).otherwise(F.col("station")).alias("station"),
        "source", "temp",
        F.when(F.col("station_id") % 3 == 0, F.col("lat")).alias("lat"),
        F.when(F.col("station_id") % 3 == 0, F.col("lon")).alias("lon"),
    )


def cache_rows(spark, sf):
    return stations(spark, sf).filter("station_id % 5 <> 0").selectExpr("concat(station, '|PL') AS cache_key", "lat", "lon")


def gazetteer(spark, sf):
    """ASCII spelling, a local-suffix entry and a place abroad."""
    return stations(spark, sf).selectExpr(
        """CASE WHEN station_id % 10 = 0 THEN concat(replace(station, 'Customer', 'Lodz'), ', Poland')
            WHEN station_id % 20 = 5 THEN concat(station, ' stacja meteo, Poland') ELSE concat(station, ', Elsewhere') END AS query""",
        "lat", "CASE WHEN station_id % 4 = 0 THEN 3.5E0 ELSE lon END AS lon",
    )


_UNLOCATED = """unloc AS (SELECT station_id, CASE WHEN station_id % 10 = 0 THEN replace(station, 'Customer', 'Łódź') ELSE station END AS station,
    source, temp, CASE WHEN station_id % 3 = 0 THEN lat END AS lat, CASE WHEN station_id % 3 = 0 THEN lon END AS lon, lat AS tlat, lon AS tlon FROM stations)"""
_RESOLVED = f"""hit0 AS (SELECT station_id, CASE WHEN station_id % 10 = 0 THEN replace(station, 'Customer', 'Łódź') ELSE station END AS station, lat,
    CASE WHEN station_id % 4 = 0 THEN 3.5E0 ELSE lon END AS lon, (station_id % 10 = 0 OR station_id % 20 = 5) AS known FROM stations),
  {sql_metres('hit0', 'hit1')}, {SQL_EDGES},
  resolved AS (SELECT station_id, station || '|PL' AS cache_key, lat, lon,
    CASE WHEN NOT known THEN 'NOT_FOUND' WHEN {sql_inside('hit1', 'station_id')} THEN 'OK' ELSE 'OUT_OF_POLAND' END AS status FROM hit1)"""


@query("JN1", f"""{WITH_STATIONS}, {_UNLOCATED} SELECT station_id, station, coalesce(lat, CASE WHEN station_id % 5 <> 0 THEN tlat END) AS lat,
    coalesce(lon, CASE WHEN station_id % 5 <> 0 THEN tlon END) AS lon FROM unloc""")
def cached_lookup(spark, sf):
    return lookup_cached(unlocated(spark, sf), cache_rows(spark, sf)).select("station_id", "station", "lat", "lon")


@query("JN1_dropped", f"""{WITH_STATIONS}, {_UNLOCATED} SELECT station_id, coalesce(lat, tlat) AS lat FROM unloc WHERE station_id % 3 = 0 OR station_id % 5 <> 0""")
def located_only(spark, sf):
    return locate_stations(unlocated(spark, sf), cache_rows(spark, sf)).select("station_id", "lat")


@query("JN2", f"""{WITH_STATIONS}, {_RESOLVED} SELECT cache_key, CASE WHEN status = 'OK' THEN lat END AS lat,
    CASE WHEN status = 'OK' THEN lon END AS lon, status FROM resolved""")
def resolved_names(spark, sf):
    return resolve_names(unlocated(spark, sf), gazetteer(spark, sf), ring_edges(spark))


@query("SNK1", f"""{WITH_STATIONS}, {_RESOLVED}, fresh AS (SELECT cache_key, lat, lon FROM resolved WHERE status = 'OK')
    SELECT * FROM fresh UNION ALL SELECT station || '|PL', lat, lon FROM stations
    WHERE station_id % 5 <> 0 AND station || '|PL' NOT IN (SELECT cache_key FROM fresh)""")
def merged_cache(spark, sf):
    fresh = resolve_names(unlocated(spark, sf), gazetteer(spark, sf), ring_edges(spark)).filter("status = 'OK'")
    path = scratch_path(spark, "geocache")
    upsert_geocode_cache(spark, path, cache_rows(spark, sf))
    upsert_geocode_cache(spark, path, fresh)
    return read_geocode_cache(spark, path).select("cache_key", "lat", "lon")


# ---------------------------------------------------------------- boundary
@query("JN3", f"{WITH_METRIC}, {SQL_EDGES} SELECT station_id, {sql_inside('proj', 'station_id')} AS inside FROM proj")
def inside_boundary(spark, sf):
    return mark_inside(metric_stations(spark, sf), ring_edges(spark)).select("station_id", "inside")


@query("JN3_tolerance", f"""{WITH_METRIC}, {SQL_EDGES}, t AS (SELECT station_id, x_pl, y_pl, e.*, ((x_pl - x1) * (x2 - x1) + (y_pl - y1) * (y2 - y1))
    / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS u FROM proj, edges e),
  d AS (SELECT station_id, min(sqrt(power(x_pl - (x1 + greatest(0, least(1, u)) * (x2 - x1)), 2)
    + power(y_pl - (y1 + greatest(0, least(1, u)) * (y2 - y1)), 2))) AS dist FROM t GROUP BY station_id)
  SELECT station_id, ({sql_inside('proj', 'station_id')} OR dist <= 15000) AS inside FROM proj JOIN d USING (station_id)""")
def near_boundary(spark, sf):
    return mark_inside(metric_stations(spark, sf), ring_edges(spark), tolerance=15_000.0).select("station_id", "inside")


# ---------------------------------------------------------------- neighbours
def _knn_sql(k: int) -> str:
    return f"""pairs AS (SELECT a.station_id, a.temp, a.dem, a.source, a.isModel, b.station_id AS nbr_id, b.temp AS nt, b.dem AS nd,
        sqrt(power(a.x_pl - b.x_pl, 2) + power(a.y_pl - b.y_pl, 2)) AS distance FROM proj a JOIN proj b ON a.station_id <> b.station_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY distance, nbr_id) AS rank FROM pairs) q WHERE rank <= {k})"""


@query("JN5", f"{WITH_METRIC}, {_knn_sql(10)} SELECT station_id, nbr_id, CAST(rank AS INT) AS rank, round(distance, 3) AS distance FROM near")
def ten_nearest(spark, sf):
    s = metric_stations(spark, sf)
    return nearest(s, s, 10, exclude_self=True, distinct_base=True).select("station_id", "nbr_id", "rank", r("distance", 3))


_MOUNTAINS = f"""{SQL_BANDS}, high AS (SELECT 14E0 + (c + 0.5E0) * 0.2E0 AS lon, 55E0 + (r + 0.5E0) * (-0.15E0) AS lat FROM bands WHERE band = 'dem' AND value > 800),
    {sql_metres('high', 'peak')}"""
_MOUNTAIN_DIST = """coalesce((SELECT min(sqrt(power(p.x_pl - peak.x_pl, 2) + power(p.y_pl - peak.y_pl, 2))) / 1000 FROM peak), 0)"""


@query("JN6", f"{WITH_METRIC}, {_MOUNTAINS} SELECT station_id, round({_MOUNTAIN_DIST}, 6) AS dist_mountains FROM proj p")
def distance_to_mountains(spark, sf):
    peaks = mountain_pixels(dem_pixels(spark, sf), metas(spark, sf)[0], CONFIG.mountain_height)
    return mountain_distance(metric_stations(spark, sf), peaks).select("station_id", r("dist_mountains"))


@query("JN6_grid", f"""WITH {SQL_DEM} SELECT r, c, round(coalesce((SELECT min(sqrt(power((dem.r - h.r) * 8000E0, 2) + power((dem.c - h.c) * 10000E0, 2))) FROM dem h WHERE h.v > 800) / 1000, 0), 6)
    AS dist_mountains FROM dem""")
def mountain_layer(spark, sf):
    meta = replace(metas(spark, sf)[0], origin_x=180_000.0, origin_y=700_000.0, step_x=10_000.0, step_y=-8_000.0, geographic=False)
    return mountain_distance_layer(dem_pixels(spark, sf), meta, CONFIG.mountain_height).select("r", "c", r("dist_mountains"))


@query("JN7", f"""{WITH_METRIC} SELECT station_id FROM proj a WHERE source <> 'IMGW' AND NOT EXISTS (SELECT 1 FROM proj b
    WHERE b.source = 'IMGW' AND sqrt(power(a.x_pl - b.x_pl, 2) + power(a.y_pl - b.y_pl, 2)) < 8000)""")
def outside_buffer(spark, sf):
    s = metric_stations(spark, sf)
    return remove_buffered(s.filter("source = 'IMGW'"), s.filter("source <> 'IMGW'"), 8.0).select("station_id")


@query("AGG13", f"""{WITH_METRIC}, {_knn_sql(5)} SELECT station_id, round(sum(nt / (distance + 1)) / sum(1 / (distance + 1)), 6) AS spatial_lag_temp,
    round(min(distance), 3) AS spatial_lag_min_dist, round(avg(distance), 3) AS spatial_lag_mean_dist FROM near GROUP BY station_id""")
def spatial_lags(spark, sf):
    return spatial_lag(metric_stations(spark, sf), 5).select(
        "station_id", r("spatial_lag_temp"), r("spatial_lag_min_dist", 3), r("spatial_lag_mean_dist", 3)
    )


# ---------------------------------------------------------------- quality control
@query("AGG11", f"""{WITH_UNIQUE} SELECT count(*) AS n_trusted, min(dem) AS min_dem, max(dem) AS max_dem, max(dem) - min(dem) AS spread
    FROM uniq WHERE source = 'IMGW' AND isModel = false""")
def lapse_rate_gate(spark, sf):
    return lapse_gate(unique_stations(spark, sf))


@query("QC1")
def lapse_rate(spark, sf):
    rate = dynamic_lapse_rate(unique_stations(spark, sf), CONFIG)
    return unique_stations(spark, sf).agg(F.count("*").alias("n_rows")).withColumn("lapse_rate", F.lit(round(rate, 5)))


def _consensus_sql(sign: int) -> str:
    return f"""cons AS (SELECT station_id, quantile_cont(nt + {sign} * 0.0065E0 * (nd - dem), 0.5) AS expected FROM near GROUP BY station_id, dem)"""


def _judged_sql(sign: int) -> str:
    return f"""{_consensus_sql(sign)}, judged AS (SELECT station_id, source, temp, coalesce(source = 'IMGW' AND isModel = false, false) AS is_trusted, expected,
      CASE WHEN coalesce(source = 'IMGW' AND isModel = false, false) THEN 0E0 ELSE abs(temp - expected) END AS deviation FROM proj JOIN cons USING (station_id))"""


@query("AGG12", f"{WITH_METRIC}, {_knn_sql(10)}, {_consensus_sql(1)} SELECT station_id, round(expected, 6) AS expected FROM cons")
def consensus(spark, sf):
    return neighbour_consensus(metric_stations(spark, sf), 0.0065, CONFIG).select("station_id", r("expected"))


_QC_COLUMNS = "station_id, source, round(expected, 6) AS expected, round(deviation, 6) AS deviation, is_trusted, deviation > 3.5 AS is_outlier"


def _qc(spark, sf, config):
    return judge_stations(metric_stations(spark, sf), 0.0065, config).select(
        "station_id", "source", r("expected"), r("deviation"), "is_trusted", "is_outlier"
    )


@query("QC2", f"{WITH_METRIC}, {_knn_sql(10)}, {_judged_sql(1)} SELECT {_QC_COLUMNS} FROM judged")
def quality_control(spark, sf):
    return _qc(spark, sf, CONFIG)


@query("QC2_reference_sign", f"{WITH_METRIC}, {_knn_sql(10)}, {_judged_sql(-1)} SELECT {_QC_COLUMNS} FROM judged")
def quality_control_reference_sign(spark, sf):
    return _qc(spark, sf, REFERENCE_SIGN)


@query("QC2_kept", f"{WITH_METRIC}, {_knn_sql(10)}, {_judged_sql(1)} SELECT station_id, round(temp, 6) AS temp FROM judged WHERE NOT deviation > 3.5")
def kept_stations(spark, sf):
    return spatial_qc(metric_stations(spark, sf), CONFIG, 0.0065).select("station_id", r("temp"))


@query("TOP3", f"""{WITH_METRIC}, {_knn_sql(10)}, {_judged_sql(1)} SELECT station_id, source, round(deviation, 6) AS deviation FROM judged
    WHERE deviation > 3.5 ORDER BY judged.deviation DESC, station_id LIMIT 5""")
def five_worst(spark, sf):
    judged = judge_stations(metric_stations(spark, sf), 0.0065, CONFIG)
    return worst_outliers(judged, 5).select("station_id", "source", r("deviation"))


# ---------------------------------------------------------------- an archive of snapshots
@query("QC1_snapshots", f"""{WITH_SNAPSHOTS} SELECT snapshot, count(*) FILTER (WHERE t) AS n_trusted, max(dem) FILTER (WHERE t) - min(dem) FILTER (WHERE t) AS spread, true AS as_alone
    FROM (SELECT *, coalesce(source = 'IMGW' AND isModel = false, false) AS t FROM snaps) q GROUP BY snapshot""")
def lapse_rates_of_snapshots(spark, sf):
    """All snapshots' lapse rates fitted in one job, each beside a fit of its rows alone."""
    rows = snapshots(spark, sf)
    alone = [(s, dynamic_lapse_rate(rows.filter(F.col("snapshot") == s), CONFIG)) for (s,) in rows.select("snapshot").distinct().collect()]
    one = spark.createDataFrame(alone, "snapshot int, rate double")
    return dynamic_lapse_rates(rows, CONFIG, ("snapshot",)).join(one, "snapshot").select(
        "snapshot", "n_trusted", "spread", (F.abs(F.col("lapse_rate") - F.col("rate")) < 2e-6).alias("as_alone")
    )


_SNAPSHOT_QC = f"""pairs AS (SELECT a.snapshot, a.station_id, a.temp, a.dem, a.source, a.isModel, b.station_id AS nbr_id, b.temp AS nt, b.dem AS nd,
        sqrt(power(a.x_pl - b.x_pl, 2) + power(a.y_pl - b.y_pl, 2)) AS distance FROM snaps a JOIN snaps b ON a.snapshot = b.snapshot AND a.station_id <> b.station_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, station_id ORDER BY distance, nbr_id) AS rank FROM pairs) q WHERE rank <= 10),
    cons AS (SELECT snapshot, station_id, quantile_cont(nt + 0.001E0 * (snapshot + 5) * (nd - dem), 0.5) AS expected FROM near GROUP BY snapshot, station_id)"""


@query("QC2_snapshots", f"{WITH_SNAPSHOTS}, {_SNAPSHOT_QC} SELECT snapshot, station_id, round(expected, 6) AS expected FROM cons")
def consensus_of_snapshots(spark, sf):
    """Neighbour consensus of every snapshot with a lapse rate of its own."""
    rows = snapshots(spark, sf)
    rates = rows.select("snapshot").distinct().withColumn("lapse_rate", F.expr("0.001E0 * (snapshot + 5)"))
    return neighbour_consensus(rows, rates, CONFIG, by=("snapshot",)).select("snapshot", "station_id", r("expected"))
