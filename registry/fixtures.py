"""Stations, rasters, predictions and lookup tables derived from the given tables.

Every derivation exists twice: as a DataFrame here and as the CTE text of the same
name in ``SQL_*``, so both engines start from equal rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationgrid.functions import crs
from stationgrid.functions.crs import with_metres
from stationgrid.operators.grid import GridSpec
from stationgrid.operators.stations import dedupe_locations
from stationgrid.sources.tables import RasterMeta, boundary_edges


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- stations
STATION_COLUMNS = {
    "station_id": "c_custkey",
    "station": "c_name",
    "source": """CASE c_mktsegment WHEN 'BUILDING' THEN 'IMGW' WHEN 'MACHINERY' THEN 'IMGW'
        WHEN 'AUTOMOBILE' THEN 'TRAX' WHEN 'FURNITURE' THEN 'TRAX' ELSE 'NETATMO' END""",
    "isModel": "CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN (c_custkey % 3 = 0) END",
    "lat": "49.2E0 + ((lk * 7919) % 5200) / 1000E0",
    "lon": "14.5E0 + ((lk * 104729) % 9000) / 1000E0",
    "dem": "CAST((c_custkey * 613) % 1500 AS DOUBLE)",
    "temp": """18E0 - 0.0065E0 * ((c_custkey * 613) % 1500)
        + CASE WHEN c_custkey % 37 = 0 THEN 9E0 ELSE (c_acctbal - 4500E0) / 5000E0 END""",
}
_LK = "CASE WHEN c_custkey % 40 = 39 THEN c_custkey - 1 ELSE c_custkey END AS lk"


def stations(spark: SparkSession, sf: str) -> DataFrame:
    located = table(spark, sf, "customer").selectExpr("*", _LK)
    return located.selectExpr(*[f"{v} AS {k}" for k, v in STATION_COLUMNS.items()])


def unique_stations(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_locations(stations(spark, sf))


def metric_stations(spark: SparkSession, sf: str) -> DataFrame:
    return with_metres(unique_stations(spark, sf))


SQL_STATIONS = "stations AS (SELECT {} FROM (SELECT *, {} FROM customer) c)".format(
    ", ".join(f"{v} AS {k}" for k, v in STATION_COLUMNS.items()), _LK
)
SQL_PRIORITY = "CASE source WHEN 'IMGW' THEN 1 WHEN 'TRAX' THEN 2 WHEN 'NETATMO' THEN 3 ELSE 99 END"
SQL_UNIQUE = f"""uniq AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon
    ORDER BY {SQL_PRIORITY}, station, temp, station_id) AS rn FROM stations) q WHERE rn = 1)"""


def _e(value: float) -> str:
    return f"({value:.17e})"


def sql_metres(source: str, out: str, lon: str = "lon", lat: str = "lat", x: str = "x_pl", y: str = "y_pl") -> str:
    """CTEs that add projected coordinates to ``source`` under the name ``out``."""
    e = _e(crs.ECCENTRICITY)
    east = " + ".join(f"{_e(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.FORWARD, 1))
    north = " + ".join(f"{_e(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.FORWARD, 1))
    return f"""{out}_1 AS (SELECT *, radians({lon} - 19E0) AS dl,
        sinh(atanh(sin(radians({lat}))) - {e} * atanh({e} * sin(radians({lat})))) AS tt FROM {source}),
    {out}_2 AS (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1E0 + tt * tt)) AS eta FROM {out}_1),
    {out} AS (SELECT * EXCLUDE (dl, tt, xi, eta), 500000E0 + {_e(crs.RADIUS)} * (eta + {east}) AS {x},
        -5300000E0 + {_e(crs.RADIUS)} * (xi + {north}) AS {y} FROM {out}_2)"""


def sql_degrees(source: str, out: str, x: str = "x", y: str = "y") -> str:
    east = " ".join(f"- {_e(b)} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, b in enumerate(crs.INVERSE, 1))
    north = " ".join(f"- {_e(b)} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, b in enumerate(crs.INVERSE, 1))
    lat = " + ".join(f"{_e(d)} * sin({2 * j} * chi)" for j, d in enumerate(crs.LATITUDE, 1))
    return f"""{out}_1 AS (SELECT *, ({y} + 5300000E0) / {_e(crs.RADIUS)} AS xi0,
        ({x} - 500000E0) / {_e(crs.RADIUS)} AS eta0 FROM {source}),
    {out}_2 AS (SELECT *, xi0 {north} AS xi, eta0 {east} AS eta FROM {out}_1),
    {out}_3 AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM {out}_2),
    {out} AS (SELECT * EXCLUDE (xi0, eta0, xi, eta, chi), 19E0 + degrees(atan2(sinh(eta), cos(xi))) AS lon,
        degrees(chi + {lat}) AS lat FROM {out}_3)"""


# ---------------------------------------------------------------- snapshots
#: Six days of readings are one snapshot: the last reading of each station in it moves the station's temperature.
SNAPSHOT = "CAST(floor((day(ts) - 1) / 6) AS INT)"


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Stations of an archive: one row per snapshot and station with a reading in it."""
    readings = table(spark, sf, "events").selectExpr(f"{SNAPSHOT} AS snapshot", "user_id AS station_id", "ts", "value")
    last = readings.groupBy("snapshot", "station_id").agg(F.max_by("value", "ts").alias("value"))
    moved = metric_stations(spark, sf).join(last, "station_id")
    return moved.withColumn("temp", F.expr("temp + value / 20E0 - snapshot * dem / 2000E0"))


SQL_METRIC = sql_metres("uniq", "proj")
WITH_STATIONS = f"WITH {SQL_STATIONS}"
WITH_UNIQUE = f"{WITH_STATIONS}, {SQL_UNIQUE}"
WITH_METRIC = f"{WITH_UNIQUE}, {SQL_METRIC}"
SQL_SNAPSHOTS = f"""lastread AS (SELECT {SNAPSHOT} AS snapshot, user_id AS station_id, max_by(value, ts) AS value FROM events GROUP BY 1, 2),
    snaps AS (SELECT snapshot, proj.* EXCLUDE (temp), temp + value / 20E0 - snapshot * dem / 2000E0 AS temp FROM proj JOIN lastread USING (station_id))"""
WITH_SNAPSHOTS = f"{WITH_METRIC}, {SQL_SNAPSHOTS}"

# ---------------------------------------------------------------- rasters
WIDTH = 50
BANDS = {
    "dem": "CASE WHEN p_size = 13 THEN -9999E0 ELSE (p_retailprice - 900E0) * 15E0 END",
    "landscan": "CAST(p_size AS DOUBLE)",
    "water": "CAST(p_partkey % 7 AS DOUBLE)",
}
ALL_BANDS = BANDS | {
    "land_cover": "CAST(p_partkey % 11 AS DOUBLE)",
    "settlement": "CAST((p_partkey * 7) % 13 AS DOUBLE)",
    "forests": "CASE WHEN p_partkey % 5 = 0 THEN -9999E0 ELSE CAST(p_partkey % 3 AS DOUBLE) END",
    "ecostress": "280E0 + (p_partkey % 37) / 10E0",
}
_ROW, _COL = f"CAST(FLOOR(p_partkey / {WIDTH}E0) AS INT)", f"CAST(p_partkey % {WIDTH} AS INT)"


def bands(spark: SparkSession, sf: str, kinds: dict[str, str] = BANDS) -> DataFrame:
    part = table(spark, sf, "part")
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.expr(v).alias("value")) for b, v in kinds.items()])
    return part.select(F.expr(_ROW).alias("r"), F.expr(_COL).alias("c"), F.inline(pairs))


def dem_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(f"{_ROW} AS r", f"{_COL} AS c", f"{BANDS['dem']} AS value")


def metas(spark: SparkSession, sf: str, kinds: dict[str, str] = BANDS) -> list[RasterMeta]:
    rows = table(spark, sf, "part").agg(F.max(F.expr(_ROW))).first()[0] + 1
    nodata = {"dem": -9999.0, "forests": -9999.0}
    return [RasterMeta(b, 14.0, 55.0, 0.2, -0.15, rows, WIDTH, nodata.get(b)) for b in kinds]


def _bands_sql(kinds: dict[str, str]) -> str:
    return "bands AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, {_ROW} AS r, {_COL} AS c, {v} AS value FROM part" for b, v in kinds.items()) + ")"


SQL_BANDS, SQL_ALL_BANDS = _bands_sql(BANDS), _bands_sql(ALL_BANDS)
SQL_DEM = f"""dem AS (SELECT r, c, CASE WHEN value <> -9999E0 THEN value END AS v
    FROM (SELECT {_ROW} AS r, {_COL} AS c, {BANDS['dem']} AS value FROM part) q)"""
SQL_PIXEL = """CASE WHEN lon BETWEEN 14E0 AND 24E0 AND lat <= 55E0
        AND lat >= 55E0 + (-0.15E0) * (SELECT max(r) + 1 FROM bands)
        THEN CAST(FLOOR((lat - 55E0) / (-0.15E0)) AS INT) END AS pr,
    CASE WHEN lon BETWEEN 14E0 AND 24E0 THEN CAST(FLOOR((lon - 14E0) / 0.2E0) AS INT) END AS pc"""

# ---------------------------------------------------------------- boundary
RING = (
    (14.2, 53.9), (16.5, 54.6), (18.6, 54.8), (19.6, 54.4), (22.8, 54.3), (23.9, 52.6),
    (23.5, 51.0), (22.6, 49.1), (19.8, 49.3), (16.9, 50.2), (14.9, 50.9), (14.2, 53.9),
)


def ring_edges(spark: SparkSession) -> DataFrame:
    rows = [(1, i, lon, lat) for i, (lon, lat) in enumerate(RING)]
    return boundary_edges(spark.createDataFrame(rows, "ring_id int, seq int, lon double, lat double"))


SQL_RING = "ring AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {lon}E0, {lat}E0)" for i, (lon, lat) in enumerate(RING)
) + ") t(seq, lon, lat))"
SQL_EDGES = f"""{SQL_RING}, {sql_metres("ring", "ringm", x="x1", y="y1")},
    edges AS (SELECT a.seq, a.x1, a.y1, b.x1 AS x2, b.y1 AS y2 FROM ringm a JOIN ringm b ON b.seq = a.seq + 1)"""


def sql_inside(points: str, key: str, x: str = "x_pl", y: str = "y_pl") -> str:
    """A correlated count of edge crossings, as a BOOLEAN expression over ``points``."""
    return f"""((SELECT count(*) FROM edges e WHERE ((e.y1 <= {points}.{y} AND {points}.{y} < e.y2)
        OR (e.y2 <= {points}.{y} AND {points}.{y} < e.y1))
        AND {points}.{x} < e.x1 + ({points}.{y} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1)"""


# ---------------------------------------------------------------- predictions
BASE_PREDICTION = "temp + ((station_id * 31) % 41 - 20) / 10E0"
NEW_PREDICTION = "temp + ((station_id * 17) % 21 - 10) / 10E0"
MEMBERS = tuple(range(5))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    known = "CASE WHEN station_id % 50 <> 0 THEN {} END"
    member = [f"{NEW_PREDICTION} + {m - 2} * ((station_id % 7) / 10E0) AS m{m}" for m in MEMBERS]
    return stations(spark, sf).selectExpr(
        "station_id", "station", "source", "temp",
        f"{known.format(BASE_PREDICTION)} AS base", f"{known.format(NEW_PREDICTION)} AS new", *member,
    )


SQL_PREDICTIONS = f"""preds AS (SELECT station_id, station, source, temp,
    CASE WHEN station_id % 50 <> 0 THEN {BASE_PREDICTION} END AS base,
    CASE WHEN station_id % 50 <> 0 THEN {NEW_PREDICTION} END AS new,
    {", ".join(f"{NEW_PREDICTION} + {m - 2} * ((station_id % 7) / 10E0) AS m{m}" for m in MEMBERS)} FROM stations)"""
WITH_PREDICTIONS = f"{WITH_STATIONS}, {SQL_PREDICTIONS}"


# ---------------------------------------------------------------- grid
def grid_spec(spark: SparkSession, sf: str) -> GridSpec:
    """A grid over the stations' extent with about as many cells as stations."""
    row = metric_stations(spark, sf).agg(
        F.floor(F.min("x_pl") / 1000), F.floor(F.min("y_pl") / 1000), F.ceil(F.max("x_pl") / 1000),
        F.ceil(F.max("y_pl") / 1000), F.count("*"),
    ).first()
    return GridSpec(row[0] * 1000.0, row[1] * 1000.0, row[2] * 1000.0, row[3] * 1000.0,
                    float(math.floor(600000.0 / math.sqrt(row[4]))))


SQL_SPEC = """spec AS (SELECT floor(min(x_pl) / 1000) * 1000 AS x0, floor(min(y_pl) / 1000) * 1000 AS y0,
    ceil(max(x_pl) / 1000) * 1000 AS x1, ceil(max(y_pl) / 1000) * 1000 AS y1,
    floor(600000E0 / sqrt(count(*))) AS step FROM proj),
  rect AS (SELECT *, CAST(ceil((x1 - x0) / step) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / step) AS BIGINT) AS ny FROM spec),
  cells0 AS (SELECT CAST(i // nx AS INT) AS r, CAST(i % nx AS INT) AS c, x0 + (i % nx) * step AS x, y1 - (i // nx) * step AS y
    FROM rect, LATERAL (SELECT unnest(range(nx * ny)) AS i) g)"""
SQL_GRID = f"{SQL_SPEC}, {sql_degrees('cells0', 'cells')}"
WITH_GRID = f"{WITH_METRIC}, {SQL_GRID}"

# ---------------------------------------------------------------- seeded keys
def sql_key_number(key: str, seed: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|' || CAST({seed} AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)"


def r(name: str, digits: int = 6, alias: str | None = None):
    """Rounded column for comparison across engines."""
    return F.round(F.col(name), digits).alias(alias or name)
