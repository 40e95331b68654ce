"""Raster bands, boundary rings, geocode cache and colour classes as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import SQL_BANDS, WITH_STATIONS, WITH_UNIQUE, bands, r, sql_metres, stations, table, unique_stations
from stationgrid.operators.boundary import extent, map_aspect, mark_inside
from stationgrid.operators.colors import classify
from stationgrid.operators.dissolve import dissolve
from stationgrid.session import scratch_path
from stationgrid.sources.tables import boundary_edges, parse_color_lines, read_bands, read_color_scale


@query("SRC5", f"WITH {SQL_BANDS} SELECT band, r, c, value FROM bands WHERE band IN ('dem', 'water')")
def raster_bands(spark, sf):
    path = scratch_path(spark, "bands")
    bands(spark, sf).write.partitionBy("band").parquet(path)
    return read_bands(spark, path, ["dem", "water", "forests"])


def nation_rings(spark, sf):
    """A rectangle around each nation's stations, as closed vertex rings."""
    located = stations(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("station_id"), "c_nationkey"), "station_id"
    )
    box = located.groupBy(F.col("c_nationkey").alias("ring_id")).agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    )
    corners = [("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s")]
    return box.select("ring_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("seq"), F.col(a).alias("lon"), F.col(b).alias("lat")) for i, (a, b) in enumerate(corners)
    ])))


_RINGS = """box AS (SELECT c.c_nationkey AS ring_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n
    FROM stations JOIN customer c ON c.c_custkey = stations.station_id GROUP BY 1),
  vertex AS (SELECT ring_id, 0 AS seq, w AS lon, s AS lat FROM box UNION ALL SELECT ring_id, 1, e, s FROM box
    UNION ALL SELECT ring_id, 2, e, n FROM box UNION ALL SELECT ring_id, 3, w, n FROM box UNION ALL SELECT ring_id, 4, w, s FROM box)"""


@query("SRC6", f"""{WITH_STATIONS}, {_RINGS}, {sql_metres('vertex', 'v')}
    SELECT a.ring_id, a.seq, round(a.x_pl, 3) AS x1, round(a.y_pl, 3) AS y1, round(b.x_pl, 3) AS x2, round(b.y_pl, 3) AS y2
    FROM v a JOIN v b ON a.ring_id = b.ring_id AND b.seq = a.seq + 1""")
def ring_edge_table(spark, sf):
    return boundary_edges(nation_rings(spark, sf)).select("ring_id", "seq", *[r(c, 3) for c in ("x1", "y1", "x2", "y2")])


#: Half widths of the shrunken boxes, as a share of the whole ones; units of a hundred-thousandth of a degree serve as metres.
_SHRUNK, _UNIT = 0.155, 100_000.0


def halved_boxes(spark, sf):
    """Around the middle of each nation's box two boxes side by side; boxes of different nations overlap."""
    corner = nation_rings(spark, sf).groupBy("ring_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    mid = corner.selectExpr("ring_id", "(w + e) / 2 AS x", "(s + n) / 2 AS y", f"(e - w) * {_SHRUNK}E0 AS dx", f"(n - s) * {_SHRUNK}E0 AS dy")
    halves = mid.selectExpr("ring_id", "y - dy AS s", "y + dy AS n", "inline(array(struct(0 AS half, x - dx AS w, x AS e), struct(1 AS half, x AS w, x + dx AS e)))")
    corners = [("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s")]
    return halves.select((F.col("ring_id") * 2 + F.col("half")).alias("ring_id"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("seq"), (F.col(a) * _UNIT).alias("lon"), (F.col(b) * _UNIT).alias("lat")) for i, (a, b) in enumerate(corners)
    ])))


@query("SRC6_union", f"""{WITH_STATIONS}, box AS (SELECT c.c_nationkey AS ring_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n
      FROM stations JOIN customer c ON c.c_custkey = stations.station_id GROUP BY 1),
    small AS (SELECT ((w + e) / 2 - (e - w) * {_SHRUNK}E0) * {_UNIT} AS w, ((w + e) / 2 + (e - w) * {_SHRUNK}E0) * {_UNIT} AS e,
      ((s + n) / 2 - (n - s) * {_SHRUNK}E0) * {_UNIT} AS s, ((s + n) / 2 + (n - s) * {_SHRUNK}E0) * {_UNIT} AS n FROM box)
    SELECT station_id, EXISTS (SELECT 1 FROM small b WHERE b.w <= stations.lon * {_UNIT} AND stations.lon * {_UNIT} < b.e
      AND b.s <= stations.lat * {_UNIT} AND stations.lat * {_UNIT} < b.n) AS inside FROM stations""")
def union_of_boxes(spark, sf):
    """Stations inside the dissolved border of overlapping and adjacent boxes."""
    border = dissolve(boundary_edges(halved_boxes(spark, sf), projected=False))
    points = stations(spark, sf).select("station_id", (F.col("lon") * _UNIT).alias("x"), (F.col("lat") * _UNIT).alias("y"))
    return mark_inside(points, border, "x", "y").select("station_id", "inside")


@query("SRC7", f"""{WITH_STATIONS} SELECT station || '|PL' AS cache_key, lat, lon FROM stations WHERE station_id % 5 <> 0""")
def geocode_cache(spark, sf):
    from stationgrid.sinks.geocache import upsert_geocode_cache
    from stationgrid.sources.tables import read_geocode_cache

    path = scratch_path(spark, "geocache")
    known = stations(spark, sf).filter("station_id % 5 <> 0").selectExpr("concat(station, '|PL') AS cache_key", "lat", "lon")
    upsert_geocode_cache(spark, path, known)
    return read_geocode_cache(spark, path)


_SCALE = "CAST(p_size + (p_size * p_size) {div} 60 - 30 AS INT)"


def scale_lines(spark, sf):
    """Landed CSV lines of a colour scale with uneven steps."""
    return table(spark, sf, "part").selectExpr(
        f"concat(CAST({_SCALE.format(div='div')} AS STRING), ',#', substr(md5(CAST(p_size AS STRING)), 1, 6)) AS line"
    )


_SCALE_SQL = f"""scale AS (SELECT DISTINCT {_SCALE.format(div='//')} AS value, '#' || substr(md5(CAST(p_size AS VARCHAR)), 1, 6) AS color FROM part)"""


@query("SRC8", f"WITH {_SCALE_SQL} SELECT value, color FROM scale")
def color_scale(spark, sf):
    return parse_color_lines(scale_lines(spark, sf))


@query("SRC8_csv", f"WITH {_SCALE_SQL} SELECT value, color FROM scale")
def color_scale_file(spark, sf):
    path = scratch_path(spark, "colors")
    parse_color_lines(scale_lines(spark, sf)).write.csv(path, header=True)
    return read_color_scale(spark, path)


@query("PRJ16", f"""{WITH_STATIONS}, {_SCALE_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY value) - 1 AS i FROM scale),
    n AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi FROM scale),
    binned AS (SELECT station_id, temp, (SELECT count(*) FROM scale WHERE value <= greatest(lo, least(hi, temp))) - 1 AS bin FROM stations, n),
    idx AS (SELECT station_id, CAST(CASE WHEN temp >= hi THEN n - 1 ELSE trunc((n - 1) / CAST(n - 2 AS DOUBLE) * bin) END AS INT) AS color_index FROM binned, n)
    SELECT station_id, color_index, color FROM idx JOIN ranked ON i = color_index""")
def color_classes(spark, sf):
    return classify(stations(spark, sf), "temp", parse_color_lines(scale_lines(spark, sf))).select("station_id", "color_index", "color")


@query("AGG7", f"{WITH_UNIQUE} SELECT min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM uniq")
def station_extent(spark, sf):
    return extent(unique_stations(spark, sf), "lon", "lat")


@query("PRJ17", f"""{WITH_UNIQUE} SELECT round((max(lon) - min(lon)) * cos(radians((min(lat) + max(lat)) / 2)) / (max(lat) - min(lat)), 6) AS aspect FROM uniq""")
def extent_aspect(spark, sf):
    return map_aspect(extent(unique_stations(spark, sf), "lon", "lat")).select(r("aspect"))
