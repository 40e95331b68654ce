"""Feed parsing, cleaning, union and station preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import (
    SQL_EDGES,
    SQL_PRIORITY,
    WITH_METRIC,
    WITH_STATIONS,
    WITH_UNIQUE,
    ring_edges,
    sql_inside,
    sql_metres,
    stations,
    table,
)
from stationgrid.config import AnalysisConfig, BoundingBox
from stationgrid.functions.cleaning import ascii_fold, clean_station_name, clean_temperature, is_numeric_text
from stationgrid.functions.crs import with_metres
from stationgrid.operators.boundary import mark_inside
from stationgrid.operators.stations import (
    dedupe_locations,
    display_stations,
    drop_incomplete,
    gate_report,
    label_stations,
    order_by_priority,
    source_priority,
)
from stationgrid.sources.feeds import (
    CROWD_JSON,
    NATIONAL_JSON,
    count_by_source,
    distinct_sources,
    filter_data_mode,
    json_status,
    parse_crowd,
    parse_national,
    parse_road,
    union_feeds,
    with_network,
    within_box,
)

# Temperature texts as the feeds write them: plain, comma, arrow, padded, junk, missing.
_TENTHS = "CAST(floor(temp * 10E0) AS BIGINT)"
_WHOLE, _FRACTION = f"CAST(floor({_TENTHS} / 10E0) AS BIGINT)", f"({_TENTHS} % 10)"


def _text(dialect: str) -> str:
    s = "STRING" if dialect == "spark" else "VARCHAR"
    whole, part = f"CAST({_WHOLE} AS {s})", f"CAST({_FRACTION} AS {s})"
    return f"""CASE WHEN station_id % 13 = 0 THEN NULL WHEN station_id % 11 = 0 THEN 'brak'
        WHEN station_id % 4 = 0 THEN concat({whole}, '.', {part}) WHEN station_id % 4 = 1 THEN concat({whole}, ',', {part})
        WHEN station_id % 4 = 2 THEN concat({whole}, '.', {part}, '↑') ELSE concat('  ', {whole}, '.', {part}, ' ↓ ') END"""


def _number(strip: bool = False) -> str:
    """The DuckDB value each text stands for."""
    digits = f"CAST(CAST({_WHOLE} AS VARCHAR) || CAST({_FRACTION} AS VARCHAR) AS DOUBLE)"
    value = f"CAST(CAST({_WHOLE} AS VARCHAR) || '.' || CAST({_FRACTION} AS VARCHAR) AS DOUBLE)"
    comma = digits if strip else value
    return f"""CASE WHEN station_id % 13 = 0 OR station_id % 11 = 0 THEN NULL
        WHEN station_id % 4 = 1 THEN {comma} ELSE {value} END"""


_NAME = """CASE station_id % 6 WHEN 0 THEN concat(station, ' max') WHEN 1 THEN concat(station, ' ŚREDNIA')
    WHEN 2 THEN concat('Min. ', station) WHEN 3 THEN concat(station, ' z pomiarów') WHEN 4 THEN concat('  ', station, ' AVG ')
    ELSE station END"""
_CLEAN_NAME = """CASE station_id % 6 WHEN 2 THEN '. ' || station ELSE station END"""


def raw_stations(spark, sf):
    return stations(spark, sf).selectExpr("*", f"{_text('spark')} AS text", f"{_NAME} AS raw_name")


def national_payloads(spark, sf):
    """One JSON array per station; some payloads are empty, some are cut off."""
    rows = raw_stations(spark, sf).filter("source = 'IMGW'")
    quoted = "CASE WHEN text IS NULL THEN 'null' ELSE concat('\"', text, '\"') END"
    flag = "CASE WHEN station_id % 7 = 0 THEN '' ELSE concat(',\"isModel\":', CAST(isModel AS STRING)) END"
    return rows.selectExpr(
        "station_id AS payload_id", "CAST(station_id % 16 + 1 AS INT) AS province",
        f"""CASE WHEN station_id % 50 = 0 THEN '[{{"statName":"cut' WHEN station_id % 50 = 1 THEN '[]'
        ELSE concat('[{{"statName":"', station, '","temp":', {quoted}, ',"statId":', CAST(station_id AS STRING), {flag}, '}}]') END AS payload""",
    )


_NATIONAL_SQL = f"""national AS (SELECT station, {_number()} AS temp, CAST(station_id AS VARCHAR) AS statId,
    CASE WHEN station_id % 7 <> 0 THEN isModel END AS isModel, CAST(station_id % 16 + 1 AS INT) AS province,
    station_id FROM stations WHERE source = 'IMGW' AND station_id % 50 NOT IN (0, 1))"""


@query("SRC1", f"""{WITH_STATIONS}, {_NATIONAL_SQL}
    SELECT province, station, temp, statId, isModel, 'IMGW' AS source FROM national WHERE temp IS NOT NULL""")
def national_feed(spark, sf):
    return parse_national(national_payloads(spark, sf)).select("province", "station", "temp", "statId", "isModel", "source")


def road_pages(spark, sf):
    """A page per station: two header rows, the reading, a short row, a row without a number."""
    rows = stations(spark, sf).filter("source = 'TRAX'")
    reading = f"concat(CAST({_WHOLE} AS STRING), ',', CAST({_FRACTION} AS STRING))"
    return rows.selectExpr(
        "CAST(station_id % 16 AS INT) AS region",
        f"""concat('<html><body><table><tr><th>Stacja</th></tr>\n<TR class="h"><td>Nazwa</td><td>1,0</td></TR>',
        '<tr><td> <b>', station, '</b> </td><td align="right">', {reading}, '</td><td>x</td></tr>',
        '<tr><td>only one cell</td></tr>', '<tr><td>', station, ' B</td>\n<td>--</td></tr></table></body></html>') AS html""",
    )


@query("SRC2", f"""{WITH_STATIONS} SELECT station, CAST(CAST({_WHOLE} AS VARCHAR) || '.' || CAST({_FRACTION} AS VARCHAR) AS DOUBLE) AS temp,
    CAST(station_id % 16 AS INT) AS region, 'TRAX' AS source FROM stations WHERE source = 'TRAX'""")
def road_feed(spark, sf):
    return parse_road(road_pages(spark, sf))


@query("SRC2_entities", f"""{WITH_STATIONS} SELECT station || ' Kraków – Wieś & Zażółć &amp; &unknown;' AS station,
    CAST(CAST({_WHOLE} AS VARCHAR) || '.' || CAST({_FRACTION} AS VARCHAR) AS DOUBLE) AS temp,
    CAST(station_id % 16 AS INT) AS region, 'TRAX' AS source FROM stations WHERE source = 'TRAX'""")
def road_feed_with_references(spark, sf):
    """Names written with character references: named, decimal and hexadecimal."""
    coded = " Krak&oacute;w &#8211;&nbsp;Wie&#x15B; &amp; Za&#380;&oacute;&#322;&#x107; &amp;amp; &unknown;"
    pages = road_pages(spark, sf).withColumn("html", F.replace("html", F.lit("</b>"), F.lit(coded + "</b>")))
    return parse_road(pages)


def crowd_payloads(spark, sf):
    """Nested records; some lack a location, some lie abroad, some modules are empty."""
    rows = stations(spark, sf).filter("source = 'NETATMO'")
    reading = f"concat(CAST({_WHOLE} AS STRING), '.', CAST({_FRACTION} AS STRING))"
    place = """CASE WHEN station_id % 9 = 0 THEN '' WHEN station_id % 10 = 3 THEN '"location":[3.5,50.5],'
        ELSE concat('"location":[', CAST(lon AS STRING), ',', CAST(lat AS STRING), '],') END"""
    city = "CASE WHEN station_id % 7 = 0 THEN '\"z\":1' ELSE concat('\"city\":\"', station, '\"') END"
    old, new = "'\"999\":[50,1.5]'", f"concat('\"1000\":[50,', {reading}, ']')"
    old2, new2 = "'\"999\":[1.5,50]'", f"concat('\"1000\":[', {reading}, ',50]')"
    res = f"""CASE WHEN station_id % 8 = 5 THEN '' WHEN station_id % 2 = 0 THEN concat({new}, ',', {old})
        ELSE concat({old2}, ',', {new2}) END"""
    types = """CASE WHEN station_id % 2 = 0 THEN '"humidity","temperature"' ELSE '"temperature","humidity"' END"""
    return rows.selectExpr(
        "station_id AS payload_id",
        f"""concat('{{"body":[{{"place":{{', {place}, {city},
        '}},"measures":{{"a":{{"type":["pressure"],"res":{{"1000":[1013]}}}},"b":{{"type":[', {types}, '],"res":{{', {res}, '}}}}}}}}]}}') AS payload""",
    )


_CROWD_SQL = f"""crowd0 AS (SELECT station_id, CASE WHEN station_id % 7 = 0 THEN 'Unknown' ELSE station END AS station,
    CAST(CAST({_WHOLE} AS VARCHAR) || '.' || CAST({_FRACTION} AS VARCHAR) AS DOUBLE) AS temp,
    CASE WHEN station_id % 10 = 3 THEN 50.5E0 ELSE lat END AS lat, CASE WHEN station_id % 10 = 3 THEN 3.5E0 ELSE lon END AS lon
    FROM stations WHERE source = 'NETATMO' AND station_id % 9 <> 0 AND station_id % 8 <> 5)"""
_CROWD_INSIDE = f"""{_CROWD_SQL}, {sql_metres('crowd0', 'crowd')}, {SQL_EDGES}"""


@query("SRC3", f"""{WITH_STATIONS}, {_CROWD_INSIDE} SELECT station, temp, lat, lon, 'NETATMO' AS source FROM crowd
    WHERE {sql_inside('crowd', 'station_id')}""")
def crowd_feed(spark, sf):
    rows = with_metres(parse_crowd(crowd_payloads(spark, sf)))
    return mark_inside(rows, ring_edges(spark)).filter("inside").select("station", "temp", "lat", "lon", "source")


@query("SRC4", f"""{WITH_STATIONS}, s AS (
    SELECT 'IMGW' AS feed, CASE station_id % 50 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'EMPTY' ELSE 'OK' END AS status FROM stations WHERE source = 'IMGW'
    UNION ALL SELECT 'NETATMO', 'OK' FROM stations WHERE source = 'NETATMO')
    SELECT feed, status, count(*) AS n_payloads, CAST(sum(CASE WHEN status = 'OK' THEN 1 ELSE 0 END) AS BIGINT) AS n_records FROM s GROUP BY feed, status""")
def feed_status(spark, sf):
    national = json_status(national_payloads(spark, sf), "payload", NATIONAL_JSON).withColumn("feed", F.lit("IMGW"))
    crowd = json_status(crowd_payloads(spark, sf), "payload", CROWD_JSON, "body").withColumn("feed", F.lit("NETATMO"))
    return national.unionByName(crowd, allowMissingColumns=True).groupBy("feed", "status").agg(
        F.count("*").alias("n_payloads"), F.sum("n_records").alias("n_records")
    )


@query("PRJ3", f"""{WITH_STATIONS} SELECT station_id, {_number()} AS temp_dot, {_number(True)} AS temp_strip FROM stations""")
def cleaned_temperatures(spark, sf):
    return raw_stations(spark, sf).select(
        "station_id", clean_temperature(F.col("text")).alias("temp_dot"),
        clean_temperature(F.col("text"), "strip").alias("temp_strip"),
    )


@query("PRJ4", f"{WITH_STATIONS} SELECT station_id, {_CLEAN_NAME} AS name FROM stations")
def cleaned_names(spark, sf):
    return raw_stations(spark, sf).select("station_id", clean_station_name(F.col("raw_name")).alias("name"))


@query("PRJ5", """SELECT c_custkey AS station_id, replace(c_name, 'Customer', 'Zazolc gesla jazn') ||
    CASE c_custkey % 3 WHEN 0 THEN ' Lodz' WHEN 1 THEN ' Gorlitz Trinec Kosice' ELSE ' Strasse AEro Oresund' END AS folded FROM customer""")
def folded_names(spark, sf):
    named = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("station_id"),
        F.concat(F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Zażółć gęślą jaźń")), F.element_at(
            F.array(F.lit(" Łódź"), F.lit(" Görlitz Třinec Košice"), F.lit(" Straße Æro Øresund")), (F.col("c_custkey") % 3 + 1).cast("int")
        )).alias("name"),
    )
    return named.select("station_id", ascii_fold(F.col("name")).alias("folded"))


@query("PRJ6", f"""{WITH_STATIONS} SELECT station_id, station, temp, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,
    'TRAX' AS source FROM stations WHERE source = 'TRAX'""")
def tagged_rows(spark, sf):
    rows = stations(spark, sf).filter("source = 'TRAX'").select("station_id", "station", "temp")
    return with_network(rows, "TRAX").select("station_id", "station", "temp", "lat", "lon", "source")


@query("FLT1", f"""{WITH_STATIONS}, {_NATIONAL_SQL}, f AS (SELECT * FROM national WHERE temp IS NOT NULL)
    SELECT 'all' AS mode, statId, isModel FROM f UNION ALL SELECT 'observations', statId, isModel FROM f WHERE isModel = false
    UNION ALL SELECT 'model', statId, isModel FROM f WHERE isModel = true""")
def data_modes(spark, sf):
    payloads = national_payloads(spark, sf)
    out = None
    for mode in ("all", "observations", "model"):
        rows = parse_national(payloads, mode=mode).select(F.lit(mode).alias("mode"), "statId", "isModel")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("FLT2", f"""{WITH_STATIONS} SELECT station_id, station_id % 4 <= 1 AS numeric FROM stations
    WHERE station_id % 13 <> 0 AND station_id % 11 <> 0
    UNION ALL SELECT station_id, false FROM stations WHERE station_id % 13 <> 0 AND station_id % 11 = 0
    UNION ALL SELECT station_id, NULL FROM stations WHERE station_id % 13 = 0""")
def numeric_texts(spark, sf):
    return raw_stations(spark, sf).select("station_id", is_numeric_text(F.col("text")).alias("numeric"))


@query("FLT3", f"""{WITH_STATIONS} SELECT station_id, {_number()} AS temp, lat FROM stations
    WHERE {_number()} IS NOT NULL AND station_id % 17 <> 0""")
def complete_rows(spark, sf):
    rows = raw_stations(spark, sf).select(
        "station_id", clean_temperature(F.col("text")).alias("temp"),
        F.when(F.col("station_id") % 17 != 0, F.col("lat")).alias("lat"),
    )
    return drop_incomplete(rows, ["temp", "lat"])


@query("FLT6", f"{WITH_STATIONS} SELECT station_id, source FROM stations WHERE source IN ('IMGW', 'NETATMO')")
def shown_stations(spark, sf):
    return display_stations(stations(spark, sf), ("IMGW", "NETATMO")).select("station_id", "source")


@query("FLT7", f"""{WITH_UNIQUE} SELECT count(*) AS n_rows, count(*) >= 50 AS enough_stations, count(*) >= 20 AS qc_applies FROM uniq""")
def size_gates(spark, sf):
    return gate_report(dedupe_locations(stations(spark, sf)), AnalysisConfig())


@query("FLT8", f"""{WITH_STATIONS} SELECT station_id, lat, lon FROM stations
    WHERE lat BETWEEN 50E0 AND 53.5E0 AND lon BETWEEN 16E0 AND 22.25E0""")
def boxed_stations(spark, sf):
    return within_box(stations(spark, sf), BoundingBox(50.0, 53.5, 16.0, 22.25)).select("station_id", "lat", "lon")


@query("SET1", f"""{WITH_STATIONS}, {_NATIONAL_SQL}, {_CROWD_SQL}
    SELECT station, temp, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, 'IMGW' AS source, isModel FROM national WHERE temp IS NOT NULL
    UNION ALL SELECT station, CAST(CAST({_WHOLE} AS VARCHAR) || '.' || CAST({_FRACTION} AS VARCHAR) AS DOUBLE), NULL, NULL, 'TRAX', NULL FROM stations WHERE source = 'TRAX'
    UNION ALL SELECT station, temp, lat, lon, 'NETATMO', NULL FROM crowd0""")
def united_feeds(spark, sf):
    return union_feeds(
        parse_national(national_payloads(spark, sf)), parse_road(road_pages(spark, sf)), parse_crowd(crowd_payloads(spark, sf))
    )


@query("AGG1", f"""{WITH_STATIONS} SELECT source, count(*) AS n_rows,
    CAST(sum(CASE WHEN isModel = false THEN 1 ELSE 0 END) AS BIGINT) AS n_observations,
    CAST(sum(CASE WHEN isModel = true THEN 1 ELSE 0 END) AS BIGINT) AS n_model FROM stations GROUP BY source""")
def source_counts(spark, sf):
    return count_by_source(stations(spark, sf))


@query("AGG18", f"{WITH_STATIONS} SELECT DISTINCT source FROM stations WHERE source IN ('IMGW', 'TRAX')")
def shown_sources(spark, sf):
    return distinct_sources(display_stations(stations(spark, sf), ("IMGW", "TRAX")))


@query("WIN8", f"{WITH_UNIQUE} SELECT station_id, station, source, lat, lon, round(temp, 6) AS temp FROM uniq")
def one_per_location(spark, sf):
    return dedupe_locations(stations(spark, sf)).select(
        "station_id", "station", "source", "lat", "lon", F.round("temp", 6).alias("temp")
    )


@query("WIN9", f"""{WITH_METRIC} SELECT station_id, cell_x, cell_y, station, source, round(temp, 6) AS temp FROM (
    SELECT *, CAST(trunc(lon / 0.25E0) AS INT) AS cell_x, CAST(trunc(lat / 0.25E0) AS INT) AS cell_y,
    row_number() OVER (PARTITION BY trunc(lon / 0.25E0), trunc(lat / 0.25E0) ORDER BY {SQL_PRIORITY}, station_id) AS rn FROM uniq) q WHERE rn = 1""")
def map_labels(spark, sf):
    return label_stations(dedupe_locations(stations(spark, sf)), 0.25).select(
        "station_id", "cell_x", "cell_y", "station", "source", F.round("temp", 6).alias("temp")
    )


@query("TOP1", f"{WITH_STATIONS} SELECT station_id, {SQL_PRIORITY} AS priority FROM stations")
def priority_order(spark, sf):
    return order_by_priority(stations(spark, sf)).select("station_id", source_priority().alias("priority"))


@query("readings_latest", "SELECT user_id AS station_id, max_by(value, ts) AS temp FROM events GROUP BY user_id")
def latest_reading(spark, sf):
    from stationgrid.streaming.landing import newest_reading

    readings = table(spark, sf, "events").select(F.col("user_id").alias("station_id"), "ts", F.col("value").alias("temp"))
    return newest_reading(readings).select("station_id", "temp")


@query("FLT1_flagless", "SELECT c_custkey AS station_id FROM customer")
def data_mode_without_flag(spark, sf):
    return filter_data_mode(table(spark, sf, "customer").select(F.col("c_custkey").alias("station_id")), "observations")
