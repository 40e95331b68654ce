"""Landed feed payloads to station rows.

Each parser takes a table of raw payloads (one row per downloaded document) and
uses only built-in JSON and regular-expression functions, so parsing is spread
over all payload files and works unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stationgrid.config import CROWD, NATIONAL, ROAD, BoundingBox
from stationgrid.functions.cleaning import clean_temperature, decode_entities, is_numeric_text, null_if_nan

NATIONAL_JSON = "ARRAY<STRUCT<statName: STRING, temp: STRING, statId: STRING, isModel: BOOLEAN>>"
CROWD_JSON = (
    "STRUCT<body: ARRAY<STRUCT<place: STRUCT<location: ARRAY<DOUBLE>, city: STRING>,"
    " measures: MAP<STRING, STRUCT<type: ARRAY<STRING>, res: MAP<STRING, ARRAY<DOUBLE>>>>>>>"
)
STATION_SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("isModel", T.BooleanType()),
    ]
)
HEADER_ROWS = 2
UNKNOWN_CITY = "Unknown"


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Landed payloads, or an empty table when the feed delivered nothing.

    A file that cannot be read does not stop the others (``landed_status`` names it); every
    other error, such as a missing permission or an unknown format, is raised.
    """
    try:
        return spark.read.schema(schema).format(fmt).option("ignoreCorruptFiles", "true").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def landed_status(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """``(file, n_rows, status)`` of every landed file: OK, or FAILED if no row of it can be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"))
    rows = read_landed(spark, path, schema, fmt).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"))
    counted = files.join(rows.groupBy("file").agg(F.count("*").alias("n_rows")), "file", "left")
    return counted.select("file", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("n_rows") > 0, "OK").otherwise("FAILED").alias("status"))


def parse_national(payloads: DataFrame, payload: str = "payload", mode: str = "all", comma: str = "dot") -> DataFrame:
    """JSON arrays of stations; ``mode`` keeps all rows, observations or model rows."""
    rows = payloads.select(
        *[c for c in payloads.columns if c != payload],
        F.inline(F.from_json(F.col(payload), NATIONAL_JSON)),
    )
    rows = filter_data_mode(rows, mode)
    return (
        rows.withColumn("temp", clean_temperature(F.col("temp"), comma))
        .withColumnRenamed("statName", "station")
        .withColumn("source", F.lit(NATIONAL))
        .na.drop(subset=["temp"])
    )


def filter_data_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Keep observations or model points; a table without the flag passes whole."""
    if mode == "all" or "isModel" not in rows.columns:
        return rows
    if mode not in ("observations", "model"):
        raise ValueError(f"unknown data mode {mode!r}")
    return rows.filter(F.col("isModel") == F.lit(mode == "model"))


def _cell_text(cell: Column) -> Column:
    text = F.regexp_replace(cell, r"(?s)<[^>]*>", "")
    return F.regexp_replace(F.replace(decode_entities(text), F.lit("\u00a0"), F.lit(" ")), r"^\s+|\s+$", "")


def parse_road(pages: DataFrame, html: str = "html", region: str = "region") -> DataFrame:
    """Table rows of each region's page: name in the first cell, temperature in the second."""
    rows = pages.select(
        F.col(region).alias("region"),
        F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b.*?</tr>"), 0)).alias("pos", "row_html"),
    ).filter(F.col("pos") >= HEADER_ROWS)
    cells = rows.withColumn(
        "cells", F.regexp_extract_all("row_html", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)
    ).filter(F.size("cells") >= 2)
    texts = cells.select(
        "region",
        _cell_text(F.get("cells", F.lit(0))).alias("station"),
        F.replace(_cell_text(F.get("cells", F.lit(1))), F.lit(","), F.lit(".")).alias("text"),
    )
    return texts.filter(is_numeric_text(F.col("text"))).select(
        "station", F.col("text").try_cast("double").alias("temp"), "region", F.lit(ROAD).alias("source")
    )


def parse_crowd(
    payloads: DataFrame,
    payload: str = "payload",
    bbox: BoundingBox | None = None,
    value_index: int | None = None,
) -> DataFrame:
    """Nested crowd records: the newest reading of the first module that has one.

    The reading sits at the index "temperature" has among the module's types;
    ``value_index=0`` always takes the first value instead.
    """
    body = payloads.select(F.explode(F.from_json(F.col(payload), CROWD_JSON)["body"]).alias("b"))
    located = body.filter(F.size("b.place.location") == 2).select(
        F.coalesce("b.place.city", F.lit(UNKNOWN_CITY)).alias("station"),
        F.get("b.place.location", F.lit(1)).alias("lat"),
        F.get("b.place.location", F.lit(0)).alias("lon"),
        F.get(
            F.filter(
                F.map_values("b.measures"),
                lambda m: F.array_contains(m["type"], "temperature") & (F.size(m["res"]) > 0),
            ),
            F.lit(0),
        ).alias("module"),
    )
    if bbox is not None:
        located = within_box(located, bbox)
    newest = F.array_max(
        F.transform(
            F.map_entries("module.res"),
            lambda e: F.struct(e["key"].try_cast("bigint").alias("ts"), e["value"].alias("readings")),
        )
    )
    index = F.lit(value_index) if value_index is not None else F.array_position("module.type", "temperature") - 1
    return (
        located.filter(F.col("module").isNotNull())
        .withColumn("newest", newest)
        .select(
            "station",
            null_if_nan(F.get("newest.readings", index.cast("int"))).alias("temp"),
            "lat",
            "lon",
            F.lit(CROWD).alias("source"),
        )
        .na.drop(subset=["temp"])
    )


def within_box(points: DataFrame, bbox: BoundingBox, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rectangular pre-filter; plain comparisons, so it reaches the Parquet scan."""
    return points.filter(
        F.col(lat).between(bbox.lat_min, bbox.lat_max) & F.col(lon).between(bbox.lon_min, bbox.lon_max)
    )


def json_status(payloads: DataFrame, payload: str, ddl: str, records: str | None = None) -> DataFrame:
    """One status per payload: FAILED (unreadable), EMPTY (no records) or OK."""
    parsed = F.from_json(F.col(payload), ddl)
    n = F.size(parsed if records is None else parsed[records])
    keep = [c for c in payloads.columns if c != payload]
    counted = payloads.select(*keep, F.coalesce(n, F.lit(-1)).alias("n_records"))
    status = F.when(F.col("n_records") < 0, "FAILED").when(F.col("n_records") == 0, "EMPTY").otherwise("OK")
    return counted.select(*keep, status.alias("status"), F.greatest("n_records", F.lit(0)).alias("n_records"))


def with_network(rows: DataFrame, source: str) -> DataFrame:
    """Tag rows with their network; coordinates not delivered become typed NULLs."""
    missing = {c: F.lit(None).cast("double") for c in ("lat", "lon") if c not in rows.columns}
    return rows.withColumns({**missing, "source": F.lit(source)})


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Stack feeds by column name; columns a feed lacks are NULL, extras are dropped."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    return stacked.select(
        *[
            (F.col(f.name) if f.name in stacked.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STATION_SCHEMA.fields
        ]
    )


def with_station_id(stations: DataFrame) -> DataFrame:
    """A stable BIGINT key from what identifies a station."""
    return stations.withColumn("station_id", F.xxhash64("source", "station", "lat", "lon"))


def count_by_source(stations: DataFrame) -> DataFrame:
    """Rows, observations and model points per network."""
    return stations.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("isModel")).alias("n_observations"),
        F.count_if(F.col("isModel")).alias("n_model"),
    )


def distinct_sources(stations: DataFrame) -> DataFrame:
    return stations.select("source").distinct()
