"""Raster bands, boundary polygons, geocode cache and colour classes as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationgrid.functions.crs import to_metres
from stationgrid.sinks.publish import newest_version

RASTER_SCHEMA = "r INT, c INT, value DOUBLE, band STRING"
CACHE_SCHEMA = "cache_key STRING, lat DOUBLE, lon DOUBLE"
COLOR_SCHEMA = "value INT, color STRING"
FALLBACK_COLOR_RANGE = (-40, 40)


@dataclass(frozen=True)
class RasterMeta:
    """Where a band's pixels lie: north-west corner, pixel steps and size."""

    band: str
    origin_x: float
    origin_y: float
    step_x: float
    step_y: float  # negative: rows run north to south
    height: int
    width: int
    nodata: float | None = None
    geographic: bool = True

    @property
    def right(self) -> float:
        return self.origin_x + self.step_x * self.width

    @property
    def bottom(self) -> float:
        return self.origin_y + self.step_y * self.height

    @property
    def pixel_size(self) -> float:
        return abs(self.step_x)


def read_bands(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """Pixels ``(band, r, c, value)``; ``band`` is the partition folder, so a band
    that is not asked for is never listed and a missing one is simply absent."""
    pixels = spark.read.schema(RASTER_SCHEMA).parquet(path)
    return pixels if bands is None else pixels.filter(F.col("band").isin(bands))


def boundary_edges(vertices: DataFrame, projected: bool = True) -> DataFrame:
    """Directed edges ``(ring_id, seq, x1, y1, x2, y2)`` of closed rings.

    Vertices carry consecutive ``seq`` values. The next vertex is found with an
    equi-join on ``(ring_id, seq)``, which spreads even one enormous ring.
    """
    if projected:
        x, y = to_metres("lon", "lat")
    else:
        x, y = F.col("lon"), F.col("lat")
    points = vertices.select("ring_id", "seq", x.alias("x"), y.alias("y"))
    following = points.select(
        "ring_id", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    return points.withColumnsRenamed({"x": "x1", "y": "y1"}).join(following, ["ring_id", "seq"])


def read_geocode_cache(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest, or the given, version of the cache; an empty table before the first write."""
    version = newest_version(spark, path) if version is None else version
    if version == 0:
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(f"{path}/version={version}")


def read_color_scale(spark: SparkSession, path: str) -> DataFrame:
    """Colour classes from CSV, sorted by value. A missing file gives no classes:
    callers then spread colours over ``FALLBACK_COLOR_RANGE``."""
    try:
        return spark.read.csv(path, header=True, schema=COLOR_SCHEMA).orderBy("value")
    except AnalysisException:
        return spark.createDataFrame([], COLOR_SCHEMA)


def parse_color_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Colour classes from landed CSV lines, with the bin number of each value."""
    parsed = lines.select(F.from_csv(F.col(line), COLOR_SCHEMA).alias("p")).select("p.value", "p.color")
    return parsed.na.drop().dropDuplicates(["value"]).orderBy("value")
