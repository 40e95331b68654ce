"""Geocode cache upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationgrid.sinks.publish import newest_version, publish_version
from stationgrid.sources.tables import read_geocode_cache


def merge_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing keys not in ``fresh``, plus all of ``fresh``."""
    columns = ["cache_key", "lat", "lon"]
    return cache.select(*columns).join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(
        fresh.select(*columns)
    )


def upsert_geocode_cache(spark: SparkSession, path: str, fresh: DataFrame) -> int:
    """Write the merged cache as a new version and return its number.

    Readers keep using the previous version until the new one is committed, so a
    lost executor or a failed job leaves the cache as it was. Of two writers that
    start from the same version one gets ``FileExistsError`` and may merge again; nothing is overwritten.
    """
    version = newest_version(spark, path) + 1
    publish_version(merge_cache(read_geocode_cache(spark, path, version - 1), fresh), path, version)
    return version
