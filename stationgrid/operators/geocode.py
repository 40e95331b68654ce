"""Names to coordinates: cache lookup, then ordered gazetteer variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.functions.cleaning import ascii_fold, clean_station_name
from stationgrid.functions.crs import with_metres
from stationgrid.operators.boundary import mark_inside
from stationgrid.operators.sizes import broadcast_if_small

# --- fixed values -----------------------------------------------------------
DEFAULT_REGION = "PL"
COUNTRY_SUFFIX = ", Poland"
LOCAL_SUFFIX = " stacja meteo"
ENGLISH_SUFFIX = " weather station"
OK, NOT_FOUND, OUTSIDE = "OK", "NOT_FOUND", "OUT_OF_POLAND"
# ----------------------------------------------------------------------------


def cache_key(station: Column, province: Column | None = None) -> Column:
    region = F.lit(DEFAULT_REGION) if province is None else F.coalesce(province, F.lit(DEFAULT_REGION))
    return F.concat(clean_station_name(station), F.lit("|"), region)


def query_variants(name: Column, province: Column | None = None) -> Column:
    """The lookup texts in the order they are tried."""
    suffix = F.lit(COUNTRY_SUFFIX)
    if province is not None:
        suffix = F.concat(F.coalesce(F.concat(F.lit(", "), province), F.lit("")), suffix)
    plain = ascii_fold(name)
    return F.array(
        F.concat(name, suffix),
        F.concat(plain, suffix),
        F.concat(name, F.lit(LOCAL_SUFFIX), suffix),
        F.concat(plain, F.lit(ENGLISH_SUFFIX), suffix),
    )


def lookup_cached(stations: DataFrame, cache: DataFrame) -> DataFrame:
    """Fill missing coordinates from the cache.

    Only rows without coordinates take part in the join, so located rows do not
    pile up under a NULL key.
    """
    lacking = F.col("lat").isNull() | F.col("lon").isNull()
    known = broadcast_if_small(
        cache.select("cache_key", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    )
    filled = (
        stations.filter(lacking)
        .withColumn("cache_key", cache_key(F.col("station")))
        .join(known, "cache_key", "left")
        .withColumns({"lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon")})
        .select(*stations.columns)
    )
    return stations.filter(~lacking).unionByName(filled)


def resolve_names(names: DataFrame, gazetteer: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cache_key, lat, lon, status)`` for each distinct station name.

    The first variant the gazetteer knows decides; a hit outside the boundary is
    reported, not replaced by a later variant. Names are made distinct first, so
    a name shared by very many rows is looked up once.
    """
    distinct = names.select(clean_station_name(F.col("station")).alias("name")).distinct()
    tries = distinct.select("name", F.posexplode(query_variants(F.col("name"))).alias("pos", "query"))
    hits = tries.join(broadcast_if_small(gazetteer.select("query", "lat", "lon")), "query", "left")
    first = hits.groupBy("name").agg(
        F.min(F.when(F.col("lat").isNotNull(), F.struct("pos", "lat", "lon"))).alias("hit")
    )
    located = with_metres(first.select("name", "hit.lat", "hit.lon", "hit.pos"))
    marked = mark_inside(located, edges, point_id="name")
    status = F.when(F.col("lat").isNull(), NOT_FOUND).when(F.col("inside"), OK).otherwise(OUTSIDE)
    accepted = status == OK
    return marked.select(
        F.concat("name", F.lit("|" + DEFAULT_REGION)).alias("cache_key"),
        F.when(accepted, F.col("lat")).alias("lat"),
        F.when(accepted, F.col("lon")).alias("lon"),
        status.alias("status"),
    )


def locate_stations(stations: DataFrame, cache: DataFrame, gazetteer: DataFrame | None = None,
                    edges: DataFrame | None = None) -> DataFrame:
    """Cache, then gazetteer; rows that stay without coordinates are dropped."""
    located = lookup_cached(stations, cache)
    if gazetteer is not None:
        open_rows = located.filter(F.col("lat").isNull() | F.col("lon").isNull())
        fresh = resolve_names(open_rows, gazetteer, edges).filter(F.col("status") == OK)
        located = lookup_cached(located, fresh.drop("status"))
    return located.na.drop(subset=["lat", "lon"])
