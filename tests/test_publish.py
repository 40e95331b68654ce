import os
import threading

import pytest
from pyspark.sql import functions as F

from stationgrid.session import scratch_path
from stationgrid.sinks import geocache, products
from stationgrid.sinks.publish import newest_version, publish_version
from stationgrid.sources.tables import read_geocode_cache

KEYS = ("air_temperature", "prediction_uncertainty")


def place(spark, key, lat):
    return spark.createDataFrame([(key, lat, 20.0)], "cache_key string, lat double, lon double")


def field(spark, value):
    return spark.range(20).select((F.col("id") / 5).cast("int").alias("r"), (F.col("id") % 5).cast("int").alias("c"), F.lit(value).alias("value"))


def found(spark, root, run):
    rows = products.read_product_set(spark, root, run).select("product", "value", "crs", "run").distinct().collect()
    return {(r["product"], round(r["value"], 3)) for r in rows}


def test_taken_version_stays_as_it_is(spark):
    path = scratch_path(spark, "versions")
    assert newest_version(spark, path) == 0
    publish_version(spark.range(3), path, 1)
    with pytest.raises(FileExistsError):
        publish_version(spark.range(9), path, 1)
    assert spark.read.parquet(f"{path}/version=1").count() == 3
    assert os.listdir(path.removeprefix("file:")) == ["version=1"]


def test_empty_version_counts(spark):
    path = scratch_path(spark, "versions")
    assert geocache.upsert_geocode_cache(spark, path, place(spark, "a", 1.0).limit(0)) == 1
    assert geocache.upsert_geocode_cache(spark, path, place(spark, "a", 1.0)) == 2
    assert read_geocode_cache(spark, path).count() == 1


def test_of_two_upserts_from_one_version_one_wins(spark, monkeypatch):
    path = scratch_path(spark, "cache")
    geocache.upsert_geocode_cache(spark, path, place(spark, "old", 50.0))
    both, outcome = threading.Barrier(2), {}

    def together(session, where):
        version = newest_version(session, where)
        both.wait(60)
        return version

    def upsert(key):
        try:
            outcome[key] = geocache.upsert_geocode_cache(spark, path, place(spark, key, 51.0))
        except FileExistsError:
            outcome[key] = None

    with monkeypatch.context() as patched:
        patched.setattr(geocache, "newest_version", together)
        writers = [threading.Thread(target=upsert, args=(key,)) for key in "ab"]
        for writer in writers:
            writer.start()
        for writer in writers:
            writer.join(120)
    assert sorted(outcome.values(), key=str) == [2, None]
    (won,) = (key for key, version in outcome.items() if version)
    assert {row.cache_key for row in read_geocode_cache(spark, path).collect()} == {"old", won}
    (lost,) = set("ab") - {won}
    assert geocache.upsert_geocode_cache(spark, path, place(spark, lost, 51.0)) == 3
    assert {row.cache_key for row in read_geocode_cache(spark, path).collect()} == {"old", "a", "b"}


def test_products_appear_together_or_not_at_all(spark):
    root = scratch_path(spark, "products")
    good = {(key, "EPSG2180"): (field(spark, 1.5), 5000.0) for key in KEYS}
    broken = {**good, (KEYS[1], "EPSG2180"): (field(spark, 2.5).withColumn("value", F.raise_error(F.lit("lost")).cast("double")), 5000.0)}
    assert products.published_products(spark, root).count() == 0
    with pytest.raises(Exception, match="lost"):
        products.write_product_set(broken, root, "r1")
    with pytest.raises(FileNotFoundError):
        products.read_product_set(spark, root, "r1")
    products.write_product_set(good, root, "r1")
    assert found(spark, root, "r1") == {(key, 1.5) for key in KEYS}
    with pytest.raises(Exception, match="lost"):
        products.write_product_set({(KEYS[0], "EPSG2180"): (field(spark, 9.0), 5000.0), **{k: v for k, v in broken.items() if k[0] == KEYS[1]}}, root, "r1")
    assert found(spark, root, "r1") == {(key, 1.5) for key in KEYS}
    products.write_product_set({(key, "EPSG2180"): (field(spark, 3.5), 5000.0) for key in KEYS}, root, "r1")
    products.write_product_set(good, root, "r2")
    assert found(spark, root, "r1") == {(key, 3.5) for key in KEYS}
    assert found(spark, root, "r2") == {(key, 1.5) for key in KEYS}
    assert products.published_products(spark, root).count() == 4
