"""Export of an analysis, and the whole name-to-place step."""

from pyspark.sql import functions as F

from registry.fixtures import ring_edges
from stationgrid.operators.features import FeatureModel
from stationgrid.operators.geocode import locate_stations
from stationgrid.operators.grid import GridSpec, grid_cells
from stationgrid.plans.analysis import Analysis, export
from stationgrid.session import scratch_path


def test_export_writes_four_tagged_products(spark):
    spec = GridSpec(400_000.0, 400_000.0, 500_000.0, 480_000.0, 10_000.0)
    field = grid_cells(spark, spec).select(
        "r", "c", (F.col("x") / 1e5).alias("temperature"), F.when(F.col("c") > 0, F.lit(0.5)).alias("uncertainty")
    )
    scores = spark.createDataFrame([("RMSE", 0.7), ("MAE", 0.5), ("R²", 0.9)], "metric string, new double")
    analysis = Analysis(field, None, FeatureModel(()), None, scores, None, None, None, None, spec)
    root = scratch_path(spark, "export")
    assert len(export(analysis, root, "r1", step_deg=0.2)) == 4
    cells = spark.read.parquet(f"{root}/data")
    counts = {(r["product"], r["crs"]): (r["n"], r["empty"]) for r in cells.groupBy("product", "crs").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") == -9999).alias("empty")).collect()}
    assert set(counts) == {(p, k) for p in ("air_temperature", "prediction_uncertainty") for k in ("EPSG2180", "EPSG4326")}
    assert counts[("air_temperature", "EPSG2180")] == (80, 0) and counts[("prediction_uncertainty", "EPSG2180")] == (80, 8)
    tags = {(r["variable"], r["crs"]): r for r in spark.read.json(f"{root}/tags").collect()}
    assert tags[("air_temperature", "EPSG2180")]["test_rmse"] == "0.700"
    assert tags[("air_temperature", "EPSG2180")]["max_value"] == 4.9
    assert 4.0 <= tags[("air_temperature", "EPSG4326")]["min_value"] <= tags[("air_temperature", "EPSG4326")]["max_value"] <= 4.9


def test_names_become_places(spark):
    stations = spark.createDataFrame(
        [(1, "Opole max", None), (2, "Łódź", None), (3, "Paris", None), (4, "Nowhere", None), (5, "Known", 50.0)],
        "station_id int, station string, lat double",
    ).withColumn("lon", F.when(F.col("lat").isNotNull(), F.lit(20.0)))
    cache = spark.createDataFrame([("Opole|PL", 50.7, 17.9)], "cache_key string, lat double, lon double")
    gazetteer = spark.createDataFrame(
        [("Lodz, Poland", 51.8, 19.5), ("Łódź stacja meteo, Poland", 50.0, 20.0), ("Paris, Poland", 48.8, 2.3)],
        "query string, lat double, lon double",
    )
    got = {r["station_id"]: (r["lat"], r["lon"]) for r in locate_stations(stations, cache, gazetteer, ring_edges(spark)).collect()}
    assert got == {1: (50.7, 17.9), 2: (51.8, 19.5), 5: (50.0, 20.0)}
