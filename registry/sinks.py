"""Products written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import SQL_DEM, dem_pixels, r
from stationgrid.functions.cleaning import mask_nodata
from stationgrid.session import scratch_path
from stationgrid.sinks.products import TEMPERATURE, UNCERTAINTY, product_tags, read_product_set, write_product, write_product_set

_CELLS = "CAST(r // 256 AS INT) AS tile_row, CAST(c // 256 AS INT) AS tile_col, r, c"


def _field(spark, sf):
    return dem_pixels(spark, sf).select("r", "c", (mask_nodata(F.col("value"), -9999.0) / 100).alias("value"))


@query("SNK2", f"WITH {SQL_DEM} SELECT {_CELLS}, CAST(round(CAST(coalesce(v / 100, -9999E0) AS FLOAT), 3) AS DOUBLE) AS value FROM dem")
def product(spark, sf):
    path = scratch_path(spark, "product")
    write_product(_field(spark, sf), "value", path)
    back = spark.read.parquet(path)
    return back.select(
        F.col("tile_row").cast("int").alias("tile_row"), "tile_col", "r", "c", F.round("value", 3).cast("double").alias("value")
    )


@query("SNK3", f"""WITH {SQL_DEM} SELECT 'air_temperature' AS variable, 'degrees_celsius' AS units, 'EPSG2180' AS crs, 5000E0 AS resolution,
    round(min(v) / 100, 2) AS min_value, round(max(v) / 100, 2) AS max_value, round(avg(v / 100), 2) AS mean_value, count(v) AS valid_pixels, '0.700' AS test_rmse FROM dem""")
def tags(spark, sf):
    return product_tags(_field(spark, sf), "value", TEMPERATURE, 5000.0, "EPSG2180", {"test_rmse": "0.700"})


@query("SNK4", f"""WITH {SQL_DEM}, p AS (SELECT unnest(['air_temperature', 'prediction_uncertainty']) AS product), k AS (SELECT unnest(['EPSG2180', 'EPSG4326']) AS crs)
    SELECT product, crs, 'r1' AS run, count(*) AS n_cells, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_nodata,
      CAST(round(max(CAST(v / 100 AS FLOAT)), 2) AS DOUBLE) AS max_value FROM dem, p, k GROUP BY product, crs""")
def product_set(spark, sf):
    root = scratch_path(spark, "products")
    field = _field(spark, sf).persist()
    wanted = {(p, k): (field, s) for p in (TEMPERATURE, UNCERTAINTY) for k, s in (("EPSG2180", 5000.0), ("EPSG4326", 0.05))}
    write_product_set(wanted, root, "r1", {"test_rmse": "0.700"})
    back = read_product_set(spark, root, "r1")
    return back.groupBy("product", "crs", "run").agg(
        F.count("*").alias("n_cells"), F.count_if(F.col("value") == -9999.0).alias("n_nodata"),
        F.round(F.max("value"), 2).cast("double").alias("max_value"),
    )
