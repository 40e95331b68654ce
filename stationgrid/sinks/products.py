"""Tiled grid products and their tags."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationgrid.config import GRID_NODATA, TILE_PIXELS
from stationgrid.operators.evaluate import field_stats
from stationgrid.sinks.publish import newest_version, publish_version

# --- fixed values: tag texts ---------------------------------------------------
UNITS = "degrees_celsius"
TEMPERATURE, UNCERTAINTY = "air_temperature", "prediction_uncertainty"
# -------------------------------------------------------------------------------


def product_cells(cells: DataFrame, value: str, nodata: float = GRID_NODATA) -> DataFrame:
    """``(tile_row, tile_col, r, c, value)`` as FLOAT with the nodata value for NULL."""
    return cells.select(
        F.expr(f"CAST(r DIV {TILE_PIXELS} AS INT)").alias("tile_row"),
        F.expr(f"CAST(c DIV {TILE_PIXELS} AS INT)").alias("tile_col"),
        "r", "c", F.coalesce(F.col(value), F.lit(nodata)).cast("float").alias("value"),
    )


def write_product(cells: DataFrame, value: str, path: str) -> None:
    """Write one product, a folder per tile row.

    Range partitioning by tile keeps each tile in few files whatever the grid's
    size; within a file tiles are sorted, so a tile read skips row groups.
    """
    tiled = product_cells(cells, value)
    (
        tiled.repartitionByRange("tile_row", "tile_col")
        .sortWithinPartitions("tile_row", "tile_col", "r", "c")
        .write.mode("overwrite").partitionBy("tile_row").parquet(path)
    )


def product_tags(cells: DataFrame, value: str, variable: str, resolution: float, crs: str,
                 extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row of descriptive tags computed from the field."""
    stats = field_stats(cells, value)
    tags = stats.select(
        F.lit(variable).alias("variable"), F.lit(UNITS).alias("units"), F.lit(crs).alias("crs"),
        F.lit(float(resolution)).alias("resolution"),
        F.round("min_value", 2).alias("min_value"), F.round("max_value", 2).alias("max_value"),
        F.round("mean_value", 2).alias("mean_value"), "valid_pixels",
    )
    return tags.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})


def write_tags(tags: DataFrame, path: str) -> None:
    tags.withColumn("created", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


MANIFEST_COLUMNS = ("product", "crs", "run", "data", "tags")
MANIFEST_SCHEMA = ", ".join(f"{name} STRING" for name in MANIFEST_COLUMNS)


def write_product_set(products: Mapping[tuple[str, str], tuple[DataFrame, float]], root: str, run: str,
                      extra: Mapping[str, str] | None = None) -> list[str]:
    """Write every ``(product, crs) -> (cells, resolution)``, then publish them together in one manifest.

    Files go under ``product=/crs=/run=/attempt=``. Readers follow manifests, so they see all products of a run or none,
    and a run that is written again replaces the earlier one when its own manifest appears.
    """
    root, attempt, listed = root.rstrip("/"), uuid.uuid4().hex, []
    for (product, crs), (cells, resolution) in products.items():
        place = f"product={product}/crs={crs}/run={run}/attempt={attempt}"
        where, tagged = f"{root}/data/{place}", f"{root}/tags/{place}"
        cells = cells.persist()  # read for the files and again for their tags
        try:
            write_product(cells, "value", where)
            write_tags(product_tags(cells, "value", product, resolution, crs, extra), tagged)
        finally:
            cells.unpersist()
        listed.append((product, crs, run, where, tagged))
    if listed:
        spark = cells.sparkSession
        _publish_manifest(spark.createDataFrame(listed, MANIFEST_SCHEMA).coalesce(1), f"{root}/manifests")
    return [data for *_, data, _ in listed]


def _publish_manifest(manifest: DataFrame, path: str) -> None:
    """Append a manifest; where another writer took the number, the next one does as well."""
    while True:
        try:
            return publish_version(manifest, path, newest_version(manifest.sparkSession, path) + 1)
        except FileExistsError:
            continue


def published_products(spark: SparkSession, root: str) -> DataFrame:
    """``(product, crs, run, data, tags)`` of the newest manifest of every run; empty before the first one."""
    path = f"{root.rstrip('/')}/manifests"
    if not newest_version(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    manifests = spark.read.schema(f"{MANIFEST_SCHEMA}, version INT").parquet(path)
    newest = manifests.groupBy("run").agg(F.max("version").alias("version"))
    return manifests.join(newest, ["run", "version"]).select(*MANIFEST_COLUMNS)


def read_product_set(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Cells of all products of a published run, with ``product``, ``crs``, ``run``; ``FileNotFoundError`` if it has no manifest."""
    listed = published_products(spark, root).filter(F.col("run") == run).collect()  # one row per product
    if not listed:
        raise FileNotFoundError(f"no published run {run} below {root}")
    base = f"{root.rstrip('/')}/data"
    return spark.read.option("basePath", base).parquet(*[row["data"] for row in listed]).drop("attempt")
