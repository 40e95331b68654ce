"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationgrid.session import cut_lineage, scratch_path

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Texts of one Arrow batch; Spark's default of 10,000 long ones takes too much memory on either side.
BATCH_TEXTS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send at most BATCH_TEXTS rows at a time to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_TEXTS:
        spark.conf.set(key, str(BATCH_TEXTS))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that other columns cannot clash; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """``fn`` turns each Arrow batch into a dict of columns; partitions are kept."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = fn(batch)
            if columns is not None and len(columns[names[0]]):
                yield _batch(columns, types)

    types = _arrow_types(schema)
    return df.mapInArrow(run, schema)


def _arrow_types(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def _batch(columns: dict, types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in types], schema=types)


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; a lost executor costs no recomputation."""
    return cut_lineage(df)


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder: smaller than a checkpoint, and read by column."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is hot; so there are at most as many hot keys as its inverse.
HOT_SHARE = 1 / 1000


def join_keys(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``table``: one row per key, with ``_n``, how many of the ``total`` rows have it.

    Hot keys, a bounded number, are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    hot = F.col("_n") > HOT_SHARE * total
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot), keys, how)
    return rows.join(few, keys).unionByName(rest).drop("_n")


def bounded_sample(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` documents, the smallest by hash of the id: the same ones on every run."""
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # a bounded number of ids, whatever the table
    return rows.join(F.broadcast(ids), "doc_id", "left_semi")
