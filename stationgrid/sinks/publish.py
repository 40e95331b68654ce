"""Versions of a table that appear at once or not at all.

A version is written to a hidden folder beside its place and then renamed to ``version=N``. File systems with an atomic rename
let one of several writers of the same number win; the others get ``FileExistsError`` and nothing of the winner's is touched.
A failed job leaves a hidden folder that no reader looks at.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def newest_version(spark: SparkSession, path: str) -> int:
    """The highest published version below ``path``, 0 before the first one."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return 0
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max((int(m[1]) for m in (re.fullmatch(r"version=(\d+)", name) for name in names) if m), default=0)


def publish_version(df: DataFrame, path: str, version: int) -> None:
    """Write ``df`` as ``version``; ``FileExistsError`` if that version is there by the time it is complete."""
    spark = df.sparkSession
    staged, final = f"{path}/_staged-{uuid.uuid4().hex}", f"{path}/version={version}"
    df.write.parquet(staged)
    source, files = _folder(spark, staged)
    target, _ = _folder(spark, final)
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(source), files.makeQualified(target), no_overwrite)
    except Py4JJavaError as error:
        files.delete(source, True)
        if files.exists(target):
            raise FileExistsError(f"{final} was published by another writer") from error
        raise
