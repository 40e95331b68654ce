"""Vector tables: valid rows, one row per distinct vector, exact scores of named pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, vector: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id, v (array<double>) of the rows whose vector is neither null nor empty and holds finite numbers only.

    Of rows with the same vec_id one counts, the one with the smallest vector; a null vec_id takes no part.
    ``zero=False`` leaves zero vectors out.
    """
    v = F.col(vector).cast("array<double>")
    rows = table.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """uid (smallest id), ids (the ``ids`` smallest, ascending), v: one row per distinct vector.

    Only so many ids of equal vectors can ever be among as many results, ties going to smaller ids. The
    rank limit is taken in every task before the shuffle, so very many copies of a vector never meet.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_rank") <= ids)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "ids", "v")


def inner(a: str, b: str, kind: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast(kind), lambda s, x: s + x)


def ranked_results(scored: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best ids of (query_id, ids, score), the query's own left out."""
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
