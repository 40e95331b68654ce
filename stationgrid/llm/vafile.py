"""Exact top-k by a vector-approximation file.

Every component is cut to a cell of a few bits. For a query the inner product with any vector of a cell lies between two
bounds, which differ by an amount that depends on the query alone. The scan reads
the cells, in blocks of vectors against blocks of queries, and keeps a vector of a block if its upper bound
reaches the k-th best lower bound there; the k-th best over all blocks thins them once more. Exact vectors are
then read in the order of their upper bounds: the best few first, and after them those whose bound still reaches the k-th exact
score. Nothing that could be a result is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationgrid.llm.common import materialised
from stationgrid.llm.vectors import distinct_vectors, inner, ranked_results, valid_vectors

#: Vectors of a block and queries of a block; a block pair is one matrix product.
BASE_BLOCK, QUERY_BLOCK = 8192, 2048
MIN_BLOCKS = 12
CELL_BITS = 8
EXACT_FLOAT = float(1 << 53)


def block_candidates(cells: np.ndarray, queries: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, lower, upper) of one block pair: upper bounds that reach the k-th best lower bound."""
    above = np.maximum(queries, 0).sum(axis=1) * (width - 1)
    below = np.minimum(queries, 0).sum(axis=1) * (width - 1)
    biggest = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(cells).max(initial=0) + 1) * width
    if biggest < EXACT_FLOAT:
        at = (queries.astype(np.float64) @ cells.T.astype(np.float64)).astype(np.int64) * width
    else:
        at = (queries @ cells.T) * width
    k = min(k, cells.shape[0])
    kth = np.partition(at, at.shape[1] - k, axis=1)[:, at.shape[1] - k]
    q, v = np.nonzero(at + above[:, None] >= (kth + below)[:, None])
    return q, v, at[q, v] + below[q], at[q, v] + above[q]


def exact_top_k(table: DataFrame, k: int = 10, scale: float = 1024.0, every: int = 100, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of floor(scale * x), ties to smaller ids.

    Queries are the rows whose vec_id is divisible by ``every``; they search the rows of their own dimension. Null vectors and those with
    null or non-finite components take no part; an empty table gives no rows. Scores are 64-bit integers.
    """
    rows = valid_vectors(table, vector)
    whole = materialised(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")))
    base = materialised(distinct_vectors(whole, k + 1))
    queries = whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    sizes = base.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).first()
    # the cell width that leaves CELL_BITS signed bits of the largest component
    width = 1 << max(0, int(sizes["top"] or 0).bit_length() - (CELL_BITS - 1))
    blocks = max(MIN_BLOCKS, -(-sizes["n"] // BASE_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = base.select("uid", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x / width).cast("short")).alias("cell"), deal("uid", blocks).alias("block"))
    cells = cells.select("uid", "dim", "cell", "block", every_of(query_blocks).alias("part"))
    asked = queries.select("query_id", F.size("q").alias("dim"), "q", deal("query_id", query_blocks).alias("part")).select("query_id", "dim", "q", "part", every_of(blocks).alias("block"))
    out = pa.schema([("query_id", pa.int64()), ("uid", pa.int64()), ("lower", pa.int64()), ("upper", pa.int64())])

    def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).astype(np.int64).reshape(-1, dim)

    def scan(vectors: pa.Table, searched: pa.Table) -> pa.Table:
        if not vectors.num_rows or not searched.num_rows:
            return out.empty_table()
        dim = vectors.column("dim")[0].as_py()
        q, v, lower, upper = block_candidates(matrix(vectors.column("cell"), dim), matrix(searched.column("q"), dim), width, k + 1)
        return pa.table([np.asarray(searched.column("query_id"))[q], np.asarray(vectors.column("uid"))[v], lower, upper], schema=out)

    keys = ("dim", "block", "part")
    found = materialised(cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(scan, "query_id long, uid long, lower long, upper long"))
    # one more than k: the query's own vector may be among them
    by_lower = Window.partitionBy("query_id").orderBy(F.col("lower").desc(), "uid")
    floor = found.withColumn("_n", F.row_number().over(by_lower)).where(F.col("_n") <= k + 1).groupBy("query_id").agg(F.min("lower").alias("_low"), F.count("*").alias("_n"))
    reach = found.join(floor, "query_id").where((F.col("upper") >= F.col("_low")) | (F.col("_n") <= k))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "uid"))
    reach = materialised(reach.select("query_id", "uid", "upper", turn.alias("turn")))

    def read_exact(pairs: DataFrame) -> DataFrame:
        return pairs.join(base, "uid").join(queries, "query_id").select("query_id", "ids", inner("q", "v", "long").alias("score"))

    first = materialised(read_exact(reach.where(F.col("turn") <= 2 * (k + 1))))
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    certain = first.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= k + 1).groupBy("query_id").agg(F.min("score").alias("_kth"))
    rest = read_exact(reach.where(F.col("turn") > 2 * (k + 1)).join(certain, "query_id").where("upper >= _kth"))
    return ranked_results(first.unionByName(rest), k)


#: DuckDB SQL of the default call on ``embeddings``.
DIGEST_SQL = r"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
