"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import materialised


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), sorted, and the smallest node each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], low)
        np.minimum.at(hooked, label[b], low)
        while not np.array_equal(hooked[hooked], hooked):
            hooked = hooked[hooked]
        if np.array_equal(hooked, label):
            return nodes, nodes[label]
        label = hooked


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        nodes, roots = smallest_reachable(*(np.concatenate(x) for x in zip(*held)))
        yield pa.record_batch({"node": nodes, "root": roots})


def _renamed(labels: DataFrame, to: DataFrame) -> DataFrame:
    """Labels with their roots replaced by the roots' own."""
    return materialised(
        labels.withColumnRenamed("root", "_root").join(to.withColumnsRenamed({"node": "_root", "root": "_next"}), "_root", "left")
        .select("node", F.coalesce("_next", "_root").alias("root"))
    )


def connected_components(edges: DataFrame, finish: int = 0) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of the edges (a, b).

    Each round every node hooks to its smallest neighbour, chains are halved by jumping, and the edges are
    rewritten to the roots found; only nodes smaller than all their neighbours remain, at most
    half of them, so rounds grow with the logarithm of the nodes. Hot nodes are aggregated before they move,
    and joins are plain equi-joins that skewed keys can be split in. Loops are ignored. Once at most ``finish``
    contracted links are left, one task labels these (nodes must be long), which spares the jobs of the last rounds.
    """
    loops = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node = other").select("node", F.col("node").alias("root"))
    left = materialised(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while links := left.count():
        if links <= finish:
            to = materialised(left.coalesce(1).mapInArrow(_finished, "node long, root long"))
            labels = to if labels is None else _renamed(labels, to)
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialised(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
            jumped = materialised(parents.join(above, "parent").select("node", F.col("_above").alias("parent"), (F.col("_above") != F.col("parent")).alias("_moved")))
            parents = jumped.drop("_moved")
            if not jumped.where("_moved").limit(1).count():
                break
        to = parents.select("node", F.col("parent").alias("root"))
        labels = to if labels is None else _renamed(labels, to)
        left = materialised(
            left.join(to.withColumnsRenamed({"node": "a", "root": "_a"}), "a").join(to.withColumnsRenamed({"node": "b", "root": "_b"}), "b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct()
        )
    if labels is None:
        return loops.distinct()
    return labels.unionByName(loops.distinct().join(labels, "node", "left_anti"))
