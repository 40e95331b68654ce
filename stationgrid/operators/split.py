"""Buffered hold-out split and seeded bags.

Rows are ordered by a seeded md5 of their key. The cut is an exact order statistic
of that number (see ``functions.stats``), so no task ever ranks the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stationgrid.config import AnalysisConfig
from stationgrid.functions.hashing import key_number
from stationgrid.functions.stats import value_at_rank, values_at_ranks
from stationgrid.operators.proximity import remove_buffered
from stationgrid.session import cut_lineage


def _first_by_hash(rows: DataFrame, n: int, seed: int, id_col: str):
    """Condition selecting the ``n`` rows with the smallest key number."""
    number = key_number(F.col(id_col), seed)
    if n <= 0:
        return F.lit(False)
    cut = value_at_rank(rows.select(number.alias("h")), "h", n - 1)
    return F.lit(True) if cut is None else number <= F.lit(cut)


def split_stations(stations: DataFrame, config: AnalysisConfig, id_col: str = "station_id",
                   allow_empty: bool = False) -> DataFrame:
    """``(id, part)`` with part in train, val, test, buffer.

    Test rows are never trimmed; rows within the buffer of the test set, and train
    rows within the buffer of the validation set, are set aside as ``buffer``.
    """
    rows = stations.select(id_col, "x_pl", "y_pl").persist()
    n = rows.count()
    is_test = _first_by_hash(rows, math.ceil(n * config.test_size), config.split_seed, id_col)
    test = rows.filter(is_test)
    rest = remove_buffered(test, rows.filter(~is_test), config.buffer_km, id_col).persist()
    n_rest = rest.count()
    share = config.val_size / (1.0 - config.test_size)
    is_val = _first_by_hash(rest, math.ceil(n_rest * share), config.split_seed, id_col)
    val = rest.filter(is_val)
    train = remove_buffered(val, rest.filter(~is_val), config.buffer_km, id_col)
    tagged = (
        test.select(id_col, F.lit("test").alias("part"))
        .unionByName(val.select(id_col, F.lit("val").alias("part")))
        .unionByName(train.select(id_col, F.lit("train").alias("part")))
    )
    parts = cut_lineage(rows.select(id_col).join(tagged, id_col, "left").withColumn("part", F.coalesce("part", F.lit("buffer"))))
    for held in (rest, rows):
        held.unpersist()
    if not allow_empty:
        found = {r["part"] for r in parts.select("part").distinct().collect()}
        missing = {"train", "val", "test"} - found
        if missing:
            raise ValueError(f"split left no rows in {sorted(missing)}; the buffer is too wide for this density")
    return parts


def bags(rows: DataFrame, seeds: Sequence[int], fraction: float, id_col: str = "station_id") -> DataFrame:
    """One copy of a ``fraction`` sample without replacement per seed, tagged ``seed``."""
    size = round(fraction * rows.count())
    keys = rows.select(id_col, *[key_number(F.col(id_col), s).alias(f"_h{i}") for i, s in enumerate(seeds)])
    # the cuts of all seeds are found in the same passes
    cuts = values_at_ranks(keys, {f"_h{i}": size - 1 for i in range(len(seeds))}) if size > 0 else {}
    chosen = [
        F.when(F.lit(size > 0) & (F.lit(cuts.get(f"_h{i}")).isNull() | (F.col(f"_h{i}") <= F.lit(cuts.get(f"_h{i}")))), F.lit(s))
        for i, s in enumerate(seeds)
    ]
    members = keys.select(id_col, F.explode(F.filter(F.array(*chosen), lambda s: s.isNotNull())).alias("seed"))
    return rows.join(members, id_col)


def bag(rows: DataFrame, seed: int, fraction: float, id_col: str = "station_id", n: int | None = None) -> DataFrame:
    """The bag of one seed, as a filter: nothing is shuffled."""
    n = rows.count() if n is None else n
    return rows.filter(_first_by_hash(rows, round(fraction * n), seed, id_col))
