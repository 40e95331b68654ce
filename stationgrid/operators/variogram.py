"""Experimental semivariogram and variogram model fit as Spark jobs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stationgrid.session import cut_lineage

BLOCK_ROWS = 1500
#: Rows of a block that meet the other block at a time, so that their pairs stay in the processor's cache.
TILE_ROWS = 8
#: Pairs of blocks one task takes; their work is far larger than their rows tell.
PAIRS_PER_TASK = 64
CANDIDATES = 64
#: A cell meets itself and these neighbours, so that each pair of cells is taken once.
FORWARD = ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))
_PAIR = ("cx", "cy", "block", "ox", "oy", "other")


@dataclass(frozen=True)
class Variogram:
    """A fitted model: ``nugget + psill * shape(h / range)``."""

    kind: str
    psill: float
    range: float
    nugget: float

    def gamma(self, h: np.ndarray) -> np.ndarray:
        u = h / self.range
        if self.kind == "exponential":
            shape = 1.0 - np.exp(-3.0 * u)
        else:
            shape = np.where(u <= 1.0, 1.5 * u - 0.5 * u**3, 1.0)
        return self.psill * shape + self.nugget


def _paired_blocks(points: DataFrame, value: str, reach: float, id_col: str, block_rows: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Points with every block pair they take part in: ``by..., x_pl, y_pl, z, own, side`` and the columns of :data:`_PAIR`, underscored.

    Cells have the side ``reach``, so pairs within it lie in one cell or two neighbours; a
    crowded cell is dealt into blocks by id, which bounds what one task holds.
    """
    cell = [F.floor(F.col(c) / reach).alias(n) for c, n in (("x_pl", "cx"), ("y_pl", "cy"))]
    # written once: points are read three times, and a filter on positions would be pushed below the steps that make them
    known = cut_lineage(points.select(*by, "x_pl", "y_pl", F.col(value).cast("double").alias("z"), F.xxhash64(id_col).alias("h")))
    rows = known.select("*", *cell).na.drop()
    cells = cut_lineage(rows.groupBy(*by, "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")))
    dealt = rows.join(cells, [*by, "cx", "cy"]).withColumn("block", F.pmod("h", F.col("blocks"))).drop("h", "blocks")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in FORWARD))).alias("step")
    there = cells.select(*by, "cx", "cy", "blocks", steps).select(
        *by, "cx", "cy", "blocks", (F.col("cx") + F.col("step.i")).alias("ox"), (F.col("cy") + F.col("step.j")).alias("oy")
    ).join(cells.select(*by, F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("blocks").alias("others")), [*by, "ox", "oy"])
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    pairs = there.withColumn("block", count(F.col("blocks"))).withColumn("other", count(F.col("others")))
    same = (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy"))
    pairs = pairs.filter(~same | (F.col("block") <= F.col("other"))).withColumn(
        "pair", F.struct(*by, "cx", "cy", "block", "ox", "oy", "other", (same & (F.col("block") == F.col("other"))).alias("own"))
    )
    tasks = math.ceil(pairs.count() / PAIRS_PER_TASK) or 1
    dealt = dealt.repartition(tasks, *by, "cx", "cy", "block")
    left = dealt.join(pairs.select(*by, "cx", "cy", "block", "pair"), [*by, "cx", "cy", "block"])
    right = dealt.join(
        pairs.filter(~same | (F.col("block") < F.col("other"))).select(
            *by, F.col("ox").alias("cx"), F.col("oy").alias("cy"), F.col("other").alias("block"), "pair"
        ), [*by, "cx", "cy", "block"],
    )
    columns = [*by, "x_pl", "y_pl", "z", "pair", F.col("pair.own").alias("own")]
    both = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side")))
    # plain columns only: a struct that names the pair would be sent and unpacked row by row
    flat = [F.col(f"pair.{c}").alias(f"_{c}") for c in _PAIR]
    return both.select(*by, *flat, "own", "x_pl", "y_pl", "z", "side").repartition(tasks, *by, *(f"_{c}" for c in _PAIR))


def _pair_sums(a: list[np.ndarray], b: list[np.ndarray], alone: bool, reach: float, width: float, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per lag the number, the summed distance and the summed half square difference of the pairs of two blocks ``[x, y, z]`` that ascend by x."""
    n, sum_d, sum_g = np.zeros(lags, dtype=np.int64), np.zeros(lags), np.zeros(lags)
    size = TILE_ROWS * len(b[0])
    room, spare, lag_room, far_room = np.empty(size), np.empty(size), np.empty(size, dtype=np.int64), np.empty(size, dtype=bool)
    for at in range(0, len(a[0]), TILE_ROWS):
        x, y, z = (v[at:at + TILE_ROWS, None] for v in a)
        # both sides ascend by x, so only a run of the others can be within reach
        first = at if alone else np.searchsorted(b[0], x[0, 0] - reach - 1.0)
        last = np.searchsorted(b[0], x[-1, 0] + reach + 1.0)
        shape = (len(x), max(last - first, 0))
        d, t, lag, far = (v[:shape[0] * shape[1]].reshape(shape) for v in (room, spare, lag_room, far_room))
        ox, oy, oz = (v[first:last] for v in b)
        np.subtract(x, ox, out=d)
        np.multiply(d, d, out=d)
        np.subtract(y, oy, out=t)
        np.multiply(t, t, out=t)
        np.sqrt(np.add(d, t, out=d), out=d)
        np.divide(d, width, out=t)
        np.copyto(lag, t, casting="unsafe")
        np.minimum(lag, lags - 1, out=lag)
        np.copyto(lag, lags, where=np.greater(d, reach, out=far))  # pairs that do not count
        if alone:
            lag[np.arange(shape[0])[:, None] >= np.arange(shape[1])] = lags
        np.subtract(z, oz, out=t)
        np.multiply(t, t, out=t)
        flat = lag.ravel()
        n += np.bincount(flat, minlength=lags + 1)[:lags]
        sum_d += np.bincount(flat, d.ravel(), lags + 1)[:lags]
        sum_g += np.bincount(flat, t.ravel(), lags + 1)[:lags]
    return n, sum_d, 0.5 * sum_g


def semivariogram(points: DataFrame, value: str, lags: int, reach: float, id_col: str = "station_id",
                  block_rows: int = BLOCK_ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., lag, n_pairs, distance, gamma)`` over ``lags`` equal bins of pair distance from 0 to ``reach`` metres.

    All points take part, in one pass; only per-bin sums leave a task. Points pair up with those of the same ``by`` keys, and each key has its bins.
    """
    width = reach / lags
    key_types = "".join(f"`{k}` {points.schema[k].dataType.simpleString()}, " for k in by)
    schema = f"{key_types}lag int, n bigint, sum_d double, sum_g double"
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def sums(block: pa.Table) -> pa.Table:
        side, x, y, z = (block.column(c).to_numpy() for c in ("side", "x_pl", "y_pl", "z"))
        order = np.argsort(x, kind="stable")
        side, xyz = side[order], [v[order] for v in (x, y, z)]
        a = [v[side == 0] for v in xyz]
        alone = bool(block.column("own")[0].as_py())  # a block with itself
        b = a if alone else [v[side == 1] for v in xyz]
        n, sum_d, sum_g = _pair_sums(a, b, alone, reach, width, lags)
        keys = [pa.repeat(block.column(k)[0], lags) for k in by]
        return pa.table([*keys, pa.array(np.arange(lags), pa.int32()), pa.array(n), pa.array(sum_d), pa.array(sum_g)], names=names)

    blocks = _paired_blocks(points, value, reach, id_col, block_rows, by)
    partial = blocks.groupBy(*by, *(f"_{c}" for c in _PAIR)).applyInArrow(sums, schema)
    total = partial.groupBy(*by, "lag").agg(F.sum("n").alias("n_pairs"), F.sum("sum_d").alias("d"), F.sum("sum_g").alias("g"))
    return total.filter("n_pairs > 0").select(
        *by, "lag", "n_pairs", (F.col("d") / F.col("n_pairs")).alias("distance"), (F.col("g") / F.col("n_pairs")).alias("gamma")
    )


def _shape(kind: str, h: Column, reach: Column) -> Column:
    u = h / reach
    if kind == "exponential":
        return 1.0 - F.exp(-3.0 * u)
    return F.when(u <= 1.0, 1.5 * u - 0.5 * u * u * u).otherwise(F.lit(1.0))


def _score(candidates: DataFrame, kind: str, by: tuple[str, ...]) -> DataFrame:
    """Best sill and nugget, and the soft-L1 loss, of each candidate range."""
    rows = candidates.select(*by, "reach", "max_d", "max_g", "lags", F.inline("lags"))
    rows = rows.withColumn("f", _shape(kind, F.col("distance"), F.col("reach")))
    f, g = F.col("f"), F.col("gamma")
    line = rows.groupBy(*by, "reach", "max_d", "max_g").agg(
        F.first("lags").alias("lags"),
        F.coalesce(F.regr_slope(g, f), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(g, f), F.avg(g)).alias("intercept"),
        F.sum(f * g).alias("fg"), F.sum(f).alias("sf"), F.sum(f * f).alias("ff"),
    )
    nugget = F.greatest(F.least("intercept", "max_g"), F.lit(0.0))
    free = F.when(nugget == F.col("intercept"), F.col("slope")).otherwise(
        F.coalesce(F.try_divide(F.col("fg") - nugget * F.col("sf"), F.col("ff")), F.lit(0.0))
    )
    psill = F.greatest(F.least(free, F.col("max_g") * 10.0), F.lit(0.0))
    sized = line.withColumns({"nugget": nugget, "psill": psill})
    again = sized.select("*", F.inline("lags"))
    miss = F.col("psill") * _shape(kind, F.col("distance"), F.col("reach")) + F.col("nugget") - F.col("gamma")
    return again.groupBy(*by, "reach", "psill", "nugget", "max_d", "max_g").agg(
        F.first("lags").alias("lags"), F.sum(2.0 * (F.sqrt(1.0 + miss * miss) - 1.0)).alias("loss")
    )


def fit_variogram(lags: DataFrame, kind: str, candidates: int = CANDIDATES, by: tuple[str, ...] = ()) -> DataFrame:
    """One row ``(by..., psill, range, nugget, loss)`` per key from ``(by..., lag, distance, gamma)`` rows.

    For a given range the other two parameters are a line fit, so only the range is
    searched: a grid over (0, largest lag], then one grid around the winner. All
    candidates are scored side by side by grouping.
    """
    one = lags.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("distance", "gamma"))).alias("lags"),
        F.max("distance").alias("max_d"), F.max("gamma").alias("max_g"),
    ).filter(F.col("max_d") > 0)
    coarse = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(candidates))).alias("i")).withColumn(
        "reach", F.col("max_d") * F.col("i") / candidates
    )
    best = _score(coarse, kind, by).groupBy(*by).agg(F.min(F.struct("loss", "reach", "max_d", "max_g", "lags")).alias("b")).select(*by, "b.*")
    half = candidates // 2
    fine = best.select(
        *by, F.col("reach").alias("centre"), "max_d", "max_g", "lags", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("j")
    ).withColumn("reach", F.col("centre") + F.col("max_d") / candidates * F.col("j") / half)
    fine = fine.filter((F.col("reach") > 0) & (F.col("reach") <= F.col("max_d")))
    winner = _score(fine, kind, by).groupBy(*by).agg(F.min(F.struct("loss", "reach", "psill", "nugget")).alias("w"))
    return winner.filter(F.col("w").isNotNull()).select(
        *by, "w.psill", F.col("w.reach").alias("range"), "w.nugget", "w.loss"
    )


def fitted_variogram(points: DataFrame, value: str, kind: str, lags: int, reach: float, id_col: str = "station_id") -> Variogram | None:
    """Fit and fetch the three parameters; None when there are too few points."""
    row = fit_variogram(semivariogram(points, value, lags, reach, id_col), kind).first()
    if row is None or row["range"] is None:
        return None
    return Variogram(kind, row["psill"], row["range"], row["nugget"])
