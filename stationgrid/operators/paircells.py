"""Semivariogram by pairs of cells: most pairs of points are never formed.

Points fall into a tree of square cells that stores counts and moments. Two cells whose nearest and farthest distance lie in one lag add all
their pairs at once: the count is a product, the sum of squared differences follows from sums and sums of squares, and both
are exact. Only pairs of cells that straddle a border of a lag are opened into their children, level by level, down to cells of a few points. So the
work follows the borders between lags, which grows more slowly than the number of pairs. Cells of up to ``BLOCK_POINTS`` points are opened where
a pair of them meets, in memory: only points and sums are shuffled, never the small cells' pairs.

The sum of distances of two whole cells comes from their second moments. Its error per pair is below ``tolerance`` metres, or the cells are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stationgrid.session import cut_lineage

LEAF_POINTS = 6
MAX_DEPTH = 24
#: Points of a cell that is opened in memory.
BLOCK_POINTS = 1500
#: Pairs of points or cells that are held at a time.
HELD_PAIRS = 500_000
#: Metres by which a distance may be off before a pair of cells counts as touching the border of a lag.
SLACK = 1e-6
_MOMENTS = ("n", "mx", "my", "vxx", "vyy", "vxy", "x0", "x1", "y0", "y1", "sz", "szz")


def _cells(points: DataFrame, by: list[str], level: int, reach: float) -> DataFrame:
    side = reach / 2**level
    cell = [F.floor(F.col(c) / side).alias(k) for c, k in (("x", "cx"), ("y", "cy"))]
    return points.groupBy(*by, *cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vxx"), F.var_pop("y").alias("vyy"),
        F.covar_pop("x", "y").alias("vxy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"),
    )


def _side(cells: DataFrame, by: list[str], name: str) -> DataFrame:
    return cells.select(*by, F.col("cx").alias(f"{name}cx"), F.col("cy").alias(f"{name}cy"), *(F.col(m).alias(f"{name}{m}") for m in _MOMENTS))


def _judged(pairs: DataFrame, reach: float, lags: int, tolerance: float) -> DataFrame:
    """Pairs of cells within reach with ``whole``, whether they count as one, and their sums."""
    width = reach / lags
    gap = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.col(b0) - F.col(a1), F.col(a0) - F.col(b1))
    span = lambda a0, a1, b0, b1: F.greatest(F.col(a1) - F.col(b0), F.col(b1) - F.col(a0))
    box = lambda f: F.hypot(f("ax0", "ax1", "bx0", "bx1"), f("ay0", "ay1", "by0", "by1"))
    near, far = F.col("near"), F.col("far")
    near_lag, far_lag = F.floor((near - SLACK) / width), F.floor((far + SLACK) / width)
    same = (F.col("acx") == F.col("bcx")) & (F.col("acy") == F.col("bcy"))
    spread = F.hypot(F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0")) + F.hypot(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))
    # remainder of the second-order expansion of the distance around the centres
    third = F.coalesce(F.try_divide(F.lit(0.2) * spread * spread * spread, near * near), F.lit(float("inf")))
    half = (far - near) / 2
    dx, dy = F.col("bmx") - F.col("amx"), F.col("bmy") - F.col("amy")
    d = F.hypot(dx, dy)
    vxx, vyy, vxy = (F.col(f"a{v}") + F.col(f"b{v}") for v in ("vxx", "vyy", "vxy"))
    expanded = d + F.try_divide(vxx * dy * dy + vyy * dx * dx - 2 * vxy * dx * dy, 2 * d * d * d)
    mean = F.when(~F.col("same") & (third <= half), expanded).otherwise((near + far) / 2)
    count = F.when(F.col("same"), F.col("an") * (F.col("an") - 1) / 2).otherwise(F.col("an") * F.col("bn")).cast("long")
    gamma = F.when(F.col("same"), (F.col("an") * F.col("aszz") - F.col("asz") * F.col("asz")) / 2).otherwise(
        (F.col("bn") * F.col("aszz") + F.col("an") * F.col("bszz") - 2 * F.col("asz") * F.col("bsz")) / 2
    )
    one_lag = (F.greatest(near_lag, F.lit(0)) == far_lag) & (far + SLACK <= reach)
    exact_enough = (half <= tolerance) | (~F.col("same") & (third <= tolerance))
    return pairs.withColumns({"near": box(gap), "far": box(span), "same": same}).filter(near <= reach).withColumns({
        "whole": one_lag & exact_enough, "lag": far_lag.cast("int"), "pairs": count, "sum_d": count * mean, "sum_g": gamma,
    })


def _small_cells(points: np.ndarray, parent: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """``points`` (x, y, z) and their ``parent`` cells' cells of that side: the points in order of cells, the cell of each, and the cells."""
    cx, cy = (np.floor(points[:, i] / side).astype(np.int64) for i in (0, 1))
    order = np.lexsort((cy, cx, parent))
    points, parent, cx, cy = points[order], parent[order], cx[order], cy[order]
    new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
    first = np.flatnonzero(new)
    n = np.diff([*first, len(points)])
    cell = np.repeat(np.arange(len(first)), n)
    x, y, z = points.T
    mean = lambda v: np.add.reduceat(v, first) / n
    mx, my = mean(x), mean(y)
    dx, dy = x - mx[cell], y - my[cell]
    cells = {
        "parent": parent[first], "first": first, "n": n, "mx": mx, "my": my, "vxx": mean(dx * dx), "vyy": mean(dy * dy), "vxy": mean(dx * dy),
        "x0": np.minimum.reduceat(x, first), "x1": np.maximum.reduceat(x, first), "y0": np.minimum.reduceat(y, first), "y1": np.maximum.reduceat(y, first),
        "sz": np.add.reduceat(z, first), "szz": np.add.reduceat(z * z, first),
    }
    return points, cell, cells


def _judged_small(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: np.ndarray, reach: float, lags: int, tolerance: float) -> tuple[np.ndarray, ...]:
    """What ``_judged`` says of pairs of cells: within reach, whole, lag, pairs, sum_d, sum_g."""
    width = reach / lags
    near = np.hypot(*(np.maximum(0.0, np.maximum(b[f"{c}0"] - a[f"{c}1"], a[f"{c}0"] - b[f"{c}1"])) for c in "xy"))
    far = np.hypot(*(np.maximum(a[f"{c}1"] - b[f"{c}0"], b[f"{c}1"] - a[f"{c}0"]) for c in "xy"))
    near_lag, far_lag = (np.floor(v / width).astype(np.int64) for v in (near - SLACK, far + SLACK))
    spread = sum(np.hypot(v["x1"] - v["x0"], v["y1"] - v["y0"]) for v in (a, b))
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    d = np.hypot(dx, dy)
    vxx, vyy, vxy = (a[v] + b[v] for v in ("vxx", "vyy", "vxy"))
    with np.errstate(divide="ignore", invalid="ignore"):
        third = np.where(near > 0, 0.2 * spread**3 / near**2, np.inf)
        expanded = d + (vxx * dy * dy + vyy * dx * dx - 2 * vxy * dx * dy) / (2 * d**3)
    half = (far - near) / 2
    mean = np.where(~same & (third <= half) & (d > 0), expanded, (near + far) / 2)
    count = np.where(same, a["n"] * (a["n"] - 1) // 2, a["n"] * b["n"])
    gamma = np.where(same, a["n"] * a["szz"] - a["sz"] ** 2, b["n"] * a["szz"] + a["n"] * b["szz"] - 2 * a["sz"] * b["sz"]) / 2
    whole = (np.maximum(near_lag, 0) == far_lag) & (far + SLACK <= reach) & ((half <= tolerance) | (~same & (third <= tolerance)))
    return near <= reach, whole, far_lag, count, count * mean, gamma


def _descended(one: np.ndarray, other: np.ndarray, alone: bool, level: int, reach: float, lags: int, tolerance: float, leaf_points: int) -> np.ndarray:
    """Sums ``(pairs, sum_d, sum_g, formed)`` by lag of two cells' points, opened level by level in memory."""
    width, total = reach / lags, np.zeros((4, lags))

    def add(lag: np.ndarray, pairs: np.ndarray | None, d: np.ndarray, g: np.ndarray) -> None:
        n = np.bincount(lag, pairs, lags)[:lags]
        total[:] += [n, np.bincount(lag, d, lags)[:lags], np.bincount(lag, g, lags)[:lags], n if pairs is None else np.zeros(lags)]

    def formed(p: np.ndarray, q: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: np.ndarray) -> None:
        many = a["n"] * b["n"]
        which = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        i, j = at // b["n"][which], at % b["n"][which]
        once = ~same[which] | (i < j)
        i, j = (a["first"][which] + i)[once], (b["first"][which] + j)[once]
        dx, dy, dz = (p[i] - q[j]).T
        d = np.sqrt(dx * dx + dy * dy)
        near = d <= reach
        add(np.minimum((d[near] / width).astype(np.int64), lags - 1), None, d[near], dz[near] ** 2 / 2)

    def chunks(weight: np.ndarray) -> list[np.ndarray]:
        """Positions in runs whose weights add up to about HELD_PAIRS."""
        run = (np.cumsum(weight) - weight) // HELD_PAIRS
        return np.split(np.arange(len(weight)), np.flatnonzero(np.diff(run)) + 1) if len(weight) else []

    p, pc, a = _small_cells(one, np.zeros(len(one), np.int64), reach / 2**level)
    q, qc, b = (p, pc, a) if alone else _small_cells(other, np.zeros(len(other), np.int64), reach / 2**level)
    i = j = np.zeros(1, np.int64)
    while len(i):
        left = []
        for part in chunks(np.ones(len(i), np.int64)):
            x, y = i[part], j[part]
            same = (x == y) & alone
            va, vb = ({k: v[z] for k, v in cells.items()} for cells, z in ((a, x), (b, y)))
            near, whole, lag, pairs, sum_d, sum_g = _judged_small(va, vb, same, reach, lags, tolerance)
            done = near & whole
            add(lag[done], pairs[done], sum_d[done], sum_g[done])
            small = (va["n"] <= leaf_points) & (vb["n"] <= leaf_points) if level < MAX_DEPTH else np.ones(len(x), dtype=bool)
            leaf = np.flatnonzero(near & ~whole & small)
            for run in chunks(va["n"][leaf] * vb["n"][leaf]):
                at = leaf[run]
                formed(p, q, *({k: v[at] for k, v in cells.items()} for cells in (va, vb)), same[at])
            left.append(part[near & ~whole & ~small])
        rest = np.concatenate(left)
        i, j, level = i[rest], j[rest], level + 1
        if not len(i):
            break
        p, pc, a = _small_cells(p, pc, reach / 2**level)
        q, qc, b = (p, pc, a) if alone else _small_cells(q, qc, reach / 2**level)
        # the children of a cell stand together, in order of their parents
        (ai, an), (bi, bn) = ((np.searchsorted(c["parent"], v), np.searchsorted(c["parent"], v, "right") - np.searchsorted(c["parent"], v)) for c, v in ((a, i), (b, j)))
        many = an * bn
        which = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        own = ((i == j) & alone)[which]
        i, j = ai[which] + at // bn[which], bi[which] + at % bn[which]
        once = ~own | (i <= j)
        i, j = i[once], j[once]
    return total


def _opened(points: DataFrame, pairs: DataFrame, by: list[str], level: int, reach: float, lags: int, tolerance: float, leaf_points: int) -> DataFrame:
    """Sums of the pairs of points of two cells that fit into memory."""
    side = reach / 2**level
    held = points.groupBy(*by, F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).agg(F.collect_list(F.struct("x", "y", "z")).alias("p"))
    left, right = (held.select(*by, F.col("cx").alias(f"{n}cx"), F.col("cy").alias(f"{n}cy"), *(F.col(f"p.{c}").alias(f"{n}{c}") for c in "xyz")) for n in "ab")
    met = pairs.select(*by, "acx", "acy", "bcx", "bcy", "same").join(left, [*by, "acx", "acy"]).join(right, [*by, "bcx", "bcy"])
    names = ["lag", "pairs", "sum_d", "sum_g", "formed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one, other = (np.stack([np.asarray(batch.column(f"{n}{c}")[at].values) for c in "xyz"], axis=1) for n in "ab")
                found = _descended(one, other, batch.column("same")[at].as_py(), level, reach, lags, tolerance, leaf_points)
                lag = np.flatnonzero(found[0])
                keys = [pa.array([batch.column(k)[at].as_py()] * len(lag), batch.schema.field(k).type) for k in by]
                counts, sums = found[[0, 3]][:, lag].astype(np.int64), found[1:3, lag]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(lag.astype(np.int32)), pa.array(counts[0]), pa.array(sums[0]), pa.array(sums[1]), pa.array(counts[1])], names=[*by, *names])

    # few rows with much work each: dealt evenly, whatever their keys and bytes
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.sparkSession.sparkContext.defaultParallelism)
    types = "".join(f"`{k}` {points.schema[k].dataType.simpleString()}, " for k in by)
    one = met.select(*by, "same", "ax", "ay", "az", "bx", "by", "bz").repartition(tasks).mapInArrow(run, f"{types}lag int, pairs bigint, sum_d double, sum_g double, formed bigint")
    return one.groupBy(*by, "lag").agg(*(F.sum(c).alias(c) for c in names[1:]))


def semivariogram_by_cells(points: DataFrame, value: str, lags: int, reach: float, id_col: str = "station_id", by: tuple[str, ...] = (),
                           tolerance: float | None = None, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """``(by..., lag, n_pairs, distance, gamma, formed)`` over ``lags`` equal bins of pair distance from 0 to ``reach`` metres.

    Counts and gamma are exact; the mean distance of a lag is off by at most ``tolerance`` metres (a thousandth of a lag, if not given).
    ``formed`` is how many pairs of points were formed one by one. Points with NULL positions or values take no part; points at one place are
    pairs at distance 0.
    """
    keys = list(by)
    tolerance = reach / lags / 1000.0 if tolerance is None else tolerance
    rows = points.select(*keys, F.xxhash64(id_col).alias("id"), F.col("x_pl").cast("double").alias("x"), F.col("y_pl").cast("double").alias("y"), F.col(value).cast("double").alias("z")).na.drop()
    # squares of values far from zero would lose digits that differences need
    rows = rows.withColumn("z", F.col("z") - F.lit(rows.agg(F.avg("z")).first()[0] or 0.0)).persist()
    cells = _cells(rows, keys, 0, reach).persist()
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))))).alias("step")
    pairs = _side(cells, keys, "a").select("*", steps).withColumns({"bcx": F.col("acx") + F.col("step.i"), "bcy": F.col("acy") + F.col("step.j")}).drop("step").join(_side(cells, keys, "b"), [*keys, "bcx", "bcy"])
    total = None
    columns = [*keys, "lag", "pairs", "sum_d", "sum_g", "formed"]
    for level in range(MAX_DEPTH + 1):
        judged = cut_lineage(_judged(pairs, reach, lags, tolerance))
        block = max(BLOCK_POINTS, leaf_points)
        small = (F.col("an") <= block) & (F.col("bn") <= block) if level < MAX_DEPTH else F.lit(True)
        done = judged.filter("whole").groupBy(*keys, "lag").agg(F.sum("pairs").alias("pairs"), F.sum("sum_d").alias("sum_d"), F.sum("sum_g").alias("sum_g")).withColumn("formed", F.lit(0).cast("long"))
        opened = _opened(rows, judged.filter(~F.col("whole") & small), keys, level, reach, lags, tolerance, leaf_points)
        found = done.unionByName(opened.select(*columns))
        total = found if total is None else total.unionByName(found)
        rest = judged.filter(~F.col("whole") & ~small).select(*keys, F.struct("acx", "acy").alias("a"), F.struct("bcx", "bcy").alias("b"), "same")
        if rest.isEmpty():
            break
        finer = _cells(rows, keys, level + 1, reach).persist()
        up = lambda c: F.floor(F.col(c) / 2)
        left = _side(finer, keys, "a").withColumn("a", F.struct(up("acx").alias("acx"), up("acy").alias("acy")))
        right = _side(finer, keys, "b").withColumn("b", F.struct(up("bcx").alias("bcx"), up("bcy").alias("bcy")))
        once = ~F.col("same") | (F.col("acx") < F.col("bcx")) | ((F.col("acx") == F.col("bcx")) & (F.col("acy") <= F.col("bcy")))
        pairs = rest.join(left, [*keys, "a"]).join(right, [*keys, "b"]).filter(once).drop("a", "b", "same")
    sums = cut_lineage(total.groupBy(*keys, "lag").agg(F.sum("pairs").alias("n_pairs"), F.sum("sum_d").alias("d"), F.sum("sum_g").alias("g"), F.sum("formed").alias("formed")))
    rows.unpersist()
    return sums.filter("n_pairs > 0").select(*keys, "lag", "n_pairs", (F.col("d") / F.col("n_pairs")).alias("distance"), (F.col("g") / F.col("n_pairs")).alias("gamma"), "formed")
