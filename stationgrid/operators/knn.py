"""Exact k-nearest-neighbour join as a quadtree descent.

A pure distance predicate has no equi key and would be planned as a nested loop.
Instead:

1. Base points are counted per quadtree cell (cells adapt: a cell with more than
   ``leaf_rows`` points is split, so a dense city becomes many small leaves and no
   leaf grows with the data).
2. Queries are grouped by the finest cell they lie in, and each group's bounding
   box walks down the tree, a few levels per step. A step joins its candidate cells
   with their children and keeps those not beyond the distance within which k
   points are already guaranteed. Walking per group keeps this small.
3. Each query takes over its group's leaves and applies the same bound to itself,
   which leaves a handful of leaves whatever the distribution of either side.
4. Surviving (query, leaf) rows meet the base points of the leaf in one equi-join
   and the k smallest distances per query remain (ties by neighbour id). Spark
   prunes to k rows per query before that last shuffle.

With ``lists`` the last step is taken by the groups of step 2 instead: the points of a group's leaves are sent
once to all its queries, which pick theirs in Arrow batches. For many neighbours that moves far fewer rows.

No step caps or samples candidates, so the result equals brute force. ``by``
restricts neighbours to the same group (for example the same snapshot).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from stationgrid.operators.sizes import SEARCH_BROADCAST_ROWS

LEAF_ROWS = 48
MAX_DEPTH = 28
#: Queries of a group that one batch serves; a crowded group is dealt into several.
GROUP_QUERIES = 512
STEP = 2  # tree levels per descent step: 16 children per cell
WIDE_STEP = 3  # for shallow trees, where fewer steps matter more than fewer rows


class _Tree:
    """Cell arithmetic of a quadtree over a square that contains all base points."""

    def __init__(self, x0: float, y0: float, side: float, depth: int):
        self.x0, self.y0, self.side, self.depth = x0, y0, side, depth
        step = WIDE_STEP if depth <= 2 * WIDE_STEP else STEP
        self.levels = sorted({0, *range(depth, 0, -step)})
        self.top = self.levels[:2][-1]  # where the walk starts; the root only when it is the one leaf
        self.slack = side * 1e-9

    def cell(self, x: str, y: str) -> list[str]:
        """Finest cell of a position, which may lie outside the square."""
        scale = f"{2**self.depth / self.side!r}D"
        return [
            f"CAST(floor(({v} - ({o!r}D)) * {scale}) AS BIGINT) AS {name}"
            for v, o, name in ((x, self.x0, "_gx"), (y, self.y0, "_gy"))
        ]

    def finest(self, x: str, y: str) -> list[str]:
        """Finest cell of a base point, held inside the square against rounding."""
        last = 2**self.depth - 1
        return [f"least(greatest({text}, 0), {last}) AS {name}" for text, name in
                (c.rsplit(" AS ", 1) for c in self.cell(x, y))]

    def ancestors(self, gx: str, gy: str) -> str:
        """A finest cell's cell on every used level, one row each."""
        return "inline(array(" + ", ".join(
            f"named_struct('level', {lv}, 'cx', shiftright({gx}, {self.depth - lv}), 'cy', shiftright({gy}, {self.depth - lv}))"
            for lv in self.levels
        ) + "))"

    def near_and_far(self, x: tuple[str, str], y: tuple[str, str]) -> tuple[Column, Column]:
        """Squared bounds of the distance from a box to anything in cell (level, cx, cy)."""
        size, slack = f"({self.side!r}D / power(2D, level))", f"{self.slack!r}D"
        near, far = [], []
        for (low, high), origin, index in ((x, self.x0, "cx"), (y, self.y0, "cy")):
            edge = f"({origin!r}D + {index} * {size})"
            near.append(f"power(greatest({edge} - {high}, {low} - ({edge} + {size}), {slack}) - {slack}, 2)")
            far.append(f"power(greatest({high} - {edge}, {edge} + {size} - {low}) + {slack}, 2)")
        return F.expr(" + ".join(near)), F.expr(" + ".join(far))


def _count_cells(points: DataFrame, by: list[str], tree: _Tree) -> DataFrame:
    """``(by..., level, cx, cy, n)`` of every occupied cell on every used level."""
    finest = points.selectExpr(*by, *tree.finest("_x", "_y")).groupBy(*by, "_gx", "_gy").agg(F.count("*").alias("_n"))
    return finest.selectExpr(*by, "_n", tree.ancestors("_gx", "_gy")).groupBy(*by, "level", "cx", "cy").agg(
        F.sum("_n").alias("n")
    )


def _build_tree(points: DataFrame, by: list[str], leaf_rows: int) -> tuple[_Tree, DataFrame, dict[int, int]] | None:
    """The tree, its persisted cells and their number per level; None without points.

    Extent and depth follow from one-row aggregates. A depth at which some cell is
    still crowded is refined, so the depth suits the densest place.
    """
    per_group = points.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"),
        F.min("_y").alias("y0"), F.max("_y").alias("y1"),
    )
    n, x0, x1, y0, y1 = per_group.agg(F.max("n"), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    if not n:
        return None
    side = max(x1 - x0, y1 - y0, 1e-6) * (1.0 + 1e-9)
    depth = 0 if n <= leaf_rows else math.ceil(math.log(n / leaf_rows, 4))
    while True:
        tree = _Tree(x0, y0, side, min(depth, MAX_DEPTH))
        cells = _count_cells(points, by, tree).persist(StorageLevel.MEMORY_AND_DISK)
        per_level = {r["level"]: r for r in cells.groupBy("level").agg(F.count("*").alias("size"), F.max("n").alias("full")).collect()}
        fullest = per_level[tree.depth]["full"]
        if fullest <= 4 * leaf_rows or tree.depth == MAX_DEPTH:
            return tree, cells, {level: r["size"] for level, r in per_level.items()}
        cells.unpersist()
        depth += math.ceil(math.log(fullest / (4 * leaf_rows), 4)) + 1


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_id: str = "station_id",
    base_id: str = "station_id",
    x: str = "x_pl",
    y: str = "y_pl",
    payload: tuple[str, ...] = (),
    by: tuple[str, ...] = (),
    exclude_self: bool = False,
    distinct_base: bool = False,
    leaf_rows: int = LEAF_ROWS,
    broadcast_rows: int = SEARCH_BROADCAST_ROWS,
    positions: bool = False,
    lists: bool = False,
) -> DataFrame:
    """``(by..., query_id, nbr_id, distance, rank, nbr_<payload>...)``, rank 1..k; with ``positions`` also the query's own ``qx, qy``.

    Queries are expected at distinct locations (stations after de-duplication,
    grid cells); for co-located queries use :func:`nearest_of_locations`. Base
    points may share a location: only the lowest ids there can ever be chosen, and
    the others are dropped before anything is shuffled by cell. ``distinct_base``
    says that they do not, which saves that step. ``lists`` gives one row per query, ``(by..., query_id, qx, qy,
    nbr_<payload>...)`` with arrays of the payload, nearest first.
    """
    if lists and exclude_self:
        raise ValueError("lists hold a query's own point too")
    by = list(by)
    need = k + (1 if exclude_self else 0)
    points = base.select(
        *by, F.col(base_id).alias("_bid"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
        *[F.col(c).alias(f"nbr_{c}") for c in payload],
    )
    if not distinct_base:
        same_place = Window.partitionBy(*by, "_x", "_y").orderBy("_bid")
        points = points.withColumn("_o", F.row_number().over(same_place)).filter(F.col("_o") <= need).drop("_o")
    points.persist(StorageLevel.MEMORY_AND_DISK)
    if queries is base and query_id == base_id and distinct_base:
        asked = points.selectExpr(*by, "_bid AS _qid", "_x AS _qx", "_y AS _qy")
    else:
        asked = queries.select(
            *by, F.col(query_id).alias("_qid"), F.col(x).cast("double").alias("_qx"), F.col(y).cast("double").alias("_qy")
        )
    built = _build_tree(points, by, leaf_rows)
    if built is None:
        empty = asked.limit(0).join(points, by or F.lit(False)).withColumn("_d2", F.lit(0.0))
        ranked = _ranked(empty, by, k, query_id, payload, positions or lists)
        if not lists:
            return ranked
        return ranked.select(*by, query_id, "qx", "qy", *[F.array(f"nbr_{c}").alias(f"nbr_{c}") for c in payload])
    tree, nodes, sizes = built

    def hint(df: DataFrame, rows: int) -> DataFrame:
        """Broadcast a table of a counted size; beyond the limit it is shuffled."""
        return F.broadcast(df) if rows <= broadcast_rows else df

    asked = asked.selectExpr("*", *tree.cell("_qx", "_qy"))
    groups = asked.groupBy(*by, "_gx", "_gy").agg(
        F.min("_qx").alias("_x0"), F.max("_qx").alias("_x1"), F.min("_qy").alias("_y0"), F.max("_qy").alias("_y1")
    )
    leaves = _descend(groups, nodes, tree, by, need, leaf_rows, sizes, hint)
    # each base point belongs to exactly one leaf: its coarsest cell that is small enough
    leaf_nodes = nodes.filter(
        f"level >= {tree.top} AND (n <= {leaf_rows} OR level = {tree.depth})"
    ).select(*by, "level", "cx", "cy")
    leaf_level = (
        nodes.filter(f"level = {tree.depth}").selectExpr(*by, "cx AS _gx", "cy AS _gy")
        .selectExpr(*by, "_gx", "_gy", tree.ancestors("_gx", "_gy"))
        .join(hint(leaf_nodes, sum(sizes.values())), [*by, "level", "cx", "cy"])
        .groupBy(*by, "_gx", "_gy").agg(F.min("level").alias("level"))
    )
    placed = points.selectExpr("*", *tree.finest("_x", "_y")).join(hint(leaf_level, sizes[tree.depth]), [*by, "_gx", "_gy"]).selectExpr(
        *by, "level", f"shiftright(_gx, {tree.depth} - level) AS cx", f"shiftright(_gy, {tree.depth} - level) AS cy",
        "_bid", "_x", "_y", *[f"nbr_{c}" for c in payload],
    )
    if lists:
        return _listed(asked, leaves.drop("n").join(placed, [*by, "level", "cx", "cy"]), by, k, query_id, payload)
    own = asked.join(leaves, [*by, "_gx", "_gy"])
    near, far = tree.near_and_far(("_qx", "_qx"), ("_qy", "_qy"))
    frontier = _within_bound(own, near, far, [*by, "_qid"], need)
    pairs = frontier.join(placed, [*by, "level", "cx", "cy"])
    dx, dy = F.col("_qx") - F.col("_x"), F.col("_qy") - F.col("_y")
    pairs = pairs.withColumn("_d2", dx * dx + dy * dy)
    wanted = F.coalesce(F.col("_d2") <= F.col("_bound"), F.lit(True))
    if exclude_self:
        wanted = wanted & (F.col("_bid") != F.col("_qid"))
    return _ranked(pairs.filter(wanted), by, k, query_id, payload, positions)


def _within_bound(cells: DataFrame, near: Column, far: Column, owner: list[str], need: int) -> DataFrame:
    """Cells of each owner that can hold one of its ``need`` nearest points.

    Taking cells by their far edge, ``_bound`` is the distance at which they hold
    ``need`` points for certain; a cell that starts beyond it is of no use.
    """
    everything = Window.partitionBy(*owner)
    by_reach = everything.orderBy("_far", "level", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.withColumns({"_near": near, "_far": far})
        .withColumn("_cum", F.sum("n").over(by_reach))
        .withColumn("_bound", F.min(F.when(F.col("_cum") >= need, F.col("_far"))).over(everything))
        .filter(F.coalesce(F.col("_near") <= F.col("_bound"), F.lit(True)))
        .drop("_near", "_far", "_cum")
    )


def _descend(groups, nodes, tree: _Tree, by: list[str], need: int, leaf_rows: int, sizes, hint) -> DataFrame:
    """(group, leaf) rows: every leaf that can matter to a query in the group's box."""
    box = ("_x0", "_x1", "_y0", "_y1")
    top = tree.top
    near, far = tree.near_and_far(("_x0", "_x1"), ("_y0", "_y1"))
    counts = hint(nodes.filter(f"level = {top}").select(*by, "cx", "cy", "n"), sizes[top])
    frontier = (
        groups.selectExpr("*", f"{top} AS level", f"explode(sequence(0L, {4**top - 1}L)) AS _cell")
        .selectExpr("*", f"_cell % {2**top} AS cx", f"_cell DIV {2**top} AS cy").drop("_cell")
        .join(counts, [*by, "cx", "cy"])
    )
    frontier = _within_bound(frontier, near, far, [*by, "_gx", "_gy"], need).drop("_bound")
    for parent, child in zip(tree.levels[1:], tree.levels[2:]):
        up = child - parent
        children = hint(nodes.filter(f"level = {child}").selectExpr(
            *by, f"shiftright(cx, {up}) AS _px", f"shiftright(cy, {up}) AS _py", "cx AS _cx", "cy AS _cy", "n AS _cn",
        ), sizes[child])
        # cells already small enough keep their row: a negative key finds no children, and many of them spread over tasks
        splits = f"level = {parent} AND n > {leaf_rows}"
        joined = frontier.selectExpr(
            "*", f"CASE WHEN {splits} THEN cx ELSE -1L - pmod(xxhash64(_gx, _gy, cx, cy), 1000003L) END AS _px",
            f"CASE WHEN {splits} THEN cy ELSE -1L END AS _py",
        ).join(children, [*by, "_px", "_py"], "left")
        cells = joined.selectExpr(
            *by, "_gx", "_gy", *box, f"CASE WHEN _cn IS NULL THEN level ELSE {child} END AS level",
            "coalesce(_cx, cx) AS cx", "coalesce(_cy, cy) AS cy", "coalesce(_cn, n) AS n",
        )
        frontier = _within_bound(cells, near, far, [*by, "_gx", "_gy"], need).drop("_bound")
    return frontier.drop(*box)


def _ranked(pairs: DataFrame, by: list[str], k: int, query_id: str, payload, positions: bool = False) -> DataFrame:
    closest = Window.partitionBy(*by, "_qid").orderBy("_d2", "_bid")
    return pairs.withColumn("rank", F.row_number().over(closest)).filter(F.col("rank") <= k).select(
        *by, F.col("_qid").alias(query_id), F.col("_bid").alias("nbr_id"),
        F.sqrt("_d2").alias("distance"), "rank", *[f"nbr_{c}" for c in payload],
        *([F.col("_qx").alias("qx"), F.col("_qy").alias("qy")] if positions else []),
    )


def _listed(asked: DataFrame, held: DataFrame, by: list[str], k: int, query_id: str, payload: tuple[str, ...]) -> DataFrame:
    """The first ``k`` of ``held``, the points that matter to a group, for each query of the group in ``asked``."""
    group = [*by, "_gx", "_gy"]
    asked = asked.dropna(subset=group)
    parts = asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).alias("_parts"))
    dealt = asked.join(parts, group).withColumn("_part", F.pmod(F.xxhash64("_qid"), F.col("_parts"))).drop("_parts")
    names = [f"nbr_{c}" for c in payload]
    sent = held.join(parts, group).select(
        *(F.col(c).alias(f"_to{i}") for i, c in enumerate(group)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_to_part"), "_bid", "_x", "_y", *names
    )
    types = {**dict(asked.dtypes), **dict(held.dtypes)}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), f"`{query_id}` {types['_qid']}, qx double, qy double", *(f"`{n}` array<{types[n]}>" for n in names)])

    arrow = {n: to_arrow_type(T.DataType.fromDDL(f"array<{types[n]}>")) for n in names}

    def pick(queries: pa.Table, points: pa.Table) -> pa.Table:
        # by id, so that a stable order by distance settles ties by id
        points = points.take(pc.sort_indices(points, sort_keys=[("_bid", "ascending")], null_placement="at_start")).combine_chunks()
        queries = queries if points.num_rows else queries.slice(0, 0)
        qx, qy, x, y = (t.column(c).to_numpy() for t, c in ((queries, "_qx"), (queries, "_qy"), (points, "_x"), (points, "_y")))
        dx, dy = qx[:, None] - x, qy[:, None] - y
        chosen = np.argsort(dx * dx + dy * dy, axis=1, kind="stable")[:, :k]
        ends = pa.array(np.arange(len(qx) + 1) * chosen.shape[1], pa.int32())
        flat = points.take(pa.array(chosen.ravel())).combine_chunks()
        values = [pa.concat_arrays(flat.column(n).chunks) if flat.num_rows else pa.array([], flat.schema.field(n).type) for n in names]
        found = [pa.ListArray.from_arrays(ends, v).cast(arrow[n]) for n, v in zip(names, values)]
        return pa.table([*(queries.column(c) for c in [*by, "_qid", "_qx", "_qy"]), *found], names=[*by, query_id, "qx", "qy", *names])

    to = [f"_to{i}" for i in range(len(group))]
    return dealt.groupBy(*group, "_part").cogroup(sent.groupBy(*to, "_to_part")).applyInArrow(pick, schema)


def nearest_of_locations(queries: DataFrame, base: DataFrame, k: int, query_id: str = "station_id",
                         x: str = "x_pl", y: str = "y_pl", exclude_self: bool = False, **options) -> DataFrame:
    """:func:`nearest` for queries that may share locations in any number.

    The search runs once per distinct location and asks for one extra neighbour;
    each query then takes its k from the location's short list, leaving itself out.
    """
    by = list(options.pop("by", ()))
    payload = tuple(options.get("payload", ()))
    places = queries.select(*by, x, y).distinct().withColumn("_place", F.xxhash64(x, y))
    found = nearest(places, base, k + (1 if exclude_self else 0), query_id="_place", x=x, y=y, by=tuple(by), **options)
    entry = F.struct("distance", "nbr_id", *[f"nbr_{c}" for c in payload])
    lists = found.groupBy(*by, "_place").agg(F.sort_array(F.collect_list(entry)).alias("_list"))
    own = lambda e: e["nbr_id"] != F.col(query_id)
    chosen = F.filter("_list", own) if exclude_self else F.col("_list")
    return (
        queries.select(*by, query_id, F.xxhash64(x, y).alias("_place"))
        .join(lists, [*by, "_place"])
        .select(*by, query_id, F.posexplode(F.slice(chosen, 1, k)).alias("pos", "e"))
        .select(*by, query_id, "e.nbr_id", "e.distance", (F.col("pos") + 1).alias("rank"),
                *[f"e.nbr_{c}" for c in payload])
    )
