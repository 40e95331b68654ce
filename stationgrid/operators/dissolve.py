"""Union of overlapping and adjacent polygons, on their edges.

Edges are cut wherever they meet edges of other polygons, which is found in horizontal bands. A piece belongs to the border of the union if the union
lies on exactly one of its sides, so pieces inside another polygon and borders that two neighbours share go, and of borders that
several polygons have in common one is kept. Neither step looks at more than the edges of a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.session import cut_lineage

#: Metres below which two places are the same, and how far beside a piece its two sides are tested.
SAME, BESIDE = 1e-6, 1e-3


def _bands(edges: DataFrame) -> tuple[float, float]:
    row = edges.agg(F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"), F.count("*").alias("n")).first()
    low = row["low"] if row["n"] else 0.0
    return low, max((row["high"] - low) / max(1, row["n"] // 2), 1e-3) if row["n"] else 1.0


def _banded(edges: DataFrame, low: float, step: float) -> DataFrame:
    band = lambda v: F.floor((v - F.lit(low)) / F.lit(step))
    return edges.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2") - SAME), band(F.greatest("y1", "y2") + SAME))))


def _along(x: Column, y: Column) -> Column:
    """Where on its edge a place lies, from 0 to 1, if it lies on it."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    at = F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, square)
    off = F.abs((x - F.col("x1")) * dy - (y - F.col("y1")) * dx)
    return F.when((off <= SAME * F.sqrt(square)) & (at > 0) & (at < 1), at)


def _pieces(edges: DataFrame, part: str) -> DataFrame:
    """(x1, y1, x2, y2) of the edges, cut where those of other parts cross or touch them; pieces that coincide are one."""
    low, step = _bands(edges)
    named = edges.select(part, "x1", "y1", "x2", "y2").withColumn("edge", F.monotonically_increasing_id())
    named = cut_lineage(named)
    banded = _banded(named, low, step)
    other = banded.select("band", F.col(part).alias("_part"), *(F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")))
    met = banded.join(other, "band").filter((F.col(part) != F.col("_part")) & (F.greatest("x1", "x2") + SAME >= F.least("ox1", "ox2")) & (F.greatest("ox1", "ox2") + SAME >= F.least("x1", "x2")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    turn = dx * ey - dy * ex
    ax, ay = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    at, there = F.try_divide(ax * ey - ay * ex, turn), F.try_divide(ax * dy - ay * dx, turn)
    crossing = F.when((at > 0) & (at < 1) & (there >= 0) & (there <= 1), at)
    cuts = met.select("edge", F.explode(F.array(crossing, _along(F.col("ox1"), F.col("oy1")), _along(F.col("ox2"), F.col("oy2")))).alias("at")).na.drop()
    places = cuts.groupBy("edge").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    stops = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    whole = named.join(places, "edge", "left").withColumn("stops", stops)
    spans = whole.select("x1", "y1", "x2", "y2", F.posexplode("stops").alias("i", "a"), "stops").filter(F.col("i") + 1 < F.size("stops")).withColumn("b", F.col("stops")[F.col("i") + 1])
    # ends of an edge are kept as they are, so that pieces of neighbours meet exactly
    point = lambda t, c: F.when(t == 0, F.col(f"{c}1")).when(t == 1, F.col(f"{c}2")).otherwise(F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1")))
    ends = spans.select(point(F.col("a"), "x").alias("px"), point(F.col("a"), "y").alias("py"), point(F.col("b"), "x").alias("qx"), point(F.col("b"), "y").alias("qy"))
    snapped = ends.withColumns({k: F.round(F.col(c) / SAME).cast("long") for k, c in (("ka", "px"), ("kb", "py"), ("kc", "qx"), ("kd", "qy"))}).filter("ka <> kc OR kb <> kd")
    forward = F.struct("ka", "kb") < F.struct("kc", "kd")
    key = F.when(forward, F.struct("ka", "kb", "kc", "kd")).otherwise(F.struct(F.col("kc").alias("ka"), F.col("kd").alias("kb"), F.col("ka").alias("kc"), F.col("kb").alias("kd")))
    one = snapped.groupBy(key.alias("key")).agg(F.min(F.struct("px", "py", "qx", "qy")).alias("e"))
    return one.select(F.col("e.px").alias("x1"), F.col("e.py").alias("y1"), F.col("e.qx").alias("x2"), F.col("e.qy").alias("y2"))


def inside_any(points: DataFrame, edges: DataFrame, point_id: str, x: str = "x", y: str = "y", part: str = "ring_id") -> DataFrame:
    """``(point_id, inside)`` for the points inside at least one polygon; each polygon is filled by its own edges."""
    low, step = _bands(edges)
    banded = _banded(edges, low, step).select("band", part, "x1", "y1", "x2", "y2")
    keyed = points.select(point_id, F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor((F.col(y) - low) / step).alias("band"))
    straddles = ((F.col("y1") <= F.col("_y")) & (F.col("_y") < F.col("y2"))) | ((F.col("y2") <= F.col("_y")) & (F.col("_y") < F.col("y1")))
    at = F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossed = keyed.join(banded, "band").filter(straddles & (F.col("_x") < at))
    return crossed.groupBy(point_id, part).agg((F.count("*") % 2 == 1).alias("odd")).filter("odd").select(point_id, F.lit(True).alias("inside")).distinct()


def dissolve(edges: DataFrame, part: str = "ring_id") -> DataFrame:
    """Edges ``(ring_id, seq, x1, y1, x2, y2)`` of the union of the polygons that ``part`` names.

    Filled by the even-odd rule, as :func:`mark_inside` does, they cover what any polygon covers. They form closed lines
    but are not put in order: ``ring_id`` is 0 and ``seq`` counts them. A polygon may have holes, as further rings with the same ``part``. Edges of no length, repeated polygons
    and an empty table are allowed.
    """
    pieces = cut_lineage(_pieces(edges, part).withColumn("seq", F.monotonically_increasing_id()))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    middle_x, middle_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    tested = pieces.withColumn("side", sides).select("seq", "side", (middle_x - F.col("side") * BESIDE * dy / length).alias("x"), (middle_y + F.col("side") * BESIDE * dx / length).alias("y"))
    tested = tested.withColumn("place", F.col("seq") * 2 + F.when(F.col("side") > 0, 1).otherwise(0))
    covered = inside_any(tested, edges, "place", part=part).groupBy(F.floor(F.col("place") / 2).alias("seq")).agg(F.count("*").alias("n"))
    border = covered.filter("n = 1").select("seq")
    return pieces.join(border, "seq").select(F.lit(0).alias("ring_id"), "seq", "x1", "y1", "x2", "y2")
