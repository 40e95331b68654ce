"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Every document gets a rate, the mean number of its copies. Among all rates that give each source its
target of words, the mix takes those closest to "every document once" in relative entropy,
with no rate above ``cap``. The convex dual has one number per source, and the rates are its exponential tilts:
``min(cap, exp(tilt * size / mean size of the source))``. Newton steps on the dual are aggregates over
(source, size) counts, guarded by a bracket.

Rates become copies: the whole part, and one more for the documents whose random number (a hash
of the id) lies furthest below the rest. Where to cut is found per source by refining a
histogram, so no source is ever sorted. The few words still missing or in excess are made up by single
documents of about that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationgrid.llm.common import WORD, materialised

WEIGHTS = (1, 2, 3)
CAP = 3.0
STEPS = 60
TOLERANCE = 1e-7
#: Buckets of one refinement of the cut, and how many refinements.
BUCKETS, LEVELS = 1024, 3
REPAIRS = 4
#: Copies of a source's row that its documents are spread over.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_source(rows: DataFrame, table: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` (sid) with the columns of ``table``, one row per sid.

    Rows of one source meet SALTS copies of its row, so that a source with a third of all rows is not one task, here or in
    what is aggregated by sid after it.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("_salt", salts), ["sid", "_salt"], how).drop("_salt")


def ranked_sources(sized: DataFrame) -> DataFrame:
    """One row per source: sid (its place by code point, null last, from 0), size, documents.

    Places are counted per range of sources and added up, so that no task sorts all of them.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    ranges = materialised(stats.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("_place", place).join(before, "_range").select((F.col("_place") + F.col("_before")).cast("long").alias("sid"), "source", "source_size", "n")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets share all words by weight; what exceeds ``cap`` times a source is shared again among the others."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = materialised(sources.withColumns({"weight": weight, "_most": cap * F.col("source_size")}))
    per_weight = 0.0
    while True:
        above = F.col("_most") < per_weight * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("_most")).otherwise(0.0)).alias("fixed"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        found = max(0.0, float(row["all"] or 0) - row["fixed"]) / row["open"] if row["open"] else per_weight
        if found <= per_weight:
            break
        per_weight = found
    return sources.withColumn("target", F.least("_most", per_weight * F.col("weight"))).drop("_most")


def tilts(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sid, tilt of each source: guarded Newton steps on the dual over ``cells`` (sid, size, n)."""
    most = F.log(F.lit(cap))
    known = with_source(cells, sources.where("source_size > 0").select("sid", "target", (F.col("source_size") / F.col("n")).alias("mean"), "source_size"), "size")
    known = materialised(known.withColumn("z", F.col("size") / F.col("mean")))
    state = materialised(
        known.groupBy("sid").agg(F.first("target").alias("target"), F.first("source_size").alias("whole"), F.min("z").alias("least"))
        # at these ends every rate is at most target / whole, or at the cap
        .select(
            "sid", "target", F.lit(0.0).alias("tilt"), (-(F.abs(F.log(F.col("target") / F.col("whole"))) + 1) / F.col("least")).alias("low"),
            (most / F.col("least")).alias("high"), F.lit(False).alias("done"),
        )
    )
    for _ in range(STEPS):
        rate = F.exp(F.least(F.col("tilt") * F.col("z"), most))
        mass = F.col("n") * F.col("size") * rate
        sums = with_source(known.select("sid", "size", "n", "z"), state.where("NOT done"), "size").groupBy("sid").agg(
            F.sum(mass).alias("got"), F.sum(F.when(F.col("tilt") * F.col("z") < most, mass * F.col("z")).otherwise(0.0)).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        moved = state.join(sums, "sid", "left").withColumns({
            "high": F.when(over, F.col("tilt")).otherwise(F.col("high")), "low": F.when(F.coalesce(over, F.lit(True)), F.col("low")).otherwise(F.col("tilt")),
        })
        newton = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        near = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") < 1e-13 * (1 + F.abs("tilt")))
        state = materialised(moved.select(
            "sid", "target", F.when(near, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", near.alias("done"),
        ))
        if state.where("NOT done").isEmpty():
            break
    return state.select("sid", "tilt")


def _extra(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (sid, key in [0, 1), size, open) with ``extra``: the smallest keys of a source up to its ``wanted`` words."""
    docs = docs.withColumns({"_cell": F.floor(F.col("key") * BUCKETS ** LEVELS).cast("long")})
    levels = [BUCKETS ** k for k in range(LEVELS - 1, -1, -1)]
    cuts = materialised(wanted.select("sid", F.greatest("wanted", F.lit(0.0)).alias("_left"), F.lit(0).cast("long").alias("_cut")))
    own = docs.where("open").select("sid", "row", "size", "_cell")
    for k, width in enumerate(levels):
        if k:  # only the bucket that is refined
            bucket = F.floor(F.col("_cell") / (width * BUCKETS)).cast("long") * BUCKETS
            own = materialised(with_source(own, cuts.select("sid", "_cut"), "row").where(bucket == F.col("_cut")).drop("_cut"))
        sums = own.groupBy("sid", F.floor(F.col("_cell") / width).cast("long").alias("_at")).agg(F.sum("size").alias("_sum"))
        # at most BUCKETS rows of each source
        run = F.sum("_sum").over(Window.partitionBy("sid").orderBy("_at"))
        fits = materialised(sums.withColumn("_run", run).join(cuts.select("sid", "_left"), "sid"))
        taken = fits.where(F.col("_run") <= F.col("_left")).groupBy("sid").agg(F.max("_run").alias("_run"))
        first = fits.where(F.col("_run") > F.col("_left")).groupBy("sid").agg(F.min("_at").alias("_first"))
        left = F.col("_left") - F.coalesce("_run", F.lit(0))
        # the first bucket that does not fit whole is refined; if all fit, all cells below the end are taken
        end = F.when(F.col("_first").isNotNull(), F.col("_first")).when(F.lit(k == 0), F.lit(BUCKETS)).otherwise(F.col("_cut") + BUCKETS)
        scale = BUCKETS if k + 1 < len(levels) else 1
        cuts = materialised(cuts.join(taken, "sid", "left").join(first, "sid", "left").select("sid", left.alias("_left"), (end * scale).cast("long").alias("_cut")))
    return with_source(docs, cuts.select("sid", "_cut"), "row").withColumn("extra", F.col("open") & (F.col("_cell") < F.col("_cut"))).drop("_cell", "_cut")


def _repair(docs: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """One document more or less per source and round, the one whose size is nearest to what is still missing."""
    for _ in range(REPAIRS):
        gap = docs.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("_got")).join(targets.select("sid", "target"), "sid").select("sid", (F.col("target") - F.col("_got")).alias("_gap"))
        can = F.when(F.col("_gap") > 0, F.col("copies") + 1 <= cap).otherwise(F.col("copies") > 0)
        off = F.abs(F.abs("_gap") - F.col("size"))
        best = (
            with_source(docs, gap, "row").where(can & (off < F.abs("_gap"))).groupBy("sid")
            .agg(F.min(F.struct(off.alias("off"), F.col("key"), F.col("row"), F.signum("_gap").cast("long").alias("step"))).alias("best"))
            .select(F.col("best.row").alias("row"), F.col("best.step").alias("_step"))
        )
        docs = materialised(docs.join(best, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0))).drop("_step"))
    return docs


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and row (a number of its own) of every row of ``docs``.

    A null text has size 0, and documents of size 0 are taken once. Null is a source of its own. Repeated rows are
    documents of their own. An empty table gives no rows; if no document has words, all targets are 0.
    """
    sized = materialised(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).withColumn("row", F.monotonically_increasing_id())
    sources = materialised(with_targets(ranked_sources(sized), weights, cap))
    named = materialised(sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("row", "doc_id", "sid", "size"))
    cells = named.where("size > 0").groupBy("sid", "size").agg(F.count("*").alias("n"))
    tilt = tilts(cells, sources, cap)
    rated = (
        with_source(named, sources.select("sid", "source_size", "n").join(tilt, "sid", "left"), "row")
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.exp(F.least(F.col("tilt") * F.col("size") * F.col("n") / F.col("source_size"), F.log(F.lit(cap))))))
    )
    whole = F.floor(F.col("rate") + 1e-9).cast("long")
    random = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 40)) / float(1 << 40)
    split = materialised(rated.select(
        "row", "doc_id", "sid", "size", whole.alias("copies"), ((random - (F.col("rate") - whole) + 1) / 2).alias("key"), ((whole + 1 <= cap) & (F.col("size") > 0)).alias("open"),
    ))
    base = split.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("_got"))
    wanted = sources.join(base, "sid").select("sid", (F.col("target") - F.col("_got")).alias("wanted"))
    rounded = materialised(_extra(split, wanted).withColumn("copies", F.col("copies") + F.col("extra").cast("long")).select("row", "doc_id", "sid", "size", "copies", "key"))
    return with_source(_repair(rounded, sources, cap), sources, "row").select("doc_id", "source", "size", "source_size", "target", "copies", "row")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of all its copies), copies."""
    taken = F.col("copies") * F.col("size")
    return mix_copies(docs, weights, cap).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Copies are counted by id; where an id is repeated, its rows share the copies of their sum in turn.
    """
    per_id = materialised(mix_copies(docs, weights, cap).groupBy("doc_id").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")))
    columns = docs.columns
    joined = docs.join(per_id.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    taken = joined.where("_rows = 1").withColumn("_times", F.col("_copies"))
    if not per_id.where("_rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source"))
        shared = joined.where("_rows > 1").withColumn("_place", place)
        more = (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("long")
        taken = taken.unionByName(shared.withColumn("_times", F.floor(F.col("_copies") / F.col("_rows")) + more).drop("_place"))
    return taken.where("_times > 0").withColumn("_times", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).select(*columns)
