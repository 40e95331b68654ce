"""Repeated runs of lines, found by winnowing over line hashes. DataFrame functions only.

A run of lines is repeated if the same lines, of at least ``min_words`` words together, stood in this order
before: in a document with a smaller id, or earlier in the same one. The first stays, later ones go.

From every line the shortest window of at least ``min_words`` words is taken forwards and backwards. The line with
the smallest hash in a window is its fingerprint: a repeated run holds a whole window, and equal windows have the
same fingerprint, so every repeated run is guaranteed one. Fingerprints that stand in one place only
end there, with all windows they stand for; that is nearly all of a clean corpus. The others join their positions, and windows
with the same fingerprint and the same lines are matches. A match is extended both ways by the windows
that start or end at its neighbours: those that a run contains cover all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationgrid.llm.common import join_keys, materialised, written
from stationgrid.llm.mixing import word_count

MIN_WORDS = 8


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, pos, h, words of the lines that have words. ``mark`` tells texts of the same id apart."""
    split = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), split).select("doc_id", "mark", "pos", F.xxhash64("line").alias("h"), word_count(F.col("line")).alias("words"))
    # a repeated row is the same document once more
    return lines.where("words > 0").repartition("doc_id", "mark").dropDuplicates(["doc_id", "mark", "pos"])


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, mark, low, high, print (hash and place of the fingerprint), key of the shortest windows both ways."""
    doc = Window.partitionBy("doc_id", "mark")
    placed = lines.withColumn("until", F.sum("words").over(doc.orderBy("pos"))).withColumn("since", F.col("until") - F.col("words"))
    total = F.sum("words")
    frames = [
        (doc.orderBy("since").rangeBetween(0, min_words - 1), lambda words: words >= min_words),
        # a window that is too short without its last line is the forward window of its first
        (doc.orderBy("until").rangeBetween(-(min_words - 1), 0), lambda words: words - F.col("words") >= min_words),
    ]
    windows = [
        placed.select(
            "doc_id", "mark", F.min("pos").over(frame).alias("low"), F.max("pos").over(frame).alias("high"), "words", total.over(frame).alias("_words"),
            F.min(F.struct("h", "pos")).over(frame).alias("print"), F.collect_list("h").over(frame).alias("_lines"),
        ).where(enough(F.col("_words")))
        for frame, enough in frames
    ]
    return windows[0].unionByName(windows[1]).select(
        "doc_id", "mark", "low", "high", F.col("print.h").alias("h"), F.col("print.pos").alias("at"),
        F.xxhash64("_lines").alias("k1"), F.xxhash64(F.lit(1), "_lines").alias("k2"),
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark, low, high: the maximal spans of lines of later repeated runs."""
    windows = written(_windows(_lines(docs), min_words), "windows")
    place = F.struct("doc_id", "mark", "at")
    seen = [F.count("*").alias("_n"), F.min(place).alias("_first"), F.max(place).alias("_last")]
    prints = materialised(windows.groupBy("h").agg(*seen).where("NOT (_first <=> _last)").select("h", "_n"))
    met = materialised(join_keys(windows, prints, ["h"], windows.count()))
    start = F.struct("doc_id", "mark", "low")
    seen = [F.count("*").alias("_n"), F.min(start).alias("_first"), F.max(start).alias("_last")]
    first = materialised(met.groupBy("k1", "k2").agg(*seen).where("NOT (_first <=> _last)").select("k1", "k2", "_n", "_first"))
    later = join_keys(met, first, ["k1", "k2"], met.count()).where(~start.eqNullSafe(F.col("_first")))
    spans = later.select("doc_id", "mark", "low", "high").distinct()
    doc = Window.partitionBy("doc_id", "mark").orderBy("low", "high")
    reach = F.max("high").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", (F.coalesce(reach, F.lit(-2)) < F.col("low") - 1).cast("int")).withColumn("_run", F.sum("_new").over(doc))
    return runs.groupBy("doc_id", "mark", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and ``n_lines``, ``n_removed``.

    Blank lines belong to no run; one inside a deleted run goes with it. Null texts stay null and have no lines. A
    repeated row (same id, same text) is changed like the first. Columns of these two names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*columns)
    gone = (
        repeated_lines(docs.select("doc_id", "text"), min_words).groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("low", "high")).alias("_gone")).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    )
    joined = docs.withColumn("_own", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("_gone", lambda g: (g["low"] <= i) & (i <= g["high"])))
    return joined.withColumns({
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")), "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.aggregate("_gone", F.lit(0).cast("long"), lambda n, g: n + g["high"] - g["low"] + 1), F.lit(0)).cast("long"),
    }).select(*columns, "n_lines", "n_removed")


def keep_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs``, repeated runs deleted; rows that lose all their words go."""
    found = dedup_lines(docs, min_words)
    return found.where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]"))).select(*docs.columns)


#: DuckDB SQL of the digest of ``dedup_lines``: windows compare their lines themselves.
DIGEST_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS line, len(regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+')) AS words
  FROM docs, unnest(range(1, len(parts) + 1)) AS t(i)),
placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS until FROM lines WHERE words > 0),
both_ways AS (
  SELECT doc_id, min(pos) OVER f AS low, max(pos) OVER f AS high, sum(words) OVER f AS n, list(line) OVER f AS body
  FROM (SELECT *, until - words AS since FROM placed)
  WINDOW f AS (PARTITION BY doc_id ORDER BY since RANGE BETWEEN CURRENT ROW AND {more} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER f, max(pos) OVER f, sum(words) OVER f, list(line) OVER f FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY until RANGE BETWEEN {more} PRECEDING AND CURRENT ROW)),
ranked AS (
  SELECT doc_id, low, high, dense_rank() OVER (PARTITION BY body ORDER BY doc_id, low) AS turn FROM both_ways WHERE n > {more}),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS pos FROM ranked WHERE turn > 1),
marked AS (
  SELECT d.doc_id, d.i - 1 AS pos, d.parts[d.i] AS line, g.pos IS NOT NULL AS removed
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs) d LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.pos = d.i - 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
