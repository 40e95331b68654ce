"""Audit of text filters: what each removes, alone and after the others, in every order.

Every filter leaves a relation of the ids of the documents that fail it. What a filter still finds after a prefix of others is its
relation left-anti joined by theirs, so an order needs no second look at the texts. Orders that have the same filters before one share
what it finds: five anti-joins go through all sets of earlier filters. The relations are dealt by id once, sorted and kept,
so none of these joins moves a row.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationgrid.llm.common import WORD, join_keys, materialised, written

LETTERS = "ABCDE"
LEAST_WORDS = 200
#: Percent of words that are distinct, at least; percent of capitals, at most.
DISTINCT, CAPITALS = 50, 2
SIGNS = "[#$%&*|]"


def _failures(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters that look at it alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS * F.char_length(text),
        "D": F.regexp_like(text, F.lit(SIGNS)),
    }


def failing_ids(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, filter, part, good, toxic) of every failure, and the documents of each part as (part, documents).

    ``row`` numbers the rows of ``docs``; a row that fails several filters has a row in the relation of each.
    """
    text = F.coalesce("text", F.lit(""))
    facts = written(
        docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
        .select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(f) for f, c in _failures(F.col("text")).items()))
        .withColumn("row", F.monotonically_increasing_id()),
        "filter_facts",
    )
    total = facts.count()
    copies = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")).where("_n > 1 AND least IS NOT NULL")
    later = join_keys(facts.select("row", "doc_id", "part", "digest"), copies, ["digest"], total).where("doc_id > least")
    failed = F.array_compact(F.array(*(F.when(F.col(f), f) for f in LETTERS[:-1])))
    known = facts.select("row", "doc_id", "part", F.explode(failed).alias("filter")).unionByName(later.select("row", "doc_id", "part", F.lit("E").alias("filter")))
    good, toxic = (labels.where(F.col(c) == 1).select("doc_id").distinct() for c in ("quality", "toxic"))
    # a left-semi join with each label, its result a mark: ids of a label are distinct, so no row is doubled
    marked = known.join(good.withColumn("good", F.lit(True)), "doc_id", "left").join(toxic.withColumn("toxic", F.lit(True)), "doc_id", "left")
    rows = marked.select("row", "filter", "part", F.col("good").isNotNull().alias("good"), F.col("toxic").isNotNull().alias("toxic"))
    return rows, facts.groupBy("part").agg(F.count("*").alias("documents"))


def removals(failures: DataFrame) -> DataFrame:
    """(part, before, filter, removed, good_lost, toxic_lost): what each filter finds after each set of others.

    ``before`` is the set as its letters in order; combinations without removals have no row.
    """
    spark = failures.sparkSession
    by_id = failures.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row").sortWithinPartitions("row").persist()
    by_id.count()  # only a finished cache tells the planner how its rows are dealt
    found = by_id.withColumn("before", F.lit(""))
    for letter in LETTERS:  # each row once without this filter before its own, once with it
        ids = by_id.where(F.col("filter") == letter).select(F.col("row").alias("_row"))
        both = F.array(F.col("before"), F.concat("before", F.lit(letter)))
        choices = found.withColumn("before", F.explode(F.when(F.col("filter") == letter, F.array("before")).otherwise(both)))
        found = choices.join(ids.hint("merge"), (F.col("row") == F.col("_row")) & F.endswith("before", F.lit(letter)), "left_anti")
    counts = found.groupBy("part", "before", "filter").agg(F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    counted = materialised(counts)
    by_id.unpersist()
    return counted


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null is the empty string), order of the filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Filters: A fewer than 200 words; B less than half of the words distinct; C more than 2 % capitals A-Z; D any of ``#$%&*|``;
    E the same text under a smaller doc_id. A null text is empty. Rows are documents of their own, also if they are
    repeated: rows of equal ids and texts are no copies of each other. A null doc_id is no smaller id and no larger one, and has no label. Of
    repeated labels of an id one that says 1 suffices. Empty tables give no rows.
    """
    failures, parts = failing_ids(docs, labels)
    counts = removals(failures)
    steps = json.dumps([
        {"filter_order": "".join(order), "step": k + 1, "filter": order[k], "before": "".join(sorted(order[:k]))}
        for order in permutations(LETTERS) for k in range(len(LETTERS))
    ])
    plan = parts.select("part", "documents", F.inline(F.from_json(F.lit(steps), "array<struct<filter_order string, step int, filter string, before string>>")))
    named = plan.join(counts, ["part", "filter", "before"], "left").fillna(0, ["removed", "good_lost", "toxic_lost"])
    per_filter = "PARTITION BY part, filter"
    return named.selectExpr(
        "part", "filter_order", "step",
        "documents - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS kept",
        "removed",
        f"max(if(step = 1, removed, 0)) OVER ({per_filter}) - removed AS redundant",
        f"max(if(step = 5, removed, 0)) OVER ({per_filter}) AS unique_fails",
        "good_lost", "toxic_lost",
        f"sum(removed) OVER ({per_filter}) AS shapley",
    )


AUDIT_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), facts AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * len(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM worded
), counts AS (
  SELECT part, mask, count(*) AS n,
    count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
    count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM facts GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step]::INT AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM orders, range(1, 6) t(step)
), seen AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM seen
"""
