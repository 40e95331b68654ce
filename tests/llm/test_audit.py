import re
from itertools import permutations

import duckdb

from stationgrid.llm import audit, queries

FILTERS = {
    "A": lambda t: len(words(t)) < 200,
    "B": lambda t: 100 * len(set(words(t))) < 50 * len(words(t)),
    "C": lambda t: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
    "D": lambda t: bool(re.search("[#$%&*|]", t)),
}


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text)


def plain(rows, good, toxic):
    """Rows of (doc_id, text, source): every order applied to the texts one filter after the other."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    fails = [{f for f, test in FILTERS.items() if test(t)} | ({"E"} if any(i is not None and j is not None and j < i and t == u for j, u, _ in rows) else set()) for i, t, _ in rows]
    out = {}
    for part in {s for *_, s in rows}:
        mine = [(i, bad) for (i, _, s), bad in zip(rows, fails, strict=True) if s == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in bad for _, bad in mine) - len(gone), sum(bad == {f} for _, bad in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
    sums = {}
    for (part, order, k), row in out.items():
        sums[part, order[k - 1]] = sums.get((part, order[k - 1]), 0) + row[1]
    return {(part, order, k): (*row, sums[part, order[k - 1]]) for (part, order, k), row in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_matches_sql(spark, sf):
    for table in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.op13_filter_audit(spark, sf)
    want = duckdb.sql(queries.ORACLE["op13_filter_audit"])
    assert got.columns == want.columns
    assert {tuple(r) for r in got.collect()} == set(want.fetchall())


def test_equals_each_order_applied_in_turn(spark, table):
    long = " ".join(f"word{i}" for i in range(220))
    texts = [long, long + " |", long.upper(), "short", "short", "Short # A", " ".join(["same"] * 300), " ".join(["same"] * 300) + " %", None, "", " \n", None, "x" * 200_000]
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts * 3, ["a", "b", None, "a", ""] * 9, strict=False))]
    rows += [(None, "short", "a"), (None, long, "b"), (3, "short", "a"), (4, "other | text", None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0), "extra") for i in range(25)] + [(1, 1, 0, ""), (0, 0, 0, ""), (99, 1, 1, ""), (None, 1, 1, "")], "doc_id long, quality int, toxic int, filter string")
    good = {r.doc_id for r in labels.collect() if r.quality == 1} - {None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1} - {None}
    assert result(audit.filter_audit(table(rows), labels)) == plain(rows, good, toxic)


def test_hot_copies_and_empty_tables(spark, table):
    rows = [(i, "a common text", "web") for i in range(3000)] + [(5000 + i, f"text {i} &", "web") for i in range(500)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = result(audit.filter_audit(table(rows), none))
    assert got["web", "EDABC", 1] == (501, 2999, 0, 0, 0, 0, 2999 * 60) and got["web", "EDABC", 2][:3] == (1, 500, 0)
    assert audit.filter_audit(table([]), none).collect() == []
