import hashlib
import re

import duckdb

from stationgrid.llm import lines, queries


def plain(rows, least):
    """Kept text by (doc_id, text): every run of at least ``least`` words is looked up among all earlier places."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    parts = {d: t.split("\n") for d, (_, t) in enumerate(docs)}
    worded = {d: [(p, x, len(re.findall("[^\x20\x09-\x0D]+", x))) for p, x in enumerate(ls)] for d, ls in parts.items()}
    worded = {d: [w for w in ws if w[2]] for d, ws in worded.items()}
    first, gone = {}, {d: set() for d in parts}
    for d, ws in worded.items():
        for a in range(len(ws)):
            for b in range(a + 1, len(ws) + 1):
                if sum(w[2] for w in ws[a:b]) < least:
                    continue
                body = tuple(w[1] for w in ws[a:b])
                if body in first:
                    gone[d] |= set(range(ws[a][0], ws[b - 1][0] + 1))
                else:
                    first[body] = (d, a)
    return {docs[d]: "\n".join(x for p, x in enumerate(ls) if p not in gone[d]) for d, ls in parts.items()}


def test_equals_brute_force_with_shared_runs(table):
    import random

    rng = random.Random(4)
    pool = [" ".join(f"w{k}{j}" for j in range(rng.randrange(1, 7))) for k in range(14)]
    rows = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    want = plain(rows, 8)
    got = lines.dedup_lines(table(rows), 8).select("doc_id", "text").collect()
    texts = dict(rows)
    assert {r.doc_id: r.text for r in got} == {i: want[i, texts[i]] for i in texts}


def test_matches_sql(spark, sf):
    got = {(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op5_line_dedup(spark, sf).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = "doc_id, n_lines, n_removed, kept_sha256"
    assert got == set(duckdb.sql(f"SELECT {columns} FROM ({queries.ORACLE['op5_line_dedup']})").fetchall())
    assert any(r[2] for r in got)


def test_long_passage_goes_from_later_documents(table):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(15)) for i in range(5))
    rows = [(i, f"own line {i}\n{passage}\nlast line {i}") for i in range(40)] + [(99, "clean and short\nnothing else here")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(table(rows)).collect()}
    assert got[0] == rows[0][1] and got[99] == rows[-1][1]
    assert all(got[i] == f"own line {i}\nlast line {i}" for i in range(1, 40))


def test_odd_rows(odd, table):
    got = lines.dedup_lines(odd, 3).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 8 and by_id[1].text is None and by_id[1].n_lines == 0 and by_id[2].text == ""
    assert [r.text for r in got if r.doc_id == 4] == ["one two three four five"] * 2 and by_id[5].text == ""
    kept = lines.keep_lines(odd, 3)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()} and kept.count() == 7
    assert lines.dedup_lines(table([])).collect() == []
    assert hashlib.sha256(b"").hexdigest()
