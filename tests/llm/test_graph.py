import numpy as np
import pytest

from stationgrid.llm import graph, queries, vafile


def plain(vectors, k, every, score):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            best = sorted(((-score(v, w), i) for i, w in vectors.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.fixture()
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.standard_normal(16).tolist() for i in range(700)} | {1000 + i: [0.5] * 16 for i in range(60)}
    bad = [(2000, None), (2020, [1.0, None] * 8), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (2080, []), (None, [1.0] * 16)]
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in [*rows.items(), *bad]], "vec_id long, embedding array<float>, label int, uid string").repartition(4)
    exact = {r.vec_id: [float(x) for x in r.embedding] for r in table.where("vec_id < 2000").collect()}
    return table, exact


def test_recall(vectors):
    table, exact = vectors
    want = plain(exact, 20, 20, lambda a, b: float(np.dot(a, b)))
    got = rows_of(graph.nearest(table))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([float(np.dot(exact[q], exact[i])) for i, _ in found])
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    # equal vectors: all copies but the query's own, the smaller ids first
    assert [i for i, _ in got[1000] if i >= 1000] == [i for i in range(1001, 1060)][: sum(i >= 1000 for i, _ in got[1000])]


def test_graph_search_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_NODES", 100)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = {r.vec_id: list(r.embedding) for r in table.collect()}
    small = graph.Settings(neighbours=12, trees=3, leaf=300, iterations=3, expand=20, keep=40)
    got, want = rows_of(graph.nearest(table, 10, 100, settings=small)), plain(exact, 10, 100, lambda a, b: float(np.dot(a, b)))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_exact_top_k(vectors, monkeypatch):
    monkeypatch.setattr(vafile, "BASE_BLOCK", 50)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 3)
    table, exact = vectors
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in exact.items()}
    assert rows_of(vafile.exact_top_k(table)) == plain(whole, 10, 100, lambda a, b: sum(x * y for x, y in zip(a, b)))


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-1000, 1000, (300, 8)), rng.integers(-1000, 1000, (5, 8))
    who, which, lower, upper = vafile.block_candidates(v // 16, q, 16, 11)
    exact = q @ v.T
    assert ((lower <= exact[who, which]) & (exact[who, which] <= upper)).all()
    for i in range(5):
        assert set(np.argsort(-exact[i])[:11]) <= set(which[who == i])


@pytest.mark.parametrize("op", [graph.nearest, vafile.exact_top_k])
def test_small_and_empty_tables(spark, op):
    schema = "vec_id long, embedding array<float>"
    assert op(spark.createDataFrame([], schema)).collect() == []
    assert op(spark.createDataFrame([(0, [1.0, 2.0])], schema)).collect() == []
    got = op(spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [0.5] * 3), (5, [0.1, 0.1])], schema)).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [3, 7, 5]
    zero = op(spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], schema)).collect()
    assert len(zero) == (0 if op is graph.nearest else 1)


def test_registered_queries_recall(spark, sf):
    exact = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = plain(exact, 20, 20, lambda a, b: float(a @ b))
    got = rows_of(queries.op4_graph_neighbours(spark, sf))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
