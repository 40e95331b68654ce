import numpy as np
import pytest

from stationgrid.operators.knn import nearest, nearest_of_locations
from stationgrid.operators.proximity import remove_buffered


def brute(queries, base, k, exclude_self):
    out = {}
    for qid, qx, qy in queries:
        near = sorted((np.hypot(qx - x, qy - y), bid) for bid, x, y in base if not (exclude_self and bid == qid))
        out[qid] = [(b, round(float(d), 6)) for d, b in near[:k]]
    return out


def collected(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(row["station_id"], []).append((row["nbr_id"], round(row["distance"], 6)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in rows], "station_id long, x_pl double, y_pl double")


def clustered(n, seed):
    """Half of all points within a kilometre or so, the rest spread over a thousand."""
    rng = np.random.default_rng(seed)
    near = rng.normal(0, 500, (n // 2, 2))
    wide = rng.uniform(-5e5, 5e5, (n - n // 2, 2))
    return [(i, *p) for i, p in enumerate(np.vstack([near, wide]))]


@pytest.mark.parametrize("broadcast_rows", [200_000, 1])
def test_clustered_points_equal_brute_force(spark, broadcast_rows):
    rows = clustered(400, 1)
    df = frame(spark, rows)
    got = collected(nearest(df, df, 5, exclude_self=True, leaf_rows=16, broadcast_rows=broadcast_rows, distinct_base=broadcast_rows > 1))
    assert got == brute(rows, rows, 5, True)


def test_far_queries_meet_a_dense_base(spark):
    base = clustered(300, 2)
    queries = [(i, x + 4e5, y) for i, x, y in clustered(120, 3)]
    got = collected(nearest(frame(spark, queries), frame(spark, base), 3, leaf_rows=16))
    assert got == brute(queries, base, 3, False)


def test_shared_locations(spark):
    rows = [(i, i % 5 if i < 200 else 7 * i, i % 3) for i in range(300)]
    df = frame(spark, rows)
    assert collected(nearest_of_locations(df, df, 4, exclude_self=True)) == brute(rows, rows, 4, True)


def test_fewer_points_than_neighbours(spark):
    rows = [(1, 0, 0), (2, 3, 4)]
    df = frame(spark, rows)
    assert collected(nearest(df, df, 10, exclude_self=True)) == {1: [(2, 5.0)], 2: [(1, 5.0)]}


def test_empty_base_gives_no_rows(spark):
    df = frame(spark, [(1, 0, 0)])
    assert nearest(df, df.limit(0), 3).count() == 0


def test_groups_do_not_mix(spark):
    rows = clustered(160, 4)
    rows += [(9001, 0.0, 0.0), (9002, 3.0, 4.0)]  # a snapshot far smaller than a leaf
    df = frame(spark, rows).selectExpr("CASE WHEN station_id > 9000 THEN 3 ELSE station_id % 3 END AS snapshot_id", "*")
    found = nearest(df, df, 2, by=("snapshot_id",), exclude_self=True, leaf_rows=8)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["station_id"], []).append((r["nbr_id"], round(r["distance"], 6)))
    for group in range(4):
        members = [p for p in rows if (3 if p[0] > 9000 else p[0] % 3) == group]
        expected = brute(members, members, 2, True)
        assert {i: got[i] for i in expected} == expected


def test_buffer_keeps_only_distant_candidates(spark):
    keep, candidates = clustered(60, 5), [(1000 + i, x + 2e4, y) for i, x, y in clustered(60, 6)]
    left = remove_buffered(frame(spark, keep), frame(spark, candidates), 30.0)
    expected = {i for i, x, y in candidates if min(np.hypot(x - a, y - b) for _, a, b in keep) >= 30_000}
    assert {r["station_id"] for r in left.collect()} == expected
    same = frame(spark, candidates)
    assert remove_buffered(frame(spark, keep), same, 0.0) is same


def test_lists_equal_brute_force_with_ties_crowds_and_keys(spark, monkeypatch):
    from stationgrid.operators import knn

    monkeypatch.setattr(knn, "GROUP_QUERIES", 16)
    base = clustered(400, 7) + [(900 + i, i % 4, 0.0) for i in range(40)]
    queries = [(i, x + 3.0, y) for i, x, y in clustered(300, 8)] + [(700 + i, 1.0, 0.5) for i in range(60)]
    both = [frame(spark, rows).selectExpr("station_id % 2 AS k", "*", "array(x_pl, y_pl) AS place", "station_id AS own") for rows in (queries, base)]
    got = nearest(*both, 9, by=("k",), payload=("own", "place"), leaf_rows=16, lists=True).collect()
    assert len(got) == len(queries)
    for k in (0, 1):
        want = brute([q for q in queries if q[0] % 2 == k], [p for p in base if p[0] % 2 == k], 9, False)
        found = {r.station_id: r for r in got if r.k == k}
        assert {i: r.nbr_own for i, r in found.items()} == {i: [b for b, _ in near] for i, near in want.items()}
        for r in found.values():
            assert [round(float(np.hypot(r.qx - x, r.qy - y)), 6) for x, y in r.nbr_place] == [d for _, d in want[r.station_id]]


def test_lists_move_points_by_groups_and_take_empty_tables(spark):
    df = frame(spark, clustered(200, 9))
    plan = nearest(df, df, 40, payload=("x_pl",), lists=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("FlatMapCoGroupsInArrow")
    assert nearest(df, df.limit(0), 3, payload=("x_pl",), lists=True).count() == 0
