import numpy as np
import pandas as pd
import pytest

from stationgrid.operators.paircells import semivariogram_by_cells
from stationgrid.operators.variogram import semivariogram

REACH, LAGS = 5e4, 10


def scattered(n, seed, keys=1):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-6e4, 6e4, (n, 2))
    return pd.DataFrame({"k": np.arange(n) % keys, "station_id": np.arange(n), "x_pl": xy[:, 0], "y_pl": xy[:, 1], "z": 300 + np.sin(xy[:, 0] / 1e4) + rng.normal(size=n)})


def plain(frame):
    x, y, z = (frame[c].to_numpy() for c in ("x_pl", "y_pl", "z"))
    i, j = np.triu_indices(len(frame), 1)
    d, g = np.hypot(x[i] - x[j], y[i] - y[j]), (z[i] - z[j]) ** 2 / 2
    d, g = d[d <= REACH], g[d <= REACH]
    lag = np.minimum((d / (REACH / LAGS)).astype(int), LAGS - 1)
    return {k: ((lag == k).sum(), d[lag == k].mean(), g[lag == k].mean()) for k in np.unique(lag)}


def check(found, want, tolerance=REACH / LAGS / 1000):
    assert {r.lag: r.n_pairs for r in found} == {k: v[0] for k, v in want.items()}
    for r in found:
        assert abs(r.distance - want[r.lag][1]) <= tolerance and r.gamma == pytest.approx(want[r.lag][2], rel=1e-9)


def test_counts_and_gamma_are_exact_and_distances_within_bounds(spark):
    frame = scattered(3000, 1)
    found = semivariogram_by_cells(spark.createDataFrame(frame), "z", LAGS, REACH).collect()
    check(found, plain(frame))
    assert sum(r.formed for r in found) < sum(r.n_pairs for r in found)


def test_share_of_pairs_that_are_formed_falls_with_density(spark):
    shares = []
    for n in (2000, 8000):
        found = semivariogram_by_cells(spark.createDataFrame(scattered(n, 2)), "z", LAGS, REACH, tolerance=200.0).collect()
        shares.append(sum(r.formed for r in found) / sum(r.n_pairs for r in found))
    assert shares[1] < 0.75 * shares[0]


def test_cluster_and_points_at_one_place(spark):
    frame = scattered(200, 3)
    frame.loc[50:149, ["x_pl", "y_pl"]] = 1234.5, -77.0
    frame.loc[150:, "x_pl"] = 20000 + frame.loc[150:, "x_pl"] / 1e6
    frame.loc[150:, "y_pl"] = 100 + frame.loc[150:, "y_pl"] / 1e6
    check(semivariogram_by_cells(spark.createDataFrame(frame), "z", LAGS, REACH).collect(), plain(frame))


def test_keys_missing_values_and_empty_tables(spark):
    frame = scattered(600, 4, keys=3)
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([(0, 9001, None, 1.0, 2.0), (1, 9002, 1.0, 1.0, None)], "k long, station_id long, x_pl double, y_pl double, z double"))
    found = semivariogram_by_cells(df, "z", LAGS, REACH, by=("k",)).collect()
    for k in range(3):
        check([r for r in found if r.k == k], plain(frame[frame.k == k]))
    assert semivariogram_by_cells(df.limit(0), "z", LAGS, REACH).collect() == []
    one = {r.lag: r.n_pairs for r in semivariogram(df.filter("k = 1"), "z", LAGS, REACH).collect()}
    assert one == {r.lag: r.n_pairs for r in found if r.k == 1}


def test_cells_are_opened_in_memory_and_where_spark_splits_them(spark, monkeypatch):
    """The sums do not depend on the level from which a task opens the cells; the pairs of small cells are never a table."""
    from stationgrid.operators import paircells

    frame = scattered(1200, 6)
    df = spark.createDataFrame(frame)
    tables = []
    cut = paircells.cut_lineage
    monkeypatch.setattr(paircells, "cut_lineage", lambda d: (tables.append(cut(d)), tables[-1])[1])
    found = semivariogram_by_cells(df, "z", LAGS, REACH).collect()
    check(found, plain(frame))
    assert max(t.count() for t in tables) < 200
    monkeypatch.setattr(paircells, "BLOCK_POINTS", 100)
    split = {r.lag: r for r in semivariogram_by_cells(df, "z", LAGS, REACH).collect()}
    assert [(r.lag, r.n_pairs, r.formed) for r in found] == [(r.lag, split[r.lag].n_pairs, split[r.lag].formed) for r in found]
    check(list(split.values()), plain(frame))
