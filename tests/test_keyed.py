import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stationgrid.config import AnalysisConfig
from stationgrid.models.robust import ALPHA, huber_fits
from stationgrid.models.trend import KeyedTrends
from stationgrid.operators import qc
from stationgrid.operators.variogram import fit_variogram, semivariogram

EPSILON = 1.35


def groups(sizes, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for k, n in enumerate(sizes):
        x = rng.normal(size=(n, 2))
        parts.append(pd.DataFrame({"k": f"g{k}", "u": x[:, 0], "v": 50 * x[:, 1], "y": 3 + k + x @ [1.5, -2] + rng.standard_t(1.5, size=n)}))
    return pd.concat(parts, ignore_index=True)


def loss(frame, b, c, s):
    z = np.abs(frame.y - frame[["u", "v"]].to_numpy() @ b - c) / s
    return float((s + s * np.where(z <= EPSILON, z**2, 2 * EPSILON * z - EPSILON**2)).sum() + ALPHA * np.dot(b, b))


def test_every_group_is_at_its_minimum_whatever_its_size(spark):
    frame = groups([40, 4000, 300, 25])
    fits = huber_fits(spark.createDataFrame(frame).repartition(7), ["u", "v"], "y", ["k"], EPSILON).collect()
    assert {r.k: r.n for r in fits} == dict(frame.groupby("k").size()) and all(r.settled for r in fits)
    for r in fits:
        mine, b = frame[frame.k == r.k], np.array(r.coefficients)
        least = loss(mine, b, r.intercept, r.scale)
        for moved in np.vstack([np.eye(4), -np.eye(4)]) * 1e-3:
            assert least <= loss(mine, b + moved[:2], r.intercept + moved[2], r.scale * (1 + moved[3])) + 1e-9


def test_groups_do_not_touch_each_other(spark):
    frame = groups([60, 90], seed=3)
    both = {r.k: r for r in huber_fits(spark.createDataFrame(frame), ["u", "v"], "y", ["k"], EPSILON).collect()}
    for k, mine in frame.groupby("k"):
        one = huber_fits(spark.createDataFrame(mine), ["u", "v"], "y", [], EPSILON).first()
        assert one.coefficients == pytest.approx(both[k].coefficients, rel=1e-9) and one.scale == pytest.approx(both[k].scale, rel=1e-9)


def test_planes_short_groups_and_missing_values(spark):
    rows = [("plane", float(i), float(i * i % 7), 2.0 * i + 1.0) for i in range(30)] + [("one", 1.0, 2.0, 3.0), (None, 1.0, 1.0, 1.0), ("gone", None, 1.0, 1.0), ("one", float("nan"), 0.0, 9.0)]
    found = {r.k: r for r in huber_fits(spark.createDataFrame(rows, "k string, u double, v double, y double"), ["u", "v"], "y", ["k"], EPSILON).collect()}
    assert set(found) == {"plane", "one"} and found["one"].n == 1
    assert found["plane"].coefficients == pytest.approx([2.0, 0.0], abs=1e-6) and found["plane"].intercept == pytest.approx(1.0, abs=1e-5)
    empty = spark.createDataFrame([], "k string, u double, v double, y double")
    assert huber_fits(empty, ["u", "v"], "y", ["k"], EPSILON).collect() == []


def archive(spark):
    rng = np.random.default_rng(5)
    rows = []
    for snapshot, rate in ((1, 0.0065), (2, 0.009), (3, 0.05), (4, 0.0065)):
        n = 8 if snapshot == 4 else 40
        rows += [(snapshot, i, "IMGW", i % 5 == 0, float(30 * i), 20 - rate * 30 * i + float(rng.normal()) * 0.05 + (15.0 if i == 7 else 0.0), float(i * 1000), 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "snapshot int, station_id long, source string, isModel boolean, dem double, temp double, x_pl double, y_pl double")


def test_lapse_rates_of_an_archive(spark):
    rates = {r.snapshot: r for r in qc.dynamic_lapse_rates(archive(spark), AnalysisConfig(), ("snapshot",)).collect()}
    assert rates[1].lapse_rate == pytest.approx(0.0065, abs=2e-4) and rates[2].lapse_rate == pytest.approx(0.009, abs=2e-4)
    assert rates[3].lapse_rate == 0.0065 and rates[4].lapse_rate == 0.0065 and rates[4].n_trusted == 6  # implausible; too few
    plain = qc.dynamic_lapse_rates(archive(spark).drop("isModel"), AnalysisConfig(), ("snapshot",)).collect()
    assert {(r.n_trusted, r.lapse_rate) for r in plain} == {(0, 0.0065)}


def test_each_snapshot_is_judged_with_its_own_rate(spark):
    rows, config = archive(spark), AnalysisConfig()
    rates = qc.dynamic_lapse_rates(rows, config, ("snapshot",))
    together = {(r.snapshot, r.station_id): r.expected for r in qc.neighbour_consensus(rows, rates, config, by=("snapshot",)).collect()}
    for r in rates.filter("snapshot < 3").collect():
        alone = qc.neighbour_consensus(rows.filter(F.col("snapshot") == r.snapshot), r.lapse_rate, config).collect()
        assert {(r.snapshot, a.station_id): pytest.approx(a.expected) for a in alone} == {k: v for k, v in together.items() if k[0] == r.snapshot}


def test_standard_rate_where_the_solver_fails(spark, monkeypatch):
    from pyspark.errors import IllegalArgumentException

    def fail(self, data):
        raise IllegalArgumentException("no convergence")

    monkeypatch.setattr(LinearRegression, "fit", fail)
    assert qc.dynamic_lapse_rate(archive(spark).filter("snapshot = 2"), AnalysisConfig()) == 0.0065


def test_trends_of_keys_and_of_keys_without_rows(spark):
    frame = groups([50, 80], seed=7)
    df = spark.createDataFrame(frame)
    trends = KeyedTrends.fit(df, ["u", "v"], {"u": 0.0, "v": 0.0}, EPSILON, ["k"], label="y")
    other = spark.createDataFrame([("g0", 1.0, 2.0), ("new", 1.0, 2.0)], "k string, u double, v double")
    found = {r.k: r.trend for r in trends.predict(other).collect()}
    direct = {r.k: r for r in huber_fits(df, ["u", "v"], "y", ["k"], EPSILON).collect()}["g0"]
    assert found["new"] is None and found["g0"] == pytest.approx(direct.coefficients[0] + 2 * direct.coefficients[1] + direct.intercept, abs=1e-4)


def test_variograms_of_keys(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"k": np.arange(400) % 3, "station_id": np.arange(400), "x_pl": rng.uniform(0, 9e4, 400), "y_pl": rng.uniform(0, 9e4, 400), "z": 0.0})
    frame["z"] = np.sin(frame.x_pl / 2e4) + np.cos(frame.y_pl / 3e4)
    df = spark.createDataFrame(frame)
    together = semivariogram(df, "z", 8, 4e4, by=("k",), block_rows=20).collect()
    fits = {r.k: r for r in fit_variogram(semivariogram(df, "z", 8, 4e4, by=("k",)), "spherical", by=("k",)).collect()}
    for k in range(3):
        mine = df.filter(F.col("k") == k)
        alone = {r.lag: (r.n_pairs, r.distance, r.gamma) for r in semivariogram(mine, "z", 8, 4e4).collect()}
        assert {r.lag: (r.n_pairs, pytest.approx(r.distance), pytest.approx(r.gamma)) for r in together if r.k == k} == alone
        one = fit_variogram(semivariogram(mine, "z", 8, 4e4), "spherical").first()
        assert (one.psill, one.range, one.nugget) == pytest.approx((fits[k].psill, fits[k].range, fits[k].nugget))
