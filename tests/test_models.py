import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationgrid.config import AnalysisConfig, TreeConfig
from stationgrid.models.stack import Ensemble, StackModel
from stationgrid.models.trend import ALPHA, HuberTrend
from stationgrid.operators.evaluate import METRICS, compare_models, evaluate, reduce_members
from stationgrid.operators.kriging import KrigingBaseline, KrigingModel, local_predictions, neighbours_to_search, shared_points, shared_predictions
from stationgrid.operators.qc import dynamic_lapse_rate, judge_stations
from stationgrid.operators.split import split_stations
from stationgrid.operators.variogram import PAIRS_PER_TASK, Variogram, _paired_blocks, fit_variogram, fitted_variogram, semivariogram

MODEL = Variogram("exponential", 2.0, 40.0, 0.3)


def points(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 100, (n, 2))
    z = np.sin(xy[:, 0] / 15) + np.cos(xy[:, 1] / 20)
    frame = pd.DataFrame({"station_id": np.arange(n), "x_pl": xy[:, 0], "y_pl": xy[:, 1], "z": z})
    return spark.createDataFrame(frame), frame


def primal(frame, tx, ty):
    """Kriging weights of one target solved directly."""
    x, y, z = (frame[c].to_numpy() for c in ("x_pl", "y_pl", "z"))
    n = len(z)
    system = np.ones((n + 1, n + 1))
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    system[:n, :n] = np.where(d <= 1e-10, 0, -MODEL.gamma(d))
    system[n, n] = 0
    d0 = np.hypot(x - tx, y - ty)
    w = np.linalg.solve(system, np.append(np.where(d0 <= 1e-10, 0, -MODEL.gamma(d0)), 1.0))[:n]
    assert w.sum() == pytest.approx(1.0)
    return float(w @ z)


def test_kriging_is_exact_at_stations(spark):
    df, _ = points(spark)
    got = local_predictions(df, df, "z", MODEL, 12).join(df, "station_id").toPandas()
    assert np.allclose(got["kriged"], got["z"])


def test_local_kriging_with_all_neighbours_equals_global(spark):
    df, frame = points(spark, 40)
    targets = df.selectExpr("station_id", "x_pl + 1.5 AS x_pl", "y_pl + 2.5 AS y_pl")
    got = local_predictions(targets, df, "z", MODEL, 40).join(targets, "station_id").toPandas()
    assert np.allclose(got["kriged"], [primal(frame, a, b) for a, b in zip(got["x_pl"], got["y_pl"])])


def test_every_one_of_many_stations_is_used(spark):
    """Above 3,000 stations each still gives its own value back, by the same method."""
    rng = np.random.default_rng(8)
    n = 3200
    frame = pd.DataFrame({"station_id": range(n), "x_pl": rng.uniform(0, 5e5, n), "y_pl": rng.uniform(0, 5e5, n)})
    frame["temp"] = np.sin(frame["x_pl"] / 6e4) * 5 + np.cos(frame["y_pl"] / 5e4) * 4
    df = spark.createDataFrame(frame).repartition(8)
    config = AnalysisConfig(kriging_neighbors=8)
    model = KrigingModel.fit(df, "temp", "exponential", 20, config, 1)
    assert model.points.count() == n
    got = local_predictions(df, df, "temp", model.model, 8).join(df, "station_id").toPandas()
    assert len(got) == n and np.allclose(got["kriged"], got["temp"], atol=1e-6)


def test_singular_systems_do_not_change_the_others():
    from stationgrid.operators.kriging import _solve

    rng = np.random.default_rng(2)
    systems = rng.standard_normal((5, 3, 3))
    systems[2] = 0
    right = rng.standard_normal((5, 3, 1))
    got = _solve(systems, right)
    for i in (0, 1, 3, 4):
        assert np.allclose(got[i], np.linalg.solve(systems[i], right[i]))
    assert np.allclose(got[2], 0)


def test_variogram_equals_brute_force_across_cells_and_blocks(spark):
    df, frame = points(spark, 90)
    x, y, z = (frame[c].to_numpy() for c in ("x_pl", "y_pl", "z"))
    i, j = np.triu_indices(90, 1)
    d, g = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (z[i] - z[j]) ** 2
    for reach in (d.max() / 5, d.max() / 2, d.max() * 2):
        got = semivariogram(df, "z", 8, reach, block_rows=7).orderBy("lag").toPandas()
        near = d <= reach
        lag = np.minimum((d[near] / (reach / 8)).astype(int), 7)
        n = np.bincount(lag, minlength=8)
        assert list(got["lag"]) == list(np.flatnonzero(n)) and list(got["n_pairs"]) == list(n[n > 0])
        assert np.allclose(got["gamma"], (np.bincount(lag, g[near], 8)[n > 0] / n[n > 0]))


def test_variogram_fit_recovers_noiseless_parameters(spark):
    h = np.linspace(2, 100, 20)
    lags = spark.createDataFrame([(i, float(a), float(MODEL.gamma(np.array(a)))) for i, a in enumerate(h)], "lag int, distance double, gamma double")
    row = fit_variogram(lags, "exponential").first()
    assert row["range"] == pytest.approx(40, rel=0.01) and row["psill"] == pytest.approx(2.0, rel=0.01)
    assert row["nugget"] == pytest.approx(0.3, abs=0.02)


def test_baseline_uses_the_mean_without_a_variogram(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 7.5)], "station_id long, x_pl double, y_pl double, temp double")
    assert KrigingBaseline(AnalysisConfig()).fit(one).predict(one).first()["predicted"] == 7.5


def huber_objective(w, b, sigma, x, y, eps=1.35):
    r = np.abs(y - x @ w - b) / sigma
    loss = np.where(r < eps, r**2, 2 * eps * r - eps**2)
    return np.sum(sigma + loss * sigma) + ALPHA * w @ w


def test_huber_trend_is_at_a_minimum(spark):
    rng = np.random.default_rng(5)
    n = 300
    frame = pd.DataFrame({"dem": rng.uniform(0, 1500, n), "x_pl": rng.uniform(0, 6e5, n)})
    frame["temp"] = 18 - 0.0065 * frame["dem"] + frame["x_pl"] / 3e5 + rng.normal(0, 0.5, n)
    frame.loc[::20, "temp"] += 15
    df = spark.createDataFrame(frame)
    model = HuberTrend.fit(df, ["dem", "x_pl"], {}, 1.35, n)
    w, b = np.array(model.coefficients), model.intercept
    x = np.column_stack([(frame[c] - model.scale.center[c]) / model.scale.spread[c] for c in model.features])
    y = frame["temp"].to_numpy()
    best_sigma = min(np.linspace(0.1, 5, 400), key=lambda s: huber_objective(w, b, s, x, y))
    base = huber_objective(w, b, best_sigma, x, y)
    for step in np.vstack([np.eye(3), -np.eye(3)]) * 0.02:
        assert huber_objective(w + step[:2], b + step[2], best_sigma, x, y) > base - 1e-6
    slope = w[0] / model.scale.spread["dem"]
    assert slope == pytest.approx(-0.0065, abs=2e-4)


CONFIG = AnalysisConfig(trees=TreeConfig(rounds=4, min_leaf_rows=10), ensemble_seeds=(42, 123))


def test_stack_beats_its_trend_and_survives_missing_columns(spark):
    df, frame = points(spark, 150, 9)
    rows = df.selectExpr("station_id", "x_pl", "y_pl", "x_pl * 10 AS dem", "z * 3 AS temp", "sin(x_pl / 15) AS wave", "y_pl AS other")
    model = StackModel.fit(rows, ["wave", "other"], CONFIG, 42)
    assert model.kriging is not None
    assert model.diagnostics["rmse_trees"] < model.diagnostics["rmse_trend"]
    scored = evaluate(model.predict(rows))
    assert scored["RMSE"] < model.diagnostics["rmse_trees"]
    assert model.predict(rows.drop("wave")).filter("predicted IS NULL").count() == 0
    assert sum(w for _, w in model.importance()) == pytest.approx(100.0)


def test_ensemble_predicts_median_and_spread(spark):
    df, _ = points(spark, 120, 10)
    rows = df.selectExpr("station_id", "x_pl", "y_pl", "x_pl * 10 AS dem", "z AS temp", "sin(x_pl / 15) AS wave")
    fitted = Ensemble.fit(rows, ["wave"], CONFIG)
    out = fitted.predict(rows).toPandas()
    assert len(out) == 120 and out["predicted"].notna().all() and (out["iqr_sigma"] >= 0).all()
    names = [r["feature"] for r in fitted.importance(spark).collect()]
    assert names[0] == "wave" and set(names[1:]) == {"[S1] dem", "[S1] y_pl", "[S1] x_pl"}


def test_shared_search_equals_one_search_per_model(spark, monkeypatch):
    from stationgrid.operators import kriging

    df, frame = points(spark, 300, 4)
    # the thinnest model has few points, far from most targets, so that the first search is too narrow
    kept = [F.col("station_id") % 20 != 3, F.col("station_id") % 20 != 7, F.col("x_pl") > 70]
    fitted = [KrigingModel(df.filter(c), "z", MODEL, 12) for c in kept] + [None]
    table = shared_points(fitted, df)
    assert table.count() == df.filter(kept[0] | kept[1] | kept[2]).count()
    targets = df.select((F.col("station_id") + 1000).alias("cell_id"), (F.col("x_pl") + 0.3).alias("x"), (F.col("y_pl") - 0.2).alias("y"))
    searches = []
    search = kriging.nearest
    monkeypatch.setattr(kriging, "nearest", lambda q, b, k, **o: (searches.append(k), search(q, b, k, **o))[1])
    found = {r.cell_id: r.kriged for r in shared_predictions(targets, table, [*(m.model for m in fitted[:3]), None], 12, 0.95, "cell_id", "x", "y").collect()}
    assert len(found) == 300 and len(searches) > 1 and searches[0] == neighbours_to_search(12, 0.95)
    monkeypatch.undo()
    for i, model in enumerate(fitted[:3]):
        for r in model.predict(targets, "k", "cell_id", "x", "y").collect():
            assert found[r.cell_id][i] == pytest.approx(r.k, abs=1e-9)
    assert {v[3] for v in found.values()} == {None}


def test_shared_search_with_fewer_points_than_neighbours(spark):
    df, _ = points(spark, 9, 5)
    fitted = [KrigingModel(df.filter("station_id < 5"), "z", MODEL, 30), KrigingModel(df.filter("station_id > 3"), "z", MODEL, 30)]
    found = {r.station_id: r.kriged for r in shared_predictions(df, shared_points(fitted, df), [MODEL, MODEL], 30, 0.95).collect()}
    own = {r.station_id: r.z for r in df.collect()}
    assert found[2][0] == pytest.approx(own[2]) and found[7][1] == pytest.approx(own[7]) and found[4] == pytest.approx([own[4]] * 2)


def test_member_reduction_uses_sorted_positions(spark):
    df = spark.createDataFrame([(5.0, 1.0, 4.0, 2.0, 3.0)], "a double, b double, c double, d double, e double")
    row = reduce_members(df, ["a", "b", "c", "d", "e"]).first()
    assert row["predicted"] == 3.0 and row["iqr_sigma"] == pytest.approx((4.0 - 2.0) / 1.35)


def test_scores_need_a_complete_pair(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "temp double, predicted double")
    with pytest.raises(Exception, match="no valid prediction pairs"):
        evaluate(df)


def test_comparison_flags(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1.0), (1.0, 0.0, 0.5), (2.0, 5.0, 2.0)], "temp double, base double, new double")
    rows = {r["metric"]: r for r in compare_models(df, "temp", "base", "new").collect()}
    assert set(rows) == set(METRICS)
    assert rows["MAE"]["passed"] and rows["MAE"]["pct_improvement"] == pytest.approx(75.0)
    assert not rows["Min Error"]["passed"] and rows["Min Error"]["better"]


def stations_on_a_slope(spark, n=80):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"station_id": np.arange(n), "x_pl": rng.uniform(0, 1e5, n), "y_pl": rng.uniform(0, 1e5, n), "dem": rng.uniform(0, 1000, n)})
    frame["temp"] = 20 - 0.007 * frame["dem"]
    frame["source"] = np.where(frame["station_id"] % 2 == 0, "IMGW", "TRAX")
    frame["isModel"] = np.where(frame["source"] == "IMGW", False, None)
    frame.loc[frame["station_id"].isin([3, 4]), "temp"] += 9
    return spark.createDataFrame(frame, "station_id long, x_pl double, y_pl double, dem double, temp double, source string, isModel boolean")


def test_quality_control_flags_the_fault_but_not_a_trusted_one(spark):
    df = stations_on_a_slope(spark)
    config = AnalysisConfig()
    rate = dynamic_lapse_rate(df, config)
    assert rate == pytest.approx(0.007, abs=3e-4)
    flagged = {r["station_id"] for r in judge_stations(df, rate, config).filter("is_outlier").collect()}
    assert flagged == {3}


def test_lapse_rate_falls_back(spark):
    df = stations_on_a_slope(spark)
    config = AnalysisConfig()
    assert dynamic_lapse_rate(df.drop("isModel"), config) == config.standard_lapse_rate
    assert dynamic_lapse_rate(df.drop("dem"), config) == config.standard_lapse_rate
    assert dynamic_lapse_rate(df.filter("station_id < 20"), config) == config.standard_lapse_rate
    assert dynamic_lapse_rate(df.withColumn("dem", F.col("dem") / 10), config) == config.standard_lapse_rate
    assert dynamic_lapse_rate(df.withColumn("temp", F.col("dem") * 0.1), config) == config.standard_lapse_rate


def test_split_keeps_distance_and_fails_when_a_part_is_empty(spark):
    df = stations_on_a_slope(spark)
    parts = split_stations(df, AnalysisConfig(buffer_km=3.0)).join(df, "station_id").toPandas()
    assert (parts["part"] == "test").sum() == 12
    xy = {p: parts.loc[parts["part"] == p, ["x_pl", "y_pl"]].to_numpy() for p in ("train", "val", "test")}
    for a, b in (("train", "test"), ("train", "val"), ("val", "test")):
        d = np.hypot(xy[a][:, None, 0] - xy[b][None, :, 0], xy[a][:, None, 1] - xy[b][None, :, 1])
        assert d.min() >= 3000
    with pytest.raises(ValueError, match="split left no rows"):
        split_stations(df, AnalysisConfig(buffer_km=500.0))


def test_stack_without_a_screened_out_trend_feature(spark):
    """A raster that covers few stations leaves no height to fit; the other features still give a trend."""
    df, _ = points(spark, 80, 6)
    rows = df.selectExpr("station_id", "x_pl", "y_pl", "0.1 * x_pl - 0.05 * y_pl AS temp", "x_pl * y_pl AS wave")
    config = AnalysisConfig(trees=TreeConfig(rounds=1, min_leaf_rows=5), residual_kriging=False)
    model = StackModel.fit(rows, ["wave"], config, 1)
    assert model.trend.coefficients[0] == 0.0
    got = rows.withColumn("trend", model.trend.column(rows)).toPandas()
    assert np.allclose(got["trend"], got["temp"], atol=0.05)


def test_pairs_of_blocks_are_spread_and_read_written_points(spark):
    """Positions that are costly expressions are computed once, and pairs of blocks go to tasks by their number, not by their bytes."""
    df = spark.range(400).selectExpr("id AS station_id", "sin(id) * 1e4 AS x_pl", "cos(id * 3) * 1e4 AS y_pl", "CAST(id % 17 AS DOUBLE) AS z")
    blocks = _paired_blocks(df, "z", 5e3, "station_id", 10)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "SIN(" not in plan.upper() and "Range (0, 400" not in plan
    pairs = blocks.select("_cx", "_cy", "_block", "_ox", "_oy", "_other").distinct().count()
    assert pairs > 5 * PAIRS_PER_TASK and blocks.rdd.getNumPartitions() >= pairs // PAIRS_PER_TASK
    assert "FlatMapGroupsInArrow" in semivariogram(df, "z", 8, 5e3)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_at_the_reach_count_in_the_last_lag(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 300.0, 0.0, 3.0), (3, 300.001, 400.0, 9.0)], "station_id long, x_pl double, y_pl double, z double")
    got = {row.lag: (row.n_pairs, row.gamma) for row in semivariogram(df, "z", 3, 300.0).collect()}
    assert got == {2: (1, 2.0)}
