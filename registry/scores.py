"""Scores, comparisons, distributions and variograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import (
    MEMBERS,
    SQL_DEM,
    WITH_METRIC,
    WITH_SNAPSHOTS,
    WITH_PREDICTIONS,
    WITH_STATIONS,
    dem_pixels,
    metric_stations,
    predictions,
    r,
    snapshots,
    stations,
    table,
)
from stationgrid.functions.cleaning import mask_nodata
from stationgrid.operators.evaluate import (
    axis_range,
    compare_models,
    error_histogram,
    extrapolation_check,
    field_stats,
    metric_table,
    observed_vs_predicted,
    reduce_member_rows,
    reduce_members,
    stage_diagnostics,
    summarise_importance,
    top_features,
    uncertainty_summary,
    with_trend_rows,
)
from stationgrid.operators.paircells import semivariogram_by_cells
from stationgrid.operators.variogram import fit_variogram, semivariogram
from stationgrid.session import cut_lineage

MODELS = {"base": "base", "new": "new"}


def _metrics_sql(column: str) -> str:
    e = f"({column} - temp)"
    where = f"FROM preds WHERE {column} IS NOT NULL"
    r2 = f"1 - sum({e} * {e}) / (SELECT sum(power(temp - (SELECT avg(temp) {where}), 2)) {where})"
    exprs = {"MAE": f"avg(abs({e}))", "RMSE": f"sqrt(avg({e} * {e}))", "R²": r2, "Bias": f"avg({e})",
             "Min Error": f"min({e})", "Max Error": f"max({e})"}
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {x} AS v {where}" for m, x in exprs.items())


_COMPARE = f"{WITH_PREDICTIONS}, b AS ({_metrics_sql('base')}), n AS ({_metrics_sql('new')})"


@query("AGG4", f"{_COMPARE} SELECT metric, round(b.v, 6) AS base, round(n.v, 6) AS new FROM b JOIN n USING (metric)")
def metrics(spark, sf):
    return metric_table(predictions(spark, sf), "temp", MODELS).select("metric", r("base"), r("new"))


@query("AGG5", f"""{_COMPARE}, j AS (SELECT metric, b.v AS b, n.v AS n, CASE WHEN metric = 'R²' THEN n.v - b.v ELSE b.v - n.v END AS g FROM b JOIN n USING (metric))
    SELECT metric, round(b, 6) AS base, round(n, 6) AS new, round(g, 6) AS improvement,
      round(CASE WHEN metric = 'R²' THEN 100 * g WHEN metric = 'Bias' THEN abs(b) - abs(n) WHEN b = 0 THEN 0 ELSE 100 * g / b END, 6) AS pct_improvement,
      CASE WHEN metric = 'Bias' THEN abs(n) < abs(b) ELSE g > 0 END AS passed,
      CASE WHEN metric IN ('Bias', 'Min Error', 'Max Error') THEN abs(n) < abs(b) ELSE g > 0 END AS better FROM j""")
def comparison(spark, sf):
    return compare_models(predictions(spark, sf), "temp", "base", "new").select(
        "metric", r("base"), r("new"), r("improvement"), r("pct_improvement"), "passed", "better"
    )


_LONG = " UNION ALL ".join(f"SELECT station_id, '{m}' AS model, temp AS observed, {m} AS predicted, {m} - temp AS error FROM preds WHERE {m} IS NOT NULL" for m in MODELS)


@query("PRJ18", f"{WITH_PREDICTIONS}, l AS ({_LONG}) SELECT station_id, model, round(observed, 6) AS observed, round(predicted, 6) AS predicted, round(error, 6) AS error FROM l")
def prediction_pairs(spark, sf):
    pairs = observed_vs_predicted(predictions(spark, sf), "temp", MODELS, ["station_id"])
    return pairs.select("station_id", "model", r("observed"), r("predicted"), r("error"))


@query("PRJ18_axis", f"""{WITH_PREDICTIONS}, l AS ({_LONG}) SELECT model, round(least(min(observed), min(predicted)), 6) AS axis_min,
    round(greatest(max(observed), max(predicted)), 6) AS axis_max FROM l GROUP BY model""")
def plot_range(spark, sf):
    pairs = observed_vs_predicted(predictions(spark, sf), "temp", MODELS, ["station_id"])
    return axis_range(pairs).select("model", r("axis_min"), r("axis_max"))


# errors in steps that never fall on a bin edge
_HIST_ERROR = "(c_acctbal * 7 + c_custkey) / 1000E0"


@query("AGG9", f"""WITH e AS (SELECT 'a' AS model, {_HIST_ERROR} AS error FROM customer UNION ALL SELECT 'b', c_acctbal / 321E0 FROM customer),
    s AS (SELECT model, min(error) AS lo, max(error) AS hi FROM e GROUP BY model)
    SELECT model, CAST(least(floor((error - lo) / (hi - lo) * 30), 29) AS INT) AS bin, count(*) AS n FROM e JOIN s USING (model) GROUP BY 1, 2""")
def histogram(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("0E0 AS truth", f"{_HIST_ERROR} AS a", "c_acctbal / 321E0 AS b")
    return error_histogram(rows, "truth", {"a": "a", "b": "b"})


_MEMBER_ROWS = " UNION ALL ".join(f"SELECT station_id, m{m} AS p FROM preds" for m in MEMBERS)
_REDUCED = f"""{WITH_PREDICTIONS}, l AS ({_MEMBER_ROWS}) SELECT station_id, round(quantile_cont(p, 0.5), 6) AS predicted,
    round((quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) / 1.35, 6) AS iqr_sigma FROM l GROUP BY station_id"""


@query("AGG10", _REDUCED)
def reduced_members(spark, sf):
    return reduce_members(predictions(spark, sf), [f"m{m}" for m in MEMBERS]).select("station_id", r("predicted"), r("iqr_sigma"))


@query("AGG10_rows", _REDUCED)
def reduced_member_rows(spark, sf):
    pairs = F.array(*[F.struct(F.lit(m).alias("member"), F.col(f"m{m}").alias("p")) for m in MEMBERS])
    rows = predictions(spark, sf).select("station_id", F.inline(pairs))
    return reduce_member_rows(rows, "station_id", "p").select("station_id", r("predicted"), r("iqr_sigma"))


def _dem(spark, sf):
    return dem_pixels(spark, sf).select("r", "c", mask_nodata(F.col("value"), -9999.0).alias("value"))


@query("AGG6", f"WITH {SQL_DEM} SELECT min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean_value, count(v) AS valid_pixels FROM dem")
def grid_statistics(spark, sf):
    return field_stats(_dem(spark, sf), "value").select("min_value", "max_value", r("mean_value"), "valid_pixels")


@query("AGG8", f"WITH {SQL_DEM} SELECT round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.98), 6) AS p98, round(avg(v), 6) AS mean FROM dem")
def field_percentiles(spark, sf):
    return uncertainty_summary(_dem(spark, sf), "value").select(r("p95"), r("p98"), r("mean"))


@query("AGG14", f"""{WITH_PREDICTIONS} SELECT round(sqrt(avg(power(base - temp, 2))), 6) AS rmse_trend, round(sqrt(avg(power(new - temp, 2))), 6) AS rmse_trees,
    round(1 - var_pop(new - temp) / (var_pop(base - temp) + 1e-10), 6) AS r2_trees, count(new) AS n_rows FROM preds""")
def diagnostics(spark, sf):
    rows = predictions(spark, sf).select((F.col("base") - F.col("temp")).alias("a"), (F.col("new") - F.col("temp")).alias("b"))
    return stage_diagnostics(rows, "a", "b").select(r("rmse_trend"), r("rmse_trees"), r("r2_trees"), "n_rows")


@query("AGG15", f"""{WITH_STATIONS}, {SQL_DEM}, g AS (SELECT min(v) AS grid_min, max(v) AS grid_max FROM dem), s AS (SELECT min(temp) AS lo, max(temp) AS hi FROM stations)
    SELECT grid_min, grid_max, round(lo, 6) AS station_min, round(hi, 6) AS station_max, grid_min < lo - 15 OR grid_max > hi + 15 AS extreme FROM g, s""")
def extrapolation(spark, sf):
    return extrapolation_check(_dem(spark, sf), "value", stations(spark, sf), 15.0).select(
        "grid_min", "grid_max", r("station_min"), r("station_max"), "extreme"
    )


# ---------------------------------------------------------------- importance
def member_importance(spark, sf):
    """Importance rows: a part type is a feature, a brand an ensemble member."""
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("feature"), F.col("p_brand").alias("member")).agg(
        F.sum("p_size").cast("double").alias("importance")
    )


_IMPORTANCE = """imp AS (SELECT p_type AS feature, p_brand AS member, CAST(sum(p_size) AS DOUBLE) AS importance FROM part GROUP BY 1, 2),
    agg AS (SELECT feature, avg(importance) AS importance, stddev_samp(importance) AS importance_std FROM imp GROUP BY 1)"""
_TREND = " UNION ALL ".join(f"SELECT '[S1] {f}', NULL, NULL" for f in ("dem", "y_pl", "x_pl"))


@query("AGG17", f"WITH {_IMPORTANCE} SELECT feature, round(importance, 6) AS importance, round(importance_std, 6) AS importance_std FROM agg")
def importance_summary(spark, sf):
    return summarise_importance(member_importance(spark, sf)).select("feature", r("importance"), r("importance_std"))


@query("SET2", f"WITH {_IMPORTANCE} SELECT feature, round(importance, 6) AS importance, round(importance_std, 6) AS importance_std FROM agg UNION ALL {_TREND}")
def importance_with_trend(spark, sf):
    table_ = with_trend_rows(summarise_importance(member_importance(spark, sf)), ("dem", "y_pl", "x_pl"))
    return table_.select("feature", r("importance"), r("importance_std"))


@query("TOP2", f"WITH {_IMPORTANCE}, w AS (SELECT feature, importance FROM agg UNION ALL {_TREND.replace(', NULL, NULL', ', NULL')}) SELECT feature, round(importance, 6) AS importance FROM w ORDER BY w.importance DESC NULLS LAST, feature LIMIT 3")
def top_three(spark, sf):
    table_ = with_trend_rows(summarise_importance(member_importance(spark, sf)), ("dem", "y_pl", "x_pl"))
    return top_features(table_, 3).select("feature", r("importance"))


# ---------------------------------------------------------------- variogram
REACH = 200_000.0


def _lags_sql(n: int) -> str:
    return f"""pr AS (SELECT sqrt(power(a.x_pl - b.x_pl, 2) + power(a.y_pl - b.y_pl, 2)) AS d, 0.5E0 * power(a.temp - b.temp, 2) AS g
        FROM proj a JOIN proj b ON a.station_id < b.station_id),
      lags AS (SELECT CAST(least(floor(d / ({REACH} / {n})), {n - 1}) AS INT) AS lag, count(*) AS n_pairs, avg(d) AS distance, avg(g) AS gamma
        FROM pr WHERE d <= {REACH} GROUP BY 1)"""


@query("AGG16", f"{WITH_METRIC}, {_lags_sql(20)} SELECT lag, n_pairs, round(distance, 3) AS distance, round(gamma, 6) AS gamma FROM lags")
def variogram_lags(spark, sf):
    return semivariogram(metric_stations(spark, sf), "temp", 20, REACH).select("lag", "n_pairs", r("distance", 3), r("gamma"))


@query("AGG16_cells", f"{WITH_METRIC}, {_lags_sql(20)} SELECT lag, n_pairs, true AS near_mean, round(gamma, 6) AS gamma FROM lags")
def variogram_lags_by_cells(spark, sf):
    """Pairs counted by pairs of cells; mean distances within a thousandth of a lag of those of single pairs."""
    s = metric_stations(spark, sf)
    exact = semivariogram(s, "temp", 20, REACH).select("lag", F.col("distance").alias("mean"))
    near = F.abs(F.col("distance") - F.col("mean")) <= REACH / 20 / 1000
    return semivariogram_by_cells(s, "temp", 20, REACH).join(exact, "lag").select("lag", "n_pairs", near.alias("near_mean"), r("gamma"))


_SHAPE = {
    "exponential": "1 - exp(-3 * distance / reach)",
    "spherical": "CASE WHEN distance <= reach THEN 1.5E0 * distance / reach - 0.5E0 * power(distance / reach, 3) ELSE 1E0 END",
}


def _score_sql(source: str, out: str, kind: str) -> str:
    return f"""{out}_f AS (SELECT reach, max_d, max_g, distance, gamma, {_SHAPE[kind]} AS f FROM {source}, lags),
    {out}_l AS (SELECT reach, max_d, max_g, regr_slope(gamma, f) AS slope, regr_intercept(gamma, f) AS icpt, sum(f * gamma) AS fg, sum(f) AS sf, sum(f * f) AS ff
      FROM {out}_f GROUP BY 1, 2, 3),
    {out}_n AS (SELECT *, greatest(least(icpt, max_g), 0) AS nugget FROM {out}_l),
    {out}_p AS (SELECT *, greatest(least(CASE WHEN nugget = icpt THEN slope ELSE (fg - nugget * sf) / ff END, 10 * max_g), 0) AS psill FROM {out}_n),
    {out} AS (SELECT p.reach, psill, nugget, p.max_d, p.max_g, sum(2 * (sqrt(1 + power(psill * f + nugget - gamma, 2)) - 1)) AS loss
      FROM {out}_p p JOIN {out}_f q ON q.reach = p.reach GROUP BY 1, 2, 3, 4, 5)"""


def _fit_sql(kind: str) -> str:
    return f"""{WITH_METRIC}, {_lags_sql(20)}, top AS (SELECT max(distance) AS max_d, max(gamma) AS max_g FROM lags),
    c1 AS (SELECT max_d * i / 64 AS reach, max_d, max_g FROM top, LATERAL (SELECT unnest(range(1, 65)) AS i) g), {_score_sql('c1', 's1', kind)},
    best AS (SELECT * FROM s1 ORDER BY loss, reach LIMIT 1),
    c2 AS (SELECT * FROM (SELECT reach + max_d / 64 * j / 32 AS reach, max_d, max_g FROM best, LATERAL (SELECT unnest(range(-32, 33)) AS j) g) q WHERE reach > 0 AND reach <= max_d),
    {_score_sql('c2', 's2', kind)}
    SELECT round(psill, 4) AS psill, round(reach, 1) AS range, round(nugget, 4) AS nugget, round(loss, 4) AS loss FROM s2 ORDER BY s2.loss, reach LIMIT 1"""


def _fitted(spark, sf, kind):
    fitted = fit_variogram(semivariogram(metric_stations(spark, sf), "temp", 20, REACH), kind)
    return fitted.select(r("psill", 4), r("range", 1), r("nugget", 4), r("loss", 4))


@query("KRG3", _fit_sql("exponential"))
def variogram_fit(spark, sf):
    return _fitted(spark, sf, "exponential")


@query("KRG3_spherical", _fit_sql("spherical"))
def spherical_fit(spark, sf):
    return _fitted(spark, sf, "spherical")


# ---------------------------------------------------------------- variograms of an archive
_SNAPSHOT_LAGS = f"""pr AS (SELECT a.snapshot, sqrt(power(a.x_pl - b.x_pl, 2) + power(a.y_pl - b.y_pl, 2)) AS d, 0.5E0 * power(a.temp - b.temp, 2) AS g
        FROM snaps a JOIN snaps b ON a.snapshot = b.snapshot AND a.station_id < b.station_id),
      lags AS (SELECT snapshot, CAST(least(floor(d / ({REACH} / 20)), 19) AS INT) AS lag, count(*) AS n_pairs, avg(d) AS distance, avg(g) AS gamma
        FROM pr WHERE d <= {REACH} GROUP BY 1, 2)"""


@query("AGG16_snapshots", f"{WITH_SNAPSHOTS}, {_SNAPSHOT_LAGS} SELECT snapshot, lag, n_pairs, round(distance, 3) AS distance, round(gamma, 6) AS gamma FROM lags")
def variogram_lags_of_snapshots(spark, sf):
    return semivariogram(snapshots(spark, sf), "temp", 20, REACH, by=("snapshot",)).select("snapshot", "lag", "n_pairs", r("distance", 3), r("gamma"))


@query("KRG3_snapshots", f"{WITH_SNAPSHOTS} SELECT DISTINCT snapshot, true AS as_alone FROM snaps")
def variogram_fits_of_snapshots(spark, sf):
    """All snapshots' variograms fitted in one job, each beside a fit of its rows alone."""
    rows = cut_lineage(snapshots(spark, sf))
    together = fit_variogram(semivariogram(rows, "temp", 20, REACH, by=("snapshot",)), "exponential", by=("snapshot",))
    alone = None
    for (snapshot,) in rows.select("snapshot").distinct().collect():
        one = fit_variogram(semivariogram(rows.filter(F.col("snapshot") == snapshot), "temp", 20, REACH), "exponential")
        one = one.select(F.lit(snapshot).alias("snapshot"), *(F.col(c).alias(f"{c}_1") for c in one.columns))
        alone = one if alone is None else alone.unionByName(one)
    same = [F.abs(F.col(c) - F.col(f"{c}_1")) <= 1e-9 * (1 + F.abs(F.col(c))) for c in ("psill", "range", "nugget", "loss")]
    return together.join(alone, "snapshot").select("snapshot", (same[0] & same[1] & same[2] & same[3]).alias("as_alone"))
