"""Trend, trees, kriging, the stack, the ensemble and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fields import raster_set
from registry.fixtures import (
    SQL_EDGES,
    WITH_GRID,
    WITH_METRIC,
    WITH_SNAPSHOTS,
    grid_spec,
    metric_stations,
    r,
    ring_edges,
    snapshots,
    sql_inside,
    stations,
    unique_stations,
)
from stationgrid.config import AnalysisConfig, TreeConfig
from stationgrid.functions.hashing import key_uniform
from stationgrid.functions.stats import medians
from stationgrid.models.stack import Ensemble, StackModel
from stationgrid.models.trend import HuberTrend, KeyedTrends
from stationgrid.operators.kriging import KrigingBaseline, KrigingModel, local_predictions
from stationgrid.operators.variogram import fitted_variogram
from stationgrid.plans.analysis import analyse
from stationgrid.session import cut_lineage

# Twenty boosting rounds instead of two hundred (README has the times of both); the buffer fits the density of the stations.
CONFIG = AnalysisConfig(trees=TreeConfig(rounds=20), buffer_km=2.0)
ENV = ["slope_x", "wave"]


def training(spark, sf):
    """Stations with heights, positions and two further features, derived once for all jobs of a query."""
    return cut_lineage(metric_stations(spark, sf).withColumns({
        "slope_x": F.sin(F.col("x_pl") / 50_000.0), "wave": key_uniform(F.col("station_id"), 7),
    }))


@query("MOD1")
def trend(spark, sf):
    rows = training(spark, sf)
    names = list(CONFIG.trend_features)
    model = HuberTrend.fit(rows, names, medians(rows, names), CONFIG.huber_epsilon, rows.count())
    return rows.select("station_id", "temp", F.round(model.column(rows), 4).alias("trend"))


def _stack(spark, sf, **changes):
    from dataclasses import replace

    rows = training(spark, sf)
    return rows, StackModel.fit(rows, ENV, replace(CONFIG, **changes), 42)


@query("MOD2")
def trees(spark, sf):
    rows, model = _stack(spark, sf, residual_kriging=False)
    return model.predict(rows, "predicted").select("station_id", "temp", r("predicted", 4))


@query("MOD3")
def importance(spark, sf):
    rows, model = _stack(spark, sf, residual_kriging=False)
    return spark.createDataFrame(model.importance(), "feature string, importance double").select("feature", r("importance", 4))


@query("MOD3_splits", "SELECT 100E0 AS total, CAST(2 AS BIGINT) AS features, true AS as_nodes")
def split_importance(spark, sf):
    """Importance by the number of splits; inner nodes of full binary trees are one fewer than their leaves."""
    _, model = _stack(spark, sf, residual_kriging=False)
    shares = spark.createDataFrame(model.importance("splits", spark), "feature string, importance double")
    inner = (model.trees.totalNumNodes - model.trees.getNumTrees) // 2
    return shares.agg(F.round(F.sum("importance"), 2).alias("total"), F.count("*").alias("features")).withColumn("as_nodes", F.lit(sum(model.split_counts(spark).values()) == inner))


@query("KRG1")
def baseline(spark, sf):
    rows = training(spark, sf)
    fitted = KrigingBaseline(CONFIG).fit(rows)
    return fitted.predict(rows, "predicted").select("station_id", "temp", r("predicted", 4))


@query("KRG2")
def residual_kriging(spark, sf):
    rows = training(spark, sf).withColumn("resid", F.col("temp") - 18.0 + 0.0065 * F.col("dem"))
    model = KrigingModel.fit(rows, "resid", CONFIG.residual_variogram, CONFIG.residual_lags, CONFIG, 42)
    return model.predict(rows, "kriged").select("station_id", r("kriged", 4))


@query("KRG4")
def local_kriging(spark, sf):
    rows = training(spark, sf).select("station_id", "x_pl", "y_pl", "temp")
    model = fitted_variogram(rows, "temp", "spherical", CONFIG.baseline_lags, CONFIG.variogram_reach)
    targets = rows.select("station_id", (F.col("x_pl") + 500.0).alias("x_pl"), (F.col("y_pl") - 500.0).alias("y_pl"))
    return local_predictions(targets, rows, "temp", model, CONFIG.kriging_neighbors).select("station_id", r("kriged", 4))


@query("KRG4_exact", f"{WITH_METRIC} SELECT station_id, true AS exact FROM proj")
def kriging_at_the_stations(spark, sf):
    """Kriging gives a station's own value back where it stands."""
    rows = training(spark, sf).select("station_id", "x_pl", "y_pl", "temp")
    model = fitted_variogram(rows, "temp", "spherical", CONFIG.baseline_lags, CONFIG.variogram_reach)
    found = local_predictions(rows, rows, "temp", model, CONFIG.kriging_neighbors).join(rows, "station_id")
    return found.select("station_id", (F.abs(F.col("kriged") - F.col("temp")) < 1e-6).alias("exact"))


@query("MOD3_total", "SELECT 100E0 AS total, CAST(2 AS BIGINT) AS features")
def importance_total(spark, sf):
    return importance(spark, sf).agg(F.round(F.sum("importance"), 2).alias("total"), F.count("*").alias("features"))


@query("STK1_checks", f"{WITH_METRIC} SELECT count(*) AS predictions, count(DISTINCT station_id) AS stations, true AS better_than_trend FROM proj")
def stack_properties(spark, sf):
    """Every station has one prediction, and all stages together fit better than the trend alone."""
    rows, model = _stack(spark, sf)
    scored = model.predict(rows, "predicted").withColumn("_trend", model.trend.column(rows))
    squares = lambda c: F.sum((F.col(c) - F.col("temp")) * (F.col(c) - F.col("temp")))
    return scored.agg(
        F.count("predicted").alias("predictions"), F.countDistinct("station_id").alias("stations"), (squares("predicted") < squares("_trend")).alias("better_than_trend"),
    )


@query("STK1")
def stack(spark, sf):
    rows, model = _stack(spark, sf)
    return model.predict(rows, "predicted").select("station_id", "temp", r("predicted", 4))


@query("ENS1")
def ensemble(spark, sf):
    rows = training(spark, sf)
    fitted = Ensemble.fit(rows, ENV, CONFIG)
    return fitted.predict(rows).select("station_id", "temp", r("predicted", 4), r("iqr_sigma", 4))


@query("ENS1_checks", f"{WITH_METRIC} SELECT count(*) AS predictions, count(DISTINCT station_id) AS stations, true AS between_members, true AS kriging_helps FROM proj")
def ensemble_properties(spark, sf):
    """One prediction per station, between the members it is the median of; kriging brings it nearer to the readings."""
    rows = training(spark, sf)
    fitted = Ensemble.fit(rows, ENV, CONFIG)
    scored = fitted.predict(rows)
    columns = [f"m{i}" for i in range(len(fitted.members))]
    for column, member in zip(columns, fitted.members):
        scored = member.without_kriging(scored, column)
    clamp = CONFIG.kriging_clamp
    between = (F.col("predicted") >= F.least(*columns) - clamp) & (F.col("predicted") <= F.greatest(*columns) + clamp) & (F.col("iqr_sigma") >= 0)
    squares = lambda c: F.sum((c - F.col("temp")) * (c - F.col("temp")))
    plain = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    return scored.agg(
        F.count("predicted").alias("predictions"), F.countDistinct("station_id").alias("stations"), F.min(between).alias("between_members"),
        (squares(F.col("predicted")) < squares(plain)).alias("kriging_helps"),
    )


@query("PIP1")
def whole_analysis(spark, sf):
    """Stations and rasters to a smoothed field of temperature and uncertainty."""
    result = analyse(stations(spark, sf).drop("dem"), raster_set(spark, sf), ring_edges(spark), grid_spec(spark, sf), CONFIG)
    return result.field.select("r", "c", r("temperature", 4), r("uncertainty", 4))


@query("PIP1_mask", f"{WITH_GRID}, {SQL_EDGES} SELECT r, c, {sql_inside('cells', 'r', 'x', 'y')} AS predicted, {sql_inside('cells', 'r', 'x', 'y')} AS plausible FROM cells")
def analysis_covers_the_mask(spark, sf):
    """Exactly the cells inside the boundary have a temperature, a plausible one with an uncertainty."""
    plausible = F.coalesce(F.col("temperature").between(-60.0, 60.0) & (F.col("uncertainty") >= 0), F.lit(False))
    return whole_analysis(spark, sf).select("r", "c", F.col("temperature").isNotNull().alias("predicted"), plausible.alias("plausible"))


@query("MOD1_snapshots", f"{WITH_SNAPSHOTS} SELECT snapshot, count(*) AS stations, true AS as_alone FROM snaps GROUP BY snapshot")
def trends_of_snapshots(spark, sf):
    """All snapshots' trends fitted in one job; no other fit of a snapshot's rows alone has a lower loss."""
    rows = cut_lineage(snapshots(spark, sf))
    names = list(CONFIG.trend_features)
    fills = medians(rows, names)
    trends = KeyedTrends.fit(rows, names, fills, CONFIG.huber_epsilon, ["snapshot"])
    scored = trends.predict(rows)
    alone = None
    for (snapshot,) in rows.select("snapshot").distinct().collect():
        mine = scored.filter(F.col("snapshot") == snapshot)
        one = mine.withColumn("alone", HuberTrend.fit(mine, names, fills, CONFIG.huber_epsilon, mine.count()).column(mine))
        alone = one if alone is None else alone.unionByName(one)
    near = F.max(F.abs(F.col("alone") - F.col("trend"))) < 0.01
    return alone.groupBy("snapshot").agg(F.count("*").alias("stations"), near.alias("as_alone"))
