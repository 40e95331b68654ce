"""The whole analysis: stations to scored, smoothed, gridded fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationgrid.config import AnalysisConfig
from stationgrid.functions.crs import with_metres
from stationgrid.models.stack import Ensemble
from stationgrid.operators.evaluate import compare_models, extrapolation_check, metric_table
from stationgrid.operators.features import (
    FeatureModel,
    RasterSet,
    align_to_training,
    attach_features,
    engineer_features,
)
from stationgrid.operators.geocode import locate_stations
from stationgrid.operators.grid import GridSpec, grid_cells, prediction_grid, scatter, smooth
from stationgrid.operators.kriging import KrigingBaseline
from stationgrid.operators.qc import effective_lapse_rate, judge_stations
from stationgrid.operators.raster import geographic_target, regrid_to_degrees
from stationgrid.operators.split import split_stations
from stationgrid.operators.stations import dedupe_locations, drop_incomplete, enough_stations, quality_control_applies
from stationgrid.session import cut_lineage
from stationgrid.sinks.products import TEMPERATURE, UNCERTAINTY, write_product_set


@dataclass
class Analysis:
    """Everything one run produces."""

    field: DataFrame  # r, c, temperature, uncertainty on the full rectangle
    stations: DataFrame
    features: FeatureModel
    metrics: DataFrame
    comparison: DataFrame
    importance: DataFrame
    scored: DataFrame
    extrapolation: DataFrame
    report: DataFrame
    spec: GridSpec


def prepare_stations(raw: DataFrame, cache: DataFrame | None = None, gazetteer: DataFrame | None = None,
                     edges: DataFrame | None = None) -> DataFrame:
    """Readings with a temperature and a place, one per location, in metres."""
    rows = drop_incomplete(raw, ["temp"])
    if cache is not None:
        rows = locate_stations(rows, cache, gazetteer, edges)
    else:
        rows = drop_incomplete(rows, ["lat", "lon"])
    return with_metres(dedupe_locations(rows))


def grid_features(cells: DataFrame, rasters: RasterSet, model: FeatureModel, config: AnalysisConfig) -> DataFrame:
    """The station features for grid cells, aligned to what training kept."""
    keyed = cells.withColumns({"x_pl": F.col("x"), "y_pl": F.col("y"),
                               "cell_id": F.col("r").cast("bigint") * (1 << 31) + F.col("c")})
    full = attach_features(keyed, rasters, config, "cell_id", fill_dem=model.medians.get("dem"))
    needed = list(dict.fromkeys([*config.trend_features, *model.features]))
    return align_to_training(full, needed, model.medians)


def run_report(spark: SparkSession, steps: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``(step, metric, value)`` counts; each is one aggregate over its table."""
    out = None
    for step, metric, df in steps:
        row = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(step).alias("step"), F.lit(metric).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def analyse(raw: DataFrame, rasters: RasterSet, edges: DataFrame, spec: GridSpec, config: AnalysisConfig,
            cache: DataFrame | None = None, gazetteer: DataFrame | None = None) -> Analysis:
    """Prepare, check, split, score and grid one snapshot of station readings."""
    spark = raw.sparkSession
    if not enough_stations(raw, config):
        raise ValueError(f"an analysis needs at least {config.min_stations} station rows")
    stations = prepare_stations(raw, cache, gazetteer, edges)
    featured, features = engineer_features(stations, rasters, config)
    featured = cut_lineage(featured)
    steps = [("feeds", "rows", raw), ("prepare", "stations", stations), ("features", "stations", featured)]

    checked = featured
    if quality_control_applies(featured, config):
        judged = judge_stations(featured, effective_lapse_rate(featured, config), config)
        checked = cut_lineage(judged.filter(~F.col("is_outlier")).select(*featured.columns))
    steps.append(("quality control", "stations", checked))

    trend, env = features.roles(config.trend_features)
    # heights that too few stations have are no feature: rows without one stay
    fitted = checked.drop(*(c for c in trend if c not in (*features.features, "x_pl", "y_pl")))
    parts = fitted.join(split_stations(fitted, config), "station_id").persist()
    train, val, test = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "val", "test"))
    steps += [("split", p, df) for p, df in (("train", train), ("val", val), ("test", test))]

    baseline = KrigingBaseline(config).fit(train)
    held_out_model = Ensemble.fit(train, env, config)
    scored = held_out_model.predict(parts.filter(F.col("part").isin("val", "test")), "new")
    scored = cut_lineage(baseline.predict(scored, "base"))
    on_test = scored.filter(F.col("part") == "test")
    metrics = metric_table(on_test, "temp", {"base": "base", "new": "new"}).withColumn("part", F.lit("test")).unionByName(
        metric_table(scored.filter(F.col("part") == "val"), "temp", {"base": "base", "new": "new"}).withColumn("part", F.lit("val"))
    )
    comparison = compare_models(on_test, "temp", "base", "new")

    final = Ensemble.fit(fitted, env, config)
    cells = prediction_grid(spark, spec, edges).persist()
    ready = grid_features(cells.filter("inside"), rasters, features, config)
    predicted = final.predict(ready, "temperature", "uncertainty", "cell_id")
    field = scatter(cells, predicted, ["temperature", "uncertainty"])
    if config.smoothing:
        field = smooth(field, ["temperature", "uncertainty"], config.smoothing_sigma)
    field = cut_lineage(field)
    steps += [("grid", "cells", cells), ("grid", "inside", cells.filter("inside"))]
    return Analysis(
        field=field, stations=checked, features=features, metrics=metrics, comparison=comparison,
        importance=held_out_model.importance(spark), scored=scored,
        extrapolation=extrapolation_check(field, "temperature", checked, config.extrapolation_margin),
        report=run_report(spark, steps), spec=spec,
    )


def geographic_products(analysis: Analysis, step_deg: float) -> dict[str, DataFrame]:
    """Temperature and uncertainty on a geographic grid that covers the field."""
    spark = analysis.field.sparkSession
    spec = analysis.spec
    box = grid_cells(spark, spec).agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    width = int((box[1] - box[0]) / step_deg) + 1
    height = int((box[3] - box[2]) / step_deg) + 1
    target = geographic_target(spark, box[0], box[3], step_deg, height, width)
    return {
        name: regrid_to_degrees(analysis.field, spec.min_x, spec.max_y, spec.step, target, name).select(
            "r", "c", F.col(name).alias("value")
        )
        for name in ("temperature", "uncertainty")
    }


def export(analysis: Analysis, root: str, run: str, step_deg: float = 0.05) -> list[str]:
    """Write both fields in both reference systems, tagged with the test scores."""
    scores = {r["metric"]: r["new"] for r in analysis.comparison.collect()}
    tags = {"test_rmse": f"{scores['RMSE']:.3f}", "test_mae": f"{scores['MAE']:.3f}", "test_r2": f"{scores['R²']:.3f}"}
    metric = {n: analysis.field.select("r", "c", F.col(n).alias("value")) for n in ("temperature", "uncertainty")}
    degrees = geographic_products(analysis, step_deg)
    products = {}
    for name, product in (("temperature", TEMPERATURE), ("uncertainty", UNCERTAINTY)):
        products[(product, "EPSG2180")] = (metric[name], analysis.spec.step)
        products[(product, "EPSG4326")] = (degrees[name], step_deg)
    return write_product_set(products, root, run, tags)
