"""Trend, trees on its residuals, kriging on what is left; and the bagged ensemble."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from stationgrid.config import AnalysisConfig
from stationgrid.functions.stats import medians
from stationgrid.models.trend import HuberTrend, column_or_default
from stationgrid.operators.evaluate import (
    reduce_members,
    stage_diagnostics,
    summarise_importance,
    with_trend_rows,
)
from stationgrid.operators.kriging import KrigingModel, clamp_residual, shared_points, shared_predictions
from stationgrid.operators.sizes import sized_for_iteration
from stationgrid.operators.split import bag
from stationgrid.session import scratch_path, shared_dir

_VECTOR = "_env_features"


@dataclass
class StackModel:
    """One fitted three-stage model."""

    config: AnalysisConfig
    env: tuple[str, ...]
    trend: HuberTrend
    env_fills: Mapping[str, float]
    trees: GBTRegressionModel | None
    kriging: KrigingModel | None
    diagnostics: Mapping[str, float] = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, env: Sequence[str], config: AnalysisConfig, seed: int,
            id_col: str = "station_id") -> StackModel:
        trend_names = list(config.trend_features)
        # a trend feature that screening left out is a constant to the trend
        rows = df.na.drop(subset=["temp", *(c for c in trend_names if c in df.columns)]).persist()
        n = rows.count()
        fills = medians(rows, sorted({c for c in (*trend_names, *env) if c in rows.columns}))
        trend = HuberTrend.fit(rows, trend_names, fills, config.huber_epsilon, n)
        rows = rows.withColumn("resid1", F.col("temp") - trend.column(rows))

        trees = None
        if env:
            settings = config.trees
            shared_dir(df.sparkSession)  # boosting cuts its lineage there
            data = sized_for_iteration(_assemble(rows, env, fills).select(_VECTOR, "resid1"), n).persist()
            trees = GBTRegressor(
                featuresCol=_VECTOR, labelCol="resid1", maxIter=settings.rounds, stepSize=settings.step,
                maxDepth=settings.max_depth, minInstancesPerNode=settings.min_leaf_rows,
                subsamplingRate=settings.subsample, featureSubsetStrategy=settings.feature_fraction,
                lossType="squared", seed=seed, checkpointInterval=10, cacheNodeIds=False, maxBins=64,
            ).fit(data)
            data.unpersist()
        model = StackModel(config, tuple(env), trend, fills, trees, None)
        rows = model._with_trees(rows, "_t").withColumn("resid2", F.col("resid1") - F.col("_t")).drop("_t").persist()
        model.diagnostics = stage_diagnostics(rows, "resid1", "resid2").first().asDict()

        # small remaining residuals, or few rows, leave nothing for kriging to explain
        if (
            config.residual_kriging
            and (model.diagnostics["rmse_trees"] or 0.0) > config.kriging_min_rmse
            and n > config.kriging_min_rows
        ):
            model.kriging = KrigingModel.fit(
                rows, "resid2", config.residual_variogram, config.residual_lags, config, seed, id_col
            )
        return model

    def _with_trees(self, df: DataFrame, name: str) -> DataFrame:
        if self.trees is None:
            return df.withColumn(name, F.lit(0.0))
        scored = self.trees.transform(_assemble(df, self.env, self.env_fills))
        return scored.withColumnRenamed("prediction", name).drop(_VECTOR)

    def without_kriging(self, df: DataFrame, name: str) -> DataFrame:
        """Add trend and trees, row by row."""
        return self._with_trees(df, "_t").withColumn(name, self.trend.column(df) + F.col("_t")).drop("_t")

    def predict(self, df: DataFrame, name: str = "predicted", id_col: str = "station_id") -> DataFrame:
        """Add the prediction; rows keep their order of arrival and nothing is dropped."""
        scored = self._with_trees(df, "_t")
        total = self.trend.column(df) + F.col("_t")
        if self.kriging is not None:
            scored = self.kriging.predict(scored, "_k", id_col)
            total = total + clamp_residual(F.col("_k"), self.config.kriging_clamp)
        return scored.withColumn(name, total).drop("_t", "_k")

    def split_counts(self, spark) -> dict[str, int]:
        """How many nodes of all trees split on each feature, from the stored table of nodes."""
        if self.trees is None:
            return {}
        path = scratch_path(spark, "trees")
        self.trees.save(path)
        splits = spark.read.parquet(f"{path}/data").filter("nodeData.leftChild >= 0").groupBy(F.col("nodeData.split.featureIndex").alias("i")).count()
        counted = {r["i"]: r["count"] for r in splits.collect()}  # one row per feature
        return {f: counted.get(i, 0) for i, f in enumerate(self.env)}

    def importance(self, kind: str = "gain", spark=None) -> list[tuple[str, float]]:
        """(feature, share of 100) of the tree stage, unsorted: by ``gain`` of the splits, or by their number (``splits``)."""
        if self.trees is None:
            return []
        if kind == "splits":
            counts = self.split_counts(spark)
            all_splits = sum(counts.values())
            return [(f, 100.0 * c / all_splits if all_splits else 0.0) for f, c in counts.items()]
        weights = self.trees.featureImportances.toArray()
        total = weights.sum()
        return [(f, float(100.0 * w / total) if total > 0 else float(w)) for f, w in zip(self.env, weights)]


def _assemble(df: DataFrame, env: Sequence[str], fills: Mapping[str, float]) -> DataFrame:
    named = {f"_e{i}": column_or_default(df, c, fills) for i, c in enumerate(env)}
    ready = df.withColumns(named)
    return VectorAssembler(inputCols=list(named), outputCol=_VECTOR).transform(ready).drop(*named)


@dataclass
class Ensemble:
    """Members fitted on seeded bags of the same rows."""

    config: AnalysisConfig
    env: tuple[str, ...]
    members: list[StackModel]
    points: DataFrame | None = None  # stations of all members, for one search

    @staticmethod
    def fit(df: DataFrame, env: Sequence[str], config: AnalysisConfig, id_col: str = "station_id") -> Ensemble:
        """Members are independent jobs, so they are submitted side by side."""
        rows = df.persist()
        n = rows.count()
        spark = df.sparkSession
        shared_dir(spark)

        def member(seed: int) -> StackModel:
            return StackModel.fit(bag(rows, seed, config.bag_fraction, id_col, n), env, config, seed, id_col)

        with ThreadPoolExecutor(max_workers=len(config.ensemble_seeds)) as pool:
            members = list(pool.map(inheritable_thread_target(spark)(member), config.ensemble_seeds))
        kriged = [m.kriging for m in members]
        points = shared_points(kriged, rows, id_col) if any(kriged) else None
        return Ensemble(config, tuple(env), members, points)

    def predict(self, df: DataFrame, name: str = "predicted", sigma: str = "iqr_sigma",
                id_col: str = "station_id") -> DataFrame:
        """Median over members and the scaled interquartile range, in place.

        Trend and trees are added row by row; the kriging of all members takes one neighbour search and one join.
        """
        columns = [f"_m{i}" for i in range(len(self.members))]
        scored = df
        for column, member in zip(columns, self.members):
            scored = member.without_kriging(scored, column)
        if self.points is not None:
            models = [m.kriging.model if m.kriging is not None else None for m in self.members]
            kriged = shared_predictions(df, self.points, models, self.config.kriging_neighbors, self.config.bag_fraction, id_col)
            scored = scored.join(kriged.withColumnRenamed("kriged", "_k"), id_col, "left")
            scored = scored.withColumns({c: F.col(c) + clamp_residual(F.col("_k")[i], self.config.kriging_clamp) for i, c in enumerate(columns)}).drop("_k")
        return reduce_members(scored, columns, name, sigma).drop(*columns)

    def importance(self, spark, kind: str = "gain") -> DataFrame:
        """``(feature, importance, importance_std)`` with the trend rows, best first."""
        rows = [(f, w, i) for i, m in enumerate(self.members) for f, w in m.importance(kind, spark)]
        table = spark.createDataFrame(rows, "feature string, importance double, member int")
        summary = summarise_importance(table)
        return with_trend_rows(summary, self.config.trend_features).orderBy(F.desc_nulls_last("importance"), "feature")
