"""Stage one: robust linear trend on robust-scaled features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.functions.stats import exact_quantiles
from stationgrid.models.robust import huber_fits
from stationgrid.operators.sizes import broadcast_if_small, sized_for_iteration

ALPHA = 1e-4  # weight of the squared coefficients in the summed objective


@dataclass(frozen=True)
class RobustScale:
    """(value - median) / IQR with the quantiles of the training rows."""

    center: Mapping[str, float]
    spread: Mapping[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> RobustScale:
        q = exact_quantiles(df, list(columns), [0.25, 0.5, 0.75])
        center = {c: q[c][1] if q[c][1] is not None else 0.0 for c in columns}
        spread = {c: (q[c][2] - q[c][0]) or 1.0 if q[c][1] is not None else 1.0 for c in columns}
        return RobustScale(center, spread)

    def column(self, value: Column, name: str) -> Column:
        return (value - F.lit(self.center[name])) / F.lit(self.spread[name])


def column_or_default(df: DataFrame, name: str, fills: Mapping[str, float]) -> Column:
    """The column with NULLs filled, or the fitted constant when it is absent."""
    fill = F.lit(float(fills.get(name, 0.0)))
    return F.coalesce(F.col(name).cast("double"), fill) if name in df.columns else fill


@dataclass(frozen=True)
class HuberTrend:
    features: tuple[str, ...]
    fills: Mapping[str, float]
    scale: RobustScale
    coefficients: tuple[float, ...]
    intercept: float

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], fills: Mapping[str, float], epsilon: float, n: int,
            label: str = "temp", max_iter: int = 300) -> HuberTrend:
        known = RobustScale.fit(df, [f for f in features if f in df.columns])
        absent = [f for f in features if f not in df.columns]
        scale = RobustScale({**known.center, **dict.fromkeys(absent, 0.0)}, {**known.spread, **dict.fromkeys(absent, 1.0)})
        scaled = [scale.column(column_or_default(df, f, fills), f).alias(f) for f in features]
        rows = df.select(*scaled, F.col(label).alias("label"))
        data = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
        model = LinearRegression(
            loss="huber", epsilon=epsilon, maxIter=max_iter, regParam=ALPHA / max(n, 1), standardization=False
        ).fit(sized_for_iteration(data.select("features", "label"), n))
        return HuberTrend(tuple(features), dict(fills), scale, tuple(map(float, model.coefficients)), float(model.intercept))

    def column(self, df: DataFrame) -> Column:
        """The trend as a plain arithmetic expression over ``df``."""
        total = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            total = total + F.lit(weight) * self.scale.column(column_or_default(df, name, self.fills), name)
        return total


@dataclass(frozen=True)
class KeyedTrends:
    """One robust trend per key (a snapshot, say), all fitted in the same passes.

    Features are scaled alike for all keys; the scale only matters for the tiny weight of the squared coefficients.
    """

    by: tuple[str, ...]
    features: tuple[str, ...]
    fills: Mapping[str, float]
    scale: RobustScale
    fits: DataFrame  # by..., n, coefficients, intercept, scale, settled

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], fills: Mapping[str, float], epsilon: float, by: Sequence[str], label: str = "temp") -> KeyedTrends:
        scale = RobustScale.fit(df, features)
        scaled = df.select(*by, label, *(scale.column(column_or_default(df, f, fills), f).alias(f"_f{i}") for i, f in enumerate(features)))
        fits = huber_fits(scaled, [f"_f{i}" for i in range(len(features))], label, by, epsilon, ALPHA)
        return KeyedTrends(tuple(by), tuple(features), dict(fills), scale, fits)

    def predict(self, df: DataFrame, name: str = "trend") -> DataFrame:
        """``df`` with the trend of its key; NULL where the key has none."""
        known = self.fits.select(*self.by, F.col("coefficients").alias("_b"), F.col("intercept").alias("_c"))
        joined = df.join(broadcast_if_small(known), [*self.by], "left")
        total = F.col("_c")
        for i, feature in enumerate(self.features):
            total = total + F.col("_b")[i] * self.scale.column(column_or_default(df, feature, self.fills), feature)
        return joined.withColumn(name, total).drop("_b", "_c")
