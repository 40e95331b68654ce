"""Scores, comparisons and distributions of predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.functions.stats import exact_quantiles

# --- fixed values: metric names ------------------------------------------------
MAE, RMSE, R2, BIAS, MIN_ERROR, MAX_ERROR = "MAE", "RMSE", "R²", "Bias", "Min Error", "Max Error"
METRICS = (MAE, RMSE, R2, BIAS, MIN_ERROR, MAX_ERROR)
# -------------------------------------------------------------------------------
IQR_TO_SIGMA = 1.35


def _metric_columns(truth: Column, predicted: Column) -> dict[str, Column]:
    both = truth.isNotNull() & predicted.isNotNull()
    error = F.when(both, predicted - truth)
    actual = F.when(both, truth)
    n = F.count(error)
    residual, total = F.sum(error * error), F.var_pop(actual) * n
    r2 = F.when(total > 0, 1.0 - residual / F.nullif(total, F.lit(0.0))).when(residual == 0, 1.0).otherwise(0.0)
    checked = lambda v: F.when(n == 0, F.raise_error("no valid prediction pairs").cast("double")).otherwise(v)
    return {
        MAE: checked(F.avg(F.abs(error))),
        RMSE: checked(F.sqrt(F.avg(error * error))),
        R2: checked(r2),
        BIAS: checked(F.avg(error)),
        MIN_ERROR: checked(F.min(error)),
        MAX_ERROR: checked(F.max(error)),
    }


def metric_table(df: DataFrame, truth: str, models: Mapping[str, str]) -> DataFrame:
    """``(metric, <model>...)`` rows from one pass; ``models`` maps name to column."""
    wide = []
    for i, column in enumerate(models.values()):
        metrics = _metric_columns(F.col(truth), F.col(column))
        wide += [v.alias(f"m{i}_{j}") for j, v in enumerate(metrics.values())]
    one = df.agg(*wide)
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), *[F.col(f"m{i}_{j}").alias(m) for i, m in enumerate(models)])
        for j, name in enumerate(METRICS)
    ])
    return one.select(F.inline(rows))


def evaluate(df: DataFrame, truth: str = "temp", predicted: str = "predicted") -> dict[str, float]:
    """The six scores as a dictionary; fails when no pair is complete."""
    return {r["metric"]: r["v"] for r in metric_table(df, truth, {"v": predicted}).collect()}


def compare_models(df: DataFrame, truth: str, base: str, new: str, names: tuple[str, str] = ("base", "new")) -> DataFrame:
    """Both models' scores, improvement, percentage, the pass flag, and ``better``.

    ``improvement`` and ``passed`` use signed values; ``better`` compares the size
    of bias and extreme errors.
    """
    table = metric_table(df, truth, {"_b": base, "_n": new})
    b, n, metric = F.col("_b"), F.col("_n"), F.col("metric")
    gain = F.when(metric == R2, n - b).otherwise(b - n)
    percent = (
        F.when(metric == R2, 100.0 * gain)
        .when(metric == BIAS, F.abs(b) - F.abs(n))
        .otherwise(F.coalesce(F.try_divide(100.0 * gain, b), F.lit(0.0)))
    )
    shrinks = F.abs(n) < F.abs(b)
    passed = F.when(metric == BIAS, shrinks).otherwise(gain > 0)
    better = F.when(metric.isin(BIAS, MIN_ERROR, MAX_ERROR), shrinks).otherwise(gain > 0)
    return table.select(
        "metric", b.alias(names[0]), n.alias(names[1]), gain.alias("improvement"),
        percent.alias("pct_improvement"), passed.alias("passed"), better.alias("better"),
    )


def observed_vs_predicted(df: DataFrame, truth: str, models: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Long ``(keep..., model, observed, predicted, error)`` table of complete pairs."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted")) for m, c in models.items()])
    rows = df.select(*keep, F.col(truth).alias("observed"), F.inline(pairs)).na.drop(subset=["observed", "predicted"])
    return rows.withColumn("error", F.col("predicted") - F.col("observed"))


def axis_range(pairs: DataFrame) -> DataFrame:
    """Shared plot range of observed and predicted values per model."""
    return pairs.groupBy("model").agg(
        F.least(F.min("observed"), F.min("predicted")).alias("axis_min"),
        F.greatest(F.max("observed"), F.max("predicted")).alias("axis_max"),
    )


def error_histogram(df: DataFrame, truth: str, models: Mapping[str, str], bins: int = 30) -> DataFrame:
    """``(model, bin, n)``: equal bins between each model's extreme errors."""
    errors = {m: F.col(c) - F.col(truth) for m, c in models.items()}
    span = df.agg(*[e.alias(f"{s}{i}") for i, v in enumerate(errors.values()) for s, e in (("a", F.min(v)), ("b", F.max(v)))])
    ends = F.array(*[
        F.struct(F.lit(m).alias("model"), v.alias("error"), F.lit(i).alias("i")) for i, (m, v) in enumerate(errors.items())
    ])
    bounds = span.select(F.array(*[
        F.struct(F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high")) for i in range(len(errors))
    ])).scalar()
    rows = df.select(F.inline(ends)).na.drop(subset=["error"]).withColumn("bound", F.get(bounds, F.col("i")))
    low, width = F.col("bound.low"), F.col("bound.high") - F.col("bound.low")
    place = F.coalesce(F.try_divide(F.col("error") - low, width), F.lit(0.5))
    number = F.least(F.floor(place * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy("model", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def row_quantile(values: Column, probability: float) -> Column:
    """Linear-interpolated quantile of a short sorted array without NULLs."""
    position = F.lit(probability) * (F.size(values) - 1)
    low = F.floor(position).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(position).cast("int"))
    return a + (b - a) * (position - low)


def reduce_members(df: DataFrame, members: Sequence[str], value: str = "predicted", sigma: str = "iqr_sigma") -> DataFrame:
    """Median and (q75 - q25) / 1.35 of member columns, row by row; no shuffle."""
    ordered = F.array_sort(F.filter(F.array(*members), lambda v: v.isNotNull()))
    spread = (row_quantile(ordered, 0.75) - row_quantile(ordered, 0.25)) / IQR_TO_SIGMA
    return df.withColumns({value: row_quantile(ordered, 0.5), sigma: spread})


def reduce_member_rows(rows: DataFrame, id_col: str, value: str) -> DataFrame:
    """The same reduction for one row per (id, member)."""
    q = rows.groupBy(id_col).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(
        id_col, F.get("q", F.lit(1)).alias("predicted"),
        ((F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / IQR_TO_SIGMA).alias("iqr_sigma"),
    )


def field_stats(cells: DataFrame, value: str) -> DataFrame:
    """Minimum, maximum, mean and number of valid cells."""
    return cells.agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"),
        F.count(value).alias("valid_pixels"),
    )


def uncertainty_summary(cells: DataFrame, value: str) -> DataFrame:
    """Exact 95th and 98th percentile beside the mean."""
    p95, p98 = exact_quantiles(cells, [value], [0.95, 0.98])[value]
    return cells.agg(
        F.lit(p95).cast("double").alias("p95"), F.lit(p98).cast("double").alias("p98"), F.avg(value).alias("mean")
    )


def stage_diagnostics(df: DataFrame, first: str, second: str) -> DataFrame:
    """RMSE after the trend and after the trees, and the share of variance removed."""
    return df.agg(
        F.sqrt(F.avg(F.col(first) * F.col(first))).alias("rmse_trend"),
        F.sqrt(F.avg(F.col(second) * F.col(second))).alias("rmse_trees"),
        (1.0 - F.var_pop(second) / (F.var_pop(first) + 1e-10)).alias("r2_trees"),
        F.count(second).alias("n_rows"),
    )


def extrapolation_check(cells: DataFrame, value: str, stations: DataFrame, margin: float) -> DataFrame:
    """Whether the field leaves the station range by more than ``margin``."""
    seen = stations.agg(F.struct(F.min("temp").alias("low"), F.max("temp").alias("high"))).scalar()
    field = cells.agg(F.min(value).alias("grid_min"), F.max(value).alias("grid_max"))
    low, high = seen.getField("low"), seen.getField("high")
    return field.select(
        "grid_min", "grid_max", low.alias("station_min"), high.alias("station_max"),
        ((F.col("grid_min") < low - margin) | (F.col("grid_max") > high + margin)).alias("extreme"),
    )


def summarise_importance(members: DataFrame) -> DataFrame:
    """Mean and sample deviation of each feature's importance over the members."""
    return members.groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.stddev_samp("importance").alias("importance_std")
    )


def with_trend_rows(importance: DataFrame, trend: Sequence[str]) -> DataFrame:
    """Add the trend features, which have no tree importance."""
    listed = F.explode(F.array(*[F.lit(f"[S1] {f}") for f in trend]))
    one = importance.sparkSession.range(1)
    extra = one.select(listed.alias("feature"), F.lit(None).cast("double").alias("importance"))
    return importance.unionByName(extra, allowMissingColumns=True)


def top_features(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.desc_nulls_last("importance"), "feature").limit(n)
