"""Lapse rate and neighbour-consensus quality control."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.config import NATIONAL, AnalysisConfig
from stationgrid.models.robust import huber_fits
from stationgrid.operators.knn import nearest
from stationgrid.operators.sizes import broadcast_if_small
from stationgrid.operators.stations import quality_control_applies


def trusted(df: DataFrame) -> Column:
    """Genuine observations of the national network."""
    if "isModel" not in df.columns:
        return F.lit(False)
    return F.coalesce((F.col("source") == NATIONAL) & ~F.col("isModel"), F.lit(False))


def lapse_gate(stations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., n_trusted, min_dem, max_dem, spread)`` of the trusted rows."""
    return stations.filter(trusted(stations)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trusted"),
        F.min("dem").alias("min_dem"),
        F.max("dem").alias("max_dem"),
        (F.max("dem") - F.min("dem")).alias("spread"),
    )


def dynamic_lapse_rate(stations: DataFrame, config: AnalysisConfig) -> float:
    """Minus the robust slope of temperature on height, or the standard rate."""
    fallback = config.standard_lapse_rate
    if "isModel" not in stations.columns or "dem" not in stations.columns:
        return fallback
    gate = lapse_gate(stations).first()
    if gate["n_trusted"] < config.min_trusted_stations or (gate["spread"] or 0.0) < config.min_elevation_spread:
        return fallback
    rows = stations.filter(trusted(stations)).select("dem", F.col("temp").alias("label")).na.drop()
    data = VectorAssembler(inputCols=["dem"], outputCol="features").transform(rows)
    try:
        fitted = LinearRegression(
            loss="huber", epsilon=config.huber_epsilon, maxIter=200, regParam=1e-4 / gate["n_trusted"],
            standardization=False,
        ).fit(data)
    except (PySparkException, Py4JJavaError):  # the solver gave up, as on heights that are all missing
        return fallback
    rate = -float(fitted.coefficients[0])
    return rate if abs(rate) <= config.max_abs_lapse_rate else fallback


def dynamic_lapse_rates(stations: DataFrame, config: AnalysisConfig, by: tuple[str, ...]) -> DataFrame:
    """``(by..., n_trusted, spread, lapse_rate)`` of every key, all fitted in the same passes.

    As :func:`dynamic_lapse_rate` for each key alone: the standard rate where there are too few trusted rows, too little spread of
    height, no settled fit, or an implausible slope. NULL keys are not fitted.
    """
    keys = stations.select(*by).na.drop().distinct()
    standard = F.lit(config.standard_lapse_rate)
    if "isModel" not in stations.columns or "dem" not in stations.columns:
        return keys.select(*by, F.lit(0).cast("bigint").alias("n_trusted"), F.lit(None).cast("double").alias("spread"), standard.alias("lapse_rate"))
    gate = lapse_gate(stations, by)
    fits = huber_fits(stations.filter(trusted(stations)), ["dem"], "temp", by, config.huber_epsilon)
    rate = -F.col("coefficients")[0]
    usable = (
        (F.col("n_trusted") >= config.min_trusted_stations) & (F.col("spread") >= config.min_elevation_spread)
        & F.col("settled") & (F.abs(rate) <= config.max_abs_lapse_rate)
    )
    return keys.join(gate, [*by], "left").join(fits, [*by], "left").select(
        *by, F.coalesce("n_trusted", F.lit(0)).alias("n_trusted"), "spread", F.when(usable, rate).otherwise(standard).alias("lapse_rate")
    )


def neighbour_consensus(stations: DataFrame, lapse_rate: float | DataFrame, config: AnalysisConfig,
                        id_col: str = "station_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``(id, expected)``: median neighbour temperature brought to the station's height.

    ``elev_sign=+1`` removes the height difference, ``-1`` applies it the other way. With ``by`` the rate may be a
    table ``(by..., lapse_rate)``.
    """
    keys = [*by, id_col]
    neighbours = nearest(
        stations, stations, config.qc_neighbors, query_id=id_col, base_id=id_col, payload=("temp", "dem"),
        by=by, exclude_self=True, distinct_base=True,
    )
    own = stations.select(*keys, F.col("dem").alias("own_dem"))
    if isinstance(lapse_rate, DataFrame):
        own = own.join(broadcast_if_small(lapse_rate.select(*by, F.col("lapse_rate").alias("_rate"))), [*by])
    else:
        own = own.withColumn("_rate", F.lit(float(lapse_rate)))
    moved = F.col("nbr_temp") + F.lit(float(config.elev_sign)) * F.col("_rate") * (F.col("nbr_dem") - F.col("own_dem"))
    return neighbours.join(own, keys).groupBy(*keys).agg(F.median(moved).alias("expected"))


def judge_stations(stations: DataFrame, lapse_rate: float | DataFrame, config: AnalysisConfig,
                   id_col: str = "station_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``expected, deviation, is_trusted, is_outlier``; trusted rows always pass."""
    consensus = neighbour_consensus(stations, lapse_rate, config, id_col, by)
    judged = stations.join(consensus, [*by, id_col], "left").withColumn("is_trusted", trusted(stations))
    deviation = F.when(F.col("is_trusted"), F.lit(0.0)).otherwise(F.abs(F.col("temp") - F.col("expected")))
    return judged.withColumn("deviation", deviation).withColumn(
        "is_outlier", F.coalesce(F.col("deviation") > F.lit(config.qc_threshold), F.lit(False))
    )


def effective_lapse_rate(stations: DataFrame, config: AnalysisConfig, given: float | None = None) -> float:
    if given is not None:
        return given
    return dynamic_lapse_rate(stations, config) if config.dynamic_lapse_rate else config.standard_lapse_rate


def spatial_qc(stations: DataFrame, config: AnalysisConfig, lapse_rate: float | None = None) -> DataFrame:
    """Stations that agree with their neighbours; unchanged when the check cannot run."""
    if not quality_control_applies(stations, config):
        return stations
    rate = effective_lapse_rate(stations, config, lapse_rate)
    return judge_stations(stations, rate, config).filter(~F.col("is_outlier")).select(*stations.columns)


def worst_outliers(judged: DataFrame, n: int = 5) -> DataFrame:
    return judged.filter("is_outlier").orderBy(F.desc("deviation"), "station_id").limit(n)
