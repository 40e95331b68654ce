"""Ordinary kriging from each target's nearest points, at every size.

Targets find their ``k`` nearest points in a kNN join and the small systems are solved in Arrow batches
wherever the targets live. No point is left out: the number of neighbours, a documented parameter, is the only
approximation, and it does not depend on how many points there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.config import AnalysisConfig
from stationgrid.functions.hashing import key_uniform
from stationgrid.operators.knn import nearest
from stationgrid.operators.variogram import Variogram, fitted_variogram
from stationgrid.session import cut_lineage

COINCIDENT = 1e-10
TARGETS_PER_CHUNK = 256


def jittered(points: DataFrame, seed: int, id_col: str = "station_id", metres: float = 0.1) -> DataFrame:
    """Move each point by up to ``metres`` along both axes, reproducibly."""
    shift = lambda salt: (key_uniform(F.col(id_col), F.lit(seed + salt)) * 2.0 - 1.0) * metres
    return points.withColumns({"x_pl": F.col("x_pl") + shift(0), "y_pl": F.col("y_pl") + shift(1)})


def _minus_gamma(model: Variogram, d: np.ndarray) -> np.ndarray:
    return np.where(d <= COINCIDENT, 0.0, -model.gamma(d))


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; only the singular ones take the pseudo-inverse."""
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        if len(matrix) == 1:
            return np.linalg.pinv(matrix) @ right
        half = len(matrix) // 2
        return np.concatenate([_solve(matrix[:half], right[:half]), _solve(matrix[half:], right[half:])])


def _local_batch(model: Variogram, frame: pd.DataFrame) -> np.ndarray:
    """Predictions of a batch whose targets all have the same number of neighbours."""
    nx, ny, nz = (np.stack(frame[c].to_numpy()) for c in ("nx", "ny", "nz"))
    return _kriged(model, nx, ny, nz, frame["tx"].to_numpy(), frame["ty"].to_numpy())


def _kriged(model: Variogram, nx: np.ndarray, ny: np.ndarray, nz: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """Predictions at targets from their neighbours, a row of points each."""
    m, k = nx.shape
    system = np.ones((m, k + 1, k + 1))
    dx, dy = nx[:, :, None] - nx[:, None, :], ny[:, :, None] - ny[:, None, :]
    system[:, :k, :k] = _minus_gamma(model, np.sqrt(dx * dx + dy * dy))
    system[:, k, k] = 0.0
    right = np.ones((m, k + 1, 1))
    right[:, :k, 0] = _minus_gamma(model, np.hypot(nx - tx[:, None], ny - ty[:, None]))
    return (_solve(system, right)[:, :k, 0] * nz).sum(axis=1)


def local_predictions(targets: DataFrame, points: DataFrame, value: str, model: Variogram, k: int,
                      target_id: str = "station_id", point_id: str = "station_id",
                      x: str = "x_pl", y: str = "y_pl") -> DataFrame:
    """``(target_id, kriged)`` from each target's ``k`` nearest points."""
    base = points.select(F.col(point_id).alias("_pid"), F.col("x_pl").alias(x), F.col("y_pl").alias(y),
                         F.col("x_pl").alias("px"), F.col("y_pl").alias("py"), F.col(value).alias("pz")).na.drop()
    found = nearest(targets, base, k, query_id=target_id, base_id="_pid", x=x, y=y, payload=("px", "py", "pz"), distinct_base=True, lists=True)
    rows = found.select(target_id, F.col("qx").alias("tx"), F.col("qy").alias("ty"), F.col("nbr_px").alias("nx"), F.col("nbr_py").alias("ny"), F.col("nbr_pz").alias("nz"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), TARGETS_PER_CHUNK):
                part = batch.iloc[start:start + TARGETS_PER_CHUNK]
                for _, same in part.groupby(part["nx"].map(len)):
                    yield pd.DataFrame({target_id: same[target_id], "kriged": _local_batch(model, same)})

    id_type = targets.schema[target_id].dataType.simpleString()
    return rows.mapInPandas(score, f"{target_id} {id_type}, kriged double")


def shared_points(fitted: Sequence[KrigingModel | None], stations: DataFrame, id_col: str = "station_id") -> DataFrame:
    """``(_pid, x_pl, y_pl, px, py, pz)``: each station that serves any model, with arrays of its position and value in each; NaN where it does not serve."""
    rows = None
    for i, model in enumerate(fitted):
        if model is not None:
            one = model.points.select(F.col("station_id").alias("_pid"), F.lit(i).alias("i"), F.col("x_pl").alias("x"), F.col("y_pl").alias("y"), F.col(model.value).alias("z"))
            rows = one if rows is None else rows.unionByName(one)
    nan = F.lit(float("nan"))
    arrays = [F.array(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col(c))), nan) for i in range(len(fitted)))).alias(f"p{c}") for c in "xyz"]
    places = stations.select(F.col(id_col).alias("_pid"), "x_pl", "y_pl")
    return cut_lineage(rows.groupBy("_pid").agg(*arrays).join(places, "_pid"))


def neighbours_to_search(k: int, fraction: float) -> int:
    """Stations among which every bag of ``fraction`` of them has ``k``, but for a few targets in ten thousand."""
    return math.ceil(k / fraction + 4.0 * math.sqrt(k * (1.0 - fraction)) / fraction) + 2 if fraction < 1.0 else k


def shared_predictions(targets: DataFrame, points: DataFrame, models: Sequence[Variogram | None], k: int, fraction: float = 1.0,
                       target_id: str = "station_id", x: str = "x_pl", y: str = "y_pl") -> DataFrame:
    """``(target_id, kriged)``: an array with the prediction of each model from its ``k`` nearest points, NULL for a missing model.

    One search over the stations of all models serves them all; each then takes its own first ``k`` of what was found, and all
    systems of a target are solved in the same batch. Where a model has fewer than ``k`` points among the stations found, these targets search
    again twice as far, until it has, or all stations were found. ``points`` is from :func:`shared_points`.
    """
    count = len(models)
    known = points.select("_pid", F.col("x_pl").alias(x), F.col("y_pl").alias(y), "px", "py", "pz").persist()
    stations = known.count()
    id_field = targets.schema[target_id]
    schema = f"`{target_id}` {id_field.dataType.simpleString()}, kriged array<double>, enough boolean, tx double, ty double"
    wide = neighbours_to_search(k, fraction)
    asked, done = targets.select(target_id, x, y), None
    while True:
        wide = min(wide, max(stations, 1))
        found = nearest(asked, known, wide, query_id=target_id, base_id="_pid", x=x, y=y, payload=("px", "py", "pz"), distinct_base=True, lists=True)
        flat = found.select(target_id, F.col("qx").alias("tx"), F.col("qy").alias("ty"), *(F.flatten(f"nbr_p{c}").alias(f"n{c}") for c in "xyz"))
        all_found = wide >= stations

        def score(batches: Iterator[pa.RecordBatch], all_found: bool = all_found) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, TARGETS_PER_CHUNK):
                    yield _score_chunk(batch.slice(start, TARGETS_PER_CHUNK), models, k, all_found, target_id)

        scored = cut_lineage(flat.mapInArrow(score, schema))
        enough = scored.filter("enough").select(target_id, "kriged")
        done = enough if done is None else done.unionByName(enough)
        short = scored.filter("NOT enough")
        if all_found or short.isEmpty():
            break
        asked, wide = short.select(target_id, F.col("tx").alias(x), F.col("ty").alias(y)), 2 * wide
    known.unpersist()
    return done


def _score_chunk(chunk: pa.RecordBatch, models: Sequence[Variogram | None], k: int, all_found: bool, target_id: str) -> pa.RecordBatch:
    """Predictions of all models at the targets of a chunk, whose targets found equally many stations."""
    n, count = chunk.num_rows, len(models)
    nx, ny, nz = (chunk.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1, count) for c in ("nx", "ny", "nz"))
    tx, ty = (chunk.column(c).to_numpy(zero_copy_only=False) for c in ("tx", "ty"))
    out, enough = np.full((n, count), np.nan), np.ones(n, dtype=bool)
    for m, model in enumerate(models):
        if model is None:
            continue
        serves = ~np.isnan(nz[:, :, m])
        have = np.minimum(serves.sum(axis=1), k)
        enough &= all_found | (have == k)
        order = np.argsort(~serves, axis=1, kind="stable")[:, :k]  # nearest first, as they were found
        for size in np.unique(have[have > 0]):
            at = np.flatnonzero(have == size)
            mine = order[at, :size]
            out[at, m] = _kriged(model, *(np.take_along_axis(v[at, :, m], mine, axis=1) for v in (nx, ny, nz)), tx[at], ty[at])
    kriged = pa.array([[None if np.isnan(v) else v for v in row] for row in out.tolist()], type=pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([chunk.column(target_id), kriged, pa.array(enough), chunk.column("tx"), chunk.column("ty")], names=[target_id, "kriged", "enough", "tx", "ty"])


def clamp_residual(kriged: Column, limit: float) -> Column:
    """Kriged residuals held within ``±limit``; NaN and NULL count as no correction."""
    finite = F.when(~F.isnan(kriged), kriged)
    return F.coalesce(F.greatest(F.least(finite, F.lit(limit)), F.lit(-limit)), F.lit(0.0))


@dataclass
class KrigingModel:
    """Fitted kriging of one value column over all its points."""

    points: DataFrame
    value: str
    model: Variogram
    neighbors: int

    @staticmethod
    def fit(points: DataFrame, value: str, kind: str, lags: int, config: AnalysisConfig, seed: int,
            id_col: str = "station_id") -> KrigingModel | None:
        """None when the points do not give a variogram."""
        kept = points.select(F.col(id_col).alias("station_id"), "x_pl", "y_pl", F.col(value).alias("z")).na.drop()
        moved = jittered(kept, seed, "station_id")
        model = fitted_variogram(moved, "z", kind, lags, config.variogram_reach)
        return None if model is None else KrigingModel(moved, "z", model, config.kriging_neighbors)

    def predict(self, targets: DataFrame, name: str, target_id: str = "station_id",
                x: str = "x_pl", y: str = "y_pl") -> DataFrame:
        scored = local_predictions(targets, self.points, self.value, self.model, self.neighbors, target_id, x=x, y=y)
        return targets.join(scored.withColumnRenamed("kriged", name), target_id, "left")


class KrigingBaseline:
    """Plain ordinary kriging of temperature; the mean where kriging has no answer."""

    def __init__(self, config: AnalysisConfig):
        self.config = config
        self.mean: float | None = None
        self.kriging: KrigingModel | None = None

    def fit(self, stations: DataFrame, id_col: str = "station_id") -> KrigingBaseline:
        self.mean = stations.agg(F.avg("temp")).first()[0]
        self.kriging = KrigingModel.fit(
            stations, "temp", self.config.baseline_variogram, self.config.baseline_lags, self.config,
            self.config.split_seed, id_col,
        )
        return self

    def predict(self, targets: DataFrame, name: str = "predicted", target_id: str = "station_id") -> DataFrame:
        if self.kriging is None:
            return targets.withColumn(name, F.lit(self.mean))
        scored = self.kriging.predict(targets, name, target_id)
        finite = F.when(~F.isnan(name), F.col(name))
        return scored.withColumn(name, F.coalesce(finite, F.lit(self.mean)))
