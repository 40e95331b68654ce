"""Feature assembly, screening and imputation for stations and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.config import ID_COLUMNS, INTERACTION_PAIRS, AnalysisConfig
from stationgrid.functions.crs import with_metres
from stationgrid.functions.stats import medians
from stationgrid.operators.proximity import mountain_distance, mountain_pixels, spatial_lag
from stationgrid.operators.raster import sample_bands, sample_layers
from stationgrid.operators.terrain import encode_aspect, has_valid_heights, terrain_columns, terrain_layers
from stationgrid.sources.tables import RasterMeta


@dataclass(frozen=True)
class FeatureModel:
    """What training fixed: the features in order and the median of each."""

    features: tuple[str, ...]
    medians: Mapping[str, float] = field(default_factory=dict)

    def roles(self, trend: Sequence[str]) -> tuple[list[str], list[str]]:
        """(trend, environment) columns; identity and coordinate columns are neither."""
        skip = {*ID_COLUMNS, *trend}
        return list(trend), [c for c in self.features if c not in skip]


def coast_distance(northing: Column, coast_northing: float) -> Column:
    """Kilometres south of a constant northing, 0 beyond it."""
    return F.greatest(F.lit(coast_northing) - northing, F.lit(0.0)) / 1000.0


def elevation_features(df: DataFrame, low: float, high: float) -> DataFrame:
    """Position between the fitted extremes, and height in km squared."""
    extra = {"elevation_squared": F.pow(F.col("dem") / 1000.0, F.lit(2.0))}
    if high > low:
        extra["elevation_percentile"] = (F.col("dem") - F.lit(low)) / F.lit(high - low)
    return df.withColumns(extra)


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]] = INTERACTION_PAIRS) -> DataFrame:
    """Products of the pairs whose two columns exist, plus squared height."""
    made: dict[str, Column] = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            made[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            if a == "dem":
                made["dem_squared"] = F.col("dem") * F.col("dem")
    return df.withColumns(made) if made else df


@dataclass(frozen=True)
class RasterSet:
    """Bands with their positions, and the terrain layers computed once from them."""

    pixels: DataFrame
    metas: tuple[RasterMeta, ...]
    terrain: DataFrame | None = None
    mountains: DataFrame | None = None

    def meta(self, band: str) -> RasterMeta | None:
        return next((m for m in self.metas if m.band == band), None)

    @staticmethod
    def prepare(pixels: DataFrame, metas: Sequence[RasterMeta], config: AnalysisConfig) -> RasterSet:
        """Terrain layers and mountain pixels, kept for stations and grid alike."""
        plain = RasterSet(pixels, tuple(metas))
        meta = plain.meta("dem")
        if meta is None:
            return plain
        dem = pixels.filter(F.col("band") == "dem")
        mountains = mountain_pixels(dem, meta, config.mountain_height)
        if not has_valid_heights(dem, meta):
            return RasterSet(pixels, tuple(metas), None, mountains)
        return RasterSet(pixels, tuple(metas), terrain_layers(dem, meta, config.terrain_windows).persist(), mountains)


def attach_features(points: DataFrame, rasters: RasterSet, config: AnalysisConfig, id_col: str = "station_id",
                    fill_dem: float | None = None, lag: bool = False) -> DataFrame:
    """All engineered columns of a point table that has ``lon, lat``.

    ``fill_dem`` fills missing heights before interactions, as a grid needs it.
    """
    located = points if "x_pl" in points.columns else with_metres(points)
    located = sample_bands(located, rasters.pixels, list(rasters.metas), id_col)
    if fill_dem is not None and "dem" in located.columns:
        located = located.withColumn("dem", F.coalesce("dem", F.lit(fill_dem)))
    if rasters.terrain is not None:
        names = terrain_columns(config.terrain_windows)
        located = encode_aspect(sample_layers(located, rasters.terrain, rasters.meta("dem"), names))
    located = located.withColumn("dist_coast", coast_distance(F.col("y_pl"), config.coast_northing))
    if rasters.mountains is not None:
        located = located.join(mountain_distance(located.select(id_col, "x_pl", "y_pl"), rasters.mountains, id_col), id_col, "left")
    if lag and "temp" in located.columns:
        located = located.join(spatial_lag(located, config.lag_neighbors, id_col), id_col, "left")
    return interactions(located)


def valid_percent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, valid_pct)``: share of non-null values of each column."""
    one = df.agg(*[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {pairs}) AS (feature, valid_pct)")


def usable_features(df: DataFrame, columns: Sequence[str], min_fraction: float) -> list[str]:
    """Columns with at least ``min_fraction`` non-null values, in the given order."""
    kept = valid_percent(df, columns).filter(F.col("valid_pct") >= 100 * min_fraction)
    names = {row["feature"] for row in kept.collect()}  # one short row per column
    return [c for c in columns if c in names]


def null_count(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total


def drop_sparse_rows(df: DataFrame, columns: Sequence[str], max_fraction: float) -> DataFrame:
    """Rows missing fewer than ``max_fraction`` of the columns."""
    return df.filter(null_count(columns) < F.lit(len(columns) * max_fraction))


def impute(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in fills.items() if c in df.columns})


def fit_features(df: DataFrame, columns: Sequence[str], config: AnalysisConfig) -> tuple[DataFrame, FeatureModel]:
    """Screen columns, drop sparse rows, impute medians; returns the fitted choices."""
    features = usable_features(df, columns, config.min_valid_fraction)
    kept = drop_sparse_rows(df, features, config.max_null_fraction)
    fills = medians(kept, features)
    return impute(kept, fills), FeatureModel(tuple(features), fills)


def engineer_features(stations: DataFrame, rasters: RasterSet, config: AnalysisConfig) -> tuple[DataFrame, FeatureModel]:
    """The whole station feature step: attach, screen, drop, impute."""
    before = set(stations.columns) - {"x_pl", "y_pl"}
    full = attach_features(stations, rasters, config).persist()
    made = [c for c in full.columns if c not in before and c != "temp"]
    return fit_features(full, made, config)


def align_to_training(df: DataFrame, needed: Sequence[str], fills: Mapping[str, float]) -> DataFrame:
    """Needed columns only: present values, else the training median, else 0."""
    extra = [c for c in df.columns if c not in needed]
    aligned = {
        c: F.coalesce(F.col(c), F.lit(float(fills.get(c, 0.0)))) if c in df.columns else F.lit(float(fills.get(c, 0.0)))
        for c in needed
    }
    return df.select(*extra, *[v.alias(k) for k, v in aligned.items()])


def bind_blocks(left: DataFrame, *blocks: DataFrame, on: Sequence[str]) -> DataFrame:
    """Put feature blocks side by side by key."""
    for block in blocks:
        left = left.join(block, list(on), "left")
    return left
