"""Every tunable of an analysis run in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# Network names, their precedence at a shared location, region ids, bands and, further below, the
# bounds and default thresholds of BoundingBox and AnalysisConfig; results depend on each of them.
NATIONAL, ROAD, CROWD = "IMGW", "TRAX", "NETATMO"
SOURCE_PRIORITY = {"IMGW": 1, "TRAX": 2, "NETATMO": 3}
UNKNOWN_PRIORITY = 99
PROVINCES = tuple(range(1, 17))
ROAD_REGIONS = (35, 4, 48, 12, 8, 3, 37, 6, 10, 88, 11, 7, 74, 5, 9, 39)
RASTER_BANDS = ("dem", "landscan", "land_cover", "settlement", "forests", "ecostress", "water")
TREND_FEATURES = ("dem", "y_pl", "x_pl")
INTERACTION_PAIRS = (
    ("dem", "aspect_sin"),
    ("dem", "aspect_cos"),
    ("dem", "slope"),
    ("ecostress", "settlement"),
    ("dist_coast", "dem"),
)
ID_COLUMNS = ("station", "temp", "geometry", "source", "lat", "lon")
GRID_NODATA = -9999.0
TILE_PIXELS = 256


@dataclass(frozen=True)
class BoundingBox:
    lat_min: float = 48.4
    lat_max: float = 55.4
    lon_min: float = 13.7
    lon_max: float = 24.8


@dataclass(frozen=True)
class TreeConfig:
    """Boosting settings; ``rounds * step`` fixes the total amount of fitting."""

    rounds: int = 200
    step: float = 0.1
    max_depth: int = 5
    min_leaf_rows: int = 60
    subsample: float = 1.0
    feature_fraction: str = "0.3"


@dataclass(frozen=True)
class AnalysisConfig:
    # feeds
    data_mode: str = "all"
    bbox: BoundingBox = field(default_factory=BoundingBox)
    min_stations: int = 50
    # quality control
    qc_enabled: bool = True
    qc_neighbors: int = 10
    qc_threshold: float = 3.5
    elev_sign: int = 1
    standard_lapse_rate: float = 0.0065
    dynamic_lapse_rate: bool = True
    min_trusted_stations: int = 15
    min_elevation_spread: float = 200.0
    max_abs_lapse_rate: float = 0.015
    # features
    terrain_windows: tuple[int, ...] = (3, 9, 27)
    mountain_height: float = 800.0
    coast_northing: float = 600_000.0
    min_valid_fraction: float = 0.10
    max_null_fraction: float = 0.50
    lag_neighbors: int = 5
    # split
    test_size: float = 0.15
    val_size: float = 0.15
    split_seed: int = 42
    buffer_km: float = 20.0
    # model
    trend_features: tuple[str, ...] = TREND_FEATURES
    huber_epsilon: float = 1.35
    trees: TreeConfig = field(default_factory=TreeConfig)
    ensemble_seeds: tuple[int, ...] = (42, 123, 456, 789, 101112)
    bag_fraction: float = 0.95
    residual_kriging: bool = True
    residual_variogram: str = "exponential"
    residual_lags: int = 20
    baseline_variogram: str = "spherical"
    baseline_lags: int = 6
    #: Largest pair distance of a variogram, in metres; its lags divide it.
    variogram_reach: float = 200_000.0
    #: Points of each local system.
    kriging_neighbors: int = 64
    kriging_min_rmse: float = 0.15
    kriging_min_rows: int = 50
    kriging_clamp: float = 5.0
    # grid and products
    grid_resolution: float = 5000.0
    smoothing: bool = True
    smoothing_sigma: float = 1.0
    extrapolation_margin: float = 15.0
    display_sources: tuple[str, ...] = (NATIONAL,)
    label_cell_deg: float = 0.25


# ----------------------------------------------------------------------------
