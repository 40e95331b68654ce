"""Station-level filters, gates and the one-station-per-location rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.config import SOURCE_PRIORITY, UNKNOWN_PRIORITY, AnalysisConfig
from stationgrid.operators.sizes import at_least


def source_priority(source: Column | str = "source") -> Column:
    """Rank of a network; unknown networks come last."""
    source = F.col(source) if isinstance(source, str) else source
    ranks = F.create_map(*[F.lit(v) for pair in SOURCE_PRIORITY.items() for v in pair])
    return F.coalesce(F.try_element_at(ranks, source), F.lit(UNKNOWN_PRIORITY))


def order_by_priority(stations: DataFrame) -> DataFrame:
    return stations.orderBy(source_priority(), "station", "temp", "station_id")


def dedupe_locations(stations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Keep the best-ranked station at each exact (lat, lon).

    ``min`` of a struct combines map-side, so a location holding a large share of
    all rows shrinks to one row per task before the shuffle. Ties fall to
    station, temp, station_id.
    """
    keys = [*by, "lat", "lon"]
    rest = [c for c in stations.columns if c not in keys]
    order = [source_priority().alias("_priority"), F.col("station").alias("_s"), F.col("temp").alias("_t"),
             F.col("station_id").alias("_i")]
    best = stations.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_best"))
    return best.select(*keys, "_best._row.*").select(*stations.columns)


def drop_incomplete(stations: DataFrame, columns: list[str]) -> DataFrame:
    return stations.na.drop(subset=columns)


def display_stations(stations: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Rows of the networks to draw; an empty selection draws all of them."""
    return stations.filter(F.col("source").isin(*sources)) if sources else stations


def enough_stations(stations: DataFrame, config: AnalysisConfig) -> bool:
    return at_least(stations, config.min_stations)


def quality_control_applies(stations: DataFrame, config: AnalysisConfig) -> bool:
    """Needs the switch, a height column and twice as many rows as neighbours."""
    return config.qc_enabled and "dem" in stations.columns and at_least(stations, 2 * config.qc_neighbors)


def gate_report(stations: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The two size gates as one row, for run reports."""
    has_dem = F.lit("dem" in stations.columns)
    n = F.count(F.lit(1))
    return stations.agg(
        n.alias("n_rows"),
        (n >= config.min_stations).alias("enough_stations"),
        ((n >= 2 * config.qc_neighbors) & has_dem).alias("qc_applies"),
    )


def label_stations(stations: DataFrame, cell_deg: float) -> DataFrame:
    """One labelled station per map cell: the best-ranked with a temperature.

    Cell numbers truncate toward zero.
    """
    cells = stations.filter(F.col("temp").isNotNull()).withColumns(
        {
            "cell_x": (F.col("lon") / F.lit(cell_deg)).cast("int"),
            "cell_y": (F.col("lat") / F.lit(cell_deg)).cast("int"),
        }
    )
    order = F.struct(source_priority().alias("p"), F.col("station_id").alias("station_id"),
                     F.struct("station", "source", "temp", "lon", "lat").alias("row"))
    best = cells.groupBy("cell_x", "cell_y").agg(F.min(order).alias("best"))
    return best.select("cell_x", "cell_y", "best.station_id", "best.row.*")
