import numpy as np
import pytest
from pyspark.sql import functions as F

from stationgrid.operators.grid import GridSpec, complete_rectangle, grid_cells, scatter, smooth
from stationgrid.operators.raster import geographic_target, regrid_to_degrees, sample_bands, sample_layers
from stationgrid.operators.terrain import terrain_layers
from stationgrid.sources.tables import RasterMeta


def pixels(spark, array):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, "r int, c int, value double")


def as_array(df, name, shape):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", name).collect():
        if row[name] is not None:
            out[row["r"], row["c"]] = row[name]
    return out


def meta(shape, nodata=-9999.0):
    return RasterMeta("dem", 14.0, 55.0, 0.2, -0.15, *shape, nodata)


def test_terrain_layers_equal_numpy(spark):
    rng = np.random.default_rng(3)
    dem = rng.uniform(0, 1000, (12, 15))
    dem[rng.uniform(size=dem.shape) < 0.05] = np.nan
    filled = np.where(np.isnan(dem), np.nanmedian(dem), dem)
    layers = terrain_layers(pixels(spark, dem), meta(dem.shape), (3, 9), pixel_size=1.0).persist()
    dy, dx = np.gradient(filled)
    slope = np.degrees(np.arctan(np.hypot(dx, dy)))
    curvature = np.gradient(dx, axis=1) + np.gradient(dy, axis=0)
    for name, expected in (("slope", slope), ("curvature", curvature)):
        expected = np.where(np.isnan(dem), np.nan, expected)
        assert np.allclose(as_array(layers, name, dem.shape), expected, equal_nan=True)
    for w in (3, 9):
        h = w // 2
        padded = np.pad(dem, h, constant_values=np.nan)
        windows = np.lib.stride_tricks.sliding_window_view(padded, (w, w)).reshape(*dem.shape, -1)
        assert np.allclose(as_array(layers, f"tpi_{w}", dem.shape), dem - np.nanmean(windows, axis=-1), equal_nan=True)
        assert np.allclose(as_array(layers, f"roughness_{w}", dem.shape), np.nanstd(windows, axis=-1))


def test_plane_has_no_relief_and_constant_slope(spark):
    plane = np.add.outer(3.0 * np.arange(9), 4.0 * np.arange(9))
    layers = terrain_layers(pixels(spark, plane), meta(plane.shape), (3,), pixel_size=1.0)
    assert np.allclose(as_array(layers, "slope", plane.shape), np.degrees(np.arctan(5.0)))
    assert np.allclose(as_array(layers, "tpi_3", plane.shape)[1:-1, 1:-1], 0.0)
    assert np.allclose(as_array(layers, "curvature", plane.shape), 0.0)


def test_roughness_is_zero_not_null_without_neighbours(spark):
    dem = np.full((3, 3), -9999.0)
    dem[0, 0] = 5.0
    layers = terrain_layers(pixels(spark, dem), meta(dem.shape), (3,), pixel_size=1.0)
    assert np.allclose(as_array(layers, "roughness_3", dem.shape), 0.0)
    assert np.isnan(as_array(layers, "tpi_3", dem.shape)).sum() == 8


def test_nodata_is_kept_in_parity_mode(spark):
    dem = np.full((3, 3), 1.0)
    dem[1, 1] = -9999.0
    raw = terrain_layers(pixels(spark, dem), meta(dem.shape), (3,), pixel_size=1.0, mask=False)
    assert as_array(raw, "tpi_3", dem.shape)[1, 1] < -8000


def test_smoothing_keeps_constants_and_holes(spark):
    field = np.full((8, 6), 4.25)
    field[2:4, 1] = np.nan
    df = pixels(spark, field)
    assert np.allclose(as_array(smooth(df, ["value"], 1.3), "value", field.shape), field, equal_nan=True)
    assert smooth(df, ["value"], 0.0) is df


def test_sampling_bounds_and_nodata(spark):
    dem = np.array([[1.0, -9999.0], [3.0, 4.0]])
    bands = pixels(spark, dem).selectExpr("'dem' AS band", "*")
    points = spark.createDataFrame(
        [(1, 14.0, 55.0), (2, 14.3, 54.95), (3, 14.3, 54.8), (4, 14.4, 54.9), (5, 13.9, 54.9), (6, 14.1, 54.69)],
        "station_id int, lon double, lat double",
    )
    got = {r["station_id"]: r["dem"] for r in sample_bands(points, bands, [meta((2, 2))]).collect()}
    # 4 lies on the right edge: inside the inclusive bounds, outside the array
    assert got == {1: 1.0, 2: None, 3: 4.0, 4: None, 5: None, 6: None}


def test_grid_is_half_open_and_ordered_north_to_south(spark):
    spec = GridSpec(0.0, 0.0, 10_000.0, 9_999.0, 5_000.0)
    cells = {(r["r"], r["c"]): (r["x"], r["y"]) for r in grid_cells(spark, spec).collect()}
    assert cells == {(0, 0): (0.0, 9_999.0), (0, 1): (5_000.0, 9_999.0), (1, 0): (0.0, 4_999.0), (1, 1): (5_000.0, 4_999.0)}
    one = spark.createDataFrame([(0, 1, 7.0)], "r int, c int, v double")
    assert sorted(str(r["v"]) for r in scatter(grid_cells(spark, spec), one, ["v"]).collect()) == ["7.0", "None", "None", "None"]


def test_regrid_of_a_plane_is_the_plane(spark):
    from stationgrid.functions.crs import with_metres

    spec = GridSpec(400_000.0, 400_000.0, 600_000.0, 600_000.0, 10_000.0)
    cells = grid_cells(spark, spec).selectExpr("r", "c", "2 * x - y AS value")
    target = geographic_target(spark, 18.5, 52.2, 0.1, 5, 8)
    got = with_metres(regrid_to_degrees(cells, spec.min_x, spec.max_y, spec.step, target)).collect()
    assert len(got) == 40
    assert all(row["value"] == pytest.approx(2 * row["x_pl"] - row["y_pl"], abs=1e-6) for row in got)


def test_missing_pixel_rows_are_gaps_not_neighbours(spark):
    """Left-out pixels must not make distant ones neighbours."""
    dem = np.add.outer(np.arange(8.0) * 10, np.arange(9.0))
    table = pixels(spark, dem).filter("NOT (r = 4 OR c = 5)")
    layers = terrain_layers(table, meta(dem.shape), (3,), pixel_size=1.0).persist()
    slope = as_array(layers, "slope", dem.shape)
    present = np.ones(dem.shape, bool)
    present[4, :] = present[:, 5] = False
    steep = np.degrees(np.arctan(np.hypot(10, 1)))
    assert np.allclose(slope[present], steep) and np.isnan(slope[~present]).all()
    tpi = as_array(layers, "tpi_3", dem.shape)
    for r, c in ((3, 4), (5, 6), (0, 0), (3, 1), (2, 6)):
        near = [dem[a, b] for a in range(r - 1, r + 2) for b in range(c - 1, c + 2) if 0 <= a < 8 and 0 <= b < 9 and present[a, b]]
        assert tpi[r, c] == pytest.approx(dem[r, c] - np.mean(near))


def test_smoothing_of_a_sparse_table_equals_one_with_nulls(spark):
    rng = np.random.default_rng(4)
    field = rng.uniform(0, 20, (7, 8))
    field[2, :3] = field[:, 6] = np.nan
    full = pixels(spark, field)
    shape = field.shape
    sparse = as_array(smooth(full.filter("value IS NOT NULL"), ["value"], 1.0), "value", shape)
    assert np.allclose(sparse, as_array(smooth(full, ["value"], 1.0), "value", shape), equal_nan=True)


@pytest.mark.parametrize("span", [1, 4, 7])
def test_spans_with_halo_equal_whole_lines(spark, span):
    rng = np.random.default_rng(9)
    dem = rng.uniform(0, 500, (11, 16))
    dem[rng.uniform(size=dem.shape) < 0.1] = np.nan
    whole = pixels(spark, dem).selectExpr("r - 5 AS r", "c - 6 AS c", "value")
    key = lambda row: (row["r"], row["c"])
    for table in (whole, whole.filter("NOT (r = 0 OR c = -2)")):
        for make in (lambda s: terrain_layers(table, meta(dem.shape), (3, 9), pixel_size=30.0, span=s), lambda s: smooth(table, ["value"], 1.0, s)):
            want, got = (sorted(make(s).collect(), key=key) for s in (4096, span))
            assert [key(row) for row in got] == [key(row) for row in want]
            for name in want[0].asDict():
                a, b = (np.array([np.nan if row[name] is None else row[name] for row in rows], dtype=float) for rows in (got, want))
                assert np.allclose(a, b, rtol=1e-9, atol=1e-7, equal_nan=True), name


def test_pixels_are_never_broadcast(spark):
    """Compressed files look small to the optimizer, whatever number of pixels they hold."""
    meta = RasterMeta("dem", 0.0, 10.0, 1.0, -1.0, 10, 10, None)
    grid = pixels(spark, np.arange(100.0).reshape(10, 10))
    points = spark.createDataFrame([(i, 0.5 + i, 9.5) for i in range(12)], "station_id long, lon double, lat double")
    plain = sample_bands(points, grid.withColumn("band", F.lit("dem")), [meta])
    layered = sample_layers(points, grid, meta, ["value"])
    for found, name in ((plain, "dem"), (layered, "value")):
        right = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner" if name == "dem" else "Join LeftOuter")[1].split("\n")[0]
        assert "strategy=merge" in right
        assert {r.station_id: r[name] for r in found.collect()} == {i: float(i) if i < 10 else None for i in range(12)}


def test_missing_pixels_come_back_without_a_broadcast(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0)], "r int, c int, value double")
    full = complete_rectangle(cells)
    assert "strategy=merge" in full._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].split("\n")[0]
    got = {(row.r, row.c): (row.value, row.present) for row in full.collect()}
    assert got == {(0, 0): (1.0, True), (0, 1): (None, False), (0, 2): (2.0, True), (1, 0): (None, False), (1, 1): (3.0, True), (1, 2): (None, False)}
