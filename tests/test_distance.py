import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from stationgrid.operators.distance import distance_transform, lower_envelope, mountain_distance_layer
from stationgrid.operators.proximity import mountain_distance, mountain_pixels, pixel_centres
from stationgrid.sources.tables import RasterMeta


def brute(marked, step_x, step_y):
    at = np.argwhere(marked)
    cells = np.argwhere(np.ones_like(marked, dtype=bool))
    apart = (cells[:, None, :] - at[None, :, :]) * np.array([step_y, step_x])
    return {tuple(cell): d for cell, d in zip(cells.tolist(), np.sqrt((apart**2).sum(2)).min(1))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 50)), min_size=1, max_size=30, unique_by=lambda p: p[0]), st.integers(1, 70))
def test_envelope_equals_all_parabolas(parabolas, n):
    at, height = (np.array(v, dtype=float) for v in zip(*sorted(parabolas)))
    x = np.arange(n, dtype=float)
    assert np.array_equal(lower_envelope(at, height**2, x), (height**2 + (x[:, None] - at) ** 2).min(1))


@pytest.mark.parametrize("share", [0.004, 0.05, 0.6, 1.0])
def test_equals_brute_force(spark, share):
    marked = np.random.default_rng(7).uniform(size=(23, 41)) < share
    marked[4, 30] = True
    cells = spark.createDataFrame([(r, c, bool(m)) for (r, c), m in np.ndenumerate(marked)], "r int, c int, m boolean")
    got = {(row.r, row.c): row.distance for row in distance_transform(cells, "m", 250.0, -100.0).collect()}
    assert got == pytest.approx(brute(marked, 250.0, 100.0))


def test_left_out_cells_null_marks_and_other_origins(spark):
    marked = np.zeros((6, 9), dtype=bool)
    marked[0, 8] = marked[5, 1] = True
    want = brute(marked, 1.0, 1.0)
    rows = [(r + 10, c - 4, True if m else None) for (r, c), m in np.ndenumerate(marked) if m or (r + c) % 3]
    got = {(row.r - 10, row.c + 4): row.distance for row in distance_transform(spark.createDataFrame(rows, "r int, c int, m boolean"), "m", 1, 1).collect()}
    assert got == pytest.approx({(r - 10, c + 4): want[r - 10, c + 4] for r, c, _ in rows})


def test_nothing_marked_and_empty(spark):
    cells = spark.createDataFrame([(0, 0, False), (0, 1, None)], "r int, c int, m boolean")
    assert {(row.r, row.c, row.distance) for row in distance_transform(cells, "m", 1.0, 1.0).collect()} == {(0, 0, None), (0, 1, None)}
    assert distance_transform(cells.limit(0), "m", 1.0, 1.0).collect() == []


def test_layer_equals_neighbour_join(spark):
    meta = RasterMeta("dem", 200_000.0, 600_000.0, 500.0, -400.0, 18, 25, -9999.0, geographic=False)
    values = np.random.default_rng(2).uniform(0, 900, (18, 25))
    values[3, :4] = -9999.0
    dem = spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(values)], "r int, c int, value double")
    got = {(row.r, row.c): row.dist_mountains for row in mountain_distance_layer(dem, meta, 800.0).collect()}
    centres = pixel_centres(dem, meta)
    joined = mountain_distance(centres, mountain_pixels(dem, meta, 800.0), "pixel_id")
    assert got == pytest.approx({(row.pixel_id // 25, row.pixel_id % 25): row.dist_mountains for row in joined.collect()})
    assert {row.dist_mountains for row in mountain_distance_layer(dem, meta, 9000.0).collect()} == {0.0}
    with pytest.raises(ValueError):
        mountain_distance_layer(dem, RasterMeta("dem", 14.0, 55.0, 0.2, -0.15, 18, 25, -9999.0), 800.0)


def test_columns_are_read_once_from_each_end(spark):
    """A frame to the end of the column would be read anew for each of its rows."""
    cells = spark.range(40).selectExpr("CAST(id AS INT) AS r", "0 AS c", "id = 7 AS m")
    found = distance_transform(cells, "m", 1.0, 1.0)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.r: r.distance for r in found.collect()} == {i: float(abs(i - 7)) for i in range(40)}
