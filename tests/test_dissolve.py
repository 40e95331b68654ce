import numpy as np
import pytest

from stationgrid.operators.boundary import mark_inside
from stationgrid.operators.dissolve import dissolve
from stationgrid.operators.grid import GridSpec, mask_runs, prediction_grid
from stationgrid.sources.tables import boundary_edges


def edges_of(spark, rings):
    rows = [(k, i, float(x), float(y)) for k, ring in enumerate(rings) for i, (x, y) in enumerate([*ring, ring[0]])]
    return boundary_edges(spark.createDataFrame(rows, "ring_id int, seq int, lon double, lat double"), projected=False)


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n)]


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 <= y < y2) or (y2 <= y < y1):
            odd ^= x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return odd


def check(spark, rings, low=-20.0, high=120.0, n=400, seed=0):
    border = dissolve(edges_of(spark, rings))
    xy = np.random.default_rng(seed).uniform(low, high, (n, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "station_id int, x double, y double")
    got = {r.station_id: r.inside for r in mark_inside(points, border, "x", "y").collect()}
    assert got == {i: any(inside(ring, a, b) for ring in rings) for i, (a, b) in enumerate(xy)}
    return border


def test_overlapping_adjacent_nested_and_repeated_boxes(spark):
    rings = [box(0, 0, 50, 50), box(30, 20, 80, 70), box(80, 20, 100, 70), box(10, 10, 20, 20), box(0, 0, 50, 50), box(50, 0, 60, 20), box(-10, 90, 0, 100)]
    border = check(spark, rings)
    length = sum(float(np.hypot(r.x2 - r.x1, r.y2 - r.y1)) for r in border.collect())
    # the outline: no border between neighbours, none inside
    assert length == pytest.approx((100 + 2 * 70) + 100 + 40, abs=1e-3)


def test_random_polygons(spark):
    rng = np.random.default_rng(4)
    rings = []
    for _ in range(12):
        x, y = rng.uniform(10, 90, 2)
        angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
        radius = rng.uniform(5, 30, 9)
        rings.append(list(zip(x + radius * np.cos(angle), y + radius * np.sin(angle), strict=True)))
    check(spark, rings, n=600)


def test_neighbours_with_corners_on_each_others_borders(spark):
    check(spark, [box(0, 0, 40, 100), box(40, 0, 100, 30), box(40, 30, 70, 100), box(70, 25, 100, 110)])


def test_one_ring_stays_and_nothing_gives_nothing(spark):
    ring = [(0, 0), (60, 10), (40, 80), (20, 30)]
    assert check(spark, [ring]).count() == 4
    assert dissolve(edges_of(spark, [ring]).limit(0)).collect() == []


def mask_by_points(spark, spec, edges):
    cells = [(r, c, spec.min_x + c * spec.step, spec.max_y - r * spec.step) for r in range(spec.height) for c in range(spec.width)]
    df = spark.createDataFrame(cells, "r int, c int, x double, y double")
    return {(r.r, r.c): r.inside for r in mark_inside(df, edges, "x", "y", ["r", "c"]).collect()}


def test_scanlines_equal_the_test_of_every_cell(spark):
    rng = np.random.default_rng(6)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 40))
    radius = rng.uniform(10, 50, 40)
    star = list(zip(50 + radius * np.cos(angle), 50 + radius * np.sin(angle), strict=True))
    hole, corners = box(45, 45, 55, 55), box(0, 0, 30, 20)  # corners lie on centres of cells
    spec = GridSpec(-5.0, -5.0, 105.0, 105.0, 2.5)
    edges = edges_of(spark, [star, hole, corners])
    cells = prediction_grid(spark, spec, edges).collect()
    assert len(cells) == spec.width * spec.height
    assert {(r.r, r.c): r.inside for r in cells} == mask_by_points(spark, spec, edges)
    assert mask_runs(spark, spec, edges).count() < len(cells) / 4


def test_scanlines_outside_and_beyond_the_grid(spark):
    spec = GridSpec(0.0, 0.0, 10.0, 10.0, 1.0)
    around = prediction_grid(spark, spec, edges_of(spark, [box(-5, -5, 20, 20)])).collect()
    beside = prediction_grid(spark, spec, edges_of(spark, [box(-5, -5, -1, 20)])).collect()
    none = prediction_grid(spark, spec, edges_of(spark, [box(0, 0, 1, 1)]).limit(0)).collect()
    assert {r.inside for r in around} == {True} and {r.inside for r in beside} == {False} and {r.inside for r in none} == {False}
    assert {(r.r, r.c) for r in none} == {(r, c) for r in range(10) for c in range(10)}
