import pytest
from pyspark.sql import functions as F

from stationgrid.config import AnalysisConfig, BoundingBox
from stationgrid.functions.cleaning import ascii_fold, clean_station_name, clean_temperature, decode_entities
from stationgrid.functions.crs import to_metres, with_degrees, with_metres
from stationgrid.operators.boundary import mark_inside
from stationgrid.operators.colors import bin_of, classify, color_index
from stationgrid.operators.stations import dedupe_locations, order_by_priority
from stationgrid.session import scratch_path
from stationgrid.sinks.geocache import upsert_geocode_cache
from stationgrid.sources.feeds import STATION_SCHEMA, parse_crowd, landed_status, parse_national, read_landed, union_feeds, within_box
from stationgrid.sources.tables import boundary_edges, newest_version, read_color_scale, read_geocode_cache
from stationgrid.streaming.landing import land_stations, latest_readings, payload_stream


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text,dot,strip", [
    ("12,5", 12.5, 125.0), ("12.5↓", 12.5, 12.5), (" 7 ", 7.0, 7.0), ("", None, None), (None, None, None),
    ("brak", None, None), ("-3↑", -3.0, -3.0), ("NaN", None, None),
])
def test_temperature_texts(spark, text, dot, strip):
    value = F.lit(text).cast("string")
    assert one(spark, clean_temperature(value)) == dot
    assert one(spark, clean_temperature(value, "strip")) == strip


def test_names(spark):
    assert one(spark, clean_station_name(F.lit(" ŚREDNIA Max Opole z pomiarów\t"))) == "Opole"
    assert one(spark, clean_station_name(F.lit("Jasmin"))) == "Jas"
    assert one(spark, ascii_fold(F.lit("Żółć Łódź"))) == "Zolc Lodz"


def test_projection_check_values(spark):
    x, y = to_metres("21.0122D", "52.2297D")
    assert one(spark, x) == pytest.approx(637382.204, abs=1e-3) and one(spark, y) == pytest.approx(486757.209, abs=1e-3)
    assert one(spark, to_metres("19D", "52D")[1]) == pytest.approx(459309.2094, abs=1e-4)
    place = spark.range(1).selectExpr("21.0122D AS lon", "52.2297D AS lat")
    back = with_degrees(with_metres(place).drop("lon", "lat"), "x_pl", "y_pl").first()
    assert back["lon"] == pytest.approx(21.0122, abs=1e-10) and back["lat"] == pytest.approx(52.2297, abs=1e-10)


def test_crowd_epochs_compare_as_numbers(spark):
    payload = '{"body":[{"place":{"location":[20.0,52.0]},"measures":{"m":{"type":["humidity","temperature"],"res":{"9":[50,1.0],"10":[51,2.0]}}}}]}'
    df = spark.createDataFrame([(payload,)], "payload string")
    assert [tuple(r) for r in parse_crowd(df).collect()] == [("Unknown", 2.0, 52.0, 20.0, "NETATMO")]
    assert parse_crowd(df, value_index=0).first()["temp"] == 51.0


def test_a_feed_that_delivered_nothing_is_an_empty_table(spark):
    missing = read_landed(spark, "/tmp/stationgrid-no-such-folder", STATION_SCHEMA)
    assert missing.count() == 0 and missing.schema == STATION_SCHEMA
    broken = spark.createDataFrame([("not json",), ("[]",)], "payload string")
    assert union_feeds(parse_national(broken), missing).count() == 0


def test_location_ties_fall_to_source_then_name(spark):
    rows = [(1, "b", "TRAX", 1.0, 5.0), (2, "a", "TRAX", 1.0, 4.0), (3, "z", "NETATMO", 1.0, 3.0), (4, "q", "??", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "station_id int, station string, source string, lat double, temp double").withColumn("lon", F.lit(1.0))
    assert {r["station_id"] for r in dedupe_locations(df).collect()} == {2, 4}
    assert [r["station_id"] for r in order_by_priority(df).collect()] == [2, 1, 3, 4]


def test_box_filter_reaches_the_scan(spark, sf):
    path = scratch_path(spark, "box")
    spark.createDataFrame([(50.0, 20.0), (40.0, 20.0)], "lat double, lon double").write.parquet(path)
    df = within_box(spark.read.parquet(path), BoundingBox())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat,48.4)" in plan and df.count() == 1


@pytest.mark.parametrize("limit", [200_000, 0])
def test_boundary_paths_agree(spark, limit):
    ring = [(1, i, *p) for i, p in enumerate([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)])]
    edges = boundary_edges(spark.createDataFrame([tuple(map(float, r)) for r in ring], "ring_id double, seq double, lon double, lat double"), projected=False)
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 7.0), (3, 1.0, 8.0), (4, 11.0, 5.0), (5, 5.0, 50.0)], "station_id int, x_pl double, y_pl double")
    inside = {r["station_id"] for r in mark_inside(points, edges, broadcast_rows=limit).filter("inside").collect()}
    near = {r["station_id"] for r in mark_inside(points, edges, tolerance=1.6, broadcast_rows=limit).filter("inside").collect()}
    assert inside == {1, 3} and near == {1, 2, 3, 4}


def test_geocode_cache_versions(spark):
    path = scratch_path(spark, "cache-test")
    row = lambda k, lat: spark.createDataFrame([(k, lat, 20.0)], "cache_key string, lat double, lon double")
    assert read_geocode_cache(spark, path).count() == 0
    assert upsert_geocode_cache(spark, path, row("a|PL", 50.0)) == 1
    assert upsert_geocode_cache(spark, path, row("a|PL", 51.0).union(row("b|PL", 52.0))) == 2
    assert {r["cache_key"]: r["lat"] for r in read_geocode_cache(spark, path).collect()} == {"a|PL": 51.0, "b|PL": 52.0}
    assert newest_version(spark, path) == 2


def test_colour_classes_clip_and_spread(spark):
    scale = spark.createDataFrame([(-10, "#a"), (0, "#b"), (10, "#c"), (25, "#d")], "value int, color string")
    bounds = F.array(*map(F.lit, (-10.0, 0.0, 10.0, 25.0)))
    got = [one(spark, color_index(F.lit(v), bounds)) for v in (-99.0, -10.0, -0.1, 0.0, 12.0, 25.0, 99.0)]
    assert got == [0, 0, 0, 1, 3, 3, 3]
    assert read_color_scale(spark, "/tmp/stationgrid-no-such.csv").count() == 0
    values = spark.createDataFrame([(v,) for v in (-99.0, 5.0, 30.0, None)], "temp double")
    assert [(r.color_index, r.color) for r in classify(values, "temp", scale).collect()] == [(0, "#a"), (1, "#b"), (3, "#d"), (None, None)]
    assert {r.color_index for r in classify(values, "temp", scale.limit(0)).collect()} == {None}
    assert [r.color for r in classify(values, "temp", scale.limit(1)).collect()] == ["#a", "#a", "#a", None]


def test_a_scale_of_ten_thousand_classes(spark):
    scale = spark.range(10_000).selectExpr("CAST(id * 3 AS INT) AS value", "concat('#', id) AS color").repartition(7)
    cells = spark.range(500).selectExpr("id * 67.3D - 1000 AS v")
    for r in classify(cells, "v", scale).collect():
        place = min(max(r.v, 0.0), 29_997.0)
        want = 9_999 if place >= 29_997 else int(9_999 / 9_998 * (place // 3))
        assert r.color_index == want and r.color == f"#{want}"
    bounds = F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0, 16.0)))
    assert [one(spark, bin_of(F.lit(v), bounds)) for v in (0.5, 1.0, 2.0, 3.9, 4.0, 15.9, 16.0, 99.0)] == [0, 0, 1, 1, 2, 3, 4, 4]


def test_landing_stream_parses_new_files_once(spark):
    source, out, log = (scratch_path(spark, n) for n in ("payloads", "landed", "log"))
    batch = spark.createDataFrame([('[{"statName":"x","temp":"1,5"}]',)], "payload string")
    for _ in range(2):
        batch.write.mode("append").parquet(source)
        land_stations(payload_stream(spark, source, "payload string"), parse_national, out, log).awaitTermination(120)
    assert [r["temp"] for r in spark.read.parquet(out).collect()] == [1.5, 1.5]


def test_latest_reading_per_window_is_the_same_on_a_stream(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    readings = lambda df: df.selectExpr("user_id AS station_id", "CAST(ts AS TIMESTAMP) AS ts", "value AS temp")
    expected = {tuple(r) for r in latest_readings(readings(events)).collect()}
    source = scratch_path(spark, "events")
    events.write.parquet(source)
    stream = latest_readings(readings(spark.readStream.schema(events.schema).parquet(source)))
    run = stream.writeStream.format("memory").queryName("latest_test").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT * FROM latest_test").collect()} == expected


def test_defaults_are_immutable():
    with pytest.raises(Exception):
        AnalysisConfig().qc_neighbors = 3


def test_folding_of_latin_letters(spark):
    assert one(spark, ascii_fold(F.lit("Görlitz Třinec Košice Straße Ålesund Æro Øresund Ḁ é"))) == "Gorlitz Trinec Kosice Strasse Alesund AEro Oresund A e"
    assert one(spark, ascii_fold(F.lit("plain ASCII 123"))) == "plain ASCII 123"


def test_character_references(spark):
    cases = {
        "Krak&oacute;w &#8211; Wie&#347; &#x15B;": "Kraków – Wieś ś", "no reference & none": "no reference & none", "&unknown; &; &#x1F642; &lt;b&gt;": "&unknown; &; \U0001f642 <b>",
        "&amp;oacute;": "&oacute;", "": "", "a&nbsp;b": "a b",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "text string, want string")
    for r in rows.select(decode_entities(F.col("text")).alias("got"), "want").collect():
        assert r.got == r.want


def test_unreadable_files_do_not_stop_the_others(spark, tmp_path):
    import pathlib

    rows = spark.createDataFrame([("a", 1.0, 50.0, 20.0, "x", None)], STATION_SCHEMA)
    rows.coalesce(1).write.parquet(f"{tmp_path}/landed")
    pathlib.Path(f"{tmp_path}/landed/part-broken.parquet").write_bytes(b"PAR1 this is not a parquet file")
    assert read_landed(spark, f"{tmp_path}/landed", STATION_SCHEMA).count() == 1
    status = {r.file: (r.n_rows, r.status) for r in landed_status(spark, f"{tmp_path}/landed", STATION_SCHEMA).collect() if r.file.endswith(".parquet")}
    assert status.pop("part-broken.parquet") == (0, "FAILED") and [*status.values()] == [(1, "OK")]
    with pytest.raises(Exception, match="no-such-format"):
        read_landed(spark, f"{tmp_path}/landed", STATION_SCHEMA, "no-such-format")


def test_a_cache_version_is_never_overwritten(spark, tmp_path):
    fresh = spark.createDataFrame([("a|PL", 50.0, 20.0)], "cache_key string, lat double, lon double")
    upsert_geocode_cache(spark, f"{tmp_path}/cache", fresh)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        fresh.write.mode("errorifexists").parquet(f"{tmp_path}/cache/version=1")
