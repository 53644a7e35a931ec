import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions.numbers import EDGE, EARTH_RADIUS
from tempora.operators import nearest, search, text_index


def on_map(lon, lat):
    lon = (lon + 180) % 360 - 180
    y = EDGE if lat >= 90 else -EDGE if lat <= -90 else max(-EDGE, min(EDGE, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * EARTH_RADIUS))
    return math.radians(lon) * EARTH_RADIUS, y


def distance(a, b):
    (x, y), (u, v) = on_map(*a), on_map(*b)
    return math.hypot(min(abs(x - u), 2 * EDGE - abs(x - u)), y - v)


PLACES = [(1, 179.9, 10.0), (2, -179.9, 20.0), (3, 0.0, 0.0), (4, 0.0, 0.0), (5, 10.0, 0.0), (6, 0.0, 89.9), (7, 0.0, -90.0), (8, None, 1.0), (9, 540.0, 40.0)]
POINTS = [(0, -179.9, 10.0), (1, 179.99, 20.0), (2, 5.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 90.0), (5, 170.0, -89.0), (6, None, None), (7, float("nan"), 0.0), (8, 0.0, 0.0), (9, 180.0, 40.0), (10, -5.0, 0.0)]


def test_nearest_places_equal_all_distances(spark):
    rng = random.Random(3)
    places = PLACES + [(100 + i, rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(150)]
    places += [(1000 + i, 20 + rng.random() / 1e4, 50 + rng.random() / 1e4) for i in range(400)]  # a dense spot
    points = POINTS + [(100 + i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(120)] + [(500 + i, 20 + i / 1e5, 50.0) for i in range(20)]
    own = [p for p in places if p[1] is not None]
    found = nearest.nearest(spark.createDataFrame(points, "q int, lon double, lat double"), spark.createDataFrame(places, "id int, lon double, lat double"), "id")
    got = {r.q: (r.place.id if r.place else None, r.distance) for r in found.collect()}
    assert len(got) == len(points)
    for q, lon, lat in points:
        if lon is None or math.isnan(lon):
            assert got[q] == (None, None)
            continue
        best, want = min((distance((lon, lat), p[1:]), p[0]) for p in own)
        assert got[q][0] == want and math.isclose(got[q][1], best, abs_tol=1e-3), q


def test_a_point_keeps_few_cells_and_hits_what_is_near(spark):
    places = spark.range(5000).select(F.col("id"), (F.col("id") % 100 / 10.0).alias("lon"), (F.floor(F.col("id") / 100) / 10.0).alias("lat"))
    points = spark.createDataFrame([(1, 3.301, 2.2), (2, 100.0, 2.0)], "q int, lon double, lat double")
    found = nearest.nearest(points, places, "id")
    assert {r.q: r.place.id for r in nearest.within(found, 200).collect()} == {1: 2233}


def test_places_alone_in_their_cells_end_the_search(spark, monkeypatch):
    sizes, stored = [], nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda rows, name: sizes.append((name, stored(rows, name).count())) or stored(rows, name))
    rng = random.Random(5)
    places = spark.createDataFrame([(i, rng.uniform(-180, 180), rng.uniform(-80, 80)) for i in range(300)], "id int, lon double, lat double")
    points = spark.createDataFrame([(i, rng.uniform(-180, 180), rng.uniform(-80, 80)) for i in range(100)], "q int, lon double, lat double")
    found = nearest.nearest(points, places, "id")
    kept = [n for name, n in sizes if name == "kept"]
    assert found.count() == 100 and 0 < len(kept) <= 5 and sum(kept) < 100 * 40  # 8 steps before
    assert "Window" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("none", ["places", "points"])
def test_nearest_of_nothing(spark, none):
    rows = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lon double, lat double")
    points, places = (rows, rows.limit(0)) if none == "places" else (rows.limit(0), rows)
    got = nearest.nearest(points, places, "id").collect()
    assert [(r.place, r.distance) for r in got] == ([(None, None)] if none == "places" else [])


def events(spark):
    rng = random.Random(9)
    words = ["Ferry", "ferried", "100%", "a_b", ".*", "Éire", "İz", "x", "yy", "harbour", "Har", "ÉIRE"]
    rows = [(i, " ".join(rng.choices(words, k=3)), rng.choice([None, "", " ".join(rng.choices(words, k=20))]), rng.choice(words), f"18{i % 90 + 10}") for i in range(400)]
    return spark.createDataFrame(rows + rows[:5], "n int, title string, description string, name string, date string").repartition(3)


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    rows, path = events(spark), str(tmp_path / "index")
    text_index.build(rows, path)
    for query in ("ferr", "FERRY", "100%", ".*", "a_b", "éire", "i̇z", "İz", "", "x", "yy", "y x", "harbour harbour", "no such thing", "rfe", "ry 1"):
        want = search.search_flat(rows, query, 1820, 1880)
        got = text_index.search_indexed(spark, path, query, 1820, 1880)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), query
    report = text_index.share_read(spark, path, "harbour").first()
    assert report.rows == 405 and report.rows_found <= report.rows_read < report.rows and 0 < report.entries_read < report.entries / 5
    short = text_index.share_read(spark, path, "yy").first()
    assert short.entries_read == 0 and short.rows_read == 405
    text_index.build(rows.filter("n < 10"), path)
    assert text_index.search_indexed(spark, path, "").count() == 15


def test_lists_of_frequent_grams_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 4)
    rows = spark.range(500).select(F.lit("ferry").alias("title"), F.lit("").alias("description"), F.col("id").cast("string").alias("name"), F.lit("1900").alias("date"))
    text_index.build(rows, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/lists")).agg(F.max(F.size("rows"))).first()[0] <= 16
    assert text_index.search_indexed(spark, str(tmp_path / "index"), "ferry").count() == 500 and text_index.search_indexed(spark, str(tmp_path / "index"), "499").count() == 1


def test_an_index_shuffles_lists_and_not_entries(spark, tmp_path):
    rows = spark.range(3000, numPartitions=2).select(F.lit("ferry across").alias("title"), F.lit(None).cast("string").alias("description"), (F.col("id") % 7).cast("string").alias("name"), F.lit("1900").alias("date"))
    text_index.build(rows, str(tmp_path / "index"))
    lists = spark.read.parquet(str(tmp_path / "index/lists"))
    held = lists.groupBy("block", "gram").count()
    assert held.agg(F.max("count")).first()[0] == 1 and lists.select("block").distinct().count() == 2
    assert dict(lists.dtypes)["rows"] == "array<int>"  # a row is named by its place in the block
    assert text_index.search_indexed(spark, str(tmp_path / "index"), "ferry").count() == 3000


def test_blocks_end_at_gaps_and_at_their_limits():
    import pyarrow as pa

    batch = lambda numbers: pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(["abcd", None, "abc", "bcd", ""][: len(numbers)])], names=["_row", "t"])
    got = [(g, b, r) for x in text_index._blocks(2, 100)([batch([5, 6, 7, 8, 20])]) for g, b, r in zip(*(c.to_pylist() for c in x.columns))]
    assert got == [("abc", 5, [0]), ("bcd", 5, [0]), ("abc", 7, [0]), ("bcd", 7, [1])]
    assert [x.column("block").to_pylist() for x in text_index._blocks(100, 1)([batch([5, 6, 7])])] == [[5, 5], [6]]
