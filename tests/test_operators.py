import json
import os

import pytest
from pyspark.sql import functions as F

from tempora.functions import text
from tempora.operators import edits, search, timeline
from tempora.plans.engine import Engine, get_engine, reset_engine
from tempora.schema import LOCATIONS, OVERLAY
from tempora.sources import documents
from tempora.streaming import state


def event(id, title="t", date="1869", description="d", tags=None):
    return (id, title, description, date, None, tags, None)


def places(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LOCATIONS)


def sample(spark):
    return places(
        spark,
        ("a", "Torvik, Northmark", [14.25, 67.5], [event("e1", "Ferry opens", "1863-09-14"), event("e2", "100% a_b", "unknown")]),
        ("b", "Quay", [3.5, -12.75], [event("e3", "Market", "1908-02")]),
        ("c", "Empty", [0.0, 0.0], []),
    )


def found(df):
    return [(r.location_id, r.event.id) for r in df.orderBy("loc_ord", "evt_ord").collect()]


def test_search(spark):
    rows = sample(spark)
    assert found(search.search_events(rows, "TORVIK")) == [("a", "e1"), ("a", "e2")]
    assert found(search.search_events(rows, "", 1860, 1869)) == [("a", "e1"), ("a", "e2")]  # no year passes
    assert found(search.search_events(rows, "", None, 1900)) == [("a", "e1"), ("a", "e2")]
    assert found(search.search_events(rows, "100%")) == [("a", "e2")]
    assert found(search.search_events(rows, ".*")) == []
    assert found(search.search_events(rows, "")) == [("a", "e1"), ("a", "e2"), ("b", "e3")]
    assert [r.location_id for r in search.distinct_locations(search.search_events(rows, "")).orderBy("loc_ord").collect()] == ["a", "b"]


def test_timeline_filters(spark):
    rows = sample(spark)
    assert [r.id for r in search.visible(rows, 1860, 1869).collect()] == ["a"]
    kept = search.with_events_in(rows, 1860, 1869).orderBy("loc_ord").collect()
    assert [[e.id for e in r.events] for r in kept] == [["e1"], [], []]
    assert timeline.total_events(rows).first().total == 3
    assert timeline.total_events(rows.limit(0)).first().total == 0
    assert [(r.id, r.eventCount) for r in search.list_locations(rows).orderBy("id").collect()] == [("a", 2), ("b", 1), ("c", 0)]


def test_upsert_and_delete(spark):
    rows = sample(spark)
    new = places(spark, ("z", "New", [1.0, 1.0], []), ("b", "Quay 2", [2.0, 2.0], []))
    got = edits.upserted(rows, new).orderBy("loc_ord").collect()
    assert [(r.loc_ord, r.id, r.name) for r in got] == [(0, "a", "Torvik, Northmark"), (1, "b", "Quay 2"), (2, "c", "Empty"), (3, "z", "New")]
    assert [r.id for r in edits.deleted(rows, "a").orderBy("id").collect()] == ["b", "c"]


def test_events_added_keep_repeats_of_the_batch(spark):
    rows = places(spark, ("a", "A", [0.0, 0.0], [event("e1")]))
    new = spark.createDataFrame(
        [("a", i, event(x)) for i, x in enumerate(["e1", "e2", "e2"])] + [("no", 0, event("e9"))], "location_id string, ord int, event " + LOCATIONS["events"].dataType.elementType.simpleString()
    )
    (row,) = edits.events_added(rows, new).collect()
    assert [e.id for e in row.events] == ["e1", "e2", "e2"]


def test_event_edits_touch_the_first_of_an_id(spark):
    rows = places(spark, ("a", "A", [0.0, 0.0], [event("e1"), event("e1", "second")]))
    new = F.struct(*[F.lit(v).cast(k).alias(n) for n, k, v in [("id", "string", "e1"), ("title", "string", "new"), ("description", "string", "x"), ("date", "string", "1"), ("imageUrl", "string", None), ("tags", "array<string>", None), ("source", "string", None)]])
    (row,) = rows.select(edits.event_updated(F.col("events"), new).alias("events")).collect()
    assert [e.title for e in row.events] == ["new", "second"]
    (row,) = rows.select(edits.event_deleted(F.col("events"), F.lit("e1")).alias("events")).collect()
    assert row.events == []


def test_selection(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.id for r in edits.toggled(ids("a", "b"), ids("b", "c")).collect()) == ["a", "c"]
    left, chosen = edits.rejected(ids("a", "b"), ids("a"), ids("a"))
    assert [r.id for r in left.collect()] == ["b"] and chosen.count() == 0
    assert tuple(edits.selection_counts(ids("a", "b"), ids("a")).first()) == (1, 2, False)


def test_overlays(spark):
    rows = documents.default_overlays(spark)
    assert tuple(timeline.overlay_bounds(rows).first()) == (1820, 2006)
    assert tuple(timeline.overlay_bounds(rows.limit(0)).first()) == (None, None)
    assert {r.id for r in timeline.overlays_in_year(rows, 1850).collect()} == {"ohm-historical", "manchester-1820"}
    assert {r.id for r in timeline.overlays_overlapping(rows, 1921, 1930).collect()} == {"usgs-topo-historical"}
    assert timeline.enabled_count(timeline.toggled(rows, "ohm-historical")).first()[0] == 1
    ranks = {r.id: r["rank"] for r in timeline.ranked_overlays(rows.withColumn("zIndex", F.when(F.col("zIndex") > 1, F.col("zIndex")))).collect()}
    assert ranks == {"ohm-historical": 1, "usgs-topo-historical": 2, "manchester-1820": 3}
    made = timeline.new_overlay(spark.createDataFrame([("1", " x ", "http://a", "allmaps"), ("2", " ", "b", "ohm"), ("3", "y", "u", "ohm")], "id string, name string, url string, source string"))
    got = {r.id: r for r in made.collect()}
    assert set(got) == {"1", "3"} and got["1"].annotationUrl == "http://a" and got["3"].tileUrl == "u" and got["1"].name == "x"
    assert made.schema.names == OVERLAY.names
    urls = spark.createDataFrame([("https://x.org/a",), ("http://a.iiif.io/x",), ("http://x.org",), ("no url",), ("",), (None,)], "u string")
    assert [r[0] for r in urls.select(timeline.valid_annotation_url(F.col("u"))).collect()] == [True, True, False, False, False, False]
    events = spark.createDataFrame([(1849,), (1850,), (1900,), (2010,)], "year int")
    assert timeline.in_overlay_years(events, rows).groupBy("year").count().orderBy("year").collect() == [(1849, 1), (1850, 2), (1900, 2)]


def test_pages_and_years(spark):
    rows = spark.createDataFrame([("a", i, d) for i, d in enumerate(["1869-05", "1869", "900", "1869-01-02", "1869-12", "x"])], "loc string, ord int, date string")
    got = {(r.year, r.ord): (r.page, r.pages, r.has_next) for r in timeline.paginated(rows, "loc", "ord").collect()}
    assert got[("1869", 1)] == (0, 2, True) and got[("1869", 4)] == (1, 2, False)
    assert [r.year for r in timeline.years_of(rows, "loc").orderBy("year_rank").collect()] == ["1869", "900", "x"]
    assert timeline.active_year(rows, "loc").first().year == "1869"
    moved = timeline.reordered(spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "id string, place int"), 3, 1)
    assert [(r.id, r.zIndex) for r in moved.orderBy("place").collect()] == [("a", 1), ("d", 2), ("b", 3), ("c", 4)]


def test_limiter(spark):
    rows = [("k", t * 1000, i) for i, t in enumerate([0, 10, 20, 30, 60, 61])] + [("other", 0, 9)]
    got = state.rate_limited(spark.createDataFrame(rows, "key string, ts_ms long, seq long"), ["key"], 3, 60_000)
    assert [r.admitted for r in got.filter("key = 'k'").orderBy("seq").collect()] == [True, True, True, False, True, False]


def streamed(frame, name, tmp_path):
    """Rows of a streaming frame after all files have been taken, one file a batch."""
    q = frame.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        assert q.awaitTermination(120), "the stream does not end"
    finally:
        q.stop()
    return frame.sparkSession.table(name)


def requests(spark, tmp_path, *batches):
    """A stream with one file for each batch of (key, seconds)."""
    for n, rows in enumerate(batches):
        made = spark.createDataFrame([(k, 1_000_000_000 + t * 1000) for k, t in rows], "key string, ts_ms long")
        made.coalesce(1).write.parquet(str(tmp_path / f"in/b{n}"))
        (part,) = (tmp_path / f"in/b{n}").glob("*.parquet")
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema("key string, ts_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def admitted(rows, key="k"):
    return [(int(r.ts_ms - 1_000_000_000) // 1000, r.admitted) for r in rows.filter(F.col("key") == key).orderBy("ts_ms").collect()]


def test_limiter_stream(spark, tmp_path):
    stream = requests(spark, tmp_path, [("k", t) for t in (30, 0, 20, 10)] + [("other", 5)], [("k", 61), ("k", 60)])
    got = streamed(state.rate_limited_stream(stream, 3, 60_000), "limited", tmp_path)
    assert admitted(got) == [(0, True), (10, True), (20, True), (30, False), (60, True), (61, False)]
    assert admitted(got, "other") == [(5, True)]


def test_limiter_stream_takes_late_requests_within_the_watermark_and_forgets_by_event_time(spark, tmp_path):
    batches = [("k", 100), ("k", 101)], [("k", 95), ("k", 10)], [("k", 500)], [("k", 501), ("k", 380)], [("k", 502)]
    got = streamed(state.rate_limited_stream(requests(spark, tmp_path, *batches), 2, 60_000, 30_000), "late", tmp_path)
    # 95 comes late but in time, and finds two admissions; 10 and 380 are too late; 100 and 101 are forgotten by 500.
    assert admitted(got) == [(95, False), (100, True), (101, True), (500, True), (501, True), (502, False)]


def test_limiter_stream_of_one_hot_key_equals_the_batch(spark, tmp_path):
    times = [(7919 * i) % 30_000 for i in range(30_000)]
    got = streamed(state.rate_limited_stream(requests(spark, tmp_path, [("k", t) for t in times]), 10, 60_000), "hot", tmp_path)
    rows = spark.createDataFrame([("k", 1_000_000_000 + t * 1000, t) for t in times], "key string, ts_ms long, seq long")
    assert admitted(got) == admitted(state.rate_limited(rows, ["key"], 10, 60_000))


def test_acknowledgements(spark):
    acks = spark.createDataFrame([("u", "e1", 1), ("u", "e1", 2), ("u", "e2", 3)], "user string, event string, t int")
    assert [r.points for r in state.running_points(acks, "user", "event", "t").orderBy("t").collect()] == [10, 10, 20]
    assert state.scores(acks, "user", "event").first().points == 20


def test_acknowledgement_stream(spark, tmp_path):
    spark.createDataFrame([("u", "e1"), ("u", "e1"), ("u", "e2")], "user string, event string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, event string").parquet(str(tmp_path / "in"))
    assert streamed(state.first_acks_stream(stream), "acks", tmp_path).agg(F.sum("points")).first()[0] == 20


def test_snapshots(spark):
    polls = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("s", 4, None), ("s", 5, None)], "k string, t int, v string")
    assert [r.t for r in state.changed_snapshots(polls, ["k"], "t", "v").orderBy("t").collect()] == [1, 3, 4]
    seen = []
    each = state.on_change(seen.append)
    for v in ("a", "a", "b"):
        each(spark.createDataFrame([(1, v)], "poll_ts int, lastUpdated string"), 0)
    assert seen == ["a", "b"]


def test_changes_are_remembered_by_a_query_that_starts_anew(spark, tmp_path):
    seen, store = [], str(tmp_path / "last")
    for values in (["a", "b"], ["b", "b", "c"], ["c"]):
        each = state.on_change(seen.append, store)
        for v in values:
            each(spark.createDataFrame([(1, v)], "poll_ts int, lastUpdated string"), 0)
    assert seen == ["a", "b", "c"]


def test_documents(spark, tmp_path):
    path = str(tmp_path / "map.json")
    assert documents.locations(documents.read_document(spark, path)).count() == 0
    (tmp_path / "bad.json").write_text("{no json")
    assert documents.read_document(spark, str(tmp_path / "bad.json")).first().version == "1.0.0"
    documents.write_document(sample(spark), path, F.lit("now"))
    assert json.loads((tmp_path / "map.json").read_text())["locations"][0]["events"][0]["title"] == "Ferry opens"
    back = documents.read_document(spark, path)
    assert back.first().lastUpdated == "now" and documents.locations(back).count() == 3
    exported = documents.export_json(back)
    assert json.loads(exported.first().json)["version"] == "1.0.0"
    texts = spark.createDataFrame([(exported.first().json,), ('{"version":""}',), ("x",), ('{"version":"1"}',)], "json string")
    assert [r.valid for r in documents.import_json(texts).collect()] == [True, False, False, False]
    assert documents.seeded(sample(spark).limit(0), sample(spark)).count() == 3
    documents.clear_document(spark, path)
    assert documents.locations(documents.read_document(spark, path)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.md").write_text("no")
    assert [r.text for r in documents.read_texts(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"p1|p2\r\n\r\n\r\nx")
    (tmp_path / "pdf/b.pdf").write_bytes(b"x" * 512_001)
    (tmp_path / "pdf/c.doc").write_bytes(b"x")
    got = {r.path[-5:]: r for r in documents.read_pdfs(spark, str(tmp_path / "pdf"), lambda b: b.decode().split("|")).collect()}
    assert got["a.pdf"].text == "p1\n\np2\n\nx" and got["b.pdf"].error == "too large" and got["c.doc"].error == "not a PDF"
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"X"},"geometry":{"type":"Point","coordinates":[1.5,2.5]}}]}')
    assert tuple(documents.read_points(spark, str(tmp_path / "g.json")).first()) == ("X", 1.5, 2.5)


def test_engine(spark, tmp_path):
    tools = get_engine(spark, str(tmp_path / "m.json"))
    assert get_engine(spark, tools.path) is tools
    tools.add_event("Haldane", 48.5, 12.75, "Mill", "1771-11-30", "ground", millis=5)
    tools.add_event("Haldane", 48.5, 12.75, "Flood", "1802", "rose")
    assert [(r.name, r.eventCount, r.coordinates) for r in tools.list_locations().collect()] == [("Haldane", 2, [12.75, 48.5])]
    assert tools.search_events("flood").count() == 1 and tools.show_map("flood", 1802).first().filter_year == 1802
    id = tools.list_locations().first().id
    assert not tools.delete_location("none") and not tools.add_events("none", [])
    assert tools.get_location(id).count() == 1 and tools.delete_location(id) and tools.list_locations().count() == 0
    docs = spark.createDataFrame([(1, "On 1900-01-02 x."), (2, ""), (3, "1900-01-02 " * 6000)], "doc_id long, text string")
    assert {r.doc_id for r in tools.parse(docs).collect()} == {1}
    reset_engine()
    assert isinstance(get_engine(spark, "x"), Engine)


def test_defaults_and_edits(spark):
    rows = places(spark, (None, "A", [0.0, 0.0], None), ("x", "", [0.0, 0.0], []), ("y", "B", None, [])).drop("loc_ord")
    (row,) = documents.new_location(rows).collect()
    assert row.name == "A" and row.id.startswith("location-") and row.events == []
    edited = edits.edited(spark.createDataFrame([(" a ", " b", "c "), ("", "b", "c")], "title string, date string, description string"))
    assert [tuple(r) for r in edited.collect()] == [("a", "b", "c")]
    tags = spark.createDataFrame([(["a", "b", "c"],), (None,)], "tags array<string>")
    assert [r[0] for r in tags.select(timeline.shown_tags(F.col("tags"))).collect()] == [["a", "b"], None]


def test_documents_of_each_key(spark):
    rows = spark.createDataFrame([(i, str(i), f"n{i}", [0.0, 0.0], [], i // 4) for i in range(10)], "loc_ord int, id string, name string, coordinates array<double>, events " + LOCATIONS["events"].dataType.simpleString() + ", part int")
    made = documents.documents_of(rows, ["part"])
    assert sorted(len(r["locations"]) for r in made.collect()) == [2, 4, 4]
    back = documents.locations(documents.import_json(documents.export_json(made)).filter("valid").select("document.*"))
    assert sorted(int(r["id"]) for r in back.collect()) == list(range(10))


def test_edits_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "map.json"))
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: pytest.fail("the table went to the driver"))
    for i in range(3):
        engine.upsert_location(spark.createDataFrame([(0, f"l{i}", f"n{i}", [1.0, 2.0], [])], LOCATIONS))
    assert engine.delete_location("l1")
    assert [r["id"] for r in engine.locations().orderBy("loc_ord").collect()] == ["l0", "l2"]


def test_range_joins_count_every_pair(spark):
    years = [(i % 7, 1985 + i * 5 % 40) for i in range(60)]
    spans = [(i, 1980 + i * 7 % 40, 1980 + i * 7 % 40 + i % 13, i % 9) for i in range(50)] + [(99, 2500, 2501, 1)]
    ranges = [(i, 1990 + i % 12, 1990 + i % 12 + i % 3) for i in range(30)]
    overlays = spark.createDataFrame(spans, "id int, year_from int, year_to int, z int")
    got = timeline.counted_in_overlay_years(spark.createDataFrame(years, "loc_ord int, year int"), overlays).collect()
    want = {i: n for i, a, b, _ in spans if (n := sum(a <= y <= b for _, y in years))}
    assert sorted(map(tuple, got)) == sorted(want.items())
    got = timeline.overlapping_counts(spark.createDataFrame(ranges, "r int, lo int, hi int"), overlays).select("r", "n").collect()
    want = {i: n for i, lo, hi in ranges if (n := sum(b >= lo and a <= hi for _, a, b, _ in spans))}
    assert sorted(map(tuple, got)) == sorted(want.items())


def test_blank_texts_are_refused(spark):
    texts = documents.pasted(spark, "  ").unionByName(spark.createDataFrame([(1, "\u00a0\n"), (2, None), (3, ""), (4, " x "), (5, "y" * 51_201)], "doc_id long, text string"))
    got = {r.doc_id: r.error for r in documents.checked_texts(texts).collect()}
    assert got == {0: "text is required", 1: "text is required", 2: "text is required", 3: "text is required", 4: None, 5: "too long: 51201"}


def test_writing_replaces_a_document_in_one_step(spark, tmp_path):
    path = str(tmp_path / "map.json")
    for n in (3, 1):
        documents.write_document(sample(spark).limit(n), path, F.lit(str(n)))
        assert documents.read_document(spark, path).first().lastUpdated == str(n)
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["map.json"]


def test_the_last_of_repeated_upserts_is_written_at_the_place_of_the_first(spark):
    new = places(spark, ("y", "first y", [0.0, 0.0], []), ("x", "x", [0.0, 0.0], []), ("y", "last y", [1.0, 1.0], []), ("b", "B1", [0.0, 0.0], []), ("b", "B2", [0.0, 0.0], []))
    got = edits.upserted(sample(spark), new).orderBy("loc_ord").collect()
    assert [(r.loc_ord, r.id, r.name) for r in got] == [(0, "a", "Torvik, Northmark"), (1, "b", "B2"), (2, "c", "Empty"), (3, "y", "last y"), (4, "x", "x")]


def test_numbers_in_ranges(spark):
    values = [(7919 * i) % 5000 for i in range(5000)] + [3] * 20
    got = sorted(tuple(r) for r in edits.numbered(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n").collect())
    assert [v for v, _ in got] == sorted(values) and [n for _, n in got] == list(range(1, len(values) + 1))
    assert edits.numbered(spark.createDataFrame([], "v long"), "v", "n").count() == 0


def test_a_location_is_created_with_its_events(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "map.json"))
    id = engine.create_location_with_events("Haldane", [1.0, 2.0], [event("e1"), event("e2", "two")])
    (row,) = engine.get_location(id).collect()
    assert row.name == "Haldane" and [e.title for e in row.events] == ["t", "two"]


def test_selections_and_what_is_shown(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    assert sorted(r.id for r in edits.all_selected(ids).collect()) == ["a", "b"] and edits.cleared(ids).count() == 0
    rows = spark.createDataFrame([("s", "d"), ("d", "d"), (None, "d"), (None, None)], "s string, d string")
    assert [r[0] for r in rows.select(text.source_shown(F.col("s"), F.col("d"))).collect()] == ["s", None, None, None]
    dated = spark.createDataFrame([("x", "1900"), ("x", "1900-05"), ("y", "1900"), ("y", "1901")], "loc string, date string")
    assert {r["loc"]: r.tabs_shown for r in timeline.year_tabs(dated, "loc").collect()} == {"x": False, "y": True}
    layers = documents.default_overlays(spark)
    more = timeline.added(layers, spark.createDataFrame([("new", "N")], "id string, name string"))
    assert more.count() == 4 and edits.deleted(more, "new").count() == 3
