import json
import os

import pytest
from pyspark.sql import functions as F

from tempora.plans.engine import Engine
from tempora.schema import LOCATIONS
from tempora.sources import document_source, documents

EVENTS = "events " + LOCATIONS["events"].dataType.simpleString()


def event(id, title="t", date="1869", description="d"):
    return (id, title, description, date, None, None, None)


def many(spark, n):
    name = F.concat(F.lit('näme, "'), F.col("id").cast("string"), F.lit('"\n'))
    made = F.struct(*[F.lit(x).alias(f.name) for f, x in zip(LOCATIONS["events"].dataType.elementType.fields[:4], ("e", "t", "d", "1900"))], F.lit(None).cast("string").alias("imageUrl"), F.array(F.lit("a"), F.lit(None)).alias("tags"), F.lit(None).cast("string").alias("source"))
    return spark.range(n).select((n - 1 - F.col("id")).cast("int").alias("loc_ord"), F.col("id").cast("string").alias("id"), name.alias("name"), F.array(F.lit(1.5), F.col("id").cast("double")).alias("coordinates"), F.array(made).alias("events"))


def contents(rows):
    return sorted(map(str, rows.select(*LOCATIONS.names).collect()))


def test_a_document_is_written_and_read_by_shares(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "map.json")
    rows = many(spark, 1_000_000)
    documents.write_document(rows, path, F.lit("now"))
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["map.json"]
    back = documents.read_locations(spark, path)
    assert len(document_source.shares(path)) > 20 and back.rdd.getNumPartitions() == len(document_source.shares(path))
    both = back.alias("b").join(rows.alias("r"), "loc_ord")
    same = both.filter((F.col("b.id") == F.col("r.id")) & (F.col("b.name") == F.col("r.name")) & (F.col("b.coordinates") == F.col("r.coordinates")) & (F.to_json("b.events") == F.to_json("r.events")))
    assert back.count() == 1_000_000 == same.count()
    with open(path, encoding="utf-8") as file:
        first, second = file.readline(), file.readline()
    assert first == '{"version": "1.0.0", "lastUpdated": "now", "locations":[\n' and second.startswith('{"id":"999999"')


def test_a_written_document_is_json_and_what_other_readers_see(spark, tmp_path):
    path = str(tmp_path / "map.json")
    documents.write_document(many(spark, 50), path, F.lit("now"))
    whole = json.loads((tmp_path / "map.json").read_text())
    assert [x["id"] for x in whole["locations"]] == [str(i) for i in reversed(range(50))] and whole["locations"][0]["events"][0] == {"id": "e", "title": "t", "description": "d", "date": "1900", "tags": ["a", None]}
    assert contents(documents.locations(documents.read_document(spark, path))) == contents(documents.read_locations(spark, path))


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ("{no json", []),
        ('{"version":"1"}', []),
        ('{"locations":{}}', []),
        ('{"locations":[{"id":"a"}]} tail', []),
        ('{"locations":[{"id":"a"},{"id":"b"}', []),
        (' {"x":{"locations":[1]},"locations":[ ] }\n', []),
        ('{"a":[1,2],\n "locations":[{"id":"é","name":7,"coordinates":[1,2.5],"events":[{"id":"e","tags":null}]}, {"id":"b"}],"z":1}', [("é", "7", [1.0, 2.5]), ("b", None, None)]),
    ],
)
def test_documents_of_others(spark, tmp_path, monkeypatch, text, want):
    monkeypatch.setattr(document_source, "BUFFER", 3)
    path = tmp_path / "map.json"
    if text is not None:
        path.write_text(text, encoding="utf-8")
    got = documents.read_locations(spark, str(path)).orderBy("loc_ord").collect()
    assert [(r.id, r.name, r.coordinates) for r in got] == want and [r.loc_ord for r in got] == list(range(len(want)))


def test_a_changed_document_is_not_read_by_its_old_shares(spark, tmp_path):
    path = tmp_path / "map.json"
    documents.write_document(many(spark, 9), str(path))
    whole = json.loads(path.read_text())
    whole["locations"] = whole["locations"][:4]
    path.write_text(json.dumps(whole))
    assert sorted(r.id for r in documents.read_locations(spark, str(path)).collect()) == ["5", "6", "7", "8"]


def test_a_task_that_fails_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "map.json")
    documents.write_document(many(spark, 5), path, F.lit("old"))
    broken = many(spark, 3000).withColumn("name", F.when(F.col("loc_ord") == 2900, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        documents.write_document(broken, path)
    assert documents.read_locations(spark, path).count() == 5 and documents.read_document(spark, path).first().lastUpdated == "old"
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["map.json"]


def test_appending_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="overwritten as a whole"):
        document_source.register(spark)
        many(spark, 1).write.format("tempora_document").mode("append").save(str(tmp_path / "map.json"))


def test_places_and_events_that_are_alike_all_stay(spark, tmp_path):
    tools = Engine(spark, str(tmp_path / "map.json"))
    ids = [tools.create_location_with_events("Same", [1.0, 2.0], [event("e1")]) for _ in range(3)]
    ids.append(tools.create_location_with_events("Same", [1.0, 2.5], [], millis=7))
    assert len(set(ids)) == 4 and tools.list_locations().count() == 4
    assert tools.delete_location(ids[0]) and tools.create_location_with_events("Same", [1.0, 2.0], []) not in ids[1:]
    made = [tools.add_event("Inn", 1.0, 2.0, "Feast", "1700", text, millis=5) for text in ("one", "two", "two")]
    row = tools.locations().filter("name = 'Inn'").first()
    assert len(set(made)) == 3 and [e.description for e in row.events] == ["one", "two", "two"]
    tools.add_event("inn!", 3.0, 4.0, "Fire", "1800", "x", millis=5)  # the same slug and clock, another name
    assert sorted(r.name for r in tools.list_locations().collect()) == ["Inn", "Same", "Same", "Same", "Same", "inn!"]
    assert tools.list_locations().select("id").distinct().count() == 6
    with pytest.raises(ValueError):
        tools.create_location_with_events("", [1.0, 2.0], [])


def test_default_ids_of_rows_that_are_alike(spark):
    rows = spark.createDataFrame([(None, "A", [1.0, 2.0], None, i) for i in range(3)] + [(None, "A", [1.0, 3.0], None, 0)], "id string, name string, coordinates array<double>, " + EVENTS + ", n int")
    assert documents.new_location(rows).select("id").distinct().count() == 2
    assert documents.new_location(rows, apart=["n"]).select("id").distinct().count() == 4
    events = spark.createDataFrame([(None, "t", "1", "d", i) for i in range(3)], "id string, title string, date string, description string, n int")
    assert documents.new_event(events).select("id").distinct().count() == 1 and documents.new_event(events, ["n"]).select("id").distinct().count() == 3


def test_refused_pdfs_are_not_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"p1|p2")
    (tmp_path / "b.PDF").write_bytes(b"x" * 600_000)
    (tmp_path / "c.doc").write_bytes(b"x" * 900)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = {r.path[-5:]: (r.text, r.error) for r in documents.read_pdfs(spark, str(tmp_path), lambda b: b.decode().split("|")).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {"a.pdf": ("p1\n\np2", None), "b.PDF": (None, "too large"), "c.doc": (None, "not a PDF")}


def snapshots(spark, tmp_path, seen):
    stream = document_source.register(spark).readStream.format("tempora_snapshots").option("path", str(tmp_path / "map.json")).option("log", str(tmp_path / "log")).load()
    q = stream.writeStream.foreachBatch(lambda rows, n: seen.extend(r.lastUpdated for r in rows.orderBy("poll_ts").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120), "the stream does not end"
    finally:
        q.stop()
    return seen


def test_snapshots_of_a_document_over_restarts(spark, tmp_path):
    seen = []
    assert snapshots(spark, tmp_path, seen) == []  # no document yet
    for stamp in ("a", "a", "b", None, "c", "a"):
        if stamp is None:
            (tmp_path / "map.json").write_text("{broken")
        else:
            documents.write_document(many(spark, 2), str(tmp_path / "map.json"), F.lit(stamp))
        snapshots(spark, tmp_path, seen)
    assert seen == ["a", "b", "c", "a"]
    assert len(os.listdir(tmp_path / "log")) <= 2


def test_changes_that_were_seen_but_not_taken_come_after_a_restart(spark, tmp_path):
    reader = lambda: document_source.SnapshotReader(str(tmp_path / "map.json"), str(tmp_path / "log"))
    for stamp in ("a", "b", "b", "c"):
        documents.write_document(many(spark, 1), str(tmp_path / "map.json"), F.lit(stamp))
        end = reader().latestOffset()  # each by a new process, which then fails
    taken = [v for p in reader().partitions(reader().initialOffset(), end) for _, v in reader().read(p)]
    assert taken == ["a", "b", "c"] and end == {"number": 3}
    reader().commit({"number": 2})
    assert [v for p in reader().partitions({"number": 2}, end) for _, v in reader().read(p)] == ["c"]
    assert reader().latestOffset() == end
