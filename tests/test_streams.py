import os
import random

import pytest
from pyspark.sql import functions as F

from tempora.streaming import state


def folded(requests, most, window):
    """(key, ts, seq) to admitted, by the plain fold over each key."""
    times, out = {}, {}
    for key, ts, seq in sorted(requests):
        recent = [t for t in times.get(key, []) if ts - t < window]
        out[key, ts, seq] = len(recent) < most
        times[key] = [*recent, ts] if len(recent) < most else recent
    return out


@pytest.mark.parametrize("hot", [10**6, 100])
def test_pieces_of_busy_keys_are_admitted_like_the_whole(spark, hot):
    rng = random.Random(8)
    rows, now = [], 0
    for i in range(3000):
        now += rng.choice([0, 1, 5, 40, 100, 101])
        rows.append((rng.choice(["busy", "busy", "busy", "calm"]) if i % 50 else "rare", now, i))
    rows += [("busy", 5, 9000 + i) for i in range(20)] + [("never", i, i) for i in range(400)]
    frame = spark.createDataFrame(rows, "key string, ts_ms long, seq long").repartition(5)
    for most in (1, 3):
        got = state.rate_limited(frame, ["key"], most, 100, hot=hot).collect()
        assert {(r.key, r.ts_ms, r.seq): r.admitted for r in got} == folded(rows, most, 100) and len(got) == len(rows)


def test_a_million_requests_of_one_key_over_several_tasks(spark):
    # A thousand bursts of a thousand requests, then a rest.
    at = F.floor(F.col("id") / 1000) * 40_000 + F.col("id") % 1000 * 25 + F.col("id") * 7919 % 20
    frame = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id").alias("seq"), at.cast("long").alias("ts_ms"))
    got = state.rate_limited(frame, ["key"], 3, 1000, hot=100_000).withColumn("task", F.spark_partition_id())
    table = got.select("seq", "ts_ms", "admitted", "task").toPandas().sort_values(["ts_ms", "seq"])
    assert table["task"].nunique() > 1 and len(table) == 1_000_000
    recent, want = [], []
    for now in table["ts_ms"].tolist():
        recent = [t for t in recent if now - t < 1000]
        want.append(len(recent) < 3)
        recent += [now] if want[-1] else []
    assert table["admitted"].tolist() == want


def ran(frame, out, checkpoint, **trigger):
    """All that a stream has ever written to ``out``, after a run over what there is."""
    q = frame.writeStream.format("parquet").option("path", out).trigger(**trigger or {"availableNow": True}).option("checkpointLocation", checkpoint).start()
    try:
        assert q.awaitTermination(180), "the stream does not end"
    finally:
        q.stop()
    return frame.sparkSession.read.schema(frame.schema).parquet(out)


def put(spark, folder, n, rows, schema):
    """File number ``n`` of a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{n}")
    (part,) = [x for x in os.listdir(f"{folder}/b{n}") if x.endswith(".parquet")]
    os.utime(f"{folder}/b{n}/{part}", (1_700_000_000 + n, 1_700_000_000 + n))


ACKS = "user string, event string, ts_ms long"


def acks_in(spark, folder):
    return spark.readStream.schema(ACKS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_running_points_of_a_stream_equal_the_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"u{rng.randrange(4)}", f"e{rng.randrange(30)}", t) for t in range(200)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in range(2):
        put(spark, folder, n, rows[n * 70 : n * 70 + 70], ACKS)
    first = ran(state.running_points_stream(acks_in(spark, folder)), out, checkpoint).count()
    assert first == 140
    put(spark, folder, 2, rows[140:], ACKS)
    got = ran(state.running_points_stream(acks_in(spark, folder)), out, checkpoint)  # another query, the same checkpoint
    batch = state.running_points(spark.createDataFrame(rows, ACKS), "user", "event", "ts_ms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def test_running_points_go_on_from_known_acknowledgements(spark, tmp_path):
    known = spark.createDataFrame([("u", "e1"), ("u", "e1"), ("u", "e2"), ("v", "e9")], "user string, event string")
    put(spark, str(tmp_path / "in"), 0, [("u", "e1", 1), ("u", "e3", 2), ("w", "e1", 3)], ACKS)
    stream = state.running_points_stream(acks_in(spark, str(tmp_path / "in")), known)
    got = ran(stream, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted((r.user, r.event, r["first"], r.points) for r in got) == [("u", "e1", False, 20), ("u", "e3", True, 30), ("w", "e1", True, 10)]


def test_acknowledgements_are_forgotten_after_their_time(spark, tmp_path):
    put(spark, str(tmp_path / "in"), 0, [("u", "e1", 1)], ACKS)
    parts = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    ran(state.running_points_stream(acks_in(spark, parts[0]), forget_ms=1), *parts[1:], once=True)
    put(spark, parts[0], 1, [("u", "e1", 2)], ACKS)
    got = ran(state.running_points_stream(acks_in(spark, parts[0]), forget_ms=1), *parts[1:], once=True).collect()
    assert sorted((r.ts_ms, r["first"], r.points) for r in got) == [(1, True, 10), (2, True, 20)]


def test_limiter_stream_equals_the_batch_over_a_restart_with_late_rows(spark, tmp_path):
    schema = "key string, ts_ms long"
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    base = 1_000_000_000
    batches = [[("k", base + t * 1000) for t in own] for own in ([0, 10, 30, 20], [61, 70, 71], [95, 20], [400, 401, 300])]
    stream = lambda: state.rate_limited_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), 3, 60_000, 40_000)
    for n in (0, 1):
        put(spark, folder, n, batches[n], schema)
    ran(stream(), out, checkpoint)
    for n in (2, 3):
        put(spark, folder, n, batches[n], schema)
    got = sorted(((r.ts_ms - base) // 1000, r.admitted) for r in ran(stream(), out, checkpoint).collect())
    on_time = [t for own in ([0, 10, 20, 30], [61, 70, 71], [95], [300, 400, 401]) for t in own]  # 20 came more than 40 s behind 71
    rows = spark.createDataFrame([("k", base + t * 1000, t) for t in on_time], "key string, ts_ms long, seq long")
    want = sorted(((r.ts_ms - base) // 1000, r.admitted) for r in state.rate_limited(rows, ["key"], 3, 60_000).collect())
    assert got == want


def test_limiter_stream_goes_on_from_known_admissions(spark, tmp_path):
    known = spark.createDataFrame([("k", 1_000), ("k", 2_000), ("other", 5)], "key string, ts_ms long")
    put(spark, str(tmp_path / "in"), 0, [("k", 3_000), ("k", 61_500), ("new", 3_000)], "key string, ts_ms long")
    stream = state.rate_limited_stream(spark.readStream.schema("key string, ts_ms long").parquet(str(tmp_path / "in/*")), 2, 60_000, before=known)
    got = ran(stream, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted((r.key, r.ts_ms, r.admitted) for r in got) == [("k", 3_000, False), ("k", 61_500, True), ("new", 3_000, True)]
