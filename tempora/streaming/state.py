"""State for each key: admission within sliding windows, acknowledgements and changed snapshots."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranks import HOT, hot_keys
from ..sources.shared import stored

# Fixed values: (requests, milliseconds) that a path admits; other paths admit all. Words that block a client.
LIMITS = {"/api/parse-pdf": (3, 60_000), "/api/parse": (10, 60_000)}
BLOCKED = "sqlmap|nikto|masscan|curl|wget|python-requests|go-http-client"
POINTS = 10


def blocked_agent(path: Column, agent: Column) -> Column:
    return F.startswith(path, F.lit("/api/")) & F.coalesce(agent.rlike(f"(?i){BLOCKED}"), F.lit(False))


def _admit(times: list[int], now: int, most: int, window: int) -> tuple[bool, list[int]]:
    """Admissions that still count, with this one if it is admitted. Rejected requests leave no trace."""
    recent = [t for t in times if now - t < window]
    return (False, recent) if len(recent) >= most else (True, [*recent, now])


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def busy_pieces(requests: DataFrame, keys: list[str], window_ms: int, time: str = "ts_ms", order: str = "seq") -> DataFrame:
    """``requests`` with ``_piece``: the number of gaps of at least ``window_ms`` before a request of its key.

    Behind such a gap no earlier admission counts, so pieces are independent of each other. Requests are dealt to
    ranges of (keys, time, order) and read there in order, so a key may lie in many ranges; what a range must know of
    those before it are the last time and the gaps of one key.
    """
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, time, order]

    def run(frames):
        key, last, piece = None, None, 0
        part = TaskContext.get().partitionId()
        for frame in frames:
            if not len(frame):
                continue
            own = list(zip(*[frame[k] for k in keys]))
            now = frame[time].to_numpy(np.int64)
            new = np.array([a != b for a, b in zip(own, [key, *own])])
            gap = np.diff(now, prepend=now[0] if last is None else last) >= window_ms
            count = np.cumsum(gap & ~new)
            # A key begins at 0; within the batch that is the count where it began.
            begun = np.maximum.accumulate(np.where(new, np.arange(len(now)), -1))
            count = np.where(begun < 0, count + piece, count - count[np.maximum(begun, 0)])
            key, last, piece = own[-1], int(now[-1]), int(count[-1])
            yield frame.assign(_part=part, _piece=count)

    ordered = requests.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    cut = stored(ordered.mapInPandas(run, f"{_kinds(requests)}, _part int, _piece long"), "pieces")
    ends = cut.groupBy("_part", *keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.max("_piece").alias("_gaps"))
    parts = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.withColumn("_before", F.lag("_last").over(parts))
    gap = F.coalesce((F.col("_first") - F.col("_before") >= window_ms).cast("long"), F.lit(0))
    ends = ends.withColumn("_add", F.sum(gap).over(parts) + F.sum("_gaps").over(parts) - F.col("_gaps")).filter("_before IS NOT NULL")
    ends = ends.select([F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)] + [F.col("_part").alias("_p"), "_add"])  # one row for a range at most
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.join(F.broadcast(ends), same, "left")
    return joined.select(*requests.columns, (F.col("_piece") + F.coalesce("_add", F.lit(0))).alias("_piece"))


def rate_limited(requests: DataFrame, keys: list[str], most: int, window_ms: int, time: str = "ts_ms", order: str = "seq", hot: int = HOT) -> DataFrame:
    """``requests`` with ``admitted``.

    A key of more than ``hot`` requests is cut where it rests for a window, as admission starts afresh there, and its
    pieces are dealt to tasks. A task walks through its rows, which Spark has sorted, with the last ``most`` admissions of one piece at hand; so only
    a key that never rests is the work of one task, and needs no more memory either.
    """
    names = requests.columns

    def run(frames):
        key, recent = None, []
        for frame in frames:
            out = []
            for now, *own in zip(frame[time].tolist(), *[frame[k] for k in (*keys, "_piece")]):
                if own != key:
                    key, recent = own, deque(maxlen=most)
                ok = most > 0 and (len(recent) < most or now - recent[0] >= window_ms)
                if ok:
                    recent.append(now)
                out.append(ok)
            yield frame.drop(columns="_piece").assign(admitted=out)

    pieces = requests.withColumn("_piece", F.lit(0).cast("long"))
    large, same, any_hot = hot_keys(requests, keys, hot)
    if any_hot:
        busy = busy_pieces(requests.join(large, same, "left_semi"), keys, window_ms, time, order)
        pieces = pieces.join(large, same, "left_anti").unionByName(busy)
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks, *keys, "_piece").sortWithinPartitions(*keys, "_piece", time, order)
    return dealt.mapInPandas(run, f"{_kinds(requests)}, admitted boolean").select(*names, "admitted")


def on_disk(spark: SparkSession) -> None:
    """State of streaming queries that start from now on is held by RocksDB, which the stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Admission(StatefulProcessor):
    """A key's last admissions as a list state, forgotten by a timer once the watermark has passed their window."""

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts_ms long")

    def handleInitialState(self, key, initial, timers) -> None:
        self._keep(sorted(initial["ts_ms"].tolist())[-self.most :], timers)

    def handleInputRows(self, key, rows, timers):
        asked = np.sort(np.concatenate([frame["ts_ms"].to_numpy(np.int64) for frame in rows]))
        asked = asked[asked > timers.getCurrentWatermarkInMs()]  # Spark's own filter lags behind by a batch
        times, out = [x[0] for x in self.times.get()], []
        for now in asked.tolist():
            ok, times = _admit(times, now, self.most, self.window_ms)
            out.append(ok)
        if len(asked):
            self._keep(times, timers)
        yield pd.DataFrame({"key": key[0], "ts_ms": asked, "admitted": out})

    def _keep(self, times: list[int], timers) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.times.put([(t,) for t in times])
            self.handle.registerTimer(max(max(times) + self.window_ms, timers.getCurrentWatermarkInMs()) + 1)
        else:
            self.times.clear()

    def handleExpiredTimer(self, key, timers, expired):
        self.times.clear()
        yield pd.DataFrame({"key": [], "ts_ms": [], "admitted": []}).astype({"key": str, "ts_ms": "int64", "admitted": bool})

    def close(self) -> None:
        pass


def rate_limited_stream(requests: DataFrame, most: int, window_ms: int, late_ms: int = 60_000, before: DataFrame | None = None) -> DataFrame:
    """(key, ts_ms, admitted) of a stream of (key string, ts_ms long), by the requests' own times.

    A micro-batch's requests of a key are taken in the order of their times, so a group's times, eight bytes each, are
    held at once; the trigger bounds a batch. Between batches a key keeps its last ``most`` admissions at most, and
    drops them once the watermark has passed their window. Requests that come more than ``late_ms`` behind the newest
    of earlier batches are dropped; a late request within that is judged by the admissions known when it comes.
    ``before`` (key, ts_ms) are admissions that a query knows when it starts.
    """
    on_disk(requests.sparkSession)
    timed = requests.withColumn("_ts", F.timestamp_millis("ts_ms")).withWatermark("_ts", f"{late_ms} milliseconds")
    known = before.select("key", "ts_ms").groupBy("key") if before is not None else None
    return timed.groupBy("key").transformWithStateInPandas(Admission(most, window_ms), "key string, ts_ms long, admitted boolean", "append", "eventTime", initialState=known)


class Score(StatefulProcessor):
    """A user's acknowledged events as a map state, which may forget them after a time, and points as a value state."""

    def __init__(self, points: int, forget_ms: int | None):
        self.worth, self.forget_ms = points, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "event string", "ts_ms long", self.forget_ms)
        self.points = handle.getValueState("points", "points long")

    def _so_far(self) -> int:
        return self.points.get()[0] if self.points.exists() else 0

    def handleInitialState(self, key, initial, timers) -> None:
        events = set(initial["event"].tolist())
        for event in events:
            self.known.updateValue((event,), (0,))
        self.points.update((self._so_far() + self.worth * len(events),))

    def handleInputRows(self, key, rows, timers):
        acks = pd.concat(list(rows)).sort_values(["ts_ms", "event"], kind="stable")
        new = {e for e in acks["event"].unique() if not self.known.containsKey((e,))}
        points, first, so_far = self._so_far(), [], []
        for event, now in zip(acks["event"], acks["ts_ms"].tolist()):
            first.append(event in new)
            if event in new:
                new.discard(event)
                self.known.updateValue((event,), (now,))
                points += self.worth
            so_far.append(points)
        self.points.update((points,))
        yield pd.DataFrame({"user": key[0], "event": acks["event"], "ts_ms": acks["ts_ms"], "first": first, "points": so_far})

    def close(self) -> None:
        pass


def running_points_stream(acks: DataFrame, before: DataFrame | None = None, forget_ms: int | None = None) -> DataFrame:
    """Every acknowledgement of a stream of (user string, event string, ts_ms long) with ``first`` and the user's points
    so far; repeats add nothing.

    A user's acknowledgements of one micro-batch are taken by their time. ``before`` (user, event) are acknowledgements
    that a query knows when it starts. Acknowledged events stay in the state, on disk, until ``forget_ms`` after they
    came in by the clock; None keeps them. A query that forgets runs until it is stopped, or once: the clock goes on.
    """
    on_disk(acks.sparkSession)
    known = before.select("user", "event").groupBy("user") if before is not None else None
    mode = "none" if forget_ms is None else "processingTime"
    made = Score(POINTS, forget_ms)
    return acks.select("user", "event", "ts_ms").groupBy("user").transformWithStateInPandas(made, "user string, event string, ts_ms long, first boolean, points long", "append", mode, initialState=known)


def running_points(acks: DataFrame, user: str, event: str, time: str) -> DataFrame:
    """Every acknowledgement with ``first`` and the user's points so far; repeats add nothing."""
    first = F.row_number().over(Window.partitionBy(user, event).orderBy(time)) == 1
    gained = F.when(F.col("first"), POINTS).otherwise(0)
    so_far = F.sum(gained).over(Window.partitionBy(user).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return acks.withColumn("first", first).withColumn("points", so_far)


def scores(acks: DataFrame, user: str, event: str) -> DataFrame:
    """(user, acknowledged, points)."""
    n = acks.select(user, event).distinct().groupBy(user).agg(F.count("*").alias("acknowledged"))
    return n.withColumn("points", F.col("acknowledged") * POINTS)


def first_acks_stream(acks: DataFrame) -> DataFrame:
    """The first acknowledgement of each user and event of a stream, worth ``POINTS``. State grows with the keys."""
    return acks.dropDuplicates(["user", "event"]).withColumn("points", F.lit(POINTS))


def changed_snapshots(polls: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Polls whose value differs from the one before; the first always counts."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(time))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(time))
    return polls.withColumn("_b", before).withColumn("_n", n).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_b"))).drop("_b", "_n")


def on_change(act, store: str | None = None):
    """A function for ``foreachBatch`` that calls ``act`` with the newest (poll_ts, lastUpdated) when the latter is new.

    ``store`` names a table for the last value, so that a query that starts anew does not act on it again; ``act`` comes
    before the value is stored, so a value may come twice after a failure, but none is lost.
    """
    seen: dict = {}

    def last(spark):
        if not seen:
            seen["value"] = object()
            if store:
                try:
                    seen["value"] = spark.read.schema("value string").parquet(store).first()[0]
                except (AnalysisException, TypeError):  # nothing stored yet
                    pass
        return seen["value"]

    def each(batch: DataFrame, _epoch: int) -> None:
        newest = batch.agg(F.max_by("lastUpdated", "poll_ts").alias("v"), F.count("*").alias("n")).first()
        if newest["n"] and newest["v"] != last(batch.sparkSession):
            act(newest["v"])
            seen["value"] = newest["v"]
            if store:
                batch.sparkSession.createDataFrame([(newest["v"],)], "value string").coalesce(1).write.mode("overwrite").parquet(store)

    return each
