"""Joins of points and intervals by sorted endpoints. Intervals are closed; empty ones and those with null bounds match nothing.
Values are compared as doubles.

Endpoints are cumulated once: how many points lie below a value and up to it. Counts are differences of two such sums.
For pairs the points are numbered in their order, so an interval matches a run of numbers: points stand in chunks of
consecutive numbers, an interval is sent to the chunks of its run, and chunks are an equi-join. An interval goes to no
more chunks than its matches fill, and two, so the rows that are made are bounded by input and output however wide or
nested the intervals are. Values that very many points share are spread over chunks like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ranks import ranked_by_ranges

#: Ranges of values that are cumulated side by side, and points in a chunk.
RANGES, CHUNK = 256, 256


def cumulated(counts: DataFrame) -> DataFrame:
    """(v, below, upto): for each value of ``counts`` (v, n) the sums of n at smaller values, and with its own."""
    per = counts.groupBy(F.col("v").cast("double").alias("v")).agg(F.sum("n").alias("n"))
    edges = per.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("edges"))
    dealt = per.crossJoin(F.broadcast(edges)).withColumn("range", F.size(F.filter("edges", lambda e: e <= F.col("v")))).drop("edges")
    dealt = stored(dealt, "values")
    sizes = dealt.groupBy("range").agg(F.sum("n").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # at most ``RANGES`` rows
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    return dealt.join(F.broadcast(before), "range").select("v", (upto - F.col("n")).alias("below"), upto.alias("upto"))


def _counted(values: DataFrame, asked: list[DataFrame]) -> DataFrame:
    """``cumulated`` of the values of one column, which also has a row for every value that is ``asked`` for."""
    counts = values.toDF("v").filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    for more in asked:
        counts = counts.unionByName(more.toDF("v").filter("v IS NOT NULL").distinct().withColumn("n", F.lit(0).cast("long")))
    return stored(cumulated(counts), "cumulated")


def _at(rows: DataFrame, key: str, sums: DataFrame, sum_: str, name: str) -> DataFrame:
    """``rows`` with a sum at the value of ``key``. Every value has one row of sums, so hot values may be split."""
    return rows.join(sums.select(F.col("v").alias("_v"), F.col(sum_).alias(name)), F.col(key).cast("double") == F.col("_v")).drop("_v")


def counted_within(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str, name: str = "n") -> DataFrame:
    """``intervals`` with the number of points that each holds, 0 included. Empty intervals hold none."""
    sums = _counted(points.select(value), [intervals.select(low), intervals.select(high)])
    found = _at(_at(intervals.filter(F.col(low) <= F.col(high)), low, sums, "below", "_below"), high, sums, "upto", "_upto")
    return found.withColumn(name, F.col("_upto") - F.col("_below")).drop("_below", "_upto")


def counted_overlaps(left: DataFrame, low: str, high: str, right: DataFrame, right_low: str, right_high: str, name: str = "n") -> DataFrame:
    """``left`` with the number of intervals of ``right`` that each overlaps: those begun by its end less those ended before it."""
    whole = right.filter(F.col(right_low) <= F.col(right_high))
    begun = _counted(whole.select(right_low), [left.select(high)])
    ended = _counted(whole.select(right_high), [left.select(low)])
    found = _at(_at(left.filter(F.col(low) <= F.col(high)), high, begun, "upto", "_begun"), low, ended, "below", "_ended")
    return found.withColumn(name, F.col("_begun") - F.col("_ended")).drop("_begun", "_ended")


def numbered_points(points: DataFrame, value: str) -> DataFrame:
    """(v, number, row): the points that have a value, numbered from 0 in its order, with their columns as ``row``.

    By ranges of (value, hash of the row), so points that share a value are dealt to many tasks, too.
    """
    rows = points.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(*points.columns).alias("h"), F.struct(*points.columns).alias("row"))
    return ranked_by_ranges(rows, [], [F.col("v"), F.col("h")], "number").select("v", (F.col("number") - 1).alias("number"), "row")


def _runs(intervals: DataFrame, low: str, high: str, sums: DataFrame, start: str) -> DataFrame:
    """(row, first, last): the numbers of the points in each interval; intervals without points are left out."""
    rows = intervals.filter(F.col(low) <= F.col(high)).select(F.struct(*intervals.columns).alias("row"), F.col(low).alias("_low"), F.col(high).alias("_high"))
    found = _at(_at(rows, "_low", sums, start, "first"), "_high", sums, "upto", "last").withColumn("last", F.col("last") - 1)
    return found.filter("first <= last").select("row", "first", "last")


def _chunked(runs: DataFrame, chunk: int) -> DataFrame:
    """The runs, once for each chunk of numbers that they touch. Chunks are listed in two steps, so no list gets long."""
    coarse = runs.withColumn("_c", F.explode(F.sequence(F.expr(f"first div {chunk * 4096}"), F.expr(f"last div {chunk * 4096}"))))
    low, high = F.greatest(F.expr(f"first div {chunk}"), F.col("_c") * 4096), F.least(F.expr(f"last div {chunk}"), F.col("_c") * 4096 + 4095)
    return coarse.withColumn("chunk", F.explode(F.sequence(low, high))).drop("_c")


def _matched(points: DataFrame, runs: DataFrame, chunk: int) -> DataFrame:
    """(point, interval) structs of all pairs."""
    own = points.select(F.expr(f"number div {chunk}").alias("chunk"), "number", F.col("row").alias("point"))
    met = _chunked(runs, chunk).withColumnRenamed("row", "interval").join(own, "chunk")
    return met.filter(F.col("number").between(F.col("first"), F.col("last"))).select("point", "interval")


def pairs_within(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str, chunk: int = CHUNK) -> DataFrame:
    """Every point with every interval that holds it: the columns of both, points first."""
    sums = _counted(points.select(value), [intervals.select(low), intervals.select(high)])
    met = _matched(numbered_points(points, value), _runs(intervals, low, high, sums, "below"), chunk)
    return met.select("point.*", "interval.*")


def overlapping_pairs(left: DataFrame, low: str, high: str, right: DataFrame, right_low: str, right_high: str, chunk: int = CHUNK) -> DataFrame:
    """Every interval of ``left`` with every one of ``right`` that it overlaps, once: the columns of both, left first.

    Of two that overlap either the left one begins within the right one, or the right one behind the left one's start.
    """
    left, right = left.filter(F.col(low) <= F.col(high)), right.filter(F.col(right_low) <= F.col(right_high))
    starts = _counted(left.select(low), [right.select(right_low), right.select(right_high)])
    held = _matched(numbered_points(left, low), _runs(right, right_low, right_high, starts, "below"), chunk)
    others = _counted(right.select(right_low), [left.select(low), left.select(high)])
    holding = _matched(numbered_points(right, right_low), _runs(left, low, high, others, "upto"), chunk)
    return held.select("point.*", "interval.*").union(holding.select("interval.*", "point.*"))
