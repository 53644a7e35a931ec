import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import intervals, ranks, timeline

POINTS = [(i, v) for i, v in enumerate([5] * 300 + [None, -4, 0, 0, 7, 900_000, 12, 13, 14, 2**40])]
SPANS = [(0, -(10**6), 10**6), (1, 5, 5), (2, 5, 5), (3, 6, 5), (4, None, 9), (5, 3, None), (6, 0, 13), (7, 12, 14), (8, 13, 13), (9, 15, 20), (10, 2**40, 2**40), (11, -4, 0)]


def frames(spark, points=POINTS, spans=SPANS):
    return spark.createDataFrame(points, "p long, v long").repartition(5), spark.createDataFrame(spans, "s long, lo long, hi long").repartition(3)


def meets(spans, others):
    whole = lambda rows: [r for r in rows if None not in r and r[1] <= r[2]]
    return sorted((a, b) for a, lo, hi in whole(spans) for b, low, high in whole(others) if lo <= high and low <= hi)


def random_spans(seed, n, widest):
    rng = random.Random(seed)
    return [(i, lo, lo + rng.randrange(-1, rng.choice([2, 20, widest]))) for i, lo in enumerate(rng.choices(range(-200, 200), k=n))]


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_points_within_intervals_equal_brute_force(spark, chunk):
    points, spans = frames(spark)
    want = sorted((p, s) for p, v in POINTS for s, lo, hi in SPANS if None not in (v, lo, hi) and lo <= v <= hi)
    assert sorted((r.p, r.s) for r in intervals.pairs_within(points, "v", spans, "lo", "hi", chunk).collect()) == want
    counts = {r.s: r.n for r in intervals.counted_within(points, "v", spans, "lo", "hi").collect()}
    assert counts == {s: sum(x == s for _, x in want) for s, lo, hi in SPANS if None not in (lo, hi) and lo <= hi}


@pytest.mark.parametrize("chunk", [2, 64])
def test_overlaps_equal_brute_force(spark, chunk):
    left, right = SPANS + [(100 + i, a, b) for i, a, b in random_spans(1, 120, 300)], random_spans(2, 150, 4000) + [(500, None, 1), (501, 9, 1)]
    a, b = spark.createDataFrame(left, "s long, lo long, hi long"), spark.createDataFrame(right, "o long, begun long, ended long")
    want = meets(left, right)
    assert sorted((r.s, r.o) for r in intervals.overlapping_pairs(a, "lo", "hi", b, "begun", "ended", chunk).collect()) == want
    counts = {r.s: r.n for r in intervals.counted_overlaps(a, "lo", "hi", b, "begun", "ended").collect() if r.n}
    assert counts == {s: n for s in {x for x, _ in want} if (n := sum(x == s for x, _ in want))}


def test_wide_intervals_are_repeated_no_more_than_their_matches_fill(spark):
    points, spans = frames(spark, [(i, i // 3) for i in range(3000)], [(0, -(10**9), 10**9), *[(i, i * 20, i * 20) for i in range(1, 50)]])
    sums = intervals._counted(points.select("v"), [spans.select("lo"), spans.select("hi")])
    runs = intervals._runs(spans, "lo", "hi", sums, "below")
    made = {r["s"]: r["n"] for r in intervals._chunked(runs, 100).groupBy("row.s").agg(F.count("*").alias("n")).collect()}
    assert made[0] == 30 and all(n <= 2 for s, n in made.items() if s)


def test_joins_of_empty_tables(spark):
    points, spans = frames(spark)
    for p, s in ((points.limit(0), spans), (points, spans.limit(0)), (points.limit(0), spans.limit(0))):
        assert intervals.pairs_within(p, "v", s, "lo", "hi").count() == 0
        assert intervals.overlapping_pairs(s, "lo", "hi", s.toDF("o", "a", "b").limit(0), "a", "b").count() == 0
        assert not any(r.n for r in intervals.counted_within(p, "v", s, "lo", "hi").collect() if not p.count())


def test_cumulated_values(spark):
    rows = spark.createDataFrame([(v % 700, 1) for v in range(5000)] + [(3, 100_000)], "v int, n long")
    got = {int(r.v): (r.below, r.upto) for r in intervals.cumulated(rows).collect()}
    sizes = [sum(x % 700 == v for x in range(5000)) + 100_000 * (v == 3) for v in range(700)]
    assert got == {v: (sum(sizes[:v]), sum(sizes[: v + 1])) for v in range(700)}


@pytest.mark.parametrize("hot", [10**6, 50])
def test_ranks_of_a_key_with_most_rows(spark, hot):
    rng = random.Random(4)
    rows = [("big", i) for i in range(2000)] + [(rng.choice(["a", "b", None]), i) for i in range(90)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, v int").repartition(4)
    got = ranks.ranked(frame, ["k"], [F.col("v").desc()], "n", "rows", hot).collect()
    sizes = {k: sum(x == k for x, _ in rows) for k, _ in rows}
    want = {(k, v): sum(x == k and w >= v for x, w in rows) for k, v in rows}
    assert {(r.k, r.v): r.n for r in got} == want and all(r["rows"] == sizes[r.k] for r in got) and len(got) == len(rows)


def test_a_hot_key_is_ranked_by_several_tasks(spark):
    frame = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    got = ranks.ranked_by_ranges(frame, ["k"], [F.col("v")], "n")
    assert got.filter("n <> v + 1").isEmpty() and got.withColumn("t", F.spark_partition_id()).select("t").distinct().count() > 1


def test_pages_do_not_change_when_a_key_is_split(spark, monkeypatch):
    rows = spark.createDataFrame([("x", i, f"19{i % 3:02d}-0{i % 9 + 1}") for i in range(300)] + [("y", 0, "1900")], "loc string, ord int, date string")
    plain = sorted(map(tuple, timeline.paginated(rows, "loc", "ord").collect()))
    monkeypatch.setattr(ranks, "HOT", 20)
    monkeypatch.setattr(ranks.ranked, "__defaults__", (None, 20))
    split = timeline.paginated(rows, "loc", "ord")
    assert sorted(map(tuple, split.collect())) == plain
