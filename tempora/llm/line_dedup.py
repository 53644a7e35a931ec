"""Line deduplication over a suffix array of line sequences, built by distributed prefix doubling.

The lines of all documents, blank ones left out, are numbered in one long sequence; a suffix is what follows from a
line to its document's end. Suffixes are ranked by their first line, then by their first two, four and so on lines: in
each round the rank of a suffix is paired with that of the suffix as many lines on, and those that share a rank are
ranked anew within it. Ranks are places in the sorted order, so in the end they are the suffix array. Suffixes whose
first line occurs once begin no repeated run and are left out of it.

A suffix that shares a rank goes on over repeated lines only, so its rounds need no more than its run: the repeated lines
in a row and the one behind them. A run is a row with the ranks of its lines, and one without shared ranks is done with.
A round sorts pairs of ranks by ranges; a task ranks its range, and the first and last pairs of all ranges tell where each
of them begins.

Where a round tells two neighbours apart, they have as many lines in common as the ranks compared, plus those that their
runs share from there on, fewer than as many again. If the lines before two neighbours are neighbours, too, these have one
more in common, so only the first pair of such a row is looked up. Neighbours with a common prefix of some length form its
interval, and all but the first copy in an interval are later copies of a repeated run. So for every suffix the longest
prefix that an earlier one has, too, is found by going along the array both ways with a staircase of the smallest line
numbers for each length. Blocks of the array do so side by side, with the staircases of the blocks before them handed on.

A run counts if it has at least ``min_words`` words. Of every maximal repeated run all copies but the first are deleted,
first by id and then by place.

Cases: null and empty texts have no lines and stay; blank lines (white space only) belong to no run and stay, unless
deleted lines leave them in a row, which is allowed; lines differ by what is between outer white space only; repeated
rows (same id and text) are one document and get the same result; a null id comes last. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

MIN_WORDS = 1
#: Suffixes of the array that one group looks at.
BLOCK = 1 << 16


def bare_lines(text: str) -> list[bytes]:
    """The lines that are not blank, without outer white space."""
    return [s for y in text.encode("utf-8", "surrogatepass").split(b"\n") if (s := y.strip())]


def _marks(batches):
    for batch in batches:
        marks = [[hashlib.sha256(s).digest() for s in bare_lines(x)] for x in texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([len(m) for m in marks], pa.int32()), pa.array(marks, pa.list_(pa.binary()))],
            names=["doc_id", "text_key", "size", "marks"],
        )


def _order(id: str) -> Column:
    """Ids in their order, null last."""
    return F.struct(F.col(id).isNull().alias("unnamed"), F.coalesce(F.col(id), F.lit(0)).cast("long").alias("id"))


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def sequences_of(docs: DataFrame) -> DataFrame:
    """(doc, text_key, start, size, marks): every document with lines, the number of its first one, and its lines."""
    rows = _keyed(docs).mapInArrow(_marks, "doc_id long, text_key long, size int, marks array<binary>").filter("size > 0")
    rows = rows.select(_order("doc_id").alias("doc"), "text_key", "size", "marks", F.monotonically_increasing_id().alias("row"))
    rows, keys = written(rows, "marks"), ["doc", "text_key"]
    starts = _starts(rows.groupBy(*keys).agg(F.max("size").alias("c"), F.min("row").alias("row")), keys)
    return written(rows.join(starts.select("row", "start"), "row").drop("row"), "sequences")


def _split(sequences: DataFrame) -> DataFrame:
    lines = sequences.select("doc", "text_key", "start", "size", F.posexplode("marks").alias("place", "mark"))
    return lines.select((F.col("start") + F.col("place")).alias("n"), "doc", "text_key", "place", (F.col("size") - F.col("place")).alias("below"), "mark")


def lines_of(docs: DataFrame) -> DataFrame:
    """(n, doc, text_key, place, below, mark): every line with words, numbered by document and place. ``below`` counts
    the lines from it to the document's end, itself included."""
    return _split(sequences_of(docs))


def _starts(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` (keys, c, ...) with ``start``: the sum of ``c`` over the smaller keys, by ranges of keys."""
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(groups.repartitionByRange(tasks, *keys).withColumn("part", F.spark_partition_id()), "groups")
    before = dealt.groupBy("part").agg(F.sum("c").alias("own")).select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))  # a row for a range
    within = F.sum("c").over(Window.partitionBy("part").orderBy(*keys)) - F.col("c")
    return dealt.withColumn("within", within).join(F.broadcast(before), "part").select(*groups.columns, (F.col("before") + F.col("within")).alias("start"))


def _numbers(column: pa.Array) -> np.ndarray:
    """A row of numbers for each value of a column of longs, or of binary values of 32 bytes."""
    if pa.types.is_binary(column.type):
        column = column.cast(pa.binary(32))
        return np.frombuffer(column.buffers()[1], np.int64)[column.offset * 4 : (column.offset + len(column)) * 4].reshape(-1, 4)
    return column.to_numpy().reshape(-1, 1)


def _within(keys: list[str], outer: int, kept: list[str]):
    """A range's rows in order with ``i``, their place in it, ``own`` and ``old``, the places where the rows with their
    keys and with their first ``outer`` keys begin, and whether they share their keys. The first and last rows have
    ``side`` and their keys; ``m`` and ``m_run`` are of the row before."""

    def packed(batch: pa.RecordBatch, names: list[str], i: int) -> bytes:
        return b"".join(x if isinstance(x := batch.column(c)[i].as_py(), bytes) else x.to_bytes(8, "big", signed=True) for c in names)

    def run(batches):
        pending, own, old, size = None, np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        fresh = np.ones(1, bool)

        def out(batch, at, own, old, shared, last):
            n, column = batch.num_rows, lambda c: batch.column(c).to_numpy()
            side = np.zeros(n, np.int32)
            side[0] += at == 0
            side[-1] += 2 * last
            edge = [packed(batch, keys, i) if side[i] else None for i in (0, n - 1)]
            outers = [packed(batch, keys[:outer], i) if side[i] else None for i in (0, n - 1)]
            spread = lambda x: pa.array([x[0], *[None] * (n - 2), x[1]] if n > 1 else [x[1]], pa.binary())
            before = [np.concatenate([[x], column(c)[:-1]]) for x, c in zip(ahead, ("n", "run"))]
            ahead[:] = column("n")[-1], column("run")[-1]
            more = [np.arange(at, at + n), own, old, shared, side, *before]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, more), spread(edge), spread(outers)], names=[*kept, *_PLACED])

        ahead = [-1, -1]
        for batch in batches:
            if not batch.num_rows:
                continue
            if pending is not None:
                batch = pa.Table.from_batches([pending, batch]).combine_chunks().to_batches()[0]
            new, newer = [np.zeros(batch.num_rows - 1, bool) for _ in range(2)]
            for k, name in enumerate(keys):
                x = _numbers(batch.column(name))
                differ = (x[1:] != x[:-1]).any(axis=1)
                new |= differ
                if k < outer:
                    newer |= differ
            i = np.arange(size, size + len(new) + 1)
            own = np.maximum.accumulate(np.concatenate([own[-1:], np.where(new, i[1:], 0)]))
            old = np.maximum.accumulate(np.concatenate([old[-1:], np.where(newer, i[1:], 0)]))
            fresh = np.concatenate([fresh[-1:], new])
            if len(new):
                yield out(batch.slice(0, len(new)), size, own[:-1], old[:-1], ~(fresh[:-1] & fresh[1:]), False)
            size, pending = size + len(new), batch.slice(len(new))
        if pending is not None:
            yield out(pending, size, own[-1:], old[-1:], ~fresh[-1:], True)

    return run


_PLACED = ["i", "own", "old", "shared", "side", "m", "m_run", "edge", "outer_edge"]


def _placed(rows: DataFrame, keys: list[str], outer: int = 0) -> DataFrame:
    """``rows`` (keys, n, run, ...) sorted by keys and n, without a binary key, with ``at``, their place in this order,
    ``first`` and ``outer``, the places of the first row with their keys and with their first ``outer`` keys, and
    ``shared``, whether another row has their keys. ``m`` and ``m_run`` are n and run of the row before.

    Rows of one key may lie in many ranges. What ranges tell each other are their first and last rows."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [*(c for c in rows.columns if types[c] != "binary"), "part"]
    sorted_ = rows.repartitionByRange(tasks, *keys, "n").sortWithinPartitions(*keys, "n").withColumn("part", F.spark_partition_id())
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept[:-1]), "part int, i long, own long, old long, shared boolean, side int, m long, m_run long, edge binary, outer_edge binary"])
    sorted_ = written(sorted_.mapInArrow(_within(keys, outer, kept), schema), "sorted")
    first, last = F.expr("side % 2 = 1"), F.expr("side >= 2")
    of = lambda where, c: F.max(F.when(where, F.col(c)))
    parts = sorted_.filter("side > 0").groupBy("part").agg(
        (F.max("i") + 1).alias("rows"), of(first, "edge").alias("edge"), of(last, "edge").alias("end"), of(first, "outer_edge").alias("outer_edge"), of(last, "outer_edge").alias("outer_end"),
        of(last, "own").alias("own_end"), of(last, "old").alias("old_end"), of(last, "n").alias("n_end"), of(last, "run").alias("run_end"),
    )
    every = Window.orderBy("part")  # a row for a range
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = lambda first, last: F.coalesce(F.col(first) == F.lag(last).over(every), F.lit(False))
    parts = parts.withColumns({"offset": F.coalesce(F.sum("rows").over(before), F.lit(0)), "joins": goes_on("edge", "end"), "outer_joins": goes_on("outer_edge", "outer_end")})
    begun = lambda joins, end: F.when(~F.col(joins) | (F.col(end) > 0), F.col("offset") + F.col(end))
    parts = parts.withColumns({"begun": begun("joins", "own_end"), "outer_begun": begun("outer_joins", "old_end")})
    start = lambda joins, begun: F.when(F.col(joins), F.last(begun, ignorenulls=True).over(before)).otherwise(F.col("offset"))
    parts = parts.select(
        "part", "offset", "joins", "own_end", start("joins", "begun").alias("start"), start("outer_joins", "outer_begun").alias("outer_start"),
        F.coalesce(F.lead("joins").over(every), F.lit(False)).alias("continues"), F.lag("n_end").over(every).alias("n_before"), F.lag("run_end").over(every).alias("run_before"),
    )
    place = lambda own, start: F.when(F.col(own) > 0, F.col("offset") + F.col(own)).otherwise(F.col(start))
    return sorted_.join(F.broadcast(parts), "part").select(
        *kept[:-1], (F.col("offset") + F.col("i")).alias("at"), place("own", "start").alias("first"), place("old", "outer_start").alias("outer"),
        F.expr("shared OR own = 0 AND joins OR own = own_end AND continues").alias("shared"),
        F.expr("if(i = 0, n_before, m)").alias("m"), F.expr("if(i = 0, run_before, m_run)").alias("m_run"),
    )


def _wholes(batches, key: str):
    """Tables of whole groups: rows with the same key, which come in a row, are never divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy()
        cut = int(np.argmax(column == column[-1]))
        if cut or held and held[-1].column(key)[-1].as_py() != column[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


RUNS = "run long, below int, ranks array<long>, levels array<int>"


def _lists(run, below, bounds, ranks, levels) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, k)) for x, k in ((ranks, pa.int64()), (levels, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(below, pa.int32()), *lists], names=["run", "below", "ranks", "levels"])


def _runs(batches):
    """Lines of whole documents to runs: lines with a shared rank in a row, and the one behind them. ``levels`` is 0 where
    a rank is shared, otherwise -1."""
    for frame in _wholes(batches, "end"):
        n, below, rank, shared, end = (frame[c].to_numpy() for c in ("n", "below", "rank", "shared", "end"))
        follows = np.concatenate([[False], shared[:-1] & (end[1:] == end[:-1])])
        held = np.flatnonzero(shared | follows)
        starts = np.flatnonzero((shared & ~follows)[held])
        first = held[starts]
        yield _lists(n[first], below[first], [*starts, len(held)], rank[held], np.where(shared[held], 0, -1))


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists in a row, and where each list begins and the last ends."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy().astype(kind), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _pairs(depth: int):
    def run(batches):
        for batch in batches:
            ranks, bounds = _flat(batch.column("ranks"), np.int64)
            levels, _ = _flat(batch.column("levels"), np.int32)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            at = np.flatnonzero(levels >= 0)
            row = row[at]
            place, on = at - bounds[row], at + depth
            inside = on < bounds[row + 1]
            then = np.where(inside, ranks[np.where(inside, on, 0)], -1)  # what ends comes first
            first, below = batch.column("run").to_numpy()[row], batch.column("below").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ranks[at], then, first + place, first, (below - place).astype(np.int32), levels[at])], names=["rank", "next", "n", "run", "below", "level"])

    return run


def _renewed(batches):
    """Runs, each followed by the new ranks of its lines, to runs with those; runs without shared ranks are left out."""
    for frame in _wholes(batches, "run"):
        place = frame["place"].to_numpy()
        tops = np.flatnonzero(place < 0)
        runs = frame.take(pa.array(tops)).combine_chunks().to_batches()[0]
        ranks, bounds = _flat(runs.column("ranks"), np.int64)
        levels, _ = _flat(runs.column("levels"), np.int32)
        new = np.flatnonzero(place >= 0)
        at = bounds[np.searchsorted(tops, new) - 1] + place[new]
        ranks[at], levels[at] = frame["rank"].to_numpy()[new], frame["level"].to_numpy()[new]
        left = np.logical_or.reduceat(levels >= 0, bounds[:-1])
        held = np.repeat(left, np.diff(bounds))
        sizes = np.diff(bounds)[left]
        yield _lists(runs.column("run").to_numpy()[left], runs.column("below").to_numpy()[left], np.concatenate([[0], np.cumsum(sizes)]), ranks[held], levels[held])


def suffix_ranks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, run, below, rank, level) of every suffix whose first line occurs again, and the runs with their ranks by one
    line. Suffixes that are equal to their ends share a rank. A level k > 0 says that the suffixes of the rank before have
    2**(k-1) lines in common with it or more, but not twice as many; with level 0 they have none.

    A rank is the number of suffixes that are smaller as far as they are compared.
    """
    marks = _placed(lines.select("mark", "n", "below", (F.col("n") + F.col("below")).alias("run")), ["mark"])
    marks = marks.select("n", "below", F.col("first").alias("rank"), "shared", F.col("run").alias("end"))
    runs = written(marks.repartition("end").sortWithinPartitions("n").mapInArrow(_runs, RUNS), "runs")
    open_, level, done = runs, 0, []
    while True:
        level += 1
        depth = 1 << (level - 1)
        pairs = open_.mapInArrow(_pairs(depth), "rank long, next long, n long, run long, below int, level int")
        ranked = _placed(pairs, ["rank", "next"], 1).select(
            "n", "run", "below", (F.col("rank") + F.col("first") - F.col("outer")).alias("rank"), F.when(F.col("first") > F.col("outer"), level).otherwise(F.col("level")).alias("level"),
            (F.col("shared") & (F.col("below") >= 2 * depth)).alias("open"),
        )
        ranked = written(ranked, "ranked")
        done.append(ranked.filter("NOT open").drop("open"))
        if ranked.filter("open").isEmpty():
            return reduce(DataFrame.unionByName, done), runs
        new = ranked.select("run", (F.col("n") - F.col("run")).cast("int").alias("place"), "rank", F.when(F.col("open"), F.col("level")).otherwise(-1).alias("level"))
        both = open_.withColumn("place", F.lit(-1)).unionByName(new, allowMissingColumns=True)
        open_ = written(both.repartition("run").sortWithinPartitions("run", "place").mapInArrow(_renewed, RUNS), "runs")


def suffix_array(lines: DataFrame) -> DataFrame:
    """(at, n, below, common): the suffixes in their order from 1, equal ones by number, and how many lines each has in
    common with the one before it."""
    ranks, runs = suffix_ranks(lines)
    placed = _placed(ranks, ["rank"])
    known = F.when(F.col("at") > F.col("first"), F.col("below")).when(F.col("level") < 2, F.col("level"))
    array = written(placed.select((F.col("at") + 1).alias("at"), "n", "run", "below", "m", "m_run", "level", known.cast("long").alias("common")), "array")
    row = Window.partitionBy("run").orderBy("n")
    follows = (F.lag("n").over(row) == F.col("n") - 1) & (F.lag("m").over(row) == F.col("m") - 1)
    open_ = array.filter("common IS NULL").drop("common").withColumn("top", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("n")))
    open_ = written(open_.withColumn("head", F.last("top", ignorenulls=True).over(row)), "open")
    depth = F.call_function("shiftleft", F.lit(1), F.col("level") - 1)
    heads = open_.filter("top IS NOT NULL").select("n", "run", "m", "m_run", depth.alias("depth"))
    behind = lambda n, run: F.slice("ranks", (F.col(n) - F.col(run)).cast("int") + F.col("depth") + 1, F.col("depth"))
    firsts = runs.select("run", "ranks")
    heads = heads.join(firsts, "run").withColumn("x", behind("n", "run")).select("n", "m", F.col("m_run").alias("run"), "depth", "x")
    heads = heads.join(firsts, "run").withColumn("y", behind("m", "run"))
    equal = F.zip_with("x", "y", lambda x, y: x.eqNullSafe(y))
    ends = F.array_position(equal, False)
    heads = heads.select(F.col("n").alias("head"), (F.col("depth") + F.when(ends > 0, ends - 1).otherwise(F.size(equal))).alias("most"))
    found = open_.join(heads, "head").withColumn("common", F.col("most") - F.col("n") + F.col("head"))
    columns = ["at", "n", "below", "common"]
    return written(array.filter("common IS NOT NULL").select(*columns).unionByName(found.select(*columns)), "array")


class Staircase:
    """Of the suffixes gone past, for each common length with where one stands now the smallest number. Steps go up in
    length, and in number: a longer prefix that is no earlier is no step."""

    def __init__(self, lengths=(), numbers=()):
        self.lengths, self.numbers = list(lengths), list(numbers)

    def cut(self, common: int) -> None:
        """Go on to a suffix that has ``common`` lines in common with the one before it."""
        least = None
        while self.lengths and self.lengths[-1] >= common:
            self.lengths.pop()
            number = self.numbers.pop()
            least = number if least is None else min(least, number)
        if common and least is not None:
            self.add(common, least)

    def add(self, length: int, number: int) -> None:
        """A suffix with a number, at a length that no step exceeds. It takes away the shorter steps that are no earlier."""
        while self.numbers and self.numbers[-1] >= number and self.lengths[-1] <= length:
            self.lengths.pop()
            self.numbers.pop()
        if not self.lengths or self.lengths[-1] < length:
            self.lengths.append(length)
            self.numbers.append(number)

    def join(self, other: Staircase) -> None:
        """The steps of both."""
        steps = sorted([*zip(self.lengths, self.numbers), *zip(other.lengths, other.numbers)], key=lambda x: (x[0], -x[1]))
        self.lengths, self.numbers = [], []
        for length, number in steps:
            while self.numbers and self.numbers[-1] >= number:
                self.lengths.pop()
                self.numbers.pop()
            if not self.lengths or self.lengths[-1] < length:
                self.lengths.append(length)
                self.numbers.append(number)

    def longest_before(self, number: int) -> int:
        """The largest length at which an earlier suffix stands."""
        i = bisect_left(self.numbers, number)
        return self.lengths[i - 1] if i else 0


def _forward(n: list[int], below: list[int], common: list[int], stairs: Staircase) -> list[int]:
    """For each suffix of a block the longest prefix that an earlier one before it in the array has; ``stairs`` stands at
    the one before the block, and at the block's last one in the end."""
    out = []
    for number, length, same in zip(n, below, common):
        stairs.cut(same)
        out.append(stairs.longest_before(number))
        stairs.add(length, number)
    return out


def _backward(n: list[int], below: list[int], common: list[int], stairs: Staircase, after: int) -> list[int]:
    """The same for those behind it; ``stairs`` stands at the one behind the block, which has ``after`` lines in common
    with the block's last one."""
    return _forward(n[::-1], below[::-1], [after, *common[:0:-1]], stairs)[::-1]


STEPS = "lengths array<int>, numbers array<long>, back_lengths array<int>, back_numbers array<long>"


def _block(frame: pa.Table) -> tuple[list[int], list[int], list[int]]:
    frame = frame.sort_by("at")
    return frame["n"].to_pylist(), frame["below"].to_pylist(), frame["common"].to_pylist()


def _steps(frame: pa.Table) -> pa.Table:
    """What a block adds to the staircases: its own ones at its last and first suffix, the least number of common lines
    within it, and those of its first suffix with the one before."""
    n, below, common = _block(frame)
    ahead, back = Staircase(), Staircase()
    _forward(n, below, common, ahead)
    _backward(n, below, common, back, 0)
    row = {"block": frame["block"][0].as_py(), "lengths": ahead.lengths, "numbers": ahead.numbers, "back_lengths": back.lengths, "back_numbers": back.numbers}
    return pa.Table.from_pylist([row | {"inner": min(common[1:], default=1 << 30), "first": common[0]}], _STEPS)


_STEPS = pa.schema([("block", pa.int64()), ("lengths", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int64())), ("back_lengths", pa.list_(pa.int32())), ("back_numbers", pa.list_(pa.int64())), ("inner", pa.int32()), ("first", pa.int32())])


def _handed_on(frame: pa.Table) -> pa.Table:
    """The blocks' steps, a few numbers each, to the staircases with which every block begins from both sides."""
    rows = frame.sort_by("block").to_pylist()
    out = [{"block": r["block"], "after": 0} for r in rows]
    stairs = Staircase()
    for r, o in zip(rows, out):
        o |= {"lengths": list(stairs.lengths), "numbers": list(stairs.numbers)}
        stairs.cut(min(r["first"], r["inner"]))
        stairs.join(Staircase(r["lengths"], r["numbers"]))
    stairs, after = Staircase(), 0
    for r, o in zip(rows[::-1], out[::-1]):
        o |= {"back_lengths": list(stairs.lengths), "back_numbers": list(stairs.numbers), "after": after}
        stairs.cut(min(after, r["inner"]))
        stairs.join(Staircase(r["back_lengths"], r["back_numbers"]))
        after = r["first"]
    return pa.Table.from_pylist(out, pa.schema([*(f for f in _STEPS if f.name not in ("inner", "first")), pa.field("after", pa.int32())]))


def _spans(frame: pa.Table, steps: pa.Table) -> pa.Table:
    n, below, common = _block(frame)
    (s,) = steps.to_pylist()
    ahead = _forward(n, below, common, Staircase(s["lengths"], s["numbers"]))
    back = _backward(n, below, common, Staircase(s["back_lengths"], s["back_numbers"]), s["after"])
    span = np.maximum(ahead, back)
    held = span > 0
    return pa.table({"n": pa.array(np.array(n, np.int64)[held]), "below": pa.array(np.array(below, np.int32)[held]), "span": pa.array(span[held].astype(np.int32))})


def repeated_spans(array: DataFrame, block: int = BLOCK) -> DataFrame:
    """(n, below, span): the suffixes of the array that begin with lines with which an earlier one begins, and how many."""
    blocks = array.select("at", "n", "below", F.col("common").cast("int").alias("common"), F.expr(f"(at - 1) div {block}").alias("block"))
    steps = written(blocks.groupBy("block").applyInArrow(_steps, f"block long, {STEPS}, inner int, first int"), "steps")
    handed = steps.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_handed_on, f"block long, {STEPS}, after int")
    return blocks.groupBy("block").cogroup(handed.groupBy("block")).applyInArrow(_spans, "n long, below int, span int")


def without(text: str, runs: list[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[str, int, int]:
    """The text without the lines of those runs (place, lines) that have enough words, how many lines it had, and how
    many of them went."""
    words = np.concatenate([[0], np.cumsum([len(x.split()) for x in bare_lines(text)])])
    gone = np.zeros(len(words), np.int64)
    for place, lines in runs:
        if words[place + lines] - words[place] >= min_words:
            gone[place] += 1
            gone[place + lines] -= 1
    gone, raw, at, kept = np.cumsum(gone) > 0, text.split("\n"), 0, []
    for x in raw:
        blank = not x.encode("utf-8", "surrogatepass").strip()
        if blank or not gone[at]:
            kept.append(x)
        at += not blank
    return "\n".join(kept), len(raw), int(gone[:-1].sum())


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_deleted, text without the deleted lines."""
    sequences = sequences_of(docs)
    spans = repeated_spans(suffix_array(_split(sequences)), block)
    spans = spans.groupBy((F.col("n") + F.col("below")).alias("end")).agg(F.collect_list(F.struct("n", "span")).alias("spans"))
    ends = sequences.select("doc", "text_key", "start", (F.col("start") + F.col("size")).alias("end")).join(spans, "end")
    places = F.transform("spans", lambda x: F.struct((x["n"] - F.col("start")).cast("int").alias("place"), x["span"].alias("span")))
    found = written(ends.select("doc", "text_key", places.alias("runs")), "found")

    def run(batches):
        for batch in batches:
            runs = [[(r["place"], r["span"]) for r in x or ()] for x in batch.column("runs").to_pylist()]
            out = [without(x, r, min_words) if r else (x, x.count("\n") + 1 if x else 0, 0) for x, r in zip(texts(batch), runs)]
            columns = [pa.array([x[i] for x in out], k) for i, k in ((1, pa.int64()), (2, pa.int64()), (0, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_lines", "n_deleted", "text"])

    joined = _keyed(docs).withColumn("doc", _order("doc_id")).join(found, ["doc", "text_key"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_deleted long, text string")
