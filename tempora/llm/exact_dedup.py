"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition sorts the digests of its own texts into runs, one for each digest range, and packs each into one row. The
runs of a range are then exchanged in rounds of a tree of fan-in ``FAN_IN``, three binomial rounds in one: each node
merges the runs of its children, which are sorted already, and keeps, for every digest, the row that stays and the number
of rows behind it, after it has verified by a second, unrelated hash that the texts are the same. No node ever holds more
than one digest range, and a digest that a third of all rows share is one entry of each run, so groups of copies cannot
become hot.

Cases: null text counts as empty; empty texts equal one another and any text of white space only. Ties in length go to
the smaller id, and of rows with the same id and length to one of them. Null ids are allowed and lose ties. An empty table
gives an empty result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, texts, written

FAN_IN = 8
#: Digest ranges at least, and rows of a range about; rows that a task sorts at once.
RANGES, RANGE_ROWS, HELD = 128, 200_000, 200_000

FOUND = "row long, doc_id long, digest binary, n_points long, proof long"
RUN = "part int, node long, run binary"
#: One entry of a run. ``rank`` is the id, null being last; ``row`` tells rows with the same id apart.
_ENTRY = np.dtype([("digest", "S32"), ("n_points", "<i8"), ("nameless", "?"), ("keep_id", "<i8"), ("row", "<i8"), ("proof", "<i8"), ("copies", "<i8")])


def _digest(batches):
    for batch in batches:
        found = texts(batch)
        bare = [x.encode("utf-8", "surrogatepass").translate(None, ASCII_SPACE) for x in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                pa.array([hashlib.sha256(x).digest() for x in bare], pa.binary()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(x, seed=len(x) & 0xFFFFFFFF) - (1 << 63) for x in bare], pa.int64()),
            ],
            names=["row", "doc_id", "digest", "n_points", "proof"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """``FOUND``: digest of the text without white space, code points of the text, and a second hash. ``row`` is only
    the same again once the result has been written."""
    pick = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pick.mapInArrow(_digest, FOUND)


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs merged into one: of each digest the longest original text, then the smallest id, stays.

    The stable sort of byte strings finds the runs in what it is given and merges them, so nothing is sorted anew.
    """
    rows = np.concatenate(runs)
    rows = rows[np.argsort(rows["digest"], kind="stable")]
    if not len(rows):
        return rows
    new = np.append(True, rows["digest"][1:] != rows["digest"][:-1])
    starts = np.flatnonzero(new)
    if len(starts) == len(rows):
        return rows
    if (rows["proof"] != rows["proof"][starts][np.cumsum(new) - 1]).any():  # verified at every level
        raise ValueError("texts that differ have one SHA-256")
    out = rows[starts].copy()
    out["copies"] = np.add.reduceat(rows["copies"], starts)
    size = np.diff(np.append(starts, len(rows)))
    several = np.flatnonzero(np.repeat(size > 1, size))  # only groups of copies need another order
    group = (np.cumsum(new) - 1)[several]
    some = rows[several]
    order = np.lexsort((some["row"], some["keep_id"], some["nameless"], -some["n_points"], group))
    best = order[np.append(True, group[order][1:] != group[order][:-1])]
    for name in ("n_points", "nameless", "keep_id", "row"):
        out[name][size > 1] = some[name][best]
    return out


def _local_runs(ranges: int):
    """The runs of a partition: its digests sorted, some hundred thousand at a time, and cut at the ranges."""

    def run(batches):
        context = TaskContext.get()
        node = context.partitionId() if context else 0
        held, n_held = [], 0

        def out():
            rows = np.concatenate(held)
            rows = merged([rows[np.argsort(rows["digest"], kind="stable")]])
            first = np.frombuffer(rows["digest"].tobytes(), np.uint8).reshape(-1, 32)[:, :4].copy().view(">u4").ravel().astype(np.int64)
            part = first * ranges >> 32
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            runs = [x.tobytes() for x in np.split(rows, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array([node] * len(starts), pa.int64()), pa.array(runs, pa.binary())], names=["part", "node", "run"])

        for batch in batches:
            rows = np.zeros(batch.num_rows, _ENTRY)
            ids = batch.column("doc_id")
            rows["digest"], rows["copies"] = batch.column("digest").to_pylist(), 1
            rows["nameless"] = ids.is_null().to_numpy(zero_copy_only=False)
            rows["keep_id"] = ids.fill_null(0).to_numpy()
            for name in ("n_points", "row", "proof"):
                rows[name] = batch.column(name).to_numpy()
            held.append(rows)
            n_held += len(rows)
            if n_held >= HELD:
                yield out()
                held, n_held = [], 0
        if n_held:
            yield out()

    return run


def _node(frame: pa.Table) -> pa.Table:
    """One node of the tree: the runs of its children merged into one."""
    run = merged([np.frombuffer(x, _ENTRY) for x in frame["run"].to_pylist()])
    return pa.table({"part": frame["part"][:1], "node": frame["node"][:1], "run": pa.array([run.tobytes()], pa.binary())})


def _top(frame: pa.Table) -> pa.Table:
    """The root of a range: the entries of the digests that several rows have."""
    rows = merged([np.frombuffer(x, _ENTRY) for x in frame["run"].to_pylist()])
    rows = rows[rows["copies"] > 1]
    return pa.table(
        {
            # ``tolist`` of byte strings drops zero bytes at their ends.
            "digest": pa.array([d.ljust(32, b"\0") for d in rows["digest"].tolist()], pa.binary()),
            "keep_id": pa.array(rows["keep_id"], mask=rows["nameless"]),
            "keep_row": pa.array(rows["row"].copy()),
            "copies": pa.array(rows["copies"].copy()),
        }
    )


def copied(found: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, copies) of each digest that several rows of ``found`` have; see ``digests``."""
    ranges = max(RANGES, -(-found.count() // RANGE_ROWS))
    width = max(1, found.rdd.getNumPartitions())
    runs = found.mapInArrow(_local_runs(ranges), RUN)
    while True:
        width = -(-width // FAN_IN)
        nodes = runs.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("part", "node")
        if width <= 1:
            return nodes.applyInArrow(_top, "digest binary, keep_id long, keep_row long, copies long")
        runs = nodes.applyInArrow(_node, RUN)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = written(digests(docs), "digests")
    joined = found.join(copied(found), "digest", "left")
    alone = F.col("copies").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another row stands for; all columns stay.

    An id whose rows all go is dropped by itself. Where an id, or none, stands on several rows, they are looked at again
    and told apart by their digests, and of those that are alike one stays.
    """
    found = written(digests(docs), "digests")
    marked = found.join(copied(found), "digest", "left").withColumn("stays", F.col("copies").isNull() | (F.col("row") == F.col("keep_row")))
    marked = written(marked.select("doc_id", "digest", "stays"), "marks")
    per = marked.groupBy("doc_id").agg(F.count("*").alias("_n"), F.count_if("stays").alias("_kept"))
    gone = written(per.filter("_kept = 0 and doc_id is not null").select(F.col("doc_id").alias("_gone")), "gone")
    mixed = per.filter("_kept > 0 and _kept < _n or doc_id is null and _kept < _n").select(F.col("doc_id").alias("_mixed"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own, text_at = F.col(names[docs.columns.index("doc_id")]).cast("long"), names[docs.columns.index("text")]
    rows = docs.toDF(*names)
    kept = rows.join(gone, own == F.col("_gone"), "left_anti")
    if mixed.isEmpty():
        return kept.toDF(*docs.columns)
    mixed = written(mixed, "mixed")
    text = F.coalesce(F.col(text_at).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""), 256))
    plain = kept.join(mixed, own.eqNullSafe(F.col("_mixed")), "left_anti")
    again = kept.join(mixed, own.eqNullSafe(F.col("_mixed")), "left_semi").withColumn("_key", key).withColumn("_row", F.monotonically_increasing_id())
    again = written(again, "again")
    # The row that stays is the longest of its id and text, as it was in the merge.
    stay = marked.filter("stays").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_key")).distinct()
    met = again.join(stay, (again["_key"] == stay["_key"]) & own.eqNullSafe(stay["_id"])).select(own.alias("_id"), again["_key"], "_row", F.length(text).alias("_n"))
    best = met.groupBy("_id", "_key").agg(F.max_by("_row", F.struct("_n", -F.col("_row"))).alias("_row"))
    return plain.unionByName(again.join(best.select("_row"), "_row", "left_semi").select(*names)).toDF(*docs.columns)
