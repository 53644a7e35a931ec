"""Exact top-k search over integer vectors by MaxScore.

A dimension is a term, a vector's component its weight there. Vectors are dealt to shards and queries to blocks of
bounded size; a shard meets a block in one task, finds each query's best ``k`` there, and the shards' lists are merged.

Within a shard every term has the least and the largest weight of its postings, which bound what the term can add to a
query's score. A query's terms are ordered by the width of their bounds. Those at the end of the order whose bounds
together cannot lift a vector above the query's threshold are non-essential: the essential terms' postings are
traversed, and the others are probed, largest first, only for vectors that are still competitive. The threshold is the
k-th best score so far and rises while the postings are traversed in pieces. All arithmetic is exact, in the narrowest
kind of number that holds every score that the components allow, so a score equals the plain inner product.

Shards see each other's work through the threshold that a first, small shard gives every query. The queries are a stated
part of the rows, so shards times blocks grow with both; each meeting ships a shard and a block once, and the larger they
are the less is shipped for a pair of rows.

Cases: a row without vec_id is a candidate, with null as its id and after others of its score. Vectors that are null or hold a null or non-finite component take no part, as queries or candidates; nor do
empty vectors. Vectors of different lengths meet in the terms they share. Ties go to the smaller id. A query's own row
is no candidate; other rows of its id are, and each of them is a query of its own. Components and scores that 64 bits do
not hold are an error. Fewer than ``k`` candidates give fewer rows; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, QUERY_STEP, TOP = 256, 50, 5
#: Vectors of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_ROWS = 8192, 4096
#: Postings that are traversed before the threshold is looked at again, and terms that are probed at once.
PIECE, PROBED = 1024, 8
LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(SCALE * x) of every component of the vectors that take part."""
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    too_large = F.raise_error(F.lit("a component does not fit into 64 bits")).cast("long")
    whole = F.transform(x, lambda e: F.when(F.abs(e) < 2.0**63 / SCALE, F.floor(e * SCALE)).otherwise(too_large))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    rows = column.to_pylist()
    width = width or max(map(len, rows))
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x[:width]
    return out


def _kind(a: np.ndarray, b: np.ndarray):
    """The kind of number in which all inner products of these rows, and the bounds on them, are exact."""
    most = max((abs(int(f(a))) for f in (np.min, np.max)), default=0) * max((abs(int(f(b))) for f in (np.min, np.max)), default=0) * a.shape[1] * 4
    return np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def search(queries: np.ndarray, query_rows: np.ndarray, shard: np.ndarray, rows: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int = TOP):
    """(query number, place in the shard, score) of each query's best ``k`` of the shard that can reach its floor.

    ``rows`` tell rows apart, ``ids`` ascend, so of equal scores the first places count; null ids come last. ``floors``: for each query a score that ``k`` other vectors reach, or the
    smallest integer.
    """
    exact = _kind(queries, shard)
    low, high = shard.min(axis=0).astype(exact), shard.max(axis=0).astype(exact)
    postings = shard.T.astype(exact)
    out = []
    for n, (q, own, floor) in enumerate(zip(queries.astype(exact), query_rows, floors)):
        ends = np.stack([q * low, q * high])
        most, least = ends.max(axis=0), ends.min(axis=0)
        order = np.argsort((least - most).astype(float), kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what terms from here on can add at most
        # In the place of the vectors that reach the floor stand ones that are below all of these.
        best = [(-int(floor) + 1, None)] * k if floor > LEAST else []
        bar = int(floor) if best else None
        for at in range(0, len(ids), PIECE):
            stop = min(at + PIECE, len(ids))
            alive = np.flatnonzero(rows[at:stop] != own) + at
            if bar is None:
                essential = len(order)
            else:  # the fewest terms in front without which nothing reaches the bar
                reach = np.cumsum(most[order] - least[order])
                essential = min(len(order), int(np.searchsorted(reach, max(rest[0] - bar, 0))) + 1)
            done = essential
            got = q[order[:done]] @ postings[order[:done]][:, alive] if done < len(order) else q @ postings[:, alive]
            while done < len(order) and len(alive):
                keep = got + rest[done] >= bar
                alive, got = alive[keep], got[keep]
                probe = order[done : done + PROBED]
                got = got + q[probe] @ postings[np.ix_(probe, alive)]
                done += len(probe)
            if bar is not None:
                alive, got = alive[got >= bar], got[got >= bar]
            found = list(zip([-int(x) for x in got.tolist()], alive.tolist()))
            if found:
                best = sorted(best + found, key=lambda x: (x[0], x[1] is None, x[1]))[:k]
                if len(best) == k:
                    bar = -best[-1][0]
        out += [(n, i, -s) for s, i in best if i is not None]
    return out


def _packed(name: str):
    def run(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        m = _matrix(frame["v"])
        small = -(2**31) <= m.min() and m.max() < 2**31
        row = {
            name: [frame[name][0].as_py()],
            f"{name}_ids": [frame["vec_id"].fill_null(0).to_numpy().astype("<i8").tobytes()],
            f"{name}_nulls": pa.array([frame["vec_id"].null_count], pa.int32()),
            f"{name}_numbers": [frame["row"].to_numpy().astype("<i8").tobytes()],
            f"{name}_width": pa.array([m.shape[1]], pa.int32()),
            f"{name}_kind": ["<i4" if small else "<i8"],
            f"{name}_rows": [m.astype("<i4" if small else "<i8").tobytes()],
        }
        if name == "block":
            row["floors"] = [frame["floor"].to_numpy().astype("<i8").tobytes()]
        return pa.table(row)

    return run


PACKED = "{0} long, {0}_ids binary, {0}_nulls int, {0}_numbers binary, {0}_width int, {0}_kind string, {0}_rows binary"


def _unpacked(r: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(r[f"{name}_rows"], r[f"{name}_kind"]).reshape(-1, r[f"{name}_width"]).astype(np.int64)
    return np.frombuffer(r[f"{name}_ids"], "<i8"), np.frombuffer(r[f"{name}_numbers"], "<i8"), rows


def _widened(*matrices: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[1] for m in matrices)
    return [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]


def _meet(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids, numbers, shard = _unpacked(r, "shard")
            own_ids, own, queries = _unpacked(r, "block")
            shard, queries = _widened(shard, queries)
            found = search(queries, own, shard, numbers, ids, np.frombuffer(r["floors"], "<i8"))
            n, at = [x[0] for x in found], np.array([x[1] for x in found], np.int64)
            unnamed = at >= len(ids) - r["shard_nulls"]
            # A score of more than 64 bits is refused here.
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[n] if n else [], pa.int64()), pa.array(own_ids[n] if n else [], pa.int64()), pa.array(ids[at] if n else [], pa.int64(), mask=unnamed), pa.array([x[2] for x in found], pa.int64())],
                names=["row", "query_id", "vec_id", "score"],
            )


def top_k(vectors: DataFrame, query_step: int = QUERY_STEP, k: int = TOP, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_step`` its best ``k`` others."""
    if k != TOP:
        raise ValueError("k is fixed")
    rows = written(quantised(vectors, column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    shards, blocks = -(-max(n, 1) // SHARD_ROWS), -(-max(n // query_step, 1) // BLOCK_ROWS)
    asked = rows.filter(F.col("vec_id") % query_step == 0)

    # A first look at a few vectors gives every query a floor: the k-th best of them. A bounded number of rows.
    first = rows.orderBy(F.xxhash64("vec_id"), "row").limit(64).toArrow()
    first_rows, first_numbers = (_matrix(first["v"]) if first.num_rows else np.zeros((0, 1), np.int64)), first["row"].to_numpy()

    def floored(batches):
        for batch in batches:
            own = batch.column("row").to_numpy()
            floors = np.full(len(own), LEAST, np.int64)
            if len(own) and len(first_rows) > k:
                m, f = _widened(_matrix(batch.column("v")), first_rows)
                exact = _kind(m, f)
                s = m.astype(exact) @ f.astype(exact).T
                s = np.where(own[:, None] == first_numbers, -(2**62) if exact is object else np.iinfo(np.int64).min, s)
                best = np.sort(s, axis=1)[:, -k]
                floors = np.array([int(x) if abs(x) < 2**62 else LEAST for x in best.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("row"), pa.array(floors)], names=["vec_id", "v", "row", "floor"])

    asked = asked.mapInArrow(floored, "vec_id long, v array<long>, row long, floor long")
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    packed_blocks = asked.withColumn("block", part(blocks)).groupBy("block").applyInArrow(_packed("block"), PACKED.format("block") + ", floors binary")
    packed_shards = rows.withColumn("shard", part(shards)).groupBy("shard").applyInArrow(_packed("shard"), PACKED.format("shard"))
    # Every shard meets every block of the stated queries: one row for each, spread over all tasks.
    to = packed_shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    meetings = to.join(packed_blocks, "block").repartition(max(shards * blocks, 1), "shard", "block")
    found = meetings.mapInArrow(_meet, "row long, query_id long, vec_id long, score long")
    best = found.groupBy("row", "query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("unnamed"), "vec_id"))), 1, k).alias("b")
    )
    return best.select("query_id", F.posexplode("b").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
