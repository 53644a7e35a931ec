"""Packing token sequences by order-preserving dynamic programming.

The documents of an input partition are laid end to end, in the order they have there, each followed by an end id. The
stream may be cut where a document ends, at small cost where a sentence ends, and at larger cost at any of a few places
inside sentences that have no end for a long stretch. Among all chains of windows of at most ``width`` ids between such
places the one with the least padding plus cut penalties is chosen:

    best[j] = penalty(j) + min over i of best[i] + padding(place[j] - place[i])

Padding is ``width - length``, so the minimum is over ``best[i] + place[i]`` in a window that slides with ``j``: a
monotone queue gives it in constant time. Lengths that are a power of two are not padded; those twelve transitions are
looked up by place. Every so often the chain is ended and written, so a task holds a bounded stretch of ids; nothing
is shuffled, and every partition costs less than one window of padding.

Cases: null and empty texts are one end id; documents of any length are cut; repeated rows are packed again; ids may be
null or repeat; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from .bpe import encoder
from .common import in_chunks, texts, tidy

WIDTH, END_ID = 2048, 1
#: Penalties, in ids of padding: for a cut at a sentence's end, and inside a sentence.
SENTENCE_CUT, INNER_CUT = 4.0, 24.0
#: Ids after which a place inside a sentence is offered if the sentence has not ended.
INNER_STEP = 256
#: Ids that are packed at once, about.
STRETCH = 500_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, padded_length long"
)


def padded(length: int, width: int = WIDTH) -> int:
    """What a sequence takes up: ``width``, or its own length if that is a power of two."""
    return length if length & (length - 1) == 0 else width


def places(stops: np.ndarray, sentence_ends: np.ndarray, total: int, step: int = INNER_STEP):
    """Sorted places for cuts and their penalties: document ends, sentence ends, and places inside long sentences."""
    where = np.union1d(stops, sentence_ends)
    where = np.union1d(where, [0, total])
    gaps = np.diff(where)
    extra = [np.arange(where[i] + step, where[i + 1], step) for i in np.flatnonzero(gaps > step)]
    everything = np.union1d(where, np.concatenate(extra)) if extra else where
    penalty = np.full(len(everything), INNER_CUT)
    penalty[np.searchsorted(everything, sentence_ends)] = SENTENCE_CUT
    penalty[np.searchsorted(everything, stops)] = 0.0
    penalty[np.searchsorted(everything, [0, total])] = 0.0
    return everything, penalty


def unpadded(where: list[int], width: int = WIDTH) -> list[list[int]]:
    """For each place those before it at distances that are not padded, nearest first."""
    own, out = np.array(where), [[] for _ in where]
    numbers = np.full(own[-1] - own[0] + 1, -1)
    numbers[own - own[0]] = np.arange(len(own))
    for size in (1 << k for k in range(width.bit_length()) if 1 << k <= width):
        from_ = own - own[0] - size
        to = np.flatnonzero(from_ >= 0)
        k = numbers[from_[to]]
        for a, b in zip(to[k >= 0].tolist(), k[k >= 0].tolist()):
            out[a].append(b)
    return out


def best_cuts(where: list[int], penalty: list[float], width: int = WIDTH) -> list[int]:
    """The places of the cheapest chain of windows from the first place to the last."""
    n = len(where)
    best, back = [0.0] * n, [0] * n
    jumps = unpadded(where, width)
    queue = deque([0])
    key = [float(where[0])] + [0.0] * (n - 1)
    for j in range(1, n):
        p = where[j]
        while where[queue[0]] < p - width:
            queue.popleft()
        i = queue[0]
        low, come = key[i] + width - p, i
        for k in jumps[j]:
            if best[k] < low:
                low, come = best[k], k
        low += penalty[j]
        best[j], back[j] = low, come
        key[j] = new = low + p
        while queue and key[queue[-1]] >= new:
            queue.pop()
        queue.append(j)
    cuts, j = [where[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(where[j])
    return cuts[::-1]


def pack(ids: np.ndarray, lengths: np.ndarray, is_end: np.ndarray, width: int = WIDTH):
    """Pieces of documents laid end to end: (document, start in it, length, sequence, offset, sequence length)."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    total = int(bounds[-1])
    where, penalty = places(bounds[1:-1], np.flatnonzero(is_end) + 1, total)
    cuts = np.array(best_cuts(where.tolist(), penalty.tolist(), width))
    edges = np.union1d(bounds, cuts)
    begin, size = edges[:-1], np.diff(edges)
    doc = np.searchsorted(bounds, begin, "right") - 1
    seq = np.searchsorted(cuts, begin, "right") - 1
    return doc, begin - bounds[doc], size, seq, begin - cuts[seq], np.diff(cuts)[seq]


def pack_documents(docs: DataFrame, path: str, width: int = WIDTH) -> DataFrame:
    """One row for each piece of a document; see ``SCHEMA``. Sequences of a partition have consecutive ids."""

    @tidy
    def run(batches):
        code = encoder(path)
        ends = [i for i, t in code.shown.items() if t in (".</w>", "!</w>", "?</w>", "...</w>", '."</w>')]
        table = np.zeros(len(code.shown) + 1, bool)
        table[ends] = True
        ending = np.uint32(END_ID).tobytes()
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        names, coded, held = [], [], 0

        def flush():
            nonlocal number
            blob = b"".join(coded)
            ids = np.frombuffer(blob, "<u4")
            lengths = np.array([len(x) >> 2 for x in coded], np.int64)
            doc, start, size, seq, offset, whole = pack(ids, lengths, table[ids], width)
            begin = (np.cumsum(size) - size) * 4
            crc = [zlib.crc32(blob[a:b]) for a, b in zip(begin.tolist(), (begin + size * 4).tolist())]
            columns = [
                pa.array(names, pa.int64()).take(pa.array(doc)),
                pa.array(start, pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(lengths[doc], pa.int64()),
                pa.array(seq + number, pa.int64()),
                pa.array(offset, pa.int64()),
                pa.array(whole, pa.int64()),
                pa.array(np.where(whole & (whole - 1), width, whole), pa.int64()),
            ]
            number += int(seq[-1]) + 1
            names.clear()
            coded.clear()
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            own, found = batch.column("doc_id").to_pylist(), texts(batch)
            for a, b in in_chunks([len(x) for x in found], 2 * STRETCH):
                for i, x in zip(own[a:b], code.encode_all(found[a:b])):
                    names.append(i)
                    coded.append(x + ending)
                    held += len(x) // 4 + 1
                    if held >= STRETCH:
                        yield flush()
                        held = 0
        if coded:
            yield flush()

    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pick.mapInArrow(run, SCHEMA)
