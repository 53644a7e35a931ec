"""Ranked lexical search, reversed: the items are indexed and the documents are the queries.

The terms of a block of items form an inverted index (term to items and repeats). It is bounded by parameters, so it
goes to every task, and each document's term counts are streamed through it: its score for every item adds up along the
postings of the terms it holds. A task keeps a bounded heap for each item, and heaps are merged by salted groups first,
then by item. A first pass counts what the weights need: documents, their terms, and those that hold each item's terms.
Items beyond one block are taken block by block, each against all documents.

Cases: null and empty texts, and those without a term, have no terms and no rank; every row of the items ranks for
itself, also where ids repeat or are null, and so does every row of the documents; among equal scores a null doc_id
comes last; texts are counted whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_chunks, tidy, written

#: Documents that are ranked for an item.
MOST = 20
#: Items and characters of item texts in one block; what a block's index takes in a task follows from them.
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 4_000_000
#: Bytes of text whose terms are counted at once.
CHUNK = 1 << 22
#: Groups in which an item's heaps are merged before they meet.
SALTS = 32

# What is no part of a term becomes a space, A-Z become a-z, bytes of other letters stay.
_TERM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x in _TERM else 0x20 for x in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_part(n: int, documents: int, all_terms: int) -> int:
    """What a document's number of terms adds to the denominator."""
    return 75 + 25 * n * documents // all_terms


@dataclass
class Index:
    """Inverted index of items: term ``t`` has the postings ``start[t]`` to ``start[t + 1]`` of ``item`` and ``repeats``."""

    place: dict[bytes, int]
    start: np.ndarray
    item: np.ndarray
    repeats: np.ndarray
    items: int

    @classmethod
    def of(cls, found: list[bytes | None]) -> Index:
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for i, text in enumerate(found):
            for term, n in Counter(terms(text)).items():
                postings.setdefault(term, []).append((i, n))
        flat = np.array([p for own in postings.values() for p in own], np.int64).reshape(-1, 2)
        start = np.cumsum([0, *map(len, postings.values())])
        return cls({t: i for i, t in enumerate(postings)}, start, flat[:, 0], flat[:, 1], len(found))


def _counted(texts: list[bytes | None], place: dict[bytes, int]):
    """Each text's number of terms, and (text, term, times) of the index's terms, by text."""
    split = [terms(x) for x in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    known = np.array([place.get(w, -1) for own in split for w in own], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[known >= 0]
    pair, times = np.unique(text * max(len(place), 1) + known[known >= 0], return_counts=True)
    return sizes, *np.divmod(pair, max(len(place), 1)), times


def _chunks(batches, *columns):
    """Rows of the batches in chunks of about ``CHUNK`` bytes of text: texts, and the lists of other columns."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        others = [batch.column(c).to_pylist() for c in columns]
        for a, b in in_chunks([len(x or b"") for x in texts], CHUNK):
            yield texts[a:b], *[x[a:b] for x in others]


def statistics(docs: DataFrame, index: Index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each term of the index the documents that hold it.

    One row of each task for each term it has met; the sums are as many as the index has terms.
    """
    place = index.place

    @tidy
    def run(batches):
        held, documents, every = np.zeros(len(place), np.int64), 0, 0
        for (texts,) in _chunks(batches):
            sizes, _, term, _ = _counted(texts, place)
            held += np.bincount(term, minlength=len(place))
            documents += int((sizes > 0).sum())
            every += int(sizes.sum())
        at = np.flatnonzero(held)
        ids, n = [-2, -1, *at.tolist()], [documents, every, *held[at].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    sums = dict(docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    held = np.zeros(len(place), np.int64)
    for term, n in sums.items():
        if term >= 0:
            held[term] = n
    return sums.get(-2, 0), sums.get(-1, 0), held


class Heaps:
    """The ``most`` best (score, id) of each item: by score, then by the smaller id, null ids last."""

    def __init__(self, items: int, most: int):
        self.most, self.rows = most, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # scores below can no longer enter

    def add(self, item: int, score: int, id: int | None) -> None:
        rows = self.rows[item]
        row = (score, id is not None, 0 if id is None else -id)
        if len(rows) < self.most:
            heapq.heappush(rows, row)
        else:
            heapq.heappushpop(rows, row)
        if len(rows) == self.most:
            self.least[item] = rows[0][0]


def _scored(docs: DataFrame, index: Index, most: int) -> DataFrame:
    """(item, doc_id, score, salt): what the heaps of all tasks hold."""
    documents, every, held = statistics(docs, index)
    weights = np.array([weight(documents, int(n)) for n in held], np.int64)

    @tidy
    def run(batches):
        heaps = Heaps(index.items, most)
        for texts, ids in _chunks(batches, "doc_id"):
            sizes, text, term, times = _counted(texts, index.place)
            spread = np.array([length_part(int(n), documents, every) if n else 1 for n in sizes], np.int64)
            part = weights[term] * (1_000_000_000 * times // (1000 * times + 12 * spread[text]))
            ends = np.append(np.searchsorted(text, np.arange(len(texts))), len(text))
            for i in range(len(texts)):
                own = slice(ends[i], ends[i + 1])
                first, size = index.start[term[own]], index.start[term[own] + 1] - index.start[term[own]]
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                scores = np.zeros(index.items, np.int64)
                np.add.at(scores, index.item[at], np.repeat(part[own], size) * index.repeats[at])
                for j in np.flatnonzero(scores >= heaps.least).tolist():
                    heaps.add(j, int(scores[j]), ids[i])
        rows = [(j, None if not known else -id, score) for j, own in enumerate(heaps.rows) for score, known, id in own]
        columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    heaps = docs.select("doc_id", "text").mapInArrow(run, "item long, doc_id long, score long")
    return heaps.withColumn("salt", F.spark_partition_id() % SALTS)


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def rank_documents(docs: DataFrame, items: DataFrame, most: int = MOST, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` documents with the highest scores above 0 for each row of ``items``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    pick = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found, block, chars = [], [], 0

    def search() -> None:
        index = Index.of([x for _, x in block])
        ids = docs.sparkSession.createDataFrame([(j, id) for j, (id, _) in enumerate(block)], "item long, item_id long")
        best = _best(_best(_scored(docs, index, most), ["item", "salt"], most), ["item"], most)
        found.append(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))

    for row in pick.toLocalIterator():  # one partition of the items at a time, one block of them kept
        block.append((row["item_id"], None if row["text"] is None else bytes(row["text"])))
        chars += len(row["text"] or b"")
        if len(block) >= block_items or chars >= block_chars:
            search()
            block, chars = [], 0
    if block or not found:
        search()
    if len(found) > 1:
        found = [written(x, "ranked") for x in found]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
