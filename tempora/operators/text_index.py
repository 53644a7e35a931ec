"""Keyword search by an index of trigrams.

A stored index has the rows, numbered, and for each trigram of their lower-cased texts the numbers of the rows that
hold it, in blocks, so that a trigram of very many rows is many short lists. A block is a run of rows that one task reads,
which makes its lists; they name rows by their places in it, and only they are shuffled, once. A query's trigrams are
looked up and their lists intersected block by block; the rows that are left are looked at by the literal test, which decides. Queries
shorter than a trigram are a scan.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: Letters of a gram, parts of the index by the grams' hash, and bits of a row's place within a block.
GRAM, PARTS, BLOCK = 3, 64, 16
#: Entries after which a block ends, so that a task holds few, however long its texts are.
ENTRIES = 4_000_000
LISTS = "gram string, block long, rows array<int>"
TEXTS = ("title", "description", "name")


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _blocks(size: int, entries: int):
    """A function from batches of numbered texts to their blocks' lists; a block is named by its first row's number."""

    def run(batches):
        held, numbers, n = defaultdict(list), [], 0

        def flush():
            names = sorted(held)
            flat = np.fromiter((i for g in names for i in held[g]), np.int32, n)
            ends = np.cumsum([0, *(len(held[g]) for g in names)]).astype(np.int32)
            first = pa.array(np.full(len(names), numbers[0], np.int64))
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), first, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["gram", "block", "rows"])
            held.clear()
            numbers.clear()
            return out

        for batch in batches:
            for number, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                # The numbers of a file's rows follow each other; a gap ends a block.
                if numbers and (number != numbers[-1] + 1 or len(numbers) >= size or n >= entries):
                    yield flush()
                    n = 0
                for gram in set().union(*(grams(t) for t in texts if t)):
                    held[gram].append(len(numbers))
                    n += 1
                numbers.append(number)
        if numbers:
            yield flush()

    return run


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def build(events: DataFrame, path: str) -> None:
    """Store the index of flat event rows (title, description, name, ...) at ``path``, in place of an older one."""
    spark = events.sparkSession
    events.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    lists = rows.select("_row", *[F.lower(c) for c in TEXTS]).mapInArrow(_blocks(1 << BLOCK, ENTRIES), LISTS).withColumn("part", _part(F.col("gram")))
    # A part's lists are sorted, so that a reader passes over most row groups of its file.
    lists.repartition(PARTS, "part", F.pmod(F.xxhash64("block"), F.lit(4))).sortWithinPartitions("part", "gram", "block").write.mode("overwrite").partitionBy("part").parquet(f"{path}/lists")


def _lists(spark: SparkSession, path: str, query: str) -> tuple[DataFrame, int]:
    """The lists of the query's grams, and how many grams it has."""
    wanted = sorted(grams(spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]))
    parts = [r["p"] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(_part(F.col("g")).alias("p")).distinct().collect()] if wanted else []
    return spark.read.parquet(f"{path}/lists").filter(F.col("part").isin(parts) & F.col("gram").isin(wanted)), len(wanted)


def _candidates(lists: DataFrame, n: int) -> DataFrame:
    """(_row): rows that are in the lists of all ``n`` grams."""
    blocks = lists.groupBy("block").agg(F.collect_list("rows").alias("lists")).filter(F.size("lists") == n)
    both = F.aggregate(F.slice("lists", 2, n), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return blocks.select(F.explode(F.transform(both, lambda i: F.col("block") + i)).alias("_row"))


def search_indexed(spark: SparkSession, path: str, query: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``search.search_flat`` over the rows of an index."""
    rows = spark.read.parquet(f"{path}/rows")
    if len(query) >= GRAM:
        lists, n = _lists(spark, path, query)
        if n:
            rows = rows.join(_candidates(lists, n), "_row", "left_semi")
    return search.search_flat(rows, query, low, high).drop("_row")


def share_read(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(entries, entries_read, rows, rows_read, rows_found): what a query reads of an index and what it finds."""
    size = F.coalesce(F.sum(F.size("rows")), F.lit(0))
    entries = spark.read.parquet(f"{path}/lists").agg(size.alias("entries"))
    rows = spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("rows"))
    found = search_indexed(spark, path, query).agg(F.count("*").alias("rows_found"))
    lists, n = _lists(spark, path, query)
    if not n:
        read = rows.select(F.lit(0).cast("long").alias("entries_read"), F.col("rows").alias("rows_read"))
    else:
        read = lists.agg(size.alias("entries_read")).crossJoin(_candidates(lists, n).agg(F.count("*").alias("rows_read")))
    return entries.crossJoin(read).crossJoin(rows).crossJoin(found).select("entries", "entries_read", "rows", "rows_read", "rows_found")  # one row each
