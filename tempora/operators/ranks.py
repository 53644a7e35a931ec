"""Row numbers within keys, of which one may hold most of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of a key above which its numbering is split.
HOT = 1_000_000


def ranked_by_ranges(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number from 1 within ``keys`` in ``order``, which should tell rows apart.

    Rows are dealt to ranges of (keys, order). A range numbers its rows, and the first key of a range goes on from the
    ranges before it; so a key's rows may lie in many ranges, and no task sees them all.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(tasks, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    sizes = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").drop("_n")  # one row for a range at most
    begun = begun.select([F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)] + [F.col("_part").alias("_p"), "_before"])
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    numbered = dealt.withColumn("_in", within).join(F.broadcast(begun), same, "left")
    return numbered.withColumn(name, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long")).select(*rows.columns, name)


def hot_keys(rows: DataFrame, keys: list[str], hot: int) -> tuple[DataFrame, Column, bool]:
    """Keys of more than ``hot`` rows, as (_k0, _k1, ..., _rows), the condition that joins them, and whether there are
    any. They are fewer than rows by ``hot``, so they may be broadcast."""
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(keys, names)]).agg(F.count("*").alias("_rows"))
    large = stored(sizes.filter(F.col("_rows") > hot), "hot-keys")
    same = F.lit(True)
    for c, k in zip(keys, names):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return F.broadcast(large), same, not large.isEmpty()


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str, count: str | None = None, hot: int = HOT) -> DataFrame:
    """The same by one window, but for keys of more than ``hot`` rows. ``count`` names a column for the number of the
    key's rows."""
    number = {name: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")}
    if count:
        number[count] = F.count("*").over(Window.partitionBy(*keys))
    large, same, any_hot = hot_keys(rows, keys, hot)
    if not any_hot:
        return rows.withColumns(number)
    split = rows.join(large, same).drop(*[f"_k{i}" for i in range(len(keys))])
    split = split.withColumnRenamed("_rows", count) if count else split.drop("_rows")
    few = rows.join(large, same, "left_anti").withColumns(number)
    return few.unionByName(ranked_by_ranges(split, keys, order, name))
