"""Keyed edits of locations with nested events, and of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Ranges in which rows are numbered side by side.
RANGES = 256


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their number from 1 in the order of a numeric column.

    Rows are dealt to ranges by approximate quantiles and numbered there, and every range begins behind the rows of
    those before it, so no task sees all rows.
    """
    edges = rows.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_edges"))
    dealt = rows.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e <= F.col(order)))).drop("_edges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")  # at most ``RANGES`` rows
    at = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("_in", at).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_before", "_in")


def upserted(locations: DataFrame, new: DataFrame, key: str = "id", place: str = "loc_ord") -> DataFrame:
    """Rows of ``new`` replace those with their key in place; the others follow at the end, in their own order.

    ``new`` has the columns of ``locations``; its places order what is appended. Of several rows of one key the last is
    written, at the place of the first.
    """
    others = [c for c in new.columns if c not in (key, place)]
    new = new.groupBy(key).agg(F.min(place).alias(place), F.max_by(F.struct(*others), place).alias("_last")).select(key, place, "_last.*")
    last = locations.agg(F.coalesce(F.max(place), F.lit(-1)).alias("_last"))
    fresh = new.join(locations.select(key), key, "left_anti")
    fresh = numbered(fresh, place, "_at").crossJoin(F.broadcast(last)).withColumn(place, (F.col("_last") + F.col("_at")).cast(locations.schema[place].dataType)).select(*locations.columns)
    rest = [c for c in locations.columns if c not in (key, place)]
    joined = locations.alias("o").join(new.withColumn("_is", F.lit(True)).alias("n"), key, "left")
    merged = joined.select(key, F.col(f"o.{place}").alias(place), *[F.when(F.col("n._is"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])
    return merged.select(*locations.columns).unionByName(fresh)


def deleted(locations: DataFrame, id, key: str = "id") -> DataFrame:
    """All rows but those with this key."""
    return locations.filter(~F.col(key).eqNullSafe(F.lit(id)))


def added_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and the incoming rows whose keys it lacks; repeats within ``incoming`` all stay."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def events_added(locations: DataFrame, incoming: DataFrame, id: str = "location_id") -> DataFrame:
    """Locations with ``incoming`` events (location_id, ord, event) appended where their ids are new; unknown locations drop."""
    per = incoming.groupBy(id).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "event"))), lambda x: x["event"]).alias("_new"))
    joined = locations.join(per.withColumnRenamed(id, "id"), "id", "left")
    known = F.transform("events", lambda e: e["id"])
    new = F.filter(F.coalesce("_new", F.array().cast(locations.schema["events"].dataType)), lambda e: ~F.array_contains(known, e["id"]))
    return joined.withColumn("events", F.concat("events", new)).select(*locations.columns)


def event_updated(events: Column, new: Column) -> Column:
    """The array with its first event of the new event's id replaced."""
    at = F.array_position(F.transform(events, lambda e: e["id"]), new["id"])
    return F.transform(events, lambda e, i: F.when(i + 1 == at, new).otherwise(e))


def event_deleted(events: Column, id: Column) -> Column:
    return F.filter(events, lambda e: e["id"] != id)


def edited(rows: DataFrame) -> DataFrame:
    """Edits trimmed; those with blank title or date are refused. The form of the date is not looked at."""
    clean = rows.withColumns({c: trimmed(F.col(c)) for c in ("title", "date", "description")})
    return clean.filter((F.col("title") != "") & (F.col("date") != ""))


def all_selected(parsed: DataFrame, key: str = "id") -> DataFrame:
    """The selection of everything."""
    return parsed.select(key).distinct()


def cleared(chosen: DataFrame) -> DataFrame:
    """The empty selection."""
    return chosen.limit(0)


def toggled(chosen: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Symmetric difference."""
    both = chosen.select(key).distinct().withColumn("_s", F.lit(1)).unionByName(keys.select(key).distinct().withColumn("_s", F.lit(2)))
    return both.groupBy(key).agg(F.count("*").alias("_n")).filter("_n = 1").select(key)


def rejected(parsed: DataFrame, chosen: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Parsed events and selection without these keys."""
    gone = keys.select(key)
    return parsed.join(gone, key, "left_anti"), chosen.join(gone, key, "left_anti")


def selection_counts(parsed: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """(selected, total, all_selected)."""
    marked = parsed.join(chosen.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    return marked.agg(
        F.count("_c").alias("selected"), F.count("*").alias("total"), F.coalesce(F.bool_and(F.col("_c").isNotNull()), F.lit(False)).alias("all_selected")
    )
