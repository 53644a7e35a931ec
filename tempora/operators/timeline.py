"""Sorting, grouping by year and paging of events; overlays and their year ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import sort_date, sort_date_or_epoch, year_text
from ..functions.text import trimmed
from . import intervals
from .ranks import ranked, ranked_by_ranges

PAGE = 3

# What is shown as the origin of an overlay.
ATTRIBUTIONS = {"allmaps": "Map georeferenced with Allmaps", "ohm": "© OpenHistoricalMap contributors", "usgs": "USGS The National Map", "nypl": "NYPL Map Warper", "custom": ""}


def chronological(rows: DataFrame, by: list[str], order: str, rank: str = "rank") -> DataFrame:
    """Rows with their rank by date within ``by``; dates that are none come last, ties keep their order."""
    return ranked(rows, by, [sort_date(F.col("date")).asc_nulls_last(), F.col(order)], rank).withColumn(rank, F.col(rank).cast("int"))


def chronological_epoch(rows: DataFrame, by: list[str], order: str, rank: str = "rank") -> DataFrame:
    """The same, dates that are none standing at 1970."""
    return ranked(rows, by, [sort_date_or_epoch(F.col("date")).asc(), F.col(order)], rank).withColumn(rank, F.col(rank).cast("int"))


def by_year(rows: DataFrame, location: str, order: str, value: str) -> DataFrame:
    """(location, year, n, values): the events of each location and year text, in their order."""
    return (
        rows.groupBy(location, year_text(F.col("date")).alias("year"))
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("v"))
        .withColumn("values", F.transform("v", lambda x: x["v"]))
        .drop("v")
    )


def years_of(rows: DataFrame, location: str) -> DataFrame:
    """(location, year, year_rank): the different year texts, ranked as texts."""
    years = rows.select(location, year_text(F.col("date")).alias("year")).distinct()
    return years.withColumn("year_rank", F.row_number().over(Window.partitionBy(location).orderBy("year")))


def active_year(rows: DataFrame, location: str) -> DataFrame:
    """(location, year): the first year text."""
    return rows.groupBy(location).agg(F.min(year_text(F.col("date"))).alias("year"))


def paginated(rows: DataFrame, location: str, order: str, size: int = PAGE) -> DataFrame:
    """Rows with year, page (from 0) within location and year, whether there is a page before and behind, and whether
    a pager is shown, which one page needs not."""
    rows = rows.withColumn("year", year_text(F.col("date")))
    placed = ranked(rows, [location, "year"], [sort_date(F.col("date")).asc_nulls_last(), F.col(order)], "_n", "_rows")
    out = placed.withColumn("page", F.floor((F.col("_n") - 1) / size).cast("int")).withColumn("pages", F.ceil(F.col("_rows") / size).cast("int")).drop("_n", "_rows")
    return out.withColumn("has_previous", F.col("page") > 0).withColumn("has_next", F.col("page") < F.col("pages") - 1).withColumn("pager_shown", F.col("pages") > 1)


def year_tabs(rows: DataFrame, location: str) -> DataFrame:
    """(location, years, tabs_shown): tabs of years are shown where there is more than one year."""
    years = rows.groupBy(location).agg(F.count_distinct(year_text(F.col("date"))).alias("years"))
    return years.withColumn("tabs_shown", F.col("years") > 1)


def shown_tags(tags: Column, most: int = 2) -> Column:
    return F.slice(tags, 1, most)


def total_events(locations: DataFrame) -> DataFrame:
    return locations.agg(F.coalesce(F.sum(F.size("events")), F.lit(0)).alias("total"))


def overlays_in_year(overlays: DataFrame, year: int) -> DataFrame:
    return overlays.filter(F.lit(year).between(F.col("year_from"), F.col("year_to")))


def overlays_overlapping(overlays: DataFrame, low: int, high: int) -> DataFrame:
    return overlays.filter((F.col("year_to") >= low) & (F.col("year_from") <= high))


def overlay_bounds(overlays: DataFrame) -> DataFrame:
    """Null for no overlays."""
    return overlays.agg(F.min("year_from").alias("min_year"), F.max("year_to").alias("max_year"))


def enabled_count(overlays: DataFrame) -> DataFrame:
    return overlays.agg(F.count_if("enabled").alias("enabled"))


def ranked_overlays(overlays: DataFrame, order: str = "id") -> DataFrame:
    """Overlays with their place by zIndex, which counts as 0 where it is missing."""
    return ranked_by_ranges(overlays, [], [F.coalesce("zIndex", F.lit(0)).asc(), F.col(order)], "rank")


def in_overlay_years(events: DataFrame, overlays: DataFrame, year: str = "year") -> DataFrame:
    """Every event with every overlay in whose years it lies."""
    return intervals.pairs_within(events, year, overlays, "year_from", "year_to")


def overlays_overlapping_each(ranges: DataFrame, overlays: DataFrame) -> DataFrame:
    """Every range (lo, hi) with every overlay it overlaps."""
    return intervals.overlapping_pairs(ranges, "lo", "hi", overlays, "year_from", "year_to")


def counted_in_overlay_years(events: DataFrame, overlays: DataFrame, year: str = "year") -> DataFrame:
    """(id, n): for each overlay the events in its years; overlays without events are not listed."""
    return intervals.counted_within(events, year, overlays, "year_from", "year_to").filter("n > 0").select("id", "n")


def overlapping_counts(ranges: DataFrame, overlays: DataFrame) -> DataFrame:
    """``ranges`` (lo, hi) with ``n``, the overlays that each overlaps; those without are not listed."""
    return intervals.counted_overlaps(ranges, "lo", "hi", overlays, "year_from", "year_to").filter("n > 0")


def attribution(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ATTRIBUTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(""))


def valid_annotation_url(url: Column) -> Column:
    host, scheme = F.try_parse_url(url, F.lit("HOST")), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    ok = F.contains(host, F.lit("allmaps.org")) | F.contains(host, F.lit("iiif.io")) | (scheme == "https")
    return F.coalesce(host.isNotNull() & ok, F.lit(False))


def web_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def new_overlay(rows: DataFrame) -> DataFrame:
    """(id, name, url, source) as overlays with defaults; blank names and addresses are refused."""
    name, url = trimmed(F.col("name")), trimmed(F.col("url"))
    annotated = F.col("source") == "allmaps"
    return rows.filter((name != "") & (url != "")).select(
        "id", name.alias("name"), F.lit(None).cast("string").alias("description"), F.lit(1800).alias("year_from"), F.lit(2000).alias("year_to"), "source",
        F.when(~annotated, url).alias("tileUrl"), F.when(annotated, url).alias("annotationUrl"), F.lit(0.7).alias("opacity"), attribution(F.col("source")).alias("attribution"),
        F.lit(True).alias("enabled"), F.lit(None).cast("int").alias("zIndex"),
    )


def added(overlays: DataFrame, new: DataFrame) -> DataFrame:
    """Overlays with new ones behind them; ``edits.deleted`` takes one away."""
    return overlays.unionByName(new, allowMissingColumns=True)


def toggled(overlays: DataFrame, id: str) -> DataFrame:
    return overlays.withColumn("enabled", F.when(F.col("id") == id, ~F.col("enabled")).otherwise(F.col("enabled")))


def with_opacity(overlays: DataFrame, id: str, opacity: float) -> DataFrame:
    return overlays.withColumn("opacity", F.when(F.col("id") == id, F.lit(opacity)).otherwise(F.col("opacity")))


def reordered(rows: DataFrame, source: int, target: int, place: str = "place") -> DataFrame:
    """The row at place ``source`` moved to ``target``; zIndex is the new place plus one. All rows are ranked."""
    p = F.col(place)
    moved = (
        F.when(p == source, F.lit(target))
        .when((p > source) & (p <= target), p - 1)
        .when((p < source) & (p >= target), p + 1)
        .otherwise(p)
    )
    return rows.withColumn(place, moved).withColumn("zIndex", F.col(place) + 1)
