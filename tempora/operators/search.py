"""Search, unnesting and joins over locations with events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import search_year, timeline_year
from ..functions.text import contains_text


def matches_keyword(query: str, title: Column, description: Column, name: Column) -> Column:
    if query == "":
        return F.lit(True)
    return contains_text(title, query) | contains_text(description, query) | contains_text(name, query)


def within_years(date: Column, low: int | None, high: int | None) -> Column:
    """Inclusive bounds, each optional. Dates without a year pass."""
    if low is None and high is None:
        return F.lit(True)
    year, ok = search_year(date), F.lit(True)
    if low is not None:
        ok = ok & (year >= low)
    if high is not None:
        ok = ok & (year <= high)
    return year.isNull() | ok


def unnested(locations: DataFrame) -> DataFrame:
    """One row for each event with its location; locations without events vanish."""
    return locations.select("loc_ord", F.col("id").alias("location_id"), "name", "coordinates", F.posexplode("events").alias("evt_ord", "event"))


def search_events(locations: DataFrame, query: str = "", low: int | None = None, high: int | None = None) -> DataFrame:
    """(loc_ord, location_id, name, coordinates, evt_ord, event) in document order.

    The arrays are filtered before they are unnested: Spark does not push filters on elements below an explode.
    """
    keep = lambda e: matches_keyword(query, e["title"], e["description"], F.col("name")) & within_years(e["date"], low, high)
    numbered = F.transform("events", lambda e, i: F.struct(i.alias("evt_ord"), e.alias("event")))
    found = locations.withColumn("_e", F.filter(numbered, lambda x: keep(x["event"]))).filter(F.size("_e") > 0)
    return found.select("loc_ord", F.col("id").alias("location_id"), "name", "coordinates", F.explode("_e").alias("_x")).select(
        "loc_ord", "location_id", "name", "coordinates", "_x.evt_ord", "_x.event"
    )


def search_flat(events: DataFrame, query: str = "", low: int | None = None, high: int | None = None) -> DataFrame:
    """The same over rows (name, title, description, date, ...)."""
    keyword = matches_keyword(query, F.col("title"), F.col("description"), F.col("name"))
    return events.filter(keyword & within_years(F.col("date"), low, high))


def distinct_locations(found: DataFrame) -> DataFrame:
    """The first row of each location id, by document order."""
    first = found.groupBy("location_id").agg(F.min_by(F.struct("loc_ord", "name", "coordinates"), F.struct("loc_ord", "evt_ord")).alias("f"))
    return first.select("f.loc_ord", "location_id", "f.name", "f.coordinates")


def list_locations(locations: DataFrame) -> DataFrame:
    return locations.select("id", "name", "coordinates", F.coalesce(F.size("events"), F.lit(0)).alias("eventCount"))


def in_range(date: Column, low: int, high: int) -> Column:
    """For timelines: dates without a year fail."""
    return F.coalesce(timeline_year(date).between(low, high), F.lit(False))


def visible(locations: DataFrame, low: int, high: int) -> DataFrame:
    """Locations of which any event is in the range."""
    return locations.filter(F.exists("events", lambda e: in_range(e["date"], low, high)))


def with_events_in(locations: DataFrame, low: int, high: int) -> DataFrame:
    """All locations, each with its events in the range."""
    return locations.withColumn("events", F.filter("events", lambda e: in_range(e["date"], low, high)))


def find_location(locations: DataFrame, *, id: str | None = None, name: str | None = None) -> DataFrame:
    """The first location with this id or exact name."""
    own = locations.filter(F.col("id") == id) if id is not None else locations.filter(F.col("name") == name)
    return own.orderBy("loc_ord").limit(1)


def selected(parsed: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key was chosen."""
    return parsed.join(chosen.select(key), key, "left_semi")


def marked(events: DataFrame, acknowledged: DataFrame, key: str = "event_id") -> DataFrame:
    """All rows with ``acknowledged``: whether their key is among the acknowledged."""
    known = acknowledged.select(key).distinct().withColumn("_a", F.lit(True))
    return events.join(known, key, "left").withColumn("acknowledged", F.coalesce("_a", F.lit(False))).drop("_a")


def parsed_as_events(parsed: DataFrame) -> DataFrame:
    """Parsed events in the form of a location's events: the source is the text, the confidence goes."""
    return parsed.select("id", "title", "description", "date", F.lit(None).cast("string").alias("imageUrl"), F.lit(None).cast("array<string>").alias("tags"), F.col("sourceText").alias("source"))


def map_points(locations: DataFrame) -> DataFrame:
    """(id, lon, lat, x, y) of every location."""
    from ..functions.numbers import mercator_x, mercator_y

    lon, lat = F.get("coordinates", F.lit(0)), F.get("coordinates", F.lit(1))
    return locations.select("id", lon.alias("lon"), lat.alias("lat"), mercator_x(lon).alias("x"), mercator_y(lat).alias("y"))
