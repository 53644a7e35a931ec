"""The tools of the library over one stored document of locations."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import location_id, stable_id
from ..operators import edits, search
from ..schema import EVENT, LOCATION, LOCATIONS
from ..sources import documents
from . import extract

_engine: Engine | None = None


class Engine:
    """``path`` names the stored document. Every edit reads it, changes it and writes it anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def locations(self) -> DataFrame:
        return documents.read_locations(self.spark, self.path)

    def _store(self, rows: DataFrame) -> None:
        documents.write_document(rows, self.path)  # ``rows`` may read the old document, which stays until the new one is whole

    def _free(self, id_of: Callable[[Column], Column], ids: DataFrame) -> str:
        """The first id that ``ids`` (id) lacks, of those that ``id_of`` makes from the numbers 0, 1, 2 and so on."""
        n = 0
        while True:
            asked = self.spark.range(n, n + 16, numPartitions=1).select("id", id_of(F.col("id")).alias("made"))
            free = asked.join(ids.select(F.col("id").alias("made")), "made", "left_anti").orderBy("id").first()
            if free is not None:
                return free["made"]
            n += 16

    def show_map(self, query: str | None = None, filter_year: int | None = None, location_id: str | None = None) -> DataFrame:
        """Locations with an event that matches; year and id are passed on for whoever draws the map."""
        found = search.distinct_locations(search.search_events(self.locations(), query)) if query else self.locations().select("loc_ord", F.col("id").alias("location_id"), "name", "coordinates")
        return found.withColumn("filter_year", F.lit(filter_year).cast("int")).withColumn("focus_id", F.lit(location_id).cast("string"))

    def search_events(self, query: str, from_year: int | None = None, to_year: int | None = None) -> DataFrame:
        return search.search_events(self.locations(), query, from_year, to_year)

    def list_locations(self) -> DataFrame:
        return search.list_locations(self.locations())

    def get_location(self, id: str) -> DataFrame:
        return search.find_location(self.locations(), id=id)

    def upsert_location(self, rows: DataFrame) -> None:
        self._store(edits.upserted(self.locations(), rows))

    def create_location_with_events(self, name: str, coordinates: list[float], events: list[tuple], millis: int | None = None) -> str:
        """Store a new location and all its events in one edit; its id, which no other has: from name, coordinates, the
        clock ``millis`` if it is given, and a number that sets it apart."""
        rows, place = self.locations(), F.lit(",".join(map(str, coordinates)))
        clock = [] if millis is None else [F.lit(millis)]
        id = self._free(lambda n: stable_id("location", F.lit(name), place, *clock, n), rows)
        made = documents.new_location(self.spark.createDataFrame([(id, name, coordinates, events)], LOCATION))
        if made.isEmpty():
            raise ValueError("a location needs a name and coordinates")
        self._store(edits.upserted(rows, made.withColumn("loc_ord", F.lit(0)).select(*LOCATIONS.names)))
        return id

    def delete_location(self, id: str) -> bool:
        """Whether there was such a location; nothing is written if not."""
        rows = self.locations()
        if rows.filter(F.col("id") == id).isEmpty():
            return False
        self._store(edits.deleted(rows, id))
        return True

    def add_events(self, id: str, events: list[tuple]) -> bool:
        """Add events whose ids the location lacks; False if there is no such location."""
        rows = self.locations()
        if rows.filter(F.col("id") == id).isEmpty():
            return False
        made = self.spark.createDataFrame([(id, i, e) for i, e in enumerate(events)], "location_id string, ord int, event " + EVENT.simpleString())
        self._store(edits.events_added(rows, made))
        return True

    def add_event(self, location_name: str, latitude: float, longitude: float, title: str, date: str, description: str, source: str | None = None, millis: int | None = None) -> str:
        """Find the location by its exact name, or create it, and add one event in the same edit; the event's id, which
        its location has for no other. ``millis`` is the clock in a new location's id, now if it is not given."""
        rows = self.locations()
        found = search.find_location(rows, name=location_name).select("id").first()
        if found is None:
            clock = int(time.time() * 1000) if millis is None else millis
            id = self._free(lambda n: location_id(F.lit(location_name), n + clock), rows)
            rows = edits.upserted(rows, self.spark.createDataFrame([(0, id, location_name, [longitude, latitude], [])], LOCATIONS))
        else:
            id = found["id"]
        known = rows.filter(F.col("id") == id).select(F.explode("events").alias("e")).select(F.col("e.id").alias("id"))
        event_id = self._free(lambda n: stable_id("event", F.lit(id), F.lit(title), F.lit(date), F.lit(description), n), known)
        made = self.spark.createDataFrame([(id, 0, (event_id, title, description, date, None, None, source))], "location_id string, ord int, event " + EVENT.simpleString())
        self._store(edits.events_added(rows, made))
        return event_id

    def parse(self, docs: DataFrame, strategy: str = "regex") -> DataFrame:
        """Events of the texts that are neither missing nor too long."""
        return extract.parse_documents(documents.checked_texts(docs).filter("error is null").drop("error"), strategy)


def get_engine(spark: SparkSession, path: str) -> Engine:
    global _engine
    if _engine is None or _engine.spark is not spark or _engine.path != path:
        _engine = Engine(spark, path)
    return _engine


def reset_engine() -> None:
    global _engine
    _engine = None
