"""Scans and sinks: JSON documents of locations, text, PDF and GeoJSON files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, pages_cleaned, stable_id, trimmed
from ..schema import DOCUMENT, GEOJSON, LOCATION, LOCATIONS, OVERLAY
from .document_source import VERSION, register

#: Characters of a text above which it is warned about or refused, and bytes of a PDF above which it is refused.
TEXT_LIMIT, PDF_LIMIT = 51_200, 512_000
PRETTY = {"pretty": "true", "ignoreNullFields": "true"}

# The overlays that every map begins with.
DEFAULT_OVERLAYS = [
    ("ohm-historical", "OpenHistoricalMap", "Community-mapped historical roads, railroads, and boundaries", 1850, 1920, "ohm", "https://vtiles.openhistoricalmap.org/maps/osm/{z}/{x}/{y}.pbf", None, 0.7, "© OpenHistoricalMap contributors", False, 1),
    ("usgs-topo-historical", "USGS Historical Topos", "US Geological Survey topographic maps from 1884-2006", 1884, 2006, "usgs", "https://basemap.nationalmap.gov/arcgis/services/USGSImageryTopo/MapServer/WMSServer", None, 0.6, "USGS The National Map", False, 2),
    ("manchester-1820", "Manchester & Salford 1820", "Historical plan of Manchester and Salford, England - demo overlay", 1820, 1850, "allmaps", None, "https://annotations.allmaps.org/maps/0984d3d4501b1b9a", 0.7, "Georeferenced with Allmaps", False, 3),
]


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row (version, lastUpdated, locations). A missing or broken file is an empty document, not an error."""
    empty = spark.createDataFrame([(VERSION, None, [])], DOCUMENT)
    try:
        found = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        found = found.filter(F.col("locations").isNotNull()).limit(1)
        return found if found.count() else empty
    except AnalysisException:
        return empty


def locations(document: DataFrame) -> DataFrame:
    """Locations as rows with their place in the document."""
    return document.select(F.posexplode("locations").alias("loc_ord", "l")).select("loc_ord", "l.*")


def document_of(rows: DataFrame, updated: Column | None = None, version: str = VERSION) -> DataFrame:
    """One document of location rows, in order. The document is one value, as its format asks."""
    return documents_of(rows, [], updated, version)


def documents_of(rows: DataFrame, keys: list[str], updated: Column | None = None, version: str = VERSION) -> DataFrame:
    """One document of the location rows of each key, in order."""
    packed = F.struct("loc_ord", F.struct("id", "name", "coordinates", "events").alias("l"))
    stamp = updated if updated is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    listed = F.transform(F.sort_array(F.collect_list(packed)), lambda x: x["l"])
    return rows.groupBy(*keys).agg(listed.alias("locations")).select(F.lit(version).alias("version"), stamp.alias("lastUpdated"), "locations")


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """The location rows of the document at ``path``, read by shares; none where it is missing or broken."""
    return register(spark).read.format("tempora_document").load(path)


def write_document(rows: DataFrame, path: str, updated: Column | None = None) -> None:
    """Replace the document at ``path`` by location rows: tasks write parts beside it, in order, which are joined and
    renamed over it in one step. So readers see the old or the new one, also if a task fails."""
    spark = register(rows.sparkSession)
    ordered = rows.select(*[F.col(f.name).cast(f.dataType) for f in LOCATIONS]).repartitionByRange("loc_ord").sortWithinPartitions("loc_ord")
    writer = ordered.write.format("tempora_document").mode("overwrite").option("version", VERSION)
    if updated is not None:
        writer = writer.option("updated", spark.range(1).select(updated.cast("string").alias("at")).first()["at"])
    writer.save(path)


def clear_document(spark: SparkSession, path: str) -> None:
    write_document(spark.createDataFrame([], LOCATIONS), path)


def seeded(local: DataFrame, server: DataFrame) -> DataFrame:
    """The local locations, or the server's on a first visit."""
    return local if not local.isEmpty() else server


def export_json(document: DataFrame) -> DataFrame:
    """(json): the document as indented JSON text."""
    return document.select(F.to_json(F.struct(*document.columns), PRETTY).alias("json"))


def import_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """``texts`` with ``valid`` and the parsed ``document``. Valid: a version that is not empty and a list of locations."""
    parsed = texts.withColumn("document", F.from_json(column, DOCUMENT))
    ok = F.coalesce((F.col("document.version") != "") & F.col("document.locations").isNotNull(), F.lit(False))
    return parsed.withColumn("valid", ok).withColumn("document", F.when(ok, F.col("document")))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole ``.txt`` files."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def checked_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``error``: why a text is refused, null if it is not. Text of white space only counts as missing."""
    n = F.length("text")
    return docs.withColumn(
        "error", F.when(blank(trimmed(F.col("text"))), "text is required").when(n > TEXT_LIMIT, F.concat(F.lit("too long: "), n.cast("string")))
    )


def read_pdfs(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text, error, warning) of PDF files. ``pages_of`` extracts the pages of one file's bytes.

    Other kinds and files above ``PDF_LIMIT`` bytes are refused by their names and lengths: a listing without contents
    tells them, so whatever their size no byte of them is read.
    """
    files = spark.read.format("binaryFile").load(path)
    error = F.when(~F.lower("path").endswith(".pdf"), "not a PDF").when(F.col("length") > PDF_LIMIT, "too large")
    refused = files.select("path", error.alias("error")).filter("error IS NOT NULL")
    # Conditions on length and path are pushed to the source, which opens only what passes.
    fit = files.filter((F.col("length") <= PDF_LIMIT) & F.lower("path").endswith(".pdf")).select("path", "content")

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "raw": ["\n\n".join(pages_of(bytes(c))) for c in frame["content"]]})

    raw = fit.mapInPandas(run, "path string, raw string")
    text = pages_cleaned(F.col("raw"))
    none = F.lit(None).cast("string")
    read = raw.select("path", text.alias("text"), none.alias("error"), F.when(F.length(text) > TEXT_LIMIT, "long text").alias("warning"))
    return read.unionByName(refused.select("path", none.alias("text"), "error", none.alias("warning")))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(name, lon, lat) of a GeoJSON collection of points."""
    found = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return found.select(F.col("f.properties.name").alias("name"), F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"))


def default_overlays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_OVERLAYS, OVERLAY)


def place_of(coordinates: Column) -> Column:
    return F.array_join(F.transform(coordinates, lambda x: x.cast("string")), ",")


def new_location(rows: DataFrame, more: list[str] = [], apart: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows with defaults for a missing id and missing events, and columns of ``more``; rows without name or coordinates
    are refused. A default id depends on name and coordinates and on the columns ``apart`` (an ordinal, a clock), which
    tell apart rows that are alike."""
    ok = ~blank(F.col("name")) & F.col("coordinates").isNotNull()
    made = stable_id("location", F.col("name"), place_of(F.col("coordinates")), *map(F.col, apart))
    return rows.filter(ok).select(
        F.coalesce("id", made).alias("id"), "name", "coordinates", F.coalesce("events", F.array().cast(LOCATION["events"].dataType)).alias("events"), *more
    )


def new_event(rows: DataFrame, apart: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows with a default id, to which the columns ``apart`` add; rows without title, date or description are refused."""
    ok = ~(blank(F.col("title")) | blank(F.col("date")) | blank(F.col("description")))
    made = stable_id("event", *[F.col(c) for c in ("title", "date", "description", *apart)])
    return rows.filter(ok).withColumn("id", F.coalesce("id", made))
