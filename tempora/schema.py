"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "description", "date", "imageUrl")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())]
)
LOCATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.DoubleType())),
        T.StructField("events", T.ArrayType(EVENT)),
    ]
)
DOCUMENT = T.StructType(
    [T.StructField("version", T.StringType()), T.StructField("lastUpdated", T.StringType()), T.StructField("locations", T.ArrayType(LOCATION))]
)
#: Locations as rows, with their place in the document.
LOCATIONS = T.StructType([T.StructField("loc_ord", T.IntegerType()), *LOCATION.fields])
OVERLAY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("year_from", T.IntegerType()),
        T.StructField("year_to", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("tileUrl", T.StringType()),
        T.StructField("annotationUrl", T.StringType()),
        T.StructField("opacity", T.DoubleType()),
        T.StructField("attribution", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("zIndex", T.IntegerType()),
    ]
)
GEOJSON = "type string, features array<struct<type:string, properties:struct<name:string>, geometry:struct<type:string, coordinates:array<double>>>>"
