"""The nearest place on the map, by cells along a space-filling curve.

Places lie in square cells of the map that are numbered along a Z-curve, so that a cell's number begins with those of
all cells around it. The search goes down from the whole map, all points at once: of the cells below those that a point
still has, each holds a place no farther than its far corner, so cells whose near edge is farther than the nearest such
corner are left. A cell with one place in it is measured at once and not gone down into; what is left at the finest cells
is measured in the end. Both bounds are exact, and a point keeps few cells however dense or empty its surroundings are.
The cells that a step looks at are many and never shuffled: a task gives each point's smallest bound of its own, and with
the smallest of all the cells are looked at again.

Distances are those of the plane of the map, which is closed at the antimeridian.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import EDGE, mercator_x, mercator_y
from ..sources.shared import stored

#: Halvings of the map's sides down to the finest cells, and how many of them one step takes.
DEPTH, STEP = 24, 3
#: Steps whose cells are so few (64, then 4096) that they are broadcast.
FEW = 2
#: Meters on the map by which bounds may be off, as they are computed in doubles.
SLACK = 1e-3


def _spread(v: Column) -> Column:
    """The bits of a number with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _index(x: Column) -> Column:
    """The number of a coordinate's finest cell along its side."""
    cells = 1 << DEPTH
    return F.least(F.greatest(F.floor((x + EDGE) / (2 * EDGE) * cells), F.lit(0)), F.lit(cells - 1)).cast("long")


def cell(x: Column, y: Column) -> Column:
    """The number of the finest cell of a point of the map."""
    return _spread(_index(x)).bitwiseOR(F.shiftleft(_spread(_index(y)), 1))


def _across(a: Column, b: Column) -> Column:
    """How far two eastings are apart, either way around."""
    apart = F.abs(a - b)
    return F.least(apart, F.lit(2 * EDGE) - apart)


def _on_map(rows: DataFrame, lon: str, lat: str) -> DataFrame:
    known = rows.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))
    east = F.pmod(F.col(lon).cast("double") + 180, F.lit(360.0)) - 180
    # The edges of the square are the map's ends: a latitude beyond them is drawn there.
    y = F.when(F.col(lat) >= 90, F.lit(EDGE)).when(F.col(lat) <= -90, F.lit(-EDGE)).otherwise(mercator_y(F.col(lat).cast("double")))
    return known.withColumns({"_x": mercator_x(east), "_y": y})


def _met(left: DataFrame, cells: DataFrame, half: float) -> DataFrame:
    """Points with the cells below theirs, whose sides are twice ``half``, and within what distances these have places."""
    met = left.join(cells, F.col("at") == F.col("above"))
    across, along = _across(F.col("x"), (F.col("i") * 2 + 1) * half - EDGE), F.abs(F.col("y") - ((F.col("j") * 2 + 1) * half - EDGE))
    near = F.hypot(F.greatest(across - half, F.lit(0.0)), F.greatest(along - half, F.lit(0.0)))
    far = F.hypot(F.least(across + half, F.lit(EDGE)), along + half)
    own = F.hypot(_across(F.col("x"), F.col("_x")), F.col("y") - F.col("_y"))
    return met.withColumns({"near": F.when(F.col("n") == 1, own).otherwise(near), "far": F.when(F.col("n") == 1, own).otherwise(far)})


def nearest(points: DataFrame, places: DataFrame, order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with ``place``, the nearest row of ``places`` as a struct, and ``distance`` to it in meters on the map.

    Of places that are equally near that with the least ``order`` counts. Points without coordinates, and all points if
    there are no places, have null for both.
    """
    at = _on_map(places, lon, lat).groupBy("_x", "_y").agg(F.min_by(F.struct(*places.columns), order).alias("place"))
    at = stored(at.withColumns({"cell": cell(F.col("_x"), F.col("_y")), "i": _index(F.col("_x")), "j": _index(F.col("_y"))}), "places")
    asked = stored(_on_map(points, lon, lat).select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct(), "points")
    # ``reach``: within what distance a point is known to have a place.
    left, alone = asked.withColumns({"at": F.lit(0).cast("long"), "reach": F.lit(float("inf"))}), []
    for step in range(1, DEPTH // STEP + 1):
        down = DEPTH - step * STEP
        cells = at.groupBy(F.shiftright("cell", 2 * down).alias("cell"), F.shiftright("i", down).alias("i"), F.shiftright("j", down).alias("j"))
        cells = cells.agg(F.count("*").alias("n"), F.min("_x").alias("_x"), F.min("_y").alias("_y")).withColumn("above", F.shiftright("cell", 2 * STEP))
        cells = stored(cells, "cells")
        met = _met(left, F.broadcast(cells) if step <= FEW else cells, EDGE / (1 << (step * STEP)))
        reach = met.groupBy("x", "y").agg(F.least(F.min("far"), F.min("reach")).alias("reach"))
        met = _met(left.drop("reach").join(reach, ["x", "y"]), F.broadcast(cells) if step <= FEW else cells, EDGE / (1 << (step * STEP)))
        kept = stored(met.filter(F.col("near") <= F.col("reach") + SLACK).select("x", "y", F.col("cell").alias("at"), "n", "_x", "_y", "near", "reach"), "kept")
        alone.append(kept.filter("n = 1").select("x", "y", "_x", "_y", F.col("near").alias("distance")))
        left = kept.filter("n > 1").select("x", "y", "at", "reach")
        if left.isEmpty():
            break
    measured = functools.reduce(DataFrame.unionByName, alone).join(at.select("_x", "_y", "place"), ["_x", "_y"]).select("x", "y", "place", "distance")
    dense = left.join(at.select("cell", "_x", "_y", "place"), F.col("at") == F.col("cell"))
    measured = measured.unionByName(dense.select("x", "y", "place", F.hypot(_across(F.col("x"), F.col("_x")), F.col("y") - F.col("_y")).alias("distance")))
    by = F.struct("distance", F.col(f"place.{order}"))
    found = measured.groupBy("x", "y").agg(F.min_by("place", by).alias("place"), F.min("distance").alias("distance"))
    names = points.columns
    known = _on_map(points, lon, lat).join(found, (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y")), "left").select(*names, "place", "distance")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields[-2:]]
    missing = points.filter(F.col(lon).isNull() | F.col(lat).isNull() | F.isnan(lon) | F.isnan(lat)).select(*names, *nothing)
    return known.unionByName(missing)


def within(found: DataFrame, meters: float) -> DataFrame:
    """Points of ``nearest`` that hit a place: those not farther from it than ``meters`` on the map."""
    return found.filter(F.col("distance") <= meters)
