"""Numbers of maps and timelines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, trimmed

EARTH_RADIUS = 6378137.0
#: Northing of the edge of the square map.
EDGE = math.pi * EARTH_RADIUS


def rounded(x: Column) -> Column:
    """Half goes up."""
    return F.floor(x + 0.5)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS


def mercator_y(lat: Column) -> Column:
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS
    return F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), y))


def parse_coordinates(text: Column) -> Column:
    """(lat, lng) of a text like ``41.6, -112.5``; null unless both are within bounds."""
    shape = rf"^(-?\d+\.?\d*)(?:,|{WHITE})+(-?\d+\.?\d*)\z"
    clean = trimmed(text)
    lat, lng = (F.regexp_extract(clean, shape, i).try_cast("double") for i in (1, 2))
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, rounded(done * 100 / total)).otherwise(F.lit(0)).cast("long")


def year_at(share: Column, low: int, high: int) -> Column:
    """The year at a share of the slider's length."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return rounded(F.lit(low) + held * (high - low)).cast("int")


def share_of(year: Column, low: int, high: int) -> Column:
    return (year - low) * 100.0 / (high - low) if high != low else F.lit(0.0)


def moved_low(year: Column, high: Column, least: int) -> Column:
    """Where the lower thumb goes: at least one year below the upper."""
    return F.greatest(F.lit(least), F.least(year, high - 1))


def moved_high(year: Column, low: Column, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(year, low + 1))


def nearest_thumb(year: Column, low: Column, high: Column) -> Column:
    return F.when(F.abs(year - low) <= F.abs(year - high), "low").otherwise("high")


def decade_ticks(low: Column, high: Column) -> Column:
    """Years divisible by ten in the range; every second one if there are more than eight."""
    first = (F.ceil(low / 10) * 10).cast("int")
    ticks = F.when(first > high, F.array().cast("array<int>")).otherwise(F.sequence(first, high.cast("int"), F.lit(10)))
    return F.when(F.size(ticks) > 8, F.filter(ticks, lambda x, i: i % 2 == 0)).otherwise(ticks)


def preset_of(year: Column) -> Column:
    """The named range of a year."""
    return F.when(year < 1850, "Pre-1850").when(year <= 1920, "1850-1920").otherwise("Post-1920")
