"""Dates as text with the precision of a year, a month or a day."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WHITE, WHITE

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
SHORT = [m[:3] for m in MONTHS]

_NAMES, _ABBREVIATED = "|".join(MONTHS), "|".join(SHORT)
_NUMBER = {m.lower(): f"{i + 1:02d}" for i, m in enumerate(SHORT)}

# Fixed values: (pattern, confidence, order of the parts in its groups). Where two match at one place the first counts.
PATTERNS = [
    (r"(\d{4})-(\d{2})-(\d{2})", 1.0, "ymd"),
    (rf"(?i)({_NAMES}){PY_WHITE}+(\d{{1,2}}),?{PY_WHITE}+(\d{{4}})", 0.95, "Mdy"),
    (rf"(?i)({_ABBREVIATED})\.?{PY_WHITE}+(\d{{1,2}}),?{PY_WHITE}+(\d{{4}})", 0.9, "Mdy"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", 0.85, "mdy"),
    (r"(\d{1,2})[-.](\d{1,2})[-.](\d{4})", 0.8, "dmy"),
    (rf"(?i)({_NAMES}){PY_WHITE}+(\d{{4}})", 0.7, "My"),
    (rf"(?i)(?:in|during|around|circa|c\.){PY_WHITE}+(\d{{4}})", 0.5, "y"),
    (r"(?<![A-Za-z0-9_])(1[0-9]{3}|20[0-2][0-9])(?![A-Za-z0-9_])", 0.3, "y"),
]


def month_number(name: Column) -> Column:
    """Two digits for an English month's name or its first three letters; null for other text."""
    table = F.create_map(*[F.lit(x) for pair in _NUMBER.items() for x in pair])
    return F.try_element_at(table, F.lower(F.substring(name, 1, 3)))


MATCH = "index int, priority int, raw string, normalized string, confidence double"
_MATCH = pa.struct([("index", pa.int32()), ("priority", pa.int32()), ("raw", pa.string()), ("normalized", pa.string()), ("confidence", pa.float64())])


@cache
def _places(parts: str) -> list[tuple[int, str]]:
    """(group, kind) of year, month and day, in this order."""
    return [(parts.lower().index(x), parts[parts.lower().index(x)]) for x in "ymd" if x in parts.lower()]


def _iso(groups: tuple[str, ...], parts: str) -> str:
    """Year, month and day of a match, padded and joined by hyphens."""
    return "-".join([groups[i] if kind == "y" else _NUMBER[groups[i][:3].lower()] if kind == "M" else groups[i].rjust(2, "0") for i, kind in _places(parts)])


@cache
def _compiled() -> list[tuple[re.Pattern, re.Pattern | None]]:
    """Every pattern, and one that every text has in which it matches, if that is quicker to look for."""
    month = re.compile("|".join(SHORT), re.I)
    hints = [re.compile("-"), month, month, re.compile("/"), re.compile("[-.]"), month, None, None]
    return [(re.compile(pattern, re.ASCII), hint) for (pattern, _, _), hint in zip(PATTERNS, hints)]


_YEAR = re.compile(r"\d{4}", re.ASCII)


def dates_in(text: str) -> list[tuple[int, int, str, str, float]]:
    """(index, priority, raw, normalized, confidence) by place: of the patterns that match at a place the first.

    All dates have a year of four digits, and most texts have few of those: a scan for them, and one for each mark that
    the patterns need, leave few patterns to look for.
    """
    if not _YEAR.search(text):
        return []
    found: dict[int, tuple] = {}
    has: dict[re.Pattern, bool] = {}
    for n, ((pattern, hint), (_, confidence, parts)) in enumerate(zip(_compiled(), PATTERNS)):
        if hint is not None:
            if hint not in has:
                has[hint] = hint.search(text) is not None
            if not has[hint]:
                continue
        for m in pattern.finditer(text):
            at = m.start()
            if at not in found:
                found[at] = (at, n, m.group(), _iso(m.groups(), parts), confidence)
    return [found[at] for at in sorted(found)]


def date_matches(text: Column) -> Column:
    """Dates in a text by place: array of (index, priority, raw, normalized, confidence), one for each place.

    By batches in Python: regular expressions of Spark SQL do not tell where they match, and to add up the lengths of
    what lies between costs the square of the number of matches. Null has none.
    """

    @F.arrow_udf(f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>")
    def run(texts: pa.Array) -> pa.Array:
        ends, columns = [0], ([], [], [], [], [])
        for x in texts.to_pylist():
            for row in dates_in(x) if x else ():
                for column, value in zip(columns, row):
                    column.append(value)
            ends.append(len(columns[0]))
        made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCH)], fields=list(_MATCH))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    return run(text)


def parse_to_iso(text: Column) -> Column:
    """ISO form of a text that is one date, by shape alone; null for others."""
    grab = lambda p, i: F.regexp_extract(text, p, i)
    named = rf"^([A-Za-z0-9_]+){WHITE}+(\d{{1,2}}),?{WHITE}+(\d{{4}})\z"
    short = rf"^([A-Za-z0-9_]{{3}})\.?{WHITE}+(\d{{1,2}}),?{WHITE}+(\d{{4}})\z"
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
    dated = lambda p, month: F.concat_ws("-", grab(p, 3), month, F.lpad(grab(p, 2), 2, "0"))
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z") | text.rlike(r"^\d{4}\z"), text)
        .when(text.rlike(named) & F.lower(grab(named, 1)).isin([m.lower() for m in MONTHS]), dated(named, month_number(grab(named, 1))))
        .when(text.rlike(short) & F.lower(grab(short, 1)).isin([m.lower() for m in SHORT]), dated(short, month_number(grab(short, 1))))
        .when(text.rlike(slashed), F.concat_ws("-", grab(slashed, 3), F.lpad(grab(slashed, 1), 2, "0"), F.lpad(grab(slashed, 2), 2, "0")))
    )


def year_text(date: Column) -> Column:
    """What stands before the first hyphen."""
    return F.split_part(date, F.lit("-"), F.lit(1))


def timeline_year(date: Column) -> Column:
    """The year for timelines and groups: the integer in front, null if there is none."""
    return F.regexp_extract(year_text(date), r"^\s*([+-]?\d+)", 1).try_cast("int")


def sort_date(date: Column) -> Column:
    """The day a date stands for, missing parts being the first; days 29 to 31 roll over. Null for other text."""
    shape = r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?\z"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(date, shape, i), F.lit("")), F.lit("01"))
    first = F.concat_ws("-", F.regexp_extract(date, shape, 1), part(2), F.lit("01")).try_cast("date")
    day = part(3).try_cast("int")
    return F.when(date.rlike(shape) & day.between(1, 31), F.date_add(first, day - 1))


def search_year(date: Column) -> Column:
    """The year for searches: that of ``sort_date``."""
    return F.year(sort_date(date))


def sort_date_or_epoch(date: Column) -> Column:
    return F.coalesce(sort_date(date), F.lit("1970-01-01").cast("date"))


def _formatted(date: Column, names: list[str], with_day: bool) -> Column:
    parts = F.split(date, "-", -1)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    number = F.regexp_extract(part(1), r"^\s*([+-]?\d+)", 1).try_cast("int")
    month = F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), number - 1), part(1))
    day = F.regexp_extract(part(2), r"^\s*([+-]?\d+)", 1).try_cast("int")
    shown = F.concat_ws(" ", month, part(0))
    if with_day:
        full = F.concat(month, F.lit(" "), F.coalesce(day.cast("string"), F.lit("NaN")), F.lit(", "), part(0))
        shown = F.when(part(2) == "", shown).otherwise(full)
    return F.when(part(0) == "", date).when(part(1) == "", part(0)).otherwise(shown)


def format_date(date: Column) -> Column:
    """``May 10, 1869``, ``May 1869`` or ``1869``; a month that is none stays as it is."""
    return _formatted(date, MONTHS, True)


def format_date_short(date: Column) -> Column:
    return _formatted(date, SHORT, False)
