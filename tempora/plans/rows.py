"""The parsers for one text at a time, for batches of Arrow and for table functions.

An event is (title, description, date, confidence, sourceText).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date as Date
from functools import cache, lru_cache

from ..functions.dates import MONTHS, SHORT, dates_in
from ..functions.text import NO_TITLE, PY_WHITE, SPACES, sentences_in

LEAST_CONFIDENCE = 0.5
Event = tuple[str, str, str, float, str]

_WORDS = re.compile(f"{PY_WHITE}+")
_FRONT, _BACK = re.compile(rf"^[,\-:]+{PY_WHITE}*"), re.compile(rf"[,\-:]+{PY_WHITE}*\Z")
_DAY = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", re.ASCII)
_EPOCH = Date(1970, 1, 1).toordinal()


def title_in(sentence: str, raw_date: str) -> str:
    """Eight words of the sentence without its date, tidied, of at most 60 characters."""
    before, _, behind = sentence.partition(raw_date)
    line = " ".join(_WORDS.split((before + behind).strip(SPACES))[:8])
    line = _BACK.sub("", _FRONT.sub("", line))
    line = line[:1].upper() + line[1:]
    return (line[:57] + "..." if len(line) > 60 else line) or NO_TITLE


@lru_cache(1 << 16)
def day_of(date: str) -> int:
    """The day that a date stands for, missing parts being the first and days that a month lacks rolling over; that of
    1970 for other texts. The calendar repeats after 400 years, so year 0 has days, too."""
    m = _DAY.fullmatch(date)
    year, month, day = (int(x or 1) for x in m.groups()) if m else (0, 0, 0)
    if not (1 <= month <= 12 and 1 <= day <= 31):
        return _EPOCH
    return Date(year % 400 + 400, month, 1).toordinal() + day - 1 + (year // 400 - 1) * 146_097


def ranked(events: list[Event]) -> list[tuple[int, int, Event]]:
    """(rank, place, event) by day; ties keep their order."""
    order = sorted(range(len(events)), key=lambda i: day_of(events[i][2]))
    return [(rank, i, events[i]) for rank, i in enumerate(order)]


def sentence_events(text: str) -> list[Event]:
    """One event for each sentence with a date that is sure enough; the sentence is its description."""
    found = [x for x in dates_in(text) if x[4] >= LEAST_CONFIDENCE]
    seen, out = set(), []
    for (_, _, raw, normalized, confidence), sentence in zip(found, sentences_in(text, [x[0] for x in found])):
        if sentence[:100] not in seen:
            seen.add(sentence[:100])
            out.append((title_in(sentence, raw), sentence, normalized, confidence, sentence))
    return out


@cache
def _shapes() -> dict[str, re.Pattern]:
    white = f"{PY_WHITE}*"
    block = rf"EVENT:{white}(.+?)(?:\n|\r\n?)DATE:{white}(.+?)(?:\n|\r\n?)(?:DESCRIPTION:{white})?(.+?)(?=(?:\n{white}\n|EVENT:|\Z))"
    return {
        "block": re.compile(block, re.ASCII | re.IGNORECASE | re.DOTALL),
        "named": re.compile(rf"(\w+)\.?{PY_WHITE}+(\d{{1,2}}),?{PY_WHITE}+(\d{{4}})", re.ASCII),
        "slashed": re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})", re.ASCII),
        "iso": re.compile(r"\d{4}(-\d{2}-\d{2})?", re.ASCII),
    }


@lru_cache(1 << 16)
def iso_of(text: str) -> str | None:
    """ISO form of a text that is one date, by shape alone; None for others."""
    shapes = _shapes()
    if shapes["iso"].fullmatch(text):
        return text
    if m := shapes["named"].fullmatch(text):
        name, day, year = m.groups()
        names = [x.lower() for x in (SHORT if text[len(name)] == "." else MONTHS + SHORT)]
        if name.lower() in names:
            return f"{year}-{names.index(name.lower()) % 12 + 1:02d}-{day:>02}"
    if m := shapes["slashed"].fullmatch(text):
        return f"{m[3]}-{m[1]:>02}-{m[2]:>02}"
    return None


def field_events(text: str) -> list[Event]:
    """Events of blocks of lines with keys, then of single lines whose title has not been seen."""
    blocks, lines = [], []

    def keep(out: list, title: str, date: str, description: str, source: str) -> None:
        if title and (day := iso_of(date)) is not None:
            out.append((title, description or title, day, 1.0, source))

    if re.search(r"[\n\r]DATE:", text, re.IGNORECASE):
        for m in _shapes()["block"].finditer(text):
            keep(blocks, *(x.strip(SPACES) for x in (*m.groups(), m.group())))
    for line in text.split("\n"):
        if "EVENT:" in line and "DATE:" in line:
            parts, own = [x.strip(SPACES) for x in line.split("|")], {}
            for part in parts:
                key, mark, value = part.partition(":")
                if mark:
                    own[key.lower()] = value.strip(SPACES)
            keep(lines, *(own.get(k, "") for k in ("event", "date", "description")), line.strip(SPACES))
    seen = {e[0] for e in blocks}
    for event in lines:
        if event[0] not in seen:
            seen.add(event[0])
            blocks.append(event)
    return blocks


#: Parsers of one text, by the names under which tables of texts are parsed, too.
PARSERS: dict[str, Callable[[str], list[Event]]] = {"regex": sentence_events, "structured": field_events}
