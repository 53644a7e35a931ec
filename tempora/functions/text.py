"""Text functions as Column expressions. White space is the set that ECMAScript trims, not Java's."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same for Python's regular expressions, and its characters.
PY_WHITE = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", WHITE)
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(PY_WHITE, c))
#: The title of an event whose sentence has nothing but its date.
NO_TITLE = "Historical Event"

# Tags that break lines, by prefix and without a boundary, and entities in the order of decoding.
BREAKING = "p|div|br|h[1-6]|li|tr|td|th|blockquote|article|section|header|footer|nav|aside"
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def contains_text(column: Column, query: str) -> Column:
    """Literal and without regard to case; the empty query is in every text."""
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(query))), F.lit(False))


def blank(column: Column) -> Column:
    """Null or empty: what counts as missing in a required field."""
    return F.coalesce(column, F.lit("")) == ""


def or_default(column: Column, default) -> Column:
    """The default for null and empty text."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def sentences_in(text: str, places: list[int]) -> list[str]:
    stops = [m.start() for m in re.finditer("[.!?]", text)]
    out = []
    for at in places:
        n = bisect_left(stops, at)
        start = stops[n - 1] + 1 if n else 0
        end = stops[n] + 1 if n < len(stops) else len(text)
        whole = text[start:end].strip(SPACES)
        out.append(text[max(at - 100, 0) : at + 200].strip(SPACES) + "..." if len(whole) > 300 else whole)
    return out


def sentences_at(text: Column, places: Column) -> Column:
    """The sentences around places of a text: from behind the last of ``.!?`` before one to the first at or after it.

    Longer than 300 characters, one is the stretch from 100 before to 200 behind its place, with dots. Stops are looked
    for once in a text, by batches in Python: expressions on arrays would scan the text for every place.
    """

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, places: pa.Array) -> pa.Array:
        found = zip(texts.to_pylist(), places.to_pylist())
        return pa.array([None if t is None or p is None else sentences_in(t, p) for t, p in found], pa.list_(pa.string()))

    return run(text, places)


def sentence_at(text: Column, index: Column) -> Column:
    """The sentence around one place."""
    return F.get(sentences_at(text, F.array(index)), F.lit(0))


def title_of(sentence: Column, raw_date: Column) -> Column:
    """Eight words of the sentence without its date, tidied, of at most 60 characters."""
    at = F.position(raw_date, sentence)
    rest = F.concat(F.substring(sentence, F.lit(1), at - 1), F.substring(sentence, at + F.length(raw_date), F.length(sentence)))
    words = F.split(trimmed(F.when(at > 0, rest).otherwise(sentence)), f"{WHITE}+")
    line = F.array_join(F.slice(words, 1, 8), " ")
    line = F.regexp_replace(F.regexp_replace(line, rf"^[,\-:]+{WHITE}*", ""), rf"[,\-:]+{WHITE}*\z", "")
    line = F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.length(line)))
    return or_default(F.when(F.length(line) > 60, F.concat(F.substring(line, 1, 57), F.lit("..."))).otherwise(line), NO_TITLE)


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens; the part of a place's id that comes from its name."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-|-\z", "")


def location_id(name: Column, millis: Column) -> Column:
    """The slug and the last four base-36 digits of a clock that the caller gives."""
    return F.concat(slug(name), F.lit("-"), F.right(F.lower(F.conv(millis.cast("string"), 10, 36)), F.lit(4)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that depends on its parts alone, so that a run can be repeated."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256), 1, 16))


def field_of(parts: Column, key: str) -> Column:
    """The value of the last of ``parts`` that begins with ``key:``, in any case; empty if there is none."""
    own = F.filter(parts, lambda x: F.startswith(F.lower(x), F.lit(f"{key}:")))
    return F.coalesce(trimmed(F.regexp_replace(F.try_element_at(own, F.lit(-1)), f"(?i)^{key}:{WHITE}*", "")), F.lit(""))


def character(code: Column) -> Column:
    """The UTF-16 unit with this number, which is taken modulo 65536."""
    unit = F.try_to_number(code, F.lit("9" * 38)) % 65536
    return F.decode(F.unhex(F.lpad(F.hex(unit.cast("long")), 4, "0")), "UTF-16BE")


def numbered_entities(text: Column) -> Column:
    pattern = r"&#(\d+);"
    pieces, codes = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    glued = F.zip_with(pieces, F.concat(F.transform(codes, character), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.contains(text, F.lit("&#")), F.array_join(glued, "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Readable text of a page: scripts and styles dropped, blocks on lines of their own, entities decoded once each."""
    text = html
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}(?![A-Za-z0-9_]).*?</{tag}>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKING})[^>]*>", "\n")
    text = F.regexp_replace(text, r"</?[^>]+(?:>|\z)", " ")
    for entity, value in ENTITIES:
        text = F.regexp_replace(text, f"(?i){entity}", value)
    text = numbered_entities(text)
    for pattern, value in (("[ \t]+", " "), ("\n[ \t]+", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, value)
    return trimmed(text)


def pages_cleaned(text: Column) -> Column:
    """Text of joined pages: line ends unified, at most one empty line, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n"))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def source_shown(source: Column, description: Column) -> Column:
    """The source of a parsed event where it says more than its description; null elsewhere."""
    return F.when(~source.eqNullSafe(description), source)


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n != 1, "s").otherwise(""))


def client_ip(forwarded: Column, real: Column) -> Column:
    """First address forwarded, else the real one, else the local one; empty counts as missing."""
    return F.coalesce(F.nullif(trimmed(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), F.nullif(real, F.lit("")), F.lit("127.0.0.1"))


def integer_prefix(text: Column) -> Column:
    """The integer at the front of a text, null if there is none."""
    return F.regexp_extract(text, rf"^{WHITE}*([+-]?\d+)", 1).try_cast("int")
