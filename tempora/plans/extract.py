"""Events from text. A parser is a function from (doc_id, text) rows to event rows; nothing here is shuffled.

Every document is one row until its events are unnested: a text is parsed in one pass, with de-duplication and order
within it, in batches of Arrow, and no window is needed.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.dates import date_matches
from ..functions.text import stable_id
from . import rows

COLUMNS = ["doc_id", "rank", "id", "title", "description", "date", "confidence", "sourceText"]

RANKED = [StructField(c, {"rank": IntegerType(), "confidence": DoubleType()}.get(c, StringType())) for c in COLUMNS if c not in ("doc_id", "id")]

def find_dates(docs: DataFrame) -> DataFrame:
    """(doc_id, index, raw, normalized, confidence) of every date, one for each place; the surest pattern wins."""
    found = docs.select("doc_id", F.explode(date_matches(F.col("text"))).alias("m"))
    return found.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in ("index", "raw", "normalized", "confidence")])


_FOUND = "array<struct<rank:int,i:int,title:string,description:string,date:string,confidence:double,sourceText:string>>"


def _ranked_events(text: Column, parse: Callable[[str], list[rows.Event]]) -> Column:
    """Events of each text, ranked by date: one pass over it, by batches of Arrow. Null has none."""

    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array) -> pa.Array:
        ends, columns = [0], [[] for _ in range(7)]
        for x in texts.to_pylist():
            for rank, place, event in rows.ranked(parse(x)) if x else ():
                for column, value in zip(columns, (rank, place, *event)):
                    column.append(value)
            ends.append(len(columns[0]))
        names = ["rank", "i", *COLUMNS[3:]]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
        made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    return run(text)


def sentence_events(text: Column) -> Column:
    """Events of the sentences with dates."""
    return _ranked_events(text, rows.sentence_events)


def field_events(text: Column) -> Column:
    """Events of blocks of lines with keys, then of single lines whose title has not been seen."""
    return _ranked_events(text, rows.field_events)


def _unnested(docs: DataFrame, events: Callable[[Column], Column]) -> DataFrame:
    found = docs.select("doc_id", F.inline(events(F.col("text"))))
    made = stable_id("event", *[F.col(c) for c in ("doc_id", "i", "title", "date")])
    return found.select("doc_id", "rank", made.alias("id"), *COLUMNS[3:])


def parse_regex(docs: DataFrame) -> DataFrame:
    """One event for each sentence with a date that is sure enough; the sentence is its description."""
    return _unnested(docs, sentence_events)


def parse_structured(docs: DataFrame) -> DataFrame:
    """Events of blocks, then of single lines whose title has not been seen."""
    return _unnested(docs, field_events)


Parser = Callable[[DataFrame], DataFrame]

PARSERS: dict[str, tuple[str, Parser]] = {
    "regex": ("Events from the sentences around dates", parse_regex),
    "structured": ("Events from EVENT:, DATE: and DESCRIPTION: fields", parse_structured),
}


def register_parser(name: str, description: str, parser: Parser, of_text: Callable[[str], list[rows.Event]] | None = None) -> None:
    """``of_text`` parses one text for ``parse_events`` in SQL, where ``parser`` cannot go."""
    PARSERS[name] = (description, parser)
    if of_text is not None:
        rows.PARSERS[name] = of_text


def get_parser(strategy: str) -> Parser | None:
    return PARSERS[strategy][1] if strategy in PARSERS else None


def is_valid_strategy(strategy: str) -> bool:
    return strategy in PARSERS


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d) for n, (d, _) in PARSERS.items()], "name string, description string")


def parse_documents(docs: DataFrame, strategy: str = "regex") -> DataFrame:
    """Events of all documents; an unknown strategy falls back to the first parser."""
    return (get_parser(strategy) or parse_regex)(docs)


class ParseEvents:
    """Table function ``parse_events(text, strategy)``: the events of a text, ranked by date.

    With ``TABLE(...)`` instead of a text, which has a column ``text`` and is best partitioned by a document's key, the
    texts of a partition are parts of one document, in which an event of equal title and description counts once: rows
    have the other columns, of the partition's first row, before the event's. An unknown strategy falls back to the first parser, as it does for tables.
    """

    def __init__(self):
        self.found, self.others = [], None

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable:
            if "text" not in text.dataType.names:
                raise ValueError("the table has no column text")
            return AnalyzeResult(StructType([*(f for f in text.dataType.fields if f.name != "text"), *RANKED]))
        return AnalyzeResult(StructType(RANKED))

    def eval(self, text, strategy):
        parse = rows.PARSERS.get(strategy, rows.sentence_events)
        if isinstance(text, Row):
            if self.others is None:
                self.others = [text[c] for c in text.__fields__ if c != "text"]
            known = {(e[0], e[1]) for e in self.found}
            self.found += [e for e in parse(text["text"] or "") if (e[0], e[1]) not in known]
        else:
            for rank, _, event in rows.ranked(parse(text or "")):
                yield rank, *event

    def terminate(self):
        for rank, _, event in rows.ranked(self.found):
            yield *self.others, rank, *event


def register_functions(spark: SparkSession) -> SparkSession:
    """``spark``, whose SQL then knows ``parse_events`` with the parsers that are registered by now."""
    parsers = dict(rows.PARSERS)

    class Own(ParseEvents):
        def __init__(self):
            super().__init__()
            rows.PARSERS.update(parsers)

    Own.__name__ = "ParseEvents"
    spark.udtf.register("parse_events", udtf(Own))
    return spark
