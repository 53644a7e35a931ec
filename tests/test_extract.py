import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tempora.functions.dates import parse_to_iso, sort_date_or_epoch
from tempora.functions.text import title_of
from tempora.plans import extract, rows


def parsed(spark, texts, strategy):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in extract.parse_documents(docs, strategy).orderBy("doc_id", "rank").collect():
        out[r.doc_id].append((r.title, r.description, r.date, r.confidence))
    return [out[i] for i in range(len(texts))]


def test_regex(spark):
    got = parsed(spark, ["From May 1, 1850 to May 2, 1860 it ran.", "In 1900 b. On 1899-01-02 a.", "nothing", "", None, "c. 1834"], "regex")
    assert got[0] == [("From to May 2, 1860 it ran.", "From May 1, 1850 to May 2, 1860 it ran.", "1850-05-01", 0.95)]
    assert [x[2] for x in got[1]] == ["1899-01-02", "1900"]
    assert got[2] == got[3] == got[4] == []
    assert got[5] == [("C.", "c.", "1834", 0.5)]


def test_structured(spark):
    got = parsed(
        spark,
        [
            "EVENT: A\nDATE: May 17, 1834\nDESCRIPTION: one",
            "EVENT: A\nDATE: May 1834\nx",
            "EVENT: A | DATE: 1834-05-17",
            "event: A | date: 1834",
            "EVENT: A | DATE: 1834\nEVENT: A | DATE: 1870",
            "EVENT: S | DATE: 1900\nEVENT: B\nDATE: 1901\nDESCRIPTION: d",
            "EVENT: A | DATE: 1/2/1900 | event: B",
            "EVENT: Z\nDATE: 1999\nz\n\nEVENT: Y\nDATE: 13/45/1900\ny",
        ],
        "structured",
    )
    assert got[0] == [("A", "one", "1834-05-17", 1.0)]
    assert got[1] == []
    assert got[2] == [("A", "A", "1834-05-17", 1.0)]
    assert got[3] == []
    assert got[4] == [("A", "A", "1834", 1.0)]
    assert [x[0] for x in got[5]] == ["S", "S | DATE: 1900\nEVENT: B"]
    assert got[6] == [("B", "B", "1900-01-02", 1.0)]
    assert [x[0] for x in got[7]] == ["Y", "Z"]


def test_structured_is_one_pass_over_a_text(spark):
    texts = ["EVENT: Ä\u3000\r\nDATE:\u00a0Sept 5, 1900\r\nDESCRIPTION: d\n\nEVENT: B\nDATE: feb. 31, 1901\nx", "EVENT: İ | DATE: 0000-02-30 | description:  ", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = extract.parse_documents(docs, "structured")
    # Expressions on arrays evaluate a block's fields again for each use; that took most of the time.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "transform(" not in plan
    got = [(r.doc_id, r.rank, r.title, r.description, r.date) for r in found.orderBy("doc_id", "rank").collect()]
    assert got == [(0, 0, "B", "x", "1901-02-31"), (1, 0, "İ", "İ", "0000-02-30")]


def test_unknown_strategy_and_registry(spark):
    docs = spark.createDataFrame([(1, "On 1900-01-02 x.")], "doc_id long, text string")
    assert extract.parse_documents(docs, "other").count() == 1
    assert not extract.is_valid_strategy("other") and extract.get_parser("other") is None
    assert [r.name for r in extract.strategies(spark).collect()][:2] == ["regex", "structured"]


# The patterns of dates, stated anew for an independent check.
MONTHS = "January February March April May June July August September October November December".split()
FULL, ABBREVIATED = "|".join(MONTHS), "|".join(m[:3] for m in MONTHS)
MODEL = [
    (r"\d{4}-\d{2}-\d{2}", 0), (rf"(?:{FULL})\s+\d{{1,2}},?\s+\d{{4}}", re.I), (rf"(?:{ABBREVIATED})\.?\s+\d{{1,2}},?\s+\d{{4}}", re.I), (r"\d{1,2}/\d{1,2}/\d{4}", 0),
    (r"\d{1,2}[-.]\d{1,2}[-.]\d{4}", 0), (rf"(?:{FULL})\s+\d{{4}}", re.I), (r"(?:in|during|around|circa|c\.)\s+\d{4}", re.I), (r"\b(?:1[0-9]{3}|20[0-2][0-9])\b", 0),
]


def model_places(text):
    seen = {}
    for n, (pattern, flags) in enumerate(MODEL):
        for m in re.finditer(pattern, text, flags | re.ASCII):
            seen.setdefault(m.start(), (n, m.group()))
    return sorted((i, raw) for i, (_, raw) in seen.items())


def test_places_against_a_model(spark):
    rng = random.Random(5)
    parts = ["May", "may 5, 1900", "17.5.1834", "1/2/1900", " in 1945", ". ", "Sept. 1, 1834", "1834-05-17", "x", " ", "12", "-", "1999", "c. ", "June 1871", "11834", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in extract.find_dates(docs).collect():
        got.setdefault(r.doc_id, []).append((r["index"], r.raw))
    assert [sorted(got.get(i, [])) for i in range(len(texts))] == [model_places(t) for t in texts]


def test_long_texts_take_time_in_proportion(spark):
    """1 MB with 5,000 dates, in different sentences; and 5,000 records of one line."""
    prose = "".join(f"Item {i} {'x ' * 90}of May {i % 28 + 1}, {1000 + i % 1000} came. " for i in range(5000))
    lines = "".join(f"EVENT: A{i} | DATE: 1834-05-17 | DESCRIPTION: x\n" for i in range(5000))
    docs = spark.createDataFrame([(1, prose), (2, lines)], "doc_id long, text string")
    began = time.time()
    assert extract.parse_documents(docs.filter("doc_id = 1"), "regex").count() == 5000
    assert extract.parse_documents(docs.filter("doc_id = 2"), "structured").count() == 5000
    assert time.time() - began < 60


def mixed_texts():
    rng = random.Random(12)
    bits = ["May 17, 1834", "Sept. 1, 1834", "in 1945", "circa 900", "5/17/1834", "17.5.1834", "1834-05-17", "1834-13-45", "June 1871", "2029", ".", "!", "? ", "\n", ", the ", "—", "a\u00a0b ", "x" * 70, " no date", "Émile ", "- ", ": "]
    out = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(300)]
    lines = ["EVENT: A", "event: b", "DATE: May 17, 1834", "Date: 1834-05-17", "DATE: 5/1/1900", "DATE: May 1834", "DESCRIPTION: one", "more", "", "EVENT: A | DATE: 1834-05-17", "EVENT: C | date: Sept. 3 1900 | DATE: 1900 |Description: d", "EVENT: | DATE: 1900", "\tEVENT: D DATE: x"]
    return out + ["\n".join(rng.choices(lines, k=rng.randrange(1, 9))) for _ in range(300)] + ["", None]


@pytest.mark.parametrize("strategy", ["regex", "structured", "none of them"])
def test_the_table_function_equals_the_parsers_of_tables(spark, strategy):
    docs = spark.createDataFrame(list(enumerate(mixed_texts())), "doc_id long, text string")
    want = extract.parse_documents(docs, strategy).drop("id")
    extract.register_functions(spark)
    got = spark.sql("SELECT doc_id, e.* FROM {docs}, LATERAL parse_events(text, '" + strategy + "') AS e", docs=docs)
    assert got.columns == want.columns
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == rows and len(rows) > 100


def test_the_table_function_takes_partitions_of_a_table(spark):
    texts = [("a", 1, "On 1900-01-02 it rained."), ("a", 2, "On 1850-01-02 it shone."), ("a", 3, "On 1900-01-02 it rained."), ("b", 1, "Nothing."), ("c", 1, None)]
    docs = spark.createDataFrame(texts, "k string, part int, text string")
    extract.register_functions(spark)
    got = spark.sql("SELECT * FROM parse_events(TABLE({docs}) PARTITION BY (k) ORDER BY (part), 'regex')", docs=docs)
    assert got.columns == ["k", "part", "rank", "title", "description", "date", "confidence", "sourceText"]
    assert [(r.k, r["rank"], r.date) for r in got.orderBy("rank").collect()] == [("a", 0, "1850-01-02"), ("a", 1, "1900-01-02")]
    with pytest.raises(Exception, match="no column text"):
        spark.sql("SELECT * FROM parse_events(TABLE({docs}), 'regex')", docs=docs.drop("text"))


def test_a_parser_of_ones_own_in_sql(spark):
    extract.register_parser("lines", "An event for each line", extract.parse_regex, lambda text: [(x, x, "1900", 0.6, x) for x in text.split("\n") if x])
    try:
        extract.register_functions(spark)
        got = spark.sql("SELECT e.title FROM VALUES ('a\nb'), ('') AS t(text), LATERAL parse_events(text, 'lines') AS e")
        assert sorted(r.title for r in got.collect()) == ["a", "b"]
    finally:
        del extract.PARSERS["lines"], rows.PARSERS["lines"]


def test_rows_and_columns_agree_on_titles_days_and_iso_dates(spark):
    dates = ["1834", "1834-05", "1834-02-31", "1900-02-29", "0000-01-05", "1834-00-01", "1834-13", "1834-01-32", "x", "", "9999-12-31", "May 17, 1834", "may. 17 1834", "Sept. 1, 1834", "Sep. 1 1834", "Jan 1, 1900", "January. 1, 1900", "5/6/1900", "5-6-1900"]
    frame = spark.createDataFrame([(x,) for x in dates], "x string").select("x", sort_date_or_epoch(F.col("x")).alias("day"), parse_to_iso(F.col("x")).alias("iso"))
    for r in frame.withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date"))).drop("day").collect():
        assert rows.day_of(r.x) - rows.day_of("1970") == r.n and rows.iso_of(r.x) == r.iso, r.x
    sentences = [("On 1900 , - the first: second third fourth fifth sixth seventh eighth ninth", "1900"), ("1900", "1900"), ("x", "none"), ("é" * 70 + " 1900", "1900"), ("1900 ßa", "1900")]
    made = spark.createDataFrame(sentences, "s string, raw string").select("s", "raw", title_of(F.col("s"), F.col("raw")).alias("t"))
    for r in made.collect():
        assert rows.title_in(r.s, r.raw) == r.t, r.s


def test_regex_parse_scans_texts_once(spark):
    plan = extract.parse_regex(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
