"""Hand-derived values of the scalar functions, one Spark job for each group."""

from pyspark.sql import functions as F

from tempora.functions import dates, numbers, text


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_parse_to_iso(spark):
    got = values(spark, ["5/17/1834", "May. 17, 1834", "may 17 1834", "Sept. 1, 1834", "1834-99-99", "1834", "May 1834", "September 3, 1900", "13/45/1900", "", None, "1834\n"], dates.parse_to_iso)
    assert got == ["1834-05-17", "1834-05-17", "1834-05-17", None, "1834-99-99", "1834", None, "1900-09-03", "1900-13-45", None, None, None]


def test_format_date(spark):
    rows = ["1834", "1834-05", "1834-05-09", "1834-13", "-044-03", "unknown", "1834-"]
    assert values(spark, rows, dates.format_date) == ["1834", "May 1834", "May 9, 1834", "13 1834", "-044-03", "unknown", "1834"]
    assert values(spark, rows, dates.format_date_short)[:4] == ["1834", "May 1834", "May 1834", "13 1834"]


def test_years_and_sort_dates(spark):
    rows = ["1834", "1834-02-30", "1834-13", "unknown", "0900-01-01", None]
    assert [str(x) for x in values(spark, rows, dates.sort_date)] == ["1834-01-01", "1834-03-02", "None", "None", "0900-01-01", "None"]
    assert values(spark, rows, dates.timeline_year) == [1834, 1834, 1834, None, 900, None]
    assert values(spark, rows, dates.search_year) == [1834, 1834, None, None, 900, None]


def matches(spark, rows):
    found = values(spark, rows, dates.date_matches)
    return [[(m["index"], m["normalized"], m["confidence"]) for m in x] for x in found]


def test_date_matches(spark):
    got = matches(
        spark,
        ["Work ended on May 17, 1834 at noon.", "May 5, 1900", "Berlin 1922", "June 1871", "17.5.1834", "11834-05-17", "1/2/1900 and 3/4/1901", "é1834", "none", ""],
    )
    assert got[0] == [(14, "1834-05-17", 0.95), (22, "1834", 0.3)]
    assert got[1] == [(0, "1900-05-05", 0.95), (7, "1900", 0.3)]
    assert got[2] == [(4, "1922", 0.5), (7, "1922", 0.3)]
    assert got[3] == [(0, "1871-06", 0.7), (5, "1871", 0.3)]
    assert got[4] == [(0, "1834-05-17", 0.8), (5, "1834", 0.3)]
    assert got[5] == [(1, "1834-05-17", 1.0)]
    assert [x for x in got[6] if x[2] > 0.3] == [(0, "1900-01-02", 0.85), (13, "1901-03-04", 0.85)]
    assert got[7] == [(1, "1834", 0.3)]
    assert got[8] == got[9] == []


def test_sentences_and_titles(spark):
    at = lambda i: lambda x: text.sentence_at(x, F.lit(i))
    assert values(spark, ["One. Two on May. 17, 1834 here. Three"], at(12)) == ["Two on May."]
    long = "a" * 400
    (got,) = values(spark, [long], at(150))
    assert got == "a" * 300 + "..."
    title = lambda raw: lambda x: text.title_of(x, F.lit(raw))
    assert values(spark, ["1834-05-17", "On 1834-05-17, the first barge of a new canal came in at last", "x" * 80], title("1834-05-17")) == [
        "Historical Event",
        "On , the first barge of a new",
        "X" + "x" * 56 + "...",
    ]


def test_html(spark):
    got = values(
        spark,
        ["<p>a&amp;lt;b</p><noscript>x</noscript>&#8217;", "<script>" + "<" * 60_000 + "</script>ok", "a<pre>b</pre>c <b>d</b>", "x &#39;y&#39; &nbsp; z", "", None, "&#x41; &#65;"],
        text.html_to_text,
    )
    assert got == ["a<b\n’", "ok", "a\nb\nc d", "x 'y' z", "", None, "&#x41; A"]


def test_white_space(spark):
    assert values(spark, ["\n a \t", " ﻿b　", "  ", None], text.trimmed) == ["a", "b", "", None]


def test_small_functions(spark):
    assert values(spark, ["Salt Lake City, UT", "--a--", "Å b"], text.slug) == ["salt-lake-city-ut", "a", "b"]
    assert values(spark, ["1860abc", "x", "", " -5"], text.integer_prefix) == [1860, None, None, -5]
    assert values(spark, ["0.9", "0.5", "0.1"], lambda x: text.confidence_band(x.cast("double"))) == ["high", "medium", "low"]
    assert values(spark, ["1", "0", "2"], lambda x: text.counted(x.cast("int"), "event")) == ["1 event", "0 events", "2 events"]
    (name,) = values(spark, ["Torvik"], lambda x: text.location_id(x, F.lit(1_700_000_000_000)))
    assert name.startswith("torvik-") and len(name) == 11


def test_coordinates(spark):
    got = values(spark, ["48.5, -12.75", "48.5 -12.75", "91, 0", "x", None], numbers.parse_coordinates)
    assert [tuple(x) if x else None for x in got] == [(48.5, -12.75), (48.5, -12.75), None, None, None]


def test_numbers(spark):
    df = spark.range(1)
    one = lambda e: df.select(e).first()[0]
    assert one(numbers.progress_percent(F.lit(0), F.lit(0))) == 0
    assert one(numbers.progress_percent(F.lit(1), F.lit(8))) == 13
    assert one(numbers.decade_ticks(F.lit(1776), F.lit(1830))) == [1780, 1790, 1800, 1810, 1820, 1830]
    assert one(numbers.decade_ticks(F.lit(1850), F.lit(1950))) == [1850, 1870, 1890, 1910, 1930, 1950]
    assert one(numbers.decade_ticks(F.lit(1851), F.lit(1852))) == []
    assert one(numbers.year_at(F.lit(1.5), 1776, 2020)) == 2020
    assert abs(one(numbers.mercator_x(F.lit(180.0))) - numbers.EDGE) < 1e-6
    assert one(numbers.mercator_y(F.lit(90.0))) == numbers.EDGE
