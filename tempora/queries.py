"""Registered queries over the star-schema tables, and DuckDB SQL for the same rows.

Customers are locations, orders are their events. Dates of events have the precision of a year, a month or a day by
their key, and some are no dates, so that both policies for those show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, numbers, text
from .operators import edits, intervals, nearest, search, text_index, timeline
from .plans import extract
from .schema import EVENT, LOCATION
from .sources import documents
from .sources.shared import shared_folder
from .streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOC = """loc AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ', ' || n_name AS name, c_custkey AS loc_ord,
    CAST((c_custkey * 37) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((c_custkey * 53) % 17000 AS DOUBLE) / 100 - 85 AS lat
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
EVT = """evt AS (SELECT *, CASE WHEN date = 'unknown' THEN NULL WHEN length(date) = 4 THEN CAST(date || '-01-01' AS DATE)
        WHEN length(date) = 7 THEN CAST(date || '-01' AS DATE) ELSE CAST(date AS DATE) END AS k, split_part(date, '-', 1) AS year_text,
        TRY_CAST(split_part(date, '-', 1) AS INTEGER) AS ty
    FROM (SELECT o_custkey AS loc_ord, o_orderkey AS evt_ord, o_orderpriority AS title, o_orderstatus || ' order ' || CAST(o_orderkey AS VARCHAR) AS description,
        CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y')
             WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders))"""
OVL = """ovl AS (SELECT p_partkey AS id, p_name AS name, p_size AS z, CAST(min(year(l_shipdate)) AS INTEGER) AS year_from, CAST(max(year(l_shipdate)) AS INTEGER) AS year_to
    FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)"""


def _query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return keep


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def locations(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, loc_ord, lon, lat)."""
    c, n = _table(spark, d, "customer"), _table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat("c_name", F.lit(", "), "n_name").alias("name"),
        F.col("c_custkey").alias("loc_ord"),
        ((F.col("c_custkey") * 37 % 36000).cast("double") / 100 - 180).alias("lon"),
        ((F.col("c_custkey") * 53 % 17000).cast("double") / 100 - 85).alias("lat"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """(loc_ord, evt_ord, title, description, date)."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    date = (
        F.when(key % 97 == 0, "unknown")
        .when(key % 3 == 0, F.date_format(day, "yyyy"))
        .when(key % 3 == 1, F.date_format(day, "yyyy-MM"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    description = F.concat("o_orderstatus", F.lit(" order "), key.cast("string"))
    return _table(spark, d, "orders").select(F.col("o_custkey").alias("loc_ord"), key.alias("evt_ord"), F.col("o_orderpriority").alias("title"), description.alias("description"), date.alias("date"))


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Locations with their events as arrays, in order."""
    made = F.struct(
        F.col("evt_ord").cast("string").alias("id"), "title", "description", "date", F.lit(None).cast("string").alias("imageUrl"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("source")
    )
    per = events(spark, d).groupBy("loc_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("evt_ord", made.alias("e")))), lambda x: x["e"]).alias("events"))
    events_or_none = F.coalesce("events", F.array().cast(per.schema["events"].dataType))
    return locations(spark, d).join(per, "loc_ord", "left").select("loc_ord", "id", "name", F.array("lon", "lat").alias("coordinates"), events_or_none.alias("events"))


def overlays(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, z, year_from, year_to): a part with the years in which it was shipped."""
    li, p = _table(spark, d, "lineitem"), _table(spark, d, "part")
    years = li.groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("year_from"), F.max(F.year("l_shipdate")).alias("year_to"))
    return p.join(years, p.p_partkey == years.l_partkey).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("z"), "year_from", "year_to")


_FOUND = ["loc_ord", "location_id", "name", "evt_ord", "title", "date"]


def _flat(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows with the names of their locations: what needs no arrays is filtered before anything is shuffled."""
    return events(spark, d).join(locations(spark, d).withColumnRenamed("id", "location_id"), "loc_ord")


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("loc_ord", "location_id", "name", F.col("event.id").cast("long").alias("evt_ord"), "event.title", "event.date")


def _search_sql(condition: str) -> str:
    return f"WITH {LOC}, {EVT} SELECT loc_ord, id AS location_id, name, evt_ord, title, date FROM loc JOIN evt USING (loc_ord) WHERE {condition}"


@_query("search_keyword", _search_sql("contains(lower(title), 'urgent') OR contains(lower(description), 'urgent') OR contains(lower(name), 'urgent')"))
def _(s, d):
    return search.search_flat(_flat(s, d), "URGENT").select(*_FOUND)


@_query("search_year_range", _search_sql("(contains(lower(title), 'a') OR contains(lower(description), 'a') OR contains(lower(name), 'a')) AND (k IS NULL OR year(k) BETWEEN 1996 AND 1998)"))
def _(s, d):
    return search.search_flat(_flat(s, d), "a", 1996, 1998).select(*_FOUND)


@_query("search_indexed", _search_sql("contains(lower(title), 'urgent') OR contains(lower(description), 'urgent') OR contains(lower(name), 'urgent')"))
def _(s, d):
    """The same by a stored index of trigrams."""
    path = f"{shared_folder(s)}/tempora-{s.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    text_index.build(_flat(s, d), path)
    return text_index.search_indexed(s, path, "URGENT").select(*_FOUND)


@_query("search_open_bound", _search_sql("k IS NULL OR year(k) >= 2000"))
def _(s, d):
    return search.search_flat(_flat(s, d), "", 2000).select(*_FOUND)


@_query("search_unparseable_passes", _search_sql("date = 'unknown'"))
def _(s, d):
    return _found(search.search_events(nested(s, d), "", 1, 2)).filter("date = 'unknown'")


@_query("timeline_unparseable_fails", f"WITH {EVT} SELECT loc_ord, evt_ord, date FROM evt WHERE ty BETWEEN 1 AND 3000")
def _(s, d):
    return events(s, d).filter(search.in_range(F.col("date"), 1, 3000)).select("loc_ord", "evt_ord", "date")


@_query("search_bound_text", f"WITH {EVT} SELECT loc_ord, evt_ord FROM evt WHERE k IS NULL OR year(k) >= 1999")
def _(s, d):
    bound = s.range(1).select(text.integer_prefix(F.lit(" 1999abc")).alias("low"))
    year = dates.search_year(F.col("date"))
    return events(s, d).crossJoin(F.broadcast(bound)).filter(year.isNull() | F.col("low").isNull() | (year >= F.col("low"))).select("loc_ord", "evt_ord")


@_query("show_map_distinct", f"WITH {LOC}, {EVT} SELECT DISTINCT loc_ord, id AS location_id, name FROM loc JOIN evt USING (loc_ord) WHERE contains(lower(title), 'high')")
def _(s, d):
    found = search.search_flat(_flat(s, d).withColumn("coordinates", F.array("lon", "lat")), "high")
    return search.distinct_locations(found).select("loc_ord", "location_id", "name")


@_query("list_locations", f"WITH {LOC}, {EVT} SELECT id, any_value(name) AS name, count(evt_ord) AS event_count FROM loc LEFT JOIN evt USING (loc_ord) GROUP BY id")
def _(s, d):
    return search.list_locations(nested(s, d)).select("id", "name", F.col("eventCount").cast("long").alias("event_count"))


@_query("timeline_any", f"WITH {LOC}, {EVT} SELECT DISTINCT id FROM loc JOIN evt USING (loc_ord) WHERE ty BETWEEN 1995 AND 1996")
def _(s, d):
    return search.visible(nested(s, d), 1995, 1996).select("id")


@_query("timeline_nested_filter", f"WITH {LOC}, {EVT} SELECT id, count(*) FILTER (ty BETWEEN 1995 AND 1996) AS n FROM loc LEFT JOIN evt USING (loc_ord) GROUP BY id")
def _(s, d):
    return search.with_events_in(nested(s, d), 1995, 1996).select("id", F.size("events").cast("long").alias("n"))


@_query("total_events", "SELECT count(*) AS total FROM orders")
def _(s, d):
    return timeline.total_events(nested(s, d)).select(F.col("total").cast("long").alias("total"))


@_query("find_location_by_id", f"WITH {LOC} SELECT id, name FROM loc WHERE id = '7'")
def _(s, d):
    return search.find_location(locations(s, d), id="7").select("id", "name")


@_query("selected_semi", "SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(s, d):
    return search.selected(_table(s, d, "documents"), _table(s, d, "labels").filter("quality = 1"), "doc_id").select("doc_id", "lang")


@_query("acknowledged_mark", "SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS acknowledged FROM documents d")
def _(s, d):
    return search.marked(_table(s, d, "documents").select("doc_id"), _table(s, d, "labels"), "doc_id")


@_query("selection_counts", "SELECT count(l.doc_id) AS selected, count(*) AS total, count(l.doc_id) = count(*) AS all_selected FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(s, d):
    return edits.selection_counts(_table(s, d, "documents").select("doc_id"), _table(s, d, "labels"), "doc_id")


@_query("selection_toggle", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) a FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def _(s, d):
    labels = _table(s, d, "labels")
    return edits.toggled(labels.filter("quality = 1"), labels.filter("toxic = 1"), "doc_id")


@_query("selection_reject", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    labels = _table(s, d, "labels")
    return edits.rejected(_table(s, d, "documents").select("doc_id"), labels, labels.filter("toxic = 1"), "doc_id")[0]


@_query("group_by_year", f"WITH {EVT} SELECT loc_ord, year_text AS year, count(*) AS n, string_agg(CAST(evt_ord AS VARCHAR), ',' ORDER BY evt_ord) AS members FROM evt GROUP BY ALL")
def _(s, d):
    grouped = timeline.by_year(events(s, d), "loc_ord", "evt_ord", "evt_ord")
    return grouped.select("loc_ord", "year", "n", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("members"))


@_query("active_year", f"WITH {EVT} SELECT loc_ord, min(year_text) AS year FROM evt GROUP BY loc_ord")
def _(s, d):
    return timeline.active_year(events(s, d), "loc_ord")


@_query("sort_years_lexical", f"WITH {EVT} SELECT loc_ord, year_text AS year, CAST(row_number() OVER (PARTITION BY loc_ord ORDER BY year_text) AS INTEGER) AS year_rank FROM (SELECT DISTINCT loc_ord, year_text FROM evt)")
def _(s, d):
    return timeline.years_of(events(s, d), "loc_ord")


@_query(
    "paginate",
    f"""WITH {EVT}, r AS (SELECT *, row_number() OVER (PARTITION BY loc_ord, year_text ORDER BY k NULLS LAST, evt_ord) - 1 AS i, count(*) OVER (PARTITION BY loc_ord, year_text) AS c FROM evt)
    SELECT loc_ord, evt_ord, year_text AS year, CAST(i // 3 AS INTEGER) AS page, CAST((c + 2) // 3 AS INTEGER) AS pages, i >= 3 AS has_previous, i // 3 < (c + 2) // 3 - 1 AS has_next, c > 3 AS pager_shown FROM r""",
)
def _(s, d):
    return timeline.paginated(events(s, d), "loc_ord", "evt_ord").select("loc_ord", "evt_ord", "year", "page", "pages", "has_previous", "has_next", "pager_shown")


@_query("sort_chrono", f"WITH {EVT} SELECT loc_ord, evt_ord, CAST(row_number() OVER (PARTITION BY loc_ord ORDER BY k NULLS LAST, evt_ord) AS INTEGER) AS rank FROM evt")
def _(s, d):
    return timeline.chronological(events(s, d), ["loc_ord"], "evt_ord").select("loc_ord", "evt_ord", "rank")


@_query("sort_invalid_epoch", f"WITH {EVT} SELECT loc_ord, evt_ord, CAST(row_number() OVER (PARTITION BY loc_ord ORDER BY coalesce(k, DATE '1970-01-01'), evt_ord) AS INTEGER) AS rank FROM evt")
def _(s, d):
    return timeline.chronological_epoch(events(s, d), ["loc_ord"], "evt_ord").select("loc_ord", "evt_ord", "rank")


@_query("sort_zindex", f"WITH {OVL} SELECT id, row_number() OVER (ORDER BY z, id) AS rank FROM ovl")
def _(s, d):
    return timeline.ranked_overlays(overlays(s, d).withColumn("zIndex", F.col("z"))).select("id", F.col("rank").cast("long").alias("rank"))


@_query("overlay_in_year", f"WITH {OVL} SELECT id, year_from, year_to FROM ovl WHERE 1996 BETWEEN year_from AND year_to")
def _(s, d):
    return timeline.overlays_in_year(overlays(s, d), 1996).select("id", "year_from", "year_to")


@_query("overlay_overlap", f"WITH {OVL} SELECT id, year_from, year_to FROM ovl WHERE year_to >= 2001 AND year_from <= 2003")
def _(s, d):
    return timeline.overlays_overlapping(overlays(s, d), 2001, 2003).select("id", "year_from", "year_to")


@_query("overlay_year_bounds", f"WITH {OVL} SELECT min(year_from) AS min_year, max(year_to) AS max_year FROM ovl")
def _(s, d):
    return timeline.overlay_bounds(overlays(s, d))


_OVERLAY_EVENT_RANGE_JOIN = f"WITH {EVT}, {OVL}, e AS (SELECT ty, count(DISTINCT loc_ord) AS c FROM evt WHERE ty IS NOT NULL GROUP BY ty) SELECT ovl.id, CAST(sum(c) AS BIGINT) AS n FROM e JOIN ovl ON ty BETWEEN year_from AND year_to GROUP BY ovl.id"


@_query("overlay_event_range_join", _OVERLAY_EVENT_RANGE_JOIN)
def _(s, d):
    own = events(s, d).select("loc_ord", dates.timeline_year(F.col("date")).alias("year")).filter("year is not null").distinct()
    return timeline.counted_in_overlay_years(own, overlays(s, d))


_OVERLAY_RANGES_OVERLAP = f"WITH {OVL}, r AS (SELECT s_suppkey AS r, CAST(1990 + s_suppkey % 12 AS INTEGER) AS lo, CAST(1990 + s_suppkey % 12 + s_suppkey % 3 AS INTEGER) AS hi FROM supplier), o AS (SELECT year_from, year_to, count(*) AS c FROM ovl GROUP BY ALL) SELECT r, CAST(sum(c) AS BIGINT) AS n FROM r JOIN o ON year_to >= lo AND year_from <= hi GROUP BY r"


@_query("overlay_ranges_overlap", _OVERLAY_RANGES_OVERLAP)
def _(s, d):
    key = F.col("s_suppkey")
    ranges = _table(s, d, "supplier").select(key.alias("r"), (1990 + key % 12).cast("int").alias("lo"), (1990 + key % 12 + key % 3).cast("int").alias("hi"))
    return timeline.overlapping_counts(ranges, overlays(s, d)).select("r", "n")


_ERAS = "eras AS (SELECT n_nationkey AS era, CAST(1985 + n_nationkey AS INTEGER) AS lo, CAST(1985 + n_nationkey + n_nationkey % 7 * 3 - 1 AS INTEGER) AS hi FROM nation)"


def _eras(s, d):
    """(era, lo, hi): ranges of years by nation, nested, wide and empty ones among them."""
    key = F.col("n_nationkey")
    return _table(s, d, "nation").select(key.alias("era"), (1985 + key).cast("int").alias("lo"), (1985 + key + key % 7 * 3 - 1).cast("int").alias("hi"))


@_query("overlay_era_pairs", f"WITH {OVL}, {_ERAS} SELECT era, id FROM eras JOIN ovl ON year_to >= lo AND year_from <= hi WHERE lo <= hi")
def _(s, d):
    return timeline.overlays_overlapping_each(_eras(s, d), overlays(s, d)).select("era", "id")


@_query("event_era_pairs", f"WITH {EVT}, {_ERAS} SELECT era, evt_ord FROM eras JOIN evt ON ty BETWEEN lo AND hi")
def _(s, d):
    own = events(s, d).select("evt_ord", dates.timeline_year(F.col("date")).alias("year"))
    return intervals.pairs_within(own, "year", _eras(s, d), "lo", "hi").select("era", "evt_ord")


@_query("overlay_enabled_count", "SELECT count(*) FILTER (p_size % 2 = 0) AS enabled FROM part")
def _(s, d):
    return timeline.enabled_count(_table(s, d, "part").select((F.col("p_size") % 2 == 0).alias("enabled")))


@_query("overlay_edit", "SELECT p_partkey AS id, CASE WHEN p_partkey = 3 THEN NOT (p_size % 2 = 0) ELSE p_size % 2 = 0 END AS enabled, CASE WHEN p_partkey = 4 THEN 0.25::DOUBLE ELSE 0.7::DOUBLE END AS opacity FROM part")
def _(s, d):
    rows = _table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 2 == 0).alias("enabled"), F.lit(0.7).alias("opacity"))
    return timeline.with_opacity(timeline.toggled(rows, "3"), "4", 0.25).withColumn("id", F.col("id").cast("long"))


@_query("overlay_reorder", "SELECT n_nationkey AS id, CAST(CASE WHEN n_nationkey = 2 THEN 7 WHEN n_nationkey BETWEEN 3 AND 7 THEN n_nationkey - 1 ELSE n_nationkey END AS INTEGER) AS place, CAST(CASE WHEN n_nationkey = 2 THEN 7 WHEN n_nationkey BETWEEN 3 AND 7 THEN n_nationkey - 1 ELSE n_nationkey END + 1 AS INTEGER) AS z_index FROM nation")
def _(s, d):
    rows = _table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("place"))
    return timeline.reordered(rows, 2, 7).select("id", "place", F.col("zIndex").alias("z_index"))


@_query("overlay_attribution", "SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'Map georeferenced with Allmaps' WHEN 1 THEN '© OpenHistoricalMap contributors' WHEN 2 THEN 'USGS The National Map' WHEN 3 THEN 'NYPL Map Warper' ELSE '' END AS attribution FROM nation")
def _(s, d):
    source = F.get(F.array(*[F.lit(x) for x in ("allmaps", "ohm", "usgs", "nypl", "custom", "other")]), F.col("n_nationkey") % 6)
    return _table(s, d, "nation").select("n_nationkey", timeline.attribution(source).alias("attribution"))


@_query(
    "upsert",
    f"""WITH {LOC}, new AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'new-' || s_suppkey END AS id, s_name AS name, s_suppkey AS o FROM supplier),
    last AS (SELECT max(loc_ord) AS m FROM loc)
    SELECT loc.id, coalesce(new.name, loc.name) AS name, loc_ord FROM loc LEFT JOIN new USING (id)
    UNION ALL SELECT new.id, name, m + row_number() OVER (ORDER BY o) FROM new, last WHERE new.id NOT IN (SELECT id FROM loc)""",
)
def _(s, d):
    key = F.col("s_suppkey")
    new = _table(s, d, "supplier").select(
        F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(F.lit("new-"), key.cast("string"))).alias("id"), F.col("s_name").alias("name"), key.alias("loc_ord")
    )
    return edits.upserted(locations(s, d).select("id", "name", "loc_ord"), new)


@_query("delete_location", f"WITH {LOC} SELECT id FROM loc WHERE id <> '5'")
def _(s, d):
    return edits.deleted(locations(s, d), "5").select("id")


@_query("add_events_absent", f"WITH {EVT}, old AS (SELECT loc_ord, evt_ord, title FROM evt WHERE evt_ord % 5 <> 0), new AS (SELECT loc_ord, evt_ord, 'new' AS title FROM evt WHERE evt_ord % 10 < 6) SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.loc_ord = new.loc_ord AND old.evt_ord = new.evt_ord)")
def _(s, d):
    rows = events(s, d).select("loc_ord", "evt_ord", "title")
    return edits.added_if_absent(rows.filter("evt_ord % 5 <> 0"), rows.filter("evt_ord % 10 < 6").withColumn("title", F.lit("new")), ["loc_ord", "evt_ord"])


def _one_event(location: DataFrame, change) -> DataFrame:
    changed = location.withColumn("events", change)
    return search.unnested(changed).select("loc_ord", F.col("event.id").cast("long").alias("evt_ord"), F.col("event.title").alias("title"))


@_query("update_event", f"WITH {EVT} SELECT loc_ord, evt_ord, CASE WHEN evt_ord = (SELECT min(evt_ord) FROM evt) THEN 'changed' ELSE title END AS title FROM evt JOIN customer ON c_custkey = loc_ord")
def _(s, d):
    first = events(s, d).agg(F.min("evt_ord").cast("string").alias("first"))
    rows = nested(s, d).crossJoin(F.broadcast(first))
    new = F.struct(F.col("first").alias("id"), F.lit("changed").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("description", "date", "imageUrl")], F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("source"))
    return _one_event(rows, edits.event_updated(F.col("events"), new))


@_query("delete_event", f"WITH {EVT} SELECT loc_ord, evt_ord, title FROM evt JOIN customer ON c_custkey = loc_ord WHERE evt_ord <> (SELECT min(evt_ord) FROM evt)")
def _(s, d):
    first = events(s, d).agg(F.min("evt_ord").cast("string").alias("first"))
    return _one_event(nested(s, d).crossJoin(F.broadcast(first)), edits.event_deleted(F.col("events"), F.col("first")))


@_query("edit_validation", "SELECT o_orderkey, trim(o_orderpriority) AS title FROM orders WHERE o_orderkey % 4 <> 0")
def _(s, d):
    rows = _table(s, d, "orders").select("o_orderkey", F.concat(F.lit("\t "), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise(""), F.lit(" \n")).alias("title"), F.lit("1869 ").alias("date"), F.lit("x").alias("description"))
    return edits.edited(rows).select("o_orderkey", "title")


@_query("required_fields", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0")
def _(s, d):
    rows = events(s, d).withColumn("id", F.lit(None).cast("string")).withColumn("title", F.when(F.col("evt_ord") % 7 != 0, F.col("title")))
    return documents.new_event(rows).agg(F.count("*").alias("n"))


_FORMS = "CASE CAST(o_orderkey % 8 AS INTEGER) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%b. %-d %Y') WHEN 3 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 4 THEN strftime(o_orderdate, '%-d.%-m.%Y') WHEN 5 THEN strftime(o_orderdate, '%B %Y') WHEN 6 THEN 'in ' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y') END"


def _form() -> Column:
    day = F.col("o_orderdate")
    shown = [F.date_format(day, x) for x in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM. d yyyy", "M/d/yyyy", "d.M.yyyy", "MMMM yyyy", "'in 'yyyy", "yyyy")]
    return F.get(F.array(*shown), (F.col("o_orderkey") % 8).cast("int"))


@_query("parse_to_iso", f"SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 8 = 7 THEN strftime(o_orderdate, '%Y') END AS iso FROM orders")
def _(s, d):
    return _table(s, d, "orders").select("o_orderkey", dates.parse_to_iso(_form()).alias("iso"))


@_query("format_date_long", f"WITH {EVT} SELECT evt_ord, CASE WHEN date = 'unknown' OR length(date) = 4 THEN date WHEN length(date) = 7 THEN strftime(k, '%B %Y') ELSE strftime(k, '%B %-d, %Y') END AS shown FROM evt")
def _(s, d):
    return events(s, d).select("evt_ord", dates.format_date(F.col("date")).alias("shown"))


@_query("format_date_short", f"WITH {EVT} SELECT evt_ord, CASE WHEN date = 'unknown' OR length(date) = 4 THEN date ELSE strftime(k, '%b %Y') END AS shown FROM evt")
def _(s, d):
    return events(s, d).select("evt_ord", dates.format_date_short(F.col("date")).alias("shown"))


@_query("year_of", f"WITH {EVT} SELECT evt_ord, year_text, ty AS year FROM evt")
def _(s, d):
    return events(s, d).select("evt_ord", dates.year_text(F.col("date")).alias("year_text"), dates.timeline_year(F.col("date")).alias("year"))


@_query("parse_coordinates", f"WITH {LOC} SELECT loc_ord, CASE WHEN loc_ord % 3 < 2 THEN CAST(loc_ord % 80 AS DOUBLE) + 0.5 END AS lat, CASE WHEN loc_ord % 3 < 2 THEN -CAST(loc_ord % 170 AS DOUBLE) END AS lng FROM loc")
def _(s, d):
    k = F.col("loc_ord")
    shown = F.concat((k % 80).cast("string"), F.lit(".5"), F.when(k % 3 == 0, ", ").otherwise(" "), F.lit("-"), (k % 170).cast("string"))
    given = F.when(k % 3 < 2, shown).otherwise(F.concat(F.lit("91."), shown))
    return locations(s, d).select("loc_ord", numbers.parse_coordinates(given).alias("p")).select("loc_ord", "p.lat", "p.lng")


@_query("mercator", f"WITH {LOC} SELECT id, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y FROM loc")
def _(s, d):
    at = search.map_points(locations(s, d).withColumn("coordinates", F.array("lon", "lat")))
    return at.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@_query(
    "nearest_place",
    f"""WITH {LOC}, p AS (SELECT s_suppkey AS place, CAST((s_suppkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((s_suppkey * 104729) % 1700 AS DOUBLE) / 10 - 85 AS lat FROM supplier),
    a AS (SELECT id, radians(lon) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS y FROM loc),
    b AS (SELECT place, radians(lon) * 6378137.0 AS u, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS v FROM p),
    m AS (SELECT id, place, sqrt(pow(least(abs(x - u), 2 * pi() * 6378137.0 - abs(x - u)), 2) + pow(y - v, 2)) AS d FROM a, b)
    SELECT id, arg_min(place, (round(d, 3), place)) AS place, round(min(d), 3) AS meters FROM m GROUP BY id""",
)
def _(s, d):
    """The supplier nearest to each location."""
    key = F.col("s_suppkey")
    places = _table(s, d, "supplier").select(key.alias("place"), ((key * 7919 % 3600).cast("double") / 10 - 180).alias("lon"), ((key * 104729 % 1700).cast("double") / 10 - 85).alias("lat"))
    return nearest.nearest(locations(s, d), places, "place").select("id", "place.place", F.round("distance", 3).alias("meters"))


@_query("confidence_band", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.8 THEN 'high' WHEN l_discount * 10 >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM lineitem")
def _(s, d):
    return _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.confidence_band(F.col("l_discount") * 10).alias("band"))


@_query("decade_ticks", f"WITH {OVL}, t AS (SELECT id, unnest(range(CAST(ceil((year_from - id % 90) / 10.0) * 10 AS BIGINT), CAST(year_to + 1 AS BIGINT), 10)) AS y FROM ovl), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY id) AS c FROM t) SELECT id, CAST(y AS INTEGER) AS year FROM r WHERE c <= 8 OR i % 2 = 0")
def _(s, d):
    low = (F.col("year_from") - F.col("id") % 90).cast("int")
    return overlays(s, d).select("id", F.explode(numbers.decade_ticks(low, F.col("year_to"))).alias("year"))


@_query("year_scale", "SELECT l_orderkey, l_linenumber, CAST(floor(1776 + least(1, greatest(0, l_tax * 15 - 0.1)) * 244 + 0.5) AS INTEGER) AS year FROM lineitem")
def _(s, d):
    return _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.year_at(F.col("l_tax") * 15 - 0.1, 1776, 2020).alias("year"))


@_query("thumbs", "SELECT n_nationkey, CASE WHEN abs(n_nationkey - 5) <= abs(n_nationkey - 15) THEN 'low' ELSE 'high' END AS thumb, CAST(greatest(0, least(n_nationkey, 14)) AS INTEGER) AS low, CAST(least(20, greatest(n_nationkey, 6)) AS INTEGER) AS high FROM nation")
def _(s, d):
    y = F.col("n_nationkey")
    return _table(s, d, "nation").select("n_nationkey", numbers.nearest_thumb(y, F.lit(5), F.lit(15)).alias("thumb"), numbers.moved_low(y, F.lit(15), 0).alias("low"), numbers.moved_high(y, F.lit(5), 20).alias("high"))


@_query("range_presets", f"WITH {OVL} SELECT CASE WHEN year_from - id % 200 < 1850 THEN 'Pre-1850' WHEN year_from - id % 200 <= 1920 THEN '1850-1920' ELSE 'Post-1920' END AS preset, count(*) AS n FROM ovl GROUP BY 1")
def _(s, d):
    return overlays(s, d).groupBy(numbers.preset_of(F.col("year_from") - F.col("id") % 200).alias("preset")).agg(F.count("*").alias("n"))


_ACK = "acks AS (SELECT user_id, event_id % 500 AS e, ts, event_id FROM events)"


@_query("ack_score", f"WITH {_ACK} SELECT user_id, count(DISTINCT e) AS acknowledged, CAST(10 * count(DISTINCT e) AS BIGINT) AS points FROM acks GROUP BY user_id")
def _(s, d):
    acks = _table(s, d, "events").select("user_id", (F.col("event_id") % 500).alias("e"))
    return state.scores(acks, "user_id", "e").select("user_id", "acknowledged", F.col("points").cast("long").alias("points"))


@_query("progress_pct", f"WITH {_ACK} SELECT user_id, CAST(floor(100.0 * count(DISTINCT e) / 500 + 0.5) AS BIGINT) AS percent FROM acks GROUP BY user_id")
def _(s, d):
    acks = _table(s, d, "events").select("user_id", (F.col("event_id") % 500).alias("e"))
    return state.scores(acks, "user_id", "e").select("user_id", numbers.progress_percent(F.col("acknowledged"), F.lit(500)).alias("percent"))


@_query("ack_running_points", f"WITH {_ACK}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, e ORDER BY event_id) = 1 AS first FROM acks) SELECT user_id, event_id, first, CAST(sum(CASE WHEN first THEN 10 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS points FROM f")
def _(s, d):
    acks = _table(s, d, "events").select("user_id", "event_id", (F.col("event_id") % 500).alias("e"))
    return state.running_points(acks, "user_id", "e", "event_id").select("user_id", "event_id", "first", F.col("points").cast("long").alias("points"))


@_query("snapshot_changes", "WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, event_type FROM p WHERE n = 1 OR event_type <> b")
def _(s, d):
    polls = _table(s, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("t"))
    return state.changed_snapshots(polls, ["user_id"], "t", "event_type").select("user_id", "event_id", "event_type")


@_query(
    "rate_limit",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT user_id, event_type, ts_ms, seq, n, TRUE AS admitted, [ts_ms] AS recent FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_type, e.ts_ms, e.seq, e.n, len(list_filter(recent, lambda t: e.ts_ms - t < 21600000)) < 2,
            CASE WHEN len(list_filter(recent, lambda t: e.ts_ms - t < 21600000)) < 2 THEN list_append(list_filter(recent, lambda t: e.ts_ms - t < 21600000), e.ts_ms)
                 ELSE list_filter(recent, lambda t: e.ts_ms - t < 21600000) END
        FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
    SELECT user_id, event_type, ts_ms, seq, admitted FROM w""",
)
def _(s, d):
    requests = _table(s, d, "events").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"))
    return state.rate_limited(requests, ["user_id", "event_type"], 2, 6 * 3_600_000)


@_query("client_ip", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || event_id % 250 WHEN 1 THEN '192.168.1.' || user_id ELSE '127.0.0.1' END AS ip FROM events")
def _(s, d):
    e = _table(s, d, "events")
    kind = F.col("event_id") % 3
    forwarded = F.when(kind == 0, F.concat(F.lit(" 10.0.0."), (F.col("event_id") % 250).cast("string"), F.lit(" , 1.1.1.1"))).when(kind == 1, "")
    real = F.when(kind == 1, F.concat(F.lit("192.168.1."), F.col("user_id").cast("string"))).otherwise("")
    return e.select("event_id", text.client_ip(forwarded, real).alias("ip"))


@_query("ua_blocked", "SELECT event_id, event_id % 4 = 1 AS blocked FROM events")
def _(s, d):
    kind = F.col("event_id") % 4
    path = F.when(kind == 3, "/map").otherwise("/api/parse")
    agent = F.when((kind == 1) | (kind == 3), "Mozilla CURL/8").when(kind == 0, "Mozilla/5.0")
    return _table(s, d, "events").select("event_id", state.blocked_agent(path, agent).alias("blocked"))


@_query("web_urls", "SELECT page_id, CAST(regexp_matches(url, '^(?i)https?://') AS BOOLEAN) AS web FROM pages")
def _(s, d):
    return _table(s, d, "pages").select("page_id", timeline.web_url(F.col("url")).alias("web"))


@_query("slugify", f"WITH {LOC} SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM loc")
def _(s, d):
    return locations(s, d).select("id", text.slug(F.col("name")).alias("slug"))


@_query("text_size_guard", r"SELECT doc_id, coalesce(length(text), 0) > 51200 OR regexp_full_match(coalesce(text, ''), '[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*') AS refused FROM documents")
def _(s, d):
    return documents.checked_texts(_table(s, d, "documents")).select("doc_id", F.col("error").isNotNull().alias("refused"))


@_query("pdf_cleanup", r"SELECT doc_id, trim(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS clean FROM documents")
def _(s, d):
    paged = F.regexp_replace("text", "\n", "\r\n\r\n")
    return _table(s, d, "documents").select("doc_id", text.pages_cleaned(paged).alias("clean"))


_STEPS = [(rf"(?is)<{t}\b.*?</{t}>", "''") for t in ("script", "style", "noscript")]
_STEPS += [(rf"(?i)</?(?:{text.BREAKING})[^>]*>", "chr(10)"), (r"</?[^>]+(?:>|\z)", "' '")]
_STEPS += [(f"(?i){e.replace(chr(39), chr(39) * 2)}", "chr(39)" if v == "'" else f"'{v}'") for e, v in text.ENTITIES]
_STEPS += [(r"[ \t]+", "' '"), (r"\n[ \t]+", "chr(10)"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")]
_HTML = "html"
for _pattern, _value in _STEPS:
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', {_value}, 'g')"


@_query("html_to_text", f"SELECT page_id, trim({_HTML}, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM pages")
def _(s, d):
    return _table(s, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


_ROUNDTRIP = f"WITH {LOC}, {EVT} SELECT id, name, count(evt_ord) AS n FROM loc LEFT JOIN evt USING (loc_ord) GROUP BY ALL"


@_query("json_roundtrip", _ROUNDTRIP)
def _(s, d):
    rows = nested(s, d).withColumn("part", F.floor(F.col("loc_ord") / 1000))
    back = documents.import_json(documents.export_json(documents.documents_of(rows, ["part"]))).filter("valid").select("document.*")
    return documents.locations(back).select("id", "name", F.size("events").cast("long").alias("n"))


def prose(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): for each order a sentence with its date in one of eight forms, and one without a date."""
    return _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("No date stands here. The "), F.lower(F.substring("o_orderpriority", 3, 30)), F.lit(" order came "), _form(), F.lit(" to town! So it was")).alias("text"),
    )


_PROSE = f"prose AS (SELECT o_orderkey AS doc_id, o_orderdate AS day, CAST(o_orderkey % 8 AS INTEGER) AS f, {_FORMS} AS form, lower(substr(o_orderpriority, 3, 30)) AS p FROM orders), t AS (SELECT *, 'No date stands here. The ' || p || ' order came ' || form || ' to town! So it was' AS text, length('No date stands here. The ' || p || ' order came ') AS i FROM prose)"
_YEAR_AT = "strftime(day, '%Y')"


@_query(
    "find_dates",
    f"""WITH {_PROSE}, m AS (
        SELECT doc_id, i AS index, form AS raw, CASE f WHEN 5 THEN strftime(day, '%Y-%m') WHEN 6 THEN {_YEAR_AT} WHEN 7 THEN {_YEAR_AT} ELSE strftime(day, '%Y-%m-%d') END AS normalized,
               CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.7 WHEN 6 THEN 0.5 ELSE 0.3 END AS confidence FROM t
        UNION ALL  -- May is its own abbreviation, which the longer name precedes
        SELECT doc_id, i + length(form) - 4, {_YEAR_AT}, {_YEAR_AT}, 0.3 FROM t WHERE f IN (1, 2, 3, 4, 5, 6))
    SELECT doc_id, CAST(index AS INTEGER) AS index, raw, normalized, CAST(confidence AS DOUBLE) AS confidence FROM m""",
)
def _(s, d):
    return extract.find_dates(prose(s, d))


_PARSED = f"""WITH {_PROSE}, c AS (SELECT *, CASE f WHEN 2 THEN strftime(day, '%b.') WHEN 4 THEN strftime(day, '%-d.') ELSE form || ' to town!' END AS rest FROM t WHERE f < 7)
    SELECT doc_id, CAST(0 AS INTEGER) AS rank, 'The ' || p || ' order came ' || CASE WHEN f IN (2, 4) THEN rest ELSE 'to town!' END AS title,
        'The ' || p || ' order came ' || rest AS description, 'The ' || p || ' order came ' || rest AS "sourceText",
        CASE f WHEN 5 THEN strftime(day, '%Y-%m') WHEN 6 THEN strftime(day, '%Y') ELSE strftime(day, '%Y-%m-%d') END AS date,
        CAST(CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM c"""


@_query("regex_parse", _PARSED)
def _(s, d):
    return extract.parse_documents(prose(s, d), "regex").drop("id")


@_query("parse_events_lateral", _PARSED)
def _(s, d):
    extract.register_functions(s)
    return s.sql("SELECT doc_id, e.* FROM {docs}, LATERAL parse_events(text, 'regex') AS e", docs=prose(s, d))


@_query("parse_events_partitioned", "SELECT o_custkey AS doc_id, 'Order ' || o_orderkey AS title, o_orderstatus AS description, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 2 = 0")
def _(s, d):
    """The records of a customer's orders are one document."""
    extract.register_functions(s)
    docs = records(s, d).join(_table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey"), "doc_id").select(F.col("o_custkey").alias("doc_id"), "text")
    return s.sql("SELECT doc_id, title, description, date FROM parse_events(TABLE({docs}) PARTITION BY (doc_id), 'structured')", docs=docs)


def records(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): single-line records of orders; some have no date, some a second title."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit("EVENT: Order "), k.cast("string"), F.lit(" | date: "), _form(), F.when(k % 2 == 0, F.concat(F.lit(" | DATE: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" |Description: "), F.col("o_orderstatus"))).otherwise(" DATE:"))
    return _table(spark, d, "orders").select(k.alias("doc_id"), line.alias("text"))


@_query("structured_single_line", "SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey AS title, o_orderstatus AS description, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 2 = 0")
def _(s, d):
    return extract.parse_documents(records(s, d), "structured").select("doc_id", "title", "description", "date")


@_query("structured_parse", "SELECT o_custkey AS doc_id, 'Order ' || o_orderkey AS title, o_orderpriority AS description, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS INTEGER) AS rank FROM orders")
def _(s, d):
    o = _table(s, d, "orders")
    block = F.concat(F.lit("EVENT: Order "), F.col("o_orderkey").cast("string"), F.lit("\nDATE: "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("\nDESCRIPTION: "), F.col("o_orderpriority"), F.lit("\n\n"))
    docs = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "").alias("text"))
    return extract.parse_documents(docs, "structured").select("doc_id", "title", "description", "date", "rank")


@_query("find_location_by_name", f"WITH {LOC} SELECT id, name FROM loc WHERE name = (SELECT min(name) FROM loc)")
def _(s, d):
    rows = locations(s, d)
    return search.find_location(rows, name=rows.agg(F.min("name")).first()[0]).select("id", "name")


@_query("annotation_urls", r"SELECT page_id, CAST(regexp_matches(url, '^(?i)https:') OR regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(allmaps\.org|iiif\.io)') AS BOOLEAN) AS valid FROM pages")
def _(s, d):
    return _table(s, d, "pages").select("page_id", timeline.valid_annotation_url(F.col("url")).alias("valid"))


@_query(
    "parsed_as_events",
    f"SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, 'EVENT: Order ' || o_orderkey || ' | date: ' || {_FORMS} || ' | DATE: ' || strftime(o_orderdate, '%Y-%m-%d') || ' |Description: ' || o_orderstatus AS source FROM orders WHERE o_orderkey % 2 = 0",
)
def _(s, d):
    parsed = extract.parse_documents(records(s, d), "structured")
    made = search.parsed_as_events(parsed.withColumn("id", F.col("doc_id").cast("string")))
    return made.select(F.col("id").cast("long").alias("doc_id"), "title", "date", "source")


@_query("source_shown", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'from ' || o_orderstatus END AS source FROM orders")
def _(s, d):
    same = F.col("o_orderkey") % 3 == 0
    source = F.when(same, F.col("o_orderstatus")).otherwise(F.concat(F.lit("from "), F.col("o_orderstatus")))
    return _table(s, d, "orders").select("o_orderkey", text.source_shown(source, F.col("o_orderstatus")).alias("source"))


@_query("year_tabs", f"WITH {EVT} SELECT loc_ord, count(DISTINCT year_text) AS years, count(DISTINCT year_text) > 1 AS tabs_shown FROM evt GROUP BY loc_ord")
def _(s, d):
    return timeline.year_tabs(events(s, d), "loc_ord")


@_query("overlay_append_remove", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey <> 5 UNION ALL SELECT -s_suppkey, s_name FROM supplier")
def _(s, d):
    rows = _table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("enabled"))
    new = _table(s, d, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    return edits.deleted(timeline.added(rows, new), 5).select("id", "name")


@_query("selection_all_and_clear", "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS selected, 0::BIGINT AS left_over")
def _(s, d):
    every = edits.all_selected(_table(s, d, "documents"), "doc_id")
    return every.agg(F.count("*").alias("selected")).crossJoin(edits.cleared(every).agg(F.count("*").alias("left_over")))


def _made_id(*parts: str) -> str:
    """SQL of the id that is made of name, coordinates (1.0, 2.0) and what sets rows apart."""
    joined = " || chr(1) || ".join(["s_name", "'1.0,2.0'", *parts])
    return f"'location-' || substr(sha256({joined}), 1, 16)"


_NEW_PLACES = f"SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE {_made_id()} END AS id, s_name AS name, 0::BIGINT AS n FROM supplier WHERE s_suppkey % 5 <> 0"


@_query("new_location", _NEW_PLACES)
def _(s, d):
    key = F.col("s_suppkey")
    rows = _table(s, d, "supplier").select(
        F.when(key % 2 == 0, key.cast("string")).alias("id"), F.col("s_name").alias("name"), F.when(key % 5 != 0, F.array(F.lit(1.0), F.lit(2.0))).alias("coordinates"), F.lit(None).cast(LOCATION["events"].dataType).alias("events")
    )
    return documents.new_location(rows).select("id", "name", F.size("events").cast("long").alias("n"))


_REPEATED = "SELECT s_suppkey, 'Place ' || CAST(s_nationkey AS VARCHAR) AS s_name FROM supplier"


@_query(
    "create_with_events",
    f"""WITH {LOC}, {EVT}, p AS ({_REPEATED}), n AS (SELECT s_suppkey, count(evt_ord) AS n, any_value(s_name) AS s_name FROM p LEFT JOIN evt ON loc_ord = s_suppkey GROUP BY s_suppkey)
    SELECT id, name, 0::BIGINT AS n FROM loc UNION ALL SELECT {_made_id("CAST(s_suppkey AS VARCHAR)")}, s_name, n FROM n""",
)
def _(s, d):
    """Suppliers as new places with events; their names repeat, so their keys set them apart."""
    own = nested(s, d).select(F.col("loc_ord").alias("s_suppkey"), "events")
    rows = _table(s, d, "supplier").join(own, "s_suppkey", "left").select(
        F.lit(None).cast("string").alias("id"), F.concat(F.lit("Place "), F.col("s_nationkey").cast("string")).alias("name"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates"), "events", "s_suppkey"
    )
    made = documents.new_location(rows, ["s_suppkey"], ["s_suppkey"]).withColumnRenamed("s_suppkey", "loc_ord")
    old = locations(s, d).select("id", "name", F.array("lon", "lat").alias("coordinates"), F.array().cast(LOCATION["events"].dataType).alias("events"), "loc_ord")
    return edits.upserted(old, made.select(old.columns)).select("id", "name", F.size("events").cast("long").alias("n"))


@_query("new_overlay", "SELECT p_partkey AS id, trim(p_name) AS name, CASE WHEN p_partkey % 6 = 0 THEN 'http://t/' || p_partkey END AS annotation, CASE WHEN p_partkey % 6 <> 0 THEN 'http://t/' || p_partkey END AS tiles, 1800 AS year_from, 2000 AS year_to FROM part WHERE p_partkey % 7 <> 0")
def _(s, d):
    key = F.col("p_partkey")
    source = F.when(key % 6 == 0, "allmaps").otherwise("ohm")
    url = F.when(key % 7 == 0, "  ").otherwise(F.concat(F.lit(" http://t/"), key.cast("string")))
    made = timeline.new_overlay(_table(s, d, "part").select(key.cast("string").alias("id"), F.col("p_name").alias("name"), url.alias("url"), source.alias("source")))
    return made.select(F.col("id").cast("long").alias("id"), "name", F.col("annotationUrl").alias("annotation"), F.col("tileUrl").alias("tiles"), "year_from", "year_to")


@_query("shown_tags", "SELECT p_partkey, array_to_string(list_slice(string_split(p_name, ' '), 1, 2), ',') AS tags FROM part")
def _(s, d):
    return _table(s, d, "part").select("p_partkey", F.array_join(timeline.shown_tags(F.split("p_name", " ")), ",").alias("tags"))


@_query("location_ids", f"WITH {LOC} SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || right(lower(to_base(loc_ord * 7919 + 1700000000000, 36)), 4) AS location_id FROM loc")
def _(s, d):
    return locations(s, d).select("id", text.location_id(F.col("name"), F.col("loc_ord") * 7919 + 1700000000000).alias("location_id"))


@_query("counted", f"WITH {EVT} SELECT loc_ord, count(*) || ' event' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END AS shown FROM evt GROUP BY loc_ord")
def _(s, d):
    return events(s, d).groupBy("loc_ord").agg(text.counted(F.count("*"), "event").alias("shown"))


@_query("year_share", f"WITH {OVL} SELECT id, round((year_from - 1776) * 100.0::DOUBLE / 244, 6) AS share FROM ovl")
def _(s, d):
    return overlays(s, d).select("id", F.round(numbers.share_of(F.col("year_from"), 1776, 2020), 6).alias("share"))


@_query(
    "events_added",
    f"""WITH {LOC}, {EVT}, new AS (SELECT loc_ord, evt_ord + 1 AS evt_ord FROM evt)
    SELECT loc_ord, evt_ord, false AS added FROM evt JOIN loc USING (loc_ord)
    UNION ALL SELECT loc_ord, evt_ord, true FROM new JOIN loc USING (loc_ord) WHERE NOT EXISTS (SELECT 1 FROM evt WHERE evt.loc_ord = new.loc_ord AND evt.evt_ord = new.evt_ord)""",
)
def _(s, d):
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT.fields[2:]]
    made = F.struct((F.col("evt_ord") + 1).cast("string").alias("id"), F.lit("new").alias("title"), *nothing)
    incoming = events(s, d).select(F.col("loc_ord").cast("string").alias("location_id"), F.col("evt_ord").alias("ord"), made.alias("event"))
    rows = search.unnested(edits.events_added(nested(s, d), incoming))
    return rows.select("loc_ord", F.col("event.id").cast("long").alias("evt_ord"), (F.col("event.title") == "new").alias("added"))
