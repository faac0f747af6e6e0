"""Sinks and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import keys
from tallyhouse.operators import outputs, reading
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, SPANS, listings, today, utc_sql
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}


def _stamp(wall: str, more: str = "") -> str:
    return f"strftime({utc_sql(_ts(wall))}{more}, '%Y%m%dT%H%M%SZ')"


def _ts(wall: str) -> str:
    return f"CAST(replace({wall}, 'T', ' ') AS TIMESTAMP)"


def _iso(wall: str) -> str:
    return f"({wall} || ':00-0' || CAST(date_diff('hour', {_ts(wall)}, {utc_sql(_ts(wall))}) AS VARCHAR) || ':00')"


_ESC = r"regexp_replace(regexp_replace({}, '([\\;,])', '\\\1', 'g'), '\r?\n', '\\n', 'g')"


@query(QUERIES, LISTINGS + """ SELECT id, '"' || replace(title, '"', '""') || '","' || replace(price, '"', '""') || '","' || CASE WHEN lng < 0 THEN '''' ELSE '' END || CAST(CAST(lng AS INTEGER) AS VARCHAR) || '"' AS line FROM listings""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table for spreadsheets: quotes doubled, formulas disarmed."""
    return listings(spark, sf_dir).select("id", outputs.csv_line(F.col("title"), F.col("price"), F.round("lng").cast("int").cast("string")).alias("line"))


_LINES = ["'BEGIN:VEVENT'", "'UID:' || id || '@listings.example'", "'DTSTAMP:20240101T000000Z'", "CASE WHEN all_day THEN 'DTSTART;VALUE=DATE:' || strftime(start_day, '%Y%m%d') ELSE 'DTSTART:' || " + _stamp('"start"') + " END", "CASE WHEN all_day THEN 'DTEND;VALUE=DATE:' || strftime(last_day + 1, '%Y%m%d') ELSE 'DTEND:' || CASE WHEN span_end IS NOT NULL THEN " + _stamp("span_end") + " WHEN coalesce(end_wall, \"start\") <> \"start\" THEN " + _stamp("end_wall") + " ELSE " + _stamp('"start"', " + INTERVAL 2 HOUR") + " END END", "'SUMMARY:' || " + _ESC.format("title"), "'LOCATION:' || " + _ESC.format("concat_ws(', ', CASE WHEN venue <> '' THEN venue END, CASE WHEN city <> '' THEN city || ', MN' END)"), "'DESCRIPTION:' || " + _ESC.format("concat_ws(chr(10) || chr(10), CASE WHEN description <> '' THEN description END, 'More: https://listings.example/event/' || id)"), "'URL:https://listings.example/event/' || id", "'STATUS:' || CASE WHEN status = 'cancelled' THEN 'CANCELLED' ELSE 'CONFIRMED' END", "'END:VEVENT'"]


@query(QUERIES, SPANS.replace("WITH listings", "WITH RECURSIVE listings", 1) + ", x AS (SELECT id, [" + ", ".join(_LINES) + """] AS x FROM spans), u AS (SELECT id, generate_subscripts(x, 1) AS k, unnest(x) AS line FROM x),
    f AS (SELECT id, k, 0 AS j, line AS rest, '' AS piece FROM u UNION ALL SELECT id, k, j + 1, substr(rest, n + 1), left(rest, n) FROM (SELECT *, CASE WHEN octet_length(encode(rest)) <= CASE WHEN j = 0 THEN 75 ELSE 74 END THEN length(rest) ELSE list_max(list_filter(generate_series(1, 75), lambda i: octet_length(encode(left(rest, i))) <= CASE WHEN j = 0 THEN 75 ELSE 74 END)) END AS n FROM f WHERE rest <> ''))
    SELECT id, string_agg(CASE WHEN j > 1 THEN chr(13) || chr(10) || ' ' || piece WHEN k > 1 THEN chr(13) || chr(10) || piece ELSE piece END, '' ORDER BY k, j) AS event FROM f WHERE j > 0 GROUP BY id""")
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A VEVENT of each listing, lines folded at 75 bytes."""
    rows = reading.with_span(listings(spark, sf_dir))
    return rows.select("id", outputs.calendar_event(rows, "20240101T000000Z").alias("event"))


@query(QUERIES, SPANS + f""", x AS (SELECT *, CASE WHEN all_day THEN CAST(start_day AS VARCHAR) ELSE {_iso('"start"')} END AS b, CASE WHEN all_day THEN CASE WHEN left(coalesce(span_end, end_wall), 10) > left("start", 10) THEN left(coalesce(span_end, end_wall), 10) END WHEN span_end IS NOT NULL THEN {_iso('span_end')} WHEN coalesce(end_wall, "start") <> "start" THEN {_iso('end_wall')} END AS e,
    CASE price WHEN 'Free' THEN '0' WHEN '$12.50' THEN '12.5' WHEN '$25 - $80' THEN '25' WHEN '$120' THEN '120' END AS p FROM spans)
    SELECT id, title AS name, CASE WHEN status = 'cancelled' THEN 'https://schema.org/EventCancelled' ELSE 'https://schema.org/EventScheduled' END AS status, CASE WHEN lat <> 0 OR lng <> 0 THEN round(lat, 6) END AS lat, b AS start_date, e AS end_date, p AS price, CASE WHEN p IS NOT NULL THEN CASE WHEN url <> '' THEN url ELSE 'https://listings.example/event/' || id END END AS offer_url FROM x""")
def linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema.org documents of all listings, read again field by field."""
    rows = reading.with_span(listings(spark, sf_dir))
    d = rows.select("id", outputs.linked_data(rows).alias("doc"))
    at = lambda path: F.get_json_object("doc", f"$.{path}")
    return d.select("id", at("name").alias("name"), at("eventStatus").alias("status"), F.round(at("location.geo.latitude").cast("double"), 6).alias("lat"), at("startDate").alias("start_date"), at("endDate").alias("end_date"), at("offers.price").alias("price"), at("offers.url").alias("offer_url"))


@query(QUERIES, LISTINGS + """ SELECT round(min(lng), 6) AS west, round(min(lat), 6) AS south, round(max(lng), 6) AS east, round(max(lat), 6) AS north FROM listings WHERE venue <> ''""")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = outputs.bounds(listings(spark, sf_dir).where("venue <> ''"))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query(QUERIES, LISTINGS + """ SELECT DISTINCT unnest(['/day/' || CAST(start_day AS VARCHAR), '/cities/' || CASE WHEN city IN ('Saint Paul, MN', 'St. Paul') THEN 'st-paul' ELSE lower(city) END, CASE WHEN venue LIKE 'Hook%' THEN '/venues/hook-and-ladder-theater' WHEN venue = 'The Armory' THEN '/venues/armory' WHEN venue <> '' THEN '/venues/' || replace(lower(venue), ' ', '-') ELSE '/day/' || CAST(start_day AS VARCHAR) END]) AS path FROM listings, clock WHERE status = 'published' AND start_day >= today""")
def site_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a site map lists."""
    return outputs.site_map(reading.published(listings(spark, sf_dir)).where(F.col("start_day") >= F.lit(today(spark, sf_dir))))


_REPLY = "CASE WHEN id % 5 = 0 THEN 'I found nothing.' ELSE 'Here:' || {n} || '```json' || {n} || '[{{\"title\": \"' || CASE WHEN id % 7 = 0 THEN '' ELSE 'T' || CAST(id AS {s}) END || '\", \"start\": \"' || {d} || '\"}}, {{\"title\": \"second\"}}]' || {n} || '```' END"


@query(QUERIES, LISTINGS + """ SELECT id, 'T' || id AS title, CAST(start_day AS VARCHAR) AS start FROM listings WHERE id % 5 <> 0 AND id % 7 <> 0""")
def replied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the fenced JSON of replies; those without title or start are left out."""
    r = listings(spark, sf_dir).select("id", F.expr(_REPLY.format(n="'\\n'", s="STRING", d="CAST(start_day AS STRING)")).alias("reply"))
    rows = r.select("id", F.explode(outputs.fenced_json(F.col("reply"), "array<struct<title: string, start: string>>")).alias("x"))
    return rows.where("coalesce(x.title, '') <> '' AND coalesce(x.start, '') <> ''").select("id", "x.title", "x.start")


@query(QUERIES, """WITH h AS (SELECT event_id, event_id % 12 + 1 AS h, event_id % 60 AS m, event_id % 4 AS k FROM events) SELECT event_id, CASE k WHEN 3 THEN NULL WHEN 0 THEN lpad(CAST(h % 12 + 12 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN 1 THEN lpad(CAST(h % 12 AS VARCHAR), 2, '0') || ':00' ELSE '19:30' END AS time FROM h""")
def show_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Show times in pages of venues: the start before the doors."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12 + 1).alias("h"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0").alias("m"), (F.col("event_id") % 4).alias("k"))
    html = F.when(F.col("k") == 0, F.concat(F.lit("<p>Doors open: 6 PM</p><p>Show starts: "), "h", F.lit(":"), "m", F.lit(" P.M.</p>"))).when(F.col("k") == 1, F.concat(F.lit("<b>Show: "), "h", F.lit("am</b>"))).when(F.col("k") == 2, "<i>doors 7:30pm</i>").otherwise("<i>tba</i>")
    return e.select("event_id", outputs.show_time(html).alias("time"))


@query(QUERIES, r"SELECT page_id, CAST(length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS INTEGER) AS chars FROM pages")
def page_text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much text pages hold without tags and entities."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(outputs.plain_text(F.col("html"))).alias("chars"))


@query(QUERIES, LISTINGS + ", r AS (SELECT id, round(lat, 5) AS lat, round(lng, 5) AS lng, title FROM listings) SELECT lat, lng, arg_min(title, id) AS name FROM r GROUP BY ALL")
def distinct_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name a spot, the first of them."""
    return outputs.rounded_places(listings(spark, sf_dir).select(F.col("id").alias("pos"), F.col("title").alias("name"), "lat", "lng"))


@query(QUERIES, LISTINGS + """ SELECT id, CASE WHEN url = '' THEN '' WHEN url LIKE '%cal?id%' THEN url || '&ref=site' ELSE url || '?ref=site' END AS url FROM listings""")
def affiliate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with a parameter of ours; never a second one."""
    url = F.col("url")
    once = F.when(url == "", url).otherwise(keys.with_parameter(url, "ref", "site"))
    return listings(spark, sf_dir).select("id", F.when(url == "", url).otherwise(keys.with_parameter(once, "ref", "other")).alias("url"))


@query(QUERIES, LISTINGS + """ SELECT id, 'https://www.google.com/maps/dir/?api=1&destination=' || replace(replace(replace(city || ', MN', ',', '%2C'), ' ', '%20'), '''', '%27') AS url FROM listings""")
def direction_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", keys.directions_url(F.col("venue"), F.lit(""), F.col("city"), F.col("lat"), F.col("lng")).alias("url"))
