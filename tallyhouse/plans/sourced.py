"""League schedules and venue calendars read from bodies that are written from lineitem and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.text import key_part, url_host
from tallyhouse.plans.base import Registered, query
from tallyhouse.sources import feed_bodies
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}

# A supplier is a team, its lines are games, a month of them is a reply; the supplier's number decides the feed's shape, and some replies are cut off.


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, seq, shape, who, body)."""
    x = table(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL")
    minutes = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1440
    at = F.to_timestamp(F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))) + F.make_dt_interval(mins=minutes.cast("int"))
    shape = F.element_at(F.array(*map(F.lit, feed_bodies.SHAPES)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    own = F.struct(F.col("l_suppkey").alias("id"), F.concat(F.lit("Team "), "l_suppkey").alias("name"), F.concat(F.lit("T"), "l_suppkey").alias("abbrev"))
    no = (F.col("l_partkey") % 7).cast("string")
    g = x.select(
        F.col("l_suppkey").alias("team"), F.date_format("l_shipdate", "yyyy-MM").alias("seq"), shape.alias("shape"), own.alias("own"), "l_orderkey", "l_linenumber",
        at.alias("at"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("stated"), no.alias("no"), (F.col("l_linenumber") % 2 == 0).alias("home"),
        (F.col("l_orderkey") % 11 == 0).alias("tbd"), (F.col("l_partkey") % 9 == 0).alias("pre"),
    )
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm'Z'")
    sides = lambda ours, theirs: (F.when(F.col("home"), ours).otherwise(theirs), F.when(F.col("home"), theirs).otherwise(ours))
    h0, a0 = sides(F.struct(F.struct(F.col("own.id").alias("id"), F.col("own.name").alias("name")).alias("team")), F.struct(F.struct(F.lit(-1).cast("bigint").alias("id"), F.concat(F.lit("Opponent "), "no").alias("name")).alias("team")))
    dates = F.to_json(F.struct(F.col("stated").alias("date"), F.array(F.struct(iso.alias("gameDate"), F.when(F.col("pre"), "S").otherwise("R").alias("gameType"), F.struct(F.col("tbd").alias("startTimeTBD")).alias("status"), F.struct(h0.alias("home"), a0.alias("away")).alias("teams"))).alias("games")))
    club = lambda abbrev, place, common: F.struct(abbrev.alias("abbrev"), F.struct(place.alias("default")).alias("placeName"), F.struct(common.alias("default")).alias("commonName"))
    h1, a1 = sides(club(F.col("own.abbrev"), F.lit("Here"), F.lit("We")), club(F.concat(F.lit("O"), "no"), F.when(F.col("no") != "3", F.concat(F.lit("Place "), "no")), F.when(~F.col("no").isin("3", "4"), F.concat(F.lit("Name "), "no"))))
    games = F.to_json(F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startTimeUTC"), F.col("stated").alias("gameDate"), F.when(F.col("pre"), 1).otherwise(2).alias("gameType"), h1.alias("homeTeam"), a1.alias("awayTeam")))
    side = lambda where, name: F.struct(F.lit(where).alias("homeAway"), F.struct(name.alias("displayName")).alias("team"))
    h2, a2 = sides(F.col("own.name"), F.concat(F.lit("Opponent "), "no"))
    events = F.to_json(F.struct(iso.alias("date"), F.array(F.struct((~F.col("tbd")).alias("timeValid"), F.array(side("away", a2), side("home", h2)).alias("competitors"))).alias("competitions")))
    item = F.when(F.col("shape") == "dates", dates).when(F.col("shape") == "games", games).otherwise(events)
    listed = g.withColumn("item", item).groupBy("team", "seq", "shape", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "item"))), lambda s: s["item"]), ",").alias("items"))
    who = F.when(F.col("shape") == "dates", F.col("own.id").cast("string")).when(F.col("shape") == "games", F.col("own.abbrev")).otherwise(F.col("own.name"))
    body = F.concat(F.lit('{"'), "shape", F.lit('": ['), "items", F.when((F.col("team") % 17 == 5) & F.col("seq").endswith("-03"), "").otherwise("]}"))
    return listed.select("team", "seq", "shape", who.alias("who"), body.alias("body"))


_GAMES = """WITH b AS (SELECT l_suppkey AS team, strftime(l_shipdate, '%Y-%m') AS seq, l_orderkey AS o, l_linenumber AS ln, CAST(l_shipdate AS DATE)::TIMESTAMP + to_minutes((l_orderkey * 37 + l_linenumber * 11) % 1440) AS moment, strftime(l_shipdate, '%Y-%m-%d') AS stated,
        l_suppkey % 3 AS shape, CAST(l_partkey % 7 AS VARCHAR) AS no, l_linenumber % 2 = 0 AS home, l_orderkey % 11 = 0 AS tbd, l_partkey % 9 = 0 AS pre FROM lineitem),
    w AS (SELECT *, strftime(timezone('America/Chicago', timezone('UTC', moment)), '%Y-%m-%dT%H:%M') AS wall, strftime(timezone('America/New_York', timezone('UTC', moment)), '%Y-%m-%d') AS eastern FROM b),
    f AS (SELECT *, shape <> 1 AND tbd OR CAST(substr(wall, 12, 2) AS INT) < 7 AS open_ FROM w),
    d AS (SELECT *, CASE WHEN NOT open_ THEN left(wall, 10) WHEN shape = 2 THEN eastern ELSE stated END AS day, CASE WHEN shape <> 1 THEN 'Opponent ' || no WHEN no = '3' THEN 'O3' WHEN no = '4' THEN 'Place 4' ELSE 'Place ' || no || ' Name ' || no END AS opponent FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY team, day, opponent, home ORDER BY seq, o, ln) AS k FROM d),
    bad AS (SELECT DISTINCT team, seq FROM b WHERE team % 17 = 5 AND seq LIKE '%-03')"""


@query(QUERIES, _GAMES + """ SELECT team, day, CASE WHEN open_ THEN day || 'T00:00' ELSE wall END AS "start", opponent, home, pre AND shape <> 2 AS preseason, open_ AS tbd FROM n WHERE k = 1 AND team NOT IN (SELECT team FROM bad)""")
def league_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of every team whose replies can all be read, from three shapes of JSON."""
    return feed_bodies.schedules(replies(spark, sf_dir))


@query(QUERIES, _GAMES + " SELECT team, seq FROM bad")
def unreadable_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are no JSON of their shape."""
    return feed_bodies.bad_replies(replies(spark, sf_dir)).select("team", "seq")


def month_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): month pages of a venue calendar, fifty pages' titles each. Some shows come before any day, some have no venue."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = table(spark, sf_dir, "pages").where("page_id IS NOT NULL AND url IS NOT NULL").select("page_id", url_host(F.col("url")).alias("host"), F.replace("url", F.lit('"'), F.lit("%22")).alias("url"), title.alias("title"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int"))
    mark = F.when(F.col("page_id") % 50 == 0, "").otherwise(F.concat(F.lit('<div id="day-'), F.date_format(day, "yyyy-M-d"), F.lit('">\n')))
    venue = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit('<div class="venue_name">\n  '), "host", F.lit(" </div>")))
    heading = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<em>Someone presents</em><BR />"), "title")).otherwise(F.col("title"))
    show = F.concat(mark, F.lit('<div class="show_list_item" data-x="1">'), venue, F.lit('<h4 class="t"> <a href="'), "url", F.lit('">'), heading, F.lit("</a></h4>"), venue, F.lit("</div>\n"))
    rows = p.select(F.expr("page_id div 50").alias("month"), F.struct("page_id", show.alias("show")).alias("s"))
    return rows.groupBy(F.col("month").alias("page_id")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["show"]), ""), F.lit("</body></html>")).alias("html"))


_SHOWN = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://(?:www\.)?([^/:?#]+)', 1) AS venue, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages),
    s AS (SELECT page_id, page_id // 50 AS calendar, DATE '2024-01-01' + CAST(page_id % 60 AS INT) AS day, venue, replace(url, '"', '%22') AS url, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(t, '\s+', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&#38;', '&'), '&#8217;', chr(39)), '\s+', ' ', 'g')) AS title FROM p WHERE page_id % 50 <> 0 AND page_id % 7 <> 0),
    q AS (SELECT *, CASE WHEN title = '' AND page_id % 3 = 0 THEN 'Someone presents' ELSE title END AS shown FROM s)"""


@query(QUERIES, _SHOWN + " SELECT calendar, day, venue, shown AS title, url FROM q WHERE shown <> ''")
def venue_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows of all month pages."""
    return feed_bodies.calendar_shows(month_pages(spark, sf_dir)).select(F.col("page_id").alias("calendar"), "day", "venue", "title", "url")


@query(QUERIES, _SHOWN + r""", k AS (SELECT *, row_number() OVER (PARTITION BY lower(venue), day, trim(regexp_replace(regexp_replace(strip_accents(lower(shown)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) ORDER BY calendar, page_id) AS n FROM q WHERE shown <> '') SELECT day, venue, shown AS title, url FROM k WHERE n = 1""")
def shows_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows of all month pages, one of each billing in a room on a day."""
    shows = feed_bodies.calendar_shows(month_pages(spark, sf_dir))
    return feed_bodies.each_show_once(shows, key_part(F.col("title")), ["page_id", "pos"]).select("day", "venue", "title", "url")
