"""Small reads and helpers around listings, subscribers and places."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions import keys, spans
from tallyhouse.functions import text as X
from tallyhouse.operators import reading
from tallyhouse.operators.curation import open_in
from tallyhouse.operators.ranking import first_per
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.curation import PLACES, _places
from tallyhouse.plans.fixture import LISTINGS, SPANS, listings, today
from tallyhouse.plans.ledger import SUBSCRIBERS, _subscribers
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}


@query(QUERIES, SUBSCRIBERS + " SELECT source, count(*) AS n FROM subscribers WHERE status = 'subscribed' AND created_day >= DATE '2024-03-30' - 7 GROUP BY 1")
def new_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers of the last seven days by source."""
    return _subscribers(spark, sf_dir).where("status = 'subscribed' AND created_day >= DATE '2024-03-23'").groupBy("source").agg(F.count("*").alias("n"))


@query(QUERIES, SUBSCRIBERS + " SELECT id, email, saver FROM subscribers WHERE status = 'subscribed'")
def digest_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who gets the digest, by id."""
    return _subscribers(spark, sf_dir).where("status = 'subscribed'").orderBy("id").select("id", "email", "saver")


@query(QUERIES, LISTINGS + ", s AS (SELECT max(start_day) AS last FROM listings WHERE status = 'archived') SELECT CAST(today - last AS INTEGER) AS days_since, today - last >= 8 AS stale FROM s, clock")
def days_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the last archived listing, which stands for the last digest sent; stale from eight on."""
    last = listings(spark, sf_dir).where("status = 'archived'").agg(F.max("start_day").alias("last"))
    days = F.datediff(F.lit(today(spark, sf_dir)), "last")
    return last.select(days.alias("days_since"), (days >= 8).alias("stale"))


@query(QUERIES, LISTINGS + " SELECT status, category, count(*) AS n FROM listings GROUP BY ALL")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy("status", "category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status", "category")


@query(QUERIES, LISTINGS + ", s AS (SELECT DISTINCT l_suppkey % 150 AS token, l_orderkey AS id FROM lineitem), u AS (SELECT 't' || token AS saver, token FROM s GROUP BY ALL) SELECT token, l.id, row_number() OVER (PARTITION BY token ORDER BY l.\"start\", l.id) AS pos FROM s JOIN listings l USING (id), clock WHERE status = 'published' AND start_day BETWEEN today AND today + 13 QUALIFY pos <= 5")
def personal_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each token up to five of its saved listings that start within two weeks, the soonest first."""
    now = today(spark, sf_dir)
    soon = reading.published(listings(spark, sf_dir)).where(F.col("start_day").between(F.lit(now), F.lit(now + timedelta(days=13)))).select("id", "start")
    pos = F.row_number().over(Window.partitionBy("token").orderBy("start", "id"))
    return reading.saves(spark, sf_dir).join(soon, "id").withColumn("pos", pos).where("pos <= 5").select("token", "id", "pos")


@query(QUERIES, LISTINGS + """, v AS (SELECT *, CASE WHEN venue = 'First Ave' THEN 'first avenue' WHEN venue = 'The Armory' THEN 'armory' WHEN venue = '7th St Entry' THEN '7th street entry' WHEN venue = 'Palace Theater' THEN 'palace theatre' WHEN venue = 'Xcel Energy Ctr' THEN 'xcel energy center' WHEN venue LIKE 'Hook%' THEN 'hook ladder theater mission room' ELSE lower(venue) END AS vkey FROM listings WHERE status <> 'draft' AND venue <> '')
    SELECT vkey, count(*) AS all_time, min(start_day) AS first_day, count(*) FILTER (WHERE status = 'published' AND start_day >= today) AS upcoming, min("start") FILTER (WHERE status = 'published' AND start_day >= today) AS next FROM v, clock GROUP BY 1""")
def venue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a venue has had, and what is to come, in one pass."""
    live = (F.col("status") == "published") & (F.col("start_day") >= F.lit(today(spark, sf_dir)))
    rows = listings(spark, sf_dir).where("status <> 'draft' AND venue <> ''").withColumn("vkey", keys.venue_key(F.col("venue")))
    return rows.groupBy("vkey").agg(F.count("*").alias("all_time"), F.min("start_day").alias("first_day"), F.count_if(live).alias("upcoming"), F.min(F.when(live, F.col("start"))).alias("next"))


@query(QUERIES, PLACES + " SELECT city, slug, row_number() OVER (PARTITION BY city ORDER BY slug) AS pos FROM places WHERE kind IN ('beach', 'trail', 'garden') QUALIFY pos <= 4")
def related_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four outdoor places of each city, by name."""
    p = first_per(_places(spark, sf_dir).where(F.col("kind").isin("beach", "trail", "garden")), ["city"], [F.col("slug")], 4)
    return p.withColumn("pos", F.row_number().over(Window.partitionBy("city").orderBy("slug"))).select("city", "slug", "pos")


@query(QUERIES, PLACES + ", o AS (SELECT kind, bool_or(CASE WHEN open_month IS NULL THEN true WHEN open_month <= close_month THEN 7 BETWEEN open_month AND close_month ELSE 7 >= open_month OR 7 <= close_month END) AS open, min(open_month) AS first FROM places WHERE open_month IS NOT NULL GROUP BY 1) SELECT kind, CASE WHEN NOT open THEN 'Closed for the season: back from month ' || first END AS banner FROM o")
def season_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kind's page says when all its seasonal places are closed in July."""
    o = _places(spark, sf_dir).where("open_month IS NOT NULL").groupBy("kind").agg(F.bool_or(open_in(7, F.col("open_month"), F.col("close_month"))).alias("open"), F.min("open_month").alias("first"))
    return o.select("kind", F.when(~F.col("open"), F.concat(F.lit("Closed for the season: back from month "), F.col("first").cast("string"))).alias("banner"))


@query(QUERIES, SPANS + ", d AS (SELECT DISTINCT start_day AS day FROM listings), c AS (SELECT day, today + 2 AS a, today + 9 AS z FROM d, clock) SELECT day, CASE WHEN day BETWEEN a AND z THEN 'in' ELSE 'out' END AS state FROM c")
def day_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a calendar's cells lie in a window."""
    now = today(spark, sf_dir)
    inside = F.col("day").between(F.lit(now + timedelta(days=2)), F.lit(now + timedelta(days=9)))
    return listings(spark, sf_dir).select(F.col("start_day").alias("day")).distinct().withColumn("state", F.when(inside, "in").otherwise("out"))


_WEEK = "strftime(today, '%B ') || CAST(day(today) AS VARCHAR) || ' – ' || CASE WHEN month(today) = month(today + 6) THEN '' ELSE strftime(today + 6, '%B ') END || CAST(day(today + 6) AS VARCHAR)"


@query(QUERIES, LISTINGS + f" SELECT {_WEEK} AS label, count(*) AS n, count(DISTINCT category) AS categories FROM listings, clock WHERE status = 'published' AND start_day BETWEEN today AND today + 6 GROUP BY ALL")
def digest_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's label with how much it holds."""
    now = today(spark, sf_dir)
    first, last = F.lit(now), F.lit(now + timedelta(days=6))
    label = F.concat(F.date_format(first, "MMMM d"), F.lit(" – "), F.when(F.month(first) == F.month(last), F.date_format(last, "d")).otherwise(F.date_format(last, "MMMM d")))
    week = reading.published(listings(spark, sf_dir)).where(F.col("start_day").between(first, last))
    return week.agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories")).select(label.alias("label"), "n", "categories")


@query(QUERIES, LISTINGS + """ SELECT id, substr(sha256(CASE WHEN title LIKE 'The Show%' THEN 'show ' || (owner % 53) WHEN title LIKE 'Show % vs%' THEN 'show ' || (owner % 53) || ' vs foo' WHEN title LIKE 'Café%' THEN 'cafe night ' || (owner % 53) || ' opening weekend' WHEN title LIKE 'Sever%' THEN lower(replace(title, '''', '')) WHEN title LIKE 'Jazz%' THEN 'jazz blues ' || (owner % 53) ELSE lower(title) END || '|' ||
    CASE WHEN venue = 'First Ave' THEN 'first avenue' WHEN venue = 'The Armory' THEN 'armory' WHEN venue = '7th St Entry' THEN '7th street entry' WHEN venue = 'Palace Theater' THEN 'palace theatre' WHEN venue = 'Xcel Energy Ctr' THEN 'xcel energy center' WHEN venue LIKE 'Hook%' THEN 'hook ladder theater mission room' ELSE lower(venue) END || '|' || CAST(start_day AS VARCHAR)), 1, 32) AS key FROM listings""")
def listing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact-duplicate keys of listings: brackets, accents, versus forms and venue names folded."""
    return listings(spark, sf_dir).select("id", X.listing_key(F.col("title"), F.col("venue"), F.col("start_day")).alias("key"))


@query(QUERIES, LISTINGS + """, s AS (SELECT id, title, 'See listing' AS price, start_day FROM listings WHERE status = 'draft') SELECT id, 'published' AS status, '$$' AS tier, CAST(44.9778 AS DOUBLE) AS lat, strftime(start_day, '%Y-%m-%d') || 'T19:30' AS start, strftime(start_day + 1, '%Y-%m-%d') || 'T01:00' AS "end" FROM s""")
def approved_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts as they would be published: priced, placed at the centre without coordinates, their end past midnight."""
    rows = listings(spark, sf_dir).where("status = 'draft'")
    end = spans.end_local(F.col("start_day"), F.lit("19:30"), F.lit("01:00"))
    return rows.select("id", F.lit("published").alias("status"), X.price_tier(F.lit("See listing")).alias("tier"), F.lit(44.9778).alias("lat"), F.concat(F.col("start_day").cast("string"), F.lit("T19:30")).alias("start"), end.alias("end"))


@query(QUERIES, "WITH e AS (SELECT event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT event_type, n, last >= now - INTERVAL 1 HOUR AS fresh FROM e, m")
def section_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose latest row is under an hour old."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    now = F.broadcast(e.agg(F.max("last").alias("now")))  # one row
    return e.join(now, F.lit(True)).select("event_type", "n", (F.col("last") >= F.col("now") - F.expr("INTERVAL 1 HOUR")).alias("fresh"))
