"""Writes and checks, exercised on customers as subscribers and on orders as listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.keys import normal_url, source_label
from tallyhouse.functions.text import is_email
from tallyhouse.operators import ledger
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, listings, today
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
#: Fixed values of this fixture: customers stand for subscribers, suppliers for requests.
_SUBSCRIBER = {
    "id": "c_custkey",
    "email": "CASE CAST(c_custkey % 9 AS INT) WHEN 8 THEN 'no at ' || CAST(c_custkey AS STRING) ELSE 'u' || CAST(c_custkey AS STRING) || '@example.org' END",
    "status": "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'unsubscribed' ELSE 'subscribed' END",
    "left_once": "c_custkey % 4 = 1 OR c_custkey % 8 = 0",
    "saver": "CASE WHEN c_custkey % 3 = 0 THEN 't' || CAST(c_custkey AS STRING) END",
    "source": "CASE CAST(c_nationkey % 6 AS INT) WHEN 0 THEN 'home' WHEN 1 THEN 'this-week' WHEN 2 THEN 'venue-page' WHEN 3 THEN '' WHEN 4 THEN 'spring-fair' ELSE 'site' END",
    "created_day": "DATE '2024-01-01' + CAST(c_custkey % 90 AS INT)",
}
SUBSCRIBERS = "WITH subscribers AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SUBSCRIBER.items()) + " FROM customer), requests AS (SELECT s_suppkey * 7 AS id, ' U' || CAST(s_suppkey * 7 AS STRING) || '@Example.org' AS email FROM supplier UNION ALL SELECT s_suppkey, 'wrong' || CAST(s_suppkey AS STRING) FROM supplier)"


def _subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in _SUBSCRIBER.items()])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.selectExpr("s_suppkey * 7 AS id", "' U' || CAST(s_suppkey * 7 AS STRING) || '@Example.org' AS email").unionByName(s.selectExpr("s_suppkey AS id", "'wrong' || CAST(s_suppkey AS STRING) AS email"))


@query(QUERIES, SUBSCRIBERS + """ SELECT r.email, s.status AS before, CASE WHEN r.email NOT LIKE '%@%' THEN NULL WHEN s.left_once AND s.status <> 'subscribed' THEN 'pending' ELSE 'subscribed' END AS status,
    CASE WHEN r.email NOT LIKE '%@%' THEN 'invalid' WHEN s.email IS NULL THEN 'added' WHEN s.left_once AND s.status <> 'subscribed' THEN 'reconfirm' WHEN s.status = 'subscribed' THEN 'already' ELSE 'resubscribed' END AS result FROM (SELECT DISTINCT lower(trim(email)) AS email FROM requests) r LEFT JOIN subscribers s ON s.email = r.email""")
def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each request to subscribe."""
    return ledger.subscribe(_subscribers(spark, sf_dir).withColumnRenamed("left_once", "left"), _requests(spark, sf_dir))


@query(QUERIES, SUBSCRIBERS + " SELECT r.id, CASE s.status WHEN 'pending' THEN 'confirmed' WHEN 'subscribed' THEN 'already' ELSE 'expired' END AS result FROM (SELECT DISTINCT id FROM requests) r LEFT JOIN subscribers s ON s.id = r.id")
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.confirm(_subscribers(spark, sf_dir), _requests(spark, sf_dir))


@query(QUERIES, SUBSCRIBERS + " SELECT id, CASE WHEN id IN (SELECT id FROM requests) THEN 'unsubscribed' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM requests) AND status <> 'unsubscribed' THEN NULL ELSE saver END AS saver FROM subscribers")
def unsubscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscribers after those named have left."""
    return ledger.unsubscribe(_subscribers(spark, sf_dir), _requests(spark, sf_dir))


@query(QUERIES, SUBSCRIBERS + """, n AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE created_day > DATE '2024-03-30' - 30) AS last30 FROM subscribers WHERE status = 'subscribed' GROUP BY 1)
    SELECT source, CASE source WHEN 'home' THEN 'Homepage' WHEN 'this-week' THEN 'This Week page' WHEN 'venue-page' THEN 'Venue pages' WHEN 'site' THEN 'Direct / other' WHEN '' THEN 'Direct / other' ELSE 'Spring Fair' END AS label, total, last30, CAST(floor(total / sum(total) OVER () * 100 + 0.5) AS BIGINT) AS share FROM n""")
def subscriber_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where subscribers came from, with labels, the last thirty days and the share in whole percents."""
    n = _subscribers(spark, sf_dir).where("status = 'subscribed'").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("created_day") > F.lit("2024-02-29").cast("date")).alias("last30"))
    share = F.floor(F.col("total") / F.sum("total").over(Window.partitionBy()) * 100 + F.lit(0.5))
    return n.select("source", source_label(F.col("source")).alias("label"), "total", "last30", share.alias("share"))


@query(QUERIES, SUBSCRIBERS + " SELECT id, email LIKE '%@%' AS valid FROM subscribers")
def valid_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subscribers(spark, sf_dir).select("id", is_email(F.col("email")).alias("valid"))


_SAVED = "WITH s AS (SELECT l_suppkey % 40 AS token, l_orderkey AS id, CAST(l_shipdate AS DATE) AS since FROM lineitem WHERE l_returnflag = 'A'), w AS (SELECT l_suppkey % 40 AS token, l_orderkey AS id, CAST(l_shipdate AS DATE) AS since FROM lineitem WHERE l_returnflag <> 'A'), saved AS (SELECT token, id, min(since) AS since FROM s GROUP BY ALL)"


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("token"), F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("since"), "l_returnflag")
    return rows.where("l_returnflag = 'A'").groupBy("token", "id").agg(F.min("since").alias("since")), rows.where("l_returnflag <> 'A'").drop("l_returnflag")


@query(QUERIES, _SAVED + ", f AS (SELECT token, id, min(since) AS since FROM w WHERE (token, id) NOT IN (SELECT (token, id) FROM saved) GROUP BY ALL), n AS (SELECT f.*, row_number() OVER (PARTITION BY f.token ORDER BY f.since, f.id) + coalesce(h.have, 0) AS n FROM f LEFT JOIN (SELECT token, count(*) AS have FROM saved GROUP BY 1) h ON h.token = f.token) SELECT token, id, since FROM saved UNION ALL SELECT token, id, since FROM n WHERE n <= 300")
def saves_up_to_the_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each token has saved after more saves: each listing once, 300 at most."""
    return ledger.save(*_saved(spark, sf_dir))


@query(QUERIES, _SAVED + " SELECT token, id, since FROM saved WHERE (token, id) NOT IN (SELECT (token, id) FROM w)")
def saves_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unsave(*_saved(spark, sf_dir))


@query(QUERIES, _SAVED + " SELECT CASE WHEN token < 20 THEN token + 20 ELSE token END AS token, id, min(since) AS since FROM saved GROUP BY ALL")
def merged_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saves of half of the tokens moved to others."""
    links = spark.range(20).selectExpr("id AS old", "id + 20 AS new")
    return ledger.merge_tokens(_saved(spark, sf_dir)[0], links)


@query(QUERIES, LISTINGS + """ SELECT status, n FROM (SELECT CASE WHEN status = 'published' AND CAST(left(coalesce(multi_day_end, end_wall, "start"), 10) AS DATE) < today THEN 'archived' ELSE status END AS status, count(*) AS n FROM listings, clock GROUP BY 1)""")
def statuses_after_archiving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings of each status there are once the past is archived."""
    return ledger.archive_past(listings(spark, sf_dir), today(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


_SENT = """ AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'ab' ELSE title END AS title, CASE WHEN id % 19 = 0 THEN 'opera' ELSE category END AS category, CASE WHEN id % 23 = 0 THEN '2024-02-31' ELSE CAST(start_day AS STRING) END AS date,
    CASE WHEN id % 29 = 0 THEN '24:00' ELSE substr({start}, 12, 5) END AS time, CASE WHEN id % 31 = 0 THEN '7pm' ELSE '' END AS end_time, venue, CASE WHEN id % 37 = 0 THEN ' ' ELSE city END AS city, repeat('a', CAST(id % 170 AS INT)) AS address,
    CASE WHEN id % 41 = 0 THEN 'localhost' WHEN id % 43 = 0 THEN 'tickets.example/x' ELSE url END AS url, repeat('d', CAST(id % 1010 AS INT)) AS description, CASE WHEN id % 47 = 0 THEN 'me@here' WHEN id % 53 = 0 THEN ' A@b.org ' ELSE '' END AS email FROM listings)"""
_DAY = "(CASE WHEN id % 23 = 0 THEN NULL ELSE CAST(date AS DATE) END)"


@query(QUERIES, LISTINGS + ", sent" + _SENT.format(start='"start"') + f""", e AS (SELECT id, list_filter(['title ' || CASE WHEN length(trim(title)) < 3 THEN 'short' WHEN length(trim(title)) > 140 THEN 'long' END, 'category ' || CASE WHEN category = 'opera' THEN 'unknown' END,
    'date ' || CASE WHEN {_DAY} IS NULL THEN 'invalid' WHEN {_DAY} < today THEN 'past' WHEN {_DAY} > today + 400 THEN 'far' END, 'time ' || CASE WHEN time = '24:00' THEN 'invalid' END, 'end_time ' || CASE WHEN end_time = '7pm' THEN 'invalid' END, 'venue ' || CASE WHEN venue = '' THEN 'missing' END, 'city ' || CASE WHEN trim(city) = '' THEN 'missing' END,
    'address ' || CASE WHEN length(address) > 160 THEN 'long' END, 'url ' || CASE WHEN url = 'localhost' THEN 'invalid' END, 'description ' || CASE WHEN length(description) > 1000 THEN 'long' END, 'email ' || CASE WHEN email = 'me@here' THEN 'invalid' END], lambda x: x IS NOT NULL) AS errors FROM sent, clock) SELECT id, array_to_string(list_sort(errors), ', ') AS errors FROM e""")
def submission_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each submission, by field."""
    sent = _SENT.format(start="start").removeprefix(" AS (").removesuffix(")")
    rows = spark.sql(sent.replace("FROM listings", "FROM {rows}"), rows=listings(spark, sf_dir))
    e = rows.select("id", ledger.submission_errors(today(spark, sf_dir)).alias("e"))
    return e.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("e"), lambda x: F.concat_ws(" ", x["key"], x["value"]))), ", ").alias("errors"))


_HEX = "substr(md5(CAST(event_id AS {0})), 1, 8) || '-' || substr(md5(CAST(event_id AS {0})), 9, 4) || CASE WHEN event_id % 7 = 0 THEN '' ELSE '-' END || '4abc-8ABC-' || substr(md5(CAST(event_id AS {0})), 13, 12)"


@query(QUERIES, f"WITH b AS (SELECT event_id, event_type, {_HEX.format('VARCHAR')} AS listing FROM events) SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'listing' WHEN event_type NOT IN ('view', 'click') THEN 'action' END AS refusal FROM b")
def refused_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why beacons are refused: a listing that is no UUID, an action that is not on the list."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS action", f"{_HEX.format('STRING')} AS listing")
    return e.select("event_id", ledger.beacon_refusal(("view", "click")).alias("refusal"))


@query(QUERIES, f"WITH r AS (SELECT event_id, {_HEX.format('VARCHAR')} AS listing, event_type, CAST(value AS INTEGER) AS v FROM events) SELECT event_id, concat_ws(', ', CASE WHEN event_id % 5 = 0 THEN 'email invalid' END, CASE WHEN event_type = 'error' THEN 'kind unknown' END, CASE WHEN event_id % 7 = 0 THEN 'listing invalid' END, CASE WHEN event_id % 13 = 0 THEN 'reason missing' END) AS errors FROM r")
def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each report, by field."""
    r = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS kind", f"{_HEX.format('STRING')} AS listing", "CASE WHEN event_id % 13 = 0 THEN '  ' ELSE 'because' END AS reason", "CASE WHEN event_id % 5 = 0 THEN 'a b@c.d' ELSE '' END AS email")
    e = r.select("event_id", ledger.report_errors(("view", "click", "purchase", "signup")).alias("e"))
    return e.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("e"), lambda x: F.concat_ws(" ", x["key"], x["value"]))), ", ").alias("errors"))


_VERDICTS = "SELECT id, CASE CAST(id % 6 AS INT) WHEN 0 THEN 'cancelled' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'moved' WHEN 4 THEN 'sold_out' ELSE 'not_found' END AS verdict, CASE WHEN id % 6 = 0 THEN ' page says so ' ELSE ' ' END AS evidence, CASE WHEN id % 9 = 3 THEN '2024-01-01T20:00' END AS new_start FROM {}"


@query(QUERIES, LISTINGS + f", v AS ({_VERDICTS.format('listings')}), a AS (SELECT id, CASE WHEN verdict = 'confirmed' THEN 'confirm' WHEN verdict = 'cancelled' AND trim(evidence) <> '' THEN 'cancel' ELSE 'flag' END AS action FROM v) SELECT l.id, CASE WHEN action = 'cancel' AND status = 'published' THEN 'cancelled' ELSE status END AS status, CASE WHEN action = 'confirm' THEN 'now' ELSE 'before' END AS verified_at FROM listings l JOIN a USING (id)")
def verified_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings after the verdicts of a check: only evidence cancels."""
    rows = listings(spark, sf_dir).withColumn("verified_at", F.lit("before"))
    return ledger.apply_actions(rows, ledger.verdict_actions(spark.sql(_VERDICTS.format("{rows}"), rows=rows)), F.lit("now"))[0].select("id", "status", "verified_at")


@query(QUERIES, LISTINGS + f", v AS ({_VERDICTS.format('listings')}) SELECT id, CASE WHEN id % 6 = 0 THEN 'verify_cancel' ELSE 'verify_flag' END AS action, CASE verdict WHEN 'cancelled' THEN CASE WHEN id % 6 = 0 THEN 'page says so' ELSE 'cancelled without evidence' END WHEN 'moved' THEN coalesce('source shows ' || new_start, 'time appears changed') WHEN 'sold_out' THEN 'sold out' ELSE 'source page not found' END AS note FROM v WHERE verdict <> 'confirmed'")
def verification_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return ledger.apply_actions(rows, ledger.verdict_actions(spark.sql(_VERDICTS.format("{rows}"), rows=rows)))[1]


@query(QUERIES, LISTINGS + " SELECT id, 'status' AS field, status AS before, 'published' AS after FROM listings WHERE id % 50 = 0 AND status <> 'published' UNION ALL SELECT id, 'price', price, 'Free' FROM listings WHERE id % 50 = 0 AND id % 20 = 10 AND price <> 'Free'")
def edit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a batch of edits: a row for each field that changes."""
    patches = listings(spark, sf_dir).where("id % 50 = 0").select("id", F.lit("published").alias("status"), F.when(F.col("id") % 20 == 10, "Free").alias("price"))
    return ledger.edit(listings(spark, sf_dir), patches, ("status", "price"))[1]


@query(QUERIES, "WITH h AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, last FROM h, n WHERE last >= now - INTERVAL 2 DAY")
def live_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-limit buckets that have had a hit within two days."""
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    now = h.agg(F.max("last")).first()[0]
    return ledger.prune(h, "last", F.lit(str(now)).cast("timestamp_ntz"))


@query(QUERIES, LISTINGS + " SELECT id, CASE WHEN url = '' THEN '' WHEN url LIKE 'https://%' OR url LIKE 'http://%' THEN url ELSE 'https://' || url END AS url FROM listings")
def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", normal_url(F.col("url")).alias("url"))


@query(QUERIES, LISTINGS + """, r AS (SELECT l_orderkey AS id, min(CAST(l_shipdate AS DATE)) AS created, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY 1) SELECT l.id, l.title, l.status, r.n, r.created FROM r JOIN listings l USING (id) ORDER BY r.created, l.id LIMIT 300""")
def pending_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that wait, with the listing that they are about, the oldest first."""
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.to_date("l_shipdate")).alias("created"), F.count("*").alias("n"))
    return listings(spark, sf_dir).join(r, "id").orderBy("created", "id").limit(300).select("id", "title", "status", "n", "created")


@query(QUERIES, "SELECT count(*) AS pending, CAST(DATE '2002-01-01' - min(CAST(l_shipdate AS DATE)) AS INTEGER) AS oldest_days FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reports wait, and the age of the oldest in days."""
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'O'")
    return r.agg(F.count("*").alias("pending"), F.datediff(F.lit("2002-01-01").cast("date"), F.min(F.to_date("l_shipdate"))).alias("oldest_days"))
