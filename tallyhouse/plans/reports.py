"""Aggregates and the sections of the operator's report."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.text import url_host
from tallyhouse.functions.time import day
from tallyhouse.operators import ranking, reading
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, SPANS, listings, today
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
#: Fixed values of this fixture: an event counts for the listing of its number, purchases as saves.
_STATS = "stats AS (SELECT event_id % 5000 + 1 AS id, CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day, CASE event_type WHEN 'purchase' THEN 'save' WHEN 'click' THEN 'ticket_click' WHEN 'signup' THEN 'calendar' ELSE event_type END AS action, count(*) AS n FROM events GROUP BY ALL)"
WEIGHTS = {"view": 1.0, "save": 3.0, "calendar": 4.0, "ticket_click": 5.0}


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, day, action, n): the counters of listings."""
    e = table(spark, sf_dir, "events")
    named = F.col("event_type")
    action = F.when(named == "purchase", "save").when(named == "click", "ticket_click").when(named == "signup", "calendar").otherwise(named)
    return e.groupBy((F.col("event_id") % 5000 + 1).alias("id"), day(F.col("ts")).alias("day"), action.alias("action")).agg(F.count("*").alias("n"))


def _sum(action: str) -> F.Column:
    return F.coalesce(F.sum(F.when(F.col("action") == action, F.col("n"))), F.lit(0)).cast("bigint")


@query(QUERIES, LISTINGS + f", {_STATS} SELECT id, title, CAST(coalesce(sum(n) FILTER (WHERE action = 'view'), 0) AS BIGINT) AS views, CAST(coalesce(sum(n) FILTER (WHERE action = 'ticket_click'), 0) AS BIGINT) AS clicks, CAST(sum(n) AS BIGINT) AS total FROM stats JOIN listings USING (id) GROUP BY 1, 2 ORDER BY total DESC, id LIMIT 50")
def top_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty listings with most actions; counters of unknown listings are left out."""
    t = _stats(spark, sf_dir).groupBy("id").agg(_sum("view").alias("views"), _sum("ticket_click").alias("clicks"), F.sum("n").alias("total"))
    return t.join(listings(spark, sf_dir).select("id", "title"), "id").orderBy(F.desc("total"), "id").limit(50).select("id", "title", "views", "clicks", "total")


@query(QUERIES, LISTINGS + f", {_STATS} SELECT id, title, CAST(sum(n) AS BIGINT) AS saves FROM stats JOIN listings USING (id) WHERE action = 'save' GROUP BY 1, 2 ORDER BY saves DESC, id LIMIT 20")
def most_saved_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _stats(spark, sf_dir).where("action = 'save'").groupBy("id").agg(F.sum("n").alias("saves"))
    return t.join(listings(spark, sf_dir).select("id", "title"), "id").orderBy(F.desc("saves"), "id").limit(20).select("id", "title", "saves")


@query(QUERIES, LISTINGS + f", {_STATS} SELECT regexp_extract(url, '^https?://(?:www\\.)?([^/:?#]+)', 1) AS host, CAST(sum(n) AS BIGINT) AS clicks FROM stats JOIN listings USING (id) WHERE action = 'ticket_click' AND url <> '' GROUP BY 1 ORDER BY clicks DESC, host LIMIT 25")
def clicks_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket clicks by the vendor's host, the largest 25."""
    t = _stats(spark, sf_dir).where("action = 'ticket_click'").groupBy("id").agg(F.sum("n").alias("n"))
    hosts = listings(spark, sf_dir).where("url <> ''").select("id", url_host(F.col("url")).alias("host"))
    return t.join(hosts, "id").groupBy("host").agg(F.sum("n").alias("clicks")).orderBy(F.desc("clicks"), "host").limit(25)


@query(QUERIES, LISTINGS + f", {_STATS}, c AS (SELECT category, CAST(coalesce(sum(n) FILTER (WHERE action = 'view'), 0) AS BIGINT) AS views, CAST(coalesce(sum(n) FILTER (WHERE action = 'ticket_click'), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(n) FILTER (WHERE action = 'save'), 0) AS BIGINT) AS saves FROM stats JOIN listings USING (id) GROUP BY 1), p AS (SELECT category, count(*) AS published FROM listings, clock WHERE status = 'published' AND start_day >= today GROUP BY 1) SELECT category, coalesce(published, 0) AS published, views, clicks, saves, round(views / published::DOUBLE, 4) AS intensity, round(CASE WHEN views > 0 THEN clicks / views::DOUBLE ELSE 0 END, 4) AS ctr, row_number() OVER (ORDER BY round(views / published::DOUBLE, 4) DESC NULLS LAST, views DESC, category) AS pos FROM c LEFT JOIN p USING (category) WHERE (SELECT sum(views) FROM c) >= 50")
def demand_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, clicks and saves of each category against what is still to come; categories without supply last; nothing under fifty views."""
    c = _stats(spark, sf_dir).join(listings(spark, sf_dir).select("id", "category"), "id").groupBy("category").agg(_sum("view").alias("views"), _sum("ticket_click").alias("clicks"), _sum("save").alias("saves"))
    p = reading.published(listings(spark, sf_dir)).where(F.col("start_day") >= F.lit(today(spark, sf_dir))).groupBy("category").agg(F.count("*").alias("published"))
    j = c.join(p, "category", "left").withColumn("published", F.coalesce("published", F.lit(0)).cast("bigint"))
    j = j.withColumn("intensity", F.round(F.try_divide("views", "published"), 4)).withColumn("ctr", F.round(F.coalesce(F.try_divide("clicks", "views"), F.lit(0.0)), 4))
    gated = j.withColumn("all", F.sum("views").over(Window.partitionBy())).where("all >= 50").drop("all")  # seven rows
    return gated.withColumn("pos", F.row_number().over(Window.orderBy(F.col("intensity").desc_nulls_last(), F.desc("views"), "category")))


@query(QUERIES, SPANS + f""", {_STATS}, m AS (SELECT max(day) AS d FROM stats), s AS (SELECT (id - 1) % 97 AS slot, round(sum(CASE action WHEN 'view' THEN 1.0 WHEN 'save' THEN 3.0 WHEN 'calendar' THEN 4.0 WHEN 'ticket_click' THEN 5.0 ELSE 0.0 END * n * pow(0.5, (d - day) / 3.0)), 6) AS score FROM stats, m WHERE d - day BETWEEN 0 AND 6 GROUP BY 1),
    q AS (SELECT spans.id, score, "start" FROM s JOIN spans ON spans.id % 97 = slot, clock WHERE score >= 5 AND status = 'published' AND last_day >= today) SELECT id, score FROM q WHERE (SELECT count(*) FROM q) >= 3 ORDER BY score DESC, "start", id LIMIT 12""")
def trending_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in demand: published and not over, by decayed actions of a week, ties by start; twelve at most, none under three.

    Each of 97 counters stands for the listings of its remainder, so that what is to come has counts.
    """
    s = _stats(spark, sf_dir)
    last = s.agg(F.max("day")).first()[0]
    age = F.datediff(F.lit(last), F.col("day"))
    weight = F.coalesce(*[F.when(F.col("action") == a, F.lit(w)) for a, w in WEIGHTS.items()], F.lit(0.0))
    score = s.where(age.between(0, 6)).groupBy(((F.col("id") - 1) % 97).alias("slot")).agg(F.round(F.sum(weight * F.col("n") * F.pow(F.lit(0.5), age / F.lit(3.0))), 6).alias("score")).where("score >= 5")
    live = reading.with_span(reading.published(listings(spark, sf_dir))).where(F.col("last_day") >= F.lit(today(spark, sf_dir))).select("id", "start")
    hot = score.join(live, F.col("id") % 97 == F.col("slot"))
    gate = F.broadcast(hot.agg(F.count("*").alias("all")))
    return hot.join(gate, F.col("all") >= 3).orderBy(F.desc("score"), "start", "id").limit(12).select("id", "score")


_FLOORS = "(VALUES ('music', 6), ('sports', 2), ('family', 3), ('arts', 4), ('food', 3), ('weird', 1), ('festival', 2)) f(category, floor)"


@query(QUERIES, LISTINGS + f""", w AS (SELECT CAST(unnest(generate_series(date_trunc('week', today), date_trunc('week', today) + INTERVAL 21 DAY, INTERVAL 7 DAY)) AS DATE) AS week FROM clock), n AS (SELECT category, CAST(date_trunc('week', start_day) AS DATE) AS week, count(*) AS n FROM listings WHERE status = 'published' GROUP BY ALL),
    c AS (SELECT category, week, coalesce(n, 0) AS n, floor, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < floor THEN 'thin' ELSE 'ok' END AS status FROM {_FLOORS} CROSS JOIN w LEFT JOIN n USING (category, week))
    SELECT category, week, n, CAST(floor AS INTEGER) AS floor, status, CASE WHEN status <> 'ok' THEN upper(status) || ' ' || category || ' week of ' || strftime(week, '%b ') || CAST(day(week) AS VARCHAR) || ': ' || n || '/' || floor END AS alert FROM c""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weeks from this one: every category against its floor, with the alerts' text."""
    #: The least listings of a week.
    floors = [("music", 6), ("sports", 2), ("family", 3), ("arts", 4), ("food", 3), ("weird", 1), ("festival", 2)]
    now = today(spark, sf_dir)
    monday = now - timedelta(days=now.weekday())
    grid = spark.createDataFrame([(c, f, monday + timedelta(days=7 * k)) for c, f in floors for k in range(4)], "category string, floor int, week date")
    rows = reading.published(listings(spark, sf_dir)).where(F.col("start_day").between(F.lit(monday), F.lit(monday + timedelta(days=27))))
    n = rows.groupBy("category", F.to_date(F.date_trunc("week", "start_day")).alias("week")).agg(F.count("*").alias("n"))
    full = F.broadcast(grid).join(n, ["category", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("n") < F.col("floor"), "thin").otherwise("ok")
    text = F.concat(F.upper("status"), F.lit(" "), "category", F.lit(" week of "), F.date_format("week", "MMM d"), F.lit(": "), F.col("n").cast("string"), F.lit("/"), F.col("floor").cast("string"))
    return full.withColumn("status", status).withColumn("alert", F.when(F.col("status") != "ok", text)).select("category", "week", "n", "floor", "status", "alert")


@query(QUERIES, LISTINGS + " SELECT count(*) FILTER (WHERE status = 'published' AND id % 3 = 0) AS verified, count(*) FILTER (WHERE status = 'published' AND id % 3 <> 0 AND start_day >= today) AS never_verified, count(*) FILTER (WHERE status = 'draft') AS drafts, count(*) FILTER (WHERE status = 'archived') AS archived, max(created_day) AS newest FROM listings, clock")
def content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the report in one pass. Every third listing stands for a verified one."""
    rows, now = listings(spark, sf_dir), F.lit(today(spark, sf_dir))
    live = F.col("status") == "published"
    return rows.agg(F.count_if(live & (F.col("id") % 3 == 0)).alias("verified"), F.count_if(live & (F.col("id") % 3 != 0) & (F.col("start_day") >= now)).alias("never_verified"), F.count_if(F.col("status") == "draft").alias("drafts"), F.count_if(F.col("status") == "archived").alias("archived"), F.max("created_day").alias("newest"))


@query(QUERIES, "WITH s AS (SELECT event_type AS slug, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT slug, n, total FROM s ORDER BY n DESC, slug LIMIT 3")
def feed_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions of feeds: the three most used, beside the total of the known ones."""
    n = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("slug")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "slug").limit(3)


@query(QUERIES, "WITH r AS (SELECT o_orderkey AS run, o_orderdate AS started, o_orderdate + to_seconds(o_orderkey % 9000) AS finished FROM orders), n AS (SELECT *, lag(run % 500) OVER (ORDER BY started, run) AS before FROM r ORDER BY started DESC, run DESC LIMIT 20) SELECT run, CASE WHEN run % 9000 >= 60 THEN CAST(run % 9000 // 60 AS VARCHAR) || 'm ' ELSE '' END || CAST(run % 9000 % 60 AS VARCHAR) || 's' AS took, CASE WHEN before IS NULL THEN '' WHEN run % 500 = before THEN ' (±0)' ELSE ' (' || CASE WHEN run % 500 > before THEN '+' ELSE '' END || CAST(run % 500 - before AS VARCHAR) || ')' END AS delta FROM n")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest runs: how long they took, and the change of their count from the run before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"))
    late = o.orderBy(F.desc("started"), F.desc("run")).limit(21)
    seconds, count = F.col("run") % 9000, F.col("run") % 500
    before = F.lag(F.col("run") % 500).over(Window.orderBy("started", "run"))  # 21 rows
    took = F.concat(F.when(seconds >= 60, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "))).otherwise(""), (seconds % 60).cast("string"), F.lit("s"))
    change = count - F.col("before")
    delta = F.when(F.col("before").isNull(), "").when(change == 0, " (±0)").otherwise(F.concat(F.lit(" ("), F.when(change > 0, "+").otherwise(""), change.cast("string"), F.lit(")")))
    return late.withColumn("before", before).orderBy(F.desc("started"), F.desc("run")).limit(20).select("run", took.alias("took"), delta.alias("delta"))


@query(QUERIES, "WITH r AS (SELECT CASE WHEN event_id % 10 = 3 THEN 'n/a' ELSE CAST(event_id % 50 AS VARCHAR) END AS impressions, CASE WHEN event_id % 10 = 7 THEN NULL ELSE CAST(event_id % 5 AS VARCHAR) END AS clicks FROM events) SELECT CAST(sum(coalesce(TRY_CAST(impressions AS BIGINT), 0)) AS BIGINT) AS impressions, CAST(sum(coalesce(TRY_CAST(clicks AS BIGINT), 0)) AS BIGINT) AS clicks, round(sum(coalesce(TRY_CAST(clicks AS BIGINT), 0)) / sum(coalesce(TRY_CAST(impressions AS BIGINT), 0))::DOUBLE, 6) AS ctr FROM r")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a search report whose numbers may be none; the rate is derived."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 3, "n/a").otherwise((F.col("event_id") % 50).cast("string")).alias("i"), F.when(F.col("event_id") % 10 != 7, (F.col("event_id") % 5).cast("string")).alias("c"))
    n = lambda x: F.coalesce(F.col(x).try_cast("bigint"), F.lit(0))
    return e.agg(F.sum(n("i")).alias("impressions"), F.sum(n("c")).alias("clicks")).withColumn("ctr", F.round(F.try_divide("clicks", "impressions"), 6))


@query(QUERIES, LISTINGS + f""", {_STATS}, m AS (SELECT max(day) AS d FROM stats), n AS (SELECT coalesce(sum(n) FILTER (WHERE day > d - 7), 0) AS cur, coalesce(sum(n) FILTER (WHERE day <= d - 7 AND day > d - 14), 0) AS prev FROM stats, m WHERE action = 'view'),
    q AS (SELECT count(*) AS waiting FROM listings WHERE status = 'draft'), c AS (SELECT count(*) AS thin FROM (SELECT category, count(*) AS k FROM listings, clock WHERE status = 'published' AND start_day BETWEEN today AND today + 6 GROUP BY 1) WHERE k < 3)
    SELECT 'engagement' AS section, CAST(cur AS VARCHAR) || ' views, ' || CASE WHEN prev = 0 THEN CASE WHEN cur > 0 THEN 'new' ELSE '±0%' END WHEN floor((cur - prev) / prev::DOUBLE * 100 + 0.5) = 0 THEN '±0%' ELSE CASE WHEN cur > prev THEN '+' ELSE '' END || CAST(floor((cur - prev) / prev::DOUBLE * 100 + 0.5) AS BIGINT) || '% WoW' END AS line, false AS alert FROM n
    UNION ALL SELECT 'queue', waiting || ' waiting', waiting > 0 FROM q UNION ALL SELECT 'coverage', thin || ' thin categories', thin > 0 FROM c""")
def operator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the weekly report, one row each, with what asks for attention."""
    s = _stats(spark, sf_dir).where("action = 'view'")
    last = _stats(spark, sf_dir).agg(F.max("day")).first()[0]
    age = F.datediff(F.lit(last), F.col("day"))
    n = s.agg(F.coalesce(F.sum(F.when(age < 7, F.col("n"))), F.lit(0)).alias("cur"), F.coalesce(F.sum(F.when((age >= 7) & (age < 14), F.col("n"))), F.lit(0)).alias("prev"))
    section = lambda name, line, alert: (F.lit(name).alias("section"), line.alias("line"), alert.alias("alert"))
    engagement = n.select(*section("engagement", F.concat(F.col("cur").cast("string"), F.lit(" views, "), ranking.change_label(F.col("cur"), F.col("prev"))), F.lit(False)))
    rows, now = listings(spark, sf_dir), today(spark, sf_dir)
    queue = rows.agg(F.count_if(F.col("status") == "draft").alias("k")).select(*section("queue", F.concat(F.col("k").cast("string"), F.lit(" waiting")), F.col("k") > 0))
    week = reading.published(rows).where(F.col("start_day").between(F.lit(now), F.lit(now + timedelta(days=6)))).groupBy("category").agg(F.count("*").alias("k"))
    coverage = week.agg(F.count_if(F.col("k") < 3).alias("k")).select(*section("coverage", F.concat(F.col("k").cast("string"), F.lit(" thin categories")), F.col("k") > 0))
    return engagement.unionByName(queue).unionByName(coverage)
