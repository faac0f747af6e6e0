"""Counters, scores and tripwires over the events table."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.text import percent
from tallyhouse.functions.time import ZONE, day, wall
from tallyhouse.operators import ranking, snapshots
from tallyhouse.plans.base import Registered, query
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
ACTIONS = ("view", "click", "purchase", "signup")
#: What an action weighs in trending scores.
WEIGHTS = {"view": 1.0, "click": 5.0, "purchase": 4.0, "signup": 3.0}
_WALL = "timezone('America/Chicago', timezone('UTC', ts))"
_DAY = f"CAST({_WALL} AS DATE)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", day(F.col("ts")))


def recent(events: DataFrame, days: int = 7) -> tuple[DataFrame, date | None]:
    """The events of the last `days` (1 to 90) Chicago days of the data, today included, and that day.

    The last instant is looked up first, so the bound is a literal on ts and reaches the scan.
    """
    last = events.agg(F.max("ts")).first()[0]
    if last is None:
        return events, None
    local = last.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(ZONE)).date()
    first = local - timedelta(days=max(1, min(90, days)) - 1)
    begin = datetime(first.year, first.month, first.day, tzinfo=ZoneInfo(ZONE)).astimezone(timezone.utc).replace(tzinfo=None)
    return events.where(F.col("ts") >= F.lit(str(begin)).cast("timestamp_ntz")), local


@query(QUERIES, f"SELECT {_DAY} AS day, " + ", ".join(f"COUNT(*) FILTER (WHERE event_type = '{a}') AS {a}s" for a in ACTIONS) + " FROM events GROUP BY 1")
def engagement_daily_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per Chicago day with a count for each known action; unknown actions still make the day's row."""
    e = _events(spark, sf_dir).select("day", "event_type")
    return e.groupBy("day").agg(*[F.count_if(F.col("event_type") == a).alias(f"{a}s") for a in ACTIONS])


@query(QUERIES, f"WITH e AS (SELECT {_DAY} AS day, event_type FROM events), t AS (SELECT max(day) AS today FROM e) SELECT day, event_type, count(*) AS n FROM e, t WHERE day > today - 7 AND day <= today GROUP BY 1, 2")
def engagement_trailing_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and action over the last seven days, today included."""
    near, _ = recent(_events(spark, sf_dir))
    return near.groupBy("day", "event_type").agg(F.count("*").alias("n"))


@query(QUERIES, "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE event_type = '{a}') AS {a}s" for a in ACTIONS) + ", COUNT(*) AS total FROM events")
def engagement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type")
    return e.agg(*[F.count_if(F.col("event_type") == a).alias(f"{a}s") for a in ACTIONS], F.count("*").alias("total"))


@query(QUERIES, "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'view') + 0.5) AS BIGINT) ELSE 0 END AS ctr FROM events GROUP BY 1")
def click_through_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, clicks and the rounded percentage per user, 0 without views."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return e.withColumn("ctr", percent(F.col("clicks"), F.col("views")))


@query(QUERIES, "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 50")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"))
    return e.orderBy(F.desc("n"), "user_id").limit(50)


@query(QUERIES, f"WITH e AS (SELECT {_DAY} AS day, user_id, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 5.0 WHEN 'purchase' THEN 4.0 WHEN 'signup' THEN 3.0 ELSE 0.0 END AS w FROM events), t AS (SELECT max(day) AS today FROM e), s AS (SELECT user_id, round(sum(w * pow(0.5, (today - day) / 3.0)), 6) AS score FROM e, t WHERE today - day BETWEEN 0 AND 6 GROUP BY 1), q AS (SELECT * FROM s WHERE score >= 5) SELECT user_id, score FROM q WHERE (SELECT count(*) FROM q) >= 3 ORDER BY score DESC, user_id LIMIT 12")
def trending_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed weighted actions of a week; at least 5, at least three of them or none, at most 12."""
    near, today = recent(_events(spark, sf_dir))
    hot = ranking.decayed(near, "user_id", "event_type", "day", WEIGHTS, F.lit(today)).where("score >= 5")
    gate = F.broadcast(hot.agg(F.count("*").alias("__n")))
    return hot.join(gate, F.col("__n") >= 3).orderBy(F.desc("score"), "user_id").limit(12).select("user_id", "score")


@query(QUERIES, f"WITH d AS (SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT d.*, coalesce(w.n, CASE WHEN d.day - 7 >= (SELECT min(day) FROM d) THEN 0 END) AS before FROM d LEFT JOIN d w ON w.event_type = d.event_type AND w.day = d.day - 7) SELECT day, event_type, n, before, CASE WHEN before IS NULL THEN 'first report' WHEN before = 0 THEN CASE WHEN n > 0 THEN 'new' ELSE '±0%' END WHEN floor((n - before) / before::DOUBLE * 100 + 0.5) = 0 THEN '±0%' ELSE (CASE WHEN floor((n - before) / before::DOUBLE * 100 + 0.5) > 0 THEN '+' ELSE '' END) || CAST(floor((n - before) / before::DOUBLE * 100 + 0.5) AS BIGINT)::VARCHAR || '% WoW' END AS label FROM l")
def week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day against the day a week before; a day without events counts as zero, days before the first as unknown."""
    return week_before(_events(spark, sf_dir).groupBy("day", "event_type").agg(F.count("*").alias("n")))


def week_before(counts: DataFrame) -> DataFrame:
    """counts (day, event_type, n) with `before` and `label`."""
    w = counts.select(F.date_add("day", 7).alias("w_day"), F.col("event_type").alias("w_type"), F.col("n").alias("w_n"))
    first = counts.agg(F.min("day").alias("first"))  # one row
    joined = counts.join(w, (F.col("day") == F.col("w_day")) & F.col("event_type").eqNullSafe(F.col("w_type")), "left").join(F.broadcast(first), F.lit(True))
    before = F.coalesce("w_n", F.when(F.date_sub("day", 7) >= F.col("first"), F.lit(0).cast("bigint")))
    rows = joined.select("day", "event_type", "n", before.alias("before"))
    return rows.withColumn("label", ranking.change_label(F.col("n"), F.col("before")))


@query(QUERIES, f"WITH d AS (SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, max(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS baseline FROM d) SELECT day, event_type, n, baseline, CASE WHEN baseline IS NULL OR baseline <= 0 THEN n >= 250 ELSE n >= 80 AND n >= 2.0 * baseline END AS stampede FROM b")
def stampede_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with twice the most of the four before, and at least 80."""
    d = _events(spark, sf_dir).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    b = d.withColumn("baseline", F.max("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-4, -1)))
    return b.withColumn("stampede", ranking.stampede(F.col("n"), F.col("baseline"), 80, 250))


@query(QUERIES, f"SELECT hour({_WALL}) AS hour, count(*) AS n FROM events GROUP BY 1")
def local_hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.hour(wall(F.col("ts"))).alias("hour")).agg(F.count("*").alias("n"))


@query(QUERIES, f"SELECT event_id, strftime({_WALL}, '%Y-%m-%dT%H:%M') AS wall, hour({_WALL}) < 7 AS improbable FROM events")
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall strings, and whether a start at that hour is improbable."""
    w = wall(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(w, "yyyy-MM-dd'T'HH:mm").alias("wall"), (F.hour(w) < 7).alias("improbable"))


@query(QUERIES, "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def props_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties, read with a declared schema."""
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k bigint").alias("p"), "value")
    return e.groupBy((F.col("p.k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(QUERIES, f"WITH d AS (SELECT DISTINCT user_id, {_DAY} AS day FROM events), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d) SELECT user_id, min(day) AS start_day, max(day) AS end_day, count(*) AS n_days FROM r GROUP BY user_id, run")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive active days per user."""
    from tallyhouse.operators.spans import islands

    return islands(_events(spark, sf_dir).select("user_id", "day"), ["user_id"], "day")


@query(QUERIES, f"SELECT user_id, event_type, {_DAY} AS day, count(*) AS n, round(max(value), 2) AS best FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3")
def action_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter table: one row per user, action and day; other actions are refused."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id", "event_type", "day").agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("best"))


@query(QUERIES, "WITH h AS (SELECT split_part(CAST(value AS VARCHAR), '.', 1) AS k, event_id, event_type, value FROM events), r AS (SELECT *, (CASE WHEN value > 10 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS rich FROM events) SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rich DESC, event_id DESC) AS n FROM r) WHERE n = 1")
def richest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per user: the richest, the latest of equals."""
    e = table(spark, sf_dir, "events")
    rich = (F.col("value") > 10).cast("int") + (F.col("event_type") == "purchase").cast("int")
    return snapshots.richest(e, "user_id", F.coalesce(rich, F.lit(0)), "event_id").select("user_id", "event_id", "event_type", "value")


@query(QUERIES, "WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_id % 3 <> 0 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, coalesce(a.first_seen, b.first_seen) AS first_seen, coalesce(b.last_seen, a.last_seen) AS last_seen FROM a FULL JOIN b ON a.user_id = b.user_id")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged third of the events upserted into the rest; first_seen is set on insert only."""
    e = table(spark, sf_dir, "events")
    state = lambda x: x.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return snapshots.upsert(state(e.where("event_id % 3 <> 0")), state(e.where("event_id % 3 = 0")), "user_id", ("first_seen",))


@query(QUERIES, "WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT event_id, user_id, ts, r, ts AS began, 1::BIGINT AS n FROM o WHERE r = 1 UNION ALL SELECT o.event_id, o.user_id, o.ts, o.r, CASE WHEN o.ts >= f.began + INTERVAL 60 MINUTE THEN o.ts ELSE f.began END, CASE WHEN o.ts >= f.began + INTERVAL 60 MINUTE THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1) SELECT event_id, user_id, ts, n, n <= 30 AS allowed FROM f")
def hit_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 hits per user in 60 minutes from a window's first hit."""
    return snapshots.limit_hits(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 30)


@query(QUERIES, f"WITH e AS (SELECT user_id, event_type, {_DAY} AS day, max(value) AS value FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, day, event_type) AS rk FROM e) SELECT user_id, event_type, day, round(value, 2) AS value FROM r WHERE rk <= 3")
def top_three_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).groupBy("user_id", "event_type", "day").agg(F.max("value").alias("value"))
    return ranking.first_per(e, ["user_id"], [F.desc("value"), F.col("day"), F.col("event_type")], 3).select("user_id", "event_type", "day", F.round("value", 2).alias("value"))


@query(QUERIES, f"WITH RECURSIVE o AS (SELECT event_type, user_id, {_DAY} AS day, -value AS rank_value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY -value, event_id) AS r FROM events), f AS (SELECT event_type, 0::BIGINT AS r, 0 AS pick, false AS took, []::BIGINT[] AS users, []::DATE[] AS days FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT event_type, r, CASE WHEN ok THEN pick + 1 ELSE pick END, ok, CASE WHEN ok THEN list_append(users, user_id) ELSE users END, CASE WHEN ok THEN list_append(days, day) ELSE days END FROM (SELECT o.event_type, o.r, f.pick, f.users, f.days, o.user_id, o.day, f.pick < 8 AND NOT list_contains(f.users, o.user_id) AND len(list_filter(f.days, lambda d: d = o.day)) < 2 AS ok FROM f JOIN o ON o.event_type = f.event_type AND o.r = f.r + 1 WHERE f.pick < 8)) SELECT f.event_type, f.pick, o.rank_value, o.event_id, o.user_id, o.day FROM f JOIN o ON o.event_type = f.event_type AND o.r = f.r WHERE took")
def spread_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy picks per action: the most valuable events, one per user, two per day, eight in all."""
    e = _events(spark, sf_dir).select("event_type", "user_id", "day", (-F.col("value")).alias("rank_value"), "event_id")
    return ranking.spread(e, "event_type", ["rank_value", "event_id"], "user_id", "day", 8)
