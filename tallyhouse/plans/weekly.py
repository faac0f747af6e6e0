"""The weekly report over orders as listings, events as counters and customers as runs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.time import day
from tallyhouse.operators import report
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, listings, today
from tallyhouse.plans.reports import WEIGHTS
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
#: The least listings of a week.
FLOORS = {"music": 6, "sports": 2, "family": 3, "arts": 4, "food": 3, "weird": 1, "festival": 2}
_ACTIONS = ("view", "ticket_click", "save", "calendar")
_OF = {"view": "view", "ticket_click": "click", "save": "purchase", "calendar": "signup"}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: orders, events and customers are read once each."""
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("started"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") * 7 % 9000).alias("seconds"), (F.col("c_custkey") % 7 != 0).alias("ok"), F.lit("boom").alias("error"), (F.col("c_custkey") % 500).alias("upserted"), (F.col("c_custkey") * 13 % 40).alias("collapsed"), (F.col("c_custkey") % 9).alias("collapsed_runs"), (F.col("c_custkey") * 31 % 97).alias("archived"))
    runs = report.latest(r, ["started"], 5)
    now = today(spark, sf_dir)
    rows = listings(spark, sf_dir)
    live = F.col("status") == "published"
    week = live & F.col("start_day").between(F.lit(now), F.lit(now + timedelta(days=6)))
    reported = (F.col("status") == "draft") & (F.col("id") % 5 == 0)
    n = rows.agg(
        *[F.count_if(week & (F.col("category") == c)).alias(f"week_{c}") for c in FLOORS],
        F.count_if(live & (F.col("id") % 3 == 0) & (F.col("created_day") > F.lit(now - timedelta(days=7))) & (F.col("created_day") <= F.lit(now))).alias("verified7"),
        F.count_if(live & (F.col("id") % 3 != 0) & (F.col("start_day") >= F.lit(now))).alias("never_verified"),
        F.count_if(live & (F.col("start_day") >= F.lit(now))).alias("urls"),
        F.count_if(live & (F.col("start_day") >= F.lit(now - timedelta(days=7)))).alias("urls_before"),
        F.count_if((F.col("status") == "draft") & ~reported).alias("submissions"),
        F.count_if(reported).alias("reports"),
        F.max(F.when(reported, F.datediff(F.lit(now), F.col("created_day")))).alias("oldest_report"),
    )
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5000 + 1).alias("id"), "event_type", day(F.col("ts")).alias("day"))
    dated = e.groupBy("id", "event_type", "day").agg(F.count("*").alias("n"))
    # the last day comes with the sums: how old each day is, is known only then
    byid = dated.groupBy("id", "day").agg(*[F.sum(F.when(F.col("event_type") == t, F.col("n")).otherwise(0)).alias(a) for a, t in _OF.items()], F.sum("n").alias("all")).groupBy("id").agg(F.collect_list(F.struct("day", *_OF, "all")).alias("days"), F.max("day").alias("last"))
    last = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]  # one value from the files' statistics
    ref = day(F.lit(last).cast("timestamp_ntz")) if last else F.lit(None).cast("date")
    near = lambda f, lo, hi: F.aggregate(F.filter("days", lambda d: F.datediff(ref, d["day"]).between(lo, hi)), F.lit(0).cast("bigint"), lambda a, d: a + d[f])
    score = F.aggregate(F.filter("days", lambda d: F.datediff(ref, d["day"]).between(0, 6)), F.lit(0.0), lambda a, d: a + sum((F.lit(w) * d[k] for k, w in WEIGHTS.items()), F.lit(0.0)) * F.pow(F.lit(0.5), F.datediff(ref, d["day"]) / F.lit(3.0)))
    per = byid.select("id", *[near(a, 0, 6).alias(f"{a}7") for a in _ACTIONS], *[near(a, 7, 13).alias(f"{a}_before") for a in _ACTIONS], near("calendar", 0, 10_000).alias("subscribed"), (score >= 5).alias("hot"))
    feeds = F.reverse(F.array_sort(F.filter(F.array(*[F.struct(F.sum(f"{a}7").alias("n"), F.lit(a).alias("slug")) for a in _ACTIONS]), lambda x: x["n"] > 0)))
    m = per.agg(
        *[F.coalesce(F.sum(f"{a}{k}"), F.lit(0)).alias(f"{a}{k}") for a in _ACTIONS for k in ("7", "_before")],
        F.max(F.struct(F.col("view7"), (-F.col("id")).alias("i"))).alias("top"),
        F.count_if("hot").alias("hot"),
        F.coalesce(F.sum("subscribed"), F.lit(0)).alias("subscribed"),
        F.coalesce(feeds, F.expr("cast(array() AS array<struct<n: bigint, slug: string>>)")).alias("feeds"),
    )
    m = m.withColumns({"top_viewed": -F.col("top.i"), "trending": F.when(F.col("hot") >= 3, F.col("hot")).otherwise(0), "subscribed7": F.col("calendar7"), "digest_age": (F.col("view7") % 12).cast("int")})
    return runs.join(n, F.lit(True)).join(m, F.lit(True))  # one row each


def _wow(now: str, before: str) -> str:
    pct = f"CAST(floor(({now} - {before}) / {before}::DOUBLE * 100 + 0.5) AS BIGINT)"
    return f"CASE WHEN {before} IS NULL THEN 'first report' WHEN {before} = 0 THEN CASE WHEN {now} > 0 THEN 'new' ELSE '±0%' END WHEN {pct} = 0 THEN '±0%' ELSE CASE WHEN {pct} > 0 THEN '+' ELSE '' END || {pct} || '% WoW' END"


def _delta(f: str, label: str) -> str:
    return f"{f} || ' {label}' || CASE WHEN p_{f} IS NULL THEN '' WHEN {f} = p_{f} THEN ' (±0)' ELSE ' (' || CASE WHEN {f} > p_{f} THEN '+' ELSE '' END || ({f} - p_{f}) || ')' END"


def _spike(f: str) -> str:
    return f"CASE WHEN b_{f} IS NULL OR b_{f} <= 0 THEN {f} >= 100 ELSE {f} >= 50 AND {f} >= 2 * b_{f} END"


_STAGES = (("upserted", "upserted"), ("collapsed", "deduped"), ("collapsed_runs", "collapsed"), ("archived", "archived"))
_NL = "chr(10)"
_SQL = LISTINGS + f""", r AS (SELECT c_custkey AS started, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 7 % 9000 END AS seconds, c_custkey % 7 <> 0 AS ok, c_custkey % 500 AS upserted, c_custkey * 13 % 40 AS collapsed, c_custkey % 9 AS collapsed_runs, c_custkey * 31 % 97 AS archived FROM customer ORDER BY 1 DESC LIMIT 5),
    rn AS (SELECT *, {', '.join(f'lead({f}) OVER w AS p_{f}' for f, _ in _STAGES)}, row_number() OVER w AS k FROM r WINDOW w AS (ORDER BY started DESC)),
    run AS (SELECT *, (SELECT max(archived) FROM rn WHERE k > 1 AND ok) AS b_archived, (SELECT max(collapsed) FROM rn WHERE k > 1 AND ok) AS b_collapsed FROM rn WHERE k = 1),
    n AS (SELECT {', '.join(f"count(*) FILTER (WHERE status = 'published' AND start_day BETWEEN today AND today + 6 AND category = '{c}') AS week_{c}" for c in FLOORS)},
        count(*) FILTER (WHERE status = 'published' AND id % 3 = 0 AND created_day > today - 7 AND created_day <= today) AS verified7, count(*) FILTER (WHERE status = 'published' AND id % 3 <> 0 AND start_day >= today) AS never_verified,
        count(*) FILTER (WHERE status = 'published' AND start_day >= today) AS urls, count(*) FILTER (WHERE status = 'published' AND start_day >= today - 7) AS urls_before,
        count(*) FILTER (WHERE status = 'draft' AND id % 5 <> 0) AS submissions, count(*) FILTER (WHERE status = 'draft' AND id % 5 = 0) AS reports, max(today - created_day) FILTER (WHERE status = 'draft' AND id % 5 = 0) AS oldest FROM listings, clock),
    e AS (SELECT event_id % 5000 + 1 AS id, event_type, CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day FROM events), z AS (SELECT max(day) AS d FROM e), a AS (SELECT *, d - day AS age FROM e, z),
    m AS (SELECT {', '.join(f"count(*) FILTER (WHERE event_type = '{t}' AND age BETWEEN {lo} AND {hi}) AS {x}{k}" for x, t in _OF.items() for k, lo, hi in (('7', 0, 6), ('_before', 7, 13)))}, count(*) FILTER (WHERE event_type = 'signup') AS subscribed FROM a),
    i AS (SELECT id, count(*) FILTER (WHERE event_type = 'view' AND age BETWEEN 0 AND 6) AS v, sum(CASE event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'purchase' THEN 3.0::DOUBLE WHEN 'signup' THEN 4.0::DOUBLE WHEN 'click' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END * pow(0.5::DOUBLE, age / 3.0::DOUBLE)) FILTER (WHERE age BETWEEN 0 AND 6) AS s FROM a GROUP BY 1),
    t AS (SELECT (SELECT id FROM i ORDER BY v DESC, id LIMIT 1) AS top_viewed, CASE WHEN count(*) FILTER (WHERE s >= 5) >= 3 THEN count(*) FILTER (WHERE s >= 5) ELSE 0 END AS trending FROM i),
    f AS (SELECT sum(n) AS fed, string_agg(slug || ': ' || n, {_NL} ORDER BY n DESC, slug DESC) FILTER (WHERE k <= 3) AS top FROM (SELECT *, row_number() OVER (ORDER BY n DESC, slug DESC) AS k FROM (SELECT unnest([{', '.join(f"'{x}'" for x in _OF)}]) AS slug, unnest([{', '.join(f'{x}7' for x in _OF)}]) AS n FROM m) WHERE n > 0)),
    q AS (SELECT *, view7 % 12 AS age FROM m)
    SELECT 1 AS pos, 'pipeline' AS section, CASE WHEN seconds IS NULL THEN 'the last run was killed or is not complete' WHEN NOT ok THEN 'the last run failed: boom' ELSE 'ok: ' || {" || ', ' || ".join(_delta(f, label) for f, label in _STAGES)} || {_NL} || 'took ' || CASE WHEN seconds >= 60 THEN seconds // 60 || 'm ' ELSE '' END || seconds % 60 || 's' || CASE WHEN {_spike('archived')} OR {_spike('collapsed')} THEN {_NL} || 'stampede check: far more was archived or deduped than in recent runs' ELSE '' END END AS lines, seconds IS NULL OR NOT ok OR {_spike('archived')} OR {_spike('collapsed')} AS alert FROM run
    UNION ALL SELECT 2, 'coverage', CASE WHEN {' AND '.join(f'week_{c} >= {k}' for c, k in FLOORS.items())} THEN 'every category has its floor' ELSE concat_ws({_NL}, {', '.join(f"CASE WHEN week_{c} < {k} THEN '{c} ' || week_{c} || '/{k}' END" for c, k in FLOORS.items())}) END, NOT ({' AND '.join(f'week_{c} >= {k}' for c, k in FLOORS.items())}) FROM n
    UNION ALL SELECT 3, 'verification', verified7 || ' verified in 7 days' || {_NL} || never_verified || ' upcoming never verified', false FROM n
    UNION ALL SELECT 4, 'engagement', {f" || {_NL} || ".join(" || ', ' || ".join(f"'{x} ' || {x}7 || ' (' || {_wow(f'{x}7', f'{x}_before')} || ')'" for x in pair) for pair in (("view", "ticket_click"), ("save", "calendar")))} || {_NL} || 'most viewed: ' || top_viewed, false FROM m, t
    UNION ALL SELECT 5, 'trending', CASE WHEN trending = 0 THEN 'dark: below the minimum' ELSE trending || ' trending' END, false FROM t
    UNION ALL SELECT 6, 'index', urls || ' addresses (' || {_wow('urls', 'urls_before')} || ')', false FROM n
    UNION ALL SELECT 7, 'subscribers', subscribed || ' subscribed (+' || calendar7 || ' in 7 days)' || {_NL} || CASE WHEN age >= 8 THEN 'a send was missed: the last was ' || age || ' days ago' ELSE 'last digest: ' || age || CASE WHEN age = 1 THEN ' day ago' ELSE ' days ago' END END, age >= 8 FROM q
    UNION ALL SELECT 8, 'feeds', CASE WHEN coalesce(fed, 0) = 0 THEN 'no subscriptions in 7 days' ELSE fed || CASE WHEN fed = 1 THEN ' subscription' ELSE ' subscriptions' END || ' in 7 days' || {_NL} || top END, false FROM f
    UNION ALL SELECT 9, 'queue', CASE WHEN submissions = 0 AND reports = 0 AND coalesce(oldest, 0) < 3 THEN 'nothing waiting' ELSE concat_ws({_NL}, CASE WHEN submissions > 0 THEN submissions || CASE WHEN submissions = 1 THEN ' submission' ELSE ' submissions' END || ' waiting' END, CASE WHEN reports > 0 THEN reports || CASE WHEN reports = 1 THEN ' report' ELSE ' reports' END || ' waiting' END, CASE WHEN oldest >= 3 THEN 'the oldest report is ' || oldest || ' days old' END) END, coalesce(oldest >= 3, false) FROM n"""


@query(QUERIES, _SQL)
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine sections of the weekly report with what asks for attention."""
    return report.sections(facts(spark, sf_dir), FLOORS)
