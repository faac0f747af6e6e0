"""Snapshots, feeds of changes, plans that are applied as one, and logged runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.operators import changes
from tallyhouse.operators.runlog import RunLog
from tallyhouse.operators.versions import Tables
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.feeds import QUERIES as FEEDS
from tallyhouse.plans.feeds import game_verdicts
from tallyhouse.plans.fixture import LISTINGS, listings, today
from tallyhouse.sources.shared import shared_folder
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}

_COLUMNS = ["id", "category", "title", "start", "status"]
_BEFORE = LISTINGS + ', b AS (SELECT id, category, title, "start", status FROM listings)'
#: What an evening's repairs make of the listings: categories by list, small hours moved, the past archived, some deleted, some added.
_AFTER = _BEFORE + """, a AS (SELECT id, CASE WHEN id % 14 = 3 THEN 'arts' ELSE category END AS category, title,
        CASE WHEN id % 3 = 0 AND CAST(substr("start", 12, 2) AS INT) < 6 THEN strftime(CAST(replace("start", 'T', ' ') AS TIMESTAMP) + INTERVAL 12 HOUR, '%Y-%m-%dT%H:%M') ELSE "start" END AS "start", status FROM b WHERE NOT (status = 'draft' AND id % 19 = 0)
        UNION ALL SELECT id + 1000000000, category, title || ' again', "start", 'draft' FROM b WHERE id % 23 = 0),
    n AS (SELECT id, category, title, "start", CASE WHEN status = 'published' AND CAST(left("start", 10) AS DATE) < today THEN 'archived' ELSE status END AS status FROM a, clock)"""


def _repaired(before: DataFrame, now: date) -> DataFrame:
    fixes = before.where("id % 14 = 3").select("id", F.lit("arts").alias("category"))
    late = before.where("id % 3 = 0").select("id")
    a = changes.shifted(changes.repaired(before, fixes, "id", "category"), late, "id", "start", 12, 6)
    a = a.where("NOT (status = 'draft' AND id % 19 = 0)")
    more = before.where("id % 23 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "category", F.concat("title", F.lit(" again")).alias("title"), "start", F.lit("draft").alias("status"))
    return changes.archived(a.unionByName(more), "start", str(now))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = listings(spark, sf_dir).select(*_COLUMNS)
    return before, _repaired(before, today(spark, sf_dir))


@query(QUERIES, _AFTER + """ SELECT coalesce(b.id, n.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS kind,
    CASE WHEN b.id IS NOT NULL AND n.id IS NOT NULL THEN concat_ws(',', CASE WHEN b.category <> n.category THEN 'category' END, CASE WHEN b."start" <> n."start" THEN 'start' END, CASE WHEN b.status <> n.status THEN 'status' END) END AS fields
    FROM b FULL JOIN n ON b.id = n.id WHERE b.id IS NULL OR n.id IS NULL OR b.category <> n.category OR b."start" <> n."start" OR b.status <> n.status""")
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of an evening's repairs: kinds, and the fields of updates."""
    before, after = _both(spark, sf_dir)
    feed = changes.difference(before, after, "id")
    return feed.select("id", "kind", F.array_join(changes.changed_fields(feed, _COLUMNS), ",").alias("fields"))


@query(QUERIES, _AFTER + """ SELECT 'applied' AS state, * FROM n UNION ALL SELECT 'back', * FROM b""")
def there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings after the feed was applied to them, and after it was turned round and applied to those."""
    before, after = _both(spark, sf_dir)
    feed = changes.difference(before, after, "id")
    there = changes.applied(before, feed, "id")
    back = changes.applied(there, changes.turned(feed, "id"), "id")
    return there.select(F.lit("applied").alias("state"), "*").unionByName(back.select(F.lit("back").alias("state"), "*"))


@query(QUERIES, _AFTER + """ SELECT n.id, CASE WHEN b.id IS NULL OR b.category <> n.category OR b."start" <> n."start" OR b.status <> n.status THEN strftime(today, '%Y-%m-%d') ELSE 'long ago' END AS updated_at FROM n LEFT JOIN b ON b.id = n.id, clock""")
def touched_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each listing was last changed: now if the repairs changed it."""
    before, after = _both(spark, sf_dir)
    stamped = changes.touched(before.withColumn("updated_at", F.lit("long ago")), after, "id", "updated_at", F.lit(str(today(spark, sf_dir))))
    return stamped.select("id", "updated_at")


_GAMES = f"""WITH v AS (SELECT * FROM ({FEEDS["game_verdicts"].sql})), l AS (SELECT * FROM ({LISTINGS} SELECT id, title, "start", status, start_day, category FROM listings)),
    k AS (SELECT *, CASE WHEN category = 'sports' AND status <> 'published' AND row_number() OVER (PARTITION BY start_day, category = 'sports' AND status <> 'published' ORDER BY id) = 1 THEN 'game|' || start_day ELSE 'own|' || id END AS key FROM l),
    f AS (SELECT 2000000000 + datediff('day', DATE '1970-01-01', day) AS id, 'game|' || day AS key, 'Home game on ' || day AS title, day || 'T19:00' AS "start" FROM v WHERE verdict = 'missing'),
    w AS (SELECT k.id, k.key, k.title, k."start", k.status, v.verdict, v.day, f.key IS NOT NULL AS met, f.title AS ft, f."start" AS fs, CASE WHEN v.verdict IN ('phantom', 'wrong-opponent') THEN 'draft' ELSE k.status END AS state FROM k LEFT JOIN v ON v.id = k.id LEFT JOIN f ON f.key = k.key)"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame, DataFrame]:
    own = F.row_number().over(Window.partitionBy("start_day", (F.col("category") == "sports") & (F.col("status") != "published")).orderBy("id"))
    hidden = (F.col("category") == "sports") & (F.col("status") != "published") & (F.col("n") == 1)
    key = F.when(hidden, F.concat(F.lit("game|"), F.col("start_day").cast("string"))).otherwise(F.concat(F.lit("own|"), "id"))
    rows = listings(spark, sf_dir).withColumn("n", own).select("id", key.alias("key"), "title", "start", "status", F.lit(None).cast("string").alias("verified_at"))
    verdicts = game_verdicts(spark, sf_dir)
    day = F.col("day").cast("string")
    known = verdicts.where("id IS NOT NULL").select("id", "verdict", F.concat(day, F.lit("T19:00")).alias("start"), F.lit(None).cast("string").alias("truth"))
    found = verdicts.where("verdict = 'missing'").select((F.datediff("day", F.lit("1970-01-01")) + 2_000_000_000).cast("bigint").alias("id"), F.concat(F.lit("game|"), day).alias("key"), F.concat(F.lit("Home game on "), day).alias("title"), F.concat(day, F.lit("T19:00")).alias("start"))
    tables = Tables(spark, f"{shared_folder(spark, 'games')}/tables")
    tables.commit({"listings": rows})
    return tables, known, found


@query(QUERIES, _GAMES + """ SELECT id, key, coalesce(ft, title) AS title, coalesce(fs, CASE WHEN verdict = 'retime' THEN day || 'T19:00' END, "start") AS "start", CASE WHEN met AND state IN ('draft', 'archived') THEN 'published' ELSE state END AS status, CASE WHEN met OR verdict IN ('ok', 'retime') THEN 'now' END AS verified_at FROM w
    UNION ALL SELECT id, key, title, "start", 'published', 'now' FROM f WHERE key NOT IN (SELECT key FROM k)""")
def applied_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings as of the version that applying a league's verdicts gives."""
    tables, known, found = _plan(spark, sf_dir)
    tables.update(lambda now: changes.applied_games(now["listings"], known, found, "now"), ["listings"])
    return tables.read("listings")


@query(QUERIES, _GAMES + """ SELECT id, 'hide' AS action, CASE WHEN verdict = 'phantom' THEN 'no home game that day' ELSE 'the opponent is ?' END AS note FROM w WHERE verdict IN ('phantom', 'wrong-opponent')
    UNION ALL SELECT id, 'retime', "start" || ' to ' || day || 'T19:00' FROM w WHERE verdict = 'retime' UNION ALL SELECT id, 'republish', state FROM w WHERE met AND state IN ('draft', 'archived')
    UNION ALL SELECT id, 'add', title FROM f WHERE key NOT IN (SELECT key FROM k)""")
def applied_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit that the same version has."""
    tables, known, found = _plan(spark, sf_dir)
    tables.update(lambda now: changes.applied_games(now["listings"], known, found, "now"), ["listings"])
    return tables.read("audit")


@query(QUERIES, "SELECT event_type AS run, a AS attempt, event_type <> 'error' OR a = 2 AS ok, CASE WHEN event_type <> 'error' OR a = 2 THEN n END AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (SELECT unnest([1, 2]) AS a) WHERE a = 1 OR event_type = 'error'")
def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a count for each action: one fails at first and is repeated, all are asked for twice."""
    log = RunLog(spark, shared_folder(spark, "runs"))
    events = table(spark, sf_dir, "events")
    tried: set[str] = set()

    def count(action: str) -> dict[str, int]:
        n = events.where(F.col("event_type") == action).count()
        if action == "error" and action not in tried:
            tried.add(action)
            raise RuntimeError("the first attempt fails")
        return {"n": n}

    actions = sorted(r[0] for r in events.select("event_type").where("event_type IS NOT NULL").distinct().limit(100).collect())
    for action in [*actions, *actions]:
        try:
            log.run(action, lambda a=action: count(a))
        except RuntimeError:
            log.run(action, lambda a=action: count(a))
    return log.table().select("run", "attempt", "ok", F.try_element_at("counts", F.lit("n")).alias("n"))
