"""Categories by content, over listings whose words vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import categories
from tallyhouse.operators.reading import CATEGORIES
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import WORDED, worded

QUERIES: dict[str, Registered] = {}


def _hit(field: str, pattern: str) -> str:
    return f"regexp_matches({field}, '\\b(?:" + pattern.replace("'", "''") + ")\\b')"


def _score(name: str) -> str:
    """One category's score, signal by signal."""
    venue = "(NOT arts) AND " if name in categories.DAMPED else ""
    said, own = [], []
    for pattern, w in categories.SIGNALS[name]:
        said += [f"CASE WHEN {_hit('t', pattern)} THEN {2 * w} ELSE 0 END", f"CASE WHEN {_hit('x', pattern)} THEN {w} ELSE 0 END"]
        own.append(f"CASE WHEN {venue}{_hit('v', pattern)} THEN {(w + 1) // 2} ELSE 0 END")
    total = f"({' + '.join(said + own)})"
    if name in categories.DAMPED:
        total = f"(CASE WHEN arts THEN floor(0.25::DOUBLE * {total} + 0.5) ELSE {total} END)"
    more = [f"CASE WHEN {_hit('v', p)} THEN {w} ELSE 0 END" for c, p, w in categories.HINTS if c == name]
    more += [f"CASE WHEN {_hit('a', p)} THEN {w} ELSE 0 END" for c, p, w in categories.PLACES if c == name]
    if name == "arts":
        more.append(f"CASE WHEN arts AND NOT {_hit('t', categories.FAMILY_TITLE)} THEN {categories.ARTS_FLOOR} ELSE 0 END")
    return f"CAST({' + '.join([total, *more])} AS INTEGER) AS {name}"


_BEST = f"greatest({', '.join(CATEGORIES)})"
_SCORED = WORDED + f""", f AS (SELECT *, lower(title) AS t, lower(description) AS x, lower(venue) AS v, lower(title || ' ' || venue || ' ' || description) AS a, {_hit('lower(venue)', categories.ARTS_VENUE)} AS arts FROM worded),
    s AS (SELECT id, category, {', '.join(map(_score, CATEGORIES))} FROM f),
    c AS (SELECT *, {_BEST} AS confidence, CASE WHEN {_BEST} = 0 THEN CASE WHEN category IN ({', '.join(f"'{c}'" for c in CATEGORIES)}) THEN category ELSE 'festival' END {' '.join(f"WHEN {c} = {_BEST} THEN '{c}'" for c in CATEGORIES)} END AS chosen FROM s)"""


@query(QUERIES, _SCORED + " SELECT id, category AS suggested, chosen, confidence FROM c")
def classified_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's category by its own words, with the score that decided."""
    return categories.with_category(worded(spark, sf_dir), "title", "description", "venue", "category").selectExpr("id", "category AS suggested", "chosen", "confidence")


@query(QUERIES, _SCORED + ', m AS (SELECT id, category AS "before", CASE WHEN confidence > 0 THEN chosen ELSE category END AS "after" FROM c) SELECT * FROM m WHERE "before" IS DISTINCT FROM "after"')
def category_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recategorisation would change."""
    return categories.recategorise(worded(spark, sf_dir), "title", "description", "venue", "category")[0]


@query(QUERIES, _SCORED + ', m AS (SELECT category AS b, CASE WHEN confidence > 0 THEN chosen ELSE category END AS a FROM c) SELECT category, CAST(sum(x) AS BIGINT) AS "before", CAST(sum(y) AS BIGINT) AS "after" FROM (SELECT b AS category, 1 AS x, 0 AS y FROM m UNION ALL SELECT a, 0, 1 FROM m) GROUP BY 1')
def category_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by category before and after a recategorisation."""
    return categories.recategorise(worded(spark, sf_dir), "title", "description", "venue", "category")[1]


@query(QUERIES, _SCORED + ', m AS (SELECT category AS b, CASE WHEN confidence > 0 THEN chosen ELSE category END AS a FROM c) SELECT category, CAST(sum(x) AS BIGINT) AS "before", CAST(sum(y) AS BIGINT) AS "after", CAST(sum(z) AS BIGINT) AS moved_in FROM (SELECT b AS category, 1 AS x, 0 AS y, 0 AS z FROM m UNION ALL SELECT a, 0, 1, CASE WHEN a <> b THEN 1 ELSE 0 END FROM m) GROUP BY 1')
def recategorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by category before and after a recategorisation by content, and how many moved in."""
    changes, tally = categories.recategorise(worded(spark, sf_dir), "title", "description", "venue", "category")
    moved = changes.groupBy("after").agg(F.count("*").alias("moved_in"))
    return tally.join(moved, F.col("category") == moved["after"], "left").select("category", "before", tally["after"], F.coalesce("moved_in", F.lit(0)).alias("moved_in"))
