"""Dimensions, placements, repairs, titles and scored categories of listings."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import titles
from tallyhouse.operators import reading, registry
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, listings, today
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
#: Fixed values of this fixture.
ALIASES = [(0, "First Avenue", "first-avenue"), (1, "first ave", "first-avenue"), (2, "The Armory", "armory"), (3, "the armory!", "other-armory"), (4, "Hall 7", "hall-7")]
_ALIAS = "(VALUES ('first ave', 'first-avenue'), ('the armory', 'armory'), ('hall 7', 'hall-7')) a(k, slug)"


@query(QUERIES, LISTINGS + f" SELECT id, coalesce(slug, 'elsewhere') AS slug FROM listings LEFT JOIN {_ALIAS} ON lower(venue) = k")
def venue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each listing's venue by its registered names."""
    aliases = spark.createDataFrame(ALIASES, "pos int, alias string, slug string")
    return registry.with_dimension(listings(spark, sf_dir), F.col("venue"), aliases, "elsewhere").select("id", "slug")


@query(QUERIES, "SELECT DISTINCT s_suppkey * 1000 AS id FROM supplier WHERE s_suppkey * 1000 NOT IN (SELECT o_orderkey FROM orders)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a list that the table has not."""
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 1000).alias("id"))
    return registry.missing(ids, listings(spark, sf_dir))


@query(QUERIES, LISTINGS + " SELECT 'changed' AS state, id, CASE WHEN id IN (SELECT s_suppkey * 3 FROM supplier) THEN 'cancelled' ELSE status END AS status, price FROM listings UNION ALL SELECT 'restored', id, status, price FROM listings")
def restored_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings after a change, and after it was undone by the backup taken before."""
    rows = listings(spark, sf_dir)
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("id"))
    before = registry.backup(rows, ids, ["status", "price"])
    named = ids.select(F.col("id").alias("of")).distinct()
    changed = rows.join(named, F.col("id") == F.col("of"), "left").withColumn("status", F.when(F.col("of").isNotNull(), "cancelled").otherwise(F.col("status"))).drop("of")
    state = lambda name, d: d.select(F.lit(name).alias("state"), "id", "status", "price")
    return state("changed", changed).unionByName(state("restored", registry.restore(changed, before)))


@query(QUERIES, LISTINGS + ", p AS (SELECT s_suppkey * 5 AS id, 'Pick ' || s_suppkey AS label, today - CAST(s_suppkey % 9 AS INT) AS starts, today + CAST(s_suppkey % 4 AS INT) - 2 AS ends FROM supplier, clock) SELECT id, label, CAST(row_number() OVER (ORDER BY starts DESC, id) AS INTEGER) AS pos FROM p, clock WHERE today BETWEEN starts AND ends AND id IN (SELECT id FROM listings WHERE status = 'published') ORDER BY pos LIMIT 2")
def featured_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two placements in force that began last."""
    now = today(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    day = F.lit(now)
    p = s.select((F.col("s_suppkey") * 5).alias("id"), F.concat(F.lit("Pick "), F.col("s_suppkey").cast("string")).alias("label"), F.date_sub(day, (F.col("s_suppkey") % 9).cast("int")).alias("starts"), F.date_add(day, (F.col("s_suppkey") % 4 - 2).cast("int")).alias("ends"))
    return registry.featured(p, reading.published(listings(spark, sf_dir)), day, 2)


@query(QUERIES, LISTINGS + """ SELECT id, CAST(floor((row_number() OVER (ORDER BY "start", id) - 1) / 8) AS BIGINT) AS chunk FROM listings, clock WHERE status = 'published' AND start_day BETWEEN today AND today + 6""")
def work_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's listings in batches of eight."""
    now = today(spark, sf_dir)
    week = reading.published(listings(spark, sf_dir)).where(F.col("start_day").between(F.lit(now), F.lit(now + timedelta(days=6))))
    return registry.chunks(week, ["start", "id"], 8).select("id", "chunk")


#: Fixed values of this fixture: patterns with their weights, and what venues hint at.
RULES = {"music": {r"\bjazz\b": 3, r"\bblues\b": 2, r"\bmusic\b": 1}, "food": {r"\bfood\b": 3, r"\btrucks?\b": 2}, "festival": {r"\bfestival\b": 3, r"\bfair\b": 2}, "arts": {r"\bcaf[eé]\b": 1}}
VENUE_RULES = {"arts": {r"\btheater\b": 6}}
_SCORES = {"music": "(CASE WHEN title LIKE 'Jazz%' THEN 10 ELSE 0 END + CASE WHEN description LIKE 'Doors%' THEN 1 ELSE 0 END)", "food": "((CASE WHEN title LIKE 'Food%' THEN 10 ELSE 0 END + CASE WHEN description LIKE 'Doors%' THEN 5 ELSE 0 END) * CASE WHEN venue LIKE '%Theater%' THEN 0.25 ELSE 1 END)", "festival": "CASE WHEN title LIKE '%Festival%' THEN 6 ELSE 0 END", "arts": "(CASE WHEN title LIKE 'Café%' THEN 2 ELSE 0 END + CASE WHEN venue LIKE '%Theater%' THEN 12 ELSE 0 END)"}
_MOST = f"greatest({', '.join(_SCORES.values())})"


@query(QUERIES, LISTINGS + f" SELECT id, CASE WHEN {_MOST} = 0 THEN category " + " ".join(f"WHEN {s} = {_MOST} THEN '{n}'" for n, s in _SCORES.items()) + " END AS category FROM listings")
def scored_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by weighted words of title, text and venue; a theatre speaks for the arts and damps food."""
    theatre = F.lower("venue").rlike(r"\btheater\b")
    scores = registry.category_scores(F.col("title"), F.col("description"), F.col("venue"), RULES, VENUE_RULES)
    scores = registry.muted(scores, theatre, ("food", "sports"), 0.25, {"arts": 6.0})
    return listings(spark, sf_dir).select("id", registry.best_category(scores, F.col("category")).alias("category"))


@query(QUERIES, LISTINGS + r""" SELECT id, CASE WHEN title LIKE 'Jazz%' THEN replace(title, ' (Saturdays)', '') WHEN title LIKE 'Café%' THEN replace(title, '—', '–') ELSE title END AS title FROM listings""")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as they are shown."""
    return listings(spark, sf_dir).select("id", titles.shown_title(F.col("title"), F.col("venue"), F.col("city")).alias("title"))


@query(QUERIES, LISTINGS + r""" SELECT id, left(trim(regexp_replace(strftime(start_day, '%A, %B ') || CAST(day(start_day) AS VARCHAR) || ' at ' || concat_ws(', ', CASE WHEN venue <> '' THEN venue END, CASE WHEN city <> '' THEN city END) || '. ' || price || '.' || CASE WHEN description <> '' THEN ' ' || description ELSE '' END, '\s+', ' ', 'g')), 200) AS description FROM listings""")
def meta_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return rows.select("id", registry.meta_description(rows).alias("description"))


@query(QUERIES, LISTINGS + ", g AS (SELECT DISTINCT city AS c, length(city) / 10.0 AS lat, -93.0 AS lng FROM listings WHERE city <> 'Duluth') SELECT id, CAST(g.lat AS DOUBLE) AS lat FROM listings l JOIN g ON g.c = l.city")
def geocoded_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings placed by a table of answers; those without one are dropped."""
    rows = listings(spark, sf_dir).select("id", "city")
    found = rows.select("city").distinct().withColumn("lat", F.when(F.col("city") != "Duluth", F.length("city") / 10.0)).withColumn("lng", F.lit(-93.0))
    return registry.geocoded(rows, found, "city").select("id", "lat")


@query(QUERIES, "SELECT event_id, 'beacon:' || CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '10.0.0.' || event_id % 200 ELSE '2001:db8::' || event_id % 9 END AS bucket FROM events")
def limiter_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of requests by their first hop."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' 10.0.0.' || CAST(event_id % 200 AS STRING) || ', 10.9.9.9' ELSE '2001:db8::' || CAST(event_id % 9 AS STRING) END AS hops")
    return e.select("event_id", registry.bucket_name("beacon", F.col("hops")).alias("bucket"))
