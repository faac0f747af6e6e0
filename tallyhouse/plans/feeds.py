"""Feeds of games and shows against listings, and the collapse of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import keys, titles
from tallyhouse.operators import feeds
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, listings, today
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
#: Fixed values of this fixture: days with shipments stand for days with games and shows.
_GAMES = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CASE CAST(day(l_shipdate) % 3 AS INT) WHEN 0 THEN 'Foo' WHEN 1 THEN 'Chicago Red Stars' ELSE 'New Foo City' END AS opponent, day(l_shipdate) % 4 > 0 AS home, CAST(CAST(l_shipdate AS DATE) AS STRING) || 'T19:00' AS start, day(l_shipdate) % 5 = 0 AS tbd FROM lineitem"
_BARE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_NAMED = f"(contains({_BARE.format('title')}, {_BARE.format('opponent')}) OR opponent = 'Chicago Red Stars' AND (contains({_BARE.format('title')}, 'redstars') OR contains({_BARE.format('title')}, 'stars') OR contains({_BARE.format('title')}, 'chicagored')) OR opponent = 'New Foo City' AND (contains({_BARE.format('title')}, 'foocity') OR contains({_BARE.format('title')}, 'newfoo')))"


@query(QUERIES, LISTINGS + f""", games AS ({_GAMES.replace(' AS start,', ' AS "start",')}), w AS (SELECT min(day) AS lo, max(day) AS hi FROM games), h AS (SELECT * FROM games WHERE home), rows AS (SELECT id, start_day AS day, "start", title FROM listings, clock WHERE category = 'sports' AND start_day >= today),
    j AS (SELECT r.id, r.day, CASE WHEN lo IS NULL OR r.day < lo OR r.day > hi THEN 'unknown' WHEN h.day IS NULL THEN 'phantom' WHEN NOT {_NAMED} THEN 'wrong-opponent' WHEN tbd OR r."start" = h."start" THEN 'ok' ELSE 'retime' END AS verdict FROM rows r CROSS JOIN w LEFT JOIN h ON h.day = r.day)
    SELECT id, day, verdict FROM j UNION ALL SELECT NULL, h.day, 'missing' FROM h, clock WHERE h.day >= today AND h.day NOT IN (SELECT day FROM j WHERE verdict IN ('ok', 'retime'))""")
def game_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sports listings against a league's feed."""
    games = spark.sql(_GAMES.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    listed = listings(spark, sf_dir).where("category = 'sports'").select("id", F.col("start_day").alias("day"), "start", "title")
    return feeds.reconcile_games(listed, games, today(spark, sf_dir))


_SHOWS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN 'First Ave' WHEN 1 THEN 'THE ARMORY' ELSE 'Hall 7' END AS venue, CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'Jazz & Blues ' || CAST(l_suppkey % 53 AS STRING) || ' live' WHEN 1 THEN 'Cafe Night tour' WHEN 2 THEN 'Sever''s fall festival' ELSE 'Somebody Else ' || CAST(l_suppkey % 7 AS STRING) END AS title FROM lineitem WHERE l_quantity > 45"
_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in feeds.NOISE) + ") AND NOT regexp_full_match(w, '\\d{{1,2}}')))"
_WHOLE = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_SAME = "(a.whole = b.whole AND a.whole <> '' OR len(a.words) > 0 AND len(b.words) > 0 AND len(list_intersect(a.words, b.words)) >= 0.6 * least(len(a.words), len(b.words)) AND len(list_filter(list_intersect(a.words, b.words), lambda w: length(w) >= 4)) > 0)"


@query(QUERIES, LISTINGS + f""", raw AS ({_SHOWS}), feed AS (SELECT DISTINCT day, lower(venue) AS room, {_WORDS.format('title')} AS words, {_WHOLE.format('title')} AS whole FROM raw), w AS (SELECT min(day) AS lo, max(day) AS hi FROM feed),
    rows AS (SELECT id, start_day AS day, lower(venue) AS room, {_WORDS.format('title')} AS words, {_WHOLE.format('title')} AS whole, lower(venue) IN ('first ave', 'the armory', 'hall 7') AND start_day BETWEEN lo AND hi AS inside FROM listings, clock, w WHERE start_day >= today),
    here AS (SELECT a.id, coalesce(bool_or({_SAME}), false) AS hit, count(b.day) AS on_ FROM rows a LEFT JOIN feed b ON a.day = b.day AND a.room = b.room GROUP BY 1),
    far AS (SELECT DISTINCT a.id FROM rows a JOIN feed b ON (a.day <> b.day OR a.room <> b.room) AND {_SAME} WHERE a.inside)
    SELECT r.id, CASE WHEN NOT inside THEN 'unknown' WHEN hit THEN 'ok' WHEN room NOT IN ('first ave', 'the armory') THEN 'unknown' WHEN r.id IN (SELECT id FROM far) THEN 'moved' WHEN on_ = 0 THEN 'phantom' ELSE 'unmatched' END AS verdict FROM rows r JOIN here USING (id)""")
def show_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of venues against the shows of their rooms, titles matched loosely."""
    shows = spark.sql(_SHOWS.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    listed = listings(spark, sf_dir).select("id", F.col("start_day").alias("day"), "venue", "title")
    return feeds.reconcile_shows(listed, shows, today(spark, sf_dir), ("First Ave", "The Armory"), ("First Ave", "The Armory", "Hall 7"))


def _collapsible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where("status IN ('published', 'draft')")
    return rows.select("id", "title", "city", "category", "start_day", F.to_date(F.left("multi_day_end", F.lit(10))).alias("end_day"))


_RUN = r"""trim(regexp_replace(regexp_replace(CASE WHEN title LIKE 'Café%' THEN regexp_replace(lower(title), '\s*— opening weekend$', '') WHEN title LIKE 'Food%' THEN 'food truck rally' WHEN title LIKE 'Sever%' THEN 'severs fall festival' ELSE regexp_replace(lower(title), '\([^)]*\)', ' ', 'g') END, '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"""
_CITY = "CASE WHEN city = 'Saint Paul, MN' THEN 'st paul mn' WHEN city = 'St. Paul' THEN 'st paul' ELSE lower(city) END"


@query(QUERIES, LISTINGS + f""", r AS (SELECT id, {_RUN} AS t, {_CITY} AS c, category, start_day, CAST(left(multi_day_end, 10) AS DATE) AS e FROM listings WHERE status IN ('published', 'draft')), s AS (SELECT *, bool_or(category = 'sports') OVER (PARTITION BY c, t) AS sports FROM r),
    l AS (SELECT *, CASE WHEN sports THEN start_day ELSE greatest(start_day, coalesce(e, start_day)) END AS last FROM s), m AS (SELECT *, max(last) OVER (PARTITION BY c, t ORDER BY start_day, last, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_day - reach > CASE WHEN sports THEN 0 ELSE 1 END THEN 1 ELSE 0 END) OVER (PARTITION BY c, t ORDER BY start_day, last, id ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT c AS city_key, t AS title_key, min(start_day) AS start_day, max(last) AS end_day, count(*) AS n FROM n GROUP BY c, t, run HAVING count(*) > 1""")
def collapsible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than one listing of a title in a city."""
    m = feeds.clusters(_collapsible(spark, sf_dir))
    return m.groupBy("city_key", "title_key", "cluster").agg(F.min("start_day").alias("start_day"), F.max("last_day").alias("end_day"), F.count("*").alias("n")).where("n > 1").drop("cluster")


@query(QUERIES)
def collapse_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of runs, duplicates and folded titles; tested against a plain loop."""
    return feeds.collapse_plan(_collapsible(spark, sf_dir))


@query(QUERIES, LISTINGS + f" SELECT id, {_RUN} AS run_title, {_CITY} AS run_city FROM listings")
def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", titles.run_title(F.col("title")).alias("run_title"), keys.run_city(F.col("city")).alias("run_city"))
