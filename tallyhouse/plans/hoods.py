"""Neighbourhoods through the read path: rows, feeds, relations and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import keys
from tallyhouse.functions import text as X
from tallyhouse.functions.titles import shown_title
from tallyhouse.operators import reading
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, SPANS, listings, today
from tallyhouse.plans.reading import _AREA, _TIER
from tallyhouse.plans.registry import QUERIES as REGISTRY
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}

#: Fixed values of this fixture: neighbourhoods on a grid, with their city.
HOODS = [(i, f"hood-{i:02d}", 44.55 + 0.25 * (i // 4), -93.75 + 0.25 * (i % 4), 12.0 + i, "Minneapolis" if i % 2 else "St. Paul") for i in range(16)]
_VALUES = ", ".join(f"({i}, '{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {r!r}::DOUBLE, '{c}')" for i, n, a, b, r, c in HOODS)
#: hooded: spans with their neighbourhood.
_HOODED = SPANS + f""", hoods(position, hood, hlat, hlng, radius, hcity) AS (VALUES {_VALUES}),
    d AS (SELECT id, hood, position, radius, 2 * 6371.0 * asin(sqrt(pow(sin(radians(hlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(hlat)) * pow(sin(radians(hlng - lng) / 2), 2))) AS km FROM spans CROSS JOIN hoods),
    n AS (SELECT id, arg_min(hood, (km, position)) AS hood FROM d WHERE km <= radius GROUP BY 1), hooded AS (SELECT spans.*, hood FROM spans LEFT JOIN n USING (id))"""


def _hoods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([h[:5] for h in HOODS], "position int, centre string, lat double, lng double, radius_km double")


def _hooded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.with_hood(listings(spark, sf_dir), _hoods(spark))


@query(QUERIES, f"""WITH t AS (SELECT * FROM ({REGISTRY["clean_titles"].sql})), h AS (SELECT * FROM ({_HOODED} SELECT id, "start", category, CASE WHEN city IN ('Saint Paul, MN') THEN 'St. Paul, MN' ELSE city END AS city, coalesce(end_wall, "start") AS "end", {_TIER} AS tier, {_AREA} AS area, hood FROM hooded WHERE status = 'published')) SELECT h.*, t.title FROM h JOIN t USING (id)""")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read model with shown titles and neighbourhoods."""
    rows = reading.published(_hooded(spark, sf_dir))
    title = shown_title(F.col("title"), F.col("venue"), F.col("city"))
    return rows.select("id", "start", "category", keys.display_city(F.col("city")).alias("city"), F.coalesce("end_wall", "start").alias("end"), X.price_tier(F.col("price")).alias("tier"), keys.area(F.col("city")).alias("area"), "hood", title.alias("title"))


@query(QUERIES, _HOODED + f" SELECT hood AS slug, id FROM hooded, clock WHERE status = 'published' AND hood IS NOT NULL AND start_day <= today + {reading.FEED_DAYS} AND last_day >= today")
def hood_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feed of each neighbourhood holds."""
    names = [h[1] for h in HOODS]
    rows = reading.published(_hooded(spark, sf_dir))
    return reading.in_feeds(rows, names, today(spark, sf_dir), hood=F.col("hood"), hoods=names).select("slug", "id")


_ASKED = "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'venue-hall-' || CAST(o_orderkey % 40 AS {s}) WHEN 1 THEN 'hood-' || lpad(CAST(o_orderkey % 20 AS {s}), 2, '0') WHEN 2 THEN split_part('this-weekend|music|weird|unique|live-music|date-night|arts', '|', CAST(o_orderkey % 7 AS INT) + 1) WHEN 3 THEN 'venue-' WHEN 4 THEN 'Music' ELSE 'x' || CAST(o_orderkey % 9 AS {s}) END"


@query(QUERIES, LISTINGS + f""", a AS (SELECT DISTINCT {_ASKED.format(s='VARCHAR')} AS slug FROM orders), v AS (SELECT DISTINCT 'venue-' || replace(lower(venue), ' ', '-') AS slug, replace(lower(venue), ' ', '-') AS key FROM listings WHERE venue LIKE 'Hall%'),
    k AS (SELECT slug, CASE WHEN slug = 'this-weekend' THEN 'weekend' WHEN slug IN ('music', 'unique', 'arts') THEN 'category' WHEN slug IN ('live-music', 'date-night') THEN 'collection' WHEN slug IN (SELECT slug FROM v) THEN 'venue' WHEN slug LIKE 'hood-%' AND CAST(right(slug, 2) AS INT) < 16 THEN 'neighborhood' END AS kind FROM a)
    SELECT slug, kind, CASE WHEN kind = 'venue' THEN substr(slug, 7) WHEN slug = 'unique' THEN 'weird' WHEN kind IS NOT NULL THEN slug END AS key FROM k""")
def asked_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What feed each slug that is asked for names, if any."""
    slugs = table(spark, sf_dir, "orders").select(F.expr(_ASKED.format(s="STRING")).alias("slug"))
    venues = listings(spark, sf_dir).where("venue LIKE 'Hall%'").select(keys.slug(F.col("venue")).alias("slug"))
    return reading.feed_kinds(slugs, venues, _hoods(spark).select(F.col("centre").alias("slug")))


@query(QUERIES, _HOODED + """, u AS (SELECT *, CASE WHEN venue = 'First Ave' THEN 'first avenue' WHEN venue = 'The Armory' THEN 'armory' WHEN venue = '7th St Entry' THEN '7th street entry' WHEN venue = 'Palace Theater' THEN 'palace theatre' WHEN venue = 'Xcel Energy Ctr' THEN 'xcel energy center' WHEN venue LIKE 'Hook%' THEN 'hook ladder theater mission room' ELSE lower(venue) END AS vkey, today FROM hooded, clock WHERE status = 'published'),
    c AS (SELECT * FROM u WHERE start_day = today), p AS (SELECT * FROM u WHERE "start" >= strftime(today, '%Y-%m-%d') || 'T12:00'),
    v AS (SELECT c.id, 'venue' AS kind, p.id AS related, row_number() OVER (PARTITION BY c.id ORDER BY p."start", p.id) AS pos FROM c JOIN p ON c.vkey = p.vkey AND c.vkey <> '' AND c.id <> p.id),
    h AS (SELECT c.id, 'neighborhood' AS kind, p.id AS related, row_number() OVER (PARTITION BY c.id ORDER BY p."start", p.id) AS pos FROM c JOIN p ON c.hood = p.hood AND c.id <> p.id WHERE c.id NOT IN (SELECT id FROM v))
    SELECT id, kind, related, CAST(pos AS INTEGER) AS pos FROM (SELECT * FROM v UNION ALL SELECT * FROM h) WHERE pos <= 4""")
def related_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each listing of today up to four that start from now on at its venue, else in its neighbourhood."""
    now = today(spark, sf_dir)
    rows = reading.published(_hooded(spark, sf_dir)).withColumn("vkey", keys.venue_key(F.col("venue")))
    return reading.related_rows(rows.where(F.col("start_day") == F.lit(now)), rows.where(F.col("start") >= f"{now}T12:00"))


@query(QUERIES, _HOODED + """, u AS (SELECT * FROM hooded, clock WHERE status = 'published' AND capped_last >= today)
    SELECT 'neighborhood' AS kind, hood AS name, count(*) AS n FROM u WHERE hood IS NOT NULL GROUP BY 2 UNION ALL SELECT 'venue', venue, count(*) FROM u WHERE venue LIKE 'Hall%' GROUP BY 2""")
def upcoming_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcoming listings of each neighbourhood and hall, spans counted to their last shown day."""
    rows = reading.with_span(reading.published(_hooded(spark, sf_dir))).where(F.col("capped_last") >= F.lit(today(spark, sf_dir)))
    hall = F.when(F.col("venue").startswith("Hall"), F.col("venue"))
    named = F.array(F.struct(F.lit("neighborhood").alias("kind"), F.col("hood").alias("name")), F.struct(F.lit("venue").alias("kind"), hall.alias("name")))
    return rows.select(F.explode(named).alias("g")).where("g.name IS NOT NULL").groupBy("g.kind", "g.name").agg(F.count("*").alias("n"))


@query(QUERIES, _HOODED + " SELECT hcity AS city, hood, count(*) AS n FROM hooded JOIN hoods USING (hood) WHERE status = 'published' GROUP BY ALL")
def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published listings of each district of the core cities; districts without any have no row."""
    of = spark.createDataFrame([(h[1], h[5]) for h in HOODS], "name string, city_of string")
    n = reading.published(_hooded(spark, sf_dir)).where("hood IS NOT NULL").groupBy("hood").agg(F.count("*").alias("n"))
    return n.join(of, F.col("hood") == F.col("name")).select(F.col("city_of").alias("city"), "hood", "n")
