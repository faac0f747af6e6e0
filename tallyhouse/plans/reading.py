"""The read path over listings: look-ups, filters, windows, collections and feeds."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import keys, spans
from tallyhouse.functions import text as X
from tallyhouse.operators import reading
from tallyhouse.operators.reading import COLLECTIONS, FEED_DAYS, CollectionSpec
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, SPANS, listings, today

QUERIES: dict[str, Registered] = {}

_TIER = "CASE WHEN price = '' THEN '$$' WHEN price = 'Free' THEN 'Free' WHEN price = '$12.50' THEN '$' WHEN price = '$25 - $80' THEN '$$' ELSE '$$$' END"
_AREA = "CASE WHEN city = 'Minneapolis' THEN 'mpls' WHEN city IN ('Saint Paul, MN', 'St. Paul') THEN 'stpaul' WHEN city = 'Woodbury' THEN 'east' WHEN city = 'Edina' THEN 'west' WHEN city = 'Bloomington' THEN 'south' WHEN city = 'Blaine' THEN 'north' ELSE 'other' END"
_NOW = "(strftime(today, '%Y-%m-%d') || 'T12:00')"


def _metres(lat: float, lng: float) -> str:
    return f"6371000.0 * acos(greatest(-1.0, least(1.0, cos(radians({lat})) * cos(radians(lat)) * cos(radians(lng) - radians({lng})) + sin(radians({lat})) * sin(radians(lat)))))"


@query(QUERIES, LISTINGS + f""" SELECT id, "start", category, CASE WHEN city IN ('Saint Paul, MN') THEN 'St. Paul, MN' ELSE city END AS city, coalesce(end_wall, "start") AS "end", {_TIER} AS tier, {_AREA} AS area, CASE WHEN length(description) > 180 THEN left(description, 179) || '…' ELSE description END AS description FROM listings WHERE status = 'published'""")
def published_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read model of all published listings, by start."""
    rows = reading.published(listings(spark, sf_dir))
    return rows.select("id", "start", "category", keys.display_city(F.col("city")).alias("city"), F.coalesce("end_wall", "start").alias("end"), X.price_tier(F.col("price")).alias("tier"), keys.area(F.col("city")).alias("area"), X.preview(F.col("description")).alias("description")).orderBy("start", "id")


@query(QUERIES, LISTINGS + " SELECT id, title, status FROM listings WHERE id = 1 AND status <> 'draft'")
def listing_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing that is no draft; no row if there is none."""
    return reading.lookup(listings(spark, sf_dir), 1).select("id", "title", "status")


@query(QUERIES, LISTINGS + ", p AS (SELECT i AS pos, i * i * 7 % 997 AS id FROM range(0, 60) t(i)) SELECT pos, p.id, title FROM p JOIN listings l ON l.id = p.id WHERE status <> 'draft'")
def listings_in_given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named listings in the order of the names, drafts left out."""
    return reading.in_order(listings(spark, sf_dir), [i * i * 7 % 997 for i in range(60)]).select("pos", "id", "title")


@query(QUERIES, SPANS + """ SELECT id, start_day < today AS running, CASE WHEN start_day >= today THEN CASE WHEN all_day THEN 'All day' ELSE ltrim(CASE WHEN substr("start", 15, 2) = '00' THEN strftime(CAST(replace("start", 'T', ' ') AS TIMESTAMP), '%I %p') ELSE strftime(CAST(replace("start", 'T', ' ') AS TIMESTAMP), '%I:%M %p') END, '0') END
    WHEN span_end IS NULL OR last_day < today THEN 'Ongoing' WHEN last_day = today THEN 'Last day' ELSE 'Through ' || strftime(last_day, '%b ') || CAST(day(last_day) AS VARCHAR) END AS label FROM spans, clock WHERE status <> 'draft' AND today BETWEEN start_day AND capped_last""")
def listings_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything on a day: first what has begun before, by title, then by time."""
    day = F.lit(today(spark, sf_dir))
    rows = reading.on_day(listings(spark, sf_dir).where("status <> 'draft'"), day)
    running = F.col("start_day") < day
    ordered = rows.orderBy(running.desc(), F.when(running, F.collate("title", "UNICODE")), "start", "id")
    return ordered.select("id", running.alias("running"), spans.day_time_label(F.col("start"), F.col("all_day"), F.col("span_end"), day).alias("label"))


@query(QUERIES, LISTINGS + """ SELECT id, title, status FROM listings WHERE (title ILIKE '%rally%' OR venue ILIKE '%rally%' OR city ILIKE '%rally%') AND status = 'draft' ORDER BY "start" DESC, id LIMIT 100""")
def admin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, venue or city contain a text, in any case, with one status; the latest hundred."""
    return reading.admin_filter(listings(spark, sf_dir), "rally", "draft").select("id", "title", "status")


@query(QUERIES, LISTINGS + f" SELECT id FROM listings WHERE {_TIER} IN ('Free', '$') AND {_AREA} IN ('mpls', 'stpaul') AND category IN ('music', 'arts', 'food')")
def by_price_area_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of tiers, areas and categories; an empty set would ask for nothing."""
    return reading.narrowed(listings(spark, sf_dir), categories=["music", "arts", "food"], tiers=["Free", "$"], areas=["mpls", "stpaul"]).select("id")


@query(QUERIES, LISTINGS + f" SELECT id FROM listings WHERE {_metres(44.9778, -93.265)} <= 25 * 1609.344")
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within 25 miles of a centre."""
    return reading.near(listings(spark, sf_dir), 44.9778, -93.265, 25).select("id")


@query(QUERIES, LISTINGS + """, d AS (SELECT DISTINCT start_day AS day, dayofweek(start_day) AS w FROM listings)
    SELECT day, CASE WHEN w IN (0, 5, 6) THEN day ELSE day + CAST(5 - w AS INT) END AS weekend_first, CASE WHEN w = 0 THEN day ELSE day + CAST(7 - w AS INT) END AS weekend_last, CASE WHEN w = 0 THEN 1 WHEN w = 6 THEN 2 ELSE 3 END AS n_days,
    CASE WHEN w = 1 THEN day + 7 ELSE day + CAST((8 - w) % 7 AS INT) END AS next_monday, CAST(date_trunc('week', day) AS DATE) AS week, CAST(date_trunc('month', day) AS DATE) AS month_first, last_day(day) AS month_last,
    CAST(floor((day - DATE '1970-01-01') / 7.0) AS BIGINT) AS week_index FROM d""")
def calendar_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day its weekend, the Monday after it, its week, month and epoch week."""
    d = listings(spark, sf_dir).select(F.col("start_day").alias("day")).distinct()
    w = spans.weekend_days(F.col("day"))
    index = F.floor(F.datediff("day", F.lit(date(1970, 1, 1))) / 7)
    return d.select("day", F.element_at(w, 1).alias("weekend_first"), F.element_at(w, -1).alias("weekend_last"), F.size(w).alias("n_days"), F.next_day("day", "MO").alias("next_monday"), F.to_date(F.date_trunc("week", "day")).alias("week"), F.to_date(F.date_trunc("month", "day")).alias("month_first"), F.last_day("day").alias("month_last"), index.alias("week_index"))


@query(QUERIES, LISTINGS + ", w AS (SELECT CASE WHEN dayofweek(today) IN (0, 5, 6) THEN today ELSE today + CAST(5 - dayofweek(today) AS INT) END AS a, CASE WHEN dayofweek(today) = 0 THEN today ELSE today + CAST(7 - dayofweek(today) AS INT) END AS b FROM clock) SELECT id, start_day FROM listings, w WHERE start_day BETWEEN a AND b AND category IN ('music', 'arts')")
def weekend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts within the weekend preset, by start."""
    first, last = spans.preset("weekend", today(spark, sf_dir))
    return reading.starting(reading.narrowed(listings(spark, sf_dir), categories=["music", "arts"]), first, last).select("id", "start_day")


@query(QUERIES, LISTINGS + """ SELECT category, count(*) AS n, min("start") AS first FROM listings, clock WHERE start_day > today + 6 GROUP BY 1""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings of a category lie beyond the week's window, and the first of them."""
    _, last = spans.preset("week", today(spark, sf_dir))
    return listings(spark, sf_dir).where(F.col("start_day") > F.lit(last)).groupBy("category").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query(QUERIES, LISTINGS + f""" SELECT id FROM listings, clock WHERE lower(title) LIKE '%show%' AND {_TIER} IN ('Free', '$$') AND {_AREA} IN ('mpls', 'west', 'south') AND {_metres(44.9778, -93.265)} <= 50 * 1609.344 AND category IN ('music', 'food', 'arts', 'family') AND start_day BETWEEN today AND today + 6""")
def explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, price, area, radius, category and window in one plan."""
    first, last = spans.preset("week", today(spark, sf_dir))
    rows = listings(spark, sf_dir).where(X.matches(F.col("title"), "show"))
    rows = reading.narrowed(rows, categories=["music", "food", "arts", "family"], tiers=["Free", "$$"], areas=["mpls", "west", "south"])
    return reading.starting(reading.near(rows, 44.9778, -93.265, 50), first, last).select("id")


def _collection_sql(c: CollectionSpec) -> str:
    where = ["status = 'published'", f'"start" >= {_NOW}']
    weekend = "(CASE WHEN dayofweek(today) = 0 THEN today ELSE today + CAST(7 - dayofweek(today) AS INT) END)"
    first = "(CASE WHEN dayofweek(today) IN (0, 5, 6) THEN today ELSE today + CAST(5 - dayofweek(today) AS INT) END)"
    where.append(f"start_day BETWEEN {first} AND {weekend}" if c.window == "weekend" else f"start_day <= today + {c.days}")
    for names, column in ((c.categories, "category"), (c.tiers, _TIER)):
        if names:
            where.append(f"{column} IN ({', '.join(repr(n) for n in names)})")
    if c.query:
        where.append(" AND ".join(f"lower(title) LIKE '%{t}%'" for t in c.query.split()))
    return f"SELECT '{c.slug}' AS slug, id FROM listings, clock WHERE {' AND '.join(where)}"


@query(QUERIES, LISTINGS + " " + " UNION ALL ".join(_collection_sql(c) for c in COLLECTIONS))
def collection_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each collection shows: published, still to start, in its window, by its sets and search."""
    rows, now = listings(spark, sf_dir), today(spark, sf_dir)
    return reading.in_collections(rows, COLLECTIONS, now, f"{now}T12:00").select("slug", "id")


@query(QUERIES, SPANS + f""", p AS (SELECT * FROM spans, clock WHERE status = 'published'), w AS (SELECT * FROM p WHERE start_day <= today + {FEED_DAYS} AND last_day >= today),
    d AS (SELECT CASE WHEN dayofweek(today) IN (0, 5, 6) THEN today ELSE today + CAST(5 - dayofweek(today) AS INT) END AS a, CASE WHEN dayofweek(today) = 0 THEN today ELSE today + CAST(7 - dayofweek(today) AS INT) END AS b FROM clock)
    SELECT 'this-weekend' AS slug, id FROM p, d WHERE start_day <= b AND last_day >= a UNION ALL SELECT CASE category WHEN 'weird' THEN 'unique' ELSE category END, id FROM w
    UNION ALL SELECT 'free-this-week', id FROM w WHERE {_TIER} = 'Free' UNION ALL SELECT 'venue-hall-7', id FROM w WHERE venue = 'Hall 7'""")
def feed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calendar feeds hold: 30 days by true span, or the days of the weekend."""
    rows, now = listings(spark, sf_dir).where("status = 'published'"), today(spark, sf_dir)
    named = ["this-weekend", *[reading.category_slug(c) for c in reading.CATEGORIES], "free-this-week", "venue-hall-7"]
    return reading.in_feeds(rows, named, now, venues={"hall-7"}).select("slug", "id")


@query(QUERIES, LISTINGS + """ SELECT id, "start" FROM listings, clock WHERE status = 'published' AND url <> '' AND "start" >= """ + _NOW + """ AND start_day <= today + 7 AND NOT (start_day = today + 7 AND substr("start", 12) > '12:00') ORDER BY "start", id LIMIT 40""")
def verification_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, with an address, starting within seven days: the soonest forty."""
    now = today(spark, sf_dir)
    rows = reading.published(listings(spark, sf_dir)).where((F.col("url") != "") & F.col("start").between(f"{now}T12:00", f"{now + timedelta(days=7)}T12:00"))
    return rows.orderBy("start", "id").limit(40).select("id", "start")


@query(QUERIES, LISTINGS + """ SELECT id FROM listings WHERE NOT all_day AND CAST(substr("start", 12, 2) AS INT) < 7""")
def improbable_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts before seven in the morning that are not all-day."""
    hour = F.substring("start", 12, 2).cast("int")
    return listings(spark, sf_dir).where(~F.col("all_day") & (hour < spans.EARLY_HOUR)).select("id")


@query(QUERIES, LISTINGS + f""", c AS (SELECT CASE WHEN city IN ('Saint Paul, MN', 'St. Paul') THEN 'st paul' ELSE lower(city) END AS city, lat, lng FROM listings) SELECT city, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM c GROUP BY 1""")
def city_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean place and count of each city, busiest first."""
    rows = listings(spark, sf_dir).withColumn("city", keys.area_city(F.col("city"))).where("city <> ''")
    return rows.groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng")).orderBy(F.desc("n"), "city")


@query(QUERIES, LISTINGS + """, v AS (SELECT venue, CAST(round(lat, 5) AS VARCHAR) || ',' || CAST(round(lng, 5) AS VARCHAR) AS spot, min(id) AS first, count(*) AS n FROM listings WHERE NOT (lat = 0 AND lng = 0) AND venue <> '' GROUP BY ALL) SELECT venue, spot, n FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY n DESC, first) AS r FROM v) WHERE r = 1""")
def usual_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest coordinates of each venue, to five places; the first seen of equals; (0, 0) is none."""
    rows = listings(spark, sf_dir).where("NOT (lat = 0 AND lng = 0) AND venue <> ''")
    spot = F.concat_ws(",", F.round("lat", 5).cast("string"), F.round("lng", 5).cast("string"))
    return reading.usual(rows.withColumn("spot", spot), "venue", "spot", "id").select("venue", "spot", "n")


@query(QUERIES, LISTINGS + f""", u AS (SELECT * FROM listings, clock WHERE status = 'published' AND start_day >= today) SELECT 'city' AS kind, CASE WHEN city IN ('Saint Paul, MN', 'St. Paul') THEN 'st paul' ELSE lower(city) END AS name, count(*) AS n FROM u GROUP BY ALL
    UNION ALL SELECT 'area', {_AREA}, count(*) FROM u GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM u GROUP BY ALL""")
def upcoming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcoming listings by city, area and category; what has none has no row."""
    rows = reading.published(listings(spark, sf_dir)).where(F.col("start_day") >= F.lit(today(spark, sf_dir)))
    named = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("city", keys.area_city(F.col("city"))), ("area", keys.area(F.col("city"))), ("category", F.col("category")))])
    return rows.select(F.explode(named).alias("g")).groupBy("g.kind", "g.name").agg(F.count("*").alias("n"))


@query(QUERIES, LISTINGS + """, u AS (SELECT *, CASE WHEN venue = 'First Ave' THEN 'first avenue' WHEN venue = 'The Armory' THEN 'armory' WHEN venue = '7th St Entry' THEN '7th street entry' WHEN venue = 'Palace Theater' THEN 'palace theatre' WHEN venue = 'Xcel Energy Ctr' THEN 'xcel energy center' WHEN venue LIKE 'Hook%' THEN 'hook ladder theater mission room' ELSE lower(venue) END AS vkey FROM listings WHERE status = 'published')
    SELECT a.id, b.id AS related, row_number() OVER (PARTITION BY a.id ORDER BY b."start", b.id) AS pos FROM (SELECT * FROM u, clock WHERE start_day = today) a JOIN (SELECT * FROM u, clock WHERE start_day >= today) b ON a.vkey = b.vkey AND a.vkey <> '' AND a.id <> b.id QUALIFY pos <= 4""")
def related_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each listing of today up to four upcoming ones of the same venue, under whatever name."""
    now = today(spark, sf_dir)
    rows = reading.published(listings(spark, sf_dir)).where(F.col("start_day") >= F.lit(now)).withColumn("vkey", keys.venue_key(F.col("venue"))).where("vkey <> ''")
    return reading.related(rows.where(F.col("start_day") == F.lit(now)), rows, "vkey")


@query(QUERIES, LISTINGS + """, s AS (SELECT l_suppkey % 150 AS token, l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT id, count(*) AS saves FROM s GROUP BY 1)
    SELECT l.id, title, saves FROM t JOIN listings l USING (id), clock WHERE status = 'published' AND start_day >= today AND saves >= 3 ORDER BY saves DESC, l.id LIMIT 3""")
def most_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three upcoming listings saved most, by three tokens at least."""
    saved = reading.saves(spark, sf_dir)
    live = reading.published(listings(spark, sf_dir)).where(F.col("start_day") >= F.lit(today(spark, sf_dir)))
    top = saved.groupBy("id").agg(F.count("*").alias("saves")).where("saves >= 3")
    return live.join(top, "id").orderBy(F.desc("saves"), "id").limit(3).select("id", "title", "saves")


@query(QUERIES, LISTINGS + """, s AS (SELECT DISTINCT l_suppkey % 150 AS token, l_orderkey AS id FROM lineitem), c AS (SELECT token, category, count(*) AS n, min(CASE category WHEN 'music' THEN 0 WHEN 'sports' THEN 1 WHEN 'family' THEN 2 WHEN 'arts' THEN 3 WHEN 'food' THEN 4 WHEN 'weird' THEN 5 ELSE 6 END) AS place FROM s JOIN listings USING (id) GROUP BY ALL)
    SELECT token, category, n, row_number() OVER (PARTITION BY token ORDER BY n DESC, place) AS rank FROM c""")
def category_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token has saved each category; ties in the categories' own order."""
    return reading.affinity(reading.saves(spark, sf_dir).join(listings(spark, sf_dir).select("id", "category"), "id"))
