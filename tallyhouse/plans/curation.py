"""Picks for digests and cards, and the places registry."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions import spans
from tallyhouse.operators import curation, reading
from tallyhouse.operators.ranking import first_per
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, SPANS, listings, today
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
_SCORE = "(CASE WHEN url <> '' THEN 2 ELSE 0 END + CASE WHEN length(description) > 40 THEN 2 ELSE 0 END + CASE WHEN dayofweek(start_day) IN (0, 5, 6) THEN 2 ELSE 0 END + CASE WHEN price = 'Free' THEN 1 ELSE 0 END + CASE WHEN image LIKE 'http%' THEN 1 ELSE 0 END)"
_POOL = LISTINGS + f""", pool AS (SELECT l.*, today, {_SCORE} AS score, row_number() OVER (ORDER BY {_SCORE} DESC, "start", title, id) AS pos FROM listings l, clock WHERE status = 'published' AND "start" >= strftime(today, '%Y-%m-%d') || 'T12:00' AND "start" <= strftime(today + 7, '%Y-%m-%d') || 'T12:00')"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = today(spark, sf_dir)
    return curation.picked_pool(listings(spark, sf_dir), f"{now}T12:00", f"{now + timedelta(days=7)}T12:00")


@query(QUERIES, _POOL + " SELECT id, CAST(score AS INTEGER) AS score, pos FROM pool")
def weekly_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's listings by how worth sharing they are."""
    # a week's listings: the window's one partition holds no more
    return _pool(spark, sf_dir).select("id", "score", F.row_number().over(Window.orderBy("order")).cast("bigint").alias("pos"))


@query(QUERIES, _POOL + " SELECT category, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos) AS r FROM pool WHERE category IN ('family', 'weird')) WHERE r = 1")
def family_and_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best family and the best unusual listing of the week."""
    best = _pool(spark, sf_dir).where(F.col("category").isin("family", "weird")).groupBy("category").agg(F.min("order").alias("o"))
    return best.select("category", F.col("o.id").alias("id"))


_HALVES = _POOL.replace("WITH listings", "WITH RECURSIVE listings", 1) + """, p AS (SELECT *, CASE WHEN start_day >= today + CASE WHEN dayofweek(today) = 1 THEN 7 ELSE CAST((8 - dayofweek(today)) % 7 AS INT) END THEN 'later' ELSE 'soon' END AS half FROM pool),
    o AS (SELECT half, id, lower(trim(venue)) AS v, start_day AS d, row_number() OVER (PARTITION BY half ORDER BY pos) AS r FROM p),
    f AS (SELECT half, 0::BIGINT AS r, 0 AS n, false AS took, []::VARCHAR[] AS vs, []::DATE[] AS ds FROM (VALUES ('soon'), ('later')) h(half) UNION ALL
        SELECT half, r, CASE WHEN ok THEN n + 1 ELSE n END, ok, CASE WHEN ok AND v <> '' THEN list_append(vs, v) ELSE vs END, CASE WHEN ok THEN list_append(ds, d) ELSE ds END FROM
        (SELECT o.half, o.r, f.n, f.vs, f.ds, o.v, o.d, f.n < 8 AND NOT list_contains(f.vs, o.v) AND len(list_filter(f.ds, lambda x: x = o.d)) < 2 AS ok FROM f JOIN o ON o.half = f.half AND o.r = f.r + 1)),
    t AS (SELECT f.half, f.n, o.id, p."start" FROM f JOIN o ON o.half = f.half AND o.r = f.r JOIN p ON p.id = o.id WHERE took)"""


@query(QUERIES, _HALVES + """ SELECT half, id FROM t WHERE half = 'later' AND n <= 3 OR half = 'soon' AND n <= 8 - (SELECT least(3, count(*)) FROM t WHERE half = 'later')""")
def digest_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight picks, up to three of them from Monday on; each half spreads over venues and days by itself."""
    now = today(spark, sf_dir)
    monday = now + timedelta(days=(7 - now.weekday()) or 7)
    pool = _pool(spark, sf_dir).withColumn("half", F.when(F.col("start_day") >= F.lit(monday), "later").otherwise("soon"))
    picks = curation.spread_pool(pool, 8)
    later = picks.where("half = 'later' AND pick <= 3")
    left = F.broadcast(later.agg((F.lit(8) - F.count("*")).alias("left")))  # one row
    soon = picks.where("half = 'soon'").join(left, F.col("pick") <= F.col("left")).drop("left")
    return later.unionByName(soon).select("half", "id")


_REASON = r"""CASE WHEN regexp_matches(t, '\bdrag\b') AND NOT regexp_matches(t, '\bdrag\s+(?:rac|strip)') THEN 'drag' WHEN regexp_matches(t, '\b(?:protest|political|politics|election|campaign|senator|governor|mayoral|city council|caucus|gop|dfl|democrat|republican|maga)\b') OR (regexp_matches(t, '\brally\b') AND NOT regexp_matches(t, '\brally\s*(?:car|cross)')) OR regexp_matches(t, '\bmarch\s+(?:for|on|against)\b') THEN 'political' END"""


@query(QUERIES, LISTINGS + f", t AS (SELECT id, lower(title || ' ' || description) AS t FROM listings), r AS (SELECT id, {_REASON} AS reason FROM t) SELECT id, reason FROM r WHERE reason IS NOT NULL")
def excluded_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exclusion rules keep off cards, and why."""
    return listings(spark, sf_dir).select("id", curation.exclusion(F.col("title"), F.col("description")).alias("reason")).where("reason IS NOT NULL")


@query(QUERIES, SPANS + f""", c AS (SELECT id, category, "start", CASE WHEN category IN ('family', 'weird') THEN category ELSE 'regular' END AS variant, lower(title || ' ' || description) AS t FROM spans, clock WHERE status = 'published' AND start_day <= today + 6 AND capped_last >= today),
    k AS (SELECT *, row_number() OVER (PARTITION BY variant, category ORDER BY "start", id) AS n FROM c WHERE ({_REASON}) IS NULL)
    SELECT variant, CAST(pos AS INTEGER) AS pos, id FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY "start", id) AS pos FROM k WHERE variant <> 'regular' OR n <= 2) WHERE pos <= 5""")
def card_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's three cards of five."""
    first, last = spans.preset("week", today(spark, sf_dir))
    return curation.cards(listings(spark, sf_dir), [first, last])


@query(QUERIES, LISTINGS + """, s AS (SELECT DISTINCT l_suppkey % 150 AS token, l_orderkey AS id FROM lineitem), c AS (SELECT token, category, count(*) AS n, min(CASE category WHEN 'music' THEN 0 WHEN 'sports' THEN 1 WHEN 'family' THEN 2 WHEN 'arts' THEN 3 WHEN 'food' THEN 4 WHEN 'weird' THEN 5 ELSE 6 END) AS place FROM s JOIN listings USING (id) GROUP BY ALL),
    a AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, place) AS rank FROM c), """ + f"""pool AS (SELECT id, category, row_number() OVER (ORDER BY {_SCORE} DESC, "start", title, id) AS old FROM listings, clock WHERE status = 'published' AND "start" >= strftime(today, '%Y-%m-%d') || 'T12:00' AND "start" <= strftime(today + 7, '%Y-%m-%d') || 'T12:00' ORDER BY old LIMIT 8)
    SELECT t.token, CAST(row_number() OVER (PARTITION BY t.token ORDER BY coalesce(rank, 1073741824), old) AS INTEGER) AS pos, id FROM (SELECT DISTINCT token FROM a) t CROSS JOIN pool LEFT JOIN a ON a.token = t.token AND a.category = pool.category""")
def personal_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's best eight in each reader's own order."""
    best = _pool(spark, sf_dir).orderBy("order").limit(8).select(F.row_number().over(Window.orderBy("order")).alias("pos"), "id", "category")
    affinity = reading.affinity(reading.saves(spark, sf_dir).join(listings(spark, sf_dir).select("id", "category"), "id"))
    return curation.personal_order(best, affinity)


#: Fixed values of this fixture: parts stand for places.
_PLACE = {
    "slug": "'place-' || lpad(CAST(p_partkey AS STRING), 7, '0')",
    "kind": "CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'beach' WHEN 1 THEN 'rink' WHEN 2 THEN 'garden' WHEN 3 THEN 'trail' ELSE 'market' END",
    "cost": "CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'free' WHEN 1 THEN 'donation' ELSE 'paid' END",
    "city": "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Minneapolis' WHEN 1 THEN 'St. Paul' WHEN 2 THEN 'Edina' ELSE 'Eagan' END",
    "open_month": "CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 12 + 1 AS INT) END",
    "close_month": "CASE WHEN p_partkey % 4 > 0 THEN CAST((p_partkey * 5) % 12 + 1 AS INT) END",
    "lat": "CAST(44.5 AS DOUBLE) + CAST(p_partkey % 97 AS DOUBLE) / CAST(97 AS DOUBLE)",
    "lng": "CAST(-93.8 AS DOUBLE) + CAST(p_partkey % 89 AS DOUBLE) / CAST(89 AS DOUBLE)",
    "dogs": "p_size % 5 < 3 AND p_partkey % 2 = 0",
    "parking": "CASE WHEN p_partkey % 7 < 4 THEN p_partkey % 7 < 2 END",
    "skates": "p_size % 5 = 1",
}
PLACES = "WITH places AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PLACE.items()) + " FROM part)"
_OPEN = "CASE WHEN open_month IS NULL THEN true WHEN open_month <= close_month THEN 2 BETWEEN open_month AND close_month ELSE 2 >= open_month OR 2 <= close_month END"
_DETAILS = ("dogs", "parking", "skates")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in _PLACE.items()])
    pairs = F.map_filter(F.create_map(*[x for d in _DETAILS for x in (F.lit(d), F.col(d))]), lambda _, v: v.isNotNull())
    return p.withColumn("details", pairs).drop(*_DETAILS)


@query(QUERIES, PLACES + f" SELECT slug FROM places WHERE cost = 'free' AND {_OPEN} AND city = 'Minneapolis' AND dogs AND coalesce(parking, false)")
def open_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free, open in February, in one city, with two details; a missing detail is not a true one."""
    return curation.filter_places(_places(spark, sf_dir), 2, "free", "Minneapolis", ("dogs", "parking"), open_now=True).select("slug")


@query(QUERIES, PLACES + f" SELECT kind, count(*) AS n, bool_or({_OPEN}) AS open, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities FROM places GROUP BY 1")
def place_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind with its count, whether any of it is open, and its cities."""
    is_open = curation.open_in(2, F.col("open_month"), F.col("close_month"))
    return _places(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.bool_or(is_open).alias("open"), F.array_join(F.array_sort(F.collect_set("city")), ", ").alias("cities"))


@query(QUERIES, PLACES + " SELECT 'dogs' AS detail, count(DISTINCT kind) AS kinds FROM places WHERE dogs HAVING kinds > 0 UNION ALL SELECT 'parking', count(DISTINCT kind) AS kinds FROM places WHERE parking HAVING kinds > 0 UNION ALL SELECT 'skates', count(DISTINCT kind) AS kinds FROM places WHERE skates HAVING kinds > 0")
def detail_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details that some place has, and of how many kinds; two make one worth a filter across kinds."""
    d = _places(spark, sf_dir).select("kind", F.explode("details").alias("detail", "there")).where("there")
    return d.groupBy("detail").agg(F.count_distinct("kind").alias("kinds"))


@query(QUERIES, PLACES + ", d AS (SELECT slug, 6371000.0 * acos(greatest(-1.0, least(1.0, cos(radians(44.9778)) * cos(radians(lat)) * cos(radians(lng - -93.265)) + sin(radians(44.9778)) * sin(radians(lat))))) / 1609.344 AS miles FROM places) SELECT slug, round(miles, 4) AS miles FROM d ORDER BY d.miles, slug LIMIT 20")
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty places nearest to a point, with miles."""
    return curation.nearest_places(_places(spark, sf_dir), 44.9778, -93.265).limit(20).select("slug", F.round("miles", 4).alias("miles"))


@query(QUERIES, PLACES + f", o AS (SELECT slug, open_month, row_number() OVER (ORDER BY slug) - 1 AS i, count(*) OVER () AS n FROM places WHERE {_OPEN} AND open_month IS NOT NULL) SELECT slug FROM o WHERE i = CAST(floor((DATE '2024-02-15' - DATE '1970-01-01') / 7.0) AS BIGINT) % n")
def place_of_the_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open seasonal place whose turn it is in mid-February."""
    return curation.of_the_week(_places(spark, sf_dir), date(2024, 2, 15)).select("slug")


@query(QUERIES, PLACES + " SELECT kind, slug, row_number() OVER (PARTITION BY kind ORDER BY CASE cost WHEN 'free' THEN 0 WHEN 'donation' THEN 1 ELSE 2 END, slug) AS pos FROM places QUALIFY pos <= 10")
def first_places_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each kind: free, then by donation, then paid, by name."""
    cost = F.array_position(F.array(F.lit("free"), F.lit("donation"), F.lit("paid")), F.col("cost"))
    p = _places(spark, sf_dir).withColumn("c", cost)
    return first_per(p, ["kind"], [F.col("c"), F.col("slug")], 10).withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("c", "slug"))).select("kind", "slug", "pos")
