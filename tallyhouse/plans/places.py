"""Facts, lookups, neighbours and documents of places; submissions as they are approved; windows and seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import keys
from tallyhouse.functions import text as X
from tallyhouse.operators import categories, places, reading
from tallyhouse.operators.outputs import BASE_URL
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.categories import _SCORED
from tallyhouse.plans.curation import _DETAILS, PLACES, _places
from tallyhouse.plans.fixture import LISTINGS, listings, worded
from tallyhouse.plans.hoods import _VALUES, _hoods
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}


@query(QUERIES, PLACES + ", d AS (SELECT 1 AS pos, 'dogs' AS detail, count(DISTINCT kind) FILTER (WHERE dogs) AS kinds FROM places UNION ALL SELECT 2, 'parking', count(DISTINCT kind) FILTER (WHERE parking) FROM places UNION ALL SELECT 3, 'skates', count(DISTINCT kind) FILTER (WHERE skates) FROM places) SELECT * FROM d WHERE kinds >= 2")
def cross_kind_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details worth a filter across kinds: those of two kinds or more."""
    return places.cross_kind_details(_places(spark, sf_dir), _DETAILS)


_SUM = ", ".join(f"CASE WHEN count(*) FILTER (WHERE {d}) > 0 THEN '{d} at ' || count(*) FILTER (WHERE {d}) || ' of ' || count(*) END" for d in _DETAILS)
_SOME = ", ".join(f"CASE WHEN count(*) FILTER (WHERE {d}) > 0 THEN '{d}' END" for d in _DETAILS)


@query(QUERIES, PLACES + f" SELECT kind, concat_ws(',', {_SOME}) AS details, string_agg(DISTINCT city, ',' ORDER BY city) AS cities, concat_ws('; ', {_SUM}) AS summary FROM places GROUP BY 1")
def kind_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind's places offer, where they are, and how many have what."""
    f = places.kind_facts(_places(spark, sf_dir), _DETAILS)
    return f.select("kind", F.array_join("details", ",").alias("details"), F.array_join("cities", ",").alias("cities"), "summary")


_ASKED = "SELECT 'place-' || lpad(CAST(o_custkey AS {s}), 7, '0') AS slug, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'beach' WHEN 1 THEN 'trail' END AS kind FROM {t} WHERE o_orderkey % 5 = 0"


@query(QUERIES, PLACES + f", a AS ({_ASKED.format(s='VARCHAR', t='orders')}) SELECT a.slug, a.kind, p.slug AS found, p.kind AS found_kind FROM a LEFT JOIN places p ON a.slug = p.slug AND (a.kind IS NULL OR a.kind = p.kind)")
def found_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by slug, and by kind and slug."""
    asked = spark.sql(_ASKED.format(s="STRING", t="{o}"), o=table(spark, sf_dir, "orders"))
    return places.found_places(asked, _places(spark, sf_dir))


_THEMED = ", ".join(f"('{k}', '{t}')" for k, t in places.THEMES.items())


@query(QUERIES, PLACES + f", t(kind, theme) AS (VALUES {_THEMED}), k AS (SELECT DISTINCT kind, theme FROM places JOIN t USING (kind)) SELECT a.kind, b.kind AS related FROM k a JOIN k b ON a.theme = b.theme AND a.kind <> b.kind")
def related_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the same theme."""
    return places.related_kinds(_places(spark, sf_dir))


@query(QUERIES, PLACES + f""", hoods(position, hood, hlat, hlng, radius, hcity) AS (VALUES {_VALUES}), d AS (SELECT slug, kind, hood, position, radius, 2 * 6371.0 * asin(sqrt(pow(sin(radians(hlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(hlat)) * pow(sin(radians(hlng - lng) / 2), 2))) AS km FROM places CROSS JOIN hoods),
    n AS (SELECT slug, any_value(kind) AS kind, arg_min(hood, (km, position)) AS hood FROM d WHERE km <= radius GROUP BY 1) SELECT hood, kind, count(*) AS n, min(slug) AS first FROM n GROUP BY ALL""")
def places_by_hood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each neighbourhood by kind."""
    p = reading.with_hood(_places(spark, sf_dir).withColumn("id", F.col("slug")), _hoods(spark)).where("hood IS NOT NULL")
    return p.groupBy("hood", "kind").agg(F.count("*").alias("n"), F.min("slug").alias("first"))


@query(QUERIES, PLACES + " SELECT slug, kind, CASE cost WHEN 'free' THEN 'true' WHEN 'paid' THEN 'false' END AS free, 'https://listings.example/places/' || kind || '/' || slug AS url, city FROM places")
def place_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema.org documents of all places, read again field by field."""
    p = _places(spark, sf_dir)
    at = lambda path: F.get_json_object("doc", f"$.{path}")
    d = p.select("slug", "kind", places.place_document(p, BASE_URL).alias("doc"))
    return d.select("slug", "kind", at("isAccessibleForFree").alias("free"), at("url").alias("url"), at("address.addressLocality").alias("city"))


@query(QUERIES, LISTINGS + """, p AS (SELECT start_day, id, title, row_number() OVER (PARTITION BY start_day ORDER BY "start", id) AS k, least(count(*) OVER (PARTITION BY start_day), 20) AS n FROM listings WHERE status = 'published') SELECT start_day, CAST(n AS INTEGER) AS n, title AS first, 'https://listings.example/event/' || id AS url FROM p WHERE k = 1""")
def day_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ItemList of each day's first twenty listings: how many it has, and its first."""
    rows = reading.published(listings(spark, sf_dir))
    lists = places.item_list(rows, "start_day", ["start", "id"], F.col("title"), F.concat(F.lit(f"{BASE_URL}/event/"), "id"))
    doc = F.from_json("doc", "itemListElement array<struct<position: int, name: string, url: string>>")
    return lists.select("start_day", doc.alias("d")).select("start_day", F.size("d.itemListElement").alias("n"), F.get("d.itemListElement", F.lit(0))["name"].alias("first"), F.get("d.itemListElement", F.lit(0))["url"].alias("url"))


@query(QUERIES, PLACES + """, p AS (SELECT kind, slug, lat, lng, row_number() OVER (PARTITION BY kind ORDER BY slug) AS k FROM places) SELECT kind, 'https://maps.example/' || string_agg('pin-' || k || '(' || printf('%.4f', lng) || ',' || printf('%.4f', lat) || ')', ',' ORDER BY k) AS url FROM p WHERE k <= 30 GROUP BY 1""")
def pinned_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of each kind's first thirty places."""
    return places.pinned_map(_places(spark, sf_dir), "kind", ["slug"], "https://maps.example/")


_STREET = "CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE CAST(o_custkey % 7 AS {s}) || ' Main St ' END"


@query(QUERIES, LISTINGS + f", a AS (SELECT venue, trim({_STREET.format(s='VARCHAR').replace('o_custkey', 'owner')}) AS address, id FROM listings WHERE venue <> ''), n AS (SELECT venue, address, count(*) AS n, min(id) AS first FROM a WHERE address <> '' GROUP BY ALL) SELECT venue, address, n FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY n DESC, first) AS k FROM n) WHERE k = 1")
def usual_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest address of each venue that isn't blank; the first seen of equals."""
    rows = listings(spark, sf_dir).where("venue <> ''").select("venue", F.trim(F.expr(_STREET.format(s="STRING").replace("o_custkey", "owner"))).alias("address"), "id")
    return reading.usual(rows.where("address <> ''"), "venue", "address", "id")


@query(QUERIES, LISTINGS + """ SELECT DISTINCT city, CASE WHEN city IN ('Saint Paul, MN', 'St. Paul') THEN 'st-paul' WHEN city <> 'Duluth' THEN lower(city) END AS slug FROM listings""")
def city_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each city's spelling, if the registry has the city."""
    name = keys.area_city(F.col("city"))
    slug = F.when(keys.area(F.col("city")) != "other", F.replace(name, F.lit(" "), F.lit("-")))
    return listings(spark, sf_dir).select("city", slug.alias("slug")).distinct()


_WALL = "'2024-05-' || lpad(CAST(id % 28 + 1 AS {s}), 2, '0')"


@query(QUERIES, _SCORED.replace("WITH worded", "WITH worded", 1) + f""", s AS MATERIALIZED (SELECT c.*, w.title, w.venue FROM c JOIN worded w USING (id)) SELECT id, chosen AS category, 'published' AS status, CASE WHEN id % 3 = 0 THEN 44.9778 ELSE 45.0 + id % 10 END::DOUBLE AS lat, {_WALL.format(s='VARCHAR')} || 'T19:30' AS "start" FROM s""".replace(", s AS MATERIALIZED", ", t AS MATERIALIZED").replace("FROM s", "FROM t"))
def approved_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions as they are published: their category by content, placed where the geocoder found them or at the centre, with the key of their title, venue and day."""
    rows = worded(spark, sf_dir).withColumn("day", F.to_date(F.expr(_WALL.format(s="STRING"))))
    found = rows.where("id % 3 <> 0").select(F.col("id").alias("of"), (F.lit(45.0) + F.col("id") % 10).cast("double").alias("lat"))
    sorted_ = categories.with_category(rows, "title", "description", "venue", "category").join(found, F.col("id") == F.col("of"), "left")
    done = sorted_.select("id", F.col("chosen").alias("category"), F.lit("published").alias("status"), F.coalesce("lat", F.lit(44.9778)).alias("lat"), F.concat(F.col("day").cast("string"), F.lit("T19:30")).alias("start"), X.listing_key(F.col("title"), F.col("venue"), F.col("day")).alias("key"))
    return done.where(F.length("key") == 32).drop("key")


@query(QUERIES, "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) - 30 AS first, CAST(o_orderdate AS DATE) - 3 AS last, CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) || '' || (year(o_orderdate) + 1) ELSE (year(o_orderdate) - 1) || '' || year(o_orderdate) END AS code, CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS label FROM orders")
def windows_and_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's day: the 28 days of search figures that are final by then, and the season by its two names."""
    day = F.to_date("o_orderdate")
    first, last = reading.search_window(day, 28)
    code, label = reading.season_names(day)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first.alias("first"), last.alias("last"), code.alias("code"), label.alias("label"))
