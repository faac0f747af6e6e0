"""Lists that exclude each other, pages by day, and official links."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.text import url_host
from tallyhouse.operators import curation, links, reading
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.curation import _POOL
from tallyhouse.plans.fixture import listings, today
from tallyhouse.plans.reading import QUERIES as READING
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}

_LISTS = _POOL.replace("WITH listings", "WITH RECURSIVE listings", 1) + """, one AS (SELECT city, category, arg_min(id, pos) AS id FROM pool WHERE category IN ('family', 'weird') GROUP BY ALL),
    o AS (SELECT city, id, lower(trim(venue)) AS v, start_day AS d, row_number() OVER (PARTITION BY city ORDER BY pos) AS r FROM pool WHERE id NOT IN (SELECT id FROM one)),
    f AS (SELECT city, 0::BIGINT AS r, 0 AS n, false AS took, []::VARCHAR[] AS vs, []::DATE[] AS ds FROM (SELECT DISTINCT city FROM pool) UNION ALL
        SELECT city, r, CASE WHEN ok THEN n + 1 ELSE n END, ok, CASE WHEN ok AND v <> '' THEN list_append(vs, v) ELSE vs END, CASE WHEN ok THEN list_append(ds, d) ELSE ds END FROM
        (SELECT o.city, o.r, f.n, f.vs, f.ds, o.v, o.d, f.n < 6 AND NOT list_contains(f.vs, o.v) AND len(list_filter(f.ds, lambda x: x = o.d)) < 2 AS ok FROM f JOIN o ON o.city = f.city AND o.r = f.r + 1)),
    l AS (SELECT city, CASE category WHEN 'family' THEN 'family' ELSE 'unique' END AS list, CASE category WHEN 'family' THEN 1 ELSE 2 END AS place, 1 AS pos, id FROM one UNION ALL SELECT f.city, 'regular', 3, n, o.id FROM f JOIN o ON o.city = f.city AND o.r = f.r WHERE took),
    k AS (SELECT l.*, pool."start", row_number() OVER (PARTITION BY l.city ORDER BY place, l.pos) AS rank FROM l JOIN pool USING (id)),
    g AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY "start", place, id) AS shown FROM k WHERE rank <= 8)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = today(spark, sf_dir)
    pool = curation.picked_pool(listings(spark, sf_dir), f"{now}T12:00", f"{now + timedelta(days=7)}T12:00")
    return curation.week_lists(pool, "city", 6)


@query(QUERIES, _LISTS + " SELECT city, list, CAST(pos AS INTEGER) AS pos, id FROM l")
def week_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's family, unusual and six regular listings of each city's readers; none is in two lists."""
    return _lists(spark, sf_dir).select("city", "list", "pos", "id")


@query(QUERIES, _LISTS + " SELECT city, CAST(shown AS INTEGER) AS pos, id FROM g")
def city_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each city: eight listings of the three lists, by start."""
    return curation.digest_list(_lists(spark, sf_dir), "city").select("city", "pos", "id")


@query(QUERIES, _LISTS + """ SELECT city, left("start", 10) AS day, array_to_string(list(id ORDER BY shown), ',') AS ids FROM g GROUP BY ALL""")
def week_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the week of each city: its digest day by day."""
    days = curation.by_day(curation.digest_list(_lists(spark, sf_dir), "city"), "city", ["pos"])
    return days.select("city", "day", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(QUERIES, f"""WITH c AS (SELECT * FROM ({READING["collection_listings"].sql})), l AS (SELECT * FROM ({_POOL.split(", pool AS")[0]} SELECT id, "start" FROM listings)) SELECT slug, left("start", 10) AS day, array_to_string(list(c.id ORDER BY "start", c.id), ',') AS ids FROM c JOIN l USING (id) GROUP BY ALL""")
def collection_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collection's listings day by day, in their order."""
    now = today(spark, sf_dir)
    rows = reading.in_collections(listings(spark, sf_dir), reading.COLLECTIONS, now, f"{now}T12:00")
    days = curation.by_day(rows.select("slug", "id", "start"), "slug", ["start"])
    return days.select("slug", "day", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


#: Fixed values of this fixture: what pages' hosts, venues and tickets are made of.
_LINKS = r"""WITH p AS (SELECT page_id AS id, url AS source, regexp_extract(url, '^https?://(?:www\.)?([^/:?#]+)', 1) AS h FROM pages),
    r AS (SELECT id, source, CASE CAST(id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'https://www.ticketmaster.com/e/' || id WHEN 2 THEN ' https://' || h || '/buy ' ELSE 'https://tickets.' || split_part(h, '.', 2) || '.org/' || id END AS ticket,
        CASE CAST(id % 3 AS INT) WHEN 0 THEN 'The ' || upper(split_part(h, '.', 2)) || ' Hall' WHEN 1 THEN 'North Park Theater' ELSE split_part(h, '.', 1) || '-House' END AS venue FROM p)"""
_REGISTRY = (*links.AGGREGATORS, "spam-farm.example.org", "example.net")


@query(QUERIES, _LINKS + rf""", d AS (SELECT id, trim(ticket) AS t, source AS s, venue, nullif(regexp_replace(lower(regexp_extract(trim(ticket), '^[A-Za-z]+://([^/?#:@]+)', 1)), '^www\.', ''), '') AS th, regexp_replace(lower(regexp_extract(source, '^[A-Za-z]+://([^/?#:@]+)', 1)), '^www\.', '') AS sh FROM r),
    w AS (SELECT *, list_filter(string_split(regexp_replace(lower(venue), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(f"'{w}'" for w in links.GENERIC)})) AS words FROM d),
    v AS (SELECT *, len(list_filter(words, lambda w: contains(regexp_replace(sh, '[^a-z0-9]', '', 'g'), w))) > 0 AND NOT list_bool_or(list_transform([{', '.join(f"'{h}'" for h in _REGISTRY)}], lambda a: sh = a OR ends_with(sh, '.' || a))) AS own,
        t <> '' AND sh IS DISTINCT FROM th AND len(list_filter(words, lambda w: contains(regexp_replace(th, '[^a-z0-9]', '', 'g'), w))) = 0 AS away FROM w)
    SELECT id, CASE WHEN own AND away THEN s WHEN t <> '' THEN t WHEN own THEN s END AS "primary", CASE WHEN own AND away THEN 'official' WHEN t <> '' THEN 'tickets' WHEN own THEN 'official' END AS kind, CASE WHEN own AND away THEN t END AS secondary FROM v""")
def official_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that listings of all pages' addresses would show."""
    host = url_host(F.col("url"))
    part = lambda n: F.split_part(F.col("h"), F.lit("."), F.lit(n))
    k = F.col("id") % 4
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source"), host.alias("h"))
    ticket = F.when(k == 0, "").when(k == 1, F.concat(F.lit("https://www.ticketmaster.com/e/"), "id")).when(k == 2, F.concat(F.lit(" https://"), "h", F.lit("/buy "))).otherwise(F.concat(F.lit("https://tickets."), part(2), F.lit(".org/"), "id"))
    venue = F.when(F.col("id") % 3 == 0, F.concat(F.lit("The "), F.upper(part(2)), F.lit(" Hall"))).when(F.col("id") % 3 == 1, "North Park Theater").otherwise(F.concat(part(1), F.lit("-House")))
    registry = spark.createDataFrame([(h,) for h in _REGISTRY], "host string")
    return links.official_links(p.select("id", "source", ticket.alias("ticket"), venue.alias("venue")), registry).select("id", "primary", "kind", "secondary")
