"""Search, keys, similarity and classes over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import text as X
from tallyhouse.operators import matching
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, listings
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}
_KEY = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
#: Fixed values of this fixture: patterns and what they weigh, first category first.
RULES = {"legal": {"license": 3, "[Vv]ersion": 1}, "contact": {"@": 3, r"example\.com": 1}, "french": {r"(^|[ \n])les[ ,.]": 2, r"(^|[ \n])que[ ,.]": 1}, "german": {r"(^|[ \n])der[ ,.]": 2, r"(^|[ \n])und[ ,.]": 1}}


@query(QUERIES, "SELECT doc_id FROM documents WHERE contains(" + _KEY.format("text") + ", 'reau') AND contains(" + _KEY.format("text") + ", 'que')")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of "Réau que", as substrings, accents folded."""
    return table(spark, sf_dir, "documents").where(X.matches(F.col("text"), "Réau que")).select("doc_id")


@query(QUERIES, "SELECT doc_id, CASE WHEN length(text) > 180 THEN left(text, 179) || '…' ELSE text END AS preview FROM documents")
def document_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(QUERIES, r"SELECT regexp_extract(url, '^https?://(?:www\.)?([^/:?#]+)', 1) AS host, CASE WHEN regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) = '' THEN 'home' ELSE regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) END AS section, count(*) AS n FROM pages GROUP BY 1, 2")
def pages_by_host_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url")
    return p.groupBy(X.url_host(F.col("url")).alias("host"), X.url_section(F.col("url")).alias("section")).agg(F.count("*").alias("n"))


@query(QUERIES, "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"))


def _score(rules: dict[str, int]) -> str:
    return " + ".join(f"(CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END)" for p, w in rules.items())


_SCORES = ", ".join(f"{_score(r)} AS {n}" for n, r in RULES.items())
_BEST = f"greatest({', '.join(RULES)})"


@query(QUERIES, f"WITH s AS (SELECT doc_id, {_SCORES} FROM documents) SELECT doc_id, CASE WHEN {_BEST} = 0 THEN 'other' " + " ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n in RULES) + " END AS category FROM s")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", matching.weighted_category(F.col("text"), RULES, "other").alias("category"))


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(QUERIES, r"WITH p AS (SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages)," + f"""
    c AS (SELECT lang, t, min(page_id) AS id, count(*) AS copies, {_GRAMS} AS g FROM p GROUP BY lang, t),
    l AS (SELECT a.id, sum(b.copies) AS near FROM c a JOIN c b ON a.lang IS NOT DISTINCT FROM b.lang AND a.id <> b.id WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g))::DOUBLE > 0.6 GROUP BY 1)
    SELECT page_id AS id, c.id AS class_id, copies, CAST(CASE WHEN len(g) > 0 THEN copies - 1 + coalesce(near, 0) ELSE 0 END AS BIGINT) AS links FROM p JOIN c ON p.lang IS NOT DISTINCT FROM c.lang AND p.t IS NOT DISTINCT FROM c.t LEFT JOIN l ON l.id = c.id""")
def near_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its class of equal titles within a language, how many pages have that title, and how many others an equal or near equal one."""
    h = F.col("html")
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"))
    return matching.linked(d, ["lang"], ["page_id"], "title", 0.6)


_PAIRS = LISTINGS + f", r AS (SELECT *, {_GRAMS} AS g FROM (SELECT *, title AS t FROM listings) WHERE status IN ('published', 'draft')), p AS (SELECT a.id AS keep_id, b.id AS dup_id, len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g))::DOUBLE AS s, 6371000.0 * acos(greatest(-1.0, least(1.0, cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng) - radians(a.lng)) + sin(radians(a.lat)) * sin(radians(b.lat))))) AS m FROM r a JOIN r b ON a.start_day = b.start_day AND (a.created_day, a.id) < (b.created_day, b.id))"


@query(QUERIES, _PAIRS + ", q AS (SELECT * FROM p WHERE s > 0.6 AND m < 250) SELECT keep_id, dup_id, round(s, 6) AS similarity FROM q WHERE keep_id NOT IN (SELECT dup_id FROM q)")
def near_duplicate_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one day and place with near equal titles; a keeper is no duplicate itself."""
    rows = listings(spark, sf_dir).where("status IN ('published', 'draft')")
    return matching.near_listings(rows, 0.6, 250.0).withColumn("similarity", F.round("similarity", 6))


#: Classes of equal titles of a day, and which are similar.
_CLASSES = LISTINGS + f""", r AS (SELECT *, lower(title) AS t FROM listings WHERE status IN ('published', 'draft')),
    c AS (SELECT start_day, t, min((created_day, id)) AS o, count(*) AS copies, count(*) FILTER (WHERE status = 'draft') AS drafts, {_GRAMS} AS g FROM r GROUP BY start_day, t),
    e AS (SELECT a.o AS x, b.o AS y, len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g))::DOUBLE AS s FROM c a JOIN c b ON a.start_day = b.start_day WHERE len(a.g) > 0 AND len(b.g) > 0)"""


@query(QUERIES, _CLASSES + """, m AS (SELECT r.start, (r.created_day, r.id) AS o, c.o AS of FROM r JOIN c ON r.start_day = c.start_day AND r.t = c.t)
    SELECT struct_extract(k.o, 2) AS keep_id, struct_extract(d.o, 2) AS dup_id, round(s, 6) AS similarity FROM m k JOIN e ON e.x = k.of AND s > 0.4 JOIN m d ON d.of = e.y AND k.o < d.o ORDER BY k.start, k.o, d.o LIMIT 100""")
def duplicate_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pairs of listings of one day with equal or similar titles, by start; the one seen first is kept."""
    rows = listings(spark, sf_dir).where("status IN ('published', 'draft')")
    return matching.review_pairs(rows, ["start_day"], ["created_day", "id"], "start", "title", 0.4, 100).withColumn("similarity", F.round("similarity", 6))


@query(QUERIES, _CLASSES + """, l AS (SELECT x, CAST(sum(c.copies) - max(CASE WHEN c.o = x THEN 1 ELSE 0 END) AS BIGINT) AS links FROM e JOIN c ON c.o = y WHERE s > 0.4 GROUP BY 1)
    SELECT r.id, struct_extract(c.o, 2) AS class_id, copies, coalesce(links, 0) AS links FROM r JOIN c ON r.start_day = c.start_day AND r.t = c.t LEFT JOIN l ON x = c.o""")
def duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with its class of equal titles of the day and to how many listings of the day it is linked."""
    rows = listings(spark, sf_dir).where("status IN ('published', 'draft')")
    return matching.linked(rows, ["start_day"], ["created_day", "id"], "title", 0.4)


@query(QUERIES, _CLASSES.replace("status IN ('published', 'draft')", "status <> 'archived'") + """, k AS (SELECT least(struct_extract(x, 2), struct_extract(y, 2)) AS a, greatest(struct_extract(x, 2), struct_extract(y, 2)) AS b, s,
        CASE WHEN x = y THEN p.copies * (p.copies - 1) // 2 - (p.copies - p.drafts) * (p.copies - p.drafts - 1) // 2 ELSE p.copies * q.copies - (p.copies - p.drafts) * (q.copies - q.drafts) END AS pairs FROM e JOIN c p ON p.o = x JOIN c q ON q.o = y WHERE s > 0.45 AND struct_extract(x, 2) <= struct_extract(y, 2))
    SELECT a, b, pairs, round(s, 6) AS similarity FROM k WHERE pairs > 0""")
def draft_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal or similar titles of one day with the number of pairs that have a draft, to be looked at before publishing."""
    rows = listings(spark, sf_dir).where("status <> 'archived'")
    return matching.draft_pairs(rows, ["start_day"], ["created_day", "id"], "title", "status", 0.45).withColumn("similarity", F.round("similarity", 6))


@query(QUERIES, r"SELECT page_id, CASE WHEN regexp_matches(url, '^[=+\-@]') THEN '''' || url ELSE url END AS url FROM pages")
def csv_safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.csv_safe(F.col("url")).alias("url"))


@query(QUERIES, "SELECT lang, source, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY 1, 2")
def documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("bigint").alias("shortest"), F.max(F.length("text")).cast("bigint").alias("longest"))
