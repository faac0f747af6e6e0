"""Look-ups, filters and selections of listings. Conditions are plain columns, so they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions import geo, keys, spans
from tallyhouse.functions import text as X
from tallyhouse.operators import matching
from tallyhouse.sources.tables import table

#: Categories in their own order, days of a feed, and what a collection's window reaches. Fixed values.
CATEGORIES = ("music", "sports", "family", "arts", "food", "weird", "festival")
FEED_DAYS = 30
WINDOW_DAYS = {"week": 7, "month": 30, "all": 365}


@dataclass(frozen=True)
class CollectionSpec:
    slug: str
    window: str = "all"
    categories: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    areas: tuple[str, ...] = ()
    query: str = ""

    @property
    def days(self) -> int:
        return WINDOW_DAYS.get(self.window, 0)


#: Fixed values; a query looks at titles.
COLLECTIONS = (
    CollectionSpec("free-this-week", "week", tiers=("Free",)),
    CollectionSpec("live-music", "week", ("music",)),
    CollectionSpec("family-fun", "week", ("family",)),
    CollectionSpec("date-night", "weekend", ("music", "arts", "food")),
    CollectionSpec("arts-and-culture", "month", ("arts",)),
    CollectionSpec("festivals-and-markets", "month", ("festival", "food")),
    CollectionSpec("food-truck-festivals", "all", query="food truck"),
    CollectionSpec("only-in-minnesota", "month", ("weird",)),
)


def published(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "published")


def lookup(rows: DataFrame, key: int) -> DataFrame:
    return rows.where((F.col("id") == key) & (F.col("status") != "draft")).limit(1)


def in_order(rows: DataFrame, ids: list[int]) -> DataFrame:
    """The named rows with their place in `ids`, in that order; drafts and unknown ids are left out."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id long")
    return rows.where(F.col("status") != "draft").join(F.broadcast(wanted), "id").orderBy("pos")


def with_span(rows: DataFrame) -> DataFrame:
    """rows with span_end, last_day and capped_last."""
    ends = (F.col("start"), F.col("end_wall"), F.col("multi_day_end"))
    spanned = rows.withColumn("span_end", spans.span_end(*ends))
    spanned = spanned.withColumn("last_day", F.coalesce(spans.day_of(F.col("span_end")), F.col("start_day")))
    return spanned.withColumn("capped_last", spans.capped_last(F.col("start_day"), F.col("last_day")))


def on_day(rows: DataFrame, day: Column) -> DataFrame:
    return with_span(rows.where(F.col("start_day") <= day)).where(F.col("capped_last") >= day)


def admin_filter(rows: DataFrame, text: str, status: str | None = None, most: int = 100) -> DataFrame:
    found = F.lit(False)
    for c in ("title", "venue", "city"):
        found = found | F.col(c).ilike(f"%{text}%")
    kept = rows.where(found) if status is None else rows.where(found & (F.col("status") == status))
    return kept.orderBy(F.desc("start"), "id").limit(most)


def wanted(categories: Iterable[str] = (), tiers: Iterable[str] = (), areas: Iterable[str] = (), query: str = "") -> Column:
    """Whether a row is in the given sets and its title holds the words of the query; an empty one asks for nothing."""
    out = F.lit(True)
    for names, column in ((categories, lambda: F.col("category")), (tiers, lambda: X.price_tier(F.col("price"))), (areas, lambda: keys.area(F.col("city")))):
        if names := list(names):
            out = out & column().isin(names)
    return out & X.matches(F.col("title"), query) if query else out


def narrowed(rows: DataFrame, categories: Iterable[str] = (), tiers: Iterable[str] = (), areas: Iterable[str] = ()) -> DataFrame:
    """Rows in the given sets; an empty set asks for nothing."""
    return rows.where(wanted(categories, tiers, areas))


def near(rows: DataFrame, lat: float, lng: float, miles: float) -> DataFrame:
    return rows.where(geo.cosine_metres(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= miles * geo.MILE_M)


def starting(rows: DataFrame, first: date, last: date) -> DataFrame:
    return rows.where(F.col("start_day").between(F.lit(first), F.lit(last))).orderBy("start", "id")


def in_collection(spec: CollectionSpec, day: date, now: str) -> Column:
    """Whether a collection shows a row at the wall time `now`."""
    if spec.window == "weekend":
        days = spans.weekend_of(day)
        window = F.col("start_day").between(F.lit(days[0]), F.lit(days[-1]))
    else:
        window = F.col("start_day") <= F.lit(day + timedelta(days=spec.days))
    return (F.col("status") == "published") & (F.col("start") >= now) & window & wanted(spec.categories, spec.tiers, spec.areas, spec.query)


def collection(rows: DataFrame, spec: CollectionSpec, day: date, now: str) -> DataFrame:
    """What a collection shows at the wall time `now`, by start."""
    return rows.where(in_collection(spec, day, now)).orderBy("start", "id")


def with_slugs(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """rows with `slug`, once for each condition that holds: one scan, whatever the number of lists."""
    return rows.withColumn("slug", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in conditions.items()]))))


def in_collections(rows: DataFrame, specs: Iterable[CollectionSpec], day: date, now: str) -> DataFrame:
    """rows with the slug of each collection that shows them."""
    alive = rows.where((F.col("status") == "published") & (F.col("start") >= now))
    return with_slugs(alive, {s.slug: in_collection(s, day, now) for s in specs})


def category_slug(category: str) -> str:
    return "unique" if category == "weird" else category


def resolve_feed(slug: str, venues: Iterable[str] = (), hoods: Iterable[str] = ()) -> tuple[str, str] | None:
    """(kind, key) of a feed's slug: weekend before category, collection, venue and neighbourhood."""
    if slug == "this-weekend":
        return "weekend", slug
    for c in CATEGORIES:
        if category_slug(c) == slug:
            return "category", c
    if any(c.slug == slug for c in COLLECTIONS):
        return "collection", slug
    if slug.startswith("venue-"):
        return ("venue", slug[6:]) if slug[6:] in set(venues) else None
    return ("neighborhood", slug) if slug in set(hoods) else None


def in_feed(slug: str, day: date, venues: Iterable[str] = (), hood: Column | None = None, hoods: Iterable[str] = ()) -> Column:
    """Whether a feed holds a row with its span (start_day, last_day); an unknown feed holds nothing. hood: a row's neighbourhood."""
    found = resolve_feed(slug, venues, hoods)
    if found is None:
        return F.lit(False)
    kind, key = found
    days = spans.weekend_of(day) if kind == "weekend" else [day, day + timedelta(days=FEED_DAYS)]
    shown = (F.col("start_day") <= F.lit(days[-1])) & (F.col("last_day") >= F.lit(days[0]))
    if kind == "category":
        return shown & (F.col("category") == key)
    if kind == "collection":
        spec = next(c for c in COLLECTIONS if c.slug == key)
        return shown & wanted(spec.categories, spec.tiers, spec.areas, spec.query)
    if kind == "venue":
        return shown & (keys.slug(F.col("venue")) == key)
    return shown & (hood == key) if kind == "neighborhood" else shown


def feed(rows: DataFrame, slug: str, day: date, venues: Iterable[str] = (), hood: Column | None = None, hoods: Iterable[str] = ()) -> DataFrame:
    """What a feed holds, by start."""
    return with_span(rows).where(in_feed(slug, day, venues, hood, hoods)).orderBy("start", "id")


def in_feeds(rows: DataFrame, slugs: Iterable[str], day: date, venues: Iterable[str] = (), hood: Column | None = None, hoods: Iterable[str] = ()) -> DataFrame:
    """rows with the slug of each feed that holds them."""
    return with_slugs(with_span(rows), {s: in_feed(s, day, venues, hood, hoods) for s in slugs})


def with_hood(rows: DataFrame, hoods: DataFrame) -> DataFrame:
    """rows (id, lat, lng, ...) with `hood`: the nearest neighbourhood (position, centre, lat, lng, radius_km) that reaches them, else null."""
    found = matching.nearest(rows.where("lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)").select("id", "lat", "lng"), hoods, "id")
    return rows.join(found.select(F.col("id").alias("__id"), F.col("centre").alias("hood")), F.col("id") == F.col("__id"), "left").drop("__id")


def feed_kinds(slugs: DataFrame, venues: DataFrame, hoods: DataFrame) -> DataFrame:
    """(slug, kind, key) of each slug asked for; kind and key are null for those that name no feed. venues: slug; hoods: slug."""
    s = F.col("slug")
    fixed = {"this-weekend": ("weekend", "this-weekend")} | {category_slug(c): ("category", c) for c in CATEGORIES} | {c.slug: ("collection", c.slug) for c in COLLECTIONS}
    known = F.create_map(*[x for name, (kind, key) in fixed.items() for x in (F.lit(name), F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key")))])
    room = F.when(s.startswith("venue-"), F.substr(s, F.lit(7)))
    j = slugs.select("slug").distinct().withColumns({"fixed": F.try_element_at(known, s), "room": room})
    j = j.join(venues.select(F.col("slug").alias("v")).distinct(), F.col("room") == F.col("v"), "left").join(hoods.select(F.col("slug").alias("h")).distinct(), F.col("slug") == F.col("h"), "left")
    kind = F.when(F.col("fixed").isNotNull(), F.col("fixed.kind")).when(F.col("room").isNotNull(), F.when(F.col("v").isNotNull(), "venue")).when(F.col("h").isNotNull(), "neighborhood")
    key = F.when(F.col("fixed").isNotNull(), F.col("fixed.key")).when(kind == "venue", F.col("v")).when(kind == "neighborhood", F.col("h"))
    return j.select("slug", kind.alias("kind"), key.alias("key"))


def related_rows(rows: DataFrame, pool: DataFrame, most: int = 4) -> DataFrame:
    """(id, kind, related, pos): for each of rows up to `most` of the pool at its venue (vkey), by start; where the venue has none, of its neighbourhood (hood).

    A row is no relation of itself. Rows without venue or neighbourhood skip that step.
    """
    same = lambda key: related(rows.where(F.coalesce(key, F.lit("")) != ""), pool.where(F.coalesce(key, F.lit("")) != ""), key, most)
    venue = same("vkey")
    met = venue.select(F.col("id").alias("__met")).distinct()
    rest = same("hood").join(met, F.col("id") == F.col("__met"), "left_anti")
    return venue.select("id", F.lit("venue").alias("kind"), "related", "pos").unionByName(rest.select("id", F.lit("neighborhood").alias("kind"), "related", "pos"))


def usual(rows: DataFrame, key: str, value: str, arrival: str) -> DataFrame:
    """(key, value, n): the commonest value of each key, the first seen of equals."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(arrival).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "first", value)).alias("b")
    return n.groupBy(key).agg(best).select(key, F.col(f"b.{value}").alias(value), (-F.col("b.m")).alias("n"))


def related(rows: DataFrame, pool: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(id, related, pos): rows of the pool with the same key, the soonest first.

    Of a key at most most + 1 rows can be among the first `most` others of any row, so the pool is cut before the join.
    """
    order = Window.partitionBy(key).orderBy("start", "id")
    first = pool.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 1).select(F.col(key).alias("k"), F.col("id").alias("related"), F.col("start").alias("at"))
    pairs = rows.select("id", key).join(first, (F.col(key) == F.col("k")) & (F.col("id") != F.col("related")))
    return pairs.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("at", "related"))).where(F.col("pos") <= most).select("id", "related", "pos")


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, id): who has saved what. Suppliers stand for tokens, the orders that they serve for saved listings."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 150).alias("token"), F.col("l_orderkey").alias("id")).distinct()


def affinity(saved: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(token, category, n, rank) from (token, category)."""
    place = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    n = saved.groupBy("token", "category").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), place)))


def search_window(day: Column, days: int) -> tuple[Column, Column]:
    """First and last day of a report over `days` days of search figures, which are final three days later."""
    return F.date_add(day, -(days + 2)), F.date_add(day, -3)


def season_names(day: Column) -> tuple[Column, Column]:
    """A season's code of both years, and its label, the year in which it ends; seasons begin in July."""
    first = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    return F.concat(first.cast("string"), (first + 1).cast("string")), (first + 1).cast("bigint")
