"""Ranked and greedy picks, cards, personal order, rotation, and selections of places."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import geo, spans
from tallyhouse.functions import text as X
from tallyhouse.operators import ranking, reading

CARD_SIZE, CARD_PER_CATEGORY = 5, 2
CARD_CATEGORIES = ("music", "festival", "food", "arts", "sports")
#: Reasons why a listing is kept off cards: a pattern that must and one that must not be found in the lower-cased title and description. Fixed values.
EXCLUSIONS = (
    ("drag", r"\bdrag\b", r"\bdrag\s+(?:rac|strip)"),
    ("political", r"\b(?:protest|political|politics|election|campaign|senator|governor|mayoral|city council|caucus|gop|dfl|democrat|republican|maga)\b", None),
    ("political", r"\brally\b", r"\brally\s*(?:car|cross)"),
    ("political", r"\bmarch\s+(?:for|on|against)\b", None),
)


def exclusion(title: Column, description: Column) -> Column:
    """The first reason to exclude, null if there is none."""
    t = F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))))
    return F.coalesce(*[F.when(t.rlike(must) & (~t.rlike(no) if no else F.lit(True)), name) for name, must, no in EXCLUSIONS])


def shareability(rows: DataFrame) -> Column:
    """2 for an address, 2 for a description over 40 characters, 1 for an image on the web, 2 for Friday to Sunday, 1 for free."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    return one(F.col("url") != "", 2) + one(F.length("description") > 40, 2) + one(F.coalesce(F.col("image"), F.lit("")).startswith("http"), 1) + one(spans.weekday(F.col("start_day")).isin(0, 5, 6), 2) + one(X.price_tier(F.col("price")) == "Free", 1)


def picked_pool(rows: DataFrame, now: str, until: str) -> DataFrame:
    """Published listings that start between two wall times, with their score and rank (score, start, title, id)."""
    pool = reading.published(rows).where(F.col("start").between(now, until)).withColumn("score", shareability(rows))
    return pool.withColumn("order", F.struct((-F.col("score")).alias("s"), "start", "title", "id"))


def spread_pool(pool: DataFrame, limit: int, group: str = "half") -> DataFrame:
    """Greedy picks of each group of the pool, one a venue (a nameless venue is none), two a day."""
    venue = F.lower(F.trim("venue"))
    unnamed = F.concat(F.lit("#"), F.col("id").cast("string"))
    named = pool.withColumn("spot", F.when(venue == "", unnamed).otherwise(venue)).withColumn("s", -F.col("score"))
    return ranking.spread(named, group, ["s", "start", "title", "id"], "spot", "start_day", limit)


def cards(rows: DataFrame, days: list[date]) -> DataFrame:
    """(variant, pos, id): five clean listings for families, five unusual ones and five regular ones with two a category at most, in the order of their start."""
    shown = reading.with_span(reading.published(rows)).where((F.col("start_day") <= F.lit(days[-1])) & (F.col("capped_last") >= F.lit(days[0])))
    clean = shown.where(exclusion(F.col("title"), F.col("description")).isNull())
    kind = F.when(F.col("category").isin("family", "weird"), F.col("category")).when(F.col("category").isin(*CARD_CATEGORIES), "regular")
    by = [F.col("start"), F.col("id")]
    few = ranking.first_per(clean.withColumn("variant", kind).where("variant IS NOT NULL"), ["variant", "category"], by, CARD_SIZE)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("variant", "category").orderBy(*by))).where(f"variant <> 'regular' OR n <= {CARD_PER_CATEGORY}")
    return few.withColumn("pos", F.row_number().over(Window.partitionBy("variant").orderBy(*by))).where(F.col("pos") <= CARD_SIZE).select("variant", "pos", "id")


def personal_order(picks: DataFrame, affinity: DataFrame) -> DataFrame:
    """(token, pos, id): every token's picks (pos, id, category) with its favourite categories first, otherwise in the old order.

    picks is a digest's handful of rows.
    """
    tokens = affinity.select("token").distinct()
    each = tokens.join(F.broadcast(picks.withColumnRenamed("pos", "old")), F.lit(True))
    ranked = each.join(affinity.select("token", "category", "rank"), ["token", "category"], "left")
    order = Window.partitionBy("token").orderBy(F.coalesce("rank", F.lit(1 << 30)), "old")
    return ranked.withColumn("pos", F.row_number().over(order)).select("token", "pos", "id")


def open_in(month: int, first: Column, last: Column) -> Column:
    """Whether a season holds a month; it may wrap the new year; null bounds are open all year."""
    m = F.lit(month)
    return F.when(first.isNull(), True).when(first <= last, m.between(first, last)).otherwise((m >= first) | (m <= last))


def filter_places(places: DataFrame, month: int, cost: str = "all", city: str | None = None, details: tuple[str, ...] = (), kinds: tuple[str, ...] = (), open_now: bool = False) -> DataFrame:
    """Places by kind, cost (a donation is neither free nor paid), season, city and details that must all be true."""
    if kinds:
        places = places.where(F.col("kind").isin(*kinds))
    if cost != "all":
        places = places.where(F.col("cost") == cost)
    if open_now:
        places = places.where(open_in(month, F.col("open_month"), F.col("close_month")))
    if city:
        places = places.where(F.col("city") == city)
    for key in details:
        places = places.where(F.coalesce(F.try_element_at("details", F.lit(key)), F.lit(False)))
    return places


def nearest_places(places: DataFrame, lat: float, lng: float) -> DataFrame:
    return places.withColumn("miles", geo.cosine_metres(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) / geo.MILE_M).orderBy("miles", "slug")


def of_the_week(places: DataFrame, day: date) -> DataFrame:
    """The open place whose turn it is, seasonal ones first: the pool by slug, one a week.

    The pool's size is counted first; the place is then the one whose rank the week asks for.
    """
    pool = places.where(open_in(day.month, F.col("open_month"), F.col("close_month")))
    seasonal, every = pool.agg(F.count("open_month"), F.count("*")).first()
    if not every:
        return places.limit(0)
    if seasonal:
        pool = pool.where("open_month IS NOT NULL")
    turn = (day - date(1970, 1, 1)).days // 7 % (seasonal or every)
    return pool.orderBy("slug").offset(turn).limit(1)


def week_lists(pool: DataFrame, reader: str, regular: int) -> DataFrame:
    """(reader, list, pos, id, start): the best family listing, the best unusual one, and `regular` others of each reader's pool.

    A listing is in one list of a reader at most: what an earlier list has taken is not there for a later one. The caps on venues and days
    hold among the regular ones alone. pool: as of picked_pool, with the column `reader`.
    """
    kinds = {"family": "family", "weird": "unique"}
    best = pool.where(F.col("category").isin(*kinds)).groupBy(reader, "category").agg(F.min("order").alias("o"))
    named = F.when(F.col("category") == "family", "family").otherwise("unique")
    first = best.select(reader, named.alias("list"), F.lit(1).alias("pos"), F.col("o.id").alias("id"), F.col("o.start").alias("start"))
    taken = first.select(F.col(reader).alias("__reader"), F.col("id").alias("__id"))
    rest = pool.join(taken, F.col(reader).eqNullSafe(F.col("__reader")) & (F.col("id") == F.col("__id")), "left_anti")
    spread = spread_pool(rest, regular, reader).select(reader, F.lit("regular").alias("list"), F.col("pick").alias("pos"), "id", "start")
    return first.unionByName(spread)


def digest_list(lists: DataFrame, reader: str, cap: int = 8) -> DataFrame:
    """(reader, pos, id, start): family, unusual, then regular listings, `cap` in all, in the order of their start."""
    place = F.array_position(F.array(F.lit("family"), F.lit("unique"), F.lit("regular")), F.col("list"))
    few = ranking.first_per(lists.withColumn("place", place), [reader], [F.col("place"), F.col("pos")], cap)
    return few.withColumn("pos", F.row_number().over(Window.partitionBy(reader).orderBy("start", "place", "id"))).select(reader, "pos", "id", "start")


def by_day(rows: DataFrame, reader: str, order: list[str]) -> DataFrame:
    """(reader, day, ids): the rows of each day in order, as a page shows them."""
    entry = F.struct(*order, F.col("id").alias("__id"))
    return rows.groupBy(reader, F.left("start", F.lit(10)).alias("day")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["__id"]).alias("ids"))
