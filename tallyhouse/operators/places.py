"""Places of a registry: their facts, lookups, neighbours and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of one theme are related. Fixed values of the registry.
THEMES = {"beach": "water", "rink": "winter", "garden": "green", "trail": "green", "market": "town"}


def cross_kind_details(places: DataFrame, labels: tuple[str, ...], least: int = 2) -> DataFrame:
    """(pos, detail, kinds): details that places of at least `least` kinds have, in the order of the labels."""
    there = places.select("kind", F.explode("details").alias("detail", "there")).where("there")
    n = there.groupBy("detail").agg(F.count_distinct("kind").alias("kinds")).where(F.col("kinds") >= least)
    return n.withColumn("pos", F.array_position(F.array(*map(F.lit, labels)), F.col("detail")).cast("int")).where("pos > 0").select("pos", "detail", "kinds")


def kind_facts(places: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(kind, details, cities, summary) of each kind: details that some place has, in the order of the labels, its cities, and how many have each detail."""
    n = [F.count_if(F.coalesce(F.try_element_at("details", F.lit(k)), F.lit(False))).alias(f"n_{k}") for k in labels]
    g = places.groupBy("kind").agg(F.count("*").alias("all"), F.array_sort(F.collect_set("city")).alias("cities"), *n)
    some = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in labels]))
    said = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(f"{k} at "), F.col(f"n_{k}").cast("string"), F.lit(" of "), F.col("all").cast("string"))) for k in labels]))
    return g.select("kind", some.alias("details"), "cities", F.array_join(said, "; ").alias("summary"))


def found_places(asked: DataFrame, places: DataFrame) -> DataFrame:
    """asked (slug, kind null) with the place (found) of that slug, and of that kind where one is asked for."""
    p = places.select(F.col("slug").alias("found"), F.col("kind").alias("found_kind"))
    return asked.join(p, (F.col("slug") == F.col("found")) & (F.col("kind").isNull() | (F.col("kind") == F.col("found_kind"))), "left").select("slug", "kind", "found", "found_kind")


def related_kinds(places: DataFrame) -> DataFrame:
    """(kind, related): kinds that places have, with the other kinds of their theme that places have."""
    theme = F.create_map(*[F.lit(x) for pair in THEMES.items() for x in pair])
    k = places.select("kind").distinct().withColumn("theme", F.try_element_at(theme, F.col("kind")))
    other = k.select(F.col("kind").alias("related"), F.col("theme").alias("of"))
    return k.join(other, (F.col("theme") == F.col("of")) & (F.col("kind") != F.col("related"))).select("kind", "related")


def place_document(rows: DataFrame, base: str) -> Column:
    """A schema.org Place as JSON, safe inside a script element."""
    free = F.when(F.col("cost") == "free", True).when(F.col("cost") == "paid", False)
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Place").alias("@type"), F.col("slug").alias("name"), F.concat(F.lit(f"{base}/places/"), "kind", F.lit("/"), "slug").alias("url"), free.alias("isAccessibleForFree"), F.struct(F.lit("PostalAddress").alias("@type"), F.col("city").alias("addressLocality"), F.lit("MN").alias("addressRegion")).alias("address"))
    return F.replace(F.to_json(doc), F.lit("<"), F.lit("\\u003c"))


def item_list(rows: DataFrame, key: str, order: list[str], name: Column, url: Column, most: int = 20) -> DataFrame:
    """(key, doc): a schema.org ItemList of each key's first rows."""
    entry = F.struct(*order, name.alias("__name"), url.alias("__url"))
    first = F.slice(F.array_sort(F.collect_list(entry)), 1, most)
    items = F.transform(first, lambda e, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), e["__name"].alias("name"), e["__url"].alias("url")))
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), items.alias("itemListElement"))
    return rows.groupBy(key).agg(F.replace(F.to_json(doc), F.lit("<"), F.lit("\\u003c")).alias("doc"))


def pinned_map(places: DataFrame, key: str, order: list[str], base: str, most: int = 30) -> DataFrame:
    """(key, url): the address of a map with numbered pins of each key's first places, as the list beneath it has them."""
    there = places.where("lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)")
    first = F.slice(F.array_sort(F.collect_list(F.struct(*order, "lat", "lng"))), 1, most)
    pins = F.transform(first, lambda e, i: F.concat(F.lit("pin-"), (i + 1).cast("string"), F.lit("("), F.format_string("%.4f", e["lng"]), F.lit(","), F.format_string("%.4f", e["lat"]), F.lit(")")))
    return there.groupBy(key).agg(F.concat(F.lit(base), F.array_join(pins, ",")).alias("url"))
