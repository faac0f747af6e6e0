"""Dimensions, placements, look-ups against lists, parsed feeds, scored categories, logs and cached snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions import keys
from tallyhouse.functions.text import key_part
from tallyhouse.operators.reading import CATEGORIES


def with_dimension(rows: DataFrame, name: Column, aliases: DataFrame, other: str | None = None) -> DataFrame:
    """rows with `slug`: what aliases (pos, alias, slug) calls the name's key; of equal aliases the first counts; `other` for none.

    Spark broadcasts the registry if its size allows.
    """
    first = aliases.groupBy(key_part(F.col("alias")).alias("__alias")).agg(F.min(F.struct("pos", "slug"))["slug"].alias("slug"))
    joined = rows.withColumn("__key", key_part(name)).join(first, F.col("__key") == F.col("__alias"), "left").drop("__key", "__alias")
    return joined.withColumn("slug", F.coalesce("slug", F.lit(other)))


def missing(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Named ids that rows have not."""
    return ids.select("id").distinct().join(rows.select("id"), "id", "left_anti")


def backup(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """What the columns of the named rows hold before a change."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi").select("id", *columns)


def restore(rows: DataFrame, before: DataFrame) -> DataFrame:
    """rows with the values of a backup; rows that it has not stay as they are."""
    names = [c for c in before.columns if c != "id"]
    old = before.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in names])
    j = rows.join(old, F.col("id") == F.col("__id"), "left")
    return j.select(*[F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


def featured(placements: DataFrame, pool: DataFrame, now: Column, cap: int) -> DataFrame:
    """(id, label, pos): placements (id, label, starts, ends) that hold now, of listings in the pool, the latest begun first, `cap` at most."""
    live = placements.where(now.between(F.col("starts"), F.col("ends"))).join(pool.select("id"), "id", "left_semi")
    first = live.orderBy(F.desc("starts"), "id").limit(cap)
    return first.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("starts"), "id"))).select("id", "label", "pos")


def chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with `chunk`: batches of `size` in an order. The rows are a work list, ordered in one task."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))


def category_scores(title: Column, description: Column, venue: Column, rules: dict[str, dict[str, float]], venue_rules: dict[str, dict[str, float]] | None = None) -> dict[str, Column]:
    """A score of each category: the weights of its patterns, twice in the title, once in the description and half (rounded up) in the venue.

    Scores are sums of generated columns, so no row meets a table of rules.
    """
    hit = lambda text, p, w: F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(p), F.lit(w)).otherwise(F.lit(0.0))
    out = {}
    for name, words in rules.items():
        total = F.lit(0.0)
        for p, w in words.items():
            total = total + hit(title, p, 2.0 * w) + hit(description, p, float(w)) + hit(venue, p, float(int(w / 2 + 0.5)))
        for p, w in (venue_rules or {}).get(name, {}).items():
            total = total + hit(venue, p, float(w))
        out[name] = total
    return out


def muted(scores: dict[str, Column], where: Column, names: tuple[str, ...], factor: float, floor: dict[str, float] | None = None) -> dict[str, Column]:
    """Scores damped where a condition holds, and raised by a floor for some categories."""
    return {n: F.when(where, s * (factor if n in names else 1.0) + (floor or {}).get(n, 0.0)).otherwise(s) for n, s in scores.items()}


def best_category(scores: dict[str, Column], fallback: Column) -> Column:
    """The category of the highest score, in the categories' own order; the fallback if all are zero, else festival."""
    best = F.greatest(*scores.values())
    known = F.when(fallback.isin(*CATEGORIES), fallback).otherwise("festival")
    out = F.when(best <= 0, known)
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def meta_description(rows: DataFrame) -> Column:
    """Day, place, price and text of a listing in 200 characters."""
    where = F.concat_ws(", ", F.when(F.col("venue") != "", F.col("venue")), F.when(F.col("city") != "", F.col("city")))
    text = F.concat(F.date_format("start_day", "EEEE, MMMM d"), F.lit(" at "), where, F.lit(". "), F.col("price"), F.lit("."), F.when(F.col("description") != "", F.concat(F.lit(" "), F.col("description"))).otherwise(""))
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(200))


def bucket_name(action: str, forwarded: Column) -> Column:
    """The limiter's bucket of a request: its action and the first hop that it came by."""
    hop = F.trim(F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), 1))
    return F.concat(F.lit(f"{action}:"), F.when(hop == "", "unknown").otherwise(hop))


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add rows to a log table; what is there stays."""
    rows.write.mode("append").parquet(path)


class Snapshots:
    """Results kept as tables for a time: a read within `ttl` seconds reuses the last one; a tag drops what it names."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = 3600.0, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.ttl, self.clock = spark, folder, ttl, clock
        self.made: dict[str, tuple[float, int, tuple[str, ...]]] = {}

    def get(self, name: str, make: Callable[[], DataFrame], tags: tuple[str, ...] = ()) -> DataFrame:
        at, version, _ = self.made.get(name, (float("-inf"), 0, ()))
        if self.clock() - at >= self.ttl:
            version += 1
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}-{version}")
            self.made[name] = (self.clock(), version, tags)
        return self.spark.read.parquet(f"{self.folder}/{name}-{version}")

    def drop(self, tag: str) -> None:
        for name, (_, version, tags) in list(self.made.items()):
            if tag in tags:
                self.made[name] = (float("-inf"), version, tags)


#: What the explorer's address can hold, and the values that it takes. Fixed values.
EXPLORER = {"range": ("today", "weekend", "week", "month"), "category": CATEGORIES, "price": ("Free", "$", "$$", "$$$"), "area": tuple([*keys.AREAS, "other"]), "radius": ("5", "10", "25", "50")}


def read_address(query: str) -> dict[str, list[str]]:
    """The state in an address: known fields and values only, lists by commas, the free text as q."""
    out: dict[str, list[str]] = {}
    for name, value in parse_qsl(query.lstrip("?")):
        if name == "q" and value.strip():
            out["q"] = [value.strip()]
        elif found := [v for v in value.split(",") if v in EXPLORER.get(name, ())]:
            out[name] = found
    return out


def write_address(state: dict[str, list[str]]) -> str:
    return urlencode({k: ",".join(v) for k, v in sorted(state.items()) if v})


def geocoded(rows: DataFrame, found: DataFrame, address: str) -> DataFrame:
    """rows with lat and lng of their address in a table of answers (address, lat, lng); rows without an answer are dropped."""
    return rows.join(found.where("lat IS NOT NULL AND lng IS NOT NULL"), address)


def sample_listings(spark: SparkSession) -> DataFrame:
    """A few rows to show where there is no table."""
    return spark.createDataFrame(pd.DataFrame([{"id": k, "title": t, "category": c, "start": f"2026-07-1{k}T19:00", "status": "published"} for k, (t, c) in enumerate([("Concert in the Park", "music"), ("Market Day", "food"), ("Puppet Hour", "family")], 1)]))
