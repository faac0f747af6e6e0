"""Ranks, decayed scores, tripwires and greedy picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. The order must be total, as Spark's sorts are not stable."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def decayed(rows: DataFrame, key: str, action: str, day: str, weights: dict[str, float], today: Column, half_life: float = 3.0, window: int = 7) -> DataFrame:
    """(key, score): weighted actions of the last `window` days, halved every half_life days of age."""
    age = F.datediff(today, F.col(day))
    weight = F.coalesce(*[F.when(F.col(action) == a, F.lit(float(w))) for a, w in weights.items()], F.lit(0.0))
    near = rows.where((age >= 0) & (age < window))
    return near.groupBy(key, age.alias("age"), weight.alias("weight")).agg(F.count("*").alias("n")).groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("n") * F.pow(F.lit(0.5), F.col("age") / F.lit(half_life))), 6).alias("score"))


def stampede(current: Column, baseline: Column, floor: float, ceiling: float, ratio: float = 2.0) -> Column:
    """A spike over the baseline; without a baseline only the ceiling counts."""
    return F.when(baseline.isNull() | (baseline <= 0), current >= ceiling).otherwise((current >= floor) & (current >= ratio * baseline))


def change_label(current: Column, before: Column) -> Column:
    pct = F.floor((current - before) / before * 100 + F.lit(0.5)).cast("bigint")
    return F.when(before.isNull(), "first report").when(before == 0, F.when(current > 0, "new").otherwise("±0%")).otherwise(F.when(pct == 0, "±0%").otherwise(F.concat(F.when(pct > 0, "+").otherwise(""), pct.cast("string"), F.lit("% WoW"))))


def spread(rows: DataFrame, group: str, order: list[str], unique: str, day: str, limit: int, per_unique: int = 1, per_day: int = 2) -> DataFrame:
    """Greedy picks in order: at most per_unique of each `unique` and per_day of each `day` in a group, up to `limit`.

    The two caps interact, so ranks per key are not enough. What can matter is cut first: of a (unique, day) its first per_unique
    rows, as the later ones meet the same caps; of a day its first (limit + per_day) * per_unique, as at most `limit` uniques are used up.
    """
    first = [F.col(c) for c in order]
    kept = first_per(rows, [group, unique, day], first, per_unique)
    kept = first_per(kept, [group, day], first, (limit + per_day) * per_unique)
    entry = F.struct(*order, F.col(unique).alias("__u"), F.col(day).alias("__d"))
    lists = kept.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    kind = kept.select(entry.alias("e")).schema["e"].dataType.simpleString()
    start = F.expr(f"cast(array() AS array<{kind}>)")

    def take(acc: Column, x: Column) -> Column:
        same = F.size(F.filter(acc, lambda y: y["__u"] == x["__u"])) < per_unique
        free = F.size(F.filter(acc, lambda y: y["__d"] == x["__d"])) < per_day
        return F.when((F.size(acc) < limit) & same & free, F.concat(acc, F.array(x))).otherwise(acc)

    picks = lists.select(group, F.posexplode(F.aggregate("rows", start, take)).alias("pick", "e"))
    return picks.select(group, (F.col("pick") + 1).alias("pick"), *[F.col(f"e.{c}").alias(c) for c in order], F.col("e.__u").alias(unique), F.col("e.__d").alias(day))
