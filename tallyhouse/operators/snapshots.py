"""Writes as new snapshots: dedupe, upsert, status changes, counters, and their audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def richest(rows: DataFrame, key: str, richness: Column, arrival: str) -> DataFrame:
    """One row a key: the richest, the latest of equals."""
    order = Window.partitionBy(key).orderBy(richness.desc(), F.col(arrival).desc())
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(current: DataFrame, staged: DataFrame, key: str, only_on_insert: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot: staged rows replace or join current ones; some columns keep their current value.

    staged has one row a key. A full outer join, as Parquet tables know no MERGE.
    """
    c, s = current.alias("c"), staged.alias("s")
    joined = c.join(s, F.col(f"c.{key}") == F.col(f"s.{key}"), "full_outer")
    old, new = F.col(f"c.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    columns = []
    for name in current.columns:
        if name == key:
            columns.append(F.coalesce(F.col(f"s.{key}"), F.col(f"c.{key}")).alias(key))
        elif name in only_on_insert:
            columns.append(F.when(old, F.col(f"c.{name}")).otherwise(F.col(f"s.{name}")).alias(name))
        else:
            columns.append(F.when(new, F.col(f"s.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
    return joined.select(*columns)


def change_status(current: DataFrame, keys: DataFrame, key: str, status: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, audit): rows named by keys get a status; audit has one row for each that changed."""
    named = keys.select(F.col(key).alias("__key")).distinct()
    joined = current.join(named, current[key] == named["__key"], "left")
    hit = F.col("__key").isNotNull() & ~F.col(status).eqNullSafe(F.lit(to))
    audit = joined.where(hit).select(key, F.col(status).alias("before"), F.lit(to).alias("after"))
    return joined.withColumn(status, F.when(hit, F.lit(to)).otherwise(F.col(status))).drop("__key"), audit


def limit_hits(hits: DataFrame, bucket: str, order: list[str], most: int, minutes: int = 60) -> DataFrame:
    """hits with n and allowed: a bucket's window starts at its first hit and restarts at the first one after it has lapsed.

    order: the time, then what makes it total. A hit that comes a whole window after the one before starts a window whatever came
    earlier, so runs between such gaps are dealt to tasks one by one; only within a run do restarts depend on each other, and it is folded in order, a bounded batch of rows at a time.
    """
    at = order[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields) + ", n bigint, allowed boolean"
    span = minutes * 60_000_000
    by = Window.partitionBy(bucket).orderBy(*order)
    lapsed = F.coalesce((F.col(at) >= F.lag(at).over(by) + F.make_dt_interval(mins=F.lit(minutes))).cast("int"), F.lit(1))
    runs = hits.withColumn("__lapsed", lapsed).withColumn("__run", F.sum("__lapsed").over(by)).drop("__lapsed")
    rows = runs.repartition(bucket, "__run").sortWithinPartitions(bucket, "__run", *order)

    def fold(frames):
        key, began, n = None, 0, 0
        for frame in frames:
            counts = []
            for b, run, t in zip(frame[bucket], frame["__run"], frame[at].astype("int64") // _TICK[str(frame[at].dtype)], strict=True):
                if (b, run) != key or t - began >= span:
                    key, began, n = (b, run), t, 0
                n += 1
                counts.append(n)
            yield frame.drop(columns="__run").assign(n=counts, allowed=[x <= most for x in counts])

    return rows.mapInPandas(fold, schema)


#: Ticks of a microsecond in a pandas column of times.
_TICK = {"datetime64[ns]": 1000, "datetime64[us]": 1}
