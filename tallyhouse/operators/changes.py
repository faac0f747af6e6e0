"""What changed between two snapshots of a table, and going there and back.

A change feed has a row for each key that was inserted, updated or deleted, with the row before and after. It is found by one full outer join on the key
in which rows that hash alike drop out before their columns are compared; applied to the old snapshot it gives the new one, and turned round the old one again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import spans


def _row(columns: list[str], side: str = "") -> Column:
    return F.struct(*[F.col(f"{side}{c}").alias(c) for c in columns])


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, before, after): before and after are structs of the columns of `before`, null where the row is not there. Keys are distinct and not null."""
    columns = before.columns
    keyed = lambda d, n: d.select(F.col(key).alias(f"{n}_key"), F.xxhash64(*columns).alias(f"{n}_hash"), _row(columns).alias(n))
    j = keyed(before, "before").join(keyed(after.select(*columns), "after"), F.col("before_key") == F.col("after_key"), "full_outer")
    kind = F.when(F.col("before_key").isNull(), "insert").when(F.col("after_key").isNull(), "delete").otherwise("update")
    # equal hashes of unequal rows are met once in 2^64 pairs: then the columns decide
    moved = j.where(~(F.col("before_hash").eqNullSafe(F.col("after_hash")) & F.col("before").eqNullSafe(F.col("after"))))
    return moved.select(F.coalesce("before_key", "after_key").alias(key), kind.alias("kind"), "before", "after")


def changed_fields(feed: DataFrame, columns: list[str]) -> Column:
    """Names of the columns that differ, for updates."""
    each = F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in columns])
    return F.when(F.col("kind") == "update", F.array_compact(each))


def applied(rows: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The snapshot after a feed: named rows become what the feed says, inserted ones are added, deleted ones go."""
    columns = rows.columns
    f = feed.select(F.col(key).alias("__key"), "kind", "after")
    j = rows.join(f, F.col(key) == F.col("__key"), "full_outer").where("kind IS NULL OR kind <> 'delete'")
    return j.select(*[F.when(F.col("kind").isNull(), F.col(c)).otherwise(F.col(f"after.{c}")).alias(c) for c in columns])


def turned(feed: DataFrame, key: str) -> DataFrame:
    """The feed that leads back."""
    back = F.when(F.col("kind") == "insert", "delete").when(F.col("kind") == "delete", "insert").otherwise("update")
    return feed.select(key, back.alias("kind"), F.col("after").alias("before"), F.col("before").alias("after"))


def touched(before: DataFrame, after: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """after with column `at`: now for rows that are new or differ from before in another column, else what it was."""
    columns = [c for c in before.columns if c != at]
    old = before.select(F.col(key).alias("__key"), F.xxhash64(*columns).alias("__hash"), F.col(at).alias("__at"))
    j = after.select(*columns).withColumn("__own", F.xxhash64(*columns)).join(old, F.col(key) == F.col("__key"), "left")
    return j.withColumn(at, F.when(F.col("__hash").eqNullSafe(F.col("__own")), F.col("__at")).otherwise(now)).select(*before.columns)


def repaired(rows: DataFrame, fixes: DataFrame, key: str, field: str) -> DataFrame:
    """rows with `field` from fixes (key, field), where these name the row; of several fixes of a row the largest value counts."""
    f = fixes.groupBy(F.col(key).alias("__key")).agg(F.max(field).alias("__new"))
    return rows.join(f, F.col(key) == F.col("__key"), "left").withColumn(field, F.coalesce("__new", field)).select(*rows.columns)


def shifted(rows: DataFrame, named: DataFrame, key: str, start: str, hours: int, before_hour: int) -> DataFrame:
    """rows whose wall start is moved by hours, where `named` (key) names them and they start before an hour of the day; others stay, so a second run does nothing more."""
    n = named.select(F.col(key).alias("__key")).distinct()
    hit = F.col("__key").isNotNull() & (F.substring(start, 12, 2).cast("int") < before_hour)
    later = F.date_format(F.to_timestamp_ntz(F.replace(F.col(start), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm")) + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm")
    return rows.join(n, F.col(key) == F.col("__key"), "left").withColumn(start, F.when(hit, later).otherwise(F.col(start))).select(*rows.columns)


def applied_games(rows: DataFrame, verdicts: DataFrame, found: DataFrame, now: str) -> dict[str, DataFrame]:
    """{"listings", "audit"}: rows (id, key, title, start, status, verified_at) after a league's verdicts, and what was done to each.

    verdicts: id, verdict, start (of the feed), truth. Phantoms and wrong opponents are hidden, other times corrected; both what was right and what has been corrected is
    verified now. found (id, key, title, start; keys distinct): games that weren't listed. One whose key a row has already takes that row over and brings it back if it is hidden, even if
    by this very plan: the league outranks a hide; the others are added.
    """
    v = verdicts.select(F.col("id").alias("v_id"), "verdict", F.col("start").alias("to"), "truth")
    f = found.select(F.col("key").alias("f_key"), F.col("title").alias("f_title"), F.col("start").alias("f_start"))
    hide = F.col("verdict").isin("phantom", "wrong-opponent")
    j = rows.join(v, F.col("id") == F.col("v_id"), "left").join(f, F.col("key") == F.col("f_key"), "left")
    j = j.withColumns({"hidden": F.coalesce(hide, F.lit(False)), "met": F.col("f_key").isNotNull(), "moved": F.coalesce(F.col("verdict") == "retime", F.lit(False))})
    state = F.when(F.col("hidden"), "draft").otherwise(F.col("status"))
    back = F.col("met") & state.isin("draft", "archived")
    after = j.select(
        "id",
        "key",
        F.coalesce("f_title", "title").alias("title"),
        F.coalesce(F.col("f_start"), F.when(F.col("moved"), F.col("to")), F.col("start")).alias("start"),
        F.when(back, "published").otherwise(state).alias("status"),
        F.when(F.col("met") | F.col("moved") | (F.col("verdict") == "ok"), F.lit(now)).otherwise(F.col("verified_at")).alias("verified_at"),
    )
    new = found.join(rows.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_anti").select("id", "key", "title", "start", F.lit("published").alias("status"), F.lit(now).alias("verified_at"))
    why = F.when(F.col("verdict") == "phantom", "no home game that day").otherwise(F.concat(F.lit("the opponent is "), F.coalesce("truth", F.lit("?"))))
    notes = F.array(
        F.when(F.col("hidden"), F.struct(F.lit("hide").alias("action"), why.alias("note"))),
        F.when(F.col("moved"), F.struct(F.lit("retime").alias("action"), F.concat(F.col("start"), F.lit(" to "), F.col("to")).alias("note"))),
        F.when(back, F.struct(F.lit("republish").alias("action"), state.alias("note"))),
    )
    audit = j.select("id", F.explode(F.array_compact(notes)).alias("n")).select("id", "n.action", "n.note").unionByName(new.select("id", F.lit("add").alias("action"), F.col("title").alias("note")))
    return {"listings": after.unionByName(new), "audit": audit}


def archived(rows: DataFrame, start: str, today: str) -> DataFrame:
    """rows whose published listings that started before a day are archived."""
    return rows.withColumn("status", F.when((F.col("status") == "published") & (spans.day_of(F.col(start)) < F.lit(today).cast("date")), "archived").otherwise(F.col("status")))
