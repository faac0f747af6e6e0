"""State changes as new snapshots: subscriptions, saves, reviews, edits, archives; and the checks of what comes in."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import spans
from tallyhouse.functions.keys import normal_url
from tallyhouse.functions.text import is_email
from tallyhouse.operators.reading import CATEGORIES

SAVED_CAP = 300
#: Largest lengths, days ahead, and reviewers' kinds. Fixed values.
LONGEST = {"title": 140, "venue": 120, "city": 80, "address": 160, "url": 300, "description": 1000, "reason": 1000}
FUTURE_DAYS = 400


def errors(checks: dict[str, list[tuple[Column, str]]]) -> Column:
    """map<field, code>: for each field the code of the first check that holds; fields without any are left out."""
    found = [x for field, tests in checks.items() for x in (F.lit(field), F.coalesce(*[F.when(bad, code) for bad, code in tests]))]
    return F.map_filter(F.create_map(*found), lambda _, code: code.isNotNull())


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def submission_errors(today: date) -> Column:
    """Of columns title, category, date, time, end_time, venue, city, address, url, description, email: what is wrong with them."""
    day = F.when(_text("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date"))
    clock = r"^([01]\d|2[0-3]):[0-5]\d$"
    long = lambda n: (F.length(_text(n)) > LONGEST[n], "long")
    url = normal_url(F.col("url"))
    return errors({
        "title": [(F.length(_text("title")) < 3, "short"), long("title")],
        "category": [(~_text("category").isin(*CATEGORIES), "unknown")],
        "date": [(day.isNull(), "invalid"), (day < F.lit(today), "past"), (day > F.lit(today + timedelta(days=FUTURE_DAYS)), "far")],
        "time": [(~_text("time").rlike(clock), "invalid")],
        "end_time": [((_text("end_time") != "") & ~_text("end_time").rlike(clock), "invalid")],
        "venue": [(_text("venue") == "", "missing"), long("venue")],
        "city": [(_text("city") == "", "missing"), long("city")],
        "address": [long("address")],
        "url": [((url != "") & ~url.rlike(r"(?i)^https?://[^\s/]+\.[^\s]+$"), "invalid"), (F.length(url) > LONGEST["url"], "long")],
        "description": [long("description")],
        "email": [((_text("email") != "") & ~is_email(F.lower(_text("email"))), "invalid")],
    })


UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def report_errors(kinds: tuple[str, ...]) -> Column:
    """Of columns listing, kind, reason, email."""
    return errors({
        "listing": [(_text("listing") == "", "missing"), (~_text("listing").rlike(UUID), "invalid")],
        "kind": [(_text("kind") == "", "missing"), (~_text("kind").isin(*kinds), "unknown")],
        "reason": [(_text("reason") == "", "missing"), (F.length(_text("reason")) > LONGEST["reason"], "long")],
        "email": [((_text("email") != "") & ~is_email(_text("email")), "invalid")],
    })


def beacon_refusal(actions: tuple[str, ...]) -> Column:
    """Why a beacon (listing, action) is refused, null if it is not."""
    return F.when(~_text("listing").rlike(UUID), "listing").when(~F.coalesce(F.col("action").isin(*actions), F.lit(False)), "action")


def archive_past(rows: DataFrame, today: date) -> DataFrame:
    """The next snapshot: published listings whose end (several days', own, else start) lies before today become archived."""
    end = spans.day_of(F.coalesce("multi_day_end", "end_wall", "start"))
    return rows.withColumn("status", F.when((F.col("status") == "published") & (end < F.lit(today)), "archived").otherwise(F.col("status")))


def subscribe(current: DataFrame, requests: DataFrame) -> DataFrame:
    """(email, before, status, result) of each requested address (requests: email, one row each) against current (email, status, left).

    left: whether the address has ever unsubscribed. Who left and isn't subscribed must confirm again; an unknown address is added.
    """
    asked = requests.select(F.lower(F.trim("email")).alias("email")).distinct()
    known = current.select(F.col("email").alias("of"), F.col("status").alias("before"), "left")
    j = asked.join(known, F.col("email") == F.col("of"), "left")
    again = F.col("left") & (F.col("before") != "subscribed")
    result = F.when(~is_email(F.col("email")), "invalid").when(F.col("of").isNull(), "added").when(again, "reconfirm").when(F.col("before") == "subscribed", "already").otherwise("resubscribed")
    status = F.when(result == "invalid", F.lit(None)).when(again, "pending").otherwise("subscribed")
    return j.select("email", "before", status.alias("status"), result.alias("result"))


def confirm(current: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, result): pending ids are confirmed, subscribed ones are already, all others expired."""
    j = ids.select("id").distinct().join(current.select(F.col("id").alias("of"), "status"), F.col("id") == F.col("of"), "left")
    return j.select("id", F.when(F.col("status") == "pending", "confirmed").when(F.col("status") == "subscribed", "already").otherwise("expired").alias("result"))


def unsubscribe(current: DataFrame, ids: DataFrame) -> DataFrame:
    """The next snapshot of (id, status, saver): those named leave, and their saver is severed."""
    gone = current.join(ids.select(F.col("id").alias("of")).distinct(), F.col("id") == F.col("of"), "left")
    hit = F.col("of").isNotNull() & (F.col("status") != "unsubscribed")
    return gone.select("id", F.when(hit, "unsubscribed").otherwise(F.col("status")).alias("status"), F.when(~hit, F.col("saver")).alias("saver"))


def save(saved: DataFrame, wanted: DataFrame, cap: int = SAVED_CAP) -> DataFrame:
    """The next (token, id, since): wanted rows join what is saved, each pair once, until a token has `cap`; the earliest come first."""
    fresh = wanted.groupBy("token", "id").agg(F.min("since").alias("since")).join(saved.select("token", "id"), ["token", "id"], "left_anti")
    counts = saved.groupBy("token").agg(F.count("*").alias("have"))
    order = Window.partitionBy("token").orderBy("since", "id")
    room = fresh.join(counts, "token", "left").withColumn("n", F.row_number().over(order) + F.coalesce("have", F.lit(0))).where(F.col("n") <= cap)
    return saved.select("token", "id", "since").unionByName(room.select("token", "id", "since"))


def unsave(saved: DataFrame, gone: DataFrame) -> DataFrame:
    return saved.join(gone.select("token", "id").distinct(), ["token", "id"], "left_anti")


def merge_tokens(saved: DataFrame, links: DataFrame) -> DataFrame:
    """What is saved under an old token joins the new one's (links: old, new), each listing once, since its earliest time."""
    moved = saved.join(links, F.col("token") == F.col("old"), "left").select(F.coalesce("new", "token").alias("token"), "id", "since")
    return moved.groupBy("token", "id").agg(F.min("since").alias("since"))


def verdict_actions(verdicts: DataFrame) -> DataFrame:
    """(id, action, note) from (id, verdict, evidence, new_start): only a cancellation with evidence cancels; what moved, sold out or is gone is flagged."""
    proof = F.trim(F.coalesce("evidence", F.lit("")))
    v = F.col("verdict")
    action = F.when(v == "confirmed", "confirm").when((v == "cancelled") & (proof != ""), "cancel").otherwise("flag")
    note = F.when(action == "cancel", F.left(proof, F.lit(500))).when(v == "cancelled", "cancelled without evidence").when(v == "moved", F.coalesce(F.concat(F.lit("source shows "), F.col("new_start")), F.lit("time appears changed"))).when(v == "sold_out", "sold out").when(v == "not_found", "source page not found")
    return verdicts.select("id", action.alias("action"), note.alias("note"))


def apply_actions(rows: DataFrame, actions: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, audit): cancelled listings that are published change status; a confirmation stamps verified_at with now, if given; every other action leaves an audit row."""
    a = actions.select(F.col("id").alias("of"), "action", "note")
    j = rows.join(a, F.col("id") == F.col("of"), "left")
    hit = (F.col("action") == "cancel") & (F.col("status") == "published")
    snapshot = j.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "cancelled").otherwise(F.col("status")))
    if now is not None:
        snapshot = snapshot.withColumn("verified_at", F.when(F.col("action") == "confirm", now).otherwise(F.col("verified_at")))
    snapshot = snapshot.select(*rows.columns)
    return snapshot, a.where("action <> 'confirm'").select(F.col("of").alias("id"), F.concat(F.lit("verify_"), F.col("action")).alias("action"), "note")


def edit(rows: DataFrame, patches: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(snapshot, audit): patches (id and some of `fields`, null: as it was) replace values; the audit has a row for each field that changed."""
    p = patches.select(F.col("id").alias("of"), *[F.col(f).alias(f"new_{f}") for f in fields])
    j = rows.join(p, F.col("id") == F.col("of"), "left")
    changes = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), F.col(f"new_{f}").cast("string").alias("after")) for f in fields]), lambda x: x["after"].isNotNull() & ~x["after"].eqNullSafe(x["before"]))
    audit = j.select("id", F.explode(changes).alias("c")).select("id", "c.field", "c.before", "c.after")
    return j.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]), audit


def prune(rows: DataFrame, at: str, now: Column, days: int = 2) -> DataFrame:
    """The next snapshot without what has been idle for more than `days`."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))
