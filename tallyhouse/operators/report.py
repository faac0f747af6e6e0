"""The operator's weekly report: nine sections from one pass over each table.

Every table is summed up to one row (conditional counts, the latest runs as a short list); the rows are put side by side and each section is a few expressions over them, so a
table is read once however many sections speak of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.ranking import change_label

#: Days after which a report or a digest is late, the spike over the busiest recent run, and the counts below or above which it does or doesn't matter. Fixed values.
STALE_REPORT_DAYS, STALE_DIGEST_DAYS = 3, 8
SPIKE, SPIKE_FLOOR, SPIKE_CEILING = 2.0, 50, 100
RUN = "started, seconds, ok, error, upserted, collapsed, collapsed_runs, archived"


def latest(runs: DataFrame, order: list[str], n: int) -> DataFrame:
    """One row: `runs`, the latest n runs as an array of structs, the last one first."""
    few = runs.orderBy(*[F.desc(c) for c in order]).limit(n)
    entry = F.struct(*order, *[c for c in runs.columns if c not in order])
    return few.agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("runs"))


def delta(now: Column, before: Column) -> Column:
    """How a count has changed, in brackets; nothing where there is no earlier one."""
    d = now - before
    return F.when(d.isNull(), "").when(d == 0, " (±0)").otherwise(F.concat(F.lit(" ("), F.when(d > 0, "+").otherwise(""), d.cast("string"), F.lit(")")))


def took(seconds: Column) -> Column:
    return F.concat(F.when(seconds >= 60, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "))).otherwise(""), (seconds % 60).cast("string"), F.lit("s"))


def spikes(now: Column, before: Column) -> Column:
    """Whether a count is a spike over the busiest of the runs before; without any only the ceiling counts."""
    most = F.array_max(before)
    return F.when(most.isNull() | (most <= 0), now >= SPIKE_CEILING).otherwise((now >= SPIKE_FLOOR) & (now >= SPIKE * most))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _many(n: Column, one: str, more: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(more)))


def sections(facts: DataFrame, floors: dict[str, int]) -> DataFrame:
    """(pos, section, lines, alert) from one row of facts.

    facts: runs (of `latest`); week_<category>; verified7, never_verified; <action>7 and <action>_before; top_viewed; trending; urls, urls_before; subscribed,
    subscribed7, digest_age; feeds (array of n, slug, the most used first); submissions, reports, oldest_report.
    """
    c, line = F.col, lambda *x: F.concat_ws("\n", *x)
    run, before = F.get("runs", F.lit(0)), F.get("runs", F.lit(1))
    earlier = lambda f: F.transform(F.filter(F.slice("runs", 2, 4), lambda r: r["ok"]), lambda r: r[f])
    stage = lambda name, f: _text(F.coalesce(run[f], F.lit(0)), f" {name}", delta(run[f], before[f]))
    spiked = spikes(run["archived"], earlier("archived")) | spikes(run["collapsed"], earlier("collapsed"))
    well = line(F.concat(F.lit("ok: "), F.concat_ws(", ", stage("upserted", "upserted"), stage("deduped", "collapsed"), stage("collapsed", "collapsed_runs"), stage("archived", "archived"))), _text("took ", took(run["seconds"])), F.when(spiked, "stampede check: far more was archived or deduped than in recent runs"))
    pipeline = F.when(run.isNull(), "no runs recorded yet").when(run["seconds"].isNull(), "the last run was killed or is not complete").when(~run["ok"], _text("the last run failed: ", F.coalesce(run["error"], F.lit("no error recorded")))).otherwise(well)
    thin = [F.when(c(f"week_{k}") < n, _text(f"{k} ", c(f"week_{k}"), f"/{n}")) for k, n in floors.items()]
    healthy = F.size(F.array_compact(F.array(*thin))) == 0
    wow = lambda a: _text(f"{a} ", c(f"{a}7"), " (", change_label(c(f"{a}7"), c(f"{a}_before")), ")")
    age = c("digest_age")
    missed = F.coalesce(age >= STALE_DIGEST_DAYS, F.lit(False))
    digest = F.when(age.isNull(), "no digest sent yet").when(missed, _text("a send was missed: the last was ", age, " days ago")).otherwise(_text("last digest: ", _many(age, " day ago", " days ago")))
    fed = F.aggregate("feeds", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    late = F.coalesce(c("oldest_report") >= STALE_REPORT_DAYS, F.lit(False))
    waiting = line(F.when(c("submissions") > 0, _text(_many(c("submissions"), " submission", " submissions"), " waiting")), F.when(c("reports") > 0, _text(_many(c("reports"), " report", " reports"), " waiting")), F.when(late, _text("the oldest report is ", c("oldest_report"), " days old")))
    out = [
        ("pipeline", pipeline, F.coalesce(run["seconds"].isNull() | ~run["ok"] | spiked, F.lit(True))),
        ("coverage", F.when(healthy, "every category has its floor").otherwise(F.concat_ws("\n", *thin)), ~healthy),
        ("verification", line(_text(c("verified7"), " verified in 7 days"), _text(c("never_verified"), " upcoming never verified")), F.lit(False)),
        ("engagement", line(F.concat_ws(", ", wow("view"), wow("ticket_click")), F.concat_ws(", ", wow("save"), wow("calendar")), _text("most viewed: ", c("top_viewed"))), F.lit(False)),
        ("trending", F.when(c("trending") == 0, "dark: below the minimum").otherwise(_text(c("trending"), " trending")), F.lit(False)),
        ("index", _text(c("urls"), " addresses (", change_label(c("urls"), c("urls_before")), ")"), F.lit(False)),
        ("subscribers", line(_text(c("subscribed"), " subscribed (+", c("subscribed7"), " in 7 days)"), digest), missed),
        ("feeds", F.when(fed == 0, "no subscriptions in 7 days").otherwise(line(_text(_many(fed, " subscription", " subscriptions"), " in 7 days"), F.array_join(F.transform(F.slice("feeds", 1, 3), lambda x: F.concat(x["slug"], F.lit(": "), x["n"].cast("string"))), "\n"))), F.lit(False)),
        ("queue", F.when(waiting == "", "nothing waiting").otherwise(waiting), late),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("section"), text.alias("lines"), alert.alias("alert")) for i, (n, text, alert) in enumerate(out, 1)])
    return facts.select(F.explode(rows).alias("s")).select("s.*")
