"""Every registered query of the library against its SQL."""

import math
import os

import pytest

from tallyhouse.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple(f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(plain(r) for r in got.select(cols).collect())
    if name in oracle_sql():
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert rows == sorted(plain(r) for r in duck.sql(f"SELECT {quoted} FROM ({oracle_sql()[name]})").fetchall())
    else:
        assert rows


def test_limiter_restarts_at_the_first_hit_after_a_lapse(spark):
    from tallyhouse.operators.snapshots import limit_hits

    rows = spark.sql("SELECT b, to_timestamp('2024-01-01') + make_dt_interval(0, 0, m) AS at, m FROM VALUES ('a', 0), ('a', 30), ('a', 59), ('a', 60), ('a', 100), ('b', 10), ('a', 121) AS t(b, m)")
    got = sorted((r.b, r.m, r.n, r.allowed) for r in limit_hits(rows, "b", ["at", "m"], 2).collect())
    assert got == [("a", 0, 1, True), ("a", 30, 2, True), ("a", 59, 3, False), ("a", 60, 1, True), ("a", 100, 2, True), ("a", 121, 1, True), ("b", 10, 1, True)]


def test_greedy_picks_match_a_plain_loop(spark):
    import random

    from tallyhouse.operators.ranking import spread

    rng = random.Random(1)
    rows = [(rng.choice("xy"), float(rng.randint(0, 9)), i, rng.randint(0, 6), rng.randint(0, 3)) for i in range(300)]
    got = {}
    for r in spread(spark.createDataFrame(rows, "g string, score double, id int, venue int, day int"), "g", ["score", "id"], "venue", "day", 6).collect():
        got.setdefault(r.g, []).append((r.pick, r.id))
    for g in "xy":
        venues, days, picks = set(), {}, []
        for _, s, i, v, d in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if len(picks) < 6 and v not in venues and days.get(d, 0) < 2:
                venues.add(v)
                days[d] = days.get(d, 0) + 1
                picks.append(i)
        assert [i for _, i in sorted(got[g])] == picks


def test_spans_and_islands(spark):
    from pyspark.sql import functions as F

    from tallyhouse.operators import spans

    days = spark.sql("SELECT 'k' AS k, date_add(date '2024-01-01', d) AS d FROM VALUES (0), (1), (1), (3), (10) AS t(d)")
    assert sorted((r.start_day.day, r.end_day.day, r.n_days) for r in spans.islands(days, ["k"], "d").collect()) == [(1, 2, 2), (4, 4, 1), (11, 11, 1)]
    covered = spark.sql("SELECT date '2024-01-01' AS a, date_add(date '2024-01-01', n) AS b FROM VALUES (13), (14), (-1) AS t(n)")
    assert sorted(r.n for r in covered.select(F.size(spans.covered_days(F.col("a"), F.col("b"))).alias("n")).collect()) == [1, 1, 14]


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from tallyhouse.functions import keys as K
    from tallyhouse.functions import text as X

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(X.title_key(F.lit("The Élan Versus Foo (21+) [FREE]"))) == "elan vs foo"
    tiers = {"Free": "Free", "": "$$", "free entry": "Free", "$0": "Free", "$15-$80": "$", "20.00": "$$", "$75": "$$$", "tbd": "$$", "0.00": "Free", None: "$$"}
    assert {p: value(X.price_tier(F.lit(p).cast("string"))) for p in tiers} == tiers
    assert value(K.slug(F.lit("The Hook & Ladder Theater (Mission Room)"))) == "hook-and-ladder-theater"
    assert value(K.area_city(F.lit("Saint Paul, MN"))) == "st paul" and value(K.area(F.lit("St. Paul"))) == "stpaul" and value(K.area(F.lit("Paris"))) == "other"
    assert value(X.key_part(F.lit("Škoda Ő ﬁne ½ ⁵ İ"))) == "skoda o fine 5 i" and value(K.venue_key(F.lit("The Armory!"))) == "armory"
    assert value(F.size(X.trigrams(F.lit("Αθήνα 東京")))) == 9
    assert value(X.csv_safe(F.lit("=1+1"))) == "'=1+1" and value(X.matches(F.lit("Fête à Paris"), "paris fete")) and value(X.matches(F.lit("x"), "  "))
    assert value(F.size(X.trigrams(F.lit("ab ab")))) == 3


def test_stream_counts_finished_days(spark, tmp_path):
    from tallyhouse.streaming import counters

    counters.run_counts(counters.read_events(spark, SF), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    want = spark.read.parquet(f"{SF}/events.parquet").selectExpr("date_trunc('day', convert_timezone('UTC', 'America/Chicago', ts)) AS day", "event_type").groupBy("day", "event_type").count()
    assert 0 < rows.count() < want.count()
    assert rows.selectExpr("to_date(day) AS d", "event_type", "n").exceptAll(want.selectExpr("to_date(day)", "event_type", "count")).count() == 0


def test_entry_works_without_the_training_text_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tallyhouse", tmp_path / "tallyhouse", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_reconcile_has_phantoms_and_unknown_rows(spark):
    from tallyhouse.operators import matching

    listed = spark.sql("SELECT * FROM VALUES (1, date '2024-01-02', 'a'), (2, date '2024-01-03', 'a'), (3, date '2023-12-01', 'a'), (5, date '2024-01-04', 'b') AS t(k, d, s)")
    feed = spark.sql("SELECT * FROM VALUES (1, date '2024-01-02', 'a'), (4, date '2024-01-05', 'a'), (5, date '2024-01-04', 'a'), (6, date '2024-01-01', 'a') AS t(k, d, s)")
    assert {r.k: r.verdict for r in matching.reconcile(listed, feed, "k", "d", "s").collect()} == {1: "ok", 2: "phantom", 3: "unknown", 4: "missing", 5: "changed", 6: "missing"}


def test_week_before_counts_missing_days_as_zero(spark):
    from tallyhouse.plans.engagement import week_before

    rows = spark.sql("SELECT date_add(date '2024-01-01', d) AS day, 'view' AS event_type, CAST(n AS BIGINT) AS n FROM VALUES (0, 4), (7, 6), (8, 3), (15, 3), (16, 1) AS t(d, n)")
    assert {r.day.day: r.label for r in week_before(rows).collect()} == {1: "first report", 8: "+50% WoW", 9: "new", 16: "±0%", 17: "new"}


def test_clock_changes(spark):
    from pyspark.sql import functions as F

    from tallyhouse.functions import spans

    walls = {"2026-11-01T01:30": "2026-11-01 06:30", "2026-11-01T02:30": "2026-11-01 08:30", "2026-03-08T01:59": "2026-03-08 07:59", "2026-03-08T03:00": "2026-03-08 08:00", "2026-07-01T00:10": "2026-07-01 05:10"}
    got = spark.createDataFrame([(w,) for w in walls], "w string").select("w", F.date_format(spans.instant(F.col("w")), "yyyy-MM-dd HH:mm").alias("u"), spans.iso(F.col("w")).alias("i")).collect()
    assert {r.w: r.u for r in got} == walls and {r.i[-6:] for r in got} == {"-05:00", "-06:00"}


def test_weekends_of_each_weekday(spark):
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    from tallyhouse.functions import spans

    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(14)]
    got = {r.d: r.w for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", spans.weekend_days(F.col("d")).alias("w")).collect()}
    assert got == {d: spans.weekend_of(d) for d in days}
    assert [len(got[d]) for d in days[:7]] == [3, 3, 3, 3, 3, 2, 1]


def plain_collapse(rows):
    """Clusters, folds and survivors in plain loops; rows: id, title, city, category, start, end (days as numbers)."""
    import re

    def key(r):
        t = re.sub(r"\([^)]*\)", " ", r[1].lower())
        return " ".join(re.findall("[a-z0-9]+", t)), r[2].lower()

    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    found = []
    for (title, city), list_ in groups.items():
        sports = any(r[3] == "sports" for r in list_)
        end = lambda r: r[4] if sports else max(r[4], r[5] if r[5] is not None else r[4])  # noqa: E731, B023
        for r in sorted(list_, key=lambda r: (r[4], end(r), r[0])):
            last = found[-1] if found else None
            if last and last["key"] == (title, city) and r[4] <= last["hi"] + (0 if sports else 1):
                last["rows"].append(r)
                last["hi"] = max(last["hi"], end(r))
            else:
                found.append({"key": (title, city), "sports": sports, "rows": [r], "lo": r[4], "hi": end(r), "id": r[0]})
    gone = {}
    for c in sorted(found, key=lambda c: (-len(c["key"][0]), c["id"])):
        options = []
        for p in found:
            a, b = sorted((c["key"][0], p["key"][0]), key=len)
            if p is not c and not c["sports"] and not p["sports"] and p["id"] not in gone and p["key"][1] == c["key"][1] and b.startswith(a + " ") and len(a.split()) > 1 and p["lo"] <= c["lo"] and p["hi"] >= c["hi"]:
                options.append((-(p["hi"] - p["lo"]), len(p["key"][0]), p["id"]))
        if options:
            gone[c["id"]] = min(options)[2]
    home = lambda i: gone.get(gone.get(i, i), gone.get(i, i))
    merged = {}
    for c in found:
        m = merged.setdefault(home(c["id"]), {"rows": [], "hi": c["hi"], "fold": False})
        m["rows"] += c["rows"]
        m["hi"] = max(m["hi"], c["hi"])
        m["fold"] |= c["id"] in gone
    out = []
    for m in merged.values():
        own = lambda r: max(r[4], r[5] if r[5] is not None else r[4])
        keep, *rest = sorted(m["rows"], key=lambda r: (r[4], -own(r), len(r[1]), r[0]))
        if rest:
            out.append(("fold" if m["fold"] else "run" if m["hi"] > keep[4] else "duplicate", keep[0], keep[4], m["hi"], m["hi"] if m["hi"] > keep[4] and own(keep) < m["hi"] else None, sorted(r[0] for r in rest)))
    return sorted(out)


def test_collapse_matches_a_plain_loop(spark):
    import random
    from datetime import date, timedelta

    from tallyhouse.operators import feeds

    rng, day = random.Random(3), date(2024, 1, 1)
    titles = ["winter fair", "winter fair ice", "winter fair ice carving", "Winter Fair (noon)", "winter fairground", "jazz", "jazz night"]
    rows = [(i, rng.choice(titles), rng.choice(["edina", "hugo"]), rng.choice(["arts", "arts", "arts", "music"]), rng.randint(0, 40), rng.choice([None, None, rng.randint(0, 60)])) for i in range(90)]
    rows += [(200 + i, "loons vs foo", "edina", "sports", i // 2, 30) for i in range(6)]
    frame = spark.createDataFrame([(i, t, c, k, day + timedelta(days=s), None if e is None else day + timedelta(days=e)) for i, t, c, k, s, e in rows], "id long, title string, city string, category string, start_day date, end_day date")
    number = lambda d: None if d is None else (d - day).days
    got = sorted((r.kind, r.keep_id, number(r.start_day), number(r.end_day), number(r.set_end), sorted(r.archive_ids)) for r in feeds.collapse_plan(frame).collect())
    assert got == plain_collapse(rows) and {r[0] for r in got} == {"run", "duplicate", "fold"}


def test_opponents_shows_and_lines(spark):
    from pyspark.sql import functions as F

    from tallyhouse.operators import feeds, outputs, reading

    value = lambda c: spark.range(1).select(c).first()[0]
    named = {("Twins vs. Red Sox", "Boston Red Sox"): True, ("Twins vs. Boston", "Boston Red Sox"): False, ("Twins v Sox", "Boston Red Sox"): False, ("Wild at Jets", "Winnipeg Jets"): False, ("Winnipeg at Wild", "Winnipeg Jets"): True, ("x", ""): False}
    assert {k: value(feeds.names_opponent(F.lit(k[0]), F.lit(k[1]))) for k in named} == named
    words = lambda t: feeds.show_words(F.lit(t))
    same = {("The Lumineers: Live", "An evening with Lumineers"): True, ("U2", "U2 tour"): False, ("Sigur Rós", "sigur ros 2024"): True, ("Night of Blues", "Blue Night"): False}
    assert {k: value(feeds.same_show(words(k[0]), words(k[1]), F.lit(""), F.lit(""))) for k in same} == same
    text = "DESCRIPTION:" + "é" * 100 + "東京" * 20 + "x" * 90
    folded = value(outputs.fold_line(F.lit(text)))
    lines = folded.split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and all(x[0] == " " for x in lines[1:]) and lines[0] + "".join(x[1:] for x in lines[1:]) == text
    assert value(outputs.calendar_text(F.lit("a;b,c\\d\ne"))) == "a\\;b\\,c\\\\d\\ne"
    assert [reading.resolve_feed(s, ["hall-7"], ["uptown"]) for s in ("this-weekend", "unique", "weird", "live-music", "venue-hall-7", "venue-x", "uptown", "nope")] == [("weekend", "this-weekend"), ("category", "weird"), None, ("collection", "live-music"), ("venue", "hall-7"), None, ("neighborhood", "uptown"), None]


def test_registry_operators(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyhouse.functions.titles import shown_title
    from tallyhouse.operators import registry

    value = lambda c: spark.range(1).select(c).first()[0]
    titles = {
        ("Jazz at Noon (First Avenue)", "First Avenue", ""): "Jazz at Noon",
        ("Big Show (21+) (July 5-7)", "", ""): "Big Show (21+)",
        ("Ballgame - Bobblehead Giveaway", "", ""): "Ballgame",
        ("Art — Now ", "", ""): "Art – Now",
        ("(Ongoing)", "", ""): "(Ongoing)",
        ("Loons vs. Foo (The Sequel)", "Allianz Field", "St. Paul"): "Loons vs. Foo (The Sequel)",
    }
    assert {k: value(shown_title(*map(F.lit, k))) for k in titles} == titles
    state = registry.read_address("?range=week&category=music,opera,arts&radius=7&q= jazz &x=1")
    assert state == {"range": ["week"], "category": ["music", "arts"], "q": ["jazz"]} and registry.read_address(registry.write_address(state)) == state
    now, made = [0.0], []
    kept = registry.Snapshots(spark, str(tmp_path / "kept"), 10, lambda: now[0])
    read = lambda: kept.get("n", lambda: made.append(1) or spark.range(len(made)), ("listings",)).count()
    assert [read(), read()] == [1, 1]
    now[0] = 11
    assert read() == 2
    kept.drop("listings")
    assert read() == 3 and registry.sample_listings(spark).count() == 3
