"""Operators against plain loops on random rows, and what happens when things fail half way."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tallyhouse.sources.shared import shared_folder


def plain_scores(title, text, venue):
    """The rules, one expression a signal and field."""
    from tallyhouse.operators import categories as C

    t, x, v = title.lower(), text.lower(), venue.lower()
    hit = lambda p, s: re.search(rf"(?a)\b(?:{p})\b", s) is not None
    arts = hit(C.ARTS_VENUE, v)
    out = {}
    for name in C.CATEGORIES:
        n = 0
        for p, w in C.SIGNALS[name]:
            n += 2 * w * hit(p, t) + w * hit(p, x)
            if not (arts and name in C.DAMPED):
                n += math.floor(w / 2 + 0.5) * hit(p, v)
        if arts and name in C.DAMPED:
            n = math.floor(n * 0.25 + 0.5)
        if arts and name == "arts" and not hit(C.FAMILY_TITLE, t):
            n += C.ARTS_FLOOR
        n += sum(w * hit(p, v) for c, p, w in C.HINTS if c == name) + sum(w * hit(p, f"{t} {v} {x}") for c, p, w in C.PLACES if c == name)
        out[name] = n
    return out


def test_categories_are_those_of_single_expressions(spark):
    from tallyhouse.operators import categories as C

    rng = random.Random(1)
    words = [w for s in C.SIGNALS.values() for p, _ in s for w in re.split(r"[|()?*\\]|\[- \]|\.\*", p) if w.strip(" bsw+")] + ["country", "club", "party", "fairly", "Café", "7th", "st", "beer", "hall", "x@y", "@", "vs.", "children's", "R&B", "hip-hop", "hip hop", "hiphop", "walker", "art", "center", "é", "_art_", "eating", "contest"]
    signs = [" ", " ", " ", "  ", "-", "'", ", ", "\n", "/", ""]
    some = lambda n: "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randint(0, n)))
    rows = [(i, some(5), some(12), some(3), rng.choice(["music", "other", None])) for i in range(1500)]
    got = C.with_scores(spark.createDataFrame(rows, "id int, title string, text string, venue string, own string"), "title", "text", "venue").select("id", "scores").collect()
    assert {r.id: list(r.scores) for r in got} == {i: list(plain_scores(t, x, v).values()) for i, t, x, v, _ in rows}
    nothing = spark.createDataFrame([(1, None, None, None, "food"), (2, "qq", "", "", "none"), (3, "qq", "", "", None)], "id int, title string, text string, venue string, own string")
    assert {r.id: (r.chosen, r.confidence) for r in C.with_category(nothing, "title", "text", "venue", "own").collect()} == {1: ("food", 0), 2: ("festival", 0), 3: ("festival", 0)}


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("metres", [200.0, 50_000.0, 3_000_000.0])
def test_points_within_reach_share_a_cell(spark, metres):
    from pyspark.sql import functions as F

    from tallyhouse.operators import grid

    rng = random.Random(int(metres))
    points = []
    for _ in range(60):
        lat, lng = rng.choice([0.0, 44.9, -67.0, 89.5, -89.99, 80.0, 10.0]) + rng.uniform(-0.4, 0.4), rng.choice([-93.2, 179.9, -179.95, 0.0]) + rng.uniform(-0.2, 0.2)
        lat = max(-90.0, min(90.0, lat))
        for _ in range(4):
            d, turn = rng.uniform(0, 1.3) * metres / 111_000, rng.uniform(0, 6.3)
            y = max(-90.0, min(90.0, lat + d * math.sin(turn)))
            x = lng + d * math.cos(turn) / max(0.01, math.cos(math.radians(y)))
            points.append((y, (x + 180) % 360 - 180))
    rows = list(enumerate(points))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in rows], "i int, lat double, lng double")
    near = df.select("i", grid.cell(F.col("lat"), F.col("lng"), metres).alias("c")).alias("x").join(df.select("i", F.explode(grid.cells_around(F.col("lat"), F.col("lng"), metres)).alias("c")).alias("y"), F.col("x.c") == F.col("y.c"))
    met = {(r[0], r[1]) for r in near.select("x.i", "y.i").collect()}
    want = {(i, j) for i, a in rows for j, b in rows if km(a, b) * 1000 <= metres}
    assert want <= met
    assert len(near.collect()) == len(met)  # no pair twice
    assert df.limit(1).select(F.size(grid.cells_around(F.lit(None).cast("double"), F.col("lng"), metres))).first()[0] in (0, -1)


def test_nearest_on_a_grid_is_nearest_of_all(spark, monkeypatch):
    from tallyhouse.operators import matching

    rng = random.Random(3)
    points = [(i, rng.uniform(44, 46), rng.uniform(-94, -92)) for i in range(300)] + [(300, None, -93.0), (301, 89.9, 10.0), (302, float("nan"), 1.0)]
    centres = [(i, f"c{i}", rng.uniform(44, 46), rng.uniform(-94, -92), rng.choice([0.0, 0.5, 3.0, 20.0, 150.0])) for i in range(80)] + [(80, "pole", 90.0, 0.0, 500.0), (81, "c0 again", 45.0, -93.0, 20.0), (82, "c0 twice", 45.0, -93.0, 20.0)]
    p, c = spark.createDataFrame(points, "id int, lat double, lng double"), spark.createDataFrame(centres, "position int, centre string, lat double, lng double, radius_km double")
    want = {}
    for i, lat, lng in points:
        inside = [] if lat is None or math.isnan(lat) else [(d, k, n) for k, n, a, b, r in centres if (d := km((lat, lng), (a, b))) <= r]
        want[i] = min(inside)[2] if inside else None
    listed = {r.id: r.centre for r in matching.nearest(p.where("NOT isnan(lat)"), c, "id").collect()}
    monkeypatch.setattr(matching, "MOST_CENTRES", 5)
    assert {r.id: r.centre for r in matching.nearest(p, c, "id").collect()} == want
    assert listed == {i: x for i, x in want.items() if i != 302}


def test_rows_are_linked_to_equal_and_similar_titles(spark):
    from tallyhouse.operators import matching

    titles = ["Jazz Night", "jazz night", "Jazz Nights", "Jazz Night", "Other", "", "", None, "Jazz Night at the Park"]
    rows = [(i, 1 + i // 8, t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id int, day int, title string")
    got = {r.id: (r.class_id, r.copies, r.links) for r in matching.linked(df, ["day"], ["id"], "title", 0.6).collect()}
    assert got == {0: (0, 3, 3), 1: (0, 3, 3), 2: (2, 1, 3), 3: (0, 3, 3), 4: (4, 1, 0), 5: (5, 2, 0), 6: (5, 2, 0), 7: (7, 1, 0), 8: (8, 1, 0)}
    pairs = [(r.keep_id, r.dup_id) for r in matching.review_pairs(df, ["day"], ["id"], "day", "title", 0.6, 5).collect()]
    assert pairs == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def test_a_failure_between_two_tables_leaves_the_old_version(spark, monkeypatch):
    from tallyhouse.operators.versions import Conflict, Tables

    tables = Tables(spark, shared_folder(spark, "test"))
    one = lambda n: spark.range(n)
    assert tables.read("a") is None
    base = tables.commit({"a": one(1), "b": one(1)})
    broken = spark.range(3).selectExpr("id", "raise_error('half way') AS x")
    with pytest.raises(Exception, match="half way"):
        tables.commit({"a": one(2), "b": broken})
    assert (tables.read("a").count(), tables.read("b").count(), tables.current().number) == (1, 1, 1)
    tables.commit({"a": one(5)})
    assert (tables.read("a").count(), tables.read("b").count(), tables.read("a", base).count()) == (5, 1, 1)
    with pytest.raises(Conflict):
        tables.commit({"a": one(7)}, base)
    assert tables.commit({"a": one(9)}, writer="w", tag=4).number == 3
    assert tables.commit({"a": one(10)}, writer="w", tag=4).number == 3  # a replay
    assert tables.read("a").count() == 9
    assert tables.sweep(1) == 5
    assert (tables.read("a").count(), tables.read("b").count()) == (9, 1)


def test_counters_ignore_a_replayed_batch(spark):
    from tallyhouse.operators.versions import Tables
    from tallyhouse.streaming.counters import count_into

    tables = Tables(spark, shared_folder(spark, "test"))
    add = count_into(tables)
    batch = spark.sql("SELECT 1L AS user_id, 'view' AS event_type, timestamp'2024-01-01 12:00' AS ts UNION ALL SELECT 1, 'view', timestamp'2024-01-01 13:00'")
    for number in (0, 0, 1, 0, 1):
        add(batch, number)
    assert [(r.user_id, str(r.day), r.n) for r in tables.read("counters").collect()] == [(1, "2024-01-01", 4)]


def test_the_live_limiter_goes_on_after_a_restart(spark):
    from tallyhouse.streaming.limiter import STORE, run_limiter

    top = shared_folder(spark, "test")
    rows = lambda hits: spark.createDataFrame([(b, i) for b, i in hits], "bucket string, id bigint").selectExpr("bucket", "id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id)) AS ts")
    before = spark.conf.get(STORE)
    for hits in ([("a", 0), ("a", 10), ("b", 5)], [("a", 20), ("a", 60), ("b", 70)], [("a", 61), ("a", 130)]):
        rows(hits).coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema("bucket string, id bigint, ts timestamp").parquet(f"{top}/in")
        run_limiter(spark, stream, f"{top}/out", f"{top}/checkpoint", 2)
    got = sorted((r.bucket, r.id, r.n, r.allowed) for r in spark.read.parquet(f"{top}/out").collect())
    assert got == [("a", 0, 1, True), ("a", 10, 2, True), ("a", 20, 3, False), ("a", 60, 1, True), ("a", 61, 2, True), ("a", 130, 1, True), ("b", 5, 1, True), ("b", 70, 1, True)]
    assert spark.conf.get(STORE) == before


def test_feeds_with_bad_bodies_and_placeholders(spark):
    from tallyhouse.sources import feed_bodies

    dates = '{"dates":[{"date":"2026-04-03","games":[{"gameDate":"2026-04-03T23:10:00Z","gameType":"R","status":{"startTimeTBD":false},"teams":{"home":{"team":{"id":1,"name":"We"}},"away":{"team":{"id":2,"name":"They"}}}},{"gameDate":"2026-04-04T08:33:00Z","gameType":"S","teams":{"home":{"team":{"id":3,"name":"Them"}},"away":{"team":{"id":1,"name":"We"}}}},{"gameDate":"x","teams":{}}]}]}'
    events = '{"events":[{"date":"2026-10-03T04:00Z","competitions":[{"timeValid":false,"competitors":[{"homeAway":"home","team":{"displayName":"We"}},{"homeAway":"away","team":{"displayName":"Michigan"}}]}]}]}'
    rows = [("a", 1, "dates", "1", dates), ("a", 2, "dates", "1", dates), ("b", 1, "events", "We", events), ("c", 1, "events", "We", events), ("c", 2, "events", "We", "oops"), ("d", 1, "games", "X", None)]
    df = spark.createDataFrame(rows, "team string, seq int, shape string, who string, body string")
    got = sorted(tuple(r) for r in feed_bodies.schedules(df).collect())
    assert got == [("a", "2026-04-03", "2026-04-03T00:00", "Them", False, True, True), ("a", "2026-04-03", "2026-04-03T18:10", "They", True, False, False), ("b", "2026-10-03", "2026-10-03T00:00", "Michigan", True, False, True)]
    assert sorted((r.team, r.seq) for r in feed_bodies.bad_replies(df).collect()) == [("c", 2), ("d", 1)]


def test_month_pages(spark):
    from tallyhouse.sources import feed_bodies

    show = lambda title, venue="Main Room": f'<div class="show_list_item" id=x>\n<div class="venue_name"> {venue} </div><h4 class=y>\n<a href="/s/{len(title)}">{title}</a></h4><div class="venue_name">Second copy</div></div>'
    page = show("too early") + '<div id="day-2026-8-1">' + show("<em>X presents</em><br/>Rude &amp; Loud") + '<div class="show_list_item"><h4><a href="u">no venue</a></h4></div>' + '<div id="day-2026-08-12">' + show("Late<br>") + show(" ")
    got = [(str(r.day), r.venue, r.title) for r in feed_bodies.calendar_shows(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")).orderBy("pos").collect()]
    assert got == [("2026-08-01", "Main Room", "Rude & Loud"), ("2026-08-12", "Main Room", "Late")]


def test_documents_are_whole_or_absent(spark):
    from pyspark.sql import functions as F

    from tallyhouse.sources import documents as D

    path = shared_folder(spark, "test")
    entries = spark.createDataFrame([("a.txt", "y", 2), ("a.txt", "x", 1), ("b/c.txt", "é", 1), ("none.txt", None, 1)], "document string, text string, pos int")
    frames = spark.createDataFrame([(d, "<", ">") for d in ("a.txt", "b/c.txt", "empty.txt", "none.txt")], "document string, head string, foot string")
    D.write_documents(entries, frames, ["pos"], path, ",")
    read = lambda: {r.document: r.text for r in D.read_documents(spark, path).collect()}
    assert read() == {"a.txt": "<x,y>", "b/c.txt": "<é>", "empty.txt": "<>", "none.txt": "<>"}
    with pytest.raises(Exception, match="broken"):
        D.write_documents(entries.withColumn("text", F.when(F.col("pos") == 2, F.raise_error(F.lit("broken"))).otherwise("new")), frames, ["pos"], path, ",")
    assert read()["a.txt"] == "<x,y>"
    D.write_documents(entries.limit(0), frames.limit(1), ["pos"], path)
    assert read() == {"a.txt": "<>"}


def test_long_documents_are_packed_and_checked_in_blocks(spark, tmp_path):
    from tallyhouse.sources import documents as D

    entries = spark.range(30_000).selectExpr("if(id % 3 = 0, 'b', 'a') AS document", "repeat(concat(id, 'x'), 40) AS text", "id AS pos")
    frames = spark.createDataFrame([("a", "<", ">"), ("b", "", ""), ("c", "", "")], "document string, head string, foot string")
    D.write_documents(entries, frames, ["pos"], f"{tmp_path}/long", ",", 1 << 20)
    want = {d: f"{h}{','.join(f'{i}x' * 40 for i in range(30_000) if (i % 3 == 0) == (d == 'b') and d != 'c')}{f}".encode() for d, h, f in (("a", "<", ">"), ("b", "", ""), ("c", "", ""))}
    got = {r.document: (r.bytes, r.sha256) for r in D.check_documents(spark, f"{tmp_path}/long").collect()}
    assert got == {d: (len(x), hashlib.sha256(x).hexdigest()) for d, x in want.items()}
    with open(f"{tmp_path}/long/a", "r+b") as f:
        f.seek(3_000_000)
        f.write(b"?")
    with pytest.raises(Exception, match="damaged or missing: a"):
        D.check_documents(spark, f"{tmp_path}/long").collect()


def test_site_maps_are_split(spark):
    from tallyhouse.sources import documents as D

    path = shared_folder(spark, "test")
    D.site_map_documents(spark.range(500).selectExpr("concat('/p/', id, '?a&b') AS path"), "https://x.example", "2024-01-01", path, 100)
    docs = {r.document: r.text for r in D.read_documents(spark, path).collect()}
    assert len(docs) == 11
    found = [x for n, t in docs.items() if n != "sitemap.xml" for x in re.findall("<loc>(.*?)</loc>", t)]
    assert sorted(found) == sorted(f"https://x.example/p/{i}?a&amp;b" for i in range(500))
    assert max(t.count("<url>") for t in docs.values()) <= 100
    assert set(re.findall(r"<loc>https://x.example/(.*?)</loc>", docs["sitemap.xml"])) == set(docs) - {"sitemap.xml"}


def test_change_feeds_on_random_snapshots(spark):
    from tallyhouse.operators import changes

    rng = random.Random(7)
    snap = lambda: {i: (i, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for i in rng.sample(range(60), 40)}
    old, new = snap(), snap()
    before, after = (spark.createDataFrame(list(x.values()), "id int, s string, n int") for x in (old, new))
    feed = changes.difference(before, after, "id")
    kinds = Counter(r.kind for r in feed.collect())
    assert kinds == Counter({"insert": len(new.keys() - old.keys()), "delete": len(old.keys() - new.keys()), "update": sum(old[k] != new[k] for k in old.keys() & new.keys())})
    there = changes.applied(before, feed, "id")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(there) == sorted(new.values())
    assert rows(changes.applied(there, changes.turned(feed, "id"), "id")) == sorted(old.values())
    assert changes.difference(before, before, "id").count() == 0


def test_runs_that_are_killed_failed_and_repeated(spark):
    from tallyhouse.operators.runlog import RunLog

    times = iter(range(100, 1000))
    log = RunLog(spark, shared_folder(spark, "test"), lambda: float(next(times)))
    log.open("r")  # killed: no final entry
    with pytest.raises(ValueError):
        log.run("r", lambda: 1 / 0 if False else (_ for _ in ()).throw(ValueError("no")))
    assert log.run("r", lambda: {"n": 3}) == "done"
    assert log.run("r", lambda: pytest.fail("it was done")) == "already"
    assert log.close("r", 3, False) is False  # a final entry is final
    got = sorted((r.run, r.attempt, r.finished is None, r.ok, r.counts, r.error) for r in log.table().collect())
    assert got == [("r", 1, True, False, None, None), ("r", 2, False, False, {}, "ValueError: no"), ("r", 3, False, True, {"n": 3}, None)]
    started = sorted(r.started for r in log.table().collect())
    assert all(a < b for a, b in pairwise(started))
    assert RunLog(None, "nowhere").done("r") is True  # unsure


def plain_shown(title, venue, city):
    """The rule by hand, over tokens."""
    from tallyhouse.functions import titles as T

    def telling(s):
        return {w for w in re.split("[^a-z0-9]+", s.lower()) if len(w) > 2 and w not in T.SILENT}

    def schedule(s):
        w = s.lower().split()
        if not w:
            return False
        rest = " ".join(w[1:])
        days = re.fullmatch(r"\d{1,2}( ?[–—-] ?\d{1,2})?", rest) is not None
        if w[0] in T.REPEATS and len(w) == 2 and re.fullmatch(r"[A-Za-z0-9_]+", w[1]):
            return True
        if w[0] in T.WEEKDAYS and len(w) == 1 or w[0].removesuffix(".") in T.MONTHS and days or w[0] in T.MONTHS and rest == "run":
            return True
        return w[0] in T.BOUNDS and len(w) > 1 or w[0] == "ongoing" or re.match(r"\d{4}( ?[–—-] ?\d{4})? season", " ".join(w)) is not None

    def idle(inner):
        own = telling(inner)
        return schedule(inner) or inner.strip().lower() in T.FORMS or bool(own) and len(own & (telling(venue) | telling(city))) / len(own) >= 0.6

    whole = title.strip(" ")
    kept, at = "", 0
    for m in re.finditer(r"\s*\(([^()]*)\)", whole):
        kept += whole[at : m.start()] + ("" if idle(m[1]) else m[0])
        at = m.end()
    kept += whole[at:]
    if m := re.search(r"\s+[–—-]\s+([^–—-]+)$", kept):
        tail = m[1].strip(" ")
        if schedule(tail) or any(re.search(rf"(?a)\b{p}\b", tail.lower()) for p in T.PROMOTIONS):
            kept = kept[: m.start()].strip(" ")
    shown = re.sub(r"\s{2,}", " ", " – ".join(re.split(r"\s+[—-]\s+", kept))).rstrip(" –—:,-").lstrip(" ")
    return whole if len(shown) < 4 else shown


def test_shown_titles_on_random_strings(spark):
    from pyspark.sql import functions as F

    from tallyhouse.functions.titles import shown_title

    rng = random.Random(11)
    inner = ["Ongoing", "every friday", "Every Friday Night", "July 5-7", "sept. 3", "Sept run", "through Sep 22", "21+", "Matinee", "film screening", "The Armory", "at the Armory", "2026 season opener", "2025-2026 Season", "opens", "World Premiere", "tuesdays", "weekly x-y", ""]
    words = ["Jazz", "Night", "–", "-", "—", "A-B", "Armory", "fest:", "The", "Bobblehead", "presented by Us", "daily show", "Weekend 1", "Opening Day", ","]
    piece = lambda: rng.choice(words) if rng.random() < 0.7 else f"({rng.choice(inner)})"
    rows = [(i, rng.choice(["", " "]) + "".join(piece() + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randint(0, 7))), rng.choice(["The Armory", "", "Hall"]), rng.choice(["", "St. Paul"])) for i in range(3000)]
    got = spark.createDataFrame(rows, "i int, t string, v string, c string").select("i", shown_title(F.col("t"), F.col("v"), F.col("c")).alias("s")).collect()
    want = {i: plain_shown(t, v, c) for i, t, v, c in rows}
    assert {r.i: r.s for r in got} == want
    assert sum(want[i] != t.strip(" ") for i, t, *_ in rows) > 1000


def plain_run_title(title):
    """The rule by hand."""
    from tallyhouse.functions import titles as T

    t = re.sub(r"(?a)\b(19|20)\d\d\b", " ", title.lower())
    for unit, kind in (("weekend", r"\s*\d+"), ("weekend", r"\s+[ivx]+"), ("day", r"\s*\d+")):
        t = re.sub(rf"(?a)\b{unit}{kind}\b", " ", t)
    for e in T.EDITIONS:
        t = re.sub(rf"(?a)\b{e}\s+edition\b", " ", t)
    while (a := t.find("(")) >= 0 and (b := t.find(")", a)) >= 0:
        t = t[:a] + " " + t[b + 1 :]
    endings = [f"{w} {k}" for w in ("", *T.WEEKENDS) for k in ("weekend", "weekends", "weekend only", "weekends only")]
    for options in (endings, T.ENDINGS):
        parts = re.split("([–—-])", t)
        for k in range(1, len(parts), 2):
            if "".join(parts[k + 1 :]).split() in [o.split() for o in options]:
                t = "".join(parts[:k]).rstrip() + " "
                break
    t = re.sub(r"[–—-]+\s*$", " ", t)
    return " ".join(re.sub("[^a-z0-9]+", " ", re.sub("['’`‘]", "", t)).split())


def test_run_titles_on_random_strings(spark):
    from pyspark.sql import functions as F

    from tallyhouse.functions.titles import run_title

    rng = random.Random(12)
    words = ["Sever's", "Fall", "Fest", "2026", "1899", "Weekend 2", "weekend IV", "Weekend2026", "Day 3", "Day", "Second Edition", "3rd edition", "(all ages)", "(", ")", "– Opening Weekend", "— final weekends", "- weekends only", "– last week", "- Labor Day Weekend", "—", "Café", "weekend"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for i in range(3000)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", run_title(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_run_title(t) for i, t in rows}


def test_lists_of_readers_exclude_each_other(spark):
    from pyspark.sql import functions as F

    from tallyhouse.operators import curation

    rng = random.Random(21)
    rows = [(i, rng.choice("abc"), rng.choice(["family", "weird", "music", "arts"]), rng.choice(["", " Hall", "hall", "Club", "Park"]), f"2026-01-{rng.randint(1, 5):02d}T{rng.randint(8, 20):02d}:00", rng.randint(0, 3), f"t{rng.randint(0, 3)}") for i in range(200)]
    pool = spark.createDataFrame(rows, "id int, reader string, category string, venue string, start string, score int, title string")
    pool = pool.withColumn("order", F.struct((-F.col("score")).alias("s"), "start", "title", "id")).withColumn("start_day", F.to_date(F.left("start", F.lit(10))))
    lists = curation.week_lists(pool, "reader", 4)
    got = sorted((r.reader, r.list, r.pos, r.id) for r in lists.collect())
    digest = sorted((r.reader, r.pos, r.id) for r in curation.digest_list(lists, "reader", 5).collect())
    want, want_digest = [], []
    for reader in "abc":
        own = sorted((r for r in rows if r[1] == reader), key=lambda r: (-r[5], r[4], r[6], r[0]))
        order, taken = [], set()
        for category, name in (("family", "family"), ("weird", "unique")):
            if first := next((r for r in own if r[2] == category), None):
                order.append((name, 1, first))
                taken.add(first[0])
        venues, days, n = set(), Counter(), 0
        for r in own:
            v, d = r[3].strip().lower(), r[4][:10]
            if n == 4 or r[0] in taken or v and v in venues or days[d] == 2:
                continue
            n += 1
            venues.add(v)
            days[d] += 1
            order.append(("regular", n, r))
        want += [(reader, name, pos, r[0]) for name, pos, r in order]
        place = {"family": 1, "unique": 2, "regular": 3}
        few = sorted(order[:5], key=lambda x: (x[2][4], place[x[0]], x[2][0]))
        want_digest += [(reader, k, r[0]) for k, (_, _, r) in enumerate(few, 1)]
    assert got == sorted(want)
    assert digest == sorted(want_digest)


def test_official_links(spark):
    from tallyhouse.operators import links

    registry = spark.createDataFrame([("tickets.example",), ("co.uk",)], "host string")
    cases = [
        ("https://tickets.example/1", "https://www.AllianzField.com/x", "Allianz Field", ("https://www.AllianzField.com/x", "official", "https://tickets.example/1")),
        ("https://allianzfield.com/buy", "https://allianzfield.com/x", "Allianz Field", ("https://allianzfield.com/buy", "tickets", None)),
        ("", "https://allianzfield.com/x", "Allianz Field", ("https://allianzfield.com/x", "official", None)),
        ("", "https://allianz.tickets.example/x", "Allianz Field", (None, None, None)),
        ("", "https://field.com/x", "The Field Park", (None, None, None)),
        (None, None, None, (None, None, None)),
        (" https://other.example ", "no address", "Allianz", ("https://other.example", "tickets", None)),
        ("", "https://notickets.example/allianz", "Allianz", (None, None, None)),
        ("https://a.b.co.uk/1", "https://b.co.uk/", "Bbbb Hall", ("https://a.b.co.uk/1", "tickets", None)),
    ]
    rows = spark.createDataFrame([(i, t, s, v) for i, (t, s, v, _) in enumerate(cases)], "id int, ticket string, source string, venue string")
    got = {r.id: (r.primary, r.kind, r.secondary) for r in links.official_links(rows, registry).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_titles_of_one_show_are_those_of_all_pairs(spark):
    from pyspark.sql import functions as F

    from tallyhouse.operators import feeds

    rng = random.Random(22)
    words = ["jazz", "blues", "loud", "quiet", "river", "stone", "king", "foo", "ab", "the", "live", "rowdy", "Ørsted"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    side = lambda n: feeds._shown(spark.createDataFrame([(title(), "r") for _ in range(n)], "title string, venue string")).select(F.concat_ws("|", "whole", F.array_join("words", " ")).alias("key"), "whole", "words").distinct()
    left, right = side(120), side(120)
    a, b = [tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()]

    def same(x, y):
        shared = set(x[2]) & set(y[2])
        n = min(len(x[2]), len(y[2]))
        return x[1] != "" and x[1] == y[1] or n > 0 and len(shared) / n >= feeds.SHARE and any(len(w) >= feeds.WORD for w in shared)

    met = feeds.same_titles(left, right).collect()
    assert {(r.l, r.r) for r in met} == {(x[0], y[0]) for x in a for y in b if same(x, y)}
    assert len(met) == len(set(met))


def test_the_report_without_runs_or_with_trouble(spark):
    from tallyhouse.operators import report

    floors = {"music": 6, "arts": 2}
    base = "0L AS view7, 0L AS view_before, 5L AS ticket_click7, 0L AS ticket_click_before, 3L AS save7, 2L AS save_before, 1L AS calendar7, 1L AS calendar_before, 9L AS top_viewed, 0L AS trending, 10L AS urls, 8L AS urls_before, 3L AS subscribed, 1L AS subscribed7"
    run = "named_struct('started', {0}, 'seconds', {1}, 'ok', {2}, 'error', {3}, 'upserted', 5, 'collapsed', {4}, 'collapsed_runs', 1, 'archived', 7)"
    kind = "array<struct<started: int, seconds: int, ok: boolean, error: string, upserted: int, collapsed: int, collapsed_runs: int, archived: int>>"

    def lines(runs, more):
        facts = spark.sql(f"SELECT cast(array({', '.join(runs)}) AS {kind}) AS runs, {base}, 6L AS week_music, 1L AS week_arts, 2L AS verified7, 0L AS never_verified, {more}")
        return {r.section: (r.lines, r.alert) for r in report.sections(facts, floors).collect()}

    none = lines([], "cast(null AS int) AS digest_age, cast(array() AS array<struct<n: bigint, slug: string>>) AS feeds, 0L AS submissions, 0L AS reports, cast(null AS int) AS oldest_report")
    assert none["pipeline"] == ("no runs recorded yet", True)
    assert none["coverage"] == ("arts 1/2", True)
    assert none["engagement"][0].startswith("view 0 (±0%), ticket_click 5 (new)\nsave 3 (+50% WoW), calendar 1 (±0%)")
    assert none["subscribers"] == ("3 subscribed (+1 in 7 days)\nno digest sent yet", False)
    assert none["queue"] == ("nothing waiting", False) and none["feeds"][1] is False and len(none) == 9
    some = "9 AS digest_age, array(named_struct('n', 2L, 'slug', 'a')) AS feeds, 1L AS submissions, 2L AS reports, 4 AS oldest_report"
    killed = lines([run.format(3, "cast(null AS int)", "false", "null", 5), run.format(2, 10, "true", "null", 5)], some)
    assert killed["pipeline"] == ("the last run was killed or is not complete", True)
    assert killed["queue"] == ("1 submission waiting\n2 reports waiting\nthe oldest report is 4 days old", True)
    assert killed["subscribers"][1] and killed["feeds"][0] == "2 subscriptions in 7 days\na: 2"
    spiked = lines([run.format(3, 70, "true", "null", 90), run.format(2, 10, "true", "null", 20), run.format(1, 9, "false", "'x'", 400)], some)
    assert spiked["pipeline"] == ("ok: 5 upserted (±0), 90 deduped (+70), 1 collapsed (±0), 7 archived (±0)\ntook 1m 10s\nstampede check: far more was archived or deduped than in recent runs", True)
    failed = lines([run.format(3, 70, "false", "'boom'", 1)], some)
    assert failed["pipeline"] == ("the last run failed: boom", True)


def test_saves_of_recipients_are_not_shuffled_once_they_are_paired(spark):
    from tallyhouse.operators.desk import saves_of_recipients

    recipients = spark.sql("SELECT id AS recipient, IF(id % 4 > 0, id % 3, NULL) AS token FROM range(40)")
    saved = spark.sql("SELECT id % 5 AS token, id % 11 AS id FROM range(200)")
    rows = spark.sql("SELECT id, concat('at ', id) AS start FROM range(9)")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = saves_of_recipients(recipients, saved, rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        result = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = next(line for line in plan.splitlines() if "Join" in line or "Exchange" in line)
    assert "Join" in first and "token" in first
    assert result == sorted((r, i, f"at {i}") for r in range(40) if r % 4 for i in range(9) if any(k % 5 == r % 3 and k % 11 == i for k in range(200)))


def _trigrams(text):
    import re

    return {f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", text.lower()) if w for i in range(len(w) + 1)}


def _similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("blocks, titles", [(3, 500), (40, 12)])
def test_links_match_a_plain_loop_whether_texts_come_back_in_many_blocks_or_not(spark, blocks, titles):
    import random

    from tallyhouse.operators import matching

    rng = random.Random(blocks)
    words = "ann bob jazz rock night show fest the of cat cats dog dogs owl".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(titles)] + ["", "!!"]
    rows = [(i, rng.choice([None, *range(blocks - 1)]), rng.choice(texts), rng.randint(0, 9)) for i in range(420)]
    frame = spark.createDataFrame(rows, "id int, day int, title string, at int")
    classes = matching.text_classes(frame, ["day"], ["id"], "title")
    assert (matching.near_texts(classes, ["day"], 0.4) is None) == (blocks == 3)
    near = {(a, b): _similarity(_trigrams(a), _trigrams(b)) for a in texts for b in texts}
    links = {i: sum(j != i and e == d and near[t, u] > 0.4 for j, e, u, _ in rows) for i, d, t, _ in rows}
    assert {r.id: r.links for r in matching.linked(frame, ["day"], ["id"], "title", 0.4).collect()} == links
    pairs = sorted((x, i, j, round(near[t, u], 6)) for i, d, t, x in rows for j, e, u, _ in rows if i < j and d == e and near[t, u] > 0.4)
    got = matching.review_pairs(frame, ["day"], ["id"], "at", "title", 0.4, 50).collect()
    assert [(r.keep_id, r.dup_id, round(r.similarity, 6)) for r in got] == [p[1:] for p in pairs[:50]]


@pytest.mark.parametrize("crowd", [0, 1000])
def test_near_listings_on_large_cells_match_a_plain_loop(spark, monkeypatch, crowd):
    import math
    import random

    from tallyhouse.operators import matching

    monkeypatch.setattr(matching, "CROWD", crowd)
    rng = random.Random(5)
    words = "ann bob jazz rock night show".split()
    # around borders of cells, the pole and the date line
    spots = [(la + rng.uniform(-0.004, 0.004), ln + rng.uniform(-0.004, 0.004)) for la, ln in [(45.0, -93.0), (0.0, 180.0), (0.0, -180.0), (44.98, -93.02), (89.9999, 10.0)] for _ in range(12)]
    spots = [(min(la, 90.0), ln) for la, ln in spots] + [(None, None)]
    rows = [(i, rng.randint(0, 1), " ".join(rng.choices(words, k=2)), *rng.choice(spots), rng.randint(0, 5)) for i in range(240)]

    def metres(a, b):
        (p, x), (q, y) = ((math.radians(v) for v in s) for s in (a, b))
        return 6371000.0 * math.acos(max(-1.0, min(1.0, math.cos(p) * math.cos(q) * math.cos(y - x) + math.sin(p) * math.sin(q))))

    pairs = set()
    for i, d, t, *at, c in rows:
        for j, e, u, *to, k in rows:
            if d == e and (c, i) < (k, j) and None not in (*at, *to) and _similarity(_trigrams(t), _trigrams(u)) > 0.6 and metres(at, to) < 250:
                pairs.add((i, j))
    dups = {j for _, j in pairs}
    frame = spark.createDataFrame(rows, "id int, start_day int, title string, lat double, lng double, created_day int")
    got = [(r.keep_id, r.dup_id) for r in matching.near_listings(frame, 0.6, 250.0).collect()]
    assert len(got) == len(set(got)) > 20
    assert set(got) == {p for p in pairs if p[0] not in dups}


def test_verdicts_and_kept_saves_stay_dealt_to_many_tasks(spark):
    from tallyhouse.operators import desk

    replies = spark.sql("""SELECT concat('[{"id": "', id, '"}]') AS reply FROM range(400)""")
    verdicts = desk.replied_verdicts(replies, spark.sql("SELECT CAST(id AS STRING) AS id FROM range(200)"))
    saved = spark.sql("SELECT id % 7 AS token, id, date '2024-01-01' AS since FROM range(400)")
    people = spark.sql("SELECT 'a' AS email, 'subscribed' AS status, 3L AS token")
    kept, _ = desk.keep_links(saved, people, spark.sql("SELECT 'a' AS email, 99L AS token"))
    for rows, n in ((verdicts, 200), (kept, 400 + 57)):
        got = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(got) == 4 and sum(r["count"] for r in got) == n


def test_shared_lists_are_written_in_little_room_by_many_tasks(spark, tmp_path):
    from tallyhouse.operators.desk import saves_of_recipients

    recipients = spark.sql("SELECT IF(id = 7, NULL, id * 13) AS recipient, IF(id < 5000, 1L, id % 4) AS token FROM range(5040)")
    saved = spark.sql("SELECT 1L AS token, id FROM range(40) UNION ALL SELECT 2L, id FROM range(40000) UNION ALL SELECT NULL, 1L UNION ALL SELECT 3L, NULL")
    rows = spark.sql("SELECT id, IF(id = 5, NULL, concat('2024-01-01T', id)) AS start FROM range(39999)")
    got = saves_of_recipients(recipients, saved, rows)
    got.write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert 1 < len(files) <= 4
    out = spark.read.parquet(str(tmp_path / "out"))
    plain = recipients.join(saved, "token").join(rows, "id").select("recipient", "id", "start")
    assert out.count() == plain.count() == 5010 * 40 + 10 * 39999
    assert not out.exceptAll(plain).take(1)
    one = saves_of_recipients(recipients.where("token = 1"), saved, rows)
    one.write.parquet(str(tmp_path / "one"))
    assert sum(f.stat().st_size for f in (tmp_path / "one").glob("*.parquet")) < 100_000  # of 200,400 rows; 13 bits each for their recipients alone would be 325,000


def test_recipients_of_a_very_common_token_are_dealt_to_several_tasks(spark):
    from tallyhouse.operators import desk

    before, (desk.PIECE, desk.GROUP, desk.FEW, desk.TASK) = (desk.PIECE, desk.GROUP, desk.FEW, desk.TASK), (7, 5, 3, 20)
    try:
        recipients = spark.sql("SELECT id AS recipient, IF(id % 9 > 0, id % 3, 5) AS token FROM range(300)")
        saved, rows = spark.sql("SELECT id % 3 AS token, id FROM range(200)"), spark.sql("SELECT id % 180 AS id, CAST(id AS STRING) AS start FROM range(190)")
        got = desk.saves_of_recipients(recipients, saved, rows).select("*", F.spark_partition_id().alias("task")).collect()
        assert len({r["task"] for r in got if r["recipient"] % 3 == 1}) > 3
        plain = recipients.join(saved, "token").join(rows, "id").select("recipient", "id", "start").collect()
        assert sorted((r["recipient"], r["id"], r["start"]) for r in got) == sorted(tuple(r) for r in plain)
    finally:
        desk.PIECE, desk.GROUP, desk.FEW, desk.TASK = before
