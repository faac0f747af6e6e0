"""Authoritative feeds as tables: league schedules in JSON and venue calendars in HTML.

Bodies come as rows (from spark.read.text with wholetext, or a table of pages), so Spark splits, retries and shuffles them like any other table. Schemas are declared; a body that
doesn't fit is kept beside the others as a bad record, and a team of which one body is bad has no schedule at all: holes in a schedule would pass for cancelled games.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.time import ZONE

EASTERN = "America/New_York"
#: Shapes of three leagues' schedules, and the hour before which no game begins: such a time is a placeholder. Fixed values.
SHAPES = {
    "dates": "dates array<struct<date: string, games: array<struct<gameDate: string, gameType: string, status: struct<startTimeTBD: boolean>, teams: struct<home: struct<team: struct<id: bigint, name: string>>, away: struct<team: struct<id: bigint, name: string>>>>>>>",
    "games": "games array<struct<startTimeUTC: string, gameDate: string, gameType: int, homeTeam: struct<abbrev: string, placeName: struct<`default`: string>, commonName: struct<`default`: string>>, awayTeam: struct<abbrev: string, placeName: struct<`default`: string>, commonName: struct<`default`: string>>>>",
    "events": "events array<struct<date: string, competitions: array<struct<date: string, timeValid: boolean, competitors: array<struct<homeAway: string, team: struct<displayName: string>>>>>>>",
}
EARLY_HOUR = 7
BAD = "_bad"


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of the files under path, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def parsed(bodies: DataFrame, shape: str) -> DataFrame:
    """bodies with `reply`, null where the body is no JSON of that shape, and `_bad`, the body then."""
    schema = f"{SHAPES[shape]}, {BAD} string"
    r = bodies.withColumn("reply", F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    bad = F.col("reply").isNull() | F.col(f"reply.{BAD}").isNotNull()
    return r.withColumn(BAD, F.when(bad, F.coalesce("body", F.lit("")))).withColumn("reply", F.when(~bad, F.col("reply")))


def _local(at: Column, zone: str) -> Column:
    """A text instant as a wall string of a zone, null if it is none."""
    instant = F.coalesce(F.try_to_timestamp(at), F.try_to_timestamp(at, F.lit("yyyy-MM-dd'T'HH:mmX")))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm")


def _full_name(team: Column) -> Column:
    parts = F.trim(F.concat_ws(" ", F.when(team["placeName"]["default"] != "", team["placeName"]["default"]), F.when(team["commonName"]["default"] != "", team["commonName"]["default"])))
    return F.when(parts != "", parts).otherwise(team["abbrev"])


def _games(replies: DataFrame, shape: str) -> DataFrame:
    """(team, seq, pos, at, stated, ours, opponent, home, preseason, flag) of the games in parsed replies (team, seq, who, reply), of whichever sides."""
    r = replies.where("reply IS NOT NULL")
    key = ["team", "seq", "who"]
    if shape == "dates":
        d = r.select(*key, F.posexplode("reply.dates").alias("p", "d")).select(*key, "p", "d.date", F.posexplode("d.games").alias("q", "g"))
        home, away = F.col("g.teams.home.team"), F.col("g.teams.away.team")
        is_home, ours = home["id"].cast("string") == F.col("who"), (home["id"].cast("string") == F.col("who")) | (away["id"].cast("string") == F.col("who"))
        return d.select("team", "seq", F.struct("p", "q").alias("pos"), F.col("g.gameDate").alias("at"), F.when(F.coalesce("date", F.lit("")) != "", F.col("date")).alias("stated"), ours.alias("ours"), F.when(is_home, away["name"]).otherwise(home["name"]).alias("opponent"), F.coalesce(is_home, F.lit(False)).alias("home"), F.coalesce(F.col("g.gameType") == "S", F.lit(False)).alias("preseason"), F.coalesce(F.col("g.status.startTimeTBD"), F.lit(False)).alias("flag"))
    if shape == "games":
        d = r.select(*key, F.posexplode("reply.games").alias("q", "g")).withColumn("p", F.lit(0))
        home, away = F.col("g.homeTeam"), F.col("g.awayTeam")
        is_home = home["abbrev"] == F.col("who")
        return d.select("team", "seq", F.struct("p", "q").alias("pos"), F.col("g.startTimeUTC").alias("at"), F.left("g.gameDate", F.lit(10)).alias("stated"), (is_home | (away["abbrev"] == F.col("who"))).alias("ours"), F.when(is_home, _full_name(away)).otherwise(_full_name(home)).alias("opponent"), F.coalesce(is_home, F.lit(False)).alias("home"), F.coalesce(F.col("g.gameType") == 1, F.lit(False)).alias("preseason"), F.lit(False).alias("flag"))
    d = r.select(*key, F.posexplode("reply.events").alias("q", "e")).withColumn("p", F.lit(0)).withColumn("c", F.get("e.competitions", F.lit(0)))
    side = lambda s: F.get(F.filter(F.col("c.competitors"), lambda x: x["homeAway"] == s), F.lit(0))["team"]["displayName"]
    d = d.select(*key, F.struct("p", "q").alias("pos"), F.coalesce("e.date", "c.date").alias("at"), F.col("c.timeValid").alias("valid"), side("home").alias("h"), side("away").alias("a"))
    is_home = F.col("h") == F.col("who")
    eastern = F.left(_local(F.col("at"), EASTERN), F.lit(10))  # a kickoff that isn't announced stands at midnight there
    return d.select("team", "seq", "pos", "at", eastern.alias("stated"), (is_home | (F.col("a") == F.col("who"))).alias("ours"), F.when(is_home, F.col("a")).otherwise(F.col("h")).alias("opponent"), F.coalesce(is_home, F.lit(False)).alias("home"), F.lit(False).alias("preseason"), F.coalesce(F.col("valid") == F.lit(False), F.lit(False)).alias("flag"))


def schedules(replies: DataFrame) -> DataFrame:
    """(team, day, start, opponent, home, preseason, tbd): the games of every team whose replies can all be read.

    replies: team, seq (which reply of the team), shape (of SHAPES), who (the team's id, abbreviation or name in the feed), body. A game whose time is flagged as unknown, or lies before EARLY_HOUR, has the
    day that its feed states and no time; the feeds repeat games, so of equal (day, opponent, home) the first counts.
    """
    found, bad = None, None
    for shape in SHAPES:
        p = parsed(replies.where(F.col("shape") == shape), shape)
        b, g = p.where(F.col(BAD).isNotNull()).select(F.col("team").alias("of")), _games(p, shape)
        found, bad = (g, b) if found is None else (found.unionByName(g), bad.unionByName(b))
    g = found.where("ours AND coalesce(opponent, '') <> ''").withColumn("wall", _local(F.col("at"), ZONE))
    early = F.substring("wall", 12, 2).cast("int") < EARLY_HOUR
    tbd = F.col("flag") | F.col("wall").isNull() | F.coalesce(early, F.lit(True))
    g = g.withColumn("tbd", tbd).withColumn("day", F.when(tbd, F.coalesce("stated", F.left("wall", F.lit(10)))).otherwise(F.left("wall", F.lit(10)))).where("day IS NOT NULL")
    # a reply without any readable time says nothing in the shapes that have no day of their own
    g = g.withColumn("start", F.when(F.col("tbd"), F.concat("day", F.lit("T00:00"))).otherwise(F.col("wall")))
    first = F.min_by(F.struct("start", "preseason", "tbd"), F.struct("seq", "pos")).alias("f")
    once = g.groupBy("team", "day", "opponent", "home").agg(first).select("team", "day", "f.start", "opponent", "home", "f.preseason", "f.tbd")
    return once.join(bad.distinct(), F.col("team") == F.col("of"), "left_anti")


def bad_replies(replies: DataFrame) -> DataFrame:
    """(team, seq, body) of replies that can't be read as their shape."""
    out = None
    for shape in SHAPES:
        b = parsed(replies.where(F.col("shape") == shape), shape).where(F.col(BAD).isNotNull()).select("team", "seq", "body")
        out = b if out is None else out.unionByName(b)
    return out


#: Marks of a venue's month page. Fixed values.
_DAY, _SHOW = r'<div id="day-(\d{4}-\d{1,2}-\d{1,2})">', '<div class="show_list_item"'
_VENUE, _LINK = r'<div class="venue_name">\s*([^<]+?)\s*</div>', r'<h4[^>]*>\s*<a href="([^"]+)">(.*?)</a>'


def shown_text(markup: Column) -> Column:
    """Text of a piece of a calendar: tags are blanks, a few entities are read, blanks collapse."""
    t = F.regexp_replace(markup, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&#0?38;", "&"), ("&#8217;", "'")):
        t = F.regexp_replace(t, entity, char)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def calendar_shows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, day, venue, title, url) of the shows in month pages (key, html).

    A page is cut at its day marks and each piece at its shows, so no show is looked at with another's day; shows before the first mark have none and are dropped,
    as are those without venue or link. Of a heading with a break the part after the last one is the title.
    """
    flat = F.regexp_replace(F.coalesce("html", F.lit("")), r"\s+", " ")
    days = pages.select(key, F.posexplode(F.split(flat, f"(?={_DAY})")).alias("p", "piece")).withColumn("raw", F.regexp_extract("piece", f"^{_DAY}", 1)).where("raw <> ''")
    shows = days.select(key, "p", "raw", F.posexplode(F.slice(F.split("piece", f"(?={_SHOW})"), 2, 100_000)).alias("q", "show"))
    block = F.regexp_extract("show", f'^{_SHOW}[^>]*>(.*?)(?=<div id="day-|$)', 1)
    cut = shows.withColumn("block", block).select(key, F.struct("p", "q").alias("pos"), "raw", F.regexp_extract("block", _VENUE, 1).alias("venue"), F.regexp_extract("block", _LINK, 1).alias("url"), F.regexp_extract("block", _LINK, 2).alias("heading"))
    after = shown_text(F.element_at(F.split("heading", r"(?i)<br\s*/?>"), -1))
    title = F.when(after != "", after).otherwise(shown_text(F.col("heading")))
    day = F.to_date(F.col("raw"), "yyyy-M-d")
    return cut.where("venue <> '' AND url <> ''").select(key, "pos", day.alias("day"), shown_text(F.col("venue")).alias("venue"), title.alias("title"), "url").where("title <> ''")


def each_show_once(shows: DataFrame, folded: Column, order: list[str]) -> DataFrame:
    """An early and a late show of one billing in one room on one day are one: the first in order."""
    by = Window.partitionBy(F.lower("venue"), "day", folded).orderBy(*order)
    return shows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
