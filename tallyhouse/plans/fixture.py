"""The listings that the read path, the pickers and the writers are exercised on.

The data folder has no table of listings, so each order stands for one. Every column is an expression that Spark and DuckDB
both read, so the oracle SQL starts from the same rows: LISTINGS is that SQL as the first parts of a WITH.
"now" is noon, 30 days before the last start.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.tables import table

_DAY = "CAST(o_orderdate AS DATE)"
_MINUTE = "(o_orderkey * 37) % 1440"


def _clock(minutes: str) -> str:
    return f"lpad(CAST(CAST(floor(({minutes}) / 60) AS INT) AS STRING), 2, '0') || ':' || lpad(CAST(CAST(({minutes}) % 60 AS INT) AS STRING), 2, '0')"


def _case(of: str, values: list[str], other: str) -> str:
    return f"CASE CAST({of} AS INT) " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"


_N = "CAST(o_custkey % 53 AS STRING)"
#: Fixed values of this fixture.
COLUMNS = {
    "id": "o_orderkey",
    "owner": "o_custkey",
    "category": _case("o_custkey % 7", ["'music'", "'sports'", "'family'", "'arts'", "'food'", "'weird'"], "'festival'"),
    "title": _case("o_orderkey % 10", [f"'The Show ' || {_N} || ' (21+)'", f"'Show ' || {_N} || ' vs. Foo [FREE]'", f"'Café Night ' || {_N} || ' — Opening Weekend'", "'Food Truck Rally Weekend 2'", "'Sever''s Fall Festival 1999'", "'Sever''s Fall Festival'", f"'Jazz & Blues ' || {_N} || ' (Saturdays)'"], f"'Show ' || {_N}"),
    "venue": _case("o_custkey % 9", ["'First Ave'", "'The Armory'", "'7th St Entry'", "'Hook & Ladder Theater (Mission Room)'", "'Palace Theater'", "'Xcel Energy Ctr'", "''"], "'Hall ' || CAST(o_custkey % 29 AS STRING)"),
    "city": _case("o_custkey % 8", ["'Minneapolis'", "'Saint Paul, MN'", "'St. Paul'", "'Woodbury'", "'Edina'", "'Bloomington'", "'Blaine'"], "'Duluth'"),
    "lat": "CASE WHEN o_custkey % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(44.5 AS DOUBLE) + CAST(o_custkey % 97 AS DOUBLE) / CAST(97 AS DOUBLE) END",
    "lng": "CASE WHEN o_custkey % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(-93.8 AS DOUBLE) + CAST(o_custkey % 89 AS DOUBLE) / CAST(89 AS DOUBLE) END",
    "start_day": _DAY,
    "start": f"CAST({_DAY} AS STRING) || 'T' || {_clock(_MINUTE)}",
    "end_wall": f"CASE CAST(o_orderkey % 6 AS INT) WHEN 1 THEN CAST({_DAY} AS STRING) || 'T23:30' WHEN 2 THEN CAST({_DAY} + 1 AS STRING) || 'T01:30' WHEN 3 THEN CAST({_DAY} + CAST(o_custkey % 20 AS INT) AS STRING) || 'T18:00' WHEN 4 THEN CAST({_DAY} - 1 AS STRING) || 'T18:00' END",
    "multi_day_end": f"CASE WHEN o_orderkey % 17 = 0 THEN CAST({_DAY} + CAST(o_orderkey % 25 AS INT) AS STRING) || 'T22:00' END",
    "all_day": "o_orderkey % 13 = 0",
    "price": _case("o_orderkey % 5", ["'Free'", "'$12.50'", "'$25 - $80'", "''"], "'$120'"),
    "status": "CASE WHEN o_orderstatus = 'O' THEN 'published' WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 'published' WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'draft' END",
    "url": _case("o_orderkey % 4", ["'https://www.ticketmaster.com/e/' || CAST(o_orderkey AS STRING)", "'https://venue' || CAST(o_custkey % 29 AS STRING) || '.example/cal?id=' || CAST(o_orderkey AS STRING)", "''"], "'http://tickets.example/' || CAST(o_orderkey AS STRING)"),
    "description": _case("o_orderkey % 3", ["'Doors, music and food trucks at ' || CAST(o_custkey AS STRING) || '; bring friends, bring chairs, stay late.'", "'Short'"], "''"),
    "created_day": f"{_DAY} - CAST(o_orderkey % 40 AS INT)",
    "image": _case("o_orderkey % 3", ["'https://img.example/' || CAST(o_orderkey AS STRING)", "''"], "'data:image'"),
}
LISTINGS = "WITH listings AS (SELECT " + ", ".join(f"{e} AS {n}" if n != "start" else f'{e} AS "start"' for n, e in COLUMNS.items()) + " FROM orders), clock AS (SELECT max(start_day) - 30 AS today FROM listings)"
#: CTE `spans` adds last_day (of the true span), n_days and capped_last (the start day beyond 14 days).
SPANS = LISTINGS + ''', e AS (SELECT *, CASE WHEN multi_day_end IS NOT NULL AND CAST(left(multi_day_end, 10) AS DATE) > start_day THEN multi_day_end
    WHEN end_wall IS NOT NULL AND CAST(left(end_wall, 10) AS DATE) > start_day AND NOT (CAST(left(end_wall, 10) AS DATE) = start_day + 1 AND CAST(substr(end_wall, 12, 2) AS INT) < 6) THEN end_wall END AS span_end FROM listings),
    l AS (SELECT *, coalesce(CAST(left(span_end, 10) AS DATE), start_day) AS last_day FROM e),
    spans AS (SELECT *, last_day - start_day + 1 AS n_days, CASE WHEN last_day - start_day + 1 <= 14 THEN last_day ELSE start_day END AS capped_last FROM l)'''


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS `{n}`" for n, e in COLUMNS.items()])


def today(spark: SparkSession, sf_dir: str) -> date:
    """The day that stands for now, one value: filters on it are literals, which reach the scan."""
    last = table(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    return (last or date(2000, 1, 31)) - timedelta(days=30)


def utc_sql(wall: str) -> str:
    """DuckDB SQL of the UTC timestamp of a Chicago wall timestamp; of a repeated hour the first, which DuckDB alone would not take."""
    utc = f"timezone('UTC', timezone('America/Chicago', {wall}))"
    return f"(CASE WHEN timezone('America/Chicago', timezone('UTC', {utc} - INTERVAL 1 HOUR)) = {wall} THEN {utc} - INTERVAL 1 HOUR ELSE {utc} END)"


def _pick(of: str, words: str) -> str:
    """One of the words, parted by bars, by a number; both engines read it."""
    return f"split_part('{words.replace(chr(39), chr(39) * 2)}', '|', CAST(({of}) % {len(words.split('|'))} AS INT) + 1)"


#: Words that titles, texts and venues are put together from, so that rules meet many combinations. Fixed values of this fixture.
_WORDS = "live music|jazz|country|club|country  music|art|party|rock|climbing|Family|kids|children's|Theatre|dinner|brewing|beer|hall|golf|tour|house|vs.|TWINS|game|5K|zoo|hot dish|Festival|county|fair|poetry|food truck|hip-hop|R&B|meet|swim|improv|haunted|Choreography|headliners|day|days|block party|Annie|godot|at|the|of|with|open mic|egg hunt|raffle|chef|happy hour|eating|contest|costume|sale|workshop|film|café|naïve|play|playdate|drop-in|in concert|museum"
_ROOMS = "Guthrie Theater|Chanhassen Dinner Theatres|Day Block Brewing|First Ave|Walker Art Center|Target Field|Como Zoo|Hall|Surly Brewery|Museum of Beer|The Armory|Ordway|Farmers' Market|Mia|Turf Club|Winery|Nature Center|"
_BETWEEN = " | - |, |  |/| & |: "
#: Column: expression over orders. Fixed values of this fixture.
WORDED_COLUMNS = {
    "id": "o_orderkey",
    "category": _pick("o_custkey", "music|sports|family|arts|food|weird|festival|other"),
    "title": " || ".join([_pick("o_orderkey * 7", _WORDS), _pick("o_custkey", _BETWEEN), _pick("o_orderkey * 13 + o_custkey", _WORDS), _pick("o_custkey * 3", _BETWEEN), _pick("o_custkey * 29 + 11", _WORDS)]),
    "venue": _pick("o_custkey * 5 + o_orderkey", _ROOMS),
    "description": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE " + " || ' ' || ".join(_pick(f"o_orderkey * {a} + o_custkey * {b}", _WORDS) for a, b in ((11, 1), (17, 3), (31, 7), (3, 2))) + " || '.' END",
}
WORDED = "WITH worded AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in WORDED_COLUMNS.items()) + " FROM orders)"


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, title, venue, description): listings of varied words."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS `{n}`" for n, e in WORDED_COLUMNS.items()])
