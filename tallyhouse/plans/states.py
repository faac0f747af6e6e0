"""Times, states and spans of listings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions import spans
from tallyhouse.operators import reading
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.fixture import LISTINGS, SPANS, listings, today, utc_sql

QUERIES: dict[str, Registered] = {}
_AT = """CAST(replace("start", 'T', ' ') AS TIMESTAMP)"""
_FINAL = """greatest("start", coalesce(end_wall, ''), coalesce(multi_day_end, ''))"""
#: A wall hour that the spring change skips has no instant; Spark and DuckDB both move it.
_DST = "strftime({}, '%Y-%m-%d %H:%M')"


@query(QUERIES, LISTINGS + f""" SELECT DISTINCT "start" AS wall, {_DST.format(utc_sql(_AT))} AS utc, "start" || ':00-0' || CAST(date_diff('hour', {_AT}, {utc_sql(_AT)}) AS VARCHAR) || ':00' AS iso FROM listings""")
def wall_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall strings as UTC instants and with their offset, over both changes of clock."""
    w = listings(spark, sf_dir).select(F.col("start").alias("wall")).distinct()
    return w.select("wall", F.date_format(spans.instant(F.col("wall")), "yyyy-MM-dd HH:mm").alias("utc"), spans.iso(F.col("wall")).alias("iso"))


_RAW = """CASE CAST(id % 8 AS INT) WHEN 0 THEN CAST(start_day AS STRING) WHEN 1 THEN "start" || ':00Z' WHEN 2 THEN replace("start", 'T', ' ') || '-05' WHEN 3 THEN CAST(start_day AS STRING) || 'T00:00' WHEN 4 THEN CAST(start_day AS STRING) || 'T24:10' WHEN 5 THEN ' ' || "start" || ':30.250+05:30 ' WHEN 6 THEN 'next Friday' END"""


@query(QUERIES, LISTINGS + f""", r AS (SELECT id, trim(coalesce({_RAW}, '')) AS raw, regexp_extract(trim(coalesce({_RAW}, '')), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})[T ](\\d{{2}}):(\\d{{2}})(?::\\d{{2}}(?:\\.\\d+)?)?(?:Z|[+-]\\d{{2}}(?::?\\d{{2}})?)?$', ['d', 'h', 'm']) AS p FROM listings)
    SELECT id, CASE WHEN length(raw) = 10 THEN raw || 'T00:00' WHEN p.h <> '' AND p.h <= '23' AND p.m <= '59' THEN p.d || 'T' || p.h || ':' || p.m END AS wall, CASE WHEN length(raw) = 10 THEN true WHEN p.h <> '' AND p.h <= '23' AND p.m <= '59' THEN p.h = '00' AND p.m = '00' END AS all_day FROM r""")
def normal_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as agents write them: date only, with zones, midnight, out of range, no time at all."""
    t = listings(spark, sf_dir).withColumn("raw", F.expr(_RAW.replace('"', "`"))).select("id", spans.normal_time(F.col("raw")).alias("t"))
    return t.select("id", F.col("t.wall").alias("wall"), F.col("t.all_day").alias("all_day"))


@query(QUERIES, SPANS + """ SELECT id, span_end, n_days, strftime(start_day, '%b ') || CAST(day(start_day) AS VARCHAR) || ' – ' || CASE WHEN month(start_day) = month(last_day) THEN '' ELSE strftime(last_day, '%b ') END || CAST(day(last_day) AS VARCHAR) AS label FROM spans WHERE span_end IS NOT NULL""")
def true_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of several days: where they end, their length and label; an end in the small hours is the same evening."""
    s = reading.with_span(listings(spark, sf_dir)).where("span_end IS NOT NULL")
    return s.select("id", "span_end", (F.datediff("last_day", "start_day") + 1).cast("bigint").alias("n_days"), spans.span_label(F.col("start_day"), F.col("last_day")).alias("label"))


@query(QUERIES, SPANS + """ SELECT category, count(*) FILTER (WHERE CASE WHEN capped_last > start_day THEN CAST(capped_last AS VARCHAR) || 'T23:59' ELSE CAST(start_day AS VARCHAR) || 'T23:59' END >= strftime(today, '%Y-%m-%d') || 'T12:00') AS upcoming, count(*) AS n FROM spans, clock GROUP BY 1""")
def upcoming_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcoming to the end of the last shown day. A span over fourteen days is shown on its first day only, so it is not upcoming in its midst."""
    s = reading.with_span(listings(spark, sf_dir))
    return s.groupBy("category").agg(F.count_if(F.col("capped_last") >= F.lit(today(spark, sf_dir))).alias("upcoming"), F.count("*").alias("n"))


@query(QUERIES, LISTINGS + f""", f AS (SELECT *, {_FINAL} AS final, {utc_sql(_AT)} AS b, {utc_sql("CAST(strftime(today, '%Y-%m-%d') || ' 12:00' AS TIMESTAMP)")} AS m FROM listings, clock),
    g AS (SELECT *, CASE WHEN final > "start" THEN {utc_sql("CAST(replace(final, 'T', ' ') AS TIMESTAMP)")} ELSE b + INTERVAL 2 HOUR END AS e, date_diff('minute', m, b) AS mins FROM f),
    h AS (SELECT id, mins, CASE WHEN all_day THEN CASE WHEN strftime(today, '%Y-%m-%d') > left(final, 10) THEN 'ended' WHEN strftime(today, '%Y-%m-%d') >= left("start", 10) THEN 'now' ELSE 'upcoming' END WHEN m > e THEN 'ended' WHEN m >= b THEN 'now' WHEN mins <= 720 THEN 'soon' ELSE 'upcoming' END AS kind FROM g)
    SELECT id, kind, CASE WHEN kind = 'soon' THEN CAST(mins AS INTEGER) END AS minutes, CASE kind WHEN 'ended' THEN 'This event has already happened.' WHEN 'now' THEN 'Happening now' WHEN 'soon' THEN CASE WHEN mins < 60 THEN 'Starts in ' || mins || ' minute' || CASE WHEN mins = 1 THEN '' ELSE 's' END ELSE 'Starts in ' || CAST(floor(mins / 60 + 0.5) AS INTEGER) || ' hour' || CASE WHEN floor(mins / 60 + 0.5) = 1 THEN '' ELSE 's' END END END AS label FROM h""")
def time_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether listings have ended, are on, soon to start or upcoming at noon."""
    state = spans.time_state(F.col("start"), F.col("end_wall"), F.col("multi_day_end"), F.col("all_day"), f"{today(spark, sf_dir)}T12:00")
    s = listings(spark, sf_dir).select("id", state.alias("s"))
    return s.select("id", F.col("s.kind").alias("kind"), F.col("s.minutes").alias("minutes"), spans.state_label(F.col("s")).alias("label"))


@query(QUERIES, SPANS + """, d AS (SELECT CASE WHEN dayofweek(today) IN (0, 5, 6) THEN today ELSE today + CAST(5 - dayofweek(today) AS INT) END AS a, CASE WHEN dayofweek(today) = 0 THEN today ELSE today + CAST(7 - dayofweek(today) AS INT) END AS b FROM clock)
    SELECT CASE WHEN start_day >= a THEN CAST(start_day AS VARCHAR) ELSE 'ongoing' END AS section, CASE WHEN start_day >= a THEN strftime(start_day, '%A, %B ') || CAST(day(start_day) AS VARCHAR) ELSE 'Happening all weekend' END AS heading, id FROM spans, d WHERE status = 'published' AND start_day <= b AND last_day >= a""")
def weekend_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekend's page: what has begun before it first, then day by day."""
    days = spans.weekend_of(today(spark, sf_dir))
    first, last = F.lit(days[0]), F.lit(days[-1])
    s = reading.with_span(reading.published(listings(spark, sf_dir))).where((F.col("start_day") <= last) & (F.col("last_day") >= first))
    fresh = F.col("start_day") >= first
    out = s.select(F.when(fresh, F.col("start_day").cast("string")).otherwise("ongoing").alias("section"), F.when(fresh, F.date_format("start_day", "EEEE, MMMM d")).otherwise("Happening all weekend").alias("heading"), "id", "start")
    return out.orderBy((F.col("section") != "ongoing"), "section", "start", "id").drop("start")


_SHELF = """, o AS (SELECT id, "start", last_day FROM spans, clock WHERE status = 'published' AND start_day < today AND last_day >= today AND n_days >= 4 ORDER BY last_day, "start", id LIMIT 12)"""


@query(QUERIES, SPANS + _SHELF + """ SELECT id, last_day, CASE WHEN last_day = today THEN 'Last day today' ELSE 'Through ' || strftime(last_day, '%b ') || CAST(day(last_day) AS VARCHAR) END AS label, last_day <= today + 6 AS last_chance FROM o, clock
    WHERE (SELECT count(*) FROM o, clock WHERE last_day <= today + 6) < 3 OR last_day <= today + 6 ORDER BY last_day, "start", id LIMIT 6""")
def ongoing_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of the twelve runs that end soonest; only those with a week left, if there are three such."""
    now = today(spark, sf_dir)
    s = reading.with_span(reading.published(listings(spark, sf_dir)).where(F.col("start_day") < F.lit(now)))
    shelf = s.where((F.col("last_day") >= F.lit(now)) & (F.datediff("last_day", "start_day") >= 3)).orderBy("last_day", "start", "id").limit(12)
    soon = F.col("last_day") <= F.lit(now + timedelta(days=6))
    counted = shelf.withColumn("few", F.count_if(soon).over(Window.partitionBy()) < 3)  # twelve rows
    label = F.when(F.col("last_day") == F.lit(now), "Last day today").otherwise(F.concat(F.lit("Through "), spans.short_date(F.col("last_day"))))
    return counted.where(F.col("few") | soon).orderBy("last_day", "start", "id").limit(6).select("id", "last_day", label.alias("label"), soon.alias("last_chance"))


@query(QUERIES, SPANS + """, d AS (SELECT id, category, unnest(generate_series(start_day::TIMESTAMP, capped_last::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day, "start" FROM spans WHERE status <> 'draft')
    SELECT day, count(*) AS n, array_to_string(list(category ORDER BY "start", id)[1:4], ',') AS first_four FROM d GROUP BY 1""")
def listings_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shown day with its listings: how many, and the categories of the first four."""
    s = reading.with_span(listings(spark, sf_dir).where("status <> 'draft'"))
    days = s.select("id", "category", "start", F.explode(F.sequence("start_day", "capped_last")).alias("day"))
    # the first four of a day are found by a window with a limit, which keeps four rows a partition and day
    ranked = days.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy("start", "id"))).where("r <= 4")
    four = ranked.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "category"))), lambda x: x["category"]), ",").alias("first_four"))
    return days.groupBy("day").agg(F.count("*").alias("n")).join(four, "day")


@query(QUERIES, SPANS + """ SELECT greatest(start_day, today - 3) AS day, id, row_number() OVER (PARTITION BY greatest(start_day, today - 3) ORDER BY "start", id) AS pos FROM spans, clock WHERE status = 'published' AND last_day >= today - 3 AND start_day <= today + 3""")
def day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's list by day; what has begun before the window counts for its first day."""
    now = today(spark, sf_dir)
    first, last = F.lit(now - timedelta(days=3)), F.lit(now + timedelta(days=3))
    s = reading.with_span(reading.published(listings(spark, sf_dir)).where(F.col("start_day") <= last)).where(F.col("last_day") >= first)
    g = s.select(F.greatest("start_day", first).alias("day"), "id", "start")
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("day").orderBy("start", "id"))).drop("start")


@query(QUERIES, LISTINGS + """ SELECT id, CASE WHEN all_day THEN 'All day' ELSE ltrim(CASE WHEN substr("start", 15, 2) = '00' THEN strftime(CAST(replace("start", 'T', ' ') AS TIMESTAMP), '%I %p') ELSE strftime(CAST(replace("start", 'T', ' ') AS TIMESTAMP), '%I:%M %p') END, '0') END AS time, strftime(start_day, '%A, %B ') || CAST(day(start_day) AS VARCHAR) || strftime(start_day, ', %Y') AS long_date, strftime(start_day, '%b ') || CAST(day(start_day) AS VARCHAR) AS short_date, start_day - 1 AS day_before, start_day + 1 AS day_after FROM listings""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("start_day")
    return listings(spark, sf_dir).select("id", spans.time_label(F.col("start"), F.col("all_day")).alias("time"), F.date_format(d, "EEEE, MMMM d, yyyy").alias("long_date"), spans.short_date(d).alias("short_date"), F.date_sub(d, 1).alias("day_before"), F.date_add(d, 1).alias("day_after"))


@query(QUERIES, LISTINGS + """, w AS (SELECT today, CAST(floor((today - DATE '1970-01-01') / 7.0) AS BIGINT) AS i FROM clock), b(label, a, z, every) AS (VALUES ('near', 0, 30, 1), ('mid', 31, 60, 2), ('far', 61, 92, 3)) SELECT label, today + CAST(a AS INT) AS first, today + CAST(z AS INT) AS last FROM b, w WHERE i % every = 0""")
def due_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which horizon bands are due this week, and their days."""
    now = today(spark, sf_dir)
    week = (now - date(1970, 1, 1)).days // 7
    #: Band, first and last day from today, due every so many weeks.
    bands = [("near", 0, 30, 1), ("mid", 31, 60, 2), ("far", 61, 92, 3)]
    due = [(n, now + timedelta(days=a), now + timedelta(days=z)) for n, a, z, every in bands if week % every == 0]
    return spark.createDataFrame(due, "label string, first date, last date")


@query(QUERIES, LISTINGS + """, t AS (SELECT id, start_day AS day, substr("start", 12) AS b, CASE WHEN end_wall IS NULL THEN '' ELSE substr(end_wall, 12) END AS e FROM listings) SELECT id, CASE WHEN e = '' THEN NULL ELSE CAST(CASE WHEN e < b THEN day + 1 ELSE day END AS VARCHAR) || 'T' || e END AS end_local FROM t""")
def local_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends given as clock times: before the beginning means past midnight."""
    t = listings(spark, sf_dir).select("id", F.col("start_day").alias("day"), F.substring("start", 12, 5).alias("b"), F.coalesce(F.substring("end_wall", 12, 5), F.lit("")).alias("e"))
    return t.select("id", spans.end_local(F.col("day"), F.col("b"), F.col("e")).alias("end_local"))


@query(QUERIES, LISTINGS + """ SELECT id, CASE WHEN all_day OR CAST(substr("start", 12, 2) AS INT) < 7 THEN NULL ELSE "start" END AS start, CASE WHEN month(start_day) >= 7 THEN CAST(year(start_day) AS VARCHAR) || CAST(year(start_day) + 1 AS VARCHAR) ELSE CAST(year(start_day) - 1 AS VARCHAR) || CAST(year(start_day) AS VARCHAR) END AS season FROM listings WHERE category = 'sports'""")
def game_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with a time to be decided keep their day only; the season's code turns in July."""
    rows = listings(spark, sf_dir).where("category = 'sports'")
    open_ = F.col("all_day") | (F.substring("start", 12, 2).cast("int") < spans.EARLY_HOUR)
    first = F.year("start_day") - F.when(F.month("start_day") >= 7, 0).otherwise(1)
    return rows.select("id", F.when(~open_, F.col("start")).alias("start"), F.concat(first.cast("string"), (first + 1).cast("string")).alias("season"))


@query(QUERIES, f"SELECT event_id, {_DST.format(utc_sql("date_trunc('minute', ts)"))} AS repaired FROM events")
def repaired_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants whose UTC face was meant as Chicago's, read again."""
    from tallyhouse.sources.tables import table

    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(spans.instant(wall), "yyyy-MM-dd HH:mm").alias("repaired"))


@query(QUERIES, LISTINGS + """ SELECT CAST(unnest(generate_series(date_trunc('month', today), date_trunc('month', today) + INTERVAL 23 MONTH, INTERVAL 1 MONTH)) AS DATE) AS first FROM clock""")
def feed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months whose pages a feed has: this one and 23 more."""
    first = today(spark, sf_dir).replace(day=1)
    return spark.range(24).select(F.add_months(F.lit(first), F.col("id").cast("int")).alias("first"))
