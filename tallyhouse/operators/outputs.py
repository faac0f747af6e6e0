"""Documents made of listings (calendars, linked data, maps, site maps, tables) and rows read from replies and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import keys, spans
from tallyhouse.functions import text as X

BASE_URL = "https://listings.example"
CRLF = "\r\n"


def csv_field(text: Column) -> Column:
    """A quoted field: quotes doubled, and nothing that a spreadsheet would run."""
    return F.concat(F.lit('"'), F.replace(X.csv_safe(F.coalesce(text, F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, columns))


def calendar_text(text: Column) -> Column:
    """A text value of a calendar: a backslash before backslashes, semicolons and commas, line ends as \\n."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\;,])", r"\\$1")
    return F.regexp_replace(marked, r"\r?\n", r"\\n")


def fold_line(line: Column) -> Column:
    """A line in pieces of at most 75 bytes, each but the first begun by a blank. Characters stay whole.

    Lines of one byte a character are sliced; others are folded character by character, if they are long.
    """
    sliced = F.concat(F.left(line, F.lit(75)), F.regexp_replace(F.substr(line, F.lit(76)), "(?s)(.{1,74})", f"{CRLF} $1"))
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("cur"))

    def put(acc: Column, c: Column) -> Column:
        full = F.octet_length(acc["cur"]) + F.octet_length(c) > 75
        return F.struct(F.when(full, F.concat(acc["done"], acc["cur"], F.lit(CRLF))).otherwise(acc["done"]).alias("done"), F.when(full, F.concat(F.lit(" "), c)).otherwise(F.concat(acc["cur"], c)).alias("cur"))

    return F.when(F.octet_length(line) <= 75, line).when(F.octet_length(line) == F.length(line), sliced).otherwise(F.aggregate(chars, start, put, lambda acc: F.concat(acc["done"], acc["cur"])))


def calendar_stamp(wall: Column) -> Column:
    return F.date_format(spans.instant(wall), "yyyyMMdd'T'HHmmss'Z'")


def calendar_event(rows: DataFrame, stamp: str) -> Column:
    """The lines of a VEVENT of a row with span_end and last_day: days for all-day listings, instants for others; two hours without an end."""
    basic = lambda d: F.date_format(d, "yyyyMMdd")
    own_end = F.when(F.coalesce("end_wall", "start") != F.col("start"), calendar_stamp(F.col("end_wall")))
    two_hours = F.date_format(spans.instant(F.col("start")) + F.expr("INTERVAL 2 HOURS"), "yyyyMMdd'T'HHmmss'Z'")
    end = F.coalesce(calendar_stamp(F.col("span_end")), own_end, two_hours)
    place = F.concat_ws(", ", F.when(F.col("venue") != "", F.col("venue")), F.when(F.col("city") != "", F.concat("city", F.lit(", MN"))))
    url = F.concat(F.lit(f"{BASE_URL}/event/"), F.col("id").cast("string"))
    about = F.concat_ws("\n\n", F.when(F.col("description") != "", F.col("description")), F.concat(F.lit("More: "), url))
    begin = F.when(F.col("all_day"), F.concat(F.lit("DTSTART;VALUE=DATE:"), basic("start_day"))).otherwise(F.concat(F.lit("DTSTART:"), calendar_stamp(F.col("start"))))
    finish = F.when(F.col("all_day"), F.concat(F.lit("DTEND;VALUE=DATE:"), basic(F.date_add("last_day", 1)))).otherwise(F.concat(F.lit("DTEND:"), end))
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit("@listings.example")), F.lit(f"DTSTAMP:{stamp}"), begin, finish, F.concat(F.lit("SUMMARY:"), calendar_text(F.col("title"))), F.concat(F.lit("LOCATION:"), calendar_text(place)), F.concat(F.lit("DESCRIPTION:"), calendar_text(about)), F.concat(F.lit("URL:"), url), F.concat(F.lit("STATUS:"), F.when(F.col("status") == "cancelled", "CANCELLED").otherwise("CONFIRMED")), F.lit("END:VEVENT")]
    return F.concat_ws(CRLF, *map(fold_line, lines))


def linked_data(rows: DataFrame) -> Column:
    """A schema.org Event as JSON, safe inside a script element. Absent values have no field."""
    url = F.concat(F.lit(f"{BASE_URL}/event/"), F.col("id").cast("string"))
    some = lambda c: F.when(c != "", c)
    geo = F.when((F.col("lat") != 0) | (F.col("lng") != 0), F.struct(F.lit("GeoCoordinates").alias("@type"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))
    address = F.struct(F.lit("PostalAddress").alias("@type"), some(F.col("city")).alias("addressLocality"), F.lit("MN").alias("addressRegion"), F.lit("US").alias("addressCountry"))
    location = F.struct(F.lit("Place").alias("@type"), F.col("venue").alias("name"), address.alias("address"), geo.alias("geo"))
    price = F.when(X.price_tier(F.col("price")) == "Free", "0").otherwise(F.regexp_replace(X.lowest_amount(F.col("price")).cast("string"), r"\.0$", ""))
    offer = F.when(price.isNotNull(), F.struct(F.lit("Offer").alias("@type"), price.alias("price"), F.lit("USD").alias("priceCurrency"), F.coalesce(some(F.col("url")), url).alias("url")))
    span = F.col("span_end")
    day = F.left("start", F.lit(10))
    own = F.when(F.coalesce("end_wall", "start") != F.col("start"), F.col("end_wall"))
    last = F.left(F.coalesce(span, "end_wall"), F.lit(10))
    begin = F.when(F.col("all_day"), day).otherwise(spans.iso(F.col("start")))
    end = F.when(F.col("all_day"), F.when(last > day, last)).otherwise(spans.iso(F.coalesce(span, own)))
    status = F.concat(F.lit("https://schema.org/Event"), F.when(F.col("status") == "cancelled", "Cancelled").otherwise("Scheduled"))
    event = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), status.alias("eventStatus"), location.alias("location"), url.alias("url"), begin.alias("startDate"), end.alias("endDate"), some(F.col("description")).alias("description"), offer.alias("offers"))
    return F.replace(F.to_json(event), F.lit("<"), F.lit("\\u003c"))


def map_features(places: DataFrame) -> DataFrame:
    """(name, feature): a GeoJSON point of each place with finite coordinates."""
    there = places.where(~F.isnan("lat") & ~F.isnan("lng") & (F.abs("lat") <= 90) & (F.abs("lng") <= 180))
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return there.select("name", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("name").alias("properties"))).alias("feature"))


def bounds(places: DataFrame) -> DataFrame:
    """One row: west, south, east and north of all places, null if there are none."""
    return places.agg(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))


def site_map(rows: DataFrame) -> DataFrame:
    """(path): pages of days, cities and venues that upcoming rows have."""
    paths = F.array(F.concat(F.lit("/day/"), F.col("start_day").cast("string")), F.concat(F.lit("/cities/"), F.replace(keys.area_city(F.col("city")), F.lit(" "), F.lit("-"))), F.when(keys.slug(F.col("venue")) != "", F.concat(F.lit("/venues/"), keys.slug(F.col("venue")))))
    return rows.select(F.explode(paths).alias("path")).where("path IS NOT NULL").distinct()


def fenced_json(reply: Column, schema: str) -> Column:
    """The array in a reply's fenced block, or in the reply itself; null if it is none."""
    body = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(body != "", body).otherwise(reply), schema)


def show_time(html: Column) -> Column:
    """HH:MM of a show: the time at which it starts before that of the doors; null without any."""
    found = F.coalesce(*[F.when(F.regexp_extract(html, p, 1) != "", F.struct(F.regexp_extract(html, p, 1).cast("int").alias("h"), F.coalesce(F.try_to_number(F.regexp_extract(html, p, 2), F.lit("99")).cast("int"), F.lit(0)).alias("m"), F.lower(F.regexp_extract(html, p, 3)).alias("half"))) for p in (r"(?is)show\s*(?:starts?)?\s*:?\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m", r"(?is)doors?\s*(?:open)?\s*:?\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m")])
    hour = found["h"] % 12 + F.when(found["half"] == "p", 12).otherwise(0)
    return F.when(found.isNotNull() & found["h"].between(1, 12), F.format_string("%02d:%02d", hour, found["m"]))


def plain_text(html: Column) -> Column:
    """Text of a piece of HTML: no tags, the commonest entities read, blanks collapsed."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def rounded_places(points: DataFrame) -> DataFrame:
    """Points (pos, name, lat, lng) to five places, one for each spot: the first by pos."""
    p = points.withColumns({"lat": F.round("lat", 5), "lng": F.round("lng", 5)})
    return p.groupBy("lat", "lng").agg(F.min(F.struct("pos", "name")).alias("f")).select("lat", "lng", F.col("f.name").alias("name"))
