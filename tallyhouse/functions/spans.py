"""States and spans of listings as columns over wall strings (yyyy-MM-ddTHH:mm, Chicago).

Wall strings of one form compare as text. Instants are made only where minutes are counted or zones are shown.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.time import ZONE

CAP_DAYS, NIGHT_HOUR, EARLY_HOUR = 14, 6, 7
DEFAULT_MINUTES, SOON_MINUTES = 120, 720


def day_of(wall: Column) -> Column:
    return F.to_date(F.left(wall, F.lit(10)))


def span_end(start: Column, end: Column, multi: Column) -> Column:
    """The wall string at which a listing of several days ends, else null: a small-hours end on the next day is the same evening."""
    first, last = day_of(start), day_of(end)
    evening = (F.datediff(last, first) == 1) & (F.substring(end, 12, 2).cast("int") < NIGHT_HOUR)
    return F.when(day_of(multi) > first, multi).when((last > first) & ~evening, end)


def last_day(start: Column, end: Column, multi: Column) -> Column:
    return F.coalesce(day_of(span_end(start, end, multi)), day_of(start))


def capped_last(first: Column, last: Column) -> Column:
    """The last day on which a listing is shown in calendars: the first one for spans over CAP_DAYS."""
    return F.when(F.datediff(last, first) + 1 <= CAP_DAYS, last).otherwise(first)


def latest_wall(start: Column, end: Column, multi: Column) -> Column:
    return F.greatest(start, F.coalesce(end, F.lit("")), F.coalesce(multi, F.lit("")))


def instant(wall: Column) -> Column:
    """The UTC instant of a wall string; the first of a repeated hour, an hour later for a skipped one."""
    return F.to_utc_timestamp(wall.cast("timestamp"), ZONE)


def offset(wall: Column) -> Column:
    """-05:00 or -06:00."""
    hours = F.round((F.unix_timestamp(wall.cast("timestamp")) - F.unix_timestamp(instant(wall))) / 3600).cast("int")
    return F.concat(F.lit("-0"), (-hours).cast("string"), F.lit(":00"))


def iso(wall: Column) -> Column:
    return F.concat(wall, F.lit(":00"), offset(wall))


def time_state(start: Column, end: Column, multi: Column, all_day: Column, now: str) -> Column:
    """struct<kind, minutes>: ended, now, soon (with minutes until the start) or upcoming at the wall time `now`."""
    final = latest_wall(start, end, multi)
    at, today = F.lit(now), F.lit(now[:10])
    stop = F.when(final > start, F.unix_timestamp(instant(final))).otherwise(F.unix_timestamp(instant(start)) + DEFAULT_MINUTES * 60)
    begin, moment = F.unix_timestamp(instant(start)), F.unix_timestamp(instant(at))
    minutes = F.ceil((begin - moment) / 60).cast("int")
    daily = F.when(today > F.left(final, F.lit(10)), "ended").when(today >= F.left(start, F.lit(10)), "now").otherwise("upcoming")
    timed = F.when(moment > stop, "ended").when(moment >= begin, "now").when(minutes <= SOON_MINUTES, "soon").otherwise("upcoming")
    kind = F.when(all_day, daily).otherwise(timed)
    return F.struct(kind.alias("kind"), F.when(kind == "soon", minutes).alias("minutes"))


def state_label(state: Column) -> Column:
    n = state["minutes"]
    hours = F.floor(n / 60 + F.lit(0.5)).cast("int")
    plural = lambda x: F.when(x == 1, "").otherwise("s")
    soon = F.when(n < 60, F.concat(F.lit("Starts in "), n.cast("string"), F.lit(" minute"), plural(n))).otherwise(F.concat(F.lit("Starts in "), hours.cast("string"), F.lit(" hour"), plural(hours)))
    return F.when(state["kind"] == "ended", "This event has already happened.").when(state["kind"] == "now", "Happening now").when(state["kind"] == "soon", soon)


def clock_label(wall: Column) -> Column:
    """7 PM, 7:30 PM."""
    h, m = F.substring(wall, 12, 2).cast("int"), F.substring(wall, 15, 2)
    return F.concat(F.when(h % 12 == 0, F.lit("12")).otherwise((h % 12).cast("string")), F.when(m == "00", "").otherwise(F.concat(F.lit(":"), m)), F.when(h >= 12, " PM").otherwise(" AM"))


def time_label(wall: Column, all_day: Column) -> Column:
    return F.when(all_day, "All day").otherwise(clock_label(wall))


def short_date(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def span_label(first: Column, last: Column) -> Column:
    """Jul 3 – 5, Jul 30 – Aug 2."""
    return F.concat(short_date(first), F.lit(" – "), F.when(F.month(first) == F.month(last), F.date_format(last, "d")).otherwise(short_date(last)))


def day_time_label(start: Column, all_day: Column, end: Column, day: Column) -> Column:
    """What a day's list shows beside a listing: its time, or how long it still runs. end: its span_end."""
    last = day_of(end)
    running = F.when(last.isNull() | (last < day), "Ongoing").when(last == day, "Last day").otherwise(F.concat(F.lit("Through "), short_date(last)))
    return F.when(day_of(start) >= day, time_label(start, all_day)).otherwise(running)


def normal_time(raw: Column) -> Column:
    """struct<wall, all_day> of a time as agents write it: zones are dropped, the clock face stays; null if it is none."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    stamp = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?$"
    hh, mm = F.regexp_extract(s, stamp, 2), F.regexp_extract(s, stamp, 3)
    right = (hh != "") & (hh <= "23") & (mm <= "59")
    dated = F.struct(F.concat(s, F.lit("T00:00")).alias("wall"), F.lit(True).alias("all_day"))
    timed = F.struct(F.concat(F.regexp_extract(s, stamp, 1), F.lit("T"), hh, F.lit(":"), mm).alias("wall"), ((hh == "00") & (mm == "00")).alias("all_day"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), dated).when(right, timed)


def end_local(day: Column, begin: Column, end: Column) -> Column:
    """Wall end from clock times: an end before the beginning is on the next day; null without one."""
    last = F.when(end < begin, F.date_add(day, 1)).otherwise(day)
    return F.when(F.coalesce(end, F.lit("")) != "", F.concat(F.date_format(last, "yyyy-MM-dd"), F.lit("T"), end))


def weekday(day: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(day) - 1


def weekend_days(day: Column) -> Column:
    """What is left of this weekend, or from Monday to Thursday the next one, Friday to Sunday."""
    w = weekday(day)
    first = F.when(w.isin(0, 5, 6), day).otherwise(F.date_add(day, 5 - w))
    last = F.when(w == 0, day).when(w == 6, F.date_add(day, 1)).otherwise(F.date_add(first, 2))
    return F.sequence(first, last)


def weekend_of(day: date) -> list[date]:
    """The same for one day, for literals."""
    w = (day.weekday() + 1) % 7
    first = day if w in (0, 5, 6) else day + timedelta(days=5 - w)
    last = day if w == 0 else day + timedelta(days=1) if w == 6 else first + timedelta(days=2)
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def preset(name: str, day: date) -> tuple[date, date]:
    """First and last day of a window preset: today, week, weekend (never before today) or month."""
    if name == "today":
        return day, day
    if name == "week":
        return day, day + timedelta(days=6)
    if name == "weekend":
        days = weekend_of(day)
        return days[0], days[-1]
    if name == "month":
        first = day.replace(day=1)
        return first, (first + timedelta(days=32)).replace(day=1) - timedelta(days=1)
    raise ValueError(name)
