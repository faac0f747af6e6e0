"""Titles as they are shown, and titles as keys of runs. The vocabularies are fixed values; the rules are put together from them."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that begin a schedule and what follows them; words of months; forms and promotions that a title needn't name. Fixed values.
REPEATS = ("weekly", "daily", "every", "each")
BOUNDS = ("through", "thru", "until", "start", "starts", "open", "opens")
WEEKDAYS = tuple(f"{d.lower()}s" for d in calendar.day_name)
MONTHS = (*(m.lower() for m in calendar.month_name[1:]), *(m.lower() for m in calendar.month_abbr[1:] if m != "May"), "sept")
FORMS = ("exhibition", "exhibit", "screening", "film screening", "touring", "matinee", "rooftop", "artist-designed", "artist designed", "ongoing exhibition", "immersive exhibit")
PROMOTIONS = ("giveaway", "bobblehead", "presented by", "sponsored by", "fan appreciation", "theme night")
SILENT = ("the", "and", "for", "at")
DASH = "[–—-]"
OWN_SHARE, SHORTEST = 0.6, 4


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")


def tells_schedule(text: Column) -> Column:
    """Whether a text only says when: "every friday", "Jul 5-7", "through fall", "ongoing", "2026 season"."""
    words = _words(text)
    word = lambda n: F.coalesce(F.get(words, F.lit(n)), F.lit(""))
    n, first = F.size(words), word(0)
    rest = F.array_join(F.slice(words, 2, 100), " ")
    return (
        (first.isin(*REPEATS) & (n == 2) & word(1).rlike(r"^\w+$"))
        | (first.isin(*WEEKDAYS) & (n == 1))
        | (F.regexp_replace(first, r"\.$", "").isin(*MONTHS) & rest.rlike(rf"^\d{{1,2}}(?: ?{DASH} ?\d{{1,2}})?$"))
        | (first.isin(*MONTHS) & (n == 2) & (word(1) == "run"))
        | (first.isin(*BOUNDS) & (n >= 2))
        | (first == "ongoing")
        | F.array_join(words, " ").rlike(rf"^\d{{4}}(?: ?{DASH} ?\d{{4}})? season")
    )


def _telling(text: Column) -> Column:
    """The words of a text that tell places apart."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.isin(*SILENT)))


def shown_title(title: Column, venue: Column, city: Column) -> Column:
    """A title without brackets that tell a schedule, a form or the place beside it, and without a schedule or promotion after its last dash.

    A title of which less than four characters would stay is shown as it is.
    """
    whole = F.trim(F.coalesce(title, F.lit("")))
    place = F.array_union(_telling(F.coalesce(venue, F.lit(""))), _telling(F.coalesce(city, F.lit(""))))

    def idle(piece: Column) -> Column:
        inner = F.regexp_extract(piece, r"^\s*\(([^()]*)\)$", 1)
        own = _telling(inner)
        names_place = F.coalesce(F.try_divide(F.size(F.array_intersect(own, place)), F.size(own)) >= OWN_SHARE, F.lit(False))
        return piece.rlike(r"^\s*\([^()]*\)$") & (tells_schedule(inner) | F.lower(F.trim(inner)).isin(*FORMS) | names_place)

    pieces = F.regexp_extract_all(whole, F.lit(r"\s*\([^()]*\)|(?:(?!\s*\([^()]*\)).)+"), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda p: ~idle(p)), "")
    last = rf"\s+{DASH}\s+([^–—-]+)$"
    tail = F.trim(F.regexp_extract(kept, last, 1))
    idle_tail = (tail != "") & (tells_schedule(tail) | F.lower(tail).rlike(rf"\b(?:{'|'.join(PROMOTIONS)})\b"))
    short = F.when(idle_tail, F.trim(F.regexp_replace(kept, last, ""))).otherwise(kept)
    spaced = F.regexp_replace(F.array_join(F.split(short, r"\s+[—-]\s+"), " – "), r"\s{2,}", " ")
    tidy = F.ltrim(F.rtrim(spaced, F.lit(" \t\n–—:,-")))
    return F.when(F.length(tidy) < SHORTEST, whole).otherwise(tidy)


#: What parts of a run are called. Fixed values.
UNITS = {"weekend": (r"\s*\d+", r"\s+[ivx]+"), "day": (r"\s*\d+",)}
EDITIONS = ("second", "third", "1st", "2nd", "3rd")
WEEKENDS = ("opening", "closing", "final", "last", "first", "continued", "ongoing")
ENDINGS = tuple(f"{w} {p}" for w in ("final", "last") for p in ("days", "week"))


def run_title(title: Column) -> Column:
    """A title as the key of a run: lower-case letters and digits, without years, numbered parts, editions, remarks in brackets, and what a dash at the end says of weekends."""
    own = lambda p: rf"\b{p}\b"
    numbered = [own(f"{unit}{number}") for unit, numbers in UNITS.items() for number in numbers]
    weekends = rf"(?:(?:{'|'.join(WEEKENDS)})\s+)?weekends?(?:\s+only)?"
    endings = "|".join(e.replace(" ", r"\s+") for e in ENDINGS)
    at_end = [rf"\s*{DASH}\s*(?:{x})\s*$" for x in (weekends, endings)] + [rf"{DASH}+\s*$"]
    t = F.lower(F.coalesce(title, F.lit("")))
    # years first: a weekend's number may be one
    for part in (own(r"(?:19|20)\d{2}"), *numbered, own(rf"(?:{'|'.join(EDITIONS)})\s+edition"), r"\([^)]*\)", *at_end):
        t = F.regexp_replace(t, part, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "['’`‘]", ""), "[^a-z0-9]+", " "))
