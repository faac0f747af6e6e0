"""Text keys, tiers, similarity and search as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition (NFKD) without marks makes of lower-case characters: those that become one letter or
    digit, what they become, and Latin ligatures that become several."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in (*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFEF)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not 0x300 <= ord(x) <= 0x36F)
        if bare != c and bare.isascii() and bare.isalnum():
            if len(bare) == 1:
                one[c] = bare
            elif "LATIN" in unicodedata.name(c, ""):
                several[c] = bare
    return "".join(one), "".join(one.values()), several


_FROM, _TO, _LIGATURES = _plain_letters()


def fold(text: Column) -> Column:
    """Lower case without accents: what NFKD leaves of Latin letters and digits when marks are taken away."""
    t = F.translate(F.regexp_replace(F.lower(text), "[\u0300-\u036f]", ""), _FROM, _TO)
    for ligature, letters in _LIGATURES.items():
        t = F.replace(t, F.lit(ligature), F.lit(letters))
    return t


def key_part(text: Column) -> Column:
    """Folded letters, digits and single blanks: what keys and searches compare."""
    bare = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title_key(title: Column) -> Column:
    """A title's key: brackets at the end, versus forms and a leading "the" don't count. The patterns are fixed values."""
    t = F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"(\s*[(\[][^()\[\]]*[)\]])+\s*$", "")
    t = F.regexp_replace(F.trim(t), r"\b(?:versus|vs\.?|v\.)(?=\s|$)", "vs")
    return key_part(F.regexp_replace(t, r"^the\s+", ""))


def listing_key(title: Column, venue: Column, day: Column) -> Column:
    """The exact-duplicate key: 32 hex digits of a SHA-256 over title, venue (under its registered name) and day."""
    from tallyhouse.functions.keys import venue_key

    return F.substring(F.sha2(F.concat_ws("|", title_key(title), venue_key(venue), F.date_format(day, "yyyy-MM-dd")), 256), 1, 32)


def lowest_amount(price: Column) -> Column:
    """The lowest number in a price text, null without one."""
    return F.array_min(F.transform(F.regexp_extract_all(price, F.lit(r"(\d+(?:\.\d{2})?)"), F.lit(1)), lambda x: x.cast("double")))


def price_tier(price: Column) -> Column:
    """Free, $, $$ or $$$ of a price text; a literal tier passes, blank or without number is $$. The bounds are fixed values."""
    p = F.trim(F.coalesce(price, F.lit("")))
    low = lowest_amount(p)
    return (
        F.when(p.isin("Free", "$", "$$", "$$$"), p)
        .when(p == "", "$$")
        .when(F.lower(p).contains("free") | (p == "$0"), "Free")
        .when(low.isNull(), "$$")
        .when(low == 0, "Free")
        .when(low < 20, "$")
        .when(low < 75, "$$")
        .otherwise("$$$")
    )


def matches(haystack: Column, query: str) -> Column:
    """Whether every token of the query occurs in the text, both as key parts; a blank query matches."""
    tokens = F.filter(F.split(key_part(F.lit(query)), " "), lambda t: t != "")
    hay = key_part(haystack)
    return F.forall(tokens, lambda t: F.contains(hay, t))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if there are none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://(?:www\.)?([^/:?#]+)", 1)


def url_section(url: Column) -> Column:
    """The first path segment, "home" without one."""
    part = F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)", 1)
    return F.when(part == "", "home").otherwise(part)


def preview(text: Column, most: int = 180) -> Column:
    """At most `most` characters: longer texts end in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet does not run: an apostrophe before = + - @."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def is_email(text: Column) -> Column:
    return (F.length(text) <= 254) & text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def percent(part: Column, whole: Column) -> Column:
    """A rounded percentage, halves up, 0 of nothing."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + F.lit(0.5))).otherwise(F.lit(0)).cast("bigint")
