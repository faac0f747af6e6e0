"""Which link of a listing is the official one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hosts that sell or list what others put on, and words of venues that prove nothing about a host. Fixed values.
AGGREGATORS = (
    "ticketmaster.com", "livenation.com", "axs.com", "seatgeek.com", "eventbrite.com",
    "eventbrite.ca", "dice.fm", "etix.com", "ticketweb.com", "universe.com",
    "tickettailor.com", "see-tickets.us", "seetickets.com", "showclix.com",
    "brownpapertickets.com", "frontgatetickets.com", "ticketon.com",
    "stubhub.com", "vividseats.com", "viagogo.com", "tickpick.com", "gametime.co",
    "ticketnetwork.com", "ticketliquidator.com",
    "songkick.com", "bandsintown.com", "allevents.in", "eventful.com",
)
GENERIC = (
    "the", "and", "bar", "hall", "club", "park", "field", "arena", "center", "centre",
    "theater", "theatre", "stage", "room", "live", "music", "events", "event", "house",
    "venue", "lounge", "cafe", "grill", "hotel", "amphitheater", "amphitheatre", "pavilion",
    "minnesota", "minneapolis", "saint", "paul", "twin", "cities", "metro", "downtown",
    "uptown", "north", "south", "east", "west", "lake", "lakes", "river", "valley",
)
LEAST_WORD = 4


def link_host(url: Column) -> Column:
    """The host of an address in lower case, without www; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def third_parties(hosts: DataFrame, registry: DataFrame) -> DataFrame:
    """(host): those of hosts (host) that the registry (host) has, or whose parent domain it has.

    Hosts are taken once each and exploded into their parents, as many as they have dots, so the registry is met by an equal join however large it is.
    """
    own = hosts.where("host IS NOT NULL").select("host").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = own.select("host", F.explode(parents).alias("parent"))
    return each.join(registry.select(F.col("host").alias("of")).distinct(), F.col("parent") == F.col("of"), "left_semi").select("host").distinct()


def host_names_venue(host: Column, venue: Column) -> Column:
    """Whether a host, signs taken out, holds a word of the venue's name that tells it from others."""
    flat = F.regexp_replace(host, "[^a-z0-9]", "")
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(venue, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= LEAST_WORD) & ~w.isin(*GENERIC))
    return F.coalesce(F.exists(words, lambda w: F.contains(flat, w)), F.lit(False))


def official_links(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (id, ticket, source, venue, ...) with primary, kind and secondary: the venue's own page before tickets that are sold elsewhere; tickets; the venue's page alone; or nothing.

    A source is the venue's own if its host names the venue and is no third party's.
    """
    r = rows.withColumns({"__t": F.trim(F.coalesce("ticket", F.lit(""))), "__s": F.trim(F.coalesce("source", F.lit("")))})
    r = r.withColumns({"__th": link_host(F.col("__t")), "__sh": link_host(F.col("__s"))})
    third = third_parties(r.select(F.col("__sh").alias("host")), registry).withColumnRenamed("host", "__third")
    r = r.join(third, F.col("__sh") == F.col("__third"), "left")
    own = (F.col("__s") != "") & F.col("__third").isNull() & host_names_venue(F.col("__sh"), F.col("venue"))
    elsewhere = (F.col("__t") != "") & ~F.col("__sh").eqNullSafe(F.col("__th")) & ~host_names_venue(F.col("__th"), F.col("venue"))
    both, sold = own & elsewhere, F.col("__t") != ""
    primary = F.when(both, F.col("__s")).when(sold, F.col("__t")).when(own, F.col("__s"))
    kind = F.when(both, "official").when(sold, "tickets").when(own, "official")
    out = r.withColumns({"primary": primary, "kind": kind, "secondary": F.when(both, F.col("__t"))})
    return out.drop("__t", "__s", "__th", "__sh", "__third")
