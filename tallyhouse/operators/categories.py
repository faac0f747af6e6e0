"""What a listing is about, by weighted phrases in its title, text and venue.

Each text is read once: at each word that begins a phrase, the runs of words from there are looked up in one table of phrases, instead of one regular
expression a signal and field. Signals that no list of phrases can say (open endings, one word somewhere after another) stay expressions; they
are few. The look-up runs in Arrow batches: as built-in functions over arrays it took 28 s for 150,000 listings, as interpreted lambdas evaluate slowly.
Weights, dampers and the choice are built-in functions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from re import _parser as parser  # the standard library's own reading of a pattern

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.reading import CATEGORIES

#: Signals: what a text says, as whole words, and how much it weighs. Fixed values.
SIGNALS: dict[str, tuple[tuple[str, int], ...]] = {
    "music": (
        (r"concert|concerts|live music|gig|dj|setlist|tour", 10),
        (r"music fest\w*|music series|music night|music in the park", 10),
        (r"band|bands|orchestra|symphony|philharmonic|choir|chorale|chorus|ensemble|quartet|quintet|trio", 9),
        (r"jazz|blues|indie|hip[- ]?hop|rap|punk|metal|bluegrass|reggae|salsa|funk|r&b|edm|techno|classical|opera|acoustic", 8),
        (r"(country|rock|soul|house|folk)\s+(music|band|night|show|concert|fest\w*|jam)", 8),
        (r"(music|concert)\b.*\b(country|rock|soul|house|folk)", 6),
        (r"singer|songwriter|vocalist|guitarist|drummer|rapper|musician|performs?|performing|headlin\w*|opening act", 6),
        (r"guitar|banjo|fiddle|violin|piano|saxophone|trumpet|drumline|bagpipe|accordion|organ recital", 9),
        (r"porchfest|bandshell|battle of the bands|showcase", 7),
        (r"open mic|jam session|karaoke|record release|album release|unplugged|recital", 8),
        (r"presents|in concert|live at|on tour", 4),
    ),
    "sports": (
        (r"vs|versus|@", 3),
        (r"twins|vikings|timberwolves|wolves|lynx|wild|united|saints|gophers|loons", 9),
        (r"game|match|tournament|championship|playoff|scrimmage", 7),
        (r"(track|swim|cross[- ]country|dual)\s+meet", 7),
        (r"baseball|basketball|football|hockey|soccer|volleyball|lacrosse|tennis|golf|wrestling|boxing|mma", 9),
        (r"marathon|half marathon|5k|10k|race|triathlon|cycling|regatta", 8),
        (r"target field|target center|xcel energy center|us bank stadium|allianz field|chs field", 6),
    ),
    "family": (
        (r"kids?|children'?s?|toddler|preschool|all[- ]ages|family[- ]friendly|families", 12),
        (r"story ?time|storytime|puppet|petting zoo|face painting|bounce house|playground|play date", 9),
        (r"zoo|aquarium|children'?s museum|science museum|nature center|planetarium", 7),
        (r"egg hunt|trick[- ]or[- ]treat|santa|easter bunny|summer camp|day camp", 8),
        (r"drop[- ]in|make[- ]and[- ]take", 3),
        (r"family", 5),
    ),
    "arts": (
        (r"theatre|theater|play|musical|drama|comedy|improv|stand[- ]?up|cabaret|burlesque", 11),
        (r"shakespeare|fringe|godot|broadway|playwright|monologue|one[- ]act", 11),
        (r"exhibit|exhibition|gallery|museum|installation|retrospective|curated|curator", 9),
        (r"art|arts|artist|painting|sculpture|photography|printmaking|ceramics|pottery", 7),
        (r"ballet|dance|choreograph\w*|contemporary dance|tap|modern dance", 8),
        (r"poetry|poet|reading|author|literary|book launch|spoken word", 7),
        (r"film|screening|cinema|documentary|movie", 7),
        (r"craft|workshop|art[- ]making|make[- ]and[- ]take", 5),
    ),
    "food": (
        (r"tasting|taste of|food truck|pop[- ]?up dinner|chef|dining|restaurant week|prix fixe", 9),
        (r"farmers'? market|farmer'?s market|night market|food hall", 8),
        (r"cider|wine|winery|cocktail|happy hour|pub crawl|beer tasting|beer garden|barrel[- ]aged", 7),
        (r"dinner|brunch|breakfast|lunch|supper|bbq|barbecue|cook[- ]?off|bake sale|pancake", 7),
        (r"food|culinary|eats|feast", 5),
    ),
    "weird": (
        (r"weird|bizarre|quirky|oddities|peculiar|unusual|offbeat|only in minnesota", 9),
        (r"rubber duck|cardboard boat|lawn mower rac\w*|hot dish|birkebeiner|polar plunge", 9),
        (r"raffle", 9),
        (r"(competition|contest|championship of)\b.*\b(eating|beard|mustache|costume|air guitar)", 9),
        (r"seance|paranormal|ghost tour|haunted|cryptid|bigfoot|ufo|alien", 8),
        (r"renaissance fair(e)?|medieval|cosplay|anime con|comic con|furry", 6),
    ),
    "festival": (
        (r"festival|fest", 5),
        (r"county fair|state fair|carnival|parade|block party|street fair", 8),
        (r"celebration|jubilee|days", 3),
    ),
}
#: Words that name places, weighed once wherever they are; what a venue's name hints at. Fixed values.
PLACES = (("food", r"brewery|brewing|brewhouse|taproom|distillery|beer hall", 2), ("food", r"beer|brew", 2))
HINTS = (
    ("music", r"first ave(nue)?|7th st(reet)? entry|turf club|icehouse|palace theatre|fine line|the cedar|dakota|amsterdam bar|hook and ladder|the armory|uptown theater|varsity theater|berlin", 6),
    ("sports", r"target field|target center|xcel energy|us bank stadium|allianz field|chs field|williams arena", 5),
    ("arts", r"guthrie|orpheum|state theatre|pantages|jungle theater|children'?s theatre|walker art|mia|minneapolis institute of art|weisman|museum|gallery", 5),
    ("food", r"brewery|brewing|taproom|winery|distillery", 3),
    ("family", r"zoo|aquarium|children'?s museum|nature center", 5),
)
#: Venues of the arts, and titles that are for families even there. Fixed values.
ARTS_VENUE = r"theatre|theater|playhouse|opera house|art center|arts center|art centre|museum|gallery|institute of art|walker art|guthrie|orpheum|ordway|pantages|state theatre|fringe|dinner theatres?"
FAMILY_TITLE = r"kids?|children'?s?|toddler|all[- ]ages|family|families|playdate|story ?time"
#: Categories that a venue of the arts damps to a quarter, and what it adds to the arts. Fixed values.
DAMPED, ARTS_FLOOR = ("sports", "food"), 6

_WORD = "[a-z0-9_]"
_WORDS = re.compile(f"{_WORD}+")


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def phrases(pattern: str) -> set[str] | None:
    """All texts that a pattern can match, None if there is no end to them or one is no phrase of words."""

    def walk(items: parser.SubPattern) -> set[str] | None:
        found = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more: set[str] | None = {chr(arg)}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                more = {chr(c) for _, c in arg}
            elif name == "BRANCH":
                parts = [walk(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif name == "SUBPATTERN":
                more = walk(arg[-1])
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                inner = walk(arg[2])
                more = None if inner is None else inner | {""}
            else:
                more = None
            if more is None:
                return None
            found = {a + b for a in found for b in more}
        return found

    found = walk(parser.parse(pattern))
    if found is None:
        return None
    # what ends in a sign is only met where the phrase without it is met as well
    bare = {f for f in found if re.fullmatch(rf"{_WORD}.*", f) and re.search(rf"{_WORD}$", f)}
    return bare if all(f in bare or re.sub(r"[^a-z0-9_]+$", "", f) in bare for f in found) else None


class Signals:
    """Numbered patterns, as a table of phrases and the expressions that are left over."""

    def __init__(self, patterns: list[str]):
        self.table: dict[str, list[int]] = defaultdict(list)
        self.open: list[tuple[int, str]] = []
        for i, pattern in enumerate(patterns, 1):
            rest = []
            for a in alternatives(pattern):
                found = phrases(a)
                for p in sorted(found or ()):
                    if i not in self.table[p]:
                        self.table[p].append(i)
                if found is None:
                    rest.append(a)
            if rest:
                self.open.append((i, rf"(?a)\b(?:{'|'.join(rest)})\b"))
        self.most = max(len(re.findall(f"{_WORD}+", p)) for p in self.table)
        self.first = {re.match(f"{_WORD}+", p)[0] for p in self.table}

        self.compiled = [(i, re.compile(p)) for i, p in self.open]

    def hits(self, text: str) -> list[int]:
        """The numbers of the signals in a text, each once."""
        low = text.lower()
        spans = [m.span() for m in _WORDS.finditer(low)]
        found: set[int] = set()
        for k, (start, end) in enumerate(spans):
            if low[start:end] in self.first:
                for _, stop in spans[k : k + self.most]:
                    found.update(self.table.get(low[start:stop], ()))
        found.update(i for i, p in self.compiled if p.search(low))
        return sorted(found)


def _half(weight: int) -> int:
    return (weight + 1) // 2


#: Every pattern with the categories that it speaks for, by field: its number is its place, from one on.
_OWN = [(name, pattern, weight) for name, signals in SIGNALS.items() for pattern, weight in signals]
_PATTERNS = [p for _, p, _ in _OWN] + [p for _, p, _ in HINTS] + [ARTS_VENUE, FAMILY_TITLE]
_ARTS, _FAMILY = len(_PATTERNS) - 1, len(_PATTERNS)
SIGNAL_TABLE = Signals(_PATTERNS)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def signal_hits(texts: pd.Series) -> pd.Series:
    """The numbers of the signals in each text; texts that repeat within a batch are looked at once."""
    known: dict[str, list[int]] = {}
    return texts.fillna("").map(lambda t: known[t] if t in known else known.setdefault(t, SIGNAL_TABLE.hits(t)))


def _totals(hits: Column, field: str) -> Column:
    """What the signals of a field give each category, as an array in the order of CATEGORIES."""
    weigh = {"title": lambda w: 2 * w, "text": lambda w: w, "venue": _half, "hint": lambda w: 0}[field]
    rows = [[weigh(w) if name == c else 0 for c in CATEGORIES] for name, _, w in _OWN]
    rows += [[w if field == "hint" and name == c else 0 for c in CATEGORIES] for name, _, w in HINTS] + [[0] * len(CATEGORIES)] * 2
    known = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    return F.aggregate(hits, F.array(*[F.lit(0)] * len(CATEGORIES)), lambda acc, i: F.zip_with(acc, F.element_at(known, i), lambda x, y: x + y))


def with_scores(rows: DataFrame, title: str, text: str, venue: str) -> DataFrame:
    """rows with `scores`: the score of each category, in the order of CATEGORIES.

    A generator of one row gives it, so that filters on what is made of it stay above: pushed down, they would repeat the look-up at each mention.
    """
    fields = {"title": title, "text": text, "venue": venue}
    r = rows.withColumns({f"__h_{f}": signal_hits(F.col(c)) for f, c in fields.items()})
    everything = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (title, venue, text)]))
    places = [sum((F.when(everything.rlike(rf"\b(?:{p})\b"), w).otherwise(0) for of, p, w in PLACES if of == name), F.lit(0)) for name in CATEGORIES]
    said = F.zip_with(_totals(F.col("__h_title"), "title"), _totals(F.col("__h_text"), "text"), lambda x, y: x + y)
    r = r.withColumns({"__said": said, "__own": _totals(F.col("__h_venue"), "venue"), "__hint": _totals(F.col("__h_venue"), "hint"), "__place": F.array(*places)})
    r = r.withColumns({"__arts": F.array_contains("__h_venue", _ARTS), "__kin": F.array_contains("__h_title", _FAMILY)})
    scores = []
    for k, name in enumerate(CATEGORIES):
        said, own = F.get("__said", F.lit(k)), F.get("__own", F.lit(k))
        if name in DAMPED:  # in a venue of the arts its own name doesn't count, and the rest counts a quarter
            score = F.when(F.col("__arts"), F.floor(said * 0.25 + 0.5)).otherwise(said + own)
        elif name == "arts":
            score = said + own + F.when(F.col("__arts") & ~F.col("__kin"), ARTS_FLOOR).otherwise(0)
        else:
            score = said + own
        scores.append((score + F.get("__hint", F.lit(k)) + F.get("__place", F.lit(k))).cast("int"))
    return r.select(*rows.columns, F.explode(F.array(F.array(*scores))).alias("scores"))


def with_category(rows: DataFrame, title: str, text: str, venue: str, suggested: str) -> DataFrame:
    """rows with `chosen` and `confidence`: the category of the highest score, the first of equals; if nothing scores the suggested one, or festival."""
    r = with_scores(rows, title, text, venue).withColumn("confidence", F.array_max("scores"))
    known = F.when(F.col(suggested).isin(*CATEGORIES), F.col(suggested)).otherwise("festival")
    first = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.array_position("scores", F.col("confidence")).cast("int"))
    return r.withColumn("chosen", F.when(F.col("confidence") > 0, first).otherwise(known)).drop("scores")


def recategorise(rows: DataFrame, title: str, text: str, venue: str, category: str) -> tuple[DataFrame, DataFrame]:
    """(changes, tally): rows (id and the named columns) whose content says another category, and rows by category before and after."""
    r = with_category(rows.select("id", title, text, venue, category), title, text, venue, category)
    # one that is none of the categories is only replaced on evidence
    moved = r.withColumn("new", F.when(F.col("confidence") > 0, F.col("chosen")).otherwise(F.col(category)))
    changes = moved.where(~F.col("new").eqNullSafe(F.col(category))).select("id", F.col(category).alias("before"), F.col("new").alias("after"))
    side = F.explode(F.array(F.struct(F.col(category).alias("category"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("new").alias("category"), F.lit(0).alias("b"), F.lit(1).alias("a"))))
    tally = moved.select(side.alias("s")).groupBy("s.category").agg(F.sum("s.b").alias("before"), F.sum("s.a").alias("after"))
    return changes, tally
