"""Document fingerprints by consistent weighted sampling.

Terms are the lower-cased (A-Z) words of a text, weighted by how often they occur. For each of SAMPLES samples a
term has r and c from Gamma(2, 1) and b from U(0, 1), all from hashes of the term: with weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The sample is the (term, t) of least a. Two texts
agree in one with a chance equal to their generalised Jaccard similarity, sum(min(w)) / sum(max(w)) (Ioffe 2010).
A fingerprint keeps 16 bits of each sample, so unequal samples look equal once in 65,536.

All of it is built-in functions. A sample's ln a (31 bits of fixed point, steps of 2^-23) and the hash of its (term, t) share a
64-bit number, so the whole fingerprint is SAMPLES plain minima, combined before any shuffle.

The share of equal samples misses the similarity J by sqrt(J (1 - J) / SAMPLES) as a standard error, 0.088 at most.

Which document follows which is found on narrow rows (doc_id and two hashes of the text), ranged by Spark. A text is then shuffled once, by those
three; of the following one comes only the part that the edit takes. Rows equal in doc_id and text are one row with a count until the end.

Defined cases: a null text is empty; an empty text has the fingerprint "" and likeness 1 to another empty one, 0 to the rest;
rows are ordered by doc_id, null first, then by hashes of the text; repeated rows stay (each is followed by the next copy); a table of one row is its own successor;
other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE, materialise, with_next

SAMPLES = 32
_UNIT = 1 << 21


def term_runs(text: str) -> str:
    """SQL for array<struct<t: bigint, w: int>>: the terms of a text, as hashes, with their counts."""
    words = f"sort_array(transform(filter(split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), x -> x <> ''), x -> xxhash64(x)))".replace("\\", "\\\\")
    return words


def _uniform(bits: str) -> str:
    return f"(({bits}) + 0.5D) / {_UNIT}D"


def sample_minimum(k: int) -> Column:
    """The number of which the least over a text's rows (t, lw: log weight) is its sample k. ln a lies over -128 for weights under e^80."""
    mask = _UNIT - 1
    one, two = f"xxhash64(t, {2 * k})", f"xxhash64(t, {2 * k + 1})"
    r = f"(-ln({_uniform(f'shiftrightunsigned({one}, 43)')} * {_uniform(f'shiftrightunsigned({one}, 22) & {mask}')}))"
    c = f"ln(-ln({_uniform(f'shiftrightunsigned({two}, 43)')} * {_uniform(f'shiftrightunsigned({two}, 22) & {mask}')}))"
    b = f"({_uniform(f'{one} & {mask}')})"
    level = f"floor(lw / {r} + {b})"
    a = f"({c} - {r} * ({level} - {b} + 1D))"
    # no branch around it, so that Spark computes what recurs in it once; null weights make it null
    return F.expr(f"shiftleft(cast(({a} + 128D) * {1 << 23}D AS bigint), 32) | (xxhash64(t, {level}, {k}) & 4294967295L)")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(equal / F.lit(float(SAMPLES)))


def _fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp of rows; rows of equal keys are one text. Partitioned as rows are, if keys hold their partitioning."""
    w = "__words"
    hashed = rows.withColumn(w, F.expr(term_runs(text))).select(*keys, w)
    starts = hashed.withColumn("__at", F.expr(f"CASE WHEN size({w}) > 0 THEN filter(sequence(0, size({w}) - 1), i -> i = 0 OR {w}[i] <> {w}[i - 1]) ELSE cast(array() AS array<int>) END"))
    runs = F.expr(f"zip_with(__at, concat(slice(__at, 2, greatest(size(__at) - 1, 0)), CASE WHEN size({w}) > 0 THEN array(size({w})) ELSE cast(array() AS array<int>) END), (x, y) -> struct({w}[x] AS t, y - x AS w))")
    terms = starts.select(*keys, F.explode_outer(runs).alias("r")).select(*keys, F.col("r.t").alias("t"), F.ln(F.col("r.w").cast("double")).alias("lw"))
    least = terms.groupBy(*keys).agg(*[F.min(sample_minimum(k)).alias(f"__m{k}") for k in range(SAMPLES)])
    digits = F.lower(F.concat(*[F.lpad(F.hex(F.col(f"__m{k}").bitwiseAND(F.lit(0xFFFF))), 4, "0") for k in range(SAMPLES)]))
    return least.select(*keys, F.coalesce(digits, F.lit("")).alias("fp"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__row", F.monotonically_increasing_id())
    return _fingerprints(rows, ["doc_id", "__row"], "text").select("doc_id", F.col("fp").alias("fingerprint"))


#: What tells a text's row: whether it has an id, the id (0 without one) and two hashes. None is null, so grouping and joins by them share one shuffle.
KEYS = ["named", "id", "h1", "h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """KEYS and text of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))


def _as(prefix: str, keys: str = "") -> list[Column]:
    """KEYS (of a struct, if named) under names with a prefix."""
    return [F.col(f"{keys}.{c}" if keys else c).alias(f"{prefix}{c}") for c in KEYS]


def _same(prefix: str, of: str = "") -> list[Column]:
    return [F.col(f"{of}{c}") == F.col(f"{prefix}{c}") for c in KEYS]


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text).

    The edited text has the last quarter of the characters replaced by as many first ones of the next document.
    """
    keyed = _keyed(docs)
    narrow = keyed.groupBy(*KEYS).agg(F.count("*").alias("copies"), F.max(F.length("text")).cast("bigint").alias("n_chars"))
    followed = materialise(with_next(narrow, KEYS), "weighted-next")
    texts = keyed.groupBy(*KEYS).agg(F.first("text").alias("text"))
    quarter = F.expr("cast(n_chars div 4 AS int)")
    # the part that each edit takes, from the following text
    wants = followed.select(*_as("of_"), *_as("n_", "next"), quarter.alias("quarter"))
    heads = texts.join(wants, _same("n_")).select(*[f"of_{c}" for c in KEYS], F.left("text", F.col("quarter")).alias("head"))
    counted = followed.select(*_as("c_"), "copies", "n_chars")
    rows = texts.join(heads, _same("of_")).join(counted, _same("c_")).select(*KEYS, "copies", "n_chars", "text", "head")
    kept = F.left("text", F.col("n_chars").cast("int") - quarter)
    # copies of a row are followed by a copy of themselves, the last one excepted
    rows = rows.withColumn("edited", F.concat(kept, F.col("head"))).withColumn("own_edited", F.when(F.col("copies") > 1, F.concat(kept, F.left("text", quarter))))
    kinds = F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited", "own_edited"))])
    each = rows.select(*KEYS, "copies", "n_chars", F.explode(F.filter(kinds, lambda x: x["text"].isNotNull())).alias("x")).select(*KEYS, "copies", "n_chars", "x.which", "x.text", F.when(F.col("x.which") > 0, F.sha2("x.text", 256)).alias("sha"))
    prints = _fingerprints(each, [*KEYS, "copies", "n_chars", "which", "sha"], "text")
    pick = lambda c, k: F.max(F.when(F.col("which") == k, F.col(c)))
    both = prints.groupBy(*KEYS, "copies", "n_chars").agg(pick("fp", 0).alias("fingerprint"), pick("fp", 1).alias("edited_fingerprint"), pick("sha", 1).alias("edited_sha256"), pick("fp", 2).alias("own_fingerprint"), pick("sha", 2).alias("own_sha256"))
    both = materialise(both, "weighted-prints")
    # narrow from here on
    following = both.select(*_as("n_"), F.col("fingerprint").alias("next_fingerprint"))
    found = followed.select(*_as("f_"), *_as("t_", "next")).join(following, _same("n_", "t_")).select(*[f"f_{c}" for c in KEYS], "next_fingerprint")
    whole = both.join(found, _same("f_"))
    last = F.struct(F.col("edited_sha256").alias("sha"), F.col("edited_fingerprint").alias("fp"), F.col("next_fingerprint").alias("next"))
    others = F.array_repeat(F.struct(F.col("own_sha256").alias("sha"), F.col("own_fingerprint").alias("fp"), F.col("fingerprint").alias("next")), F.col("copies").cast("int") - 1)
    out = whole.select(F.when(F.col("named"), F.col("id")).alias("doc_id"), "n_chars", "fingerprint", F.explode(F.concat(F.array(last), others)).alias("e"))
    return out.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), "fingerprint", F.col("e.fp").alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("e.fp")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("e.next")).alias("near_next"))


def gamma_parameters(term: int, k: int, xxhash64) -> tuple[float, float, float]:
    """r, c, b of a term's sample k, as the columns compute them; xxhash64(*values) hashes as Spark does. For tests."""
    mask = _UNIT - 1
    one, two = xxhash64(term, 2 * k) & (2**64 - 1), xxhash64(term, 2 * k + 1) & (2**64 - 1)
    u = lambda bits: (bits + 0.5) / _UNIT
    return -math.log(u(one >> 43) * u(one >> 22 & mask)), -math.log(u(two >> 43) * u(two >> 22 & mask)), u(one & mask)
