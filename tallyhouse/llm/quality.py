"""Quality rules whose cutoffs follow each language and source.

The rules look at ratios of a text: junk symbols a word, capitals a letter, repeated lines and
characters a word. Instead of one fixed cutoff a rule, each (lang, source) gets its own, from a
quantile sketch of that ratio: a log-linear histogram with 32 steps an octave. Such sketches merge
by adding counts, so they are built with an ordinary partial aggregation: a hot source sends a few
hundred counts a task, never its rows. The counts are integers and the sketch has no random
choices, so reruns and other engines get the same cutoffs (relative error at most 1/32).

A rule rejects a text above a fence, q50 + 4 * (q95 - q50), of the texts' own language and source. Quantiles are the largest values of
their buckets, and the spread q95 - q50 is one bucket at least, so texts that are all alike are no outliers of each other. The
sketch of a language and source is shrunk towards that of its
language, and that one towards the sketch of all, as if PRIOR texts of the larger group had been seen in the smaller one; so a small group moves away from the
others' cutoffs little by little. A language's fence goes where its texts are, above or below that of all texts; a source's
is held between half of its language's fence and twice that, so that a source of junk can't lift its own bar at will, and one without any tail keeps some room.

Defined cases: a null text has no words; null lang or source are groups of their own; ratios
over nothing are 0; a ratio that equals the cutoff passes; a text alone in its table or language and source is no outlier; repeated rows count each; an empty table gives an empty result. Columns of
the input that share a name with a result column don't matter: results are built from doc_id, text,
lang and source only, and filter_quality returns the input's columns as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, materialise

#: rule: numerator, denominator. Ratios are in thousandths.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Fixed limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Texts of the larger group that a sketch starts with; sketches count in thousandths of texts.
PRIOR, UNIT = 100, 1000
_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(65, 91))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in windows of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key = rank[:n]
    for k in range(1, width):  # ranks stay below the number of words, so a pair fits in 64 bits
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + rank[k : k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    found = np.flatnonzero(counts[inverse] >= 2)
    if not len(found):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()  # bytes split at ASCII white space only
    solid = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    code_points = len(solid) - np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80)
    return (
        len(words),
        int(code_points),
        len(solid) - len(solid.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(solid) - len(solid.translate(None, _UPPER)),
    )


def with_counts(docs: DataFrame, prefix: str = "", text: str = "text") -> DataFrame:
    """The given columns and COUNTS of column `text`, each named with the prefix."""
    bounded_batches(docs.sparkSession)
    names = [f"{prefix}{c}" for c in COUNTS]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in names]])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [count_text(x) for x in b.column(at).cast(pa.binary()).to_pylist()]
            columns = list(zip(*counts, strict=True)) if counts else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _ratio(rule: str, p: str) -> F.Column:
    over, under = RULES[rule]
    return F.when(F.col(p + under) > 0, F.expr(f"({p}{over} * 1000) div {p}{under}")).otherwise(F.lit(0).cast("bigint"))


def _bucket(value: str) -> str:
    return f"(greatest(length(bin({value})) - 6, 0) * 32 + shiftright({value}, greatest(length(bin({value})) - 6, 0)))"


def _bucket_floor(bucket: str) -> str:
    return f"CASE WHEN {bucket} < 64 THEN cast({bucket} AS bigint) ELSE shiftleft(cast({bucket} - ({bucket} div 32 - 1) * 32 AS bigint), cast({bucket} div 32 - 1 AS int)) END"


def _bucket_top(bucket: str) -> str:
    """The largest value of a bucket."""
    return f"({_bucket_floor(f'({bucket} + 1)')} - 1)"


def sketch(counts: DataFrame, prefix: str = "") -> DataFrame:
    """(lang, source, rule, bucket, n): the mergeable sketches."""
    stacked = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r, prefix).alias("v")) for r in RULES]))
    rows = counts.select("lang", "source", stacked.alias("r")).select("lang", "source", "r.rule", F.expr(_bucket("r.v")).cast("int").alias("bucket"))
    return rows.groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def _shrunk(own: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """(keys, rule, bucket, n): own in UNITs, with PRIOR texts spread as in the parent's sketch."""
    over = Window.partitionBy(*parent_keys, "rule")
    share = parent.withColumn("prior", F.col("n") * (PRIOR * UNIT)).withColumn("total", F.sum("n").over(over)).select(*[F.col(k).alias(f"p_{k}") for k in parent_keys], F.col("rule").alias("p_rule"), F.col("bucket").alias("p_bucket"), F.expr("prior div total").alias("prior"))
    groups = own.select(*keys, "rule").distinct()
    of = F.col("rule") == F.col("p_rule")
    for k in parent_keys:
        of = of & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    spread = groups.join(share, of).select(*keys, "rule", F.col("p_bucket").alias("bucket"), F.col("prior").alias("n"))
    return spread.unionByName(own.select(*keys, "rule", "bucket", (F.col("n") * UNIT).alias("n"))).groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def _quantiles(sketches: DataFrame, keys: list[str], percents: tuple[int, ...]) -> DataFrame:
    """For each key and rule the quantiles' buckets b<percent>."""
    by = Window.partitionBy(*keys, "rule")
    rows = sketches.withColumn("below", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("total") * q, F.col("bucket")))
    return rows.groupBy(*keys, "rule").agg(*[at(q).alias(f"b{q}") for q in percents])


def _fence(name: str) -> F.Column:
    """q50 + 4 * (q95 - q50) from the buckets b50 and b95; the spread is the width of b50 at least."""
    low, high = _bucket_top("b50"), _bucket_top("b95")
    return F.expr(f"{low} + 4 * greatest({high} - {low}, {low} - {_bucket_floor('b50')} + 1)").alias(name)


def cutoffs(sketches: DataFrame) -> DataFrame:
    """(lang, source, rule, own, wide): the fences of a group and rule, and of its language."""
    lang = sketches.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    every = lang.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    langs = _shrunk(lang, ["lang"], every, [])
    groups = _quantiles(_shrunk(sketches, ["lang", "source"], langs, ["lang"]), ["lang", "source"], (50, 95)).select("lang", "source", "rule", _fence("own"))
    wide = _quantiles(langs, ["lang"], (50, 95)).select(F.col("lang").alias("of"), F.col("rule").alias("of_rule"), _fence("wide"))
    return groups.join(wide, F.col("lang").eqNullSafe(F.col("of")) & (F.col("rule") == F.col("of_rule"))).select("lang", "source", "rule", "own", "wide")


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, t_<rule>...): the cutoffs in force for each language and source."""
    cut = cutoffs(sketches).withColumn("t", F.greatest(F.expr("wide div 2"), F.least("own", F.col("wide") * 2)))
    return cut.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col("t"))).alias(f"t_{r}") for r in RULES])


def _verdict(counted: DataFrame, limits: DataFrame, p: str) -> DataFrame:
    """counted with {p}base_failed and {p}kept. Names with {p} are ours; others pass."""
    lim = limits.select(F.col("lang").alias(f"{p}lang"), F.col("source").alias(f"{p}source"), *[F.col(f"t_{r}").alias(f"{p}t_{r}") for r in RULES])
    joined = counted.join(lim, counted["lang"].eqNullSafe(lim[f"{p}lang"]) & counted["source"].eqNullSafe(lim[f"{p}source"]))
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (F.col(f"{p}n_repeat_words") * 100 > F.col(f"{p}n_words") * MAX_REPEAT_PERCENT)
    passed = reduce(lambda x, y: x & y, [_ratio(r, p) <= F.col(f"{p}t_{r}") for r in RULES])
    return joined.withColumn(f"{p}base_failed", failed).withColumn(f"{p}kept", ~failed & passed)


_P = "__quality_"


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for each row of docs (doc_id, text, lang, source)."""
    counted = with_counts(docs.select("doc_id", "text", "lang", "source"), _P).drop("text")
    counted = materialise(counted, "quality-counts")
    judged = _verdict(counted, materialise(thresholds(materialise(sketch(counted, _P), "quality-sketch")), "quality-cutoffs"), _P)
    return judged.select("doc_id", *[F.col(f"{_P}{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")])


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    Texts are read once: counts and texts are written side by side, and the cutoffs join that table.
    """
    counted = materialise(with_counts(docs, _P), "quality-docs")
    judged = _verdict(counted, materialise(thresholds(materialise(sketch(counted, _P), "quality-sketch")), "quality-cutoffs"), _P)
    return judged.where(F.col(f"{_P}kept")).select(*docs.columns)
