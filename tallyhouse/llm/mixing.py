"""Mixing sources to target weights by Pareto order sampling.

A source's target (in words) gives each of its documents an expected number of copies
r = target / size of the source, at most 3. floor(r) copies are certain. What is left of the target is a sample
without replacement with unequal inclusion probabilities: document i has p_i = min(1, L * weight_i), L such that the expected words,
sum(p_i * size_i), are those that are left. Its key is odds(u_i) / odds(p_i), u_i a hash of the row in (0, 1), and the
smallest keys are taken. The sample's size is fixed in words: keys are taken in order while they fit the
words that remain, then at most one more document closes the gap, the one that brings the source
nearest to its target. The weight of a text is 2^(bits of its size div 2), about the root of its size, as long texts are rarer; `weight` names a column
to take instead (positive; few distinct values, as L is found among them).

Nothing is gathered by source: keys are cut into bins and those of the bin where the target falls into bins again, words are summed by
(source, bin), and only the rows of one of 2^24 bins are ordered. What is known of a source is a small table that Spark
broadcasts if its size allows.

Defined cases: a null or blank text has size 0 and is taken 0 times; a null source is a source
of its own, last in order; rows with equal doc_id, source and text are told apart by a number, so each has a key of its own; an empty table gives an
empty result; other columns of the input are not looked at (mix_documents passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, materialise, unit

CAP = 3
BINS = 4096
#: What tells rows apart, after the key.
ROW = ["doc_id", "hash", "copy"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, get the weights in turn. Targets share all words by
    weight; none exceeds cap * source_size, and the excess goes to the others by weight. This is
    the level L with sum(min(cap * size, L * weight)) = all words, found by ordering the sources by
    cap * size / weight. One row a source passes through the windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("position", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    limit = F.col("source_size") * F.lit(float(cap))
    by_limit = Window.orderBy(F.col("fill"), F.col("position"))
    upto = by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("fill", limit / F.col("weight"))
        .withColumn("full", F.sum(limit).over(upto) - limit)  # words of the sources before, all full
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", F.greatest(F.lit(0.0), (F.col("all") - F.col("full")) / F.col("open")))
        # the first source that the level leaves open fixes it for all after
        .withColumn("fixed", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "position", "level"))).over(everything))
    )
    capped = F.col("fixed").isNull() | (F.struct("fill", "position") < F.struct("fixed.fill", "fixed.position"))
    return levels.select("source", "source_size", F.when(capped, limit).otherwise(F.least(limit, F.col("fixed.level") * F.col("weight"))).alias("target"))


def size_weight(size: str) -> Column:
    """2^(bits of the size div 2)."""
    return F.pow(F.lit(2.0), F.expr(f"cast(length(bin({size})) div 2 AS double)"))


def inclusion_odds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, certain, left, weight, odds): for each weight of a source the odds of inclusion; null odds are certain.

    The heaviest weights whose p would pass 1 get 1; the first one, from the heaviest, that stays under it fixes L for all after.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumn("certain", F.floor(rate + F.lit(1e-9)).cast("bigint")).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))).withColumnRenamed("source", "of")
    classes = sizes.where("size > 0").groupBy("source", "weight").agg(F.sum("size").cast("double").alias("words"))
    by = Window.partitionBy("source").orderBy(F.desc("weight"))
    heavier = F.sum("words").over(by) - F.col("words")
    share = F.col("words") * F.col("weight")
    lighter = F.sum(share).over(Window.partitionBy("source")) - F.sum(share).over(by) + share
    c = classes.join(t, F.col("source").eqNullSafe(F.col("of"))).withColumn("level", (F.col("left") - heavier) / lighter)
    fits = F.when(F.col("level") * F.col("weight") < 1, F.struct((-F.col("weight")).alias("w"), F.col("level").alias("level")))
    c = c.withColumn("fixed", F.min(fits).over(Window.partitionBy("source")))
    p = F.when(F.col("fixed").isNotNull() & (F.col("weight") <= -F.col("fixed.w")), F.greatest(F.lit(0.0), F.col("fixed.level") * F.col("weight")))
    return c.select("source", "source_size", "target", "certain", "left", "weight", (p / (F.lit(1.0) - p)).alias("odds"))


def sample_copies(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, hash, copy, source, size, source_size, target, copies) from (doc_id, hash, copy, source, size, weight)."""
    odds = materialise(inclusion_odds(sizes, targets), "mix-odds").withColumnsRenamed({"source": "of", "weight": "w"})
    u = unit(*ROW, seed=seed)
    drawn = sizes.where("size > 0").join(odds, F.col("source").eqNullSafe(F.col("of")) & (F.col("weight") == F.col("w"))).drop("of", "w", "weight")
    key = F.when(F.col("left") <= 0, F.lit(None)).when(F.col("odds").isNull(), F.lit(0.0)).when(F.col("odds") > 0, (u / (F.lit(1.0) - u)) / F.col("odds"))
    rows = drawn.withColumn("key", key.cast("double"))
    # key / (1 + key) lies in (0, 1) and keeps the order
    rows = materialise(rows.withColumn("bin", F.floor(F.col("key") / (F.lit(1.0) + F.col("key")) * F.lit(float(BINS * BINS))).cast("int")), "mix-keys")
    keyed = rows.where(F.col("key").isNotNull())
    crossing = _crossing(keyed.withColumn("at", F.expr(f"bin div {BINS}")).withColumn("start", F.lit(0).cast("bigint")))
    inside = _within(keyed.withColumn("at", F.expr(f"bin div {BINS}")), crossing)
    crossing = _crossing(inside.withColumn("at", F.col("bin")))
    inside = _within(keyed.withColumn("at", F.col("bin")), crossing)
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "hash", "copy")
    fitting = inside.withColumn("sum", F.col("start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    name = F.struct("key", *ROW)
    fits = F.col("sum") <= F.col("left")
    cut = fitting.groupBy("source").agg(F.max(F.when(fits, name)).alias("last"), F.max(F.when(fits, F.col("sum"))).alias("sum"), F.max("start").alias("start"), F.max("at").alias("at"), F.max("left").alias("left"))
    cut = materialise(cut.select(F.col("source").alias("of"), "last", (F.col("left") - F.coalesce("sum", "start")).alias("gap"), "at"), "mix-cut")
    placed = keyed.withColumn("name", name).join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # a source without a crossing takes all of its sample
    taken = F.col("at").isNull() | (F.col("bin") < F.col("at")) | ((F.col("bin") == F.col("at")) & F.coalesce(F.col("name") <= F.col("last"), F.lit(False)))
    placed = placed.withColumn("taken", taken)
    closing = placed.where(~F.col("taken") & (F.col("size") < 2 * F.col("gap"))).groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("d"), "name")).alias("c"))
    closing = materialise(closing.select(F.col("source").alias("of"), F.col("c.name").alias("closing")), "mix-closing")
    done = placed.join(closing, F.col("source").eqNullSafe(F.col("of")), "left").select(*ROW, "source", "size", "source_size", "target", (F.col("certain") + (F.col("taken") | F.coalesce(F.col("name") == F.col("closing"), F.lit(False))).cast("bigint")).alias("copies"))
    rest = rows.where(F.col("key").isNull()).select(*ROW, "source", "size", "source_size", "target", F.col("certain").alias("copies"))
    t = targets.withColumnRenamed("source", "of")
    blank = sizes.where("size = 0").join(t, F.col("source").eqNullSafe(F.col("of"))).select(*ROW, "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("copies"))
    return done.unionByName(rest).unionByName(blank)


def _crossing(rows: DataFrame) -> DataFrame:
    """(of, crossed, from): for each source the bin `at` where the words taken pass what is left, and the words before it."""
    bins = rows.groupBy("source", "at").agg(F.sum("size").alias("words"), F.max("left").alias("left"), F.max("start").alias("start"))
    upto = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy("at"))
    found = bins.withColumn("upto", upto).where((F.col("upto") - F.col("words") <= F.col("left")) & (F.col("upto") > F.col("left")))
    return materialise(found.select(F.col("source").alias("of"), F.col("at").alias("crossed"), (F.col("upto") - F.col("words")).alias("from")), "mix-crossing")


def _within(rows: DataFrame, crossing: DataFrame) -> DataFrame:
    """The rows of the crossing bins, with the words before them as `start`."""
    return rows.join(crossing, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("crossed"))).withColumn("start", F.col("from")).drop("of", "crossed", "from")


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP, seed: int = 0, weight: str | None = None) -> DataFrame:
    """doc_id, hash, copy, source, size, source_size, target, copies of each row of docs (doc_id, text, source)."""
    own = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
    rows = docs.select("doc_id", "source", _hash("text").alias("hash"), _size("text").alias("size"), own.alias("weight"))
    alike = rows.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    sizes = alike.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("weight", F.coalesce("weight", size_weight("size"))).drop("n")
    sizes = materialise(sizes, "mix-sizes")
    targets = materialise(source_targets(sizes, weights, cap), "mix-targets")
    return sample_copies(sizes, targets, seed)


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP, seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Rows with equal doc_id, source and text share what the mix takes of them: copies that all get, and one more for the first of them in the order of the other columns.
    """
    counts = mix(docs, weights, cap, seed).groupBy("doc_id", "source", "hash").agg(F.count("*").alias("rows"), F.min("copies").alias("all"), F.sum("copies").alias("sum"))
    c = materialise(counts.where("sum > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("hash").alias("__of"), F.col("rows").alias("__rows"), F.col("all").alias("__all"), (F.col("sum") - F.col("all") * F.col("rows")).alias("__more")), "mix-counts")
    hashed = docs.withColumn("__hash", _hash("text"))
    joined = hashed.join(c, hashed["doc_id"].eqNullSafe(c["__id"]) & hashed["source"].eqNullSafe(c["__source"]) & (F.col("__hash") == F.col("__of")))
    once = joined.where("__rows = 1").withColumn("__n", F.col("__all") + F.col("__more"))
    alike = joined.where("__rows > 1").groupBy(*docs.columns, "__hash", "__all", "__more").agg(F.count("*").alias("__same"))
    before = F.sum("__same").over(Window.partitionBy("doc_id", "source", "__hash").orderBy(*[F.col(x) for x in docs.columns if x not in ("doc_id", "source", "text")])) - F.col("__same")
    several = alike.withColumn("__n", F.col("__same") * F.col("__all") + F.greatest(F.lit(0), F.least(F.col("__same"), F.col("__more") - before)))
    both = once.select(*docs.columns, "__n").unionByName(several.select(*docs.columns, "__n")).where("__n > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)
