"""SimHash near-duplicates: fingerprints, links within a Hamming radius, components.

Fingerprints are made where the texts lie; only (doc_id, fingerprint) is kept. Equal fingerprints
become one node, so thousands of copies cost one row from there on.

Links: the 64 bits are cut into `blocks` parts; two fingerprints within the radius agree in full on
at least blocks - radius of them, so each node goes to one shard for each choice of that many
parts, keyed by their bits. Every shard becomes a BK-tree (a child hangs at its Hamming distance from the
parent; a search follows only edges within the radius of the distance to the node), searched by
its own members and freed when the shard is done. No tree is sent to the driver or to all machines.
More nodes get more parts, which keeps shards small at any size; the links found are the same. A shard
above `shard_rows` is dealt as pairs of slices, each pair one tree and one set of searches, so a hot
shard is many bounded tasks. A shard reports only the links that join its parts (a spanning forest).

A tree over all fingerprints, or trees broadcast in rounds, would have every fingerprint searched in every tree: with 64 bits most distances lie
near 32, so a search within 4 follows most edges (README has figures). Hence trees of shards, each met by its own members only.

Components: alternating large-star and small-star rounds of DataFrame joins, each written to the
shared folder, until the links no longer change.

A fingerprint with a HOT share of all rows, or a component with one of all fingerprints, is one of at most 1 / HOT such: those
are broadcast, so their rows are joined where they lie; all others are joined by a shuffle in which no key has more than that share.

Defined cases: null and empty texts have fingerprint 0 and link like any other; rows with a null
doc_id get a fingerprint and belong to a component, but are never its id unless all its doc_ids
are null; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, materialise, parts

RADIUS = 4
SHINGLE = 4
SHARD_ROWS = 2048
#: The share of rows from which a key counts as hot; there are 1 / HOT of them at most.
HOT = 0.001
#: Rows of (fingerprint, shard) that one task takes.
TASK_ROWS = 2_000_000
_BITS = (1 << 64) - 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of the word shingles of one text in UTF-8, unsigned."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # bounds memory on very long texts
        h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", text: str = "text") -> DataFrame:
    """docs without the text, with its fingerprint as a signed bigint."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    schema = T.StructType([*[f for i, f in enumerate(docs.schema.fields) if i != at], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x) for x in b.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array(found)], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


class BKTree:
    """Values by Hamming distance: each child hangs at its distance from its parent. Signed values count as their 64 bits."""

    def __init__(self, values: list[int]):
        self.values = values = [v & _BITS for v in values]
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while (nxt := self.children[at].get(d := (values[at] ^ v).bit_count())) is not None:
                at = nxt
            self.children[at][d] = i

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indexes of the values at most radius away."""
        value &= _BITS
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if -radius <= edge - d <= radius:
                    todo.append(child)


def _forest(tree: list[int], queries: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links (small, large) that join what lies within the radius; queries: searched in the tree, else its own values."""
    index, root = BKTree(tree), {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for q in tree if queries is None else queries:
        for i in index.within(q, radius):
            if (v := tree[i]) != q and (a := find(q)) != (b := find(v)):
                root[a] = b
                yield min(q, v), max(q, v)


def _parts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of the parts of 64 bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def plan_blocks(nodes: int, radius: int = RADIUS) -> int:
    """Parts to cut into: the fewest that leave an evenly filled shard 256 nodes or fewer."""
    for blocks in range(radius + 1, radius + 4):
        width = sum(sorted(w for _, w in _parts(blocks))[: blocks - radius])
        if nodes <= 256 << width:
            return blocks
    return radius + 4


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, blocks: int | None = None) -> DataFrame:
    """(a, b), a < b as signed numbers: links that join all distinct values of nodes.fp within the radius."""
    nodes = nodes.select("fp")
    n = nodes.count()
    blocks = blocks or plan_blocks(n, radius)
    cuts = _parts(blocks)
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key, width = F.lit(0).cast("bigint"), 0
        for c in chosen:
            shift, w = cuts[c]
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << w) - 1)), width))
            width += w
        keys.append(F.struct(F.lit(k).alias("t"), key.alias("key")))
    spread = nodes.select("fp", F.explode(F.array(*keys)).alias("s")).select("fp", "s.t", "s.key")
    large = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # shards of one node find nothing; others get the number of their slices
    dealt = spread.join(large.withColumnRenamed("t", "t_").withColumnRenamed("key", "key_"), (F.col("t") == F.col("t_")) & (F.col("key") == F.col("key_"))).select("fp", "t", "key", F.ceil(F.col("n") / F.lit(shard_rows)).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = dealt.withColumn("own", own).select("fp", "t", "key", "own", F.explode(pairs).alias("p")).select("fp", "t", "key", "own", "p.i", "p.j")
    count = parts(nodes.sparkSession, n * len(keys), TASK_ROWS)
    dealt = dealt.repartition(count, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard; a shard's tree holds 2 * shard_rows values or so."""
        shard, first, second, out = None, [], [], []

        def close() -> None:
            if shard is None:
                return
            found = _forest(first, None if shard[2] == shard[3] else second, radius)
            out.extend(found)

        def flush() -> pa.RecordBatch:
            rows = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for fp, t, key, own_, i, j in zip(*cols, strict=True):
                if (t, key, i, j) != shard:
                    close()
                    shard, first, second = (t, key, i, j), [], []
                (first if own_ == i else second).append(fp)
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that (a, b) links lead to; nodes without links are absent."""
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the least of u's neighbourhood
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = materialise(large, "links")
        # small star: u and its neighbours below go to the least of them
        small_low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "w")
        joined = large.join(small_low, F.col("b") == F.col("w"))
        e = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        e = materialise(e, "links")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = tuple(state)


def _join_hot(rows: DataFrame, key: str, known: DataFrame, named: str, size: str, total: int) -> DataFrame:
    """rows joined with known (one row for each value of `named`) on key = named. size: rows that a value has, of total.

    Values of at least HOT * total rows, 1 / HOT at most, are broadcast.
    """
    hot = F.col(size) >= F.lit(max(1.0, HOT * total))
    few = known.where(hot).drop(size)
    names = few.select(F.col(named).alias("__hot"))
    often = rows.join(F.broadcast(few), F.col(key) == F.col(named))
    seldom = rows.join(F.broadcast(names), F.col(key) == F.col("__hot"), "left_anti").join(known.where(~hot).drop(size), F.col(key) == F.col(named))
    return often.unionByName(seldom)


def _classes(prints: DataFrame, radius: int, shard_rows: int) -> tuple[DataFrame, int]:
    """(__fp, __rows, root, component_id) of each distinct prints.fp, from (doc_id, fp); and how many rows prints has."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    total, count = nodes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    roots = materialise(components(links(nodes, radius, shard_rows)), "roots")
    alone = nodes.join(roots, F.col("fp") == F.col("node"), "left_anti").select(F.col("fp").alias("__fp"), F.col("rows").alias("__rows"), F.col("fp").alias("root"), F.col("least").alias("component_id"))
    # the smallest node of a component is its root and has no row of its own among roots
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = materialise(nodes.join(linked, F.col("fp") == F.col("node")).select("fp", "rows", "least", "root"), "linked")
    alone = alone.join(linked.select(F.col("fp").alias("__linked")), F.col("__fp") == F.col("__linked"), "left_anti")
    ids = materialise(linked.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "component-ids")
    known = _join_hot(linked, "root", ids, "of", "size", count).select(F.col("fp").alias("__fp"), F.col("rows").alias("__rows"), "root", "component_id")
    return materialise(alone.unionByName(known), "classes"), total


def link_documents(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs (doc_id, text)."""
    prints = materialise(with_fingerprint(docs.select("doc_id", "text")), "fingerprints")
    classes, total = _classes(prints, radius, shard_rows)
    return _join_hot(prints, "fp", classes, "__fp", "__rows", total).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component, with the columns of docs: that with the smallest doc_id (null last), fingerprint and text hash.

    Of rows that share doc_id and text, the one with the smallest values in the other columns stays.
    """
    text = F.coalesce(F.md5("text"), F.lit(""))  # null and empty texts differ here
    prints = materialise(with_fingerprint(docs.select("doc_id", "text", text.alias("hash"))), "fingerprints")
    counted = prints.groupBy("doc_id", "fp", "hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "hash", "n"))
    classes, total = _classes(prints, radius, SHARD_ROWS)
    kept = _join_hot(counted, "fp", classes, "__fp", "__rows", total).groupBy("root").agg(first.alias("k"))
    kept = materialise(kept.select("root", "k.doc_id", "k.hash", "k.n"), "kept")
    k = kept.select(F.col("root").alias("__root"), F.col("doc_id").alias("__id"), F.col("hash").alias("__kept_hash"), F.col("n").alias("__n"))
    # the same text has the same fingerprint and so one component
    rows = docs.withColumn("__hash", text)
    rows = rows.join(k, docs["doc_id"].eqNullSafe(k["__id"]) & (F.col("__hash") == F.col("__kept_hash")))
    once = rows.where("__n = 1").select(*docs.columns)
    twice = rows.where("__n > 1").groupBy("__root").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(twice)


def hexadecimal(fp: str) -> F.Column:
    """16 lowercase hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
