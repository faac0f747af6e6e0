"""Exact copies, found by counting quotient filters and verified byte by byte.

1. Every text, each run of ASCII white space made one space, gets a fingerprint of 64 bits (XXH64) and its SHA-256, where it lies. These narrow rows
   are a table in the shared folder; texts aren't.
2. Every partition builds counting quotient filters of its fingerprints, one for each shard of the fingerprints' range. A filter of quotient q and remainder r
   bits loses nothing: slot and remainder give the fingerprint back. The filters of a shard merge by their sorted remainders, counts
   added. Shards grow in number with the rows, and a fingerprint that a third of all rows share is one remainder and a counter.
3. Fingerprints with a count above one route to verification: the texts that have them are read again and grouped by the bytes of the whole text, with
   partial sums where they lie, so a text moves once from each task however many copies it has. What shares a fingerprint only is told apart here.
   Up to MOST_BROADCAST such fingerprints travel to the texts; beyond, they are joined by a shuffle after the partial grouping of texts.
4. The verified classes join the narrow rows.

Defined cases: a null text counts as empty; of equal texts the smallest doc_id stays, null ids after all others, and of rows that repeat that id one
stays; if all ids of a class are null keep_id is null; an empty table gives an empty result; further columns of the input aren't looked at. Two
different texts of equal XXH64 and equal SHA-256 would be an error, which is raised, not a merged class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, bounded_batches, materialise, parts

#: Fingerprints of one filter before it is closed; distinct fingerprints of a shard, about; share of a filter's slots that are filled, at most.
FILTER_ROWS, SHARD_ROWS, LOAD = 1 << 20, 1 << 20, 0.9
MOST_BROADCAST = 1 << 20
BITS = 64


def normal(text: str) -> Column:
    """The text with each run of ASCII white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


class QuotientFilter:
    """A counting quotient filter of `bits`-bit fingerprints, built from sorted distinct ones and their counts.

    A fingerprint's high bits, its quotient, say where its run of slots would like to begin; the run holds the remainders in order. As in linear probing a run
    begins later if the one before has not ended. One bit a quotient tells that it has a run, one bit a slot that a run ends in it; the k-th
    quotient with a run owns the run that ends at the k-th such slot. A remainder that occurs more than once is followed by slots with the digits of its count less one,
    lowest first, which a third bit vector tells from remainders.
    """

    def __init__(self, bits: int, remainder_bits: int, slots: np.ndarray, occupied: np.ndarray, ends: np.ndarray, digit: np.ndarray):
        self.bits, self.remainder_bits = bits, remainder_bits
        self.slots, self.occupied, self.ends, self.digit = slots, occupied, ends, digit

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """prints: sorted distinct fingerprints under 2^bits; remainders take whole bytes."""
        need = max(1, int(np.ceil(np.log2(max(1, len(prints)) / LOAD))))
        remainder = max(8, -(-(bits - need) // 8) * 8 - 8 if (bits - need) % 8 else bits - need)
        quotient = max(1, bits - remainder)
        more = [counts - 1]  # what is left of a count as its digits are written
        digits = np.zeros(len(prints), np.int64)
        while (more[-1] > 0).any():
            digits += more[-1] > 0
            more.append(more[-1] >> np.int64(min(remainder, 62)))
        size = 1 + digits
        first = np.cumsum(size) - size
        n = int(size.sum())
        own = (prints >> np.uint64(remainder)).astype(np.int64) if remainder < 64 else np.zeros(len(prints), np.int64)
        value, digit = np.zeros(n, np.uint64), np.ones(n, bool)
        mask = np.uint64((1 << remainder) - 1)
        value[first], digit[first] = prints & mask, False
        for k, left in enumerate(more[:-1]):
            has = digits > k
            value[first[has] + 1 + k] = left[has].astype(np.uint64) & mask
        of = np.repeat(own, size)
        place = np.arange(n) + np.maximum.accumulate(of - np.arange(n)) if n else np.zeros(0, np.int64)
        length = max(1 << quotient, int(place[-1]) + 1 if n else 0)
        slots, ends, counter, occupied = np.zeros(length, np.uint64), np.zeros(length, bool), np.zeros(length, bool), np.zeros(1 << quotient, bool)
        slots[place], counter[place], occupied[own] = value, digit, True
        ends[place[np.r_[of[1:] != of[:-1], True]] if n else []] = True
        return cls(bits, remainder, slots, occupied, ends, counter)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotient, first slot and last slot of each run."""
        quotients, last = np.flatnonzero(self.occupied), np.flatnonzero(self.ends)
        return quotients, np.maximum(quotients, np.r_[-1, last[:-1]] + 1) if len(last) else last, last

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        quotients, first, last = self.runs()
        length = last - first + 1
        at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        value, digit = self.slots[at], self.digit[at]
        heads = np.flatnonzero(~digit)
        prints = (np.repeat(quotients, length)[heads].astype(np.uint64) << np.uint64(self.remainder_bits)) | value[heads]
        counts = np.ones(len(heads), np.int64)
        number, step = np.cumsum(~digit) - 1, np.arange(len(at)) - heads[np.cumsum(~digit) - 1] if len(heads) else np.zeros(0, np.int64)
        np.add.at(counts, number[digit], value[digit].astype(np.int64) << ((step[digit] - 1) * self.remainder_bits))
        return prints, counts

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was put in: its quotient's run is found by rank and select, then searched."""
        quotient, remainder = fingerprint >> self.remainder_bits, fingerprint & ((1 << self.remainder_bits) - 1)
        if not self.occupied[quotient]:
            return 0
        k = int(self.occupied[:quotient].sum())
        _, first, last = self.runs()
        at = first[k]
        while at <= last[k]:
            counted, shift, head = 1, 0, at
            at += 1
            while at <= last[k] and self.digit[at]:
                counted += int(self.slots[at]) << shift
                shift += self.remainder_bits
                at += 1
            if int(self.slots[head]) == remainder:
                return counted
        return 0

    def pack(self) -> bytes:
        head = np.array([self.bits, self.remainder_bits, len(self.occupied), len(self.slots)], "<i8").tobytes()
        raw = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.remainder_bits // 8].tobytes()
        return b"".join([head, *[np.packbits(x).tobytes() for x in (self.occupied, self.ends, self.digit)], raw])

    @classmethod
    def unpack(cls, blob: bytes) -> QuotientFilter:
        bits, remainder, quotients, length = (int(x) for x in np.frombuffer(blob, "<i8", 4))
        at, found = 32, []
        for n in (quotients, length, length):
            found.append(np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        wide = np.zeros((length, 8), np.uint8)
        wide[:, : remainder // 8] = np.frombuffer(blob, np.uint8, length * remainder // 8, at).reshape(length, -1)
        return cls(bits, remainder, wide.reshape(-1).view("<u8").astype(np.uint64), *found)

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Their sorted runs in one, counts of equal fingerprints added."""
        items = [f.items() for f in filters]
        prints, counts = (np.concatenate(x) for x in zip(*items, strict=True))
        return cls.build(*added(prints, counts), filters[0].bits)


def added(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with their counts added."""
    by = np.argsort(prints, kind="stable")
    prints, counts = prints[by], counts[by]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def partition_filters(prints: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, filter): the filters of each partition, of FILTER_ROWS rows at most; prints: (fp) as signed 64 bits."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        shard = (values >> np.uint64(BITS - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(values), np.int64)
        rest = values & np.uint64((1 << (BITS - shard_bits)) - 1)
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        made = [QuotientFilter.build(rest[i:j], counts[i:j], BITS - shard_bits).pack() for i, j in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int64()), pa.array(made, pa.binary())], names=["shard", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= FILTER_ROWS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return prints.mapInArrow(run, "shard bigint, filter binary")


def repeated(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n): the fingerprints that occur more than once, from the merged filters."""
    spark = prints.sparkSession
    shard_bits = min(32, max(0, parts(spark, rows, SHARD_ROWS) - 1).bit_length())

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        values, counts = QuotientFilter.merge([QuotientFilter.unpack(x) for x in frame["filter"]]).items()
        more = counts > 1
        shard = np.uint64(int(frame["shard"].iloc[0]) << (BITS - shard_bits) if shard_bits else 0)
        return pd.DataFrame({"fp": (values[more] | shard).view(np.int64), "n": counts[more]})

    return partition_filters(prints, shard_bits).groupBy("shard").applyInPandas(merge, "fp bigint, n bigint")


def verified(docs: DataFrame, twice: DataFrame, text: str = "text") -> DataFrame:
    """(fp, hash, keep_id, group_size): classes of docs with equal bytes, among those whose fingerprint occurs more than once."""
    texts = docs.select("doc_id", normal(text).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("fp"))
    few = twice.count() <= MOST_BROADCAST
    some = twice.select(F.col("fp").alias("of"))
    if few:  # 8 bytes each
        texts = texts.join(F.broadcast(some), F.col("fp") == F.col("of"), "left_semi")
    classes = texts.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    if not few:
        classes = classes.join(some, F.col("fp") == F.col("of"), "left_semi")
    classes = classes.select("fp", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("hash"), "keep_id", "group_size").groupBy("fp", "hash").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    same = F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts with equal XXH64 and SHA-256"))).otherwise(F.col("group_size"))
    return classes.select("fp", "hash", "keep_id", same.alias("group_size"))


def mark_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    read = docs.select("doc_id", normal(text).alias("t")).select("doc_id", F.xxhash64("t").alias("fp"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("hash"))
    narrow = materialise(read.withColumn("row", F.monotonically_increasing_id()), "copies-prints")
    twice = materialise(repeated(narrow.select("fp"), narrow.count()), "copies-repeated")
    classes = materialise(verified(docs, twice, text), "copies-classes")
    of = classes.select(F.col("fp").alias("of"), F.col("hash").alias("of_hash"), "keep_id", "group_size")
    marked = narrow.join(of, (F.col("fp") == F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    marked = materialise(marked.select("row", "doc_id", "hash", F.col("of").isNotNull().alias("some"), "fp", "keep_id", "group_size"), "copies-marked")
    # rows that repeat the id that stays: one of them
    stays = marked.where(F.col("some") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("fp", "hash").agg(F.min("row").alias("stays")).select("stays")
    done = marked.join(stays, F.col("row") == F.col("stays"), "left")
    return done.select(
        "doc_id",
        F.when(F.col("some"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (~F.col("some") | F.col("stays").isNotNull()).alias("kept"),
        F.lower(F.hex("hash")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs; doc_ids that aren't null are those of one document each."""
    kept = mark_copies(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("__id"), "left_semi")
