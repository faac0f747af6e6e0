"""Language-model scores by prediction by partial matching over the bytes of whole documents.

A text is read as its lower-cased (A-Z) words, a blank after each, and an end mark. Every byte is coded after the ORDER bytes
before it, over word borders; before a text's first byte stand end marks. Contexts form a trie by their last bytes: that of order
k is cut to its last k bytes. Counts are pretrained on the training texts.

Escape estimation is secondary (SEE): how often contexts like this one (order, whether entered by an escape, size, symbols)
met a symbol that was new to them, counted over all training positions with the position itself left out.
A symbol with count c of n has (1 - escape) * c / n; the rest goes to the context one byte shorter. Symbols
that the longer context has seen are excluded there. They are a subset of the shorter context's symbols,
so what exclusion takes off is a sum per context, not per path. Below order 0 all symbols left are equally likely.

Steps: texts become chunks of bounded size. A chunk numbers its distinct (context, symbol) pairs and tokens, with counts over its
training texts, and deals them into buckets as packed arrays, one row a bucket. Rows of a bucket are merged FAN at a time until there is one;
a bucket holds whole contexts from order KEY up, as it is chosen by their last KEY bytes, and orders below KEY (at most 2^24 counts) are a broadcast.
Each bucket learns escapes, then scores its pairs once. Every chunk row of a bucket is answered by numbers in its own order, FAN rows a
task, and the chunk adds them up by document. So what is shuffled are packed distinct pairs; a frequent phrase is one of them
in each chunk, and no task sees a number of rows that grows with the corpus.

Defined cases: a null text is empty and has the end mark only; a null doc_id counts as the empty text in the split;
without training tokens the model is uniform over symbols and base_score is null; repeated rows count and are scored
each; further columns of the input are not looked at. A chunk holds at least one text, so memory grows with the longest one.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise

#: Bytes of context; with the symbol they are packed in 64 bits.
ORDER = 6
#: Last bytes of a context by which pairs are dealt.
KEY = 3
#: Text bytes after which a chunk is closed, and text bytes for each bucket of pairs and of tokens.
CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Text bytes of which the positions are held at once.
BLOCK_BYTES = 1 << 20
#: Distinct codes of blocks that wait to be merged.
HELD = 1 << 20
#: Most buckets of either kind. Distinct pairs of natural text grow slower than the text; beyond this many buckets they grow instead, and with them a task's memory.
MOST_BUCKETS = 4096
#: Rows of a bucket that one task merges or answers.
FAN = 256
#: What follows a word (no word has it), and the end mark, a token b"\\n".
STOP, END = b" ", b"\n"
#: Symbols: 256 bytes less six that no word has, the stop, the end mark.
SYMBOLS = 252
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

CHUNKS = "chunk string, ids binary, texts binary"
PACKED = "chunk string, kind int, bucket int, keys binary, counts binary"
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def is_held_out(doc_id: object, modulus: int = 10, remainder: int = 0) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 3)


def unpack(blob: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte of all, which compresses best."""
    steps = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_tokens(tokens: list[bytes]) -> bytes:
    return zstandard.compress(END.join(tokens), 3)  # the end mark, which is no word, goes as the empty string


def unpack_tokens(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(END)


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def make_chunks(docs: DataFrame) -> DataFrame:
    """Rows of CHUNKS from docs (doc_id, text): ids and whether they are null and held out, and the texts' words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            head = np.array([[0 if i is None else i, i is None, is_held_out(i)] for i in ids], np.int64)
            row = [uuid.uuid4().hex, pack(head), zstandard.compress(END.join(texts), 3)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "ids", "texts"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(STOP.join(normal_words(text)))
                size += len(text or b"")
                if size >= CHUNK_BYTES:
                    yield close()
                    ids, texts, size = [], [], 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS)


def tagged(texts: list[bytes], tags: np.ndarray) -> np.ndarray:
    """Ascending, a number for each byte to code: the context, its last byte highest, then the symbol, then the tag (a byte) of its text."""
    bodies = [END * ORDER + t + (STOP if t else b"") + END for t in texts]
    lengths = np.array([len(x) for x in bodies])
    at = np.ones(lengths.sum(), bool)
    at[((np.cumsum(lengths) - lengths)[:, None] + np.arange(ORDER)).ravel()] = False
    # eight bytes up to each position, the last one highest
    eight = np.ndarray(len(at), "<u8", bytes(7) + b"".join(bodies), strides=(1,))[at]
    out = (eight << np.uint64(8)) & np.uint64(0xFFFFFFFFFFFF0000)
    out |= (eight >> np.uint64(56)) << np.uint64(8)
    out |= np.repeat(tags.astype(np.uint64), lengths - ORDER)
    out.sort()
    return out


def codes_of(keys: np.ndarray) -> np.ndarray:
    """A code is the context, its last byte highest, and the symbol in the lowest byte."""
    return (keys & np.uint64(0xFFFFFFFFFFFF0000)) | ((keys >> np.uint64(8)) & np.uint64(255))


def first_of_each(ascending: np.ndarray) -> np.ndarray:
    """Where each distinct number begins."""
    new = np.ones(len(ascending), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    return np.flatnonzero(new)


def blocks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of at most `most` texts, of BLOCK_BYTES or so."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 2
        if size >= BLOCK_BYTES or k - first == most - 1 or k == len(texts) - 1:
            yield first, k + 1
            first, size = k + 1, 0


def count_pairs(texts: list[bytes], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a chunk, ascending, and how often each stands in the texts to learn."""
    codes, counts, held = [], [], 0
    for i, j in blocks(texts, len(texts)):
        keys = tagged(texts[i:j], learn[i:j])
        starts = first_of_each(keys >> np.uint64(8))
        codes.append(codes_of(keys[starts]))
        counts.append(np.add.reduceat((keys & np.uint64(255)).astype(np.uint32), starts).astype(np.uint32))
        held += len(starts)
        if held > 2 * len(codes[0]) + HELD or j == len(texts):
            code, c = _summed(np.concatenate(codes), np.concatenate(counts))
            codes, counts, held = [code], [c.astype(np.uint32)], len(code)
    return codes[0], counts[0].astype(np.int64)


def pair_scores(texts: list[bytes], answers: dict, buckets: int) -> np.ndarray:
    """The sum over each text's positions of what the buckets answer for their codes."""
    # blocks are made twice, as all of a chunk's positions would take eight bytes each
    codes, _ = count_pairs(texts, np.zeros(len(texts), bool))
    logp = np.empty(len(codes))
    for k, at in _by_bucket(pair_buckets(codes, buckets)):
        logp[at] = unpack(answers[PAIRS, k], np.float32)
    sums = []
    for i, j in blocks(texts, 256):  # a byte tells them apart
        keys = tagged(texts[i:j], np.arange(j - i))
        starts = first_of_each(keys >> np.uint64(8))
        each = np.repeat(logp[np.searchsorted(codes, codes_of(keys[starts]))], np.diff(starts, append=len(keys)))
        sums.append(np.bincount((keys & np.uint64(255)).astype(np.int64), each, j - i))
    return np.concatenate(sums)


def number_tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A chunk's distinct tokens in the order of their first use, after the end mark; each position's number; and how many each text has."""
    index: defaultdict[bytes, int] = defaultdict(count(1).__next__, {b"": 0})
    numbers = array("L")
    lengths = np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = t.split(STOP) if t else []
        numbers.extend(map(index.__getitem__, words))
        numbers.append(0)
        lengths[k] = len(words) + 1
    return list(index), np.frombuffer(numbers, np.int64), lengths


def pair_buckets(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(codes >> np.uint64(64 - 8 * KEY)) % np.uint64(buckets)).astype(np.int64)


def token_buckets(tokens: list[bytes], buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in tokens], np.int64) % buckets


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _open(ids: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes]]:
    return unpack(ids).reshape(-1, 3), zstandard.decompress(texts).split(END)


#: Kinds of packed rows.
PAIRS, TOKENS = 0, 1


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the indexes in it, ascending."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
        yield name, rows


def deal(chunks: DataFrame, buckets: int) -> DataFrame:
    """Rows of PACKED: the distinct pairs and tokens of each chunk with their counts over training texts, one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids, texts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                head, split = _open(ids, texts)
                learn = head[:, 2] == 0
                codes, pairs = count_pairs(split, learn)
                rows = [(PAIRS, k, pack_sorted(codes[at]), pack(pairs[at])) for k, at in _by_bucket(pair_buckets(codes, buckets))]
                names, number, lengths = number_tokens(split)
                tokens = np.bincount(number[np.repeat(learn, lengths)], minlength=len(names))
                rows += [(TOKENS, k, pack_tokens([names[i] for i in at]), pack(tokens[at])) for k, at in _by_bucket(token_buckets(names, buckets))]
                for some in range(0, len(rows), 500):
                    columns = list(zip(*rows[some : some + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(columns[0])), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["chunk", "kind", "bucket", "keys", "counts"])

    return chunks.mapInArrow(run, PACKED)


def _summed(code: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, with their counts added up."""
    order = np.argsort(code, kind="stable")
    code, c = code[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[at], np.add.reduceat(c, at)


def _merged_tokens(blobs: list[bytes], counts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    tokens = [t for x in blobs for t in unpack_tokens(x)]
    number, found = pd.factorize(np.array(tokens, object))
    return found.tolist(), np.bincount(number, weights=np.concatenate([unpack(x) for x in counts]), minlength=len(found)).astype(np.int64)


def merge(packed: DataFrame, most: int) -> DataFrame:
    """One row of PACKED for each kind and bucket, its counts summed; at most FAN rows meet in a task. most: rows a bucket has at most."""

    def run(t: pa.Table) -> pa.Table:
        kind, bucket, keys, counts = (t.column(c).to_pylist() for c in ("kind", "bucket", "keys", "counts"))
        if kind[0] == PAIRS:
            code, c = _summed(np.concatenate([unpack_sorted(x) for x in keys]), np.concatenate([unpack(x) for x in counts]))
            row = pack_sorted(code), pack(c)
        else:
            tokens, c = _merged_tokens(keys, counts)
            row = pack_tokens(tokens), pack(c)
        return pa.table({"chunk": pa.array([uuid.uuid4().hex]), "kind": pa.array(kind[:1], pa.int32()), "bucket": pa.array(bucket[:1], pa.int32()), "keys": pa.array([row[0]], pa.binary()), "counts": pa.array([row[1]], pa.binary())})

    rows = packed
    while True:
        most = -(-most // FAN)
        rows = materialise(rows.groupBy("kind", "bucket", F.pmod(F.xxhash64("chunk"), F.lit(most))).applyInArrow(run, PACKED), "ppm-merged")
        if most == 1:
            return rows


class _Level:
    """Counts of (context, symbol) of one order, and what each context sums up to."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, c: np.ndarray):
        seen = c > 0
        order = np.lexsort((symbol[seen], context[seen]))
        ctx, sym, cnt = context[seen][order], symbol[seen][order], c[seen][order]
        new = np.ones(len(ctx), bool)
        new[1:] = (ctx[1:] != ctx[:-1]) | (sym[1:] != sym[:-1])
        at = np.flatnonzero(new)
        self.ctx, self.sym = ctx[at], sym[at]
        self.c = np.add.reduceat(cnt, at) if len(at) else cnt
        self.context, starts = np.unique(self.ctx, return_index=True)
        self.starts = starts
        self.n = np.add.reduceat(self.c, starts) if len(starts) else self.c
        self.d = np.diff(np.append(starts, len(self.ctx)))
        self.key = None

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each context, and whether it is there."""
        if not len(self.context):
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        i = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return i, self.context[i] == context

    def count(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The count of each (context, symbol)."""
        i, there = self.find(context)
        if not len(self.ctx):
            return np.zeros(len(context), np.int64)
        # contexts have at most 256 symbols: one number for both
        if self.key is None:
            self.key = np.repeat(np.arange(len(self.starts)), self.d) * 256 + self.sym
        key = i * 256 + symbol
        j = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(there & (self.key[j] == key), self.c[j], 0)


def _cut(context: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes of each context."""
    return context & np.uint64(0 if order == 0 else (0xFFFFFFFFFFFFFFFF << (8 * (8 - order))) & 0xFFFFFFFFFFFFFFFF)


#: Classes of contexts for escape estimation: order, entered by an escape, half octaves of n, octaves of d.
_N_CLASSES, _D_CLASSES = 40, 6
CLASSES = (ORDER + 1) * 2 * _N_CLASSES * _D_CLASSES


def _class(order: int, entered: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    n_class = np.minimum(np.floor(2 * np.log2(n)), _N_CLASSES - 1).astype(np.int64)
    d_class = np.minimum(np.floor(np.log2(d)), _D_CLASSES - 1).astype(np.int64)
    return ((order * 2 + entered) * _N_CLASSES + n_class) * _D_CLASSES + d_class


def walk(context: np.ndarray, symbol: np.ndarray, levels: dict[int, _Level], escapes: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Code each symbol after its context, from the longest context down. levels: counts by order, 0 to ORDER.

    With escapes (probability by class): log10 probability of each symbol. With weight (how often each row stands
    in the training texts) instead: (2, CLASSES) counts of escapes and of visits, each occurrence left out of the counts it meets.
    """
    symbol = symbol.astype(np.int64)
    learn = weight is not None
    score, open_ = np.zeros(len(context)), np.ones(len(context), bool)
    if learn:
        open_ = weight > 0
    met = np.zeros((2, CLASSES))
    excluded_n, excluded_d = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
    for k in range(ORDER, -1, -1):
        level, cut = levels[k], _cut(context, k)
        i, there = level.find(cut)
        rows = np.flatnonzero(open_ & there)
        if not len(rows):
            continue
        i, c = i[rows], level.count(cut[rows], symbol[rows])
        out = 1 if learn else 0  # the occurrence that is left out
        n, d = level.n[i] - out - excluded_n[rows], level.d[i] - (out & (c == 1)) - excluded_d[rows]
        left = n > 0  # else every symbol of this context is excluded: it says nothing
        hit, miss = left & (c > out), left & (c <= out)
        group = np.zeros(len(rows), np.int64)
        group[left] = _class(k, (excluded_d[rows[left]] > 0).astype(np.int64), n[left], np.maximum(d[left], 1))
        if learn:
            met[0] += np.bincount(group[miss], weight[rows[miss]], CLASSES)
            met[1] += np.bincount(group[left], weight[rows[left]], CLASSES)
        else:
            score[rows[hit]] += np.log10((1 - escapes[group[hit]]) * c[hit] / n[hit])
            score[rows[miss]] += np.log10(escapes[group[miss]])
        open_[rows[hit]] = False
        seen_out = out & (c == 1)
        if k == 0:
            excluded_d[rows] = level.d[i] - seen_out
            continue
        # what this context has seen is excluded in the shorter one
        below = levels[k - 1]
        taken = np.add.reduceat(below.count(_cut(level.ctx, k - 1), level.sym), level.starts)[i]
        if learn:  # a symbol that only the position itself has put here is not excluded
            taken = taken - np.where(c == 1, below.count(_cut(context[rows], k - 1), symbol[rows]), 0)
        excluded_n[rows], excluded_d[rows] = taken, level.d[i] - seen_out
    if learn:
        return met
    score[open_] -= np.log10(np.maximum(1, SYMBOLS - excluded_d[open_]))
    return score


def escape_probabilities(met: np.ndarray) -> np.ndarray:
    """By class, from (2, CLASSES) escapes and visits; classes never met get 1/2."""
    return (met[0] + 0.5) / (met[1] + 1.0)


def _split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return code & np.uint64(0xFFFFFFFFFFFFFF00), (code & np.uint64(255)).astype(np.int64)


def score_pairs(merged: DataFrame) -> DataFrame:
    """(bucket, keys, scores): the log10 probability of each pair of merged, one row a bucket."""
    spark = merged.sparkSession
    pairs = merged.where(F.col("kind") == PAIRS).select("bucket", "keys", "counts")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                context, symbol = _split(unpack_sorted(keys))
                low = _Level(_cut(context, KEY - 1), symbol, unpack(counts))
                yield pa.RecordBatch.from_arrays([pa.array(low.ctx.view(np.int64)), pa.array(low.sym), pa.array(low.c)], names=["context", "symbol", "c"])

    # orders under KEY: at most 65,536 contexts of 256 symbols
    few = pairs.mapInArrow(shorten, "context bigint, symbol bigint, c bigint").groupBy("context", "symbol").agg(F.sum("c").alias("c")).toArrow()
    low = spark.sparkContext.broadcast(tuple(few.column(c).to_numpy() for c in ("context", "symbol", "c")))

    def levelled(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, _Level]]:
        last, sym, cnt = low.value
        context, symbol = _split(unpack_sorted(keys))
        c = unpack(counts)
        levels = {k: _Level(_cut(last.view(np.uint64), k), sym, cnt) for k in range(KEY)}
        return context, symbol, c, levels | {k: _Level(_cut(context, k), symbol, c) for k in range(KEY, ORDER + 1)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((2, CLASSES))
        for b in batches:
            for keys, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                context, symbol, c, levels = levelled(keys, counts)
                met += walk(context, symbol, levels, weight=c)
        at = np.flatnonzero(met[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[0][at]), pa.array(met[1][at])], names=["class", "escapes", "visits"])

    # at most CLASSES rows
    seen = pairs.mapInArrow(learn, "class bigint, escapes double, visits double").groupBy("class").agg(F.sum("escapes"), F.sum("visits")).toArrow()
    met = np.zeros((2, CLASSES))
    for k in (0, 1):
        met[k, seen.column(0).to_numpy()] = seen.column(k + 1).to_numpy()
    escapes = escape_probabilities(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, keys, counts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                context, symbol, _, levels = levelled(keys, counts)
                scores = walk(context, symbol, levels, escapes)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([keys], pa.binary()), pa.array([pack(scores)], pa.binary())], names=["bucket", "keys", "scores"])

    return pairs.mapInArrow(run, "bucket int, keys binary, scores binary")


def answer(packed: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(chunk, kind, bucket, found): for each row of packed the numbers that known (kind, bucket, keys, numbers) has for its keys, in the order of its keys."""
    salts = -(-most // FAN)
    asked = packed.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    told = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, kind, keys = (left.column(c).to_pylist() for c in ("chunk", "kind", "keys"))
        found = []
        if chunk:
            whole, numbers = right.column("keys").to_pylist()[0], right.column("numbers").to_pylist()[0]
            if kind[0] == PAIRS:
                code, scores = unpack_sorted(whole), unpack(numbers, np.float64)
                found = [pack(scores[np.searchsorted(code, unpack_sorted(x))].astype(np.float32)) for x in keys]
            else:
                index, counts = pd.Index(np.array(unpack_tokens(whole), object)), unpack(numbers)
                found = [pack(counts[index.get_indexer(np.array(unpack_tokens(x), object))]) for x in keys]
        return pa.table({"of": pa.array(chunk, pa.string()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(left.column("bucket").to_pylist(), pa.int32()), "found": pa.array(found, pa.binary())})

    return asked.groupBy("kind", "bucket", "salt").cogroup(told.groupBy("kind", "bucket", "salt")).applyInArrow(run, "of string, kind int, bucket int, found binary")


def score_documents(docs: DataFrame) -> DataFrame:
    """OUT for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    chunks = materialise(make_chunks(docs), "ppm-chunks")
    n, size = chunks.agg(F.count("*"), F.coalesce(F.sum(F.length("texts")), F.lit(0))).first()
    # packed texts are a third of their bytes or so
    buckets = min(MOST_BUCKETS, max(8, 3 * size // BUCKET_BYTES))
    packed = materialise(deal(chunks, buckets), "ppm-dealt")
    merged = merge(packed, max(1, n))

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [unpack(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in c], pa.int64()), pa.array([int((x > 0).sum()) for x in c], pa.int64())], names=["total", "kinds"])

    tokens = merged.where(F.col("kind") == TOKENS)
    total, kinds = tokens.select("counts").mapInArrow(total_of, "total bigint, kinds bigint").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    scored = materialise(score_pairs(merged), "ppm-scored")
    known = scored.select(F.lit(PAIRS).alias("kind"), "bucket", "keys", F.col("scores").alias("numbers")).unionByName(tokens.select("kind", "bucket", "keys", F.col("counts").alias("numbers")))
    answers = answer(packed.select("chunk", "kind", "bucket", "keys"), known, max(1, n))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        of = dict(zip(zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), strict=True), right.column("found").to_pylist(), strict=True))
        for ids, texts in zip(left.column("ids").to_pylist(), left.column("texts").to_pylist(), strict=True):
            head, split = _open(ids, texts)
            score = pa.array(pair_scores(split, of, buckets))
            names, number, lengths = number_tokens(split)
            c = np.empty(len(names), np.int64)
            for k, at in _by_bucket(token_buckets(names, buckets)):
                c[at] = unpack(of[TOKENS, k])
            add = lambda x: np.add.reduceat(x[number], np.cumsum(lengths) - lengths)  # noqa: E731, B023
            with np.errstate(divide="ignore"):
                base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
            base_score = pa.array(add(base)) if total else pa.nulls(len(head), pa.float64())
            columns = [pa.array(head[:, 0], mask=head[:, 1] > 0), pa.array(head[:, 2] > 0), pa.array(lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(head), total, np.int64)), base_score, score]
            out.append(pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, OUT)
