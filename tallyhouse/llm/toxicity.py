"""Toxicity by compression distance: separate zstandard dictionaries for toxic and ordinary text.

A dictionary is text of its class: the segments (words and pieces of words) that most set one class of labelled texts apart from the other, after
what is common in both, as COVER picks segments by how many samples they cover, less what they cover of the other class. The toxic one takes what is toxic beyond doubt; the ordinary
one, as no segment can be shown to be missing from a few toxic texts, the best of its class until it is as long as the toxic one; but none that shares MATCH bytes with a toxic segment, or
it would compress toxic words as well. A text is cut into
windows of WINDOW words, one every STEP words; each is compressed with either dictionary, and its excess is length with the ordinary
dictionary less length with the toxic one. The threshold for a window is calibrated: the 99.8 % quantile of the
excess in ordinary labelled texts; so is the evidence of each excess, its log ratio of rates in toxic and ordinary texts, where a window that suits the ordinary
dictionary counts as one that suits neither: else a long ordinary text around them would outweigh a few toxic words. A window that shares no MATCH bytes with
what only one dictionary holds tells nothing: its excess is 0, and it is not compressed. A logistic curve
fitted on the labelled texts turns the evidence of all windows of a text, how many are over the threshold and what share of them, into a score between 0 and 1.

Learning takes at most SAMPLE labelled texts of each class, those of the least hash of doc_id: the bound is a
parameter, and so are the dictionaries' sizes: SEGMENTS and COMMON, of PIECE + 2 bytes at most; windows and hash tables of the compressor follow from what a dictionary holds, so all of it is
searched. An excess beyond LARGEST counts as LARGEST: no window of WINDOW words of the usual length has more. Texts are never gathered: segments are counted, and windows measured, where the texts lie.
Scoring sees the text only and covers every window of every text.

Defined cases: a class without segments of its own has eight zero bytes for them; null and empty texts have no windows and score as the mean ordinary labelled text; labels of unknown
documents are not used; of several labels of a document the highest counts; null labels are not used; without labels of both classes every
score is 0; repeated rows are scored each; other columns of docs pass through, but for one that has the score's name, which gives way.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, materialise

SAMPLE = 4000
#: Words of a window, and words from the start of one to the next.
WINDOW, STEP = 4, 2
#: Bytes of the pieces that longer words are cut into.
PIECE = 24
#: Segments of a dictionary, the least ratio of each to the other class by its lower bound, and the least texts of its class that have it.
SEGMENTS, LEAST_RATIO, LEAST_TEXTS = 4000, 4.0, 5
#: Bytes that the compressor matches at least.
MATCH = 5
#: Standard errors that the lower bound of a ratio lies below it, for toxic and for ordinary segments.
ERRORS, ORDINARY_ERRORS = 1.5, 0.5
#: Follows each window and stands in both dictionaries: bytes that no text has, as a window's last 8 bytes are not searched.
CARRIER = bytes(range(192, 224))
#: Segments common to both classes that either dictionary starts with.
COMMON, LEAST_COMMON = 3000, 0.004
CUTOFF = 0.3
#: Windows of which a task remembers the excess.
REMEMBERED = 1 << 17
#: Of windows in ordinary texts, the share that stays under the threshold; the largest excess told apart.
QUANTILE, LARGEST = 0.998, 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def windows(text: bytes | None, words: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Runs of words, lower-cased (A-Z), with blanks around and between; the last one ends with the text."""
    found = text.translate(_LOWER).split() if text else []
    return [b" %b " % b" ".join(found[i : i + words]) for i in range(0, max(1, len(found) - words + step), step)] if found else []


def segments(text: bytes | None) -> set[bytes]:
    """What dictionaries are made of: the text's words, blanks around, beginnings of words from 4 bytes on, and overlapping pieces of long words."""
    out = set()
    for w in set(text.translate(_LOWER).split()) if text else ():
        w = b" %b " % w
        pieces = [w[i : i + PIECE] for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]
        out.update(pieces)
        out.update(w[:n] for n in range(5, min(len(w), 12)))
    return out


def pick_segments(best_first: Iterable[bytes], most: int = SEGMENTS, size: int | None = None, apart: bytes = b"") -> list[bytes]:
    """The first of them, none within another and none with MATCH bytes in common with `apart`, until there are `most`, or `size` bytes."""
    out: list[bytes] = []
    chosen, joined, held = set(), b"", 0
    for s in best_first:
        if len(out) == most or size is not None and held >= size:
            break
        bare = s.strip()
        if apart and any(bare[j : j + MATCH] in apart for j in range(max(1, len(bare) - MATCH + 1))):
            continue
        if s in joined or any(s[i:j] in chosen for i in range(len(s)) for j in range(i + 1, len(s) + 1)):
            continue
        out.append(s)
        chosen.add(s)
        joined += b"\xff" + s  # no UTF-8 text has that byte
        held += len(s)
    return out


def runs(text: bytes) -> np.ndarray:
    """Each run of MATCH bytes as a number, by where it begins."""
    n = max(0, len(text) - MATCH + 1)
    eight = np.ndarray(n, "<u8", text + bytes(8), strides=(1,))
    return eight & np.uint64((1 << 8 * MATCH) - 1)


class Meter:
    """Excess of windows: length with the ordinary dictionary less length with the toxic one.

    A text that both dictionaries hold follows each window, as zstandard leaves what is too short as it is.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.packers = []
        for content in (ordinary, toxic):
            # the deepest search finds the longest match; literals under 63 bytes stay as they are,
            # so a window's length is its bytes without match and 2 or 3 for a match
            log = max(17, (2 * len(content)).bit_length())  # the whole dictionary is in reach
            parameters = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, window_log=log, hash_log=log, chain_log=log, search_log=9, min_match=MATCH, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
            held = zstandard.ZstdCompressionDict(CARRIER + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.packers.append(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters))
        alike = max(0, len(os.path.commonprefix([toxic, ordinary])) - MATCH + 1)
        self.own = np.unique(np.concatenate([runs(x[alike:]) for x in (toxic, ordinary)]))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self._slot(self.own)] = True
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _slot(run: np.ndarray) -> np.ndarray:
        return (run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def excess(self, pieces: list[bytes]) -> np.ndarray:
        one, two = (p.compress for p in self.packers)
        known = self.known
        out = np.empty(len(pieces), np.int64)
        for k, x in enumerate(pieces):
            e = known.get(x)
            if e is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                e = known[x] = len(one(x + CARRIER)) - len(two(x + CARRIER))
            out[k] = e
        return out

    def telling(self, text: bytes | None) -> tuple[int, list[bytes]]:
        """How many windows a text has, and those with MATCH bytes that only one dictionary holds."""
        words = text.translate(_LOWER).split() if text else []
        if not words:
            return 0, []
        joined = b" %b " % b" ".join(words)
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        first = np.arange(0, max(1, len(words) - WINDOW + STEP), STEP)
        begin, end = blanks[first], blanks[np.minimum(first + WINDOW, len(words))] + 1
        run = runs(joined)
        at = np.flatnonzero(self.maybe[self._slot(run)])
        found = run[at]
        at = at[self.own[np.minimum(np.searchsorted(self.own, found), len(self.own) - 1)] == found]
        tells = np.searchsorted(at, begin) < np.searchsorted(at, end - MATCH, "right")
        return len(first), [joined[i:j] for i, j in zip(begin[tells].tolist(), end[tells].tolist(), strict=True)]

    def counts(self, text: bytes | None) -> np.ndarray:
        n, pieces = self.telling(text)
        out = histogram(self.excess(pieces))
        out[LARGEST] += n - len(pieces)
        return out


def histogram(excess: np.ndarray) -> np.ndarray:
    """How many of a text's windows have each excess, from -LARGEST or less to LARGEST or more."""
    return np.bincount(np.clip(excess, -LARGEST, LARGEST) + LARGEST, minlength=2 * LARGEST + 1)


def features(counts: np.ndarray, evidence: np.ndarray, threshold: int) -> np.ndarray:
    """Evidence of all windows, that of windows over the threshold, their number and their share."""
    over = counts[..., threshold + LARGEST + 1 :]
    n, some = np.maximum(1, counts.sum(-1)), over.sum(-1)
    return np.stack([counts @ evidence, over @ np.maximum(evidence[threshold + LARGEST + 1 :], 0), np.log1p(some), np.log1p(100 * some / n)], -1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Intercept and weights by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    evidence: np.ndarray
    weights: np.ndarray
    #: Mean features of ordinary labelled texts, for texts without windows.
    usual: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        x = features(counts, self.evidence, self.threshold)
        x[counts.sum(-1) == 0] = self.usual
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): at most `sample` texts of each class, of the least hash of doc_id; equal texts once, as copies would pass for a habit of their class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.withColumn("h", F.xxhash64("doc_id"))
    few = [known.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(sample) for c in (0, 1)]
    few = few[0].unionByName(few[1]).select(F.col("doc_id").alias("__id"), "toxic")
    # 2 * sample rows of two numbers at most
    return docs.join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic").dropDuplicates(["text", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from docs (doc_id, text) that have labels (doc_id, toxic); None without both classes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = materialise(labelled_sample(docs, labels, sample), "toxicity-sample")
    sizes = dict(rows.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(totals[0].keys() | totals[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *[pa.array([t[s] for s in names], pa.int64()) for t in totals]], names=["segment", "n0", "n1"])
            for t in totals:
                t.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[toxic].update(segments(text))
                if len(totals[0]) + len(totals[1]) > 500_000:
                    yield flush()
        yield flush()

    counted = rows.select("text", "toxic").mapInArrow(count, "segment binary, n0 bigint, n1 bigint").groupBy("segment").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # a segment of fewer texts is in no dictionary
    counted = materialise(counted.where(F.greatest("n0", "n1") >= LEAST_TEXTS), "toxicity-segments")
    shares = counted.select("segment", (F.col("n0") / sizes[0]).alias("p0"), (F.col("n1") / sizes[1]).alias("p1"))

    def best(own: int, errors: float, least: float) -> Iterator[bytes]:
        """Segments of a class, best first, whose ratio to the other class is at least `least` by its lower bound."""
        # a segment's share of its class doesn't count, only its ratio: a language of few texts has few texts with each of its words
        a, b = F.col(f"n{own}"), F.col(f"n{1 - own}")
        log_ratio = F.log((a + 0.5) / (sizes[own] + 1)) - F.log((b + 0.5) / (sizes[1 - own] + 1))
        sure = log_ratio - errors * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))  # what even a lucky draw leaves
        rows = counted.where((a >= LEAST_TEXTS) & (sure > math.log(least))).orderBy(F.desc(a * sure * F.sqrt(F.length("segment"))), "segment").select("segment")
        return (bytes(r.segment) for r in rows.toLocalIterator())  # a partition at a time, until the dictionary is full

    of_toxic = pick_segments(best(1, ERRORS, LEAST_RATIO))
    of_ordinary = pick_segments(best(0, ORDINARY_ERRORS, 1.0), size=sum(map(len, of_toxic)), apart=b"".join(reversed(of_toxic)))
    dictionaries = [b"".join(reversed(x)).ljust(8, b"\x00") for x in (of_toxic, of_ordinary)]
    # what is common in either class goes into both, so that only what sets them apart makes a difference
    common = shares.where((F.least("p0", "p1") >= LEAST_COMMON) & (F.greatest("p0", "p1") < 2 * F.least("p0", "p1"))).orderBy(F.desc(F.least("p0", "p1") * F.length("segment")), "segment").limit(COMMON)
    shared = b"".join(bytes(r.segment) for r in reversed(common.select("segment").collect()))
    toxic, ordinary = (shared + d for d in dictionaries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(toxic, ordinary)
        for b in batches:
            found = [meter.counts(t).tolist() for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "counts"])

    measured = materialise(rows.select("text", "toxic").mapInArrow(measure, "toxic int, counts array<bigint>"), "toxicity-excess")
    by_class = np.zeros((2, 2 * LARGEST + 1))
    for r in measured.select("toxic", F.posexplode("counts").alias("at", "n")).groupBy("toxic", "at").agg(F.sum("n").alias("n")).collect():
        by_class[r["toxic"], r["at"]] = r["n"]
    rates = (by_class + 1) / (by_class.sum(1, keepdims=True) + by_class.shape[1])
    upto = np.cumsum(by_class[0]) / max(1, by_class[0].sum())
    threshold = int(np.searchsorted(upto, QUANTILE)) - LARGEST
    evidence = np.log(rates[1] / rates[0])
    evidence[:LARGEST] = evidence[LARGEST]
    table = measured.toPandas()  # at most 2 * sample rows of 2 * LARGEST + 2 numbers
    counts = np.array(table["counts"].tolist(), np.int64)
    x, y = features(counts, evidence, threshold), table["toxic"].to_numpy().astype(float)
    return Model(toxic, ordinary, threshold, evidence, fit_logistic(x, y), x[y == 0].mean(0))


def score_texts(docs: DataFrame, model: Model | None, name: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of each text."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model.toxic, model.ordinary)
        for b in batches:
            counts = np.array([meter.counts(t) for t in b.column(at).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 2 * LARGEST + 1)
            scores = model.score(counts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs below the cutoff, with the columns of docs. Learns from all labels of documents in docs."""
    name = "__toxicity_score"
    return score_texts(docs, fit(docs.select("doc_id", "text"), labels, sample), name).where(F.col(name) < cutoff).select(*docs.columns)
