"""Vector code compression: product codes whose codebooks are found by filtering Lloyd.

A vector is cut into equal consecutive parts; each part position has a codebook, and the code names the nearest entry of each. Before the
rounds, every partition cuts its vectors into blocks of BLOCK and builds a kd-tree over the parts of each position: a level halves every node's
points by rank along its widest side, so the tree's shape follows from the number of points; each node caches its bounding box, count and
sum. Blocks with their trees are a table in the shared folder, which every round reads; a lost executor's blocks are read again.

A round takes the codebooks, a few entries of fixed number, to the tasks. From the root down, the entry nearest to the middle of a node's box eliminates
every entry that is nearer to no point of the box (the difference of the two distances is linear, so the corner that favours the other entry
decides). A node with one entry left gives its cached count and sum to it at once; the points of a leaf are compared with the entries left there.
Everything is integer and ties go to the lower index, in the box test too, so the result is that of comparing all points with all entries.
Per-partition sums merge through a groupBy on (part, entry).

Defined cases: vectors that are null or hold null or non-finite components are left out; the vectors' length is the most frequent one that can be
cut, and vectors of another length return with null code and error; scaled components beyond 2^23 count as 2^23; rows
with a null id are coded but start no entry; repeated rows count each; with fewer vectors than entries the codebooks are shorter; an entry that nothing is
assigned to stays; an empty table gives an empty result. label may have any type that casts to a string; further columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise
from .vectors import common_length, finite, matrix, scaled, sums_by

#: Vectors of a block; points of a leaf, at most; numbers in a scratch array of the comparison in leaves.
BLOCK, LEAF, SCRATCH = 4096, 24, 1 << 21
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCKS = "ids array<bigint>, labels array<string>, trees array<binary>"
CODED = "vec_id bigint, label string, code string, error bigint"


@dataclass(frozen=True)
class Tree:
    """Points in the tree's order, where each stood before, and the nodes of all levels, from the root on."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def bounds(self, level: int) -> np.ndarray:
        return _bounds(len(self.points), level)

    @property
    def depth(self) -> int:
        return len(self.low).bit_length() - 1


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    return (np.arange((1 << level) + 1) * n) >> level


def build(points: np.ndarray) -> Tree:
    """The kd-tree over the rows of points, one at least."""
    n, order = len(points), np.arange(len(points))
    depth = max(0, (n - 1) // LEAF).bit_length()
    low, high, sums = [], [], []
    for level in range(depth + 1):
        bounds = _bounds(n, level)
        low.append(np.minimum.reduceat(points, bounds[:-1]))
        high.append(np.maximum.reduceat(points, bounds[:-1]))
        sums.append(np.add.reduceat(points, bounds[:-1]))
        if level < depth:
            node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            widest = (high[-1] - low[-1]).argmax(1)
            by = np.lexsort((points[np.arange(n), widest[node]], node))
            points, order = points[by], order[by]
    return Tree(points, order, np.concatenate(low), np.concatenate(high), np.concatenate(sums))


def pack(tree: Tree) -> bytes:
    n, width = tree.points.shape
    return b"".join(np.ascontiguousarray(x, t).tobytes() for x, t in ((np.array([n, width, len(tree.low)]), "<i4"), (tree.points, "<i4"), (tree.order, "<i4"), (tree.low, "<i4"), (tree.high, "<i4"), (tree.sums, "<i8")))


def unpack(blob: bytes) -> Tree:
    n, width, nodes = (int(x) for x in np.frombuffer(blob, "<i4", 3))
    at, out = 12, []
    for shape, kind in (((n, width), "<i4"), ((n,), "<i4"), ((nodes, width), "<i4"), ((nodes, width), "<i4"), ((nodes, width), "<i8")):
        count = int(np.prod(shape))
        out.append(np.frombuffer(blob, kind, count, at).astype(np.int64).reshape(shape))
        at += count * int(kind[2])
    return Tree(*out)


def eliminate(low: np.ndarray, high: np.ndarray, entries: np.ndarray, node: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (node, entry), sorted, those that stay: the others are nearest to no point of the node's box."""
    to_middle = 2 * entries[entry] - (low + high)[node]
    distance = np.einsum("ij,ij->i", to_middle, to_middle)
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    group = np.cumsum(np.r_[False, node[1:] != node[:-1]])
    hit = np.flatnonzero(distance == np.minimum.reduceat(distance, first)[group])
    best = entry[hit[np.searchsorted(group[hit], np.arange(len(first)))]][group]  # the lowest index of equals
    apart = entries[entry] - entries[best]
    corner = np.where(apart > 0, high[node], low[node])
    square = np.einsum("ij,ij->i", entries, entries)
    gain = square[entry] - square[best] - 2 * np.einsum("ij,ij->i", apart, corner)
    stays = (entry == best) | (gain < 0) | (gain == 0) & (entry < best)
    return node[stays], entry[stays]


def compare(tree: Tree, entries: np.ndarray, node: np.ndarray, entry: np.ndarray, out: np.ndarray) -> None:
    """Writes the nearest entry of each point of the leaves in pairs (leaf, entry), sorted, to out."""
    bounds, width = tree.bounds(tree.depth), entries.shape[1]
    leaves, first, many = np.unique(node, return_index=True, return_counts=True)
    largest = int(max(np.abs(entries).max(), np.abs(tree.points).max(), 1))
    kind = np.float64 if 3 * width * largest * largest < 1 << 53 else np.int64  # both exact
    most = np.finfo(np.float64).max if kind is np.float64 else np.iinfo(np.int64).max
    square = np.einsum("ij,ij->i", entries, entries).astype(kind)
    points, targets = tree.points.astype(kind), entries.astype(kind)
    rank = np.ceil(np.log2(many)).astype(int)
    for r in np.unique(rank):  # leaves with alike many entries left together
        chosen = np.flatnonzero(rank == r)
        k, rows = int(many[chosen].max()), int(np.diff(bounds)[leaves[chosen]].max())
        each = max(1, SCRATCH // (rows * k))
        for i in range(0, len(chosen), each):
            some = chosen[i : i + each]
            held = np.arange(k) < many[some, None]
            named = entry[np.where(held, first[some, None] + np.arange(k), first[some, None])]
            start = bounds[leaves[some]]
            length = bounds[leaves[some] + 1] - start
            at = np.minimum(start[:, None] + np.arange(rows), start[:, None] + length[:, None] - 1)
            score = np.where(held, square[named], most)[:, None, :] - np.where(held[:, None, :], 2 * (points[at] @ targets[named].transpose(0, 2, 1)), 0)
            out[at] = np.take_along_axis(named, score.argmin(2), 1)  # entries ascend, so the first of equals is the lowest


def filtered(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The nearest entry of each point, -1 where a subtree was assigned at once; and these (level, nodes, entries)."""
    nearest = np.full(len(tree.points), -1, np.int64)
    whole: list[tuple[int, np.ndarray, np.ndarray]] = []
    node, entry = np.zeros(len(entries), np.int64), np.arange(len(entries))
    for level in range(tree.depth + 1):
        at = slice((1 << level) - 1, (2 << level) - 1)
        node, entry = eliminate(tree.low[at], tree.high[at], entries, node, entry)
        left = np.bincount(node, minlength=1 << level)
        alone = left[node] == 1
        if alone.any():
            whole.append((level, node[alone], entry[alone]))
            node, entry = node[~alone], entry[~alone]
        if not len(node):
            break
        if level == tree.depth:
            compare(tree, entries, node, entry, nearest)
        else:  # both halves of a node inherit its entries
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            sizes = np.diff(np.r_[starts, len(node)])
            twice = np.repeat(starts, 2), np.repeat(sizes, 2)
            index = np.repeat(twice[0] - np.r_[0, np.cumsum(twice[1])[:-1]], twice[1]) + np.arange(2 * len(node))
            half = np.tile([0, 1], len(starts)).repeat(twice[1])
            node, entry = 2 * node[index] + half, entry[index]
    return nearest, whole


def gather(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points each entry takes, and their sums."""
    k, width = entries.shape
    nearest, whole = filtered(tree, entries)
    count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for level, nodes, takes in whole:
        np.add.at(count, takes, np.diff(tree.bounds(level))[nodes])
        np.add.at(sums, takes, tree.sums[(1 << level) - 1 + nodes])
    each = np.flatnonzero(nearest >= 0)
    by = each[np.argsort(nearest[each], kind="stable")]
    if len(by):
        takes, first = np.unique(nearest[by], return_index=True)
        count[takes] += np.diff(np.r_[first, len(by)])
        sums[takes] += np.add.reduceat(tree.points[by], first)
    return count, sums


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and squared distance of each point, in the order before the tree's."""
    nearest, whole = filtered(tree, entries)
    for level, nodes, takes in whole:
        bounds = tree.bounds(level)
        for n, e in zip(nodes, takes, strict=True):
            nearest[bounds[n] : bounds[n + 1]] = e
    apart = tree.points - entries[nearest]
    index, distance = np.empty_like(nearest), np.empty_like(nearest)
    index[tree.order], distance[tree.order] = nearest, np.einsum("ij,ij->i", apart, apart)
    return index, distance


def blocks(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """BLOCKS: the vectors (vec_id, label, v) by blocks, with a tree for each part position."""
    each = width // parts

    def row(ids: list, labels: list, v: np.ndarray) -> pa.RecordBatch:
        trees = [pack(build(v[:, p * each : (p + 1) * each])) for p in range(parts)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            held.append(matrix(b.column(2), width))
            while len(ids) >= BLOCK:
                v = np.concatenate(held)
                yield row(ids[:BLOCK], labels[:BLOCK], v[:BLOCK])
                ids, labels, held = ids[BLOCK:], labels[BLOCK:], [v[BLOCK:]]
        if ids:
            yield row(ids, labels, np.concatenate(held))

    return vectors.select("vec_id", "label", "v").mapInArrow(run, BLOCKS)


def start(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks of the vectors with the smallest ids; of equal ids the smaller vector first."""
    first = vectors.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()  # `entries` rows
    return [np.ascontiguousarray(x) for x in np.split(np.array([r["v"] for r in first], np.int64), parts, axis=1)] if first else []


def round_sums(trees: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, s0, s1, ...) of the used entries."""
    width = codebooks[0].shape[1]
    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros(c.shape, np.int64) for c in codebooks]
        for b in batches:
            for row in b.column(0):
                for p, blob in enumerate(row):
                    n, s = gather(unpack(blob.as_py()), codebooks[p])
                    count[p] += n
                    sums[p] += s
        used = [np.flatnonzero(c) for c in count]
        table = np.concatenate([np.column_stack([np.full(len(u), p), u, count[p][u], sums[p][u]]) for p, u in enumerate(used)])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in table.T], names=names)

    partial = trees.select("trees").mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
    return partial.groupBy("part", "entry").agg(*[F.sum(x).alias(x) for x in names[2:]])


def lloyd(trees: DataFrame, codebooks: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    for _ in range(rounds):
        moved = [c.copy() for c in codebooks]
        for r in round_sums(trees, codebooks).collect():  # parts * entries rows
            moved[r["part"]][r["entry"]] = [s // r["n"] for s in r[3:]]
        codebooks = moved
    return codebooks


def coded(trees: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """CODED of every vector in the blocks: its code, two hex digits a part, and the squared distances added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(max(len(c) for c in codebooks))], object)
        for b in batches:
            for ids, labels, blobs in zip(*b.columns, strict=True):
                found = [assign(unpack(blob.as_py()), c) for blob, c in zip(blobs, codebooks, strict=True)]
                code = digits[found[0][0]]
                for index, _ in found[1:]:
                    code = code + digits[index]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, CODED)


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """CODED, label_error and codebooks_sha256 for each finite vector of rows (vec_id, label, embedding); entries: 256 at most."""
    spark = rows.sparkSession
    bounded_batches(spark)
    named = rows.where(finite(vector)).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("embedding"))
    width = common_length(named, "embedding", parts)
    vectors = named.where(F.size("embedding") == width).select("vec_id", "label", scaled("embedding", scale).alias("v"))
    odd = (named.where(F.size("embedding") != width) if width else named).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    codebooks = start(vectors, parts, entries) if width else []
    if not codebooks:
        return odd.withColumns({"label_error": F.lit(None).cast("bigint"), "codebooks_sha256": F.lit(None).cast("string")})
    trees = materialise(blocks(vectors, width, parts), "code-trees")
    codebooks = lloyd(trees, codebooks, rounds)
    said = ",".join(str(x) for c in codebooks for entry in c.tolist() for x in entry)
    result = materialise(coded(trees, codebooks).unionByName(odd), "codes")
    return sums_by(result, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(hashlib.sha256(said.encode()).hexdigest()))
