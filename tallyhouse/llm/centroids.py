"""Centroid clustering by plain Lloyd rounds, exact in integers.

The centroids, k short vectors, travel to the tasks with the function. A task computes in NumPy, centroid by centroid, the integer squared
differences of its vectors; the least distance takes a vector, the lowest index of equals. It adds up what it has assigned and gives one row a
centroid: how many vectors, and their componentwise sums. These rows merge through one groupBy, and k rows return to the driver, which
divides. Integers add up to the same in any order, so reruns and lost executors change nothing.

Vectors become integers once and are kept as a table in the shared folder, which every round reads.

Start: of the vectors with an id, the k with the least lowercase-hex SHA-256 of `<seed>:<vec_id>`, by hash; of equal ids the smaller vector first.

Defined cases: rows whose vector is null, of another length or holds null or non-finite components are left out; scaled
components beyond 2^23 count as 2^23; rows with a null id are assigned, but no round starts from them; repeated rows count each; fewer than k vectors with ids start
as many centroids, and without any there is no result row; a centroid that nothing is assigned to stays where it is. Further columns of
the input aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise
from .vectors import finite, scaled

SCHEMA = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centroid of each row; the lowest index of equals."""
    squares = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        d = x - c
        np.einsum("ij,ij->i", d, d, out=squares[i])
    index = squares.argmin(0)  # the first of equals
    return index, squares[index, np.arange(len(x))]


def _vectors(frame: pd.DataFrame, width: int) -> np.ndarray:
    return np.concatenate(frame["v"].to_list()).astype(np.int64).reshape(-1, width) if len(frame) else np.empty((0, width), np.int64)


def integer_vectors(rows: DataFrame, dims: int, scale: int, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors of `dims` finite components as integers."""
    kept = rows.where(finite(vector) & (F.size(vector) == dims))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(vector, scale).alias("v"))


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    text = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    first = vectors.where("vec_id IS NOT NULL").orderBy(F.sha2(text, 256), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in first], np.int64)


def round_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, s0, s1, ...): how many vectors each centroid takes and their componentwise sums."""
    k, width = centroids.shape
    names = [f"s{i}" for i in range(width)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for f in frames:
            x = _vectors(f, width)
            index, _ = nearest(x, centroids)
            count += np.bincount(index, minlength=k)
            for c in np.unique(index):
                total[c] += x[index == c].sum(0)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used]} | {s: total[used, i] for i, s in enumerate(names)})

    partial = vectors.select("v").mapInPandas(run, ", ".join(["cluster int", "n bigint", *[f"{s} bigint" for s in names]]))
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds."""
    for _ in range(rounds):
        moved = centroids.copy()
        for r in round_sums(vectors, centroids).collect():  # k rows
            moved[r["cluster"]] = [s // r["n"] for s in r[2:]]
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width = centroids.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            index, distance = nearest(_vectors(f, width), centroids)
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "cluster": index.astype(np.int32), "distance": distance})

    return vectors.select("vec_id", "v").mapInPandas(run, "vec_id bigint, cluster int, distance bigint")


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """SCHEMA: the cluster of each vector of rows (vec_id, embedding), its squared distance, what these add up to, and its centroid's hash."""
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors = materialise(integer_vectors(rows, dims, scale, vector), "centroid-vectors")
    centroids = start(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA)
    centroids = lloyd(vectors, centroids, rounds)
    assigned = materialise(assign(vectors, centroids), "centroid-assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    named = [(i, int(inertia.get(i, 0)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    of = spark.createDataFrame(named, "of int, cluster_inertia bigint, centroid_sha256 string")
    # k rows
    return assigned.join(F.broadcast(of), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(int(sum(inertia.values()))).cast("bigint").alias("inertia"), "centroid_sha256")
