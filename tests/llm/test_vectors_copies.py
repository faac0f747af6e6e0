"""Product codes, exact copies and centroid clustering against brute-force versions, on nulls, odd vectors, ties and repeats."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhouse.llm import centroids, codes, copies

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, cluster int"


def vector_rows(n, seed, width=64, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i * 3 - 40, [float(np.float32(x + rng.gauss(0, spread))) for x in m], rng.choice([None, 1, 2]), "c", 0))
    return rows


ODD = [
    (900_001, None, 1, None, None),
    (900_002, [], 1, None, None),
    (900_003, [0.5] * 63, 1, None, None),
    (900_004, [None] + [0.0] * 63, 1, None, None),
    (900_005, [float("nan")] + [0.0] * 63, 1, None, None),
    (900_006, [float("-inf")] + [0.0] * 63, 1, None, None),
]


def finite(row):
    return row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


# 11 product codes


@pytest.mark.parametrize(("n", "spread"), [(1, 1.0), (24, 0.1), (25, 1.0), (1000, 0.02), (3000, 0.5)])
def test_trees_assign_like_all_comparisons(n, spread):
    rng = np.random.default_rng(n)
    middles = rng.integers(-500, 500, (9, 5))
    points = (middles[rng.integers(0, 9, n)] + rng.normal(0, spread * 50, (n, 5))).astype(np.int64)
    points[: n // 3] = points[0]  # a third are one point
    entries = np.concatenate([points[rng.integers(0, n, 20)], middles, middles, rng.integers(-900, 900, (20, 5))])  # with equal entries
    tree = codes.unpack(codes.pack(codes.build(points)))
    squares = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    want = squares.argmin(1)
    index, distance = codes.assign(tree, entries)
    assert (index == want).all()
    assert (distance == squares.min(1)).all()
    count, sums = codes.gather(tree, entries)
    assert (count == np.bincount(want, minlength=len(entries))).all()
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(len(entries)))


def test_subtrees_are_assigned_at_once_and_boxes_eliminate():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 20, (500, 4)) + 1000 * i for i in range(4)])
    entries = np.array([[1000 * i + 10] * 4 for i in range(4)])
    nearest, whole = codes.filtered(codes.build(points), entries)
    assert (nearest == -1).all()  # no point was compared by itself
    assert [level for level, *_ in whole] == [2]


def test_large_components_are_exact():
    points = np.array([[codes_limit, -codes_limit] * 40 for codes_limit in (1 << 23, (1 << 23) - 1, 5)])
    entries = points[[1, 0, 2]]
    index, distance = codes.assign(codes.build(points), entries)
    assert index.tolist() == [1, 0, 2]
    assert distance.tolist() == [0, 0, 0]


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows]
    width = len(kept[0][2]) // parts
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))[:entries]
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def near(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            taken = defaultdict(list)
            for _, _, v in kept:
                part = v[p * width : (p + 1) * width]
                taken[near(part, books[p])[0]].append(part)
            books[p] = [[sum(c) // len(taken[e]) for c in zip(*taken[e], strict=True)] if e in taken else old for e, old in enumerate(books[p])]
    out = []
    for i, lab, v in kept:
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    total = Counter()
    for _, lab, _, e in out:
        total[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, total[lab], sha) for i, lab, c, e in out)


def test_codes_are_those_of_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 40)
    rows = vector_rows(150, 3, 8, 0.2)
    rows += [rows[0], (-5, rows[3][1], 7, "", 1), (-5, rows[4][1], 7, "", 1)]
    df = spark.createDataFrame([*rows, ODD[0], *[(i, v[:8], lab, c, k) for i, v, lab, c, k in ODD[3:]]], VECTORS)
    got = codes.compress(df.repartition(3), entries=20)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got.collect()) == brute_codes([r[:3] for r in rows], entries=20)


def test_codes_of_odd_lengths_null_ids_and_nothing(spark):
    rows = vector_rows(30, 4, 64)
    df = spark.createDataFrame([*rows, (None, rows[0][1], None, "", 0), *ODD], VECTORS)
    got = {(r.vec_id, r.code is None) for r in codes.compress(df).collect()}
    assert {i for i, none in got if none} == {900_002, 900_003}
    assert (None, False) in got
    assert codes.compress(df.limit(0)).count() == 0
    only = codes.compress(spark.createDataFrame(ODD, VECTORS)).collect()
    assert sorted((r.vec_id, r.code) for r in only) == [(900_002, None), (900_003, None)]


# 12 exact copies


@pytest.mark.parametrize(("n", "bits", "most"), [(0, 20, 1), (1, 20, 1), (400, 16, 3), (3000, 40, 2), (900, 64, 70_000)])
def test_filters_count_and_merge_without_loss(n, bits, most):
    rng = random.Random(n)
    pool = [rng.randrange(1 << bits) for _ in range(max(1, n // 2))] + [0, (1 << bits) - 1]
    counts = [Counter(rng.choice(pool) for _ in range(n)) for _ in range(3)]
    for c in counts:
        for f in list(c)[:5]:
            c[f] += rng.randrange(most)
    filters = []
    for c in counts:
        prints = np.array(sorted(c), np.uint64)
        f = copies.QuotientFilter.unpack(copies.QuotientFilter.build(prints, np.array([c[int(x)] for x in prints], np.int64), bits).pack())
        assert {int(k): int(v) for k, v in zip(*f.items(), strict=True)} == c
        assert all(f.count(k) == v for k, v in list(c.items())[:50])
        assert all(f.count(x) == c.get(x, 0) for x in [rng.randrange(1 << bits) for _ in range(50)])
        filters.append(f)
    merged = copies.QuotientFilter.merge(filters)
    assert {int(k): int(v) for k, v in zip(*merged.items(), strict=True)} == sum(counts, Counter())


def brute_copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        ordered = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ordered[0], len(ids), k == 0, sha) for k, i in enumerate(ordered)]
    return sorted(out, key=str)


def copy_rows():
    rng = random.Random(9)
    words = ["a", "b", "ccc", "dé", " ", "\x1c"]
    rows = [(i, rng.choice(["", " "]) + rng.choice([" ", "\n", "\t \r"]).join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for i in range(400)]
    rows += [(None, None), (500, ""), (501, " "), (502, "\n\n"), (None, "only null ids"), (None, "only  null ids"), (503, "x y"), (503, "x\ty"), (503, "x y"), (504, "long " * 50_000), (2, "long\n" * 50_000)]
    return rows


@pytest.mark.parametrize("most", [copies.MOST_BROADCAST, 0])
def test_copies_are_those_of_a_plain_loop(spark, monkeypatch, most):
    monkeypatch.setattr(copies, "MOST_BROADCAST", most)
    monkeypatch.setattr(copies, "SHARD_ROWS", 50)
    rows = copy_rows()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, kept string, fp int").repartition(5)
    got = copies.mark_copies(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_copies(rows)


def test_copies_of_nothing(spark):
    assert copies.mark_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# 13 centroid clustering


def brute_centroids(rows, k, rounds, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middles = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in middles]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        taken = defaultdict(list)
        for _, v in kept:
            taken[near(v)[0]].append(v)
        middles = [[sum(c) // len(taken[e]) for c in zip(*taken[e], strict=True)] if e in taken else old for e, old in enumerate(middles)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=str)


def test_centroids_are_those_of_plain_rounds(spark):
    rows = vector_rows(200, 6, 64, 0.7)
    rows += [rows[0], rows[0], (None, rows[5][1], 1, "", 1)]
    df = spark.createDataFrame([*rows, *ODD], VECTORS).repartition(3)
    got = centroids.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_centroids([r[:2] for r in rows], 16, 3)


def test_centroids_of_few_vectors_and_none(spark):
    rows = vector_rows(3, 8, 64)
    got = sorted((tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == brute_centroids([r[:2] for r in rows], 16, 3)
    assert centroids.cluster(spark.createDataFrame(ODD, VECTORS)).count() == 0


def test_ties_go_to_the_lower_centroid():
    x = np.array([[0, 0], [4, 0], [2, 0]])
    assert centroids.nearest(x, np.array([[0, 0], [4, 0], [0, 0]]))[0].tolist() == [0, 1, 0]
