"""Clusters of whole-number vectors against Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from depscope.llm import centroid_clusters as C

SCHEMA = "vec_id long, embedding array<float>, label int, q string, number long, cluster int"


def brute(rows, k, rounds, size, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [q for _, q in sorted(kept, key=key)[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids)) for _, q in kept]
    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            mine = [q for (_, q), (_, m) in zip(kept, own, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, own, strict=True)), key=str), centroids


def vectors(seed, n, size, scale=1.0):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, scale)) for _ in range(size)]) for i in range(n)]
    rows += [rows[0], rows[0], (0, rows[1][1]), (None, rows[2][1]), (n, None), (n + 1, []), (n + 2, rows[3][1][:-1]), (n + 3, [*rows[3][1][:-1], None]), (n + 4, [float("nan"), *rows[3][1][1:]]), (n + 5, [float("inf"), *rows[3][1][1:]])]
    rows += [(n + 10 + i, [f32(-0.25 if (i >> j) & 1 else 0.25) for j in range(size)]) for i in range(8)]
    return rows


@pytest.mark.parametrize(("size", "k", "scale"), [(4, 5, 1.0), (64, 16, 0.1), (3, 16, 40_000.0)])
def test_clusters(spark, size, k, scale):
    rows = vectors(size, 120, size, scale)
    df = spark.createDataFrame([(i, v, 1, "q", 2, 3) for i, v in rows], SCHEMA).repartition(3)
    found, about = C.clusters(df, k, 3, size)
    want, centroids = brute(rows, k, 3, size, 64, 1)
    got = sorted(((r["id"], r["cluster"], r["distance"]) for r in found.collect()), key=str)
    assert got == want
    about = {r["cluster"]: r for r in about.collect()}
    for n, r in about.items():
        mine = [d for _, m, d in want if m == n]
        assert (r["n"], r["cluster_inertia"], r["inertia"], r["centroid"]) == (len(mine), sum(mine), sum(d for *_, d in want), centroids[n])
    assert set(about) == {m for _, m, _ in want}


def test_few_empty_and_large(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r["cluster"], r["distance"]) for r in C.clusters(few, 5, 2, 2)[0].collect()) == [(0, 0), (0, 0)]
    found, about = C.clusters(few.limit(0), 5, 2, 2)
    assert found.count() == 0 and about.count() == 0
    huge = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        C.clusters(huge, 5, 2, 2)


def test_intervals_hold_near_ties():
    """Vectors whose distances differ by one part in 2^40: float32 can't tell them apart, whole numbers do."""
    rng = np.random.default_rng(1)
    q = rng.integers(-(1 << 26), 1 << 26, (300, 64))
    centroids = q[:8].copy()
    centroids[1] = centroids[0]
    centroids[1, 0] += 1
    centroids[2] = centroids[0]
    near = np.concatenate([q, centroids[:2] + 1])
    number, distance = C.nearest(near, centroids)
    for x, n, d in zip(near, number, distance, strict=True):
        all_of_them = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
        assert (int(d), int(n)) == min((v, i) for i, v in enumerate(all_of_them))


def test_query(spark, tmp_path):
    rows = vectors(3, 90, 64, 0.1)
    spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, centroids = brute(rows, 16, 3, 64, 64, 1)
    inertia = {n: sum(d for _, m, d in want if m == n) for n in range(16)}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    got = C.op11_centroid_clusters(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, n, d, inertia[n], sum(inertia.values()), sha(centroids[n])) for i, n, d in want), key=str)
