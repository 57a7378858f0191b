"""Clustering against Lloyd's rounds in plain integers."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import kmeans as K


def plain(rows, n=K.CENTROIDS, rounds=K.ROUNDS, width=K.WIDTH):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(-K.LARGEST < x < K.LARGEST for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:n]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of) if o == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in found)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    return Counter(tuple(r) for r in K.summarised(*K.cluster(df, **more)).collect())


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (200, rows[8][1]), (None, rows[9][1]), (201, None), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] * 64), (205, [float("nan")] * 64), (206, [float("inf")] * 64), (207, [1e300] * 64), (208, [])]
    assert got(spark, rows) == plain(rows)


def test_ties_repeats_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)] * 32) for i in range(40)]
    assert got(spark, grid) == plain(grid)  # many equal vectors, equal centroids and equal distances
    assert got(spark, grid[:5]) == plain(grid[:5])
    same = [(i, [0.25] * 64) for i in range(300)]
    assert got(spark, same) == plain(same)
    assert got(spark, []) == Counter()


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-(2**21) + 1, 2**21, 64) + rng.random(64)).tolist()) for i in range(60)]
    want = plain(rows)
    beyond = lambda x: x if x < 2**63 else None
    assert got(spark, rows) == Counter({(i, k, d, beyond(s), beyond(e), h): n for (i, k, d, s, e, h), n in want.items()})


def test_filtering_assigns_whole_nodes():
    """On clustered vectors in few dimensions most are assigned through their nodes, and all as by full comparison."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-500, 500, (16, 4))
    x = np.concatenate([c + rng.integers(-20, 20, (200, 4)) for c in centroids])
    order, start, stop, low, high, sums = K.grown(x)
    assert (sums[0] == x.sum(axis=0)).all() and sorted(order.tolist()) == list(range(len(x)))
    x = x[order]
    whole, of = K.filtered(start, stop, low, high, x, centroids)
    away = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (of == away.argmin(axis=1)).all()
    assert sum(int(stop[n] - start[n]) for n, _ in whole) > 0.8 * len(x)
    for n, k in whole:
        assert (of[start[n] : stop[n]] == k).all()


def test_start_is_found_behind_a_bound_on_hashes(spark):
    kept = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("int")).alias("v"))
    want = sorted(range(5000), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    assert K.first_centroids(kept)[:, 0].tolist() == want
