"""What the Voronoi join leaves out, with exact answers kept."""

from collections import Counter

import numpy as np

from quernstone.llm import topk


def plain(x, k):
    v = [(i, np.floor(64 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in x]
    out = Counter()
    for i, q in v:
        if i % 20 == 0:
            best = sorted((-int(q @ y), j) for j, y in v if j != i)[:k]
            out.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    return out


def test_groups_are_left_out_on_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    centres *= 3 / np.linalg.norm(centres, axis=1)[:, None]
    x = [(i, [float(c) for c in centres[i % 40] + rng.normal(0, 0.03, 16)]) for i in range(2000)]
    facts = {}
    got = topk.top_k(spark.createDataFrame(x, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0, k=20, pivots=60, facts=facts)
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == plain(x, 20)
    assert facts["visits"] < 0.25 * 100 * facts["n_groups"], facts


def test_one_group_of_copies_and_extra_columns(spark):
    x = [(i, [1.0, 0.5] if i % 3 else [float(i % 7), 1.0]) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in x], "vec_id long, embedding array<float>, cell string, row int")
    got = topk.top_k(df, lambda i: i % 20 == 0, k=5)
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == plain(x, 5)
