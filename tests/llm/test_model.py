"""The language model against a plain step-by-step likelihood, and its independence of how a table is dealt."""

import uuid

import numpy as np

from quernstone.llm import lm_score
from quernstone.llm import recurrent as R


def plain_likelihood(w, doc, first):
    """The document's log-likelihood, one token after the other, in double precision."""
    w = {k: v.astype(float) for k, v in w.items()}
    h, before, total, hidden = np.zeros(R.HIDDEN), first, 0.0, R.HIDDEN
    for token in doc:
        g = w["x"][before] + w["b"]
        zr = 1 / (1 + np.exp(-(g[: 2 * hidden] + h @ w["u"][:, : 2 * hidden])))
        z, r = zr[:hidden], zr[hidden:]
        n = np.tanh(g[2 * hidden :] + r * (h @ w["u"][:, 2 * hidden :]))
        h = (1 - z) * n + z * h
        c, k = divmod(int(token), R.SIZE)
        of_class, within = h @ w["c"] + w["cb"], h @ w["o"][c] + w["ob"][c]
        total += of_class[c] - np.log(np.exp(of_class).sum()) + within[k] - np.log(np.exp(within).sum())
        before = token
    return total


def test_likelihood_of_whole_documents():
    rng = np.random.default_rng(4)
    w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in R.start(np.arange(90, 0, -1.0)).items()}
    docs = [rng.integers(0, 90, n).astype(np.int32) for n in (1, 2, 63, 64, 65, 400, 7)]  # windows are of 64 steps
    got = R.score(w, docs, 5, lanes=3)
    assert np.allclose(got, [plain_likelihood(w, d, 5) for d in docs], rtol=1e-4)


def test_weights_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{j}" for j in rng.integers(0, 30, 40))) for k in range(120)] + [(None, "a b c"), (3, None), (3, ""), (7, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_score.durable(lm_score.word_counts(df), "lm-counts")
    shared, vocabulary = lm_score.gather(df, counts, uuid.uuid4().hex)
    one, other = (R.flat(lm_score.train(df.repartition(n), shared, vocabulary, shard_tokens=1500)) for n in (1, 7))
    assert np.array_equal(one, other)


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + (i < 5) * i) for i in range(3000)], "word string, c long")
    top = lm_score.frequent(counts, 100)
    assert [w for w, _ in top[:4]] == ["w4", "w3", "w2", "w1"] and 5 < len(top) <= 100
    assert len(lm_score.frequent(counts, 3000)) == 3000 and lm_score.frequent(counts.limit(0), 10) == []
