"""Scores of segments against plain loops, concordance by ranges, and the trigger."""

import itertools
import math
import random

from pyspark.sql import functions as F

from quernstone.operators import metrics as M
from quernstone.operators import segments as S


def cosine(p, q):
    size = sum(x * x for x in p) * sum(x * x for x in q)
    return sum(x * y for x, y in zip(p, q)) / math.sqrt(size) if size else 0.0


def test_scores_equal_loops(spark):
    r = random.Random(8)
    vectors = {f"n{k}": [r.randrange(-64, 64) for _ in range(12)] for k in range(14)}
    vectors["zero"], vectors["part"] = [0] * 12, [0] * 4 + [5] * 8
    e = spark.createDataFrame([*vectors.items(), ("none", None)], "node string, vector array<long>")
    pairs = [(a, b, i % 3) for i, (a, b) in enumerate(itertools.combinations([*vectors, "none", "unknown"], 2))]
    df = spark.createDataFrame(pairs + pairs[:2], "a string, b string, `x.y` int")
    scored = S.segment_scores(df, e, width=4)
    rows = scored.collect()
    cut = lambda v: [v[i : i + 4] for i in range(0, 12, 4)]
    plain = []
    for a, b, c in pairs + pairs[:2]:
        if a in vectors and b in vectors:
            best = sorted((cosine(p, q) for p in cut(vectors[a]) for q in cut(vectors[b])), reverse=True)
            plain.append((a, b, c, best[0], (((best[0] + best[1]) + best[2]) + best[3]) / 4, cosine(vectors[a], vectors[b])))
    assert sorted(map(tuple, rows)) == sorted(plain) and scored.columns == ["a", "b", "x.y", *S.SCORES]
    assert S.scalar_differences(scored, e, 3, width=4).count() == 0
    changed = scored.withColumn("global", F.col("global") + F.when(F.col("a") == "n1", 0.5).otherwise(0.0))
    assert S.scalar_differences(changed, e, 3, width=4, rows=500).count() == sum(p[0] == "n1" for p in plain)
    assert S.segment_scores(df.limit(0), e, width=4).count() == 0


def test_concordance_by_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.floor(F.pmod(F.hash("id"), F.lit(700))).alias("s"), (F.pmod(F.hash("id", F.lit(1)), F.lit(4)) == 0).alias("pos"), (F.col("id") % 3 + 1).cast("double").alias("w"))
    df = df.union(spark.createDataFrame([(7, 1, True, 1.0)], df.schema))
    get = lambda f: {r.g: r.concordance for r in f(df.repartition(6), ["g"], "s", F.col("pos"), F.col("w")).collect()}
    assert get(M.ranged_concordance) == get(M.concordance) and get(M.concordance)[7] is None


def test_trigger(spark):
    rows = [("c", True, 0.9, 0.9, 0.1), ("c", False, 0.2, 0.95, 0.5), ("c", False, 0.1, 0.1, 0.05), ("d", True, 0.5, 0.5, 0.5), ("d", False, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "cell string, pos boolean, local_max double, local_top4 double, `global` double")
    got = {(r.cell, r.score): (r.concordance, r.global_concordance, r.delta, r.triggered) for r in S.local_trigger(df, "cell", F.col("pos"), F.lit(1.0)).collect()}
    assert got == {("c", "local_max"): (1.0, 0.5, 0.5, True), ("c", "local_top4"): (0.5, 0.5, 0.0, False), ("d", "local_max"): (0.5, 0.5, 0.0, False), ("d", "local_top4"): (0.5, 0.5, 0.0, False)}
