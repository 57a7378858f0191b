"""Designs from pool sizes and samples by unranking, against the enumerated pairs."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.operators import designs as D


def enumerated(nodes, positives):
    part, degree = {n: p for n, p, _ in nodes}, {n: d for n, _, d in nodes}
    label = lambda d: next(x for low, x in D.DEGREE_BINS if d >= low)
    out = {}
    for a, b in itertools.combinations(sorted(part), 2):
        ends = [part[a], part[b]]
        held = [e for e in ends if e != "train"]
        if any(part[n] == "train" and not degree[n] for n in (a, b)) or len(set(held)) > 1:
            continue
        cell = f"C{len(held) + 1}" + (f"/{held[0]}" if held else "")
        lo, hi = sorted((degree[a], degree[b]))
        out.setdefault((cell, f"{label(lo)}|{label(hi)}"), []).append((a, b))
    return out


@pytest.fixture(scope="module")
def graph():
    r = random.Random(3)
    nodes = []
    for k in range(150):
        p = r.choices(("train", "development", "test"), (7, 2, 1))[0]
        nodes.append((f"n{k:03d}", p, r.choice((0, 1, 1, 2, 4, 120)) if p == "train" else 0))
    cells = enumerated(nodes, ())
    positives = [x for key in sorted(cells) for x in r.sample(cells[key], max(0, len(cells[key]) // (2 if key[1] == "1|2" else 9)))]
    return nodes, positives, cells


def test_designs_and_samples_equal_enumeration(spark, graph):
    nodes, positives, cells = graph
    n = spark.createDataFrame(nodes, "node string, partition string, training_degree long")
    at = {x: (p, d) for x, p, d in nodes}
    p = spark.createDataFrame([(a, b, at[a][0], at[b][0], at[a][1], at[b][1]) for a, b in positives], "a string, b string, qa string, qb string, da long, db long")
    places = D.pool_places(n.repartition(5))
    got = {}
    for r in places.collect():
        got.setdefault(r.pool, []).append((r.place, r.node))
    assert all(sorted(v) == list(enumerate(sorted(x for _, x in v))) for v in got.values())
    designs = D.cell_designs(places, p, 60)
    rows = {(r.cell, r.stratum): r for r in designs.collect()}
    known = set(positives)
    assert {k: (len(v), sum(x in known for x in v)) for k, v in cells.items()} == {k: (r.population, r.positives) for k, r in rows.items()}
    for cell in {c for c, _ in rows}:
        free = sum(r.unlabelled for (c, _), r in rows.items() if c == cell)
        assert sum(r.sample_size for (c, _), r in rows.items() if c == cell) == min(60, free)
    sample = D.unranked_sample(designs, places, p, "s").collect()
    again = D.unranked_sample(designs, places.repartition(3), p, "s").collect()
    assert sorted(map(tuple, sample)) == sorted(map(tuple, again))
    assert len({(r.a, r.b) for r in sample}) == len(sample) and not known & {(r.a, r.b) for r in sample}
    assert all((r.a, r.b) in cells[r.cell, r.stratum] for r in sample)
    assert Counter((r.cell, r.stratum) for r in sample) == {k: r.sample_size for k, r in rows.items() if r.sample_size}
    modes = {r.population <= D.LISTED * (r.sample_size + r.positives) for r in rows.values() if r.sample_size}
    assert modes == {True, False}


def test_draws_are_uniform_and_doubling_changes_nothing(spark):
    row = [("C1", "1|1", "train/1", "train/1", 780, 0, 780, 150, 1, 5)]
    designs = spark.createDataFrame(row, D.DESIGN)
    nodes = spark.range(40).select(F.format_string("n%02d", "id").alias("node"), F.lit("train").alias("partition"), F.lit(1).alias("training_degree"))
    places, none = D.pool_places(nodes), spark.createDataFrame([], "a string, b string")
    first = {s: {(r.a, r.b): r.sample_rank for r in D.unranked_sample(designs, places, none, s).collect()} for s in "xyz"}
    assert all(sorted(v.values()) == list(range(1, 151)) for v in first.values())
    hits = Counter(x for v in first.values() for pair in v for x in pair)
    assert len(hits) == 40 and max(hits.values()) < 3 * min(hits.values())
    more = designs.withColumn("sample_size", F.lit(160).cast("long"))
    assert {k: v for k, v in ((tuple(r[2:4]), r.sample_rank) for r in D.unranked_sample(more, places, none, "x").collect()) if v <= 150} == first["x"]


def test_numbers_of_pairs(spark):
    same = {(i, j) for j in range(60) for i in range(j)}
    x, y = D.pair_places(F.col("id"), F.lit(True), F.lit(1))
    assert {tuple(r) for r in spark.range(1770).select(x, y).collect()} == same
    x, y = D.pair_places(F.col("id"), F.lit(False), F.lit(7).cast("long"))
    assert {tuple(r) for r in spark.range(35).select(x, y).collect()} == set(itertools.product(range(5), range(7)))
    wide = [j * (j - 1) // 2 + i for j in (94_906_266, 10**9, 1_073_000_001) for i in (0, 1, j // 2, j - 1)]
    df = spark.createDataFrame([(n,) for n in wide], "n long")
    got = [tuple(r) for r in df.select(*D.pair_places(F.col("n"), F.lit(True), F.lit(1))).collect()]
    assert got == [(i, j) for j in (94_906_266, 10**9, 1_073_000_001) for i in (0, 1, j // 2, j - 1)]


def test_empty_pools_and_impossible_positives(spark):
    nodes = spark.createDataFrame([("a", "train", 0), ("b", "test", 0)], "node string, partition string, training_degree long")
    none = spark.createDataFrame([], "a string, b string, qa string, qb string, da long, db long")
    places = D.pool_places(nodes)
    designs = D.cell_designs(places, none, 5)
    assert designs.count() == 0 and D.unranked_sample(designs, places, none, "s").count() == 0
    with pytest.raises(ValueError):
        D.cell_designs(places, spark.createDataFrame([("a", "b", "train", "test", 1, 0)], none.schema), 5)
