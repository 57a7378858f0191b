"""Small inputs with answers known beforehand."""

from math import isclose

import pytest
from pyspark.sql import functions as F

from quernstone.functions import identity as I
from quernstone.functions import text as X
from quernstone.operators import metrics as M
from quernstone.operators.graph import connected_components, degree_summary, nested_components
from quernstone.operators.reconcile import multiset_match, route_cascade
from quernstone.operators.sampling import bottom_hash_sample, design, hamilton, hamilton_table
from quernstone.operators.split import allocate, trial_order


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_pair_id_is_the_same_both_ways(spark):
    r = one(spark, I.pair_id(F.lit("b"), F.lit("a")).alias("x"), I.pair_id(F.lit("a"), F.lit("b")).alias("y"))
    assert r.x == r.y == "pair:0eab8a0a3380abf4c7d1fb0b43b66aafbb64a4b953e4eb2dccca579461912d0c"


def test_hash_roles(spark):

    rows = spark.range(3000).select(I.hash_role(F.concat(F.lit("a"), "id"), F.lit("z"), "s", "7").alias("r")).groupBy("r").count().collect()
    shares = {r.r: r["count"] / 3000 for r in rows}
    assert abs(shares["train"] - 0.7) < 0.05 and abs(shares["test"] - 0.15) < 0.04


def test_framed_id_separates_parts(spark):
    r = one(spark, I.framed_id("x", F.lit("ab"), F.lit("c")).alias("x"), I.framed_id("x", F.lit("a"), F.lit("bc")).alias("y"), I.framed_id("x", F.lit("é")).alias("z"))
    import hashlib

    assert r.x != r.y
    assert r.z == "x:" + hashlib.sha256((2).to_bytes(8, "big") + "é".encode()).hexdigest()[:32]


def test_degree_bins(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 9, 19, 49, 99, 100)], "d int").select(I.degree_bin(F.col("d")).alias("b")).collect()
    assert [r.b for r in rows] == ["0", "1", "2", "3-4", "5-9", "10-19", "20-49", "50-99", "100+"]
    assert one(spark, I.degree_pair_stratum(F.lit(100), F.lit(2)).alias("s")).s == "2|100+"


def test_hamilton(spark):
    sizes = {"0|0": 9, "0|1": 3, "1|1": 8}
    assert hamilton(sizes, 10) == {"0|0": 4, "0|1": 2, "1|1": 4}
    df = hamilton_table(spark.createDataFrame(list(sizes.items()), "s string, n long"), "s", "n", 10)
    assert {r.s: r.sample_size for r in df.collect()} == hamilton(sizes, 10)
    with pytest.raises(ValueError):
        hamilton(sizes, 2)
    assert hamilton(sizes, 99) == sizes
    assert design(10, 4) == (2, 5, 5, 2)


def test_bottom_hash_sample_with_skewed_keys(spark):
    """Keys that aren't uniform still give the exact sample."""
    rows = spark.createDataFrame([("s", f"ffffff{i:02x}", i) for i in range(50)], "s string, h string, i int")
    sizes = spark.createDataFrame([("s", 50, 5)], "s string, population long, sample_size long")
    assert sorted(r.i for r in bottom_hash_sample(rows, sizes, "s", "h", ["i"]).collect()) == [0, 1, 2, 3, 4]


def scores(spark, rows):
    return spark.createDataFrame([("c", float(s), p, float(w)) for s, p, w in rows], "c string, s double, pos boolean, w double")


def test_concordance_and_average_precision(spark):
    df = scores(spark, [(0.5, True, 1), (1, True, 1), (0, False, 1), (0.5, False, 2), (2, False, 1)])
    got = M.concordance(df, ["c"], "s", F.col("pos"), F.col("w")).first().concordance
    assert isclose(got, 0.5 * ((1 + 1) / 4 + 3 / 4))
    tied = scores(spark, [(1, True, 1), (1, False, 3)])
    assert isclose(M.average_precision(tied, ["c"], "s", F.col("pos"), F.col("w")).first().average_precision, 0.25)


def test_components(spark):
    nodes = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "singleton"]], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("a", "a")], "a string, b string")
    got = dict(map(tuple, connected_components(nodes, edges).collect()))
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "singleton": "singleton"}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "a string, b string")
    assert {r.representative for r in connected_components(chain.select(F.col("a").alias("node")), chain).collect()} == {"n000"}


def tables(spark, tmp_path, **found):
    for name, (rows, columns) in found.items():
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_sizes_at_all_thresholds(spark):
    from quernstone.plans.graphs import al03
    from quernstone.plans.roles import positive_pairs

    d = "/root/testdata/sf0.001"
    parts = [f"P{r.p_partkey}" for r in spark.read.parquet(f"{d}/part.parquet").collect()]
    pairs = positive_pairs(spark, d).collect()
    want = {}
    for least in (1, 2, 3):
        root = {p: p for p in parts}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in pairs:
            if r.n >= least:
                root[top(r.a)] = top(r.b)
        sizes = {}
        for p in parts:
            sizes[top(p)] = sizes.get(top(p), 0) + 1
        ranked = sorted(sizes.values())
        want[least] = (len(ranked), ranked[-1], *(ranked[-(-len(ranked) * q // 100) - 1] for q in (25, 50, 75, 99)))
    assert {r.least_reports: (r.components, r.largest, r.q25, r.q50, r.q75, r.q99) for r in al03(spark, d).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_components_equal_those_from_scratch(spark, seed):
    from random import Random

    r = Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    pick = lambda: r.choice(names)
    edges = [(pick(), pick(), r.choice([1, 3, 3, 4, 4, 4])) for _ in range(45)] + [("n00", "n01", 4), ("n01", "n00", 1), ("n05", "n05", 1), ("n07", "stranger", 1)]  # levels 2 and 5 add nothing
    levels = [1, 2, 3, 4, 5]
    members, judged = nested_components(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(edges, "a string, b string, level int"), levels)
    least = {}
    for a, b, k in edges:
        if a != b and "stranger" not in (a, b):
            key = (min(a, b), max(a, b))
            least[key] = min(k, least.get(key, 9))

    def scratch(level):
        label = {n: n for n in names}
        for _ in names:
            for (a, b), k in least.items():
                if k <= level:
                    label[a] = label[b] = min(label[a], label[b])
        return label

    assert {(x.level, x.node): x.representative for x in members.collect()} == {(k, n): v for k in levels for n, v in scratch(k).items()}
    assert {(x.a, x.b): (x.level, x.crossing) for x in judged.collect()} == {(a, b): (k, scratch(k - 1)[a] != scratch(k - 1)[b]) for (a, b), k in least.items()}


def test_nested_components_of_nothing(spark):
    members, judged = nested_components(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([], "a string, b string, level int"), [1, 2])
    assert sorted(map(tuple, members.collect())) == [(1, "a", "a"), (2, "a", "a")] and judged.isEmpty()


def test_kmer_similarity_reads_whole_texts(spark, tmp_path):
    from quernstone.plans.scoring import heldout_brands, jn27_whole

    texts = {"A": "xxxCOMMON", "B": "yyyCOMMON", "C": "zzzzzz", "D": "xxxq"}
    d = tables(spark, tmp_path, part=(list(texts.items()), "p_brand string, p_type string"))
    held = {r.p_brand for r in heldout_brands(spark, d).collect()}
    count = lambda t: {t[i : i + 3]: sum(t[j : j + 3] == t[i : i + 3] for j in range(len(t) - 2)) for i in range(len(t) - 2)}
    dot = lambda x, y: sum(n * y.get(g, 0) for g, n in x.items())
    k = {b: count(t) for b, t in texts.items()}
    want = {(a, b): round(dot(k[a], k[b]) / (dot(k[a], k[a]) * dot(k[b], k[b])) ** 0.5, 6) for a in k for b in k if b not in held and dot(k[a], k[b])}
    assert {(r.a, r.b): round(r.similarity, 6) for r in jn27_whole(spark, d).collect()} == want and len(held) == 1


def test_bootstrap_has_all_replicates(spark):
    from quernstone.plans.evaluation import al21

    assert al21(spark, "/root/testdata/sf0.001").count() == 3 * 6 * 2000


def test_degree_summary(spark):
    r = degree_summary(spark.createDataFrame([(x,) for x in [0, 0, 1, 1, 2, 6]], "degree long")).first()
    assert (r.n, r.q50, r.q99, r.top_share) == (6, 1, 6, 0.6)


def test_allocation_of_singletons():
    order = trial_order([f"c{i}" for i in range(100)], 1, 17)
    assert sorted(order) == list(range(100)) and order != list(range(100))
    got = allocate([1] * 100, order)
    assert [got.count(k) for k in range(3)] == [70, 15, 15]


def test_numbers_and_sequences(spark):
    r = one(spark, F.round(F.lit("0.6125").cast("decimal(6,4)"), 3).alias("a"), F.round(F.lit("0.6124").cast("decimal(6,4)"), 3).alias("b"), I.choose_two(F.lit(17000)).alias("c"), X.translate_cds(F.lit("ATGAAATAA")).alias("d"), X.segments(F.lit(256)).alias("e"), F.size(X.segments(F.lit(10000))).alias("f"), X.ngrams(F.lit("ab")).alias("g"), X.ngrams(F.lit("abcd")).alias("h"))
    assert (str(r.a), str(r.b), r.c, r.d) == ("0.613", "0.612", 144491500, "MK")
    assert [tuple(x) for x in r.e] == [(0, 128), (128, 256)] and r.f == 32 and r.g == [] and r.h == ["abc", "bcd"]
    with pytest.raises(Exception, match="multiple of three"):
        one(spark, X.translate_cds(F.lit("ATGA")))


def test_source_fields(spark):
    r = one(spark, X.term(F.lit("psi-mi:MI:0397(two hybrid array)"))[0].alias("a"), X.term(F.lit("psi-mi:MI:0397(two hybrid array)"))[1].alias("b"), X.feature_range(F.lit("tag:4-8"))[1].alias("c"), X.feature_range(F.lit("tag:?-8"))[0].alias("d"), X.without_version(F.lit("A.1.2")).alias("e"), X.before_dot(F.lit("A.1.2")).alias("f"), X.pipe_list(F.lit("-")).alias("g"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("MI:0397", "two hybrid array", 8, None, "A.1", "A", [])


def test_route_cascade_and_multiset(spark):
    first = spark.createDataFrame([(1, "x")], "k int, v string")
    second = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted((r.k, r.v) for r in route_cascade([first, second], "k").collect()) == [(1, "x"), (2, "z")]
    parent = spark.createDataFrame([("a", i) for i in range(3)], "k string, at int")
    got = multiset_match(parent, parent.where("at < 2"), ["k"], "at").orderBy("at").collect()
    assert [r.matched for r in got] == [True, True, False]


def test_seeds_are_the_first_eight_bytes(spark):
    from quernstone.operators.bootstrap import cell_seed

    for cell in ("C1", "C3_development", "x:y"):
        assert int(one(spark, I.seed_u64(F.lit("20260803"), F.lit("bootstrap"), F.lit(cell)).alias("s")).s) == cell_seed("20260803", cell)


def test_ensemble_census(spark):
    from quernstone.operators.contracts import ensemble_census

    rows = [(1.0, 2.0, 3.0, 2.0), (1.0, 2.0, 3.0, 2.5), (None, 2.0, 3.0, 2.0), (1.0, float("nan"), 3.0, 2.0), (1.0, 2.0, float("inf"), 2.0)]
    df = spark.createDataFrame(rows, "`a.1` double, b double, c double, mean double")
    assert tuple(ensemble_census(df, {"mean": ["a.1", "b", "c"]}).first()) == ("mean", 5, 3, 1, 0.5)
    assert ensemble_census(df.limit(0), {"mean": ["b", "c"]}).isEmpty()
    for bad in ({"mean": []}, {"mean": ["b", "b"]}, {"mean": ["none"]}, {"mean": ["mean", "b"]}):
        with pytest.raises(ValueError):
            ensemble_census(df, bad)


def test_hubs_with_ties(spark):
    from quernstone.operators.graph import hubs

    rows = [(f"n{i:03d}", 9 if i % 50 == 7 else 1 + i % 2) for i in range(101)]
    df = spark.createDataFrame(rows, "node string, degree long")
    for percent in (1, 5, 60, 100):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[: -(-101 * percent // 100)]
        assert sorted(map(tuple, hubs(df.repartition(5), percent).collect())) == sorted(want)
    assert hubs(df.limit(0), 5).isEmpty()
