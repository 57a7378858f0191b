"""Extra columns with the operators' own names, and rows without ids in mixing."""

from pyspark.sql import functions as F

from quernstone.llm import licences, mixing, quality, url_filter


def clashing(spark, names):
    rows = [(1, "a b c " * 30, "s"), (2, None, None), (2, "under the mit license", "s"), (None, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in names})


def test_mixing_keeps_columns_of_its_own_names(spark):
    names = ["missing", "whole", "last_key", "bucket", "key", "n", "p_source", "turned_key", "size"]
    got = mixing.mix(clashing(spark, names))
    plain = mixing.mix(clashing(spark, []))
    made = ["doc_id", "size", "source_size", "target", "copies", "taken"]
    assert sorted(map(repr, got.select(made).collect())) == sorted(map(repr, plain.select(made).collect()))
    assert all(r[c] == f"own {c}" for r in got.collect() for c in names if c != "size")


def test_quality_keeps_columns_of_feature_names(spark):
    names = ["upper_share", "chars_per_word", "__words", "whole_row"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality.judge(clashing(spark, names), labels)
    assert got.count() == 4 and all(r[c] == f"own {c}" for r in got.collect() for c in names)


def test_licences_and_urls_with_extra_columns(spark):
    got = licences.summary(licences.scan(clashing(spark, ["label", "start", "matches"]))).collect()
    named = licences.scan(clashing(spark, ["__words", "__at", "__candidates", "a.b"])).collect()
    assert all(r[c] == f"own {c}" for r in named for c in ("__words", "__at", "__candidates", "a.b"))
    assert sorted(r.n_base for r in got) == [0, 0, 0, 1] and {r.labels for r in got} == {"", "mit"}
    pages = spark.createDataFrame([(1, "https://x.de/8", "a"), (2, None, "b")], "page_id long, url string, host string")
    assert url_filter.judge_urls(pages).count() == 2 and url_filter.judge_urls(pages.limit(0)).collect() == []


def test_mixing_meets_its_targets_with_null_and_equal_rows(spark):
    """Rows without ids are told apart by their texts, equal ones taken one by one: the words taken miss a target by half a document at most."""
    made = [(None, "w " * (20 + k % 31), "a") for k in range(1000)] + [(5, "x " * 40, "b")] * 700 + [(None, None, "c")] * 3 + [(k, "long " * 20_000, "d") for k in range(3)] + [(k, "y " * 10, None) for k in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("m.ap", F.create_map(F.lit("k"), F.lit(1)))
    got = mixing.mix(df.repartition(5)).collect()
    taken, target, size, most = {}, {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source], most[r.source] = r.target, r.source_size, max(most.get(r.source, 0), r.size)
    assert len(got) == len(made) and all(abs(taken[s] - target[s]) <= most[s] / 2 for s in taken)
    assert 0 < sum(r.copies == 1 for r in got if r.source == "b") < 700 or taken["b"] % size["b"] == 0
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
