"""Decontamination against a scan of every window at every place."""

import random
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from quernstone.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items, size=D.WINDOW, shingle=D.SHINGLE, share=Fraction(1)):
    windows = {(i or "", tuple(w[p : p + size])) for i, t in items for w in [words(t)] for p in range(max(1, len(w) - size + 1) if w else 0)}
    out = Counter()
    for row, text in docs:
        w, hit, found = words(text), set(), set()
        for item, v in windows:
            k = min(shingle, len(v))
            n = len(v) - k + 1
            for p in range(len(w) - len(v) + 1):
                if sum(tuple(w[p + j : p + j + k]) == v[j : j + k] for j in range(n)) >= share * n:
                    hit |= set(range(p, p + len(v)))
                    found.add(item)
        out[row, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def got(df):
    rows = df.collect()
    for r in rows:
        assert r.n_hit == sum(s.last - s.first + 1 for s in r.spans) and all(a.last + 1 < b.first for a, b in zip(r.spans, r.spans[1:]))
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "Cc", "d9", "é", "日本", "the", "of", "ß"])
    items = [(str(k), " ".join(word() for _ in range(rng.randint(1, 18)))) for k in range(30)]
    items += [("x", None), ("y", " .,;"), ("7", "the of\tthe, of"), (None, "no id at all here but more than ten words stand in it"), ("z", items[0][1]), ("0", items[0][1])]
    docs = [(1, None), (2, ""), (3, "..."), (4, "a"), (None, "no id at all here but more than ten words stand in it today"), (5, "of the of the of the of the of the of the " * 40)]
    for k in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        docs.append((10 + k, rng.choice(["", rng.choice(items)[1] or ""]) + "-" + text.upper() + "\n" + (rng.choice(items)[1] or "")))
    return docs + docs[-3:], items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, f"own {i}") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, n_words int")


def test_equals_a_plain_scan(spark):
    docs, items = made()
    d, b = frames(spark, docs, items)
    assert got(D.decontaminate(d, b)) == plain(docs, items)
    assert got(D.decontaminate(d, b, size=4, shingle=2)) == plain(docs, items, 4, 2)


def test_blocks_give_the_same(spark):
    docs, items = made(9)
    d, b = frames(spark, docs, items)
    assert got(D.decontaminate(d, b, block_bytes=900)) == plain(docs, items)


def test_share_of_shingles(spark):
    docs, items = made(11)
    docs.append((99, "one two three four five SIX seven eight nine ten eleven"))
    items.append(("q", "one two three four five 6 seven eight nine ten eleven twelve"))
    d, b = frames(spark, docs, items)
    for share in ("0.6", "0.4"):
        assert got(D.decontaminate(d, b, containment=share)) == plain(docs, items, share=Fraction(share))


def test_empty_tables_and_kept_columns(spark):
    docs, items = made()
    d, b = frames(spark, docs, items)
    assert D.decontaminate(d.limit(0), b).collect() == []
    clean = D.decontaminate(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in clean)
    odd = d.withColumn("a.b", F.lit(3)).withColumn("n_hit", F.lit("mine"))
    kept = D.decontaminate(odd, b, keep=("doc_id", "a.b"))
    assert kept.columns[:2] == ["doc_id", "a.b"] and {r["a.b"] for r in kept.collect()} == {3}


def test_long_document_is_read_whole(spark):
    item = "here is a passage of more than ten words that ends it all"
    text = "filler words go on " * 200_000 + item
    d, b = frames(spark, [(1, text), (2, item)], [("1", item)])
    assert got(D.decontaminate(d, b)) == Counter({(1, 800_013, 13, ("1",)): 1, (2, 13, 13, ("1",)): 1})
