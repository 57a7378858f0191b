"""Each operator against a plain version of itself on small, awkward inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import bpe, byteunits, licences, lm_score, mixing, quality, simhash, store, token_counts, topk, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "A b"), (6, "The cat sat on the mat. The cat sat."), (7, "the cat sat on the mat. the cat sat."),
    (8, "x<|endoftext|>y <|startoftext|> z"), (9, "déjà vu ΑΣ Σ ñ İ 日本語 🎉🏽 ½ a\x1cb\x85c\xa0d"), (10, "word " * 3000), (11, "q" * 5000), (12, "Under the MIT License, under the mit license.\nApache License, Version 2.0 cc-by-nc"),
    (12, "Under the MIT License, under the mit license.\nApache License, Version 2.0 cc-by-nc"), (13, "  lead   and\n\n trail \n x  "), (14, "don't I'LL we've 'S 12345 a1b2"), (None, "no id here"), (15, "#### $$$ x | y\nx | y\nx | y\n\nz"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"extra{i}") for i, t in DOCS], "doc_id long, text string, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_bpe_equals_the_library(spark, docs, empty):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, x in DOCS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.bpe_encode(docs, path, outputs=("n_tokens", "ids_text", "decoded", "ids"))
    assert rows(got, "doc_id", "n_tokens", "ids_text", "decoded") == want
    assert all(" ".join(map(str, r.ids)) == r.ids_text for r in got.collect())
    assert bpe.bpe_encode(empty, path).collect() == []
    e = bpe.WordEncoder(path)
    ids = t.encode("round trips are exact", add_special_tokens=False).ids
    assert e.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_units_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    t, u = Tokenizer.from_file(path), byteunits.UnitCache(byteunits.ByteUnits(path), 50, "<u4")
    rng = np.random.default_rng(5)
    bits = [" ", "  ", "\n", "\t", "a", "B.", "'s", "12", "é", "<|endoftext|>", "中", "\x1c", "\x85", "\xa0", "don't", " of", "ab\ncd", "🎉"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(4000)] + [x or "" for _, x in DOCS]
    cut = [u.units.of(x) for x in texts]
    for x, c, e in zip(texts, cut, t.encode_batch(texts, add_special_tokens=False)):
        known = u.known([c])
        assert np.frombuffer(b"".join(known[k] for k in c), "<u4").tolist() == e.ids, x


def test_token_counts(spark, docs, empty):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in DOCS)
    assert rows(token_counts.count_tokens(docs, path), "doc_id", "n_tokens") == want
    assert rows(token_counts.count_tokens(docs, path, table=3), "doc_id", "n_tokens") == want
    assert token_counts.count_tokens(empty, path).collect() == []
    units = ["of", "the", "é" * 40]
    assert token_counts.unpacked(token_counts.packed(units, [1, 1, 300])) == {"of": 1, "the": 1} and token_counts.unpacked(token_counts.packed([], [])) == {}


def test_store_round_trip(spark, docs, empty):
    path, t = P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    place = store.new_path(spark)
    root = store.write_store(docs, place, path)
    got = store.read_store(spark, place).orderBy("row").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in DOCS), key=lambda i: (i is not None, i))
    text, at = defaultdict(list), 0
    for i, x in DOCS:
        text[i].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert list(r.ids) in text[r.doc_id] and r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    light = store.read_store(spark, place, ids=False)
    assert rows(light, "row", "start", "n_tokens", "ids_crc32") == Counter((r.row, r.start, r.n_tokens, r.ids_crc32) for r in got)
    chunks = spark.read.parquet(f"{place}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() and store.manifest(spark, place)["root"] == root
    other = store.new_path(spark)
    store.write_store(empty, other, path)
    assert store.read_store(spark, other).collect() == []
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000).astype("<u2")
    a, b = store.cuts(ids), store.cuts(np.concatenate([ids[:777], ids]))
    assert len({x + 777 for x in a} & set(b)) > 0.9 * len(a) and max(np.diff([0, *b])) <= store.LONGEST
    one, two = b"some bytes", b"and more of them"
    assert store.CrcCombine()(zlib.crc32(one), zlib.crc32(two), len(two)) == zlib.crc32(one + two)


def plain_statistics(x):
    w = WORD.findall(x or "")
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if windows[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [s for s in (x or "").split("\n") if WORD.search(s)]
    return len(w), sum(map(len, w)), sum((x or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_rules(spark, docs, empty):
    rng, made = np.random.default_rng(3), []
    for k in range(600):
        words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(80)]
        made.append((k, " ".join(w + "###" if k % 4 == 0 else w for w in words), int(k % 4 != 0)))
    many = spark.createDataFrame(made, "doc_id long, text string, quality int")
    labels = many.select("doc_id", "quality").union(spark.createDataFrame([(9999, 0), (1, None), (None, 1)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.judge(many.select("doc_id", "text"), labels).collect()}
    assert all(got[k].kept == bool(q) for k, _, q in made)
    base = quality.judge(docs.select("doc_id", "text"), labels.limit(0))
    assert rows(base, "doc_id", *quality.COUNTS) == Counter((i, *plain_statistics(x)) for i, x in DOCS)
    assert all(r.kept == (not r.base_failed) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in base.collect())
    assert quality.judge(empty.select("doc_id", "text"), labels).collect() == []
    kept = quality.accepted(many.select("doc_id", "text", F.lit("x").alias("kept")), labels)
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == 450
    assert quality.learn([], []) == []


def test_repeated_words_with_colliding_hashes(spark, docs, monkeypatch):
    """Windows of equal hashes and different words are not repeats, even where they stand between repeats."""
    texts = DOCS + [(50, "a b c x y z a b c"), (51, "a b c d e f g h i"), (52, "p q r s t u p q r v w x s t u"), (53, "long short long short long short " * 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(quality.F, "xxhash64", lambda *words: F.length(words[0]).cast("long"))
    got = quality.statistics(df).collect()
    assert Counter((r.doc_id, r.n_repeat_words) for r in got) == Counter((i, plain_statistics(x)[4]) for i, x in texts)


def test_licences(spark, docs, empty):
    word = re.compile(licences.WORD)
    want = Counter()
    for i, x in DOCS:
        w = word.findall((x or "").translate(LOW))
        at = [(p, label) for label, phrase in licences.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        want[(i, len(w), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None), ",".join(sorted({k for _, k in at})))] += 1
    got = licences.summary(licences.scan(docs.select("doc_id", "text")))
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    more = spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to ANY person obtaining a copy of this software"), (2, "permission to park free of charge")], "doc_id long, text string")
    found = {r.doc_id: r for r in licences.summary(licences.scan(more)).collect()}
    assert found[1].labels == "mit" and found[1].score == pytest.approx(1.0) and (found[2].labels, found[2].score) == ("", 0.0)
    assert licences.summary(licences.scan(empty.select("doc_id", "text"))).collect() == []


def test_licences_by_mandatory_phrases(spark):
    """The mandatory phrases decide, whatever other words of the passage stand in the text or in the corpus."""
    texts = ["see the GNU General Public License for details", "GNU General Public License", "under the terms of the gnu general public licence", "the software is provided as is, without warranty", "permission was hereby granted free of charge to all"]
    got = licences.summary(licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {r.doc_id: r.labels for r in got} == {0: "gpl", 1: "gpl", 2: "", 3: "mit", 4: "mit"}


def test_lm_base_scores_and_learning(spark, docs, empty):
    got = lm_score.score_documents(docs).collect()
    token = lambda x: WORD.findall((x or "").translate(LOW)) + [""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, x in DOCS if not held(i) for w in token(x))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(token(x)), sum(c[w] > 0 for w in token(x)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(x)), 6)) for i, x in DOCS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_score.score_documents(empty).collect() == []
    rng, text = np.random.default_rng(2), []
    for k in range(400):
        words = [f"{'xy'[k % 2]}{j}" for j in rng.integers(0, 40, 60)]
        text.append((k, " ".join(words)))
    out = [r for r in lm_score.score_documents(spark.createDataFrame(text, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.3 * len(out)  # which of two languages a text is in is learned


def test_lm_training_reads_every_share(spark):
    """Training documents of any hash share move the weights."""
    import uuid

    turn = F.pmod(F.xxhash64("doc_id", F.lit("lm-train")), F.lit(8))
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x y z " * 20).alias("text")).withColumn("turn", turn)
    counts = lm_score.durable(lm_score.word_counts(df), "lm-counts")
    shared, vocabulary = lm_score.gather(df, counts, uuid.uuid4().hex)
    start = lm_score.R.flat(lm_score.R.start(vocabulary.frequencies))
    for k in range(8):
        one = df.where(F.col("turn") == k)
        assert one.count() and not np.array_equal(lm_score.R.flat(lm_score.train(one, shared, vocabulary)), start), k


def test_recurrent_gradients():
    from quernstone.llm import recurrent as R

    w = {k: v.astype(np.float32) for k, v in R.start(np.arange(70, 0, -1.0)).items()}
    rng = np.random.default_rng(0)
    w["o"] += rng.normal(0, 0.3, w["o"].shape).astype(np.float32)
    w["c"] += rng.normal(0, 0.3, w["c"].shape).astype(np.float32)
    docs = [rng.integers(0, 70, n).astype(np.int32) for n in (7, 4, 9)]
    t, seen = R.Trainer(w), {}
    t._step = lambda g: seen.update(g)
    t.learn(docs, 3, lanes=2, steps=50)
    total = sum(map(len, docs))
    for name, at in (("x", (5, 20)), ("u", (3, 40)), ("b", (10,)), ("c", (2, 1)), ("o", (1, 4, 7)), ("ob", (0, 3)), ("cb", (1,))):
        low, high = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
        if name == "x":
            at = (int(docs[2][3]), 20)
        low[name][at] -= 1e-2
        high[name][at] += 1e-2
        slope = -(R.score(high, docs, 3).sum() - R.score(low, docs, 3).sum()) / 2e-2 / total
        assert seen[name][at] == pytest.approx(slope, abs=2e-3), name


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(400)] + [(i, [1.0] * 8) for i in range(400, 460)]
    x += [(500, None), (520, [1.0, None]), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (580, [2.0]), (60, [0.5] * 8), (None, [1.0] * 8)]
    got = topk.top_k(spark.createDataFrame(x, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0, k=20, pivots=6)
    fine = [(n, i, np.array([math.floor(64 * float(np.float32(c))) for c in v] + [0] * (8 - len(v)))) for n, (i, v) in enumerate(x) if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = Counter()
    for n, i, q in fine:
        if i % 20 == 0:
            best = sorted(((-int(q @ v), j) for m, j, v in fine if m != n))[:20]
            want.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    assert rows(got, "query_id", "rank", "vec_id", "score") == want
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(few, lambda i: i % 20 == 0).collect())) == [(0, 1, 2, 8192), (0, 2, 1, 4096)]
    assert topk.top_k(few.limit(0), lambda i: i % 20 == 0).collect() == []


def components(fps, ids):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(fps))]


def plain_fingerprint(x):
    w = WORD.findall((x or "").translate(LOW))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs)
    fps = [plain_fingerprint(x) for _, x in DOCS]
    want = Counter((i, f, c) for (i, _), f, c in zip(DOCS, fps, components(fps, [i for i, _ in DOCS])))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(list)
    for (i, _), c in zip(DOCS, components(fps, [i for i, _ in DOCS])):
        groups[c].append(i)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(c or 0 for c in groups)


def test_kept_rows_by_component_not_id(spark):
    """Null and repeated ids: each component keeps one row, whatever ids its rows share with others."""
    rng = np.random.default_rng(12)
    a, b, *clean = [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(80)) for _ in range(8)]
    data = [(3, a), (5, a), (5, b), *((None, x) for x in clean), (None, clean[0]), (7, clean[1])]
    got = simhash.kept_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, a), (5, b), (None, clean[0]), (7, clean[1]), *((None, x) for x in clean[2:])])


def test_near_copies_by_shingles(spark, monkeypatch):
    """Near copies of five-word similarity 0.8 or more go, less similar ones stay; the same in full buckets of many blocks."""
    rng = np.random.default_rng(13)

    def jaccard(x, y):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in (x, y))
        return len(x & y) / len(x | y)

    data, apart = [(900, None), (901, " "), (902, "a b"), (903, "A  b")], 0
    for k in range(12):
        words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]
        data.append((k, " ".join(words)))
        for j, edits in enumerate((1, 2, 3, 3, 4, 5, 6, 12)):
            other = list(words)
            for at in rng.choice(200, edits, replace=False):
                other[at] = "changed"
            data.append((None if j == 1 else 20 * (j + 1) + k, " ".join(other)))
            apart += jaccard(data[-1][1], " ".join(words)) >= 0.8 and (plain_fingerprint(data[-1][1]) ^ plain_fingerprint(" ".join(words))).bit_count() > 2
    assert apart > 20
    texts = [x or "" for _, x in data]
    parent = list(range(len(data)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if jaccard(texts[i].lower(), texts[j].lower()) >= 0.8:
                parent[top(i)] = top(j)
    want = {}
    for i, (d, _) in enumerate(data):
        want[top(i)] = min(want.get(top(i), 10**6), 10**6 if d is None else d)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = simhash.kept_documents(df, shingle=5, similarity=0.8)
    assert sorted(10**6 if r.doc_id is None else r.doc_id for r in got.collect()) == sorted(want.values())
    # All texts in one bucket, and that dealt to many blocks: the same rows stay.
    monkeypatch.setattr(simhash, "band_keys", lambda members: np.zeros(min(len(members), 1), np.int64))
    for block in (8, 256):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert sorted(10**6 if r.doc_id is None else r.doc_id for r in simhash.kept_documents(df, shingle=5, similarity=0.8).collect()) == sorted(want.values())


def test_simhash_full_cells(spark):
    """A group whose cells are too full to be paired keeps all its links, and chains stay chains."""
    rng = np.random.default_rng(8)
    base, points = [int(x) for x in rng.integers(0, 2**63, 3)], set()
    for _ in range(500):
        points.add(base[0] ^ sum(1 << int(b) for b in rng.choice(10, rng.integers(0, 4), replace=False)))
    for k in range(30):
        points.add(base[1] ^ ((1 << 2 * k) - 1))
        points.add(base[2] ^ ((1 << 3 * (k % 20)) - 1))
    points = sorted(points)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    ours = defaultdict(set)
    for p in points:
        s = int(np.uint64(p).astype(np.int64))
        ours[root.get(s, s)].add(p)
    theirs = defaultdict(set)
    for p, c in zip(points, components(points, list(range(len(points))))):
        theirs[c].add(p)
    assert {frozenset(x) for x in ours.values()} == {frozenset(x) for x in theirs.values()}


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://www.Example.COM/en/7?x", "http://com/en/", "http://a.net/de/x#y", "http://x.example.net/de/8/", "https://org/es", "http://a.org/es/", "http://x.org/a.com/en/b", "ftp://ads.x/y", "http://h/" + "p" * 3000 + ".exe", "http://é.com/en/ü", "http://u:p@ex.com:80/en/1"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = sorted((len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
        rule = fits[-1] if fits else (0, None, "block" if any(re.search(url_filter.regex_of(g), f".{host}{path}") for g in url_filter.BLOCKED) else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule[1], rule[2]), u
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_mixing(spark, empty):
    rng = np.random.default_rng(6)
    data = [(k, "w " * int(rng.integers(0, 40)), None if k % 11 == 0 else f"s{k % 5}" if k % 2 else "s0") for k in range(900)] + [(5, "w w", "s0"), (5, "w w", "s0"), (None, None, "zz")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df)
    r = got.collect()
    size, target, taken = Counter(), {}, Counter()
    for x in r:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken <= 3 * x.size and x.taken == x.size * x.copies
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, level, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 0.0, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        level = left / max(sum(weight[s] for s in size if s not in full), 1)
        more = {s for s in size if s not in full and weight[s] * level > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in size:
        assert target[s] == pytest.approx(3 * size[s] if s in full else weight[s] * level)
        assert abs(taken[s] - target[s]) <= 20
    assert rows(mixing.mix(df.repartition(7)), "doc_id", "size", "taken", "source") == rows(got, "doc_id", "size", "taken", "source")
    assert mixing.mix(empty).collect() == []


def test_full_buckets_lose_no_link(spark, monkeypatch):
    """Three texts linked in a chain, among few and many texts of one bucket that share half of their words: the same ones stay."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    shared = [word() for _ in range(100)]
    chain = [word() for _ in range(200)]
    links = [list(chain) for _ in range(3)]
    for k, other in enumerate(links):
        for at in range(4 * k):
            other[10 + 9 * at] = "changed"
    data = [(k, " ".join(x)) for k, x in enumerate(links)]
    monkeypatch.setattr(simhash, "band_keys", lambda members: np.zeros(min(len(members), 1), np.int64))
    for fillers in (10, 300, 3000):
        more = [(100 + k, " ".join(shared + [word() for _ in range(100)])) for k in range(fillers)]
        df = spark.createDataFrame(data + more, "doc_id long, text string").repartition(4)
        stay = {r.doc_id for r in simhash.kept_documents(df, shingle=5, similarity=0.8).collect()}
        assert stay == {0, *(i for i, _ in more)}, fillers


def test_near_copies_come_from_fingerprints(spark, monkeypatch):
    """The grid of fingerprints finds copies that no band holds; sets of a bucket that are far apart by their fingerprints are not read."""
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    data = []
    for k in range(20):
        words = [word() for _ in range(1500)]
        data += [(k, " ".join(words)), (100 + k, " ".join(words[:-1] + ["changed"]))]
    prints = {d: simhash.set_fingerprint(simhash.shingle_set(t, 5)) for d, t in data}
    apart = lambda x, y, n: int(np.bitwise_count(prints[x][:n] ^ prints[y][:n]).sum())
    close = {k for k in range(20) if apart(k, 100 + k, 1) <= simhash.APART}
    assert len(close) > 5
    most = simhash.near_bits(simhash.Fraction("0.8"))
    assert all(apart(k, 100 + k, None) <= most for k in range(20)) and all(apart(k, j, None) > most for k in range(20) for j in range(k))
    df, read = spark.createDataFrame(data, "doc_id long, text string").repartition(3), []
    monkeypatch.setattr(simhash, "band_keys", lambda members: np.zeros(0, np.int64))
    stay = {r.doc_id for r in simhash.kept_documents(df, shingle=5, similarity=0.8).collect()}
    assert stay == {d for d, _ in data} - {100 + k for k in close}
    monkeypatch.setattr(simhash, "band_keys", lambda members: np.zeros(min(len(members), 1), np.int64))
    sets = simhash.shingle_sets
    monkeypatch.setattr(simhash, "shingle_sets", lambda rows, text, shingle, wanted: read.append(wanted.count()) or sets(rows, text, shingle, wanted))
    assert simhash.kept_documents(df.where("doc_id < 100"), shingle=5, similarity=0.8).count() == 20 and read == [0]
    assert simhash.kept_documents(df, shingle=5, similarity=0.8).count() == 20 and read == [0, 40]


def test_kept_documents_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__row": F.lit("r"), "__late": F.lit("l"), "__id": F.lit("i"), "row": F.lit(1), "a.b": F.lit("dot")})
    for more in ({}, {"shingle": 5, "similarity": 0.8}):
        got = simhash.kept_documents(df, **more)
        assert got.columns == df.columns and sorted((r.doc_id for r in got.collect())) == [1, 3]
        assert {tuple(r[c] for c in df.columns[2:]) for r in got.collect()} == {("r", "l", "i", 1, "dot")}
    assert simhash.kept_documents(df.limit(0), shingle=5, similarity=0.8).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    rng, data, labels = np.random.default_rng(9), [], []
    for k in range(120):
        words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(90)]
        text = " ".join(words)
        data.append((k, text + (" ####" * 80 if k % 5 == 0 else ""), "en", f"s{k % 3}", len(text)))
        labels.append((k, int(k % 5 != 0), 0))
    data += [(1000 + k, data[k + 1][1], "en", "s1", 1) for k in range(10)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = C.durable(C.quality_rules(spark, docs, str(tmp_path)), "t")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in data if (i if i < 1000 else i - 999) % 5}
    once = C.durable(C.near_dedup(spark, kept, ""), "t")
    assert {r.doc_id for r in once.collect()} == {i for i in range(120) if i % 5}
    mixed = C.durable(C.mixture(spark, once, ""), "t")
    assert mixed.columns == docs.columns
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = {i: x for i, x, *_ in data}
    for r in C.token_ids(spark, mixed, "").collect():
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert C.run(spark, str(tmp_path)).count() == mixed.count()


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated and very long rows, columns of any name; an empty table runs through."""
    import corpus_pipeline as C

    rng = np.random.default_rng(30)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    texts = [prose(120) for _ in range(20)]
    data = [(k, x, f"s{k % 2}") for k, x in enumerate(texts)] + [(None, texts[3], "s1"), (4, texts[4], "s0"), (4, texts[4], "s0"), (50, None, "s0"), (51, "", None), (None, None, None), (52, prose(20_000), None), (53, prose(80), None)]
    docs = spark.createDataFrame([(i, t, s, "own") for i, t, s in data], "doc_id long, text string, source string, `a.b` string").withColumn("__row", F.lit(7))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = C.durable(C.quality_rules(spark, docs, str(tmp_path)), "t")
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, _ in data if t and len(t.split()) >= 50)
    once = C.durable(C.near_dedup(spark, kept, ""), "t")
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == [*range(20), 52, 53]
    mixed = C.durable(C.mixture(spark, once, ""), "t")
    assert mixed.columns == docs.columns and all(r["a.b"] == "own" and r["__row"] == 7 for r in mixed.collect())
    assert C.token_ids(spark, mixed, "").count() == mixed.count() > 0
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert C.run(spark, str(tmp_path / "none")).collect() == []


def test_whole_texts_by_units_equal_the_library():
    """Fuzz of the path that encodes plain texts whole: ids as by the library for every text that it takes."""
    path = P.path("byte_bpe_50k.json")
    t, units = Tokenizer.from_file(path), byteunits.ByteUnits(path)
    rng = np.random.default_rng(77)
    bits = [*map(chr, range(0, 0x250, 3)), " ", "  ", "\n", "\n\n", "\t", "'s", "'LL", "don't", "12", "3,000", "abc", "The", " of", "...", "--", "<|endoftext|>", "\xad", "\x85", "é", "Ä"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(5000)]
    whole = [units.whole(x) for x in texts]
    for x, got, e in zip(texts, whole, t.encode_batch(texts, add_special_tokens=False)):
        assert got is None or list(got) == e.ids, x
    assert sum(g is not None for g in whole) > 500
