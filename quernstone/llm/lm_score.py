"""Scores of whole documents under a gated recurrent language model, beside a smoothed unigram one.

Word counts come from all training documents. The most frequent words are outputs of the network; every
other word belongs to one of ``BUCKETS`` outputs by its last two bytes, and has its smoothed share of the
bucket's counts, so that any text, unseen words included, has a probability. The network is trained in
``ROUNDS`` rounds, which share all training documents between them, each read once: a round's documents are dealt to
shards of about ``SHARD_TOKENS`` tokens by a hash, every shard starts from the round's weights and is read by truncated
backpropagation, and the shards' weights are averaged by tokens.

Counts of frequent words are broadcast (``TIER`` words at most); only rarer words travel, once for each document, to
meet their counts, so no word is hot in that join.

Defined cases: a null or empty text is its end token alone; a null doc_id counts as the text '' in the fold's hash;
repeated rows are scored each; without training tokens every count is 0 and the network is as it starts;
an empty table gives an empty table. Texts of any length are read whole, the state carried along.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as R
from .common import durable, quiet_worker, slices

#: Words that are outputs of their own (with the end), bucket outputs, words with broadcast counts and their longest spelling in bytes.
OUTPUTS, BUCKETS, TIER, SPELLING = 1024, 64, 131_072, 64
#: Longer words with broadcast counts, and their longest spelling in bytes.
LONG_TIER, LONGEST = 2048, 2048
#: Rounds of training, which share all training documents between them, and tokens of a shard that is trained on alone within a round.
ROUNDS, SHARD_TOKENS = 2, 3_000_000
SLICE_CHARS, SLICE_ROWS = 12_000_000, 6_000


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def lowered_words(texts: list[str]) -> pa.Array:
    """The lower-cased words of each text (A-Z only), split at the six ASCII white-space characters; one empty piece where there is none."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.string()))))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and c over all rows of docs; the end of a document is the empty word. Words are counted slice by slice before they are dealt out."""

    def count(batches):
        quiet_worker()
        for batch in batches:
            for _, texts in slices(batch, 0, SLICE_CHARS, SLICE_ROWS):
                found = lowered_words(texts).flatten().value_counts()
                words, n = found.field("values"), found.field("counts")
                real = pc.not_equal(words, "")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.filter(real), pa.array([""])]), pa.concat_arrays([n.filter(real), pa.array([len(texts)], pa.int64())])], names=["word", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """What a worker needs to know of the counts: packed for broadcast, unpacked once for each process."""

    def __init__(self, tier: list[tuple[str, int]], bucket_counts: dict[int, tuple[int, int]], n: int, v: int):
        """tier: the most frequent words with their counts, highest first; bucket_counts: tokens and words of each bucket's words, all that aren't outputs."""
        own = [(w, c) for w, c in tier if w != ""][: OUTPUTS - 1]
        ends = next((c for w, c in tier if w == ""), 0)
        mass = {("", -1): ends, **{(w, -1): c for w, c in own}, **{("", b): bucket_counts.get(b, (0, 0))[0] for b in range(BUCKETS)}}
        ranked = sorted(mass.items(), key=lambda x: -x[1])
        self.output = {key: i for i, (key, _) in enumerate(ranked)}
        self.frequencies = np.array([c for _, c in ranked], float)
        self.end, self.of_bucket = self.output[("", -1)], np.array([self.output[("", b)] for b in range(BUCKETS)])
        words = [(w.encode(), c) for w, c in tier if w != ""]
        self.at = {w: i for i, (w, _) in enumerate(words)}
        self.log_c = np.log10(np.array([c for _, c in words] or [1]) + 0.1)
        own_output = {w.encode(): self.output[(w, -1)] for w, _ in own}
        self.id = np.array([own_output.get(w, self.of_bucket[bucket(w)]) for w, _ in words] or [0], np.int32)
        shares = np.array([np.log10(bucket_counts.get(b, (0, 0))[0] + 0.1 * (bucket_counts.get(b, (0, 0))[1] + 1)) for b in range(BUCKETS)])
        self.log_share = shares
        # The log share of its bucket that a word of the tier has; nothing for a word that is an output.
        self.in_bucket = np.array([0.0 if w in own_output else np.log10(c + 0.1) - shares[bucket(w)] for w, c in words] or [0.0])
        self.log_total, self.log_end = float(np.log10(n + 0.1 * (v + 1))) if n + v else float(np.log10(0.1)), float(np.log10(ends + 0.1))
        self.end_known, self.n = ends > 0, n

    def numbers(self, texts: list[str]) -> "Numbered":
        """The output ids of the texts' tokens, ends included, and what scoring needs of their words."""
        split = lowered_words(texts)
        every = split.flatten().dictionary_encode()
        distinct, codes = every.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), every.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        if b"" in distinct:  # the one piece of a text without words
            real = codes != distinct.index(b"")
            codes, owner = codes[real], owner[real]
        places = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int32, len(distinct))
        buckets = np.array([bucket(w) if p < 0 else 0 for w, p in zip(distinct, places.tolist())], int)
        kinds = np.where(places < 0, self.of_bucket[buckets], self.id[places]).astype(np.int32)
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)) + 1)
        ids = np.full(int(ends[-1]) if len(ends) else 0, self.end, np.int32)
        ids[np.arange(len(codes)) + owner] = kinds[codes]
        return Numbered(ids, ends, owner, codes, places, buckets, every.dictionary)


class Numbered:
    """Tokens of some texts as numbers: ids of all in a row with each text's end; per word its text, its distinct word, that one's place in the tier."""

    def __init__(self, ids, ends, owner, codes, places, buckets, words):
        self.ids, self.ends, self.owner, self.codes, self.places, self.buckets, self.words = ids, ends, owner, codes, places, buckets, words

    def docs(self) -> list[np.ndarray]:
        return np.split(self.ids, self.ends[:-1]) if len(self.ends) else []

    def sizes(self) -> np.ndarray:
        return np.diff(np.r_[0, self.ends])

    def summed(self, of_word: np.ndarray) -> np.ndarray:
        """For each text the sum of a number for each of its words."""
        return np.bincount(self.owner, of_word[self.codes], len(self.ends))

    def rare(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(words in each text, words, times) of the distinct words of each text that aren't in the tier."""
        out = self.places[self.codes] < 0
        pairs, times = np.unique(self.owner[out] * max(len(self.places), 1) + self.codes[out], return_counts=True)
        texts, words = np.divmod(pairs, max(len(self.places), 1))
        return np.bincount(texts, minlength=len(self.ends)), self.words.take(pa.array(words)), times


class Shared:
    """A broadcast whose unpacked form a worker process keeps while the key is the same."""

    def __init__(self, spark, value, key: str):
        self.parts, self.key = spark.sparkContext.broadcast(value), key

    def __reduce__(self):
        return _shared, (self.parts, self.key)

    def get(self) -> Vocabulary:
        if self.key not in _KEPT:
            _KEPT.clear()
            _KEPT[self.key] = Vocabulary(*self.parts.value)
        return _KEPT[self.key]


_KEPT: dict[str, Vocabulary] = {}


def _shared(parts, key):
    out = Shared.__new__(Shared)
    out.parts, out.key = parts, key
    return out


def frequent(counts: DataFrame, room: int) -> list[tuple[str, int]]:
    """At most ``room`` words with their counts, highest first: all that are more frequent than any other, by a histogram of the counts' logarithms.

    Of the edge's bin as many hash classes are taken as there is room for, so never more than that many rows travel.
    """
    level, part = F.floor(F.log2("c") * 16).cast("int"), F.pmod(F.xxhash64("word"), F.lit(256)).cast("int")
    own = counts.withColumns({"level": level, "part": part})
    taken, edge = None, None
    for r in own.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 64 x 16 rows at most
        if r.n > room:
            edge = r.level
            break
        taken, room = r.level, room - r.n
    wanted = F.col("level") >= taken if taken is not None else F.lit(False)
    if edge is not None:
        parts = []
        for r in own.where(F.col("level") == edge).groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
            if r.n > room:
                break
            parts.append(r.part)
            room -= r.n
        wanted |= (F.col("level") == edge) & F.col("part").isin(parts) if parts else F.lit(False)
    return sorted(((r.word, r.c) for r in own.where(wanted).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def gather(docs: DataFrame, counts: DataFrame, key: str) -> tuple[Shared, Vocabulary]:
    """The vocabulary from the written counts: sums over all of them, and the TIER most frequent words (LONG_TIER among the long ones)."""
    spark = docs.sparkSession
    length = F.octet_length("word")
    tier = frequent(counts.where(length <= SPELLING), TIER) + frequent(counts.where((length > SPELLING) & (length <= LONGEST)), LONG_TIER)
    tier.sort(key=lambda x: (-x[1], x[0]))
    if not any(w == "" for w, _ in tier):
        tier += [(r.word, r.c) for r in counts.where("word = ''").collect()]
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    last_two = F.expr("crc32(substring(cast(word as binary), greatest(octet_length(word) - 1, 1), 2))") % BUCKETS
    sums = {r.b: [int(r.n), int(r.v)] for r in counts.where("word <> ''").groupBy(last_two.cast("int").alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    for w, c in [(w, c) for w, c in tier if w != ""][: OUTPUTS - 1]:
        sums[bucket(w.encode())][0] -= c
        sums[bucket(w.encode())][1] -= 1
    parts = (tier, {b: tuple(x) for b, x in sums.items()}, int(total.n or 0), int(total.v))
    return Shared(spark, parts, key), Vocabulary(*parts)


def partition_keys(spark, n: int) -> list[int] | None:
    """For each of n partitions the least number that Spark's hash partitioning deals to it; None for many partitions, which even out by themselves."""
    if n > 1024:
        return None
    own = spark.range(64 * n).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id"))
    found = {r.p: r.id for r in own.collect()}
    return [found[p] for p in range(n)] if len(found) == n else None


def train(docs: DataFrame, shared: Shared, vocabulary: Vocabulary, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> dict[str, np.ndarray]:
    """The network's weights after rounds of local training and averaging. docs: doc_id, text of the training documents.

    A document's round and shard are those of a hash of its id and text, and a shard is read in the order of such hashes:
    how the table is dealt to files and tasks has no bearing on the weights.
    """
    spark, w = docs.sparkSession, R.start(vocabulary.frequencies)
    shards = max(1, round(vocabulary.n / rounds / shard_tokens))
    keys = partition_keys(spark, shards)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    shard = F.get(F.array(*(F.lit(k).cast("int") for k in keys)), shard) if keys else shard
    own = docs.select(F.xxhash64("doc_id", "text", F.lit("lm-train")).alias("key"), F.col("text").cast("string").alias("text"))
    own = own.select(F.pmod("key", F.lit(rounds)).alias("turn"), shard.alias("shard"), "key", "text")

    def number(batches):
        quiet_worker()
        known = shared.get()
        for batch in batches:
            for at, texts in slices(batch, 2, SLICE_CHARS // 3, SLICE_ROWS):
                numbered, rows = known.numbers(texts), batch.slice(at, len(texts))
                ids = numbered.ids.astype("<u2")
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.r_[0, 2 * numbered.ends].astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), packed], names=["shard", "key", "ids"])

    for k in range(rounds):
        sent = spark.sparkContext.broadcast(R.flat(w).tobytes())

        def work(batches, sent=sent, k=k):
            quiet_worker()
            known, shard, held, size = shared.get(), None, [], 0
            before = R.shaped(np.frombuffer(sent.value, np.float32), R.start(known.frequencies))

            def learned():
                return pa.RecordBatch.from_arrays([pa.array([trainer.tokens], pa.int64()), pa.array([R.flat(trainer.w).tobytes()], pa.binary())], names=["n", "w"])

            for batch in batches:
                for s, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    if s != shard or size > 2 * shard_tokens:
                        if held:
                            trainer.learn(held, known.end)
                        if s != shard:
                            if shard is not None:
                                yield learned()
                            shard, trainer = s, R.Trainer(before, 0.02 / (k + 1))
                        held, size = [], 0
                    held.append(np.frombuffer(ids, "<u2"))
                    size += len(held[-1])
            if held:
                trainer.learn(held, known.end)
                yield learned()

        def average(batches):
            total, held = 0, 0
            for batch in batches:
                for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held = held + n * np.frombuffer(x, np.float32).astype(float)
                    total += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([(held / total).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

        dealt = own.where(F.col("turn") == k).select("shard", "key", "text").mapInArrow(number, "shard int, key long, ids binary")
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "ids")
        local = durable(dealt.mapInArrow(work, "n long, w binary"), "lm-weights")
        # As many groups as the square root of the tasks: neither a group nor the driver gets all weights.
        tasks = local.count()
        merged = local.repartition(max(1, round(tasks**0.5))).mapInArrow(average, "n long, w binary").collect()
        if merged:
            total = sum(r.n for r in merged)
            w = R.shaped(sum(r.n / total * np.frombuffer(r.w, np.float32).astype(float) for r in merged), w)
    return w


def score_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; docs has doc_id and the text."""
    import uuid

    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    counts = durable(word_counts(docs.where(~held_out())), "lm-counts")
    shared, vocabulary = gather(docs, counts, uuid.uuid4().hex)
    weights = spark.sparkContext.broadcast(R.flat(train(docs.where(~held_out()), shared, vocabulary)).tobytes())
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def work(batches):
        quiet_worker()
        known = shared.get()
        w = R.shaped(np.frombuffer(weights.value, np.float32), R.start(known.frequencies))
        for batch in batches:
            for at, texts in slices(batch, 1, SLICE_CHARS, SLICE_ROWS):
                x = known.numbers(texts)
                there = x.places >= 0
                of_tier = lambda values: np.where(there, values[np.maximum(x.places, 0)], 0.0)  # noqa: B023, E731
                n_known = x.summed(there.astype(float)).astype(np.int64) + known.end_known
                base = x.summed(of_tier(known.log_c)) + known.log_end - x.sizes() * known.log_total
                extra = x.summed(of_tier(known.in_bucket) - np.where(there, 0.0, known.log_share[x.buckets]))
                scores = R.score(w, x.docs(), known.end) / np.log(10) + extra
                sizes, spelled, times = x.rare()
                rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.StructArray.from_arrays([spelled, pa.array(times, pa.int32())], fields=list(rare_type.value_type)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(x.sizes(), pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), rare], names=["doc_id", "n_tokens", "n_known", "base", "model", "rare"])

    kind = dict(docs.dtypes)["doc_id"]
    staged = docs.mapInArrow(work, f"doc_id {kind}, n_tokens long, n_known long, base double, model double, rare array<struct<word: string, n: int>>")
    staged = durable(staged.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    asked = staged.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    met = asked.join(counts, "word", "left")
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("log_c"),
    )
    out = staged.drop("rare").join(met, "row", "left")
    log_c = F.coalesce("log_c", F.lit(0.0))
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") + log_c).alias("base_score"), (F.col("model") + log_c).alias("score"),
    )
