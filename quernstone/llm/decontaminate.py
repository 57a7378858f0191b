"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A record is a window of consecutive words of a benchmark item (the whole item, if that is shorter), taken as the set of its
shingles with their places. A part of a document with as many words holds it where at least the wanted share of these shingles
stands in place. Of a record's n shingles, o of which have to be found, any such place has one of the n - o + 1 rarest: only these are
joined with the documents (one, for exact containment). Rarity is the number of times a shingle stands in the corpus, counted in
one pass over all documents. A shingle met at word p puts the record's start at p less the shingle's place in it; starts before
the first word, or too near the last one for the record's length, go. What is left is verified word by word.

The distinct (window, item) pairs are dealt to blocks of bounded size, and each block is broadcast in turn to the tasks that read the
documents; with several blocks (a benchmark beyond ``BLOCK_BYTES``) a document's finds are put together at the end.

Defined cases: a null text has no words, neither has a null item; rows of one item_id are one item; an item without an id is one
of id ''; repeated documents keep a row each; long documents are read whole; an empty benchmark hits nothing; an empty table of documents
gives an empty table. Other columns of both tables don't matter; those named in ``keep`` are kept.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices

#: Words in a window and in a shingle; bytes of windows in a block that is broadcast.
WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 32 * 2**20
#: Bytes to bytes: A-Z lower-cased, every other ASCII character but a-z and 0-9 a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
FOUND = "n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text in UTF-8."""
    return text.translate(FOLD).split() if text else []


def windows(items: DataFrame, text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """The distinct (item, window): windows of ``size`` consecutive words, joined by spaces; a shorter item is one window."""

    def cut(batches):
        for batch in batches:
            names, found = [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(t)
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    names.append(name)
                    found.append(b" ".join(w[i : i + size]))
                    if len(found) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])
                        names, found = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(cut, "item string, window binary").distinct()


class Records:
    """The windows of one block: distinct windows as rows of word numbers, their items, and keys of shingles.

    Word numbers begin with 1; 0 is any word that no window has. A shingle's key is the number that its words' numbers are the digits of,
    so different shingles have different keys.
    """

    def __init__(self, pairs: list[tuple[str, bytes]], shingle: int = SHINGLE, containment: Fraction = Fraction(1)):
        place: dict[bytes, int] = {}
        of_window: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        for item, window in pairs:
            r = of_window.setdefault(window, len(of_window))
            if r == len(self.items):
                self.items.append([])
            self.items[r].append(item)
        cut = [w.split(b" ") for w in of_window]
        for w in cut:
            for x in w:
                place.setdefault(x, len(place) + 1)
        self.place, self.base, self.size = place, len(place) + 1, max(map(len, cut), default=0)
        while self.base**shingle >= 2**63:  # so many different words: shorter shingles, whose keys are exact
            shingle -= 1
        self.length = np.array([len(w) for w in cut], np.int64)
        self.words = np.zeros((len(cut), self.size), np.int64)
        for r, w in enumerate(cut):
            self.words[r, : len(w)] = [place[x] for x in w]
        self.shingle = np.minimum(shingle, self.length)
        self.of_record = self.length - self.shingle + 1  # shingles in a record
        self.need = -(-self.of_record * containment.numerator // containment.denominator)
        # Every shingle of every record: its length and key, the record, and its place in it.
        kinds = []
        for k in np.unique(self.shingle).tolist():
            rows = np.flatnonzero(self.shingle == k)
            keys = self.keys(self.words[rows].reshape(-1), k)
            at = np.arange(self.size - k + 1)
            flat = (np.arange(len(rows))[:, None] * self.size + at).reshape(-1)
            inside = (at[None, :] < self.of_record[rows][:, None]).reshape(-1)
            kinds.append((k, keys[flat[inside]], np.repeat(rows, len(at))[inside], np.tile(at, len(rows))[inside]))
        self.shingles = {k: (keys, r, at) for k, keys, r, at in kinds}
        self.known = {k: np.unique(keys) for k, (keys, _, _) in self.shingles.items()}
        self.index: dict[int, tuple] = {}

    def keys(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """The key of the k words that begin at each place, 0 where one of them is unknown."""
        n = max(len(numbers) - k + 1, 0)
        out, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            part = numbers[j : j + n]
            out = out * self.base + part
            whole &= part > 0
        return np.where(whole, out, 0)

    def numbers(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts, an unknown word behind each, and the texts' numbers of words."""
        every, sizes = [], []
        for t in texts:
            w = words_of(t)
            sizes.append(len(w))
            every += w
            every.append(b"")
        return np.fromiter(map(self.place.get, every, repeat(0)), np.int64, len(every)), np.array(sizes, np.int64)

    def count(self, numbers: np.ndarray) -> dict[int, np.ndarray]:
        """How often each known shingle stands in a run of texts."""
        out = {}
        for k, known in self.known.items():
            keys = self.keys(numbers, k)
            keys = keys[keys > 0]
            i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            out[k] = np.bincount(i[known[i] == keys], minlength=len(known))
        return out

    def file(self, counts: dict[int, np.ndarray]) -> None:
        """Index each record under its n - o + 1 rarest shingles; of equally frequent ones the first."""
        for k, (keys, r, at) in self.shingles.items():
            often = counts[k][np.searchsorted(self.known[k], keys)]
            order = np.lexsort((at, often, r))
            first = np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]])
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            prefix = order[rank < (self.of_record - self.need + 1)[r[order]]]
            prefix = prefix[np.argsort(keys[prefix], kind="stable")]
            own, start = np.unique(keys[prefix], return_index=True)
            self.index[k] = own, np.r_[start, len(prefix)], r[prefix], at[prefix]

    def find(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, record) of every verified place in a run of texts."""
        ends = np.cumsum(sizes + 1)  # where the unknown word behind each text ends
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (own, offsets, record, place) in self.index.items():
            keys = self.keys(numbers, k)
            p = np.flatnonzero(keys)
            i = np.minimum(np.searchsorted(own, keys[p]), len(own) - 1)
            met = own[i] == keys[p]
            p, i = p[met], i[met]
            n = offsets[i + 1] - offsets[i]
            # Postings of a frequent shingle are met at many places: they are unfolded in runs of bounded size.
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1, len(n)] if len(n) else [0]
            for a, b in zip(cuts, cuts[1:]):
                each = n[a:b]
                j = np.repeat(offsets[i[a:b]] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
                at, r = np.repeat(p[a:b], each), record[j]
                s = at - place[j]
                doc = np.searchsorted(ends, at, "right")
                good = (s >= ends[doc] - sizes[doc] - 1) & (s + self.length[r] <= ends[doc] - 1)
                s, r = s[good], r[good]
                same = np.ones((len(s), self.size), bool)
                for x in range(self.size):
                    inside = x < self.length[r]
                    same[:, x] = inside & (numbers[np.minimum(s + x, len(numbers) - 1)] == self.words[r, x])
                whole = np.ones((len(s), self.size - k + 1), bool)
                for x in range(k):
                    whole &= same[:, x : x + self.size - k + 1]
                right = whole.sum(axis=1) >= self.need[r]
                starts.append(s[right])
                found.append(r[right])
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(found)], axis=1), axis=0)
        return both[:, 0], both[:, 1]


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    edges = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def counted(docs: DataFrame, records: Records, text: str) -> dict[int, np.ndarray]:
    """The corpus counts of a block's shingles: tasks count, Spark adds up."""
    sent = docs.sparkSession.sparkContext.broadcast(records)

    def work(batches):
        own, total = sent.value, {}
        for batch in batches:
            for _, texts in slices(batch, 0):
                for k, n in own.count(own.numbers(texts)[0]).items():
                    total[k] = total[k] + n if k in total else n
        for k, n in total.items():
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i), pa.array(n[i])], names=["k", "i", "n"])

    rows = docs.select(F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(work, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toArrow()
    out = {k: np.zeros(len(known), np.int64) for k, known in records.known.items()}
    k, i, n = (rows.column(c).to_numpy() for c in range(3))  # a row for each shingle of the block at most
    for one, counts in out.items():
        counts[i[k == one]] = n[k == one]
    return out


def searched(docs: DataFrame, records: Records, text: str) -> DataFrame:
    """docs (any columns, of which text is binary) with n_words, n_hit, spans and items of one block, text dropped."""
    sent = docs.sparkSession.sparkContext.broadcast(records)
    at = docs.columns.index(text)
    others = [c for c in range(len(docs.columns)) if c != at]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text] + [FOUND])

    def work(batches):
        own = sent.value
        for batch in batches:
            for first, texts in slices(batch, at):
                numbers, sizes = own.numbers(texts)
                start, record = own.find(numbers, sizes)
                open_ = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(open_, start, 1)
                np.add.at(open_, start + own.length[record], -1)
                hit = np.cumsum(open_[:-1]) > 0
                begin = np.cumsum(np.r_[0, sizes + 1])
                doc = np.searchsorted(begin, start, "right") - 1
                items: list[list[str]] = [[] for _ in texts]
                for d in np.unique(doc).tolist():
                    items[d] = sorted({x for r in set(record[doc == d].tolist()) for x in own.items[r]})
                a, b = runs(hit)
                of = np.searchsorted(begin, a, "right") - 1
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(a - begin[of]), pa.array(b - begin[of])], names=["first", "last"])
                )
                n_hit = np.bincount(of, b - a + 1, len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(texts)) for c in others), pa.array(sizes), pa.array(n_hit), spans, pa.array(items, pa.list_(pa.string()))],
                    names=[*(batch.schema.names[c] for c in others), "n_words", "n_hit", "spans", "items"],
                )

    return docs.mapInArrow(work, schema)


def merged(found: DataFrame) -> DataFrame:
    """Rows (row, text's digest, copies; finds of a block) -> a row for each document: spans united, items distinct."""
    every = F.array_sort(F.flatten(F.collect_list("spans")))
    gap = lambda acc, s: (F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["last"] + 1)
    longer = lambda acc, s: F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"))),
    )
    kind = "array<struct<first:bigint,last:bigint>>"
    united = F.aggregate(every, F.array().cast(kind), lambda acc, s: F.when(gap(acc, s), longer(acc, s)).otherwise(F.concat(acc, F.array(s))).cast(kind))
    one = found.groupBy("row", "digest").agg(F.any_value("n_words").alias("n_words"), united.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.any_value("copies").alias("copies"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return one.select("row", "n_words", n_hit.alias("n_hit"), "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = WINDOW, shingle: int = SHINGLE, containment: Fraction | str = Fraction(1), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns with n_words, n_hit (words inside a find), spans (runs of hit words, from 0) and items (ids, sorted) of every document.

    items: item_id and text. containment is the share of a record's shingles that must stand in place; 1 means word for word.
    """
    pairs = durable(windows(items, size=size), "benchmark-windows")
    total = pairs.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))
    clean = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").cast("binary").alias("text"))
    row = [f"k{i}" for i in range(len(keep))]
    parts = []
    for b in range(blocks):
        own = dealt.where(F.col("block") == b).select("item", "window").toArrow()  # about block_bytes
        records = Records(list(zip(own["item"].to_pylist(), own["window"].to_pylist())), shingle, Fraction(containment))
        records.file(counted(clean, records, "text") if len(records.length) else {})
        source = clean if blocks == 1 else clean.select(F.struct(*row).alias("row"), F.sha2("text", 256).alias("digest"), "text")
        parts.append(searched(source, records, "text"))
    if blocks == 1:
        found = parts[0]
    else:
        # Rows that are equal in all kept columns and the text have equal finds: each block gives one of them and their number.
        each = [p.groupBy("row", "digest").agg(F.any_value("n_words").alias("n_words"), F.any_value("spans").alias("spans"), F.any_value("items").alias("items"), F.count("*").alias("copies")) for p in parts]
        united = each[0]
        for e in each[1:]:
            united = united.union(e)
        found = merged(united).select(*(F.col("row")[c].alias(c) for c in row), "n_words", "n_hit", "spans", "items")
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_hit", "spans", "items")


#: Documents are cut at every place into as many words as any window has; lengths are few, as items of WINDOW words or more have one.
ORACLE = rf"""
WITH f AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS p FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, list_slice(w, p, least(p + {WINDOW - 1}, len(w))) AS v FROM s),
n AS (SELECT v, len(v) AS n, array_to_string(v, ' ') AS k, list(item) AS items FROM v GROUP BY v),
l AS (SELECT DISTINCT n FROM n),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM f),
c AS (SELECT r, p, l.n, array_to_string(list_slice(w, p, p + l.n - 1), ' ') AS k FROM p, l WHERE p + l.n - 1 <= len(w)),
h AS (SELECT r, p, c.n, items FROM c JOIN n ON c.k = n.k AND c.n = n.n),
t AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
g AS (SELECT r, list_sort(list_distinct(flatten(list(items)))) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM f LEFT JOIN t USING (r) LEFT JOIN g USING (r)
"""
