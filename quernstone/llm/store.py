"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document into chunks at places that depend on the ids near them
only, so equal passages give equal chunks wherever they stand. A chunk is stored once, under the digest of
its bytes; a document is a recipe of digests, in ascending doc_id order; every recipe has a Merkle root over
its chunks and the manifest one over all recipes. Reading checks each chunk against its digest and each
recipe against its root.

Layout below the store's path: ``chunks`` (digest, n, payload: little-endian ids of ``width`` bytes),
``recipes`` (row, doc_id, n_tokens, digests, root; rows ascend with doc_id, null first), ``manifest``.

Defined cases: a null or empty text is its end id alone; repeated doc_ids keep a recipe each, in the order
of their roots; an empty table gives an empty store; a text of any length is one recipe, and each chunk
is at most ``LONGEST`` ids.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byteunits import worker_cache, worker_units
from .common import durable, quiet_worker, shared_dir, slices

#: Ids in the rolling window (a power of two); a cut where the hash's top bits are all zero (one in 2**CUT_BITS); bounds of a chunk.
WINDOW, CUT_BITS, SHORTEST, LONGEST = 16, 8, 64, 4096
KEPT = 150_000
DIGEST = 16
#: Recipes under one node of the manifest's tree, as a power of two.
FAN_BITS = 12


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a 64-bit hash of the last WINDOW ids, by doubling the window."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)  # odd constants that spread small numbers over 64 bits
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        width = 1
        while width < WINDOW:
            if len(h) > width:
                h[width:] = h[width:] + h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64))
            width *= 2
        return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of one document's ids."""
    return chunk_ends(ids, np.array([len(ids)]))[0]


def chunk_ends(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """For each of some documents whose ids stand in a row, the ends of its chunks; sizes: the documents' numbers of ids.

    A chunk has SHORTEST ids at least, more than the rolling window, so no cut depends on the document before.
    """
    borders = np.r_[0, np.cumsum(sizes)]
    marks = np.flatnonzero(rolling(ids) >> np.uint64(64 - CUT_BITS) == 0) + 1
    split = np.searchsorted(marks, borders, "right").tolist()
    marks, out = marks.tolist(), []
    for d, (start, stop) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
        ends, at = [], start
        for p in marks[split[d] : split[d + 1]]:
            while p - at > LONGEST:
                at += LONGEST
                ends.append(at)
            if p - at >= SHORTEST:
                ends.append(at := p)
        while stop - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if at < stop or not ends:
            ends.append(stop)
        out.append([e - start for e in ends])
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; an odd last one rises as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> str:
    """Encode every whole text, append end_id, and write the store; returns its Merkle root in hex."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, chunks array<struct<digest: binary, n: int, payload: binary>>, root binary"
    kind = id_type(tokenizer_path)

    def work(batches):
        quiet_worker()
        encode, end, width, seen = worker_documents(tokenizer_path, kind), np.array([end_id], kind), kind.itemsize, set()
        for batch in batches:
            for at, texts in slices(batch, 1):
                each = [np.concatenate((x, end)) for x in encode(texts)]
                sizes, data = np.array([len(x) for x in each]), np.concatenate(each)
                keys, lengths, payloads, counts, roots, start = [], [], [], [], [], 0
                raw = data.tobytes()
                if len(seen) > 500_000:
                    seen.clear()
                for ends, size in zip(chunk_ends(data, sizes), sizes.tolist()):
                    stops = [(start + e) * width for e in ends]
                    parts = [raw[a:b] for a, b in zip([start * width, *stops], stops)]
                    names = [digest(p) for p in parts]
                    keys += names
                    payloads += [None if k in seen or seen.add(k) else p for k, p in zip(names, parts)]
                    lengths += [len(p) // width for p in parts]
                    counts.append(len(ends))
                    roots.append(merkle(names))
                    start += size
                chunks = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(lengths, pa.int32()), pa.array(payloads, pa.binary())], names=["digest", "n", "payload"])
                chunks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), chunks)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), chunks, pa.array(roots, pa.binary())], names=["doc_id", "n_tokens", "chunks", "root"])

    # Rows of one id and equal ids are told apart by ``nth``, so no run of them has to be one task's.
    staged = durable(own.mapInArrow(work, schema).withColumn("nth", F.monotonically_increasing_id()), "staged", f"{path}/staged")
    # A task leaves out a chunk that it has put down before, so each digest has one payload at least.
    once = staged.select(F.explode("chunks").alias("c")).select("c.*").where("payload is not null")
    once.groupBy("digest").agg(F.first("n").alias("n"), F.first("payload").alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.select("doc_id", "n_tokens", F.col("chunks.digest").alias("digests"), "root", "nth")
    recipes = recipes.repartitionByRange("doc_id", "root", "nth").sortWithinPartitions("doc_id", "root", "nth").drop("nth")
    recipes = recipes.select(F.monotonically_increasing_id().alias("row"), "*")
    recipes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/recipes")
    drop(staged.sparkSession, f"{path}/staged")
    root = merkle(recipe_leaves(staged.sparkSession, path))
    note = json.dumps({"root": root.hex(), "id_bytes": np.dtype(kind).itemsize, "end_id": end_id})
    staged.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return root.hex()


def worker_documents(tokenizer_path: str, kind: np.dtype):
    """A function from texts to their ids as numbers: plain texts whole, others by their units."""
    units, cache = worker_units(tokenizer_path), worker_cache(tokenizer_path, KEPT, kind.str)

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = [units.whole(t) for t in texts]
        cut = {i: units.of(t) for i, t in enumerate(texts) if out[i] is None}
        known = cache.known(cut.values())
        for i, c in cut.items():
            out[i] = np.frombuffer(b"".join(map(known.__getitem__, c)), kind)
        return [x.astype(kind, copy=False) for x in out]

    return encode


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder by the file system that it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def id_type(tokenizer_path: str):
    from tokenizers import Tokenizer

    return np.dtype("<u2") if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else np.dtype("<u4")


def recipe_leaves(spark: SparkSession, path: str) -> list[bytes]:
    """Digests over runs of recipes, in order: a tree of fan-out FAN over their roots, two levels before the driver takes it over."""
    level = spark.read.parquet(f"{path}/recipes").select("row", F.substring("root", 1, DIGEST).alias("root"))
    for _ in range(2):  # row numbers have the range in their upper bits: a run never has more than FAN members
        run = level.groupBy(F.shiftright("row", FAN_BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("row", "root"))).alias("roots"))
        joined = F.sha2(F.array_join(F.transform("roots", lambda r: F.hex(r.root)), ","), 256)
        level = run.select(F.col("run").alias("row"), F.substring(F.unhex(joined), 1, DIGEST).alias("root"))
    return [bytes(r.root) for r in level.orderBy("row").collect()]


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``: the ids of all documents before, from one sum for each range of rows and a running sum within."""
    rows = spark.read.parquet(f"{path}/recipes").withColumn("part", F.shiftright("row", 33))
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).collect()  # a row for each file range
    before, at = [], 0
    for r in sorted(sums):
        before.append((r.part, at))
        at += r.total
    offsets = spark.createDataFrame(before, "part long, before long")
    from pyspark.sql import Window as W

    running = F.sum("n_tokens").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    return rows.join(F.broadcast(offsets), "part").select("row", "doc_id", (F.col("before") + running - F.col("n_tokens")).alias("start"), "n_tokens", "digests", "root")


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The documents in the store, checked: row, doc_id, start, n_tokens, ids_crc32, and ids (array<int>) if asked for.

    A chunk whose bytes don't give its digest, a recipe whose digests don't give its root, or recipes that
    don't give the manifest's root fail the job.
    Without ids only a checksum of each chunk travels; those of a document's chunks combine to the document's.
    """
    note = manifest(spark, path)
    if merkle(recipe_leaves(spark, path)).hex() != note["root"]:
        raise ValueError("the recipes aren't those of the manifest")
    width = note["id_bytes"]
    facts_schema = "digest binary, n int, crc long" + (", payload binary" if ids else "")

    def check(batches):
        for batch in batches:
            names, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crcs, sizes = [], []
            for name, p in zip(names, payloads):
                if digest(p) != name:
                    raise ValueError(f"chunk {name.hex()} has other bytes than it was stored with")
                found = np.frombuffer(p, f"<u{width}")
                crcs.append(zlib.crc32(found.astype("<u4").tobytes()))
                sizes.append(len(found))
            made = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64()), *([batch.column(1)] if ids else [])]
            yield pa.RecordBatch.from_arrays(made, names=["digest", "n", "crc", *(["payload"] if ids else [])])

    facts = spark.read.parquet(f"{path}/chunks").select("digest", "payload").mapInArrow(check, facts_schema)
    recipes = _recipes(spark, path)
    parts = recipes.select("row", F.posexplode("digests").alias("seq", "digest")).join(facts, "digest")
    parts = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "n", "crc", *(["payload"] if ids else [])))).alias("parts"))
    whole = recipes.drop("digests").join(parts, "row")
    out = "row long, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def rebuild(batches):
        combine = CrcCombine()
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("n_tokens", "root", "parts")}
            crcs, texts = [], []
            for n, root, parts in zip(*cols.values()):
                if merkle([p["digest"] for p in parts]) != root or sum(p["n"] for p in parts) != n:
                    raise ValueError("a recipe doesn't give the document that was stored")
                crc = 0
                for p in parts:
                    crc = combine(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
                if ids:
                    texts.append(np.frombuffer(b"".join(p["payload"] for p in parts), f"<u{width}").astype(np.int32))
            made = [batch.column(c) for c in ("row", "doc_id", "start", "n_tokens")] + [pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(made + ([pa.array(texts, pa.list_(pa.int32()))] if ids else []), names=[x.split()[0] for x in out.split(", ")])

    return whole.mapInArrow(rebuild, out)


class CrcCombine:
    """The CRC-32 of two byte strings in a row from theirs and the second's length: zero bytes are a linear map over bits."""

    POLYNOMIAL = 0xEDB88320

    def __init__(self):
        one_bit = [self.POLYNOMIAL] + [1 << i for i in range(31)]
        squares = [one_bit]
        for _ in range(3 + 48):
            squares.append([self._times(squares[-1], v) for v in squares[-1]])
        self.bytes_pow, self.known = squares[3:], {}

    @staticmethod
    def _times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    def _zeros(self, n: int) -> list[int]:
        if (m := self.known.get(n)) is None:
            m = [1 << i for i in range(32)]
            for k in range(n.bit_length()):
                if n >> k & 1:
                    m = [self._times(self.bytes_pow[k], v) for v in m]
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[n] = m
        return m

    def __call__(self, a: int, b: int, b_bytes: int) -> int:
        return self._times(self._zeros(b_bytes), a) ^ b if a else b


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quernstone/store-{uuid.uuid4().hex}"


__all__ = ["CrcCombine", "cuts", "manifest", "merkle", "new_path", "read_store", "rolling", "write_store"]
