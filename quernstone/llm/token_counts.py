"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of the corpus' frequent pre-token units, tier two each worker's
bounded cache, filled by the tokenizer itself. No pre-token is shuffled: the table comes from bounded
per-task summaries of one pass over all documents, and what it holds changes the speed, never a count.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text are one token;
repeated rows and ids each keep their row; an empty table gives an empty table and an empty tier one.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byteunits import ByteUnits, worker_cache, worker_units
from .common import quiet_worker, slices

#: Units in the broadcast table and their longest spelling in characters, units in a task's summary and in a worker's cache.
TABLE, SPELLING, SUMMARY, KEPT = 32_768, 64, 4_096, 200_000


def frequent_units(docs: DataFrame, tokenizer_path: str, text: str = "text", table: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """The (nearly) most frequent units led by a space, most frequent first: at most ``table``.

    A task counts with at most 16 x summary counters, dropping the lower half when they run out, and
    reports its ``summary`` highest ones, so what is added up is bounded by tasks, not by words.
    """

    def count(batches):
        quiet_worker()
        units, seen = worker_units(tokenizer_path), Counter()
        for batch in batches:
            for _, texts in slices(batch, 0):
                for t in texts:
                    seen.update(u for u in units.of(t) if type(u) is str and len(u) <= SPELLING)
                    if len(seen) > 16 * summary:
                        seen = Counter(dict(seen.most_common(8 * summary)))
        top = seen.most_common(summary)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, "unit string, n long")
    best = parts.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table)
    return [r.unit for r in best.collect()]


def packed(units: list[str], lengths: list[int]) -> bytes:
    """The compact table: the units joined by a space, which none contains, then a byte for each length."""
    return zlib.compress(" ".join(units).encode() + b"\xff" + bytes(min(n, 255) for n in lengths))


def unpacked(table: bytes) -> dict[str, int]:
    """Lengths from 255 on stay with tier two."""
    names, _, lengths = zlib.decompress(table).partition(b"\xff")
    return {u: n for u, n in zip(names.decode().split(" "), lengths) if n < 255} if lengths else {}


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), table: int = TABLE) -> DataFrame:
    """The columns ``keep`` of docs and n_tokens (long), row for row."""
    units = frequent_units(docs, tokenizer_path, text, table)
    spark = docs.sparkSession
    lengths = [len(ids) for ids in ByteUnits(tokenizer_path).ids(units)]
    tier_one = spark.sparkContext.broadcast(packed(units, lengths))
    own = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    n_keep = len(keep)

    def work(batches):
        quiet_worker()
        units, first = worker_units(tokenizer_path), unpacked(tier_one.value)
        second = worker_cache(tokenizer_path, KEPT)
        for batch in batches:
            for at, texts in slices(batch, n_keep):
                totals, misses = [], []
                for t in texts:
                    cut = units.of(t)
                    found = list(map(first.get, cut))
                    misses.append([u for u, n in zip(cut, found) if n is None])
                    totals.append(sum(filter(None, found)))
                known = second.known(misses)
                counts = [n + sum(map(known.__getitem__, m)) for n, m in zip(totals, misses)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:n_keep], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return own.mapInArrow(work, schema)
