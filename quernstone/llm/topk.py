"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors and queries are grouped by their nearest pivot; the pivots grow with the root of the table. Each group's
summary (radius, largest norm, the range of distances to some ring pivots) bounds what its vectors can score, and
a query's k-th best score in a bounded sample is one that its results reach: groups that cannot reach it
are left out, exactly. A query is sent only to the groups that it needs (the queries are the smaller side, so they are
what is replicated), groups are split into blocks of bounded size, blocks are solved exactly, and the blocks' best are merged.

On clustered vectors most groups are left out. Vectors without clusters in many dimensions are all about as far from
each other, so that no bound by distances can leave out a group, and the join compares each query with every vector.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, as query or
candidate, nor does one without an id; shorter vectors count as filled up with zeros; a row never finds itself, but another row of its id is found;
ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

#: Pivots, at least and at most (the vectors of the smallest id hashes; four times as many are the sample), and those of them that rings are kept for.
PIVOTS, RINGS = (32, 1024), 16
#: Rows of a block of vectors, which a task holds, and of queries, which it reads by.
BLOCK, QUERY_BLOCK = 16_384, 65_536
SCALE = 64


def quantised(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id and v (array<bigint>): floor(64 x) of each component, for vectors whose components are all finite."""
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    return own.select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


def matrix(column: pa.Array, width: int, kind: np.dtype) -> np.ndarray:
    """A list column as rows of ``width`` numbers, shorter lists filled up with zeros."""
    lists = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)])] = flat
    return out


def exact_kind(largest: float, width: int) -> np.dtype:
    """The fastest number type in which every inner product, and every sum on the way, is exact."""
    bound = largest * largest * max(width, 1)
    return np.dtype(np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest scores; of equal ones those of the smaller column. At most k in a row."""
    n = scores.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(scores)), n), np.tile(np.arange(n), len(scores))
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above, level = scores > edge, scores == edge
    rest = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level & (np.cumsum(level, axis=1) <= rest))


def solve(batches, k: int, width: int, kind: np.dtype):
    """Rows of (block, is_query, row, id, v), vectors of a block first and by id: each block's k best of each query.

    A block's vectors are held, their number is bounded; its queries are read by.
    """
    current, parts, held = None, [], None

    def matched(q_rows, q_ids, q):
        rows, ids, x = held
        for at in range(0, len(q), 256):
            scores = q[at : at + 256] @ x.T
            own = q_rows[at : at + 256, None] == rows[None, :]
            least = np.finfo(kind).min if kind.kind == "f" else np.iinfo(kind).min
            scores[own] = least
            i, j = best(scores, k)
            good = ~own[i, j]
            i, j = i[good], j[good]
            yield pa.RecordBatch.from_arrays([pa.array(q_rows[at + i]), pa.array(q_ids[at + i]), pa.array(rows[j]), pa.array(ids[j]), pa.array(scores[i, j].astype(np.int64))], names=["q_row", "query_id", "row", "vec_id", "score"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
        for a, b in zip(cuts, [*cuts[1:], len(blocks)]):
            part = batch.slice(a, b - a)
            if blocks[a] != current:
                current, parts, held = blocks[a], [], None
            is_query = part.column(1).to_numpy(zero_copy_only=False)
            rows, ids, x = part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False), matrix(part.column(4), width, kind)
            if not is_query.all():
                parts.append((rows[~is_query], ids[~is_query], x[~is_query]))
            if is_query.any() and (parts or held):
                if held is None:
                    held, parts = tuple(map(np.concatenate, zip(*parts))), []
                yield from matched(rows[is_query], ids[is_query], x[is_query])


def summaries(grouped: DataFrame, pivots: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """For each group that has vectors: cell, n, radius, the largest norm, and the least and largest distance to each of the first RINGS pivots."""
    rings = pivots[:RINGS]

    def partial(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            x, cells, d = matrix(batch.column(0), width, np.dtype(float)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            norm, away = np.sqrt((x * x).sum(axis=1)), distances(x, rings)
            for c in np.unique(cells).tolist():
                i = cells == c
                new = [int(i.sum()), d[i].max(), norm[i].max(), away[i].min(axis=0), away[i].max(axis=0)]
                old = seen.setdefault(c, new)
                if old is not new:
                    seen[c] = [old[0] + new[0], *map(max, old[1:3], new[1:3]), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
        for c, (n, radius, norm, low, high) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(low) + 1, c)), pa.array(np.arange(-1, len(low))), pa.array(np.r_[n, low]), pa.array(np.r_[radius, high]), pa.array(np.full(len(low) + 1, norm))],
                names=["cell", "ring", "low", "high", "norm"],
            )

    rows = grouped.select("v", "cell", "d").mapInArrow(partial, "cell long, ring long, low double, high double, norm double")
    merged = rows.groupBy("cell", "ring").agg(F.sum("low").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"))
    found = merged.orderBy("cell", "ring").collect()  # at most pivots x (RINGS + 1) rows
    whole = [r for r in found if r.ring < 0]
    shape = (len(whole), len(rings))
    return {
        "cell": np.array([r.cell for r in whole], int), "n": np.array([r.n for r in whole], int), "radius": np.array([r.high for r in whole], float), "norm": np.array([r.norm for r in whole], float),
        "low": np.array([r.low for r in found if r.ring >= 0], float).reshape(shape), "high": np.array([r.high for r in found if r.ring >= 0], float).reshape(shape),
    }


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ points.T + (points * points).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def needed(q: np.ndarray, q_rows: np.ndarray, k: int, pivots: np.ndarray, sample: np.ndarray, sample_rows: np.ndarray, of: dict[str, np.ndarray]) -> np.ndarray:
    """Which groups (columns) can hold a result of which queries (rows).

    A query's k-th best score among the sample is one that its results reach. What a group can reach is bounded by
    q.x <= q.p + |q| d, and by q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 with |q - x| >= | |q - r| - |x - r| | for its own
    pivot and every ring pivot r.
    """
    scores = q @ sample.T
    scores[q_rows[:, None] == sample_rows[None, :]] = -np.inf
    reached = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(q), -np.inf)
    norm, away = np.sqrt((q * q).sum(axis=1))[:, None], distances(q, pivots)
    own = pivots[of["cell"]]
    apart = np.maximum(away[:, of["cell"]] - of["radius"], 0)
    for j in range(of["low"].shape[1]):
        apart = np.maximum(apart, np.maximum(away[:, j : j + 1] - of["high"][:, j], of["low"][:, j] - away[:, j : j + 1]))
    high = np.minimum(q @ own.T + norm * of["radius"], (norm**2 + of["norm"] ** 2 - apart**2) / 2)
    reached = reached[:, None]
    return high >= reached - 1e-6 * (1 + norm**2 + np.where(np.isfinite(reached), np.abs(reached), 0))


def top_k(vectors: DataFrame, is_query, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id", pivots: int | None = None, facts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which ``is_query`` (a condition on vec_id) holds its k best other rows.

    facts, where given, receives n_groups and the queries' visits of groups (both after exclusion).
    """
    spark = vectors.sparkSession
    found = durable(quantised(vectors, vector, vec_id).withColumn("row", F.monotonically_increasing_id()), "vectors")
    of = found.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    width, kind = of.width or 1, exact_kind(float(of.largest or 0), of.width or 1)
    pivots = pivots or int(min(max(of.n**0.5 / 4, PIVOTS[0]), PIVOTS[1]))
    chosen = found.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(4 * pivots).select("row", "v").collect()
    filled = [(*r.v, *[0] * (width - len(r.v))) for r in chosen]
    sample, sample_rows = np.array(filled, float).reshape(-1, width), np.array([r.row for r in chosen], np.int64)
    p = np.array(list(dict.fromkeys(filled))[:pivots], float).reshape(-1, width)

    def group(batches):
        for batch in batches:
            x = matrix(batch.column(0), width, np.dtype(float))
            g = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
            d = np.sqrt(((x - p[g]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32)), pa.array(d)], names=[*batch.schema.names, "cell", "d"])

    grouped = durable(found.select("v", "vec_id", "row").mapInArrow(group, "v array<bigint>, vec_id long, row long, cell int, d double"), "grouped")
    summary = summaries(grouped, p, width)
    members = summary["cell"].astype(np.int32)

    def route(batches):
        """Each query with each group that it needs."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                i, j = np.nonzero(needed(matrix(part.column(0), width, np.dtype(float)), part.column(2).to_numpy(), k, p, sample, sample_rows, summary))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in part.columns), pa.array(members[j])], names=[*part.schema.names, "cell"])

    queries = grouped.where(is_query(F.col("vec_id"))).select("v", "vec_id", "row")
    routed = durable(queries.mapInArrow(route, "v array<bigint>, vec_id long, row long, cell int"), "routed")
    asked = {r.cell: r.n for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if facts is not None:
        facts.update(n_groups=len(members), visits=sum(asked.values()))
    # A group's vectors are dealt to blocks by a hash of their row; a vector is sent once for each QUERY_BLOCK of its group's queries.
    in_cell = dict(zip(summary["cell"].tolist(), summary["n"].tolist()))
    sizes = [(c, -(-in_cell[c] // BLOCK), -(-asked[c] // QUERY_BLOCK)) for c in sorted(asked)]
    splits = F.broadcast(spark.createDataFrame(sizes, "cell int, n_x int, n_q int"))  # a row for each pivot
    hashed = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = grouped.join(splits, "cell").select("cell", hashed("n_x").alias("bx"), every("n_q").alias("bq"), F.lit(False).alias("is_query"), "row", "vec_id", "v")
    sent = routed.join(splits, "cell").select("cell", every("n_x").alias("bx"), hashed("n_q").alias("bq"), F.lit(True).alias("is_query"), "row", "vec_id", "v")
    both = data.unionByName(sent).select(F.xxhash64("cell", "bx", "bq").alias("block"), "is_query", "row", "vec_id", "v")
    blocks = both.repartition("block").sortWithinPartitions("block", "is_query", "vec_id", "row")
    partial = blocks.mapInArrow(lambda b: solve(b, k, width, kind), "q_row long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_TOP_K = """
WITH e AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
