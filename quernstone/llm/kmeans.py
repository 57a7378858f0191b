"""Centroid clustering (Lloyd's rounds) by kd-tree filtering, in exact integers.

Each partition cuts its vectors into kd-trees of bounded size, once: a node holds its count, its integer sums and its box, and the trees
are written to the shared folder. In a round the centroids go down every tree. At a node the one nearest to the middle of the box is set against each
other one: where even the corner of the box that favours the other is strictly nearer to the first, the other is dominated by it
and goes. A node with one centroid left is assigned whole, through its count and sums; in a leaf, distances to those left decide.
Ties never prune, so equal distances go to the smaller number, and all sums are of whole numbers: no result depends on the partitions.

Only counts and sums of each centroid leave a task, and only centroids come back to it.

Defined cases: a vector that is null, has another number of components than ``width`` or a null or non-finite one takes no part;
nor does one with a component of 2^27 or more after scaling, as squared distances would leave the range of a long; a null id is hashed as '';
repeated rows are vectors of their own, the start takes equal ids in the order of their vectors; with fewer vectors than centroids there are
as many centroids as vectors; a sum of distances beyond a long is null; an empty table gives an empty table. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

#: Components, factor, centroids, rounds and the seed of the start.
WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Vectors in a tree and in a leaf; components stay below this.
TREE, LEAF, LARGEST = 2048, 32, 2**27
TREES = "ids binary, known binary, vectors binary, start binary, stop binary, low binary, high binary, sums binary"


def quantised(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", width: int = WIDTH) -> DataFrame:
    """vec_id and v (array<int>): floor(SCALE x) of each component, for the vectors that take part."""
    if 4 * LARGEST**2 * width >= 2**63:
        raise ValueError("squared distances of so many components don't fit a long")
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * SCALE) < LARGEST))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    return own.where(F.coalesce((F.size("x") == width) & fine, F.lit(False))).select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, n: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The n vectors of the smallest hashes of their ids. Hashes are even, so a bound on them leaves some dozen rows to be sorted."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    hashed, total = kept.withColumn("hash", key), kept.count()
    share, few = 8 * n / max(total, 1), hashed
    while share < 1:
        few = hashed.where(F.col("hash") < f"{int(share * 2**64):016x}")
        if few.count() >= n:
            break
        share, few = 8 * share, hashed
    best = few.orderBy("hash", "v").limit(n).select("v").collect()
    return np.array([r.v for r in best], np.int64)


def grown(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The kd-tree of the rows of x: their order, and for each node its first and last-but-one row, box and sums; children follow their parents.

    A node of more than LEAF rows is cut at the median of its widest side; the children of node i are found by their rows.
    """
    order, nodes, at = np.arange(len(x)), [(0, len(x))], 0
    while at < len(nodes):
        a, b = nodes[at]
        at += 1
        own = x[order[a:b]]
        side = int((own.max(axis=0) - own.min(axis=0)).argmax())
        if b - a > LEAF and own[:, side].min() < own[:, side].max():
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], m)]
            nodes += [(a, a + m), (a + m, b)]
    start, stop = np.array(nodes, np.int32).T
    x = x[order]
    low, high = (np.stack([f(x[a:b], axis=0) for a, b in nodes]) for f in (np.min, np.max))
    total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
    return order, start, stop, low, high, total[stop] - total[start]


def trees(kept: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each kd-tree: ids, which of them are known, vectors and nodes, as packed numbers."""

    def work(batches):
        ids, parts, held = [], [], 0

        def tree(ids, x):
            order, start, stop, low, high, sums = grown(x)
            at = pa.array(ids).take(pa.array(order))
            known = at.is_valid().to_numpy(zero_copy_only=False)
            packed = [at.fill_null(0).to_numpy().astype("<i8"), known.astype("u1"), x[order].astype("<i4"), start, stop, low.astype("<i4"), high.astype("<i4"), sums.astype("<i8")]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in packed], names=[c.split()[0] for c in TREES.split(", ")])

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
            ids += batch.column(0).to_pylist()
            parts.append(x)
            held += len(x)
            if held >= TREE:
                x, at = np.concatenate(parts), 0
                while held - at >= TREE:
                    yield tree(ids[at : at + TREE], x[at : at + TREE])
                    at += TREE
                ids, parts, held = ids[at:], [x[at:]], held - at
        if held:
            yield tree(ids, np.concatenate(parts))

    return kept.select("vec_id", "v").mapInArrow(work, TREES)


def read_trees(batch: pa.RecordBatch, width: int):
    """ids, known, vectors, start, stop, low, high, sums of each tree of a batch."""
    for i in range(batch.num_rows):
        raw = [batch.column(c)[i].as_py() for c in range(8)]
        kinds = ("<i8", "u1", "<i4", "<i4", "<i4", "<i4", "<i4", "<i8")
        ids, known, x, start, stop, low, high, sums = (np.frombuffer(r, k) for r, k in zip(raw, kinds))
        yield ids, known, *(a.reshape(-1, width).astype(np.int64) if a.dtype.itemsize == 4 else a for a in (x,)), start, stop, *(a.reshape(-1, width).astype(np.int64) for a in (low, high, sums))


def nearest(x: np.ndarray, numbers: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each row the first of the numbered centroids at the least squared distance, in exact arithmetic."""
    c = centroids[numbers]
    largest = float(max(np.abs(x).max(initial=1), np.abs(c).max(initial=1)))
    kind = np.float64 if 4 * largest * largest * x.shape[1] < 2**53 else np.int64
    if kind is np.int64:
        # Differences are below 2^28, so their squares' sum stays below 2^62; one centroid at a time bounds the memory.
        away = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    else:
        c = c.astype(kind)
        away = (c * c).sum(axis=1) - 2 * (x.astype(kind) @ c.T)  # less the square of the vector, the same for all
    return numbers[away.argmin(axis=1)]


def filtered(start, stop, low, high, x, centroids) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Nodes assigned whole (node, centroid), and the centroid of each row.

    Of equal centroids only the first takes part.
    """
    first = np.sort(np.unique(centroids, axis=0, return_index=True)[1])
    place = {(a, b): i for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist()))}
    of, whole = np.zeros(len(x), np.int64), []
    level, left = [0], [first]
    while level:
        below, below_left = [], []
        for node, numbers in zip(level, left):
            a, b, lo, hi = int(start[node]), int(stop[node]), low[node], high[node]
            if len(numbers) > 1:
                c = centroids[numbers]
                middle = ((2.0 * c - lo - hi) ** 2).sum(axis=1)
                best = c[int(middle.argmin())]
                corner = np.where(c > best, hi, lo)  # the corner of the box that lies furthest towards each other centroid
                numbers = numbers[((c - corner) ** 2).sum(axis=1) <= ((best - corner) ** 2).sum(axis=1)]
            if len(numbers) == 1:
                whole.append((node, int(numbers[0])))
                of[a:b] = numbers[0]
                continue
            m = a + (b - a) // 2
            child = place.get((a, m)) if b - a > LEAF else None
            if child is None or child <= node:
                of[a:b] = nearest(x[a:b], numbers, centroids)
            else:
                below += [child, place[(m, b)]]
                below_left += [numbers, numbers]
        level, left = below, below_left
    return whole, of


def sums_of(forest: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sums of the vectors that are nearest to each centroid."""
    width, n = centroids.shape[1], len(centroids)

    def work(batches):
        count, total = np.zeros(n, np.int64), np.zeros((n, width), np.int64)
        for batch in batches:
            for _, _, x, start, stop, low, high, sums in read_trees(batch, width):
                whole, of = filtered(start, stop, low, high, x, centroids)
                rest = np.ones(len(x), bool)
                for node, k in whole:
                    count[k] += stop[node] - start[node]
                    total[k] += sums[node]
                    rest[start[node] : stop[node]] = False
                count += np.bincount(of[rest], minlength=n)
                for k in np.unique(of[rest]).tolist():
                    total[k] += x[rest & (of == k)].sum(axis=0)
        k = np.flatnonzero(count)
        table = np.concatenate([count[k, None], total[k]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, width + 1)), pa.array(np.tile(np.arange(width + 1), len(k))), pa.array(table.reshape(-1))], names=["k", "i", "s"])

    rows = forest.mapInArrow(work, "k long, i long, s long").groupBy("k", "i").agg(F.sum("s").alias("s")).collect()  # a number for each centroid and component
    out = np.zeros((n, width + 1), np.int64)
    for k, i, s in rows:
        out[k, i] = s
    return out[:, 0], out[:, 1:]


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    width = centroids.shape[1]

    def work(batches):
        for batch in batches:
            for ids, known, x, start, stop, low, high, _ in read_trees(batch, width):
                of = filtered(start, stop, low, high, x, centroids)[1]
                away = ((x - centroids[of]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(of.astype(np.int32)), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return forest.mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", n: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster and distance of every vector that takes part; the final centroids)."""
    kept = durable(quantised(vectors, vector, vec_id, width), "kmeans-vectors")
    centroids = first_centroids(kept, n, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    forest = durable(trees(kept, width), "kmeans-trees")
    discard(kept)
    for _ in range(rounds):
        count, total = sums_of(forest, centroids)
        centroids = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)  # floor of the exact quotient
    out = durable(assigned(forest, centroids), "kmeans-assigned")
    discard(forest)
    return out, centroids


def summarised(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256."""
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    fits = lambda x: x if x < 2**63 else None
    rows = [(k, fits(sums.get(k, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    each = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(n: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds in SQL over long rows (vector, component): nearest centroid by sums of squared differences."""
    step = """, s{i} AS (SELECT r, k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{i} c USING (j) GROUP BY r, k),
a{i} AS (SELECT r, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM s{i} GROUP BY r)"""
    move = """,
m{i} AS (SELECT k, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM v JOIN a{i} USING (r) GROUP BY k, j),
c{next} AS (SELECT c.k, c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k, j))"""
    body = "".join(step.format(i=i) + (move.format(i=i, next=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {WIDTH}),
b AS (SELECT r FROM (SELECT r, unnest(e) AS x FROM e) WHERE x IS NULL OR NOT isfinite(x)),
f AS (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(x * {SCALE}) AS BIGINT)) AS q FROM e WHERE r NOT IN (SELECT r FROM b)),
v AS (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM f),
o AS (SELECT r, row_number() OVER (ORDER BY sha256(concat('{SEED}:', coalesce(CAST(vec_id AS VARCHAR), ''))), q) - 1 AS k FROM f QUALIFY k < {n}),
c0 AS (SELECT CAST(k AS INTEGER) AS k, j, x FROM o JOIN v USING (r)){body},
g AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY k),
z AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia, centroid_sha256
FROM f JOIN a{rounds} USING (r) JOIN g USING (k) JOIN z USING (k)"""
