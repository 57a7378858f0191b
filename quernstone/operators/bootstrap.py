"""Component-clustered bootstrap of weighted concordance over cells and scorers, paired differences, and the rules that read them.

A replicate of a cell draws as many components as the cell has, with replacement. A pair stands in it as often as the product of
its two components' draws says, or as often as its component was drawn where both ends share it. All scorers of a cell meet the
same draws, so differences between two scorers are paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import discard, durable

#: Replicates in one array of the results, bytes of a task's table of draws, and numbers in one working array.
BLOCK, TABLE_BYTES, WORK = 250, 64 << 20, 1 << 20
Draws = Callable[[str, int, int, int], np.ndarray]


def cell_seed(base: str, cell: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{base}:bootstrap:{cell}".encode()).digest()[:8], "big")


def generator_draws(base: str) -> Draws:
    """Draws by one PCG64DXSM stream for each cell, replicate after replicate."""

    def draws(cell: str, n: int, first: int, last: int) -> np.ndarray:
        stream = np.random.Generator(np.random.PCG64DXSM(cell_seed(base, cell)))
        counts = np.zeros((last - first, n), np.int32)
        for r in range(last):
            drawn = stream.integers(0, n, size=n, dtype=np.int64)
            if r >= first:
                counts[r - first] = np.bincount(drawn, minlength=n)
        return counts

    return draws


def hashed_draws(base: str) -> Draws:
    """Draws that SQL can repeat: slot j of replicate r takes the first 60 bits of a digest, modulo the number of components."""

    def draws(cell: str, n: int, first: int, last: int) -> np.ndarray:
        counts = np.zeros((last - first, n), np.int32)
        for r in range(first, last):
            for j in range(n):
                counts[r - first, int(hashlib.sha256(f"{base}|{cell}|{r}|{j}".encode()).hexdigest()[:15], 16) % n] += 1
        return counts

    return draws


def numbered_components(rows: DataFrame) -> DataFrame:
    """(cell, component, i): the components of each cell's pairs by name, from 0; numbers come from range partitions, not from one sort in one task."""
    names = rows.select("cell", F.explode(F.array("ca", "cb")).alias("component")).distinct()
    sorted_ = names.repartitionByRange("cell", "component").sortWithinPartitions("cell", "component")
    laid = durable(sorted_.select("cell", "component", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "components")
    runs = laid.groupBy("cell", "part").agg(F.min("row").alias("first"), F.count("*").alias("k"))
    before = F.sum("k").over(W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    return laid.join(runs, ["cell", "part"]).select("cell", "component", (F.col("before") + F.col("row") - F.col("first")).alias("i"))


class Slice:
    """Sums over a run of sorted scores, for all replicates at once. The lowest and the highest score stay apart: they may go on in other slices."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        zero = np.zeros(len(counts))
        self.inner, self.head, self.score = [zero.copy(), zero.copy(), zero.copy()], None, None
        self.p = self.u = zero
        self.has_inner = False

    def add(self, score, ia, ib, p, u) -> None:
        a = self.counts[:, ia]
        times = np.where(ia == ib, a, a * self.counts[:, ib])
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        ps, us, scores = np.add.reduceat(times * p, starts, axis=1), np.add.reduceat(times * u, starts, axis=1), score[starts]
        if self.score is not None:
            if scores[0] == self.score:
                ps[:, 0] += self.p
                us[:, 0] += self.u
            else:
                ps, us, scores = np.c_[self.p, ps], np.c_[self.u, us], np.r_[self.score, scores]
        if self.head is None and len(scores) > 1:
            self.head = (scores[0], ps[:, 0], us[:, 0])
            ps, us, scores = ps[:, 1:], us[:, 1:], scores[1:]
        self.score, self.p, self.u = scores[-1], ps[:, -1].copy(), us[:, -1].copy()
        ps, us = ps[:, :-1], us[:, :-1]
        if ps.shape[1]:
            total_p, total_u, good = self.inner
            below = total_u[:, None] + np.cumsum(us, axis=1) - us
            good += (ps * (below + us / 2)).sum(axis=1)
            total_p += ps.sum(axis=1)
            total_u += us.sum(axis=1)
            self.has_inner = True

    def pieces(self) -> Iterator[tuple]:
        """(score, inner, p, u, good) in ascending order; a piece of one score has no good of its own yet."""
        zero = np.zeros(len(self.counts))
        if self.head is not None:
            yield (self.head[0], 0, self.head[1], self.head[2], zero)
            if self.has_inner:
                yield (self.head[0], 1, *self.inner)
        yield (self.score, 0, self.p, self.u, zero)


def slice_pieces(draws: Draws, sizes: dict[str, int], first: int, last: int):
    """The task of a pass: replicates from first to last over its sorted rows, a batch at a time."""

    def run(batches):
        import pyarrow as pa

        key, now, counts, of = None, None, None, None

        def out():
            blocks = range(0, last - first, BLOCK)
            rows = [(key[0], key[1], (first + b) // BLOCK, float(s), k, *[list(map(float, x[b : b + BLOCK])) for x in (p, u, g)]) for s, k, p, u, g in now.pieces() for b in blocks]
            types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32()] + [pa.list_(pa.float64())] * 3
            names = ["cell", "scorer", "block", "score", "inner", "p", "u", "good"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        step = max(1, WORK // (last - first))
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, scorers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            score, ia, ib, p, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
            ends = [i for i in range(1, len(cells)) if (cells[i], scorers[i]) != (cells[i - 1], scorers[i - 1])] + [len(cells)]
            at = 0
            for end in ends:
                if (cells[at], scorers[at]) != key:
                    if now is not None:
                        yield out()
                    key = (cells[at], scorers[at])
                    if of != key[0]:
                        of, counts = key[0], draws(key[0], sizes[key[0]], first, last)
                    now = Slice(counts)
                for i in range(at, end, step):
                    j = min(i + step, end)
                    now.add(score[i:j], ia[i:j], ib[i:j], p[i:j], u[i:j])
                at = end
        if now is not None:
            yield out()

    return run


def put_together(key, pieces):
    """One array of concordances from the pieces of a scorer in a cell: what lies below a piece is the sum of all before it."""
    import pandas as pd

    pieces = pieces.sort_values(["score", "inner"], kind="stable")
    width = len(pieces["p"].iloc[0])
    total_p, below, good = np.zeros(width), np.zeros(width), np.zeros(width)
    for (_, inner), same in pieces.groupby(["score", "inner"], sort=True):
        p, u, g = (np.sum(np.stack(same[c].to_list()), axis=0) for c in ("p", "u", "good"))
        good += g + p * below if inner else p * (below + u / 2)
        total_p += p
        below += u
    full = (total_p > 0) & (below > 0)
    values = [float(g / (p * u)) if ok else None for g, p, u, ok in zip(good, total_p, below, full)]
    return pd.DataFrame({"cell": [key[0]], "scorer": [key[1]], "block": [key[2]], "concordances": [values]})


def clustered_bootstrap(rows: DataFrame, draws: Draws, replicates: int = 2000) -> DataFrame:
    """(cell, scorer, block, concordances): arrays of 250 replicates in order, null where no positive or no other was drawn.

    ``rows`` are (cell, scorer, score, ca, cb, positive, weight), long in the scorers. Equal (cell, scorer, score, pair of
    components) are added up first; then sorted ranges of scores are dealt to tasks, a hot score too, each task folds its range for
    all replicates, and a few arrays a range are put together. No row is repeated for a replicate. A task holds a table of draws of
    at most 64 MB; where a cell has too many components for that, replicates go in several passes over the same sorted ranges.
    Components of a cell are those of all its rows with two components. Rows whose score is null or not finite, whose component,
    cell, scorer or label is null, or that are not positive and have no weight take no part in the sums. An empty table gives an empty result.
    """
    named = rows.where("cell is not null and ca is not null and cb is not null").select("cell", "scorer", F.col("score").cast("double").alias("score"), "ca", "cb", "positive", F.col("weight").cast("double").alias("weight"))
    numbers = durable(numbered_components(named), "numbered")
    sizes = {r.cell: r.n for r in numbers.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    usable = named.where("scorer is not null and positive is not null and (positive or weight is not null) and score is not null and abs(score) < double('Infinity')")
    ends = usable.join(numbers.toDF("cell", "ca", "ia"), ["cell", "ca"]).join(numbers.toDF("cell", "cb", "ib"), ["cell", "cb"])
    p, u = F.when(F.col("positive"), 1.0).otherwise(0.0), F.when(F.col("positive"), 0.0).otherwise(F.col("weight"))
    added = durable(ends.groupBy("cell", "scorer", "score", "ia", "ib").agg(F.sum(p).alias("p"), F.sum(u).alias("u")), "scores")
    keys = ["cell", "scorer", "score", "ia", "ib"]
    laid = added.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "p", "u")
    fit = max(1, TABLE_BYTES // (8 * max(sizes.values(), default=1)))
    if fit >= replicates:
        step = replicates
    else:  # whole blocks, or a divisor of a block
        step = fit // BLOCK * BLOCK or max(k for k in range(1, fit + 1) if BLOCK % k == 0)
    pieces = None
    for first in range(0, replicates, step):
        one = laid.mapInArrow(slice_pieces(draws, sizes, first, min(first + step, replicates)), "cell string, scorer string, block int, score double, inner int, p array<double>, u array<double>, good array<double>")
        one = one.withColumn("first", F.lit(first))
        pieces = one if pieces is None else pieces.union(one)
    schema = "cell string, scorer string, block int, concordances array<double>"
    if step >= BLOCK or step >= replicates:
        out = durable(pieces.drop("first").groupBy("cell", "scorer", "block").applyInPandas(put_together, schema), "distributions")
    else:  # parts of a block from several passes
        parts = pieces.withColumn("block", F.col("first")).drop("first").groupBy("cell", "scorer", "block").applyInPandas(put_together, schema)
        whole = parts.groupBy("cell", "scorer", F.floor(F.col("block") / BLOCK).cast("int").alias("block"))
        out = durable(whole.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "concordances"))), lambda x: x["concordances"])).alias("concordances")), "distributions")
    discard(added)
    discard(numbers)
    return out


def intervals(distributions: DataFrame) -> DataFrame:
    """Percentiles 2.5 and 97.5 by linear interpolation over the defined replicates of each cell and scorer, and their number."""
    x = distributions.select("cell", "scorer", F.explode("concordances").alias("x"))
    return x.groupBy("cell", "scorer").agg(F.count("x").alias("defined"), F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))


def paired_deltas(distributions: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (cell, candidate, comparator, basis) with the difference of the points and the interval of the replicates' differences.

    ``points`` are (cell, scorer, concordance). A replicate counts where both are defined.
    """
    of = lambda t, scorer, value: t.select("cell", F.col("scorer").alias(scorer), *[c for c in ("block",) if c in t.columns], F.col(t.columns[-1]).alias(value))
    both = pairs.join(of(distributions, "candidate", "x"), ["cell", "candidate"]).join(of(distributions, "comparator", "y"), ["cell", "comparator", "block"])
    keys = ["cell", "candidate", "comparator", "basis"]
    gaps = both.select(*keys, F.explode(F.zip_with("x", "y", lambda x, y: x - y)).alias("gap"))
    spread = gaps.groupBy(*keys).agg(F.count("gap").alias("defined"), F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"))
    at = pairs.join(of(points, "candidate", "l"), ["cell", "candidate"]).join(of(points, "comparator", "r"), ["cell", "comparator"])
    return at.select(*keys, (F.col("l") - F.col("r")).alias("delta")).join(spread, keys)
