"""Scores of pairs from the segments of their ends' vectors, and the diagnostic of local against global scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M

SCORES = ("local_max", "local_top4", "global")


def segment_scores(pairs: DataFrame, endpoints: DataFrame, width: int = 16) -> DataFrame:
    """pairs (a, b and others) with cosines of their ends' segments: local_max the best of all segments with all, local_top4 the mean of the four best, global that of whole vectors.

    endpoints: node and vector, integers whose squares add up to less than 2^53, so that every sum is exact and a score depends on no order. Vectors have equal lengths,
    a multiple of ``width`` and at least two segments; a vector without length has cosine 0. Pairs with an end that has no vector, or a null one, have no row. Batches of joined rows are
    scored as matrices; no task holds more than a batch.
    """
    known = endpoints.where("vector is not null")
    met = pairs.join(known.toDF("a", "__x"), "a").join(known.toDF("b", "__y"), "b")
    others = [f"c{i}" for i in range(len(pairs.columns))]  # mapInArrow takes no names with dots

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.asarray(batch.column(c).flatten(), dtype=np.float64).reshape(n, -1, width) for c in ("__x", "__y"))

            def cosine(dots, p, q):
                size = p * q
                return np.divide(dots, np.sqrt(size), out=np.zeros_like(dots), where=size > 0)

            local = cosine(np.einsum("nid,njd->nij", x, y), (x * x).sum(2)[:, :, None], (y * y).sum(2)[:, None, :]).reshape(n, -1)
            best = -np.sort(-local, axis=1)
            top = (((best[:, 0] + best[:, 1]) + best[:, 2]) + best[:, 3]) / 4
            whole = cosine((x * y).sum((1, 2)), (x * x).sum((1, 2)), (y * y).sum((1, 2)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(best[:, 0]), pa.array(top), pa.array(whole)], names=[*others, *SCORES])

    schema = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(others, pairs.schema.fields)), *(f"{s} double" for s in SCORES)])
    plain = met.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(pairs.columns, others)), "__x", "__y")
    return plain.mapInArrow(work, schema).toDF(*pairs.columns, *SCORES)


def scalar_scores(x: Column, y: Column, segments: int, width: int = 16) -> list[Column]:
    """The same three scores of one pair's vectors as plain expressions."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    cosine = lambda p, q: F.when(dot(p, p) * dot(q, q) > 0, dot(p, q) / F.sqrt(dot(p, p) * dot(q, q))).otherwise(0.0)
    part = lambda v, i: F.slice(v, i * width + 1, width)
    local = F.sort_array(F.array(*[cosine(part(x, i), part(y, j)) for i in range(segments) for j in range(segments)]), asc=False)
    top = (((F.get(local, F.lit(0)) + F.get(local, F.lit(1))) + F.get(local, F.lit(2))) + F.get(local, F.lit(3))) / 4
    return [F.get(local, F.lit(0)), top, cosine(x, y)]


def scalar_differences(scored: DataFrame, endpoints: DataFrame, segments: int, width: int = 16, rows: int = 100) -> DataFrame:
    """Of the ``rows`` pairs of the least digests, those whose scores differ from the plain ones."""
    digest = F.sha2(F.concat_ws("|", "a", "b"), 256)
    chosen = scored.select("a", "b", *SCORES).orderBy(digest, "a", "b").limit(rows)
    known = endpoints.where("vector is not null")
    met = chosen.join(known.toDF("a", "__x"), "a").join(known.toDF("b", "__y"), "b")
    plain = scalar_scores(F.col("__x"), F.col("__y"), segments, width)
    unlike = [F.col(s) != p for s, p in zip(SCORES, plain)]
    return met.where(unlike[0] | unlike[1] | unlike[2]).select("a", "b", *SCORES)


def local_trigger(scored: DataFrame, cell: str, positive: Column, weight: Column, floor: float = 0.51, gain: float = 0.01) -> DataFrame:
    """cell, local score, its concordance, that of the global score, their difference, and whether the local one reaches the floor and the gain."""
    of = {s: M.ranged_concordance(scored.select(cell, s, positive.alias("pos"), weight.alias("w")), [cell], s, F.col("pos"), F.col("w")).select(cell, F.round("concordance", 9).alias("concordance")) for s in SCORES}
    one = lambda s: of[s].withColumn("score", F.lit(s)).join(of["global"].select(cell, F.col("concordance").alias("global_concordance")), cell)
    both = one(SCORES[0]).unionByName(one(SCORES[1])).withColumn("delta", F.round(F.col("concordance") - F.col("global_concordance"), 9))
    return both.withColumn("triggered", (F.col("concordance") >= floor) & (F.col("delta") >= gain))
