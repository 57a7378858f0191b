"""Stratified bottom-hash samples with exact design weights."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hamilton(populations: dict[str, int], cap: int) -> dict[str, int]:
    """Seats for each stratum: one each, the rest by exact quotas, floors first and then largest remainders, ties by key.

    A cap of at least the whole population takes all; one below the number of strata is an error.
    """
    total, n = sum(populations.values()), len(populations)
    if cap >= total:
        return dict(populations)
    if cap < n:
        raise ValueError("a sample smaller than its number of strata")
    seats, rests, spare = {}, [], total - n
    for k, size in populations.items():
        whole, rest = divmod((cap - n) * (size - 1), spare)
        seats[k] = 1 + whole
        rests.append((-rest, k))
    for _, k in sorted(rests)[: cap - sum(seats.values())]:
        seats[k] += 1
    return seats


def hamilton_table(sizes: DataFrame, stratum: str, population: str, cap: int) -> DataFrame:
    """The same as a DataFrame over one row for each stratum, in integer arithmetic: column sample_size."""
    every = W.partitionBy()
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    df = sizes.withColumns({"__total": F.sum(population).over(every), "__n": F.count("*").over(every)})
    share = (F.lit(cap) - F.col("__n")).cast("decimal(18,0)") * (wide(population) - 1)
    spare = F.greatest(F.col("__total") - F.col("__n"), F.lit(1))
    df = df.withColumns({"__share": share.cast("decimal(38,0)"), "__spare": spare.cast("decimal(38,0)")})
    df = df.withColumns({"__whole": F.expr("cast(__share div __spare as bigint) + 1"), "__rest": F.expr("__share % __spare")})
    df = df.withColumns({"__left": F.lit(cap) - F.sum("__whole").over(every), "__rank": F.row_number().over(W.orderBy(F.desc("__rest"), stratum))})
    taken = F.when(F.col("__total") <= cap, F.col(population)).otherwise(F.col("__whole") + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0))
    return df.withColumn("sample_size", taken.cast("long")).drop(*[c for c in df.columns if c.startswith("__")])


def design(population: int, sample: int) -> tuple[int, int, int, int]:
    """Inclusion probability and weight as reduced fractions: (numerator, denominator, numerator, denominator)."""
    g = gcd(population, sample) or 1
    return sample // g, population // g, population // g, sample // g


def bottom_hash_sample(rows: DataFrame, sizes: DataFrame, stratum: str, key: str, ties: list[str]) -> DataFrame:
    """The sample_size rows of the smallest keys of each stratum, with population, sample_size and sample_rank.

    Keys are hexadecimal digests, so uniform: rows far above the expected cut leave before the exact ranking. A
    stratum in which the cut leaves too few is ranked whole. sizes has a row for each stratum.
    """
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(2**32)
    cut = F.least(F.lit(1.0), 1.3 * F.col("sample_size") / F.col("population") + 8 * F.sqrt(F.col("sample_size") + 1) / F.col("population"))
    near = rows.join(F.broadcast(sizes.withColumn("__cut", cut)), stratum)
    held = near.where(lead <= F.col("__cut")).groupBy(stratum).agg(F.count("*").alias("__held"))
    short = sizes.join(held, stratum, "left").where(F.coalesce("__held", F.lit(0)) < F.col("sample_size")).select(stratum, F.lit(True).alias("__whole"))
    kept = near.join(F.broadcast(short), stratum, "left").where((lead <= F.col("__cut")) | F.col("__whole"))
    ranked = kept.withColumn("sample_rank", F.row_number().over(W.partitionBy(stratum).orderBy(key, *ties)))
    return ranked.where(F.col("sample_rank") <= F.col("sample_size")).drop("__cut", "__whole")
