"""Weighted rank metrics with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import durable


def by_score(rows: DataFrame, group: list[str], score: str, positive: Column, weight: Column) -> DataFrame:
    """Positives p and weighted others u for each distinct score: the windows below run over scores, not rows."""
    return rows.groupBy(*group, F.col(score).alias("score")).agg(F.sum(F.when(positive, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(positive, 0.0).otherwise(weight)).alias("u"))


def concordance(rows: DataFrame, group: list[str], score: str, positive: Column, weight: Column) -> DataFrame:
    """The weighted share of (positive, other) pairs that are ordered rightly, ties counting half."""
    t = by_score(rows, group, score, positive, weight)
    below = F.coalesce(F.sum("u").over(W.partitionBy(*group).orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("good", F.col("p") * (below + F.col("u") / 2))
    return t.groupBy(*group).agg(F.when((F.sum("p") > 0) & (F.sum("u") > 0), F.sum("good") / (F.sum("p") * F.sum("u"))).alias("concordance"))


def ranged_concordance(rows: DataFrame, group: list[str], score: str, positive: Column, weight: Column) -> DataFrame:
    """``concordance`` for scores of nearly as many values as rows: ranges of scores are summed apart, and a range begins behind the sums of those before."""
    keys = [*group, "score"]
    t = by_score(rows, group, score, positive, weight).repartitionByRange(*keys)
    t = durable(t.withColumn("range", F.spark_partition_id()), "score-ranges")
    sums = t.groupBy(*group, "range").agg(F.sum("u").alias("u"))  # a row for each range and group
    before = F.coalesce(F.sum("u").over(W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select(*group, "range", before.alias("before"))
    inside = F.coalesce(F.sum("u").over(W.partitionBy(*group, "range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("inside", inside).join(starts, [*group, "range"]).withColumn("good", F.col("p") * (F.col("before") + F.col("inside") + F.col("u") / 2))
    return t.groupBy(*group).agg(F.when((F.sum("p") > 0) & (F.sum("u") > 0), F.sum("good") / (F.sum("p") * F.sum("u"))).alias("concordance"))


def average_precision(rows: DataFrame, group: list[str], score: str, positive: Column, weight: Column) -> DataFrame:
    """Average precision from the highest score down, a tie group at once."""
    down = W.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    t = by_score(rows, group, score, positive, weight).withColumns({"cp": F.sum("p").over(down), "cu": F.sum("u").over(down)})
    t = t.withColumn("part", F.when(F.col("cp") + F.col("cu") > 0, F.col("p") * F.col("cp") / (F.col("cp") + F.col("cu"))).otherwise(0.0))
    return t.groupBy(*group).agg(F.when(F.sum("p") > 0, F.sum("part") / F.sum("p")).alias("average_precision"))
