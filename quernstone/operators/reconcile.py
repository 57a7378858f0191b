"""Reconciling records: routes in order of priority, spines, multiset matches, contamination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def route_cascade(routes: list[DataFrame], key: str) -> DataFrame:
    """For each key the candidates of the first route that has any: the routes' union and the least priority, one pass for all routes."""
    tagged = [r.withColumn("route", F.lit(i)) for i, r in enumerate(routes, 1)]
    every = reduce(DataFrame.unionByName, tagged)
    first = every.groupBy(key).agg(F.min("route").alias("route"))
    return every.join(first, [key, "route"])


def spine(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer reconciliation of two relations with a match state."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))  # noqa: E741
    both = l.join(r, keys, "full_outer")
    state = F.when(F.col("__l").isNull(), "view_only").when(F.col("__r").isNull(), "detailed_only").otherwise("matched")
    return both.withColumn("match_state", state).drop("__l", "__r")


def numbered(df: DataFrame, keys: list[str], *order: Column | str, name: str = "occurrence") -> DataFrame:
    """The rows of each key numbered from 0 in the given order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def multiset_match(parent: DataFrame, subset: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each row of parent with whether subset holds that occurrence of its key: the k-th meets the k-th."""
    have = numbered(subset, keys, order).select(*keys, "occurrence", F.lit(True).alias("matched"))
    out = numbered(parent, keys, order).join(have, [*keys, "occurrence"], "left")
    return out.withColumn("matched", F.coalesce("matched", F.lit(False)))


def list_membership(df: DataFrame, item: str, columns: list[str], *keep: str) -> DataFrame:
    """One row for each of the columns' distinct values: what turns a join on ``x IN (a, b)`` into an equi-join."""
    return df.select(*keep, F.explode(F.array_distinct(F.array(*columns))).alias(item))
