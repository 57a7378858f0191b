"""The test tables in the roles of the evidence warehouse, as DataFrames and as the common table expressions of the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """One row for each observation: an order line, its source, its two participants."""
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("state"),
        F.concat(F.lit("P"), "l_partkey").alias("part"), F.concat(F.lit("S"), "l_suppkey").alias("supp"), F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
    )


EV = """ev AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS evidence_id, l_returnflag AS source, l_linestatus AS state, 'P' || l_partkey AS part, 'S' || l_suppkey AS supp,
  l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem)"""


def participants(spark: SparkSession, d: str) -> DataFrame:
    """evidence_id, source, ordinal (1: part, 2: supplier), participant."""
    e = evidence(spark, d)
    both = F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.col("part").alias("participant")), F.struct(F.lit(2).alias("ordinal"), F.col("supp").alias("participant"))))
    return e.select("evidence_id", "source", both.alias("p")).select("evidence_id", "source", "p.ordinal", "p.participant")


PA = "pa AS (SELECT evidence_id, source, 1 AS ordinal, part AS participant FROM ev UNION ALL SELECT evidence_id, source, 2, supp FROM ev)"


def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Two different parts in one order, in canonical order, with the source of the earlier line."""
    e = evidence(spark, d).select("orderkey", "line", "part", "source")
    other = e.select("orderkey", F.col("line").alias("line2"), F.col("part").alias("part2"))
    joined = e.join(other, "orderkey").where((F.col("line") < F.col("line2")) & (F.col("part") != F.col("part2")))
    return joined.select(F.least("part", "part2").alias("a"), F.greatest("part", "part2").alias("b"), "source")


PE = "pe AS (SELECT least(x.part, y.part) AS a, greatest(x.part, y.part) AS b, x.source FROM ev x JOIN ev y ON x.orderkey = y.orderkey AND x.line < y.line AND x.part <> y.part)"


def positive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """a, b, n and whether source A and source R report the pair."""
    return pair_evidence(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"), F.bool_or(F.col("source") == "A").alias("in_a"), F.bool_or(F.col("source") == "R").alias("in_r"))


PP = "pp AS (SELECT a, b, count(*) AS n, bool_or(source = 'A') AS in_a, bool_or(source = 'R') AS in_r FROM pe GROUP BY a, b)"


def degrees(pairs: DataFrame) -> DataFrame:
    """node and degree over the ends of undirected edges."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


DG = "dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pp UNION ALL SELECT b FROM pp) GROUP BY node)"

PAIRS = f"WITH {EV}, {PE}, {PP}"
GRAPH = f"{PAIRS}, {DG}"
BIN = "CASE WHEN {0} >= 100 THEN '100+' WHEN {0} >= 50 THEN '50-99' WHEN {0} >= 20 THEN '20-49' WHEN {0} >= 10 THEN '10-19' WHEN {0} >= 5 THEN '5-9' WHEN {0} >= 3 THEN '3-4' ELSE CAST({0} AS VARCHAR) END"
STRATUM = f"concat({BIN.format('least(da, db)')}, '|', {BIN.format('greatest(da, db)')})"


def with_degrees(pairs: DataFrame, deg: DataFrame) -> DataFrame:
    """pairs with the degrees da and db of both ends, 0 where an end has none."""
    out = pairs.join(deg.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a", "left").join(deg.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b", "left")
    return out.withColumns({"da": F.coalesce("da", F.lit(0)), "db": F.coalesce("db", F.lit(0))})


PD = "pd AS (SELECT pp.*, x.degree AS da, y.degree AS db FROM pp JOIN dg x ON pp.a = x.node JOIN dg y ON pp.b = y.node)"
