"""Quality and contract checks (QC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.contracts import Contract, ensemble_census, orphans, relation_differences, uniform, violations
from .registry import query
from .roles import table

ORDERS = Contract("orders", {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string", "o_totalprice": "float64", "o_orderpriority": "string"}, required=("o_orderkey", "o_custkey"), vocabularies={"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH")}, key=("o_custkey", "o_orderstatus"))


@query("qc02_contract_rows", "SELECT 'required' AS check, 'o_orderkey' AS column, count_if(o_orderkey IS NULL) AS violations FROM orders UNION ALL SELECT 'required', 'o_custkey', count_if(o_custkey IS NULL) FROM orders UNION ALL SELECT 'vocabulary', 'o_orderstatus', count_if(o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 'vocabulary', 'o_orderpriority', count_if(o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) FROM orders UNION ALL SELECT 'primary_key', 'o_custkey,o_orderstatus', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1)")
def qc02(spark, d):
    return violations(ORDERS.conform(table(spark, d, "orders").drop("o_orderdate")), ORDERS)


@query("qc02_foreign_keys", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) GROUP BY ALL")
def qc02b(spark, d):
    return orphans(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size > 2"), "p_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


INVARIANTS = {"quantity": "l_quantity <= 0", "discount": "l_discount NOT BETWEEN 0 AND 0.1", "tax": "l_tax < 0", "flag": "l_returnflag = 'R' AND l_linestatus = 'O'", "line": "l_linenumber < 1", "price": "l_extendedprice < 0", "key": "l_partkey IS NULL OR l_suppkey IS NULL"}


@query("qc03_invariants", "SELECT " + ", ".join(f"count_if({c}) AS {n}" for n, c in INVARIANTS.items()) + " FROM lineitem")
def qc03(spark, d):
    return table(spark, d, "lineitem").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in INVARIANTS.items()])


@query("qc04_uniform_provenance", "SELECT count_if(lang IS DISTINCT FROM 'en') AS lang, count_if(source IS DISTINCT FROM 'src0') AS source FROM documents")
def qc04(spark, d):
    return uniform(table(spark, d, "documents"), lang="en", source="src0")


@query("qc05_recomputed_relation", "SELECT CASE WHEN y.k IS NULL THEN 'only_left' WHEN x.k IS NULL THEN 'only_right' WHEN x.n = y.n THEN 'equal' ELSE 'different' END AS state, count(*) AS rows FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) x FULL OUTER JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) y ON x.k = y.k GROUP BY ALL")
def qc05(spark, d):
    of = lambda s: table(spark, d, "lineitem").where(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return relation_differences(of("F"), of("O"), ["l_suppkey"])


@query("qc12_score_census", "SELECT count(*) - count(DISTINCT vec_id) AS repeated, count_if(len(embedding) <> 64) AS odd_sizes FROM embeddings")
def qc12(spark, d):
    return table(spark, d, "embeddings").agg((F.count("*") - F.count_distinct("vec_id")).alias("repeated"), F.count_if(F.size("embedding") != 64).alias("odd_sizes"))


#: Ensembles of columns over lines; the last one is no mean of its members.
ENSEMBLES = {"linear": ["m1", "m2", "m3"], "offset": ["m1", "m3"], "tax": ["m1", "m2"]}


@query("qc12_ensemble_census", """WITH s AS (SELECT CAST(round(l_quantity) AS DOUBLE) AS m1, CAST(round(l_quantity) + round(100 * l_discount) AS DOUBLE) AS m2, CAST(round(l_quantity) + 2 * round(100 * l_discount) AS DOUBLE) AS m3, round(100 * l_tax) AS tax FROM lineitem),
x AS (SELECT unnest([{'ensemble': 'linear', 'gap': abs(m2 - (m1 + m2 + m3) / 3)}, {'ensemble': 'offset', 'gap': abs(m2 - (m1 + m3) / 2)}, {'ensemble': 'tax', 'gap': abs(tax - (m1 + m2) / 2)}], recursive := true) FROM s)
SELECT ensemble, count(*) AS rows, count_if(gap IS NULL) AS incomplete, count_if(gap > 0) AS unequal, max(gap) AS largest FROM x GROUP BY ALL""")
def qc12_ensembles(spark, d):
    """Whether columns of ensembles are the exact means of their members' columns."""
    q, k = F.round("l_quantity"), F.round(F.col("l_discount") * 100)
    s = table(spark, d, "lineitem").select(q.alias("m1"), (q + k).alias("m2"), (q + 2 * k).alias("m3"), (q + k).alias("linear"), (q + k).alias("offset"), F.round(F.col("l_tax") * 100).alias("tax"))
    return ensemble_census(s, ENSEMBLES)
