"""Scorers over graphs and segments, alignments, training preparation (FN-32/33, JN-25/27/33, AG-35/37/58, AL-05/45/46)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .identities import CELLS, HELD, heldout_brands, with_cells
from ..functions.identity import degree_bin, degree_bin_order, degree_pair_stratum
from ..functions.text import ngrams
from .registry import query
from .roles import GRAPH, PAIRS, PD, STRATUM, degrees, positive_pairs, table, with_degrees

SEG = "(SELECT vec_id, label, [list_sum(embedding[i*16+1:i*16+16]::DOUBLE[]) FOR i IN range(0, 4)] AS s FROM embeddings)"


@query("fn32_segment_products", f"WITH k AS (SELECT x.vec_id, x.s AS p, y.s AS q FROM {SEG} x JOIN {SEG} y ON y.vec_id = x.vec_id + 1), m AS (SELECT vec_id, p[i] * q[j] AS v FROM k, LATERAL (SELECT unnest([1,2,3,4]) AS i), LATERAL (SELECT unnest([1,2,3,4]) AS j)) SELECT vec_id, round(max(v), 6) AS best FROM m GROUP BY vec_id")
def fn32(spark, d):
    x = F.col("embedding").cast("array<double>")
    sums = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.aggregate(F.slice("x", i * 16 + 1, F.lit(16)), F.lit(0.0), lambda a, v: a + v))
    e = table(spark, d, "embeddings").select("vec_id", x.alias("x")).select("vec_id", sums.alias("p"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    best = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("q", lambda b: a * b))))
    return j.select("vec_id", F.round(best, 6).alias("best"))


SIM = "sim AS (SELECT 'P' || x.p_partkey AS u, 'P' || y.p_partkey AS v, CASE WHEN x.p_size = y.p_size THEN 0.9 ELSE 0.6 END::DOUBLE AS s FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_name = y.p_name AND x.p_partkey <> y.p_partkey)"


def similar(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    y = p.select(F.col("p_partkey").alias("k2"), "p_brand", "p_type", "p_name", F.col("p_size").alias("z2"))
    j = p.join(y, ["p_brand", "p_type", "p_name"]).where("p_partkey <> k2")
    return j.select(F.concat(F.lit("P"), "p_partkey").alias("u"), F.concat(F.lit("P"), "k2").alias("v"), F.when(F.col("p_size") == F.col("z2"), 0.9).otherwise(0.6).alias("s"))


@query("fn33_interolog", f"{PAIRS}, {SIM}, e AS (SELECT a AS x, b AS y FROM pp WHERE in_a AND in_r UNION ALL SELECT b, a FROM pp WHERE in_a AND in_r) SELECT least(p.u, q.u) AS a, greatest(p.u, q.u) AS b, max(least(p.s, q.s)) AS score FROM e JOIN sim p ON p.v = e.x JOIN sim q ON q.v = e.y WHERE p.u <> q.u GROUP BY ALL")
def fn33(spark, d):
    """Pairs whose neighbours in similarity interact: the best over training edges of the weaker of both similarities."""
    p, sim = positive_pairs(spark, d).where("in_a and in_r"), similar(spark, d)
    e = p.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
    j = e.join(sim.toDF("ua", "x", "sa"), "x").join(sim.toDF("ub", "y", "sb"), "y").where("ua <> ub")
    return j.groupBy(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).agg(F.max(F.least("sa", "sb")).alias("score"))


@query("jn25_crosswalk", "SELECT count(*) AS rows, count_if(n <> 1) AS ambiguous FROM (SELECT l_orderkey, l_linenumber, count(o_orderkey) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)")
def jn25(spark, d):
    k = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.count("*").alias("m"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("r")).join(k, "l_orderkey", "left")
    return g.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("m") * F.col("r"), F.lit(0)) != 1).alias("ambiguous"))


@query("jn27_kmer_neighbours", "WITH k AS (SELECT DISTINCT p_brand, p_type, substr(p_type, 1, 3) AS g FROM part) SELECT x.p_brand AS a, y.p_brand AS b, count(DISTINCT x.g) AS shared FROM k x JOIN k y ON x.g = y.g AND x.p_brand < y.p_brand GROUP BY ALL")
def jn27(spark, d):
    k = table(spark, d, "part").select("p_brand", F.substring("p_type", 1, 3).alias("g")).distinct()
    return k.toDF("a", "g").join(k.toDF("b", "g"), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


KMERS = "k AS (SELECT p_brand AS id, g, count(*) AS n FROM (SELECT p_brand, unnest([substr(p_type, i, 3) FOR i IN range(1, length(p_type) - 1)]) AS g FROM part) GROUP BY ALL), v AS (SELECT id, g, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS v FROM k)"


@query("jn27_kmer_similarity", f"WITH {KMERS} SELECT x.id AS a, y.id AS b, round(sum(x.v * y.v), 9) AS similarity FROM v x JOIN v y ON x.g = y.g WHERE y.id NOT IN {HELD} GROUP BY x.id, y.id")
def jn27_whole(spark, d):
    """All groups against those that aren't held out, by all 3-mers of their texts with normalised counts; pairs without a common 3-mer have no row."""
    k = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.explode(ngrams(F.col("p_type"))).alias("g")).groupBy("id", "g").agg(F.count("*").alias("n"))
    norm = k.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    v = k.join(norm, "id").select("id", "g", (F.col("n") / F.col("norm")).alias("v"))
    exposed = v.join(heldout_brands(spark, d), F.col("id") == F.col("p_brand"), "left_anti")
    j = v.toDF("a", "g", "va").join(exposed.toDF("b", "g", "vb"), "g")
    return j.groupBy("a", "b").agg(F.round(F.sum(F.col("va") * F.col("vb")), 9).alias("similarity"))


@query("jn33_selection_flags", "SELECT l_orderkey, l_linenumber, (l_partkey, l_suppkey) IN (SELECT o_custkey, o_custkey FROM orders) AS exact, l_partkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS by_part FROM lineitem")
def jn33(spark, d):
    o = table(spark, d, "orders")
    exact = o.select(F.col("o_custkey").alias("l_partkey"), F.col("o_custkey").alias("l_suppkey")).distinct().withColumn("e", F.lit(True))
    part = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("l_partkey")).distinct().withColumn("p", F.lit(True))
    j = table(spark, d, "lineitem").join(exact, ["l_partkey", "l_suppkey"], "left").join(part, "l_partkey", "left")
    return j.select("l_orderkey", "l_linenumber", F.col("e").isNotNull().alias("exact"), F.col("p").isNotNull().alias("by_part"))


@query("ag35_cell_summary", f"{PAIRS}, {CELLS} SELECT cell, count(*) AS pairs, (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM cells c WHERE c.cell = k.cell UNION SELECT b FROM cells c WHERE c.cell = k.cell)) AS endpoints, count_if(in_a) AS from_a, count_if(in_r) AS from_r FROM cells k GROUP BY cell")
def ag35(spark, d):
    c = with_cells(positive_pairs(spark, d))
    ends = c.select("cell", F.explode(F.array("a", "b")).alias("x")).groupBy("cell").agg(F.count_distinct("x").alias("endpoints"))
    return c.groupBy("cell").agg(F.count("*").alias("pairs"), F.count_if("in_a").alias("from_a"), F.count_if("in_r").alias("from_r")).join(ends, "cell")


@query("ag37_unlabelled_per_stratum", f"{GRAPH}, {PD}, pos AS (SELECT {STRATUM} AS stratum, count(*) AS n FROM pd GROUP BY ALL), c AS (SELECT degree, count(*) AS k FROM dg GROUP BY ALL), pop AS (SELECT {STRATUM} AS stratum, sum(m) AS total FROM (SELECT x.degree AS da, y.degree AS db, CASE WHEN x.degree = y.degree THEN x.k * (x.k - 1) // 2 ELSE x.k * y.k END AS m FROM c x JOIN c y ON x.degree <= y.degree) GROUP BY ALL) SELECT stratum, CAST(total - coalesce(n, 0) AS BIGINT) AS unlabelled FROM pop LEFT JOIN pos USING (stratum)")
def ag37(spark, d):
    """All pairs of each stratum by the counts of degrees, less its positive ones: no pair is enumerated."""
    p = positive_pairs(spark, d)
    g = degrees(p)
    pos = with_degrees(p, g).groupBy(degree_pair_stratum(F.col("da"), F.col("db")).alias("stratum")).agg(F.count("*").alias("n"))
    degree = F.col("degree")
    c = g.groupBy(degree_bin(degree).alias("bin"), degree_bin_order(degree).alias("o")).agg(F.count("*").alias("n"))  # nine rows at most
    j = c.alias("x").join(F.broadcast(c.alias("y")), F.col("x.o") <= F.col("y.o"))
    m = F.when(F.col("x.o") == F.col("y.o"), F.expr("x.n * (x.n - 1) div 2")).otherwise(F.col("x.n") * F.col("y.n"))
    pop = j.select(F.concat("x.bin", F.lit("|"), "y.bin").alias("stratum"), m.alias("total"))
    return pop.join(pos, "stratum", "left").select("stratum", (F.col("total") - F.coalesce("n", F.lit(0))).alias("unlabelled"))


@query("ag54_degrees_with_zero", f"{GRAPH} SELECT 'P' || p_partkey AS node, coalesce(degree, 0) AS degree FROM part LEFT JOIN dg ON node = 'P' || p_partkey")
def ag54(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return nodes.join(degrees(positive_pairs(spark, d)), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("ag58_partner_constructs", "SELECT p_brand, p_size, list_sort(list(DISTINCT p_type)) AS types, count(DISTINCT p_name) = 1 AS unique_name FROM part GROUP BY ALL")
def ag58(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set("p_type")).alias("types"), (F.count_distinct("p_name") == 1).alias("unique_name"))


@query("al05_alignment_normalisation", "WITH v AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, (50 - l_quantity) / 50 AS identity, l_extendedprice AS bits, l_tax AS evalue FROM lineitem WHERE l_partkey <> l_suppkey AND isfinite(l_extendedprice)) SELECT a, b, max(identity) AS identity, max(bits) AS bits, min(evalue) AS evalue, count(*) AS alignments FROM v WHERE identity + 1e-12 >= 0.2 GROUP BY a, b")
def al05(spark, d):
    from ..functions.text import finite

    v = table(spark, d, "lineitem").where((F.col("l_partkey") != F.col("l_suppkey")) & finite(F.col("l_extendedprice")))
    v = v.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), ((50 - F.col("l_quantity")) / 50).alias("identity"), F.col("l_extendedprice").alias("bits"), F.col("l_tax").alias("evalue"))
    return v.where(F.col("identity") + 1e-12 >= 0.2).groupBy("a", "b").agg(F.max("identity").alias("identity"), F.max("bits").alias("bits"), F.min("evalue").alias("evalue"), F.count("*").alias("alignments"))


@query("al45_training_index", f"{GRAPH}, i AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS idx FROM dg) SELECT pp.a, pp.b, x.idx AS ia, y.idx AS ib FROM pp JOIN i x ON a = x.node JOIN i y ON b = y.node WHERE in_a")
def al45(spark, d):
    """Dense numbers of the endpoints in order: places within ranges of the order, and the ranges' sizes before."""
    p = positive_pairs(spark, d)
    from ..operators.durable import durable

    nodes = degrees(p).select("node").repartitionByRange("node").sortWithinPartitions("node").withColumn("row", F.monotonically_increasing_id())
    nodes = durable(nodes, "index").withColumn("part", F.shiftright("row", 33))
    sizes = nodes.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    i = nodes.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("node", (F.col("before") + F.col("row") - F.shiftleft("part", 33)).alias("idx"))
    return p.where("in_a").select("a", "b").join(i.toDF("a", "ia"), "a").join(i.toDF("b", "ib"), "b")


@query("al46_nested_counts", f"{PAIRS}, k AS (SELECT 'P' || p_partkey AS node, p_brand IN {HELD} AS held FROM part) SELECT in_a, CASE WHEN x.held AND y.held THEN 'C3' WHEN x.held OR y.held THEN 'C2' ELSE 'C1' END AS cell, count(*) AS n FROM pp JOIN k x ON a = x.node JOIN k y ON b = y.node GROUP BY ALL")
def al46(spark, d):
    held = heldout_brands(spark, d).withColumn("h", F.lit(True))
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), "p_brand").join(held, "p_brand", "left").select("node", F.coalesce("h", F.lit(False)).alias("held"))
    j = positive_pairs(spark, d).join(nodes.toDF("a", "ha"), "a").join(nodes.toDF("b", "hb"), "b")
    cell = F.when(F.col("ha") & F.col("hb"), "C3").when(F.col("ha") | F.col("hb"), "C2").otherwise("C1")
    return j.groupBy("in_a", cell.alias("cell")).agg(F.count("*").alias("n"))
