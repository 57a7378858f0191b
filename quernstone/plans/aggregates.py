"""Aggregations (AG-*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import degree_summary, nearest_rank
from .registry import query
from .roles import BIN, EV, GRAPH, PAIRS, PE, degrees, pair_evidence, positive_pairs, table

COUNTERS = {"lines": "true", "active": "l_returnflag = 'A'", "returned": "l_returnflag = 'R'", "open_lines": "l_linestatus = 'O'", "bulk": "l_quantity > 40", "discounted": "l_discount > 0.05", "taxed": "l_tax > 0.04", "late": "l_shipdate >= TIMESTAMP '1997-01-01'", "dear": "l_extendedprice > 50000"}


@query("ag01_conditional_counters", "SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in COUNTERS.items()) + " FROM lineitem GROUP BY l_suppkey")
def ag01(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in COUNTERS.items()])


@query("ag02_totals", "SELECT count_if(o_orderstatus = 'F') AS closed, count_if(o_totalprice > 100000) AS dear FROM orders")
def ag02(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.count_if(F.col("o_totalprice") > 100000).alias("dear"))


@query("ag03_04_ordinal_pivot", "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS p1, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS p2, first(l_suppkey) FILTER (WHERE l_linenumber = 3) AS s3 FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def ag03(spark, d):
    at = lambda k, c: F.max(F.when(F.col("l_linenumber") == k, F.col(c)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(at(1, "l_partkey").alias("p1"), at(2, "l_partkey").alias("p2"), at(3, "l_suppkey").alias("s3"))


@query("ag05_06_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY l_returnflag")
def ag05(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("parts"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))


@query("ag07_08_lists_and_singletons", "SELECT p_brand, list_sort(list(DISTINCT p_size)) AS sizes, CASE WHEN count(DISTINCT p_name) = 1 THEN min(p_name) END AS only_name FROM part GROUP BY p_brand")
def ag07(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"), F.when(F.count_distinct("p_name") == 1, F.min("p_name")).alias("only_name"))


@query("ag09_10_11_flags_and_having", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS pending, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 5 AND count(DISTINCT o_orderstatus) > 1")
def ag09(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("pending"), F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("k"))
    return g.where("n > 5 and k > 1").drop("k")


@query("ag12_two_row_groups", "SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2")
def ag12(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.count("*").alias("n")).where("n = 2")


@query("ag13_edge_normalisation", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_quantity) AS best, min(l_discount) AS least_discount, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def ag13(spark, d):
    return table(spark, d, "lineitem").where("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.max("l_quantity").alias("best"), F.min("l_discount").alias("least_discount"), F.count("*").alias("n"))


@query("ag14_rejection_counters", "SELECT count(*) FILTER (WHERE l_quantity < 10) AS low, count(*) FILTER (WHERE l_quantity >= 10 AND l_discount < 0.02) AS plain, count(*) FILTER (WHERE l_quantity >= 10 AND l_discount >= 0.02) AS kept FROM lineitem")
def ag14(spark, d):
    return table(spark, d, "lineitem").agg(F.count_if(F.expr("l_quantity < 10")).alias("low"), F.count_if(F.expr("l_quantity >= 10 and l_discount < 0.02")).alias("plain"), F.count_if(F.expr("l_quantity >= 10 and l_discount >= 0.02")).alias("kept"))


@query("ag15_max_by", "SELECT l_suppkey, arg_max(l_orderkey, {'q': l_extendedprice, 'o': l_orderkey, 'n': l_linenumber}) AS last_order FROM lineitem GROUP BY l_suppkey")
def ag15(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("last_order"))


@query("ag16_duplicate_rows", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)")
def ag16(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


@query("ag17_null_census", "SELECT count(*) FILTER (WHERE event_id IS NULL) AS event_id, count(*) FILTER (WHERE ts IS NULL) AS ts, count(*) FILTER (WHERE value IS NULL) AS value, count(*) FILTER (WHERE props IS NULL) AS props FROM events")
def ag17(spark, d):
    return table(spark, d, "events").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("event_id", "ts", "value", "props")])


@query("ag18_conditional_sum", "SELECT l_shipmode, CAST(coalesce(sum(l_linenumber - 1) FILTER (WHERE l_quantity > 49), 0) AS BIGINT) AS s FROM (SELECT l_returnflag AS l_shipmode, * FROM lineitem) GROUP BY l_shipmode")
def ag18(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.coalesce(F.sum(F.when(F.col("l_quantity") > 49, F.col("l_linenumber") - 1)), F.lit(0)).alias("s"))


@query("ag19_scalar_subqueries", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT max(l_quantity) FROM lineitem) AS most")
def ag19(spark, d):
    for n in ("orders", "customer", "lineitem"):
        table(spark, d, n).createOrReplaceTempView(f"ag19_{n}")
    return spark.sql("SELECT (SELECT count(*) FROM ag19_orders) AS orders, (SELECT count(*) FROM ag19_customer) AS customers, (SELECT max(l_quantity) FROM ag19_lineitem) AS most")


@query("ag20_21_pair_index", f"WITH {EV}, {PE} SELECT a, b, count(*) AS n, count_if(source = 'A') AS n_a, count_if(source = 'R') AS n_r, list_sort(list(DISTINCT source)) AS sources FROM pe GROUP BY a, b")
def ag20(spark, d):
    return pair_evidence(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "A").alias("n_a"), F.count_if(F.col("source") == "R").alias("n_r"), F.array_sort(F.collect_set("source")).alias("sources"))


@query("ag22_completeness", "SELECT lang, count_if(length(source) > 0) AS with_source, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def ag22(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.length("source") > 0).alias("with_source"), F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"))


@query("ag23_node_degree", f"{GRAPH} SELECT node, degree FROM dg")
def ag23(spark, d):
    return degrees(positive_pairs(spark, d))


BRAND_LOAD = "k AS (SELECT 'P' || p_partkey AS node, p_brand AS c FROM part)"


def brands(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_brand").alias("c"))


def with_brands(pairs, k):
    return pairs.join(k.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(k.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")


@query("ag24_component_load", f"{PAIRS}, {BRAND_LOAD}, j AS (SELECT x.c AS ca, y.c AS cb FROM pp JOIN k x ON a = x.node JOIN k y ON b = y.node) SELECT c, count(*) AS load FROM (SELECT ca AS c FROM j UNION ALL SELECT cb FROM j WHERE cb <> ca) GROUP BY c")
def ag24(spark, d):
    return with_brands(positive_pairs(spark, d), brands(spark, d)).select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("c")).groupBy("c").agg(F.count("*").alias("load"))


@query("ag25_degree_mass", f"{GRAPH}, {BRAND_LOAD} SELECT c, CAST(sum(degree) AS BIGINT) AS mass FROM dg JOIN k USING (node) GROUP BY c")
def ag25(spark, d):
    return degrees(positive_pairs(spark, d)).join(brands(spark, d), "node").groupBy("c").agg(F.sum("degree").alias("mass"))


@query("ag26_27_nearest_rank", "SELECT l_returnflag, CAST(quantile_disc(l_partkey, 0.25) AS BIGINT) AS q25, CAST(quantile_disc(l_partkey, 0.5) AS BIGINT) AS q50, CAST(quantile_disc(l_partkey, 0.99) AS BIGINT) AS q99, min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem GROUP BY l_returnflag")
def ag26(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(nearest_rank("l_partkey", 0.25).alias("q25"), nearest_rank("l_partkey", 0.5).alias("q50"), nearest_rank("l_partkey", 0.99).alias("q99"), F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most"))


@query("ag28_29_31_degree_summary", f"{GRAPH}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM dg) SELECT max(n) AS n, CAST(sum(degree) AS BIGINT) AS total, round(2 * sum(i * degree) / (max(n) * sum(degree)) - (max(n) + 1) / max(n), 9) AS gini, round(sum(degree) FILTER (WHERE i > n - greatest(1, ceil(n * 0.01))) / sum(degree), 9) AS top_share, CAST(quantile_disc(degree, 0.25) AS BIGINT) AS q25, CAST(quantile_disc(degree, 0.5) AS BIGINT) AS q50, CAST(quantile_disc(degree, 0.75) AS BIGINT) AS q75, CAST(quantile_disc(degree, 0.99) AS BIGINT) AS q99, max(degree) AS most FROM r")
def ag28(spark, d):
    return degree_summary(degrees(positive_pairs(spark, d)))


@query("ag30_histogram", f"{GRAPH}, f AS (SELECT coalesce(degree, 0) AS g FROM part LEFT JOIN dg ON node = 'P' || p_partkey) SELECT CAST(to_json({{'0': count_if(g = 0), '1': count_if(g = 1), '2': count_if(g = 2), '3-4': count_if(g BETWEEN 3 AND 4), '5-9': count_if(g BETWEEN 5 AND 9), '10-19': count_if(g BETWEEN 10 AND 19), '20-49': count_if(g BETWEEN 20 AND 49), '50-99': count_if(g BETWEEN 50 AND 99), '100+': count_if(g >= 100)}}) AS VARCHAR) AS histogram FROM f")
def ag30(spark, d):
    from ..functions.identity import DEGREE_BINS, degree_bin

    g = brands(spark, d).join(degrees(positive_pairs(spark, d)), "node", "left").select(degree_bin(F.coalesce("degree", F.lit(0))).alias("bin"))
    return g.agg(F.to_json(F.struct(*[F.count_if(F.col("bin") == label).alias(label) for _, label in reversed(DEGREE_BINS)])).alias("histogram"))


@query("ag32_numeric_summary", "SELECT p_type, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS least, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(median(p_retailprice), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, max(p_retailprice) AS most FROM part GROUP BY p_type")
def ag32(spark, d):
    q = lambda x: F.round(F.percentile("p_retailprice", F.lit(x)), 6)
    return table(spark, d, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.min("p_retailprice").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("p_retailprice").alias("most"))


@query("ag33_outcome_counts", "SELECT event_type, count_if(value > 10) AS high, count_if(value <= 10) AS low, count_if(value IS NULL) AS unknown, count_if(value > 10) + count_if(value <= 10) AS evaluable FROM events GROUP BY event_type")
def ag33(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(v > 10).alias("high"), F.count_if(v <= 10).alias("low"), F.count_if(v.isNull()).alias("unknown"), (F.count_if(v > 10) + F.count_if(v <= 10)).alias("evaluable"))


CONTRAST = "SELECT o_custkey, p_brand, count(*) AS clones, count_if(l_returnflag = 'R') AS positive, count_if(l_returnflag = 'A') AS negative, count_if(l_returnflag = 'R') > 0 AND count_if(l_returnflag = 'A') > 0 AS contrast, bool_and(l_linestatus = 'F') AS all_closed FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 2"


def contrast_groups(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("o_custkey", "p_brand").agg(F.count("*").alias("clones"), F.count_if(F.col("l_returnflag") == "R").alias("positive"), F.count_if(F.col("l_returnflag") == "A").alias("negative"), F.bool_and(F.col("l_linestatus") == "F").alias("all_closed"))
    return g.where("clones >= 2").withColumn("contrast", (F.col("positive") > 0) & (F.col("negative") > 0))


@query("ag34_contrast_groups", CONTRAST)
def ag34(spark, d):
    return contrast_groups(spark, d)


@query("pf36_protection_state", f"SELECT CASE WHEN contrast AND all_closed THEN 'protected' WHEN contrast THEN 'contrast' WHEN positive = 0 THEN 'no_positive' ELSE 'uniform' END AS state, count(*) AS n FROM ({CONTRAST}) GROUP BY ALL")
def pf36(spark, d):
    c = F.col("contrast")
    state = F.when(c & F.col("all_closed"), "protected").when(c, "contrast").when(F.col("positive") == 0, "no_positive").otherwise("uniform")
    return contrast_groups(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("ag36_pair_populations", f"{GRAPH}, c AS (SELECT {BIN.format('degree')} AS bin, min(degree) AS o, count(*) AS n FROM dg GROUP BY ALL) SELECT x.bin || '|' || y.bin AS stratum, CAST(CASE WHEN x.bin = y.bin THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS BIGINT) AS pairs FROM c x JOIN c y ON x.o <= y.o")
def ag36(spark, d):
    from ..functions.identity import degree_bin, degree_bin_order

    c = degrees(positive_pairs(spark, d)).groupBy(degree_bin(F.col("degree")).alias("bin"), degree_bin_order(F.col("degree")).alias("o")).agg(F.count("*").alias("n"))  # nine rows at most
    j = c.alias("x").join(F.broadcast(c.alias("y")), F.col("x.o") <= F.col("y.o"))
    n, m = F.col("x.n"), F.col("y.n")
    return j.select(F.concat("x.bin", F.lit("|"), "y.bin").alias("stratum"), F.when(F.col("x.o") == F.col("y.o"), F.expr("x.n * (x.n - 1) div 2")).otherwise(n * m).alias("pairs"))


@query("ag38_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def ag38(spark, d):
    r = F.when((F.stddev_pop("l_quantity") > 0) & (F.stddev_pop("l_extendedprice") > 0), F.round(F.corr("l_quantity", "l_extendedprice"), 6))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r.alias("r"))


@query("ag39_range", "SELECT label, max(vec_id) - min(vec_id) AS spread FROM embeddings GROUP BY label")
def ag39(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg((F.max("vec_id") - F.min("vec_id")).alias("spread"))


@query("ag41_42_json_panel", "SELECT event_type, props->>'$.k' AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def ag41(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("ag43_spearman", "WITH r AS (SELECT l_returnflag, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) * 2 + count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) * 2 + count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY l_returnflag")
def ag43(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    def average_ranks(c):
        """From the counts of equal values: the window runs over distinct values."""
        k = l.groupBy("l_returnflag", c).agg(F.count("*").alias("k"))
        upto = F.sum("k").over(W.partitionBy("l_returnflag").orderBy(c).rowsBetween(W.unboundedPreceding, 0))
        return k.select("l_returnflag", c, (upto - (F.col("k") - 1) / 2).alias(f"rank_{c}"))

    j = l.join(average_ranks("l_quantity"), ["l_returnflag", "l_quantity"]).join(average_ranks("l_discount"), ["l_returnflag", "l_discount"])
    return j.groupBy("l_returnflag").agg(F.round(F.corr("rank_l_quantity", "rank_l_discount"), 6).alias("rho"))


@query("ag44_45_sequence_dimension", "SELECT sha256(text) AS h, min(doc_id) AS first_id, coalesce(list_sort(list(DISTINCT source) FILTER (WHERE lang <> 'en')), []) AS sources, count(DISTINCT lang) AS langs FROM documents GROUP BY ALL")
def ag44(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.array_sort(F.collect_set(F.when(F.col("lang") != "en", F.col("source")))).alias("sources"), F.count_distinct("lang").alias("langs"))


@query("ag46_source_and_union", "SELECT coalesce(l_returnflag, 'all') AS source, count(*) AS n, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 9) AS eligible FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def ag46(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)), 9).alias("eligible")).select(F.coalesce("l_returnflag", F.lit("all")).alias("source"), "n", "eligible")


@query("ag47_48_composition", f"WITH {EV}, {PE}, {BRAND_LOAD} SELECT source, within, n, round(n / sum(n) OVER (PARTITION BY source), 9) AS share FROM (SELECT source, x.c = y.c AS within, count(*) AS n FROM pe JOIN k x ON a = x.node JOIN k y ON b = y.node GROUP BY ALL)")
def ag47(spark, d):
    g = with_brands(pair_evidence(spark, d), brands(spark, d)).groupBy("source", (F.col("ca") == F.col("cb")).alias("within")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("source")), 9))


@query("ag57_completeness_verdict", "SELECT bool_and(n > 0) AS complete FROM (SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL)")
def ag57(spark, d):
    used = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").join(used, F.col("s_suppkey") == F.col("l_suppkey"), "left").agg(F.bool_and(F.coalesce("n", F.lit(0)) > 0).alias("complete"))


@query("ag59_field_value_counts", "SELECT field, value, n FROM (SELECT 'status' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL)")
def ag59(spark, d):
    o = table(spark, d, "orders").select(F.expr("stack(2, 'status', o_orderstatus, 'priority', o_orderpriority) as (field, value)"))
    return o.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("ag60_markup_census", "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY tag")
def ag60(spark, d):
    return table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
