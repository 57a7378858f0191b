"""Joins (JN-*) and set operations (SE-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.reconcile import list_membership, multiset_match, numbered, route_cascade, spine
from .registry import query
from .roles import EV, GRAPH, PA, PAIRS, PD, PE, degrees, evidence, pair_evidence, participants, positive_pairs, table, with_degrees


@query("jn01_composite_equi", f"WITH {EV}, {PA} SELECT ev.evidence_id, ordinal, participant FROM ev JOIN pa ON ev.evidence_id = pa.evidence_id AND ev.source = pa.source")
def jn01(spark, d):
    return evidence(spark, d).select("evidence_id", "source").join(participants(spark, d), ["evidence_id", "source"]).select("evidence_id", "ordinal", "participant")


@query("jn02_left_enrichment", "SELECT p_partkey, n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) ON p_partkey = l_partkey")
def jn02(spark, d):
    s = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return table(spark, d, "part").select("p_partkey").join(s, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "n")


@query("jn03_one_sided_condition", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_orderstatus = 'F' AND o_custkey = c_custkey")
def jn03(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), (F.col("o_orderstatus") == "F") & (F.col("o_custkey") == F.col("c_custkey")), "left").select("o_orderkey", "c_name")


ROUTES = """r AS (
  SELECT s_suppkey, 1 AS route, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey
  UNION ALL SELECT s_suppkey, 2, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND round(s_acctbal) = round(c_acctbal)
  UNION ALL SELECT s_suppkey, 3, min(c_custkey) FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY s_suppkey
  UNION ALL SELECT s_suppkey, 4, 0 FROM supplier)"""


def routes(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    same = F.col("s_nationkey") == F.col("c_nationkey")
    first_of_nation = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    return [
        s.join(c, same & (F.col("s_suppkey") == F.col("c_custkey"))).select("s_suppkey", "c_custkey"),
        s.join(c, same & (F.round("s_acctbal") == F.round("c_acctbal"))).select("s_suppkey", "c_custkey"),
        s.join(first_of_nation, same).select("s_suppkey", "c_custkey"),
        s.select("s_suppkey", F.lit(0).cast("long").alias("c_custkey")),
    ]


@query("jn04_route_cascade", f"WITH {ROUTES} SELECT s_suppkey, CAST(route AS INTEGER) AS route, c_custkey FROM r WHERE route = (SELECT min(route) FROM r q WHERE q.s_suppkey = r.s_suppkey)")
def jn04(spark, d):
    return route_cascade(routes(spark, d), "s_suppkey").select("s_suppkey", "route", "c_custkey")


@query("jn05_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn05(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jn06_unnest_join", "SELECT p_partkey, w, n_nationkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) JOIN nation ON length(w) = n_nationkey")
def jn06(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    return w.join(F.broadcast(table(spark, d, "nation")), F.length("w") == F.col("n_nationkey")).select("p_partkey", "w", "n_nationkey")


@query("jn07_two_hops", "SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn07(spark, d):
    nr = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")


@query("jn08_left_anti", f"{PAIRS} SELECT x.a, x.b FROM pp x LEFT JOIN (SELECT a, b FROM pp WHERE in_a) y ON x.a = y.a AND x.b = y.b WHERE y.a IS NULL")
def jn08(spark, d):
    p = positive_pairs(spark, d)
    return p.select("a", "b").join(p.where("in_a").select("a", "b"), ["a", "b"], "left_anti")


@query("jn09_theta_pairs", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey")
def jn09(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("a")).join(s.select(F.col("s_suppkey").alias("b")), F.col("a") < F.col("b"))


@query("jn10_product_of_roles", "SELECT least(s_name, n_name) AS a, greatest(s_name, n_name) AS b FROM supplier CROSS JOIN nation")
def jn10(spark, d):
    j = table(spark, d, "supplier").crossJoin(F.broadcast(table(spark, d, "nation")))  # 25 nations
    return j.select(F.least("s_name", "n_name").alias("a"), F.greatest("s_name", "n_name").alias("b"))


@query("jn11_dimension_twice", f"{GRAPH}, {PD} SELECT a, b, da, db FROM pd")
def jn11(spark, d):
    p = positive_pairs(spark, d)
    return with_degrees(p, degrees(p)).select("a", "b", "da", "db")


@query("jn12_rank_within_sample", "WITH k AS (SELECT l_returnflag AS s, CAST(floor(sqrt(count(*))) AS BIGINT) AS sample_size FROM lineitem GROUP BY ALL), r AS (SELECT l_returnflag AS s, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256(concat_ws('-', l_orderkey, l_linenumber)), l_orderkey, l_linenumber) AS rk FROM lineitem) SELECT s, l_orderkey, l_linenumber FROM r JOIN k USING (s) WHERE rk <= sample_size")
def jn12(spark, d):
    from ..operators.sampling import bottom_hash_sample

    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("s"), "l_orderkey", "l_linenumber", F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber"), 256).alias("h"))  # noqa: E741
    sizes = l.groupBy("s").agg(F.count("*").alias("population"), F.floor(F.sqrt(F.count("*"))).alias("sample_size"))
    return bottom_hash_sample(l, sizes, "s", "h", ["l_orderkey", "l_linenumber"]).select("s", "l_orderkey", "l_linenumber")


@query("jn13_full_outer_mismatches", "SELECT count(*) AS rows, count_if(x.n IS DISTINCT FROM y.n) AS mismatches FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) x FULL OUTER JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) y ON x.k = y.k")
def jn13(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    count = lambda f, n: l.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.count("*").alias(n))
    return count("A", "x").join(count("R", "y"), "l_partkey", "full_outer").agg(F.count("*").alias("rows"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"))


@query("jn14_spine", "WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), r AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), k AS (SELECT l_partkey, l_suppkey FROM a UNION SELECT * FROM r) SELECT k.l_partkey, k.l_suppkey, n, CASE WHEN a.n IS NULL THEN 'view_only' WHEN r.l_partkey IS NULL THEN 'detailed_only' ELSE 'matched' END AS match_state FROM k LEFT JOIN a ON k.l_partkey = a.l_partkey AND k.l_suppkey = a.l_suppkey LEFT JOIN r ON k.l_partkey = r.l_partkey AND k.l_suppkey = r.l_suppkey")
def jn14(spark, d):
    l, keys = table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"]  # noqa: E741
    return spine(l.where("l_returnflag = 'A'").groupBy(*keys).agg(F.count("*").alias("n")), l.where("l_returnflag = 'R'").select(*keys).distinct(), keys)


@query("jn15_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def jn15(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "lineitem").where("l_quantity = 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("jn16_member_of_two_columns", f"{PAIRS}, f AS (SELECT 'P' || p_partkey AS node FROM part WHERE p_size = 1) SELECT a, b FROM pp WHERE a IN (SELECT node FROM f) OR b IN (SELECT node FROM f)")
def jn16(spark, d):
    f = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return list_membership(positive_pairs(spark, d), "node", ["a", "b"], "a", "b").join(f, "node").groupBy("a", "b").agg(F.lit(1)).select("a", "b")


@query("jn17_computed_keys", f"{PAIRS} SELECT e.l_orderkey, count(*) AS n FROM lineitem e JOIN pp ON pp.a = least('P' || l_partkey, 'P' || l_suppkey) AND pp.b = greatest('P' || l_partkey, 'P' || l_suppkey) GROUP BY ALL")
def jn17(spark, d):
    p, s = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("P"), "l_suppkey")
    l = table(spark, d, "lineitem").select("l_orderkey", F.least(p, s).alias("a"), F.greatest(p, s).alias("b"))  # noqa: E741
    return l.join(positive_pairs(spark, d), ["a", "b"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("jn18_self_overlap", f"WITH {EV}, {PE} SELECT x.source AS s1, y.source AS s2, count(*) AS n FROM (SELECT DISTINCT a, b, source FROM pe) x JOIN (SELECT DISTINCT a, b, source FROM pe) y ON x.a = y.a AND x.b = y.b AND x.source < y.source GROUP BY ALL")
def jn18(spark, d):
    x = pair_evidence(spark, d).distinct()
    return x.withColumnRenamed("source", "s1").join(x.withColumnRenamed("source", "s2"), ["a", "b"]).where("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("n"))


@query("jn19_index_probe", "WITH r AS (SELECT s_suppkey, 1 AS route, p_partkey FROM supplier JOIN part ON s_suppkey = p_partkey AND p_size < 25 UNION ALL SELECT s_suppkey, 2, p_partkey FROM supplier JOIN part ON s_suppkey + 1 = p_partkey) SELECT s_suppkey, CAST(route AS INTEGER) AS route, p_partkey FROM r WHERE route = (SELECT min(route) FROM r q WHERE q.s_suppkey = r.s_suppkey)")
def jn19(spark, d):
    s, p = table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "part")
    exact = s.join(p.where("p_size < 25"), F.col("s_suppkey") == F.col("p_partkey")).select("s_suppkey", "p_partkey")
    alias = s.join(p, F.col("s_suppkey") + 1 == F.col("p_partkey")).select("s_suppkey", "p_partkey")
    return route_cascade([exact, alias], "s_suppkey").select("s_suppkey", "route", "p_partkey")


@query("jn20_multi_basis_overlap", "WITH x AS (SELECT l_orderkey, 'ordered' AS basis FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_partkey = o_custkey UNION ALL SELECT l_orderkey, 'unordered' FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND (l_partkey = o_custkey OR l_suppkey = o_custkey)) SELECT l_orderkey, bool_or(basis = 'ordered') AS ordered, bool_or(basis = 'unordered') AS unordered FROM x GROUP BY l_orderkey")
def jn20(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    first, second = F.col("l_partkey") == F.col("o_custkey"), F.col("l_suppkey") == F.col("o_custkey")
    return j.where(first | second).groupBy("l_orderkey").agg(F.bool_or(first).alias("ordered"), F.bool_or(first | second).alias("unordered"))


@query("jn21_multiset_match", "WITH p AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS occurrence FROM lineitem), s AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS occurrence FROM lineitem WHERE l_returnflag = 'A') SELECT p.l_orderkey, p.l_linenumber, s.occurrence IS NOT NULL AS matched FROM p LEFT JOIN s USING (l_partkey, l_suppkey, occurrence)")
def jn21(spark, d):
    l = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))  # noqa: E741
    return multiset_match(l, l.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"], "at").select("l_orderkey", "l_linenumber", "matched")


FAMILY = "fam AS (SELECT 'P' || p_partkey AS node, p_brand AS family FROM part)"


@query("jn22_contamination", f"{PAIRS}, {FAMILY}, ex AS (SELECT DISTINCT least(x.family, y.family) AS fa, greatest(x.family, y.family) AS fb FROM pp JOIN fam x ON a = x.node JOIN fam y ON b = y.node WHERE in_a), q AS (SELECT a, b, least(x.family, y.family) AS fa, greatest(x.family, y.family) AS fb FROM pp JOIN fam x ON a = x.node JOIN fam y ON b = y.node WHERE NOT in_a), e AS (SELECT fa AS f FROM ex UNION SELECT fb FROM ex) SELECT q.a, q.b, ex.fa IS NOT NULL AS pair_overlap, q.fa IN (SELECT f FROM e) OR q.fb IN (SELECT f FROM e) AS endpoint_overlap FROM q LEFT JOIN ex ON q.fa = ex.fa AND q.fb = ex.fb")
def jn22(spark, d):
    fam = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_brand").alias("family"))
    side = lambda c: fam.select(F.col("node").alias(c), F.col("family").alias(f"f_{c}"))
    q = positive_pairs(spark, d).join(side("a"), "a").join(side("b"), "b").withColumns({"fa": F.least("f_a", "f_b"), "fb": F.greatest("f_a", "f_b")})
    ex = q.where("in_a").select("fa", "fb").distinct()
    ends = list_membership(ex, "f", ["fa", "fb"]).distinct()
    flag = lambda c: ends.select(F.col("f").alias(c), F.lit(True).alias(f"end_{c}"))
    out = q.where("not in_a").join(ex.withColumn("p", F.lit(True)), ["fa", "fb"], "left").join(flag("fa"), "fa", "left").join(flag("fb"), "fb", "left")
    return out.select("a", "b", F.col("p").isNotNull().alias("pair_overlap"), (F.col("end_fa").isNotNull() | F.col("end_fb").isNotNull()).alias("endpoint_overlap"))


@query("jn23_match_states", "WITH m AS (SELECT o_orderkey, count(c_custkey) AS n, count(DISTINCT c_mktsegment) AS k FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 GROUP BY ALL) SELECT o_orderkey, CASE WHEN n = 0 THEN 'absent' WHEN n = 1 THEN 'unique' WHEN k = 1 THEN 'consistent' ELSE 'conflicting' END AS state FROM m")
def jn23(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    n, k = F.count("c_custkey"), F.count_distinct("c_mktsegment")
    return j.groupBy("o_orderkey").agg(F.when(n == 0, "absent").when(n == 1, "unique").when(k == 1, "consistent").otherwise("conflicting").alias("state"))


@query("jn24_universe_counts", "SELECT p_partkey, coalesce(a, 0) AS a, coalesce(r, 0) AS r, CASE WHEN coalesce(a, 0) > 0 AND coalesce(r, 0) > 0 THEN 'both' WHEN coalesce(a, 0) > 0 THEN 'first' WHEN coalesce(r, 0) > 0 THEN 'second' ELSE 'none' END AS state FROM part LEFT JOIN (SELECT l_partkey, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) x ON p_partkey = x.l_partkey LEFT JOIN (SELECT l_partkey, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) y ON p_partkey = y.l_partkey")
def jn24(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    j = table(spark, d, "part").select("p_partkey").join(counts, "p_partkey", "left").withColumns({"a": F.coalesce("a", F.lit(0)), "r": F.coalesce("r", F.lit(0))})
    a, r = F.col("a") > 0, F.col("r") > 0
    return j.withColumn("state", F.when(a & r, "both").when(a, "first").when(r, "second").otherwise("none"))


@query("jn26_common_neighbours", f"{PAIRS}, e AS (SELECT a AS x, b AS y FROM pp UNION ALL SELECT b, a FROM pp), c AS (SELECT pp.a, pp.b, count(*) AS n FROM pp JOIN e p ON p.x = pp.a JOIN e q ON q.x = pp.b AND q.y = p.y WHERE in_a AND in_r GROUP BY ALL) SELECT pp.a, pp.b, coalesce(c.n, 0) AS common FROM pp LEFT JOIN c ON pp.a = c.a AND pp.b = c.b WHERE in_a AND in_r")
def jn26(spark, d):
    p = positive_pairs(spark, d)
    e = p.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
    asked = p.where("in_a and in_r").select("a", "b")
    c = asked.join(e.select(F.col("x").alias("a"), "y"), "a").join(e.select(F.col("x").alias("b"), "y"), ["b", "y"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return asked.join(c, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("common"))


@query("jn28_foreign_key", "SELECT count(*) AS orphans FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL")
def jn28(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query("jn29_list_orphans", "SELECT count(*) AS orphans FROM (SELECT unnest([l_partkey, l_suppkey * 7]) AS x FROM lineitem) LEFT JOIN part ON x = p_partkey WHERE p_partkey IS NULL")
def jn29(spark, d):
    x = table(spark, d, "lineitem").select(F.explode(F.array("l_partkey", F.col("l_suppkey") * 7)).alias("p_partkey"))
    return x.join(table(spark, d, "part"), "p_partkey", "left_anti").agg(F.count("*").alias("orphans"))


@query("jn30_overlap_count_check", f"WITH {EV}, {PE}, x AS (SELECT a, b, count(*) AS n FROM pe WHERE source = 'A' GROUP BY ALL), y AS (SELECT a, b, count(*) AS n FROM pe WHERE source = 'R' GROUP BY ALL) SELECT count(*) AS differing FROM x LEFT JOIN y ON x.a = y.a AND x.b = y.b WHERE x.n <> coalesce(y.n, 0)")
def jn30(spark, d):
    e = pair_evidence(spark, d)
    x, y = (e.where(F.col("source") == s).groupBy("a", "b").agg(F.count("*").alias(f"n_{s}")) for s in "AR")
    return x.join(y, ["a", "b"], "left").where(F.col("n_A") != F.coalesce("n_R", F.lit(0))).agg(F.count("*").alias("differing"))


@query("jn31_panel_enrichment", f"{GRAPH} SELECT o_orderkey, least('P' || o_custkey, 'P' || (o_orderkey % 100)) AS a, greatest('P' || o_custkey, 'P' || (o_orderkey % 100)) AS b, coalesce(pp.n, 0) AS positives, coalesce(pp.in_a, false) AS in_a, coalesce(x.degree, 0) AS da, coalesce(y.degree, 0) AS db FROM orders LEFT JOIN pp ON pp.a = least('P' || o_custkey, 'P' || (o_orderkey % 100)) AND pp.b = greatest('P' || o_custkey, 'P' || (o_orderkey % 100)) LEFT JOIN dg x ON x.node = least('P' || o_custkey, 'P' || (o_orderkey % 100)) LEFT JOIN dg y ON y.node = greatest('P' || o_custkey, 'P' || (o_orderkey % 100))")
def jn31(spark, d):
    u, v = F.concat(F.lit("P"), "o_custkey"), F.concat(F.lit("P"), F.col("o_orderkey") % 100)
    panel = table(spark, d, "orders").select("o_orderkey", F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    p = positive_pairs(spark, d)
    out = with_degrees(panel.join(p, ["a", "b"], "left"), degrees(p))
    return out.select("o_orderkey", "a", "b", F.coalesce("n", F.lit(0)).alias("positives"), F.coalesce("in_a", F.lit(False)).alias("in_a"), "da", "db")


@query("jn32_record_audit", "SELECT o_orderkey, count(l_linenumber) AS lines, count_if(l_returnflag = 'R') AS returned, list_sort(list(DISTINCT l_returnflag)) AS flags FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_linenumber) > 0")
def jn32(spark, d):
    j = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("jn34_swapped_key", "SELECT count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_suppkey AND x.l_suppkey = y.l_partkey")
def jn34(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("k"))  # noqa: E741
    swapped = l.select(F.col("l_suppkey").alias("l_partkey"), F.col("l_partkey").alias("l_suppkey"), F.col("k").alias("m"))
    return l.join(swapped, ["l_partkey", "l_suppkey"]).agg(F.coalesce(F.sum(F.col("k") * F.col("m")), F.lit(0)).alias("n"))


@query("jn35_regrouped_pairs", f"WITH {EV}, {PA} SELECT evidence_id, [arg_min(participant, ordinal), arg_max(participant, ordinal)] AS members FROM pa GROUP BY evidence_id HAVING count(*) = 2")
def jn35(spark, d):
    g = participants(spark, d).groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "participant"))).alias("m"))
    return g.where(F.size("m") == 2).select("evidence_id", F.transform("m", lambda x: x["participant"]).alias("members"))


@query("jn36_family_ids", "SELECT o_orderkey, list_sort(list(DISTINCT p_brand)) AS brands, list_sort(list(DISTINCT p_type)) AS types FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey")
def jn36(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"), F.array_sort(F.collect_set("p_type")).alias("types"))


@query("se01_union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def se01(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name")).union(table(spark, d, "supplier").select("s_name"))


@query("se02_union_by_name", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL BY NAME SELECT r_name AS name FROM region")
def se02(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name")), allowMissingColumns=True)


@query("se03_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def se03(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("se04_except_both_ways", "SELECT 'left' AS side, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'right', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def se04(spark, d):
    a, r = (table(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in "AR")
    return a.subtract(r).select(F.lit("left").alias("side"), "k").union(r.subtract(a).select(F.lit("right"), "k"))


@query("se05_multiset_difference", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def se05(spark, d):
    a, r = (table(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("k")) for f in "AR")
    return a.exceptAll(r)


@query("se06_edge_sets", f"WITH {EV}, {PE}, x AS (SELECT DISTINCT a, b FROM pe WHERE source = 'A'), y AS (SELECT DISTINCT a, b FROM pe WHERE source = 'R') SELECT CASE WHEN y.a IS NULL THEN 'not_rediscovered' WHEN x.a IS NULL THEN 'new' ELSE 'rediscovered' END AS edge_state, count(*) AS n FROM x FULL OUTER JOIN y ON x.a = y.a AND x.b = y.b GROUP BY ALL")
def se06(spark, d):
    e = pair_evidence(spark, d)
    x, y = (e.where(F.col("source") == s).select("a", "b").distinct() for s in "AR")
    s = F.col("match_state")
    state = F.when(s == "matched", "rediscovered").when(s == "view_only", "new").otherwise("not_rediscovered")
    return spine(x, y, ["a", "b"]).groupBy(state.alias("edge_state")).agg(F.count("*").alias("n"))


@query("se07_graph_union", f"WITH {EV}, {PE} SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM pe WHERE source = 'A' EXCEPT SELECT a, b FROM pe WHERE source <> 'N')) AS not_contained FROM (SELECT a, b FROM pe WHERE source = 'A' UNION SELECT a, b FROM pe WHERE source = 'R')")
def se07(spark, d):
    e = pair_evidence(spark, d)
    of = lambda c: e.where(c).select("a", "b")
    union = of("source = 'A'").union(of("source = 'R'")).distinct()
    outside = of("source = 'A'").join(of("source <> 'N'"), ["a", "b"], "left_anti").distinct().agg(F.count("*").alias("not_contained"))
    return union.agg(F.count("*").alias("edges")).crossJoin(outside)  # one row each


@query("se08_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def se08(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("se09_permissive_concat", "SELECT doc_id AS id, lang AS tag FROM documents UNION ALL SELECT page_id, CAST(NULL AS VARCHAR) FROM pages")
def se09(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tag")).unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id")), allowMissingColumns=True)


@query("wn03_duplicate_ordinal", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS INTEGER) AS occurrence FROM lineitem")
def wn03(spark, d):
    return numbered(table(spark, d, "lineitem"), ["l_partkey"], "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "occurrence")
