"""Reconciliation relations, pair artifacts, scorers and evaluation (AL-14..48)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from ..operators import metrics as M
from ..operators.durable import durable, released
from ..operators.geometry import candidate_counts
from ..operators.graph import hubs
from ..operators.reconcile import spine
from .identities import CELLS, with_cells
from .registry import query
from .roles import EV, GRAPH, PA, PAIRS, PD, PE, degrees, participants, positive_pairs, table, with_degrees


@query("al14_candidate_geometry", "WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), pos AS (SELECT DISTINCT least(x.l_suppkey, y.l_suppkey) AS a, greatest(x.l_suppkey, y.l_suppkey) AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey) SELECT x.s_nationkey = y.s_nationkey AS same_nation, count(*) AS candidates FROM s x JOIN s y ON x.s_suppkey < y.s_suppkey WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.a = x.s_suppkey AND pos.b = y.s_suppkey) GROUP BY ALL")
def al14(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()  # noqa: E741
    pos = l.join(l.withColumnRenamed("l_suppkey", "other"), "l_orderkey").where("l_suppkey < other").select(F.col("l_suppkey").alias("a"), F.col("other").alias("b")).distinct()
    return candidate_counts(s, "s_suppkey", "s_nationkey", pos).withColumnRenamed("same", "same_nation")


@query("al17_role_ledger", f"{PAIRS}, {CELLS} SELECT a, b, 'pair:' || sha256(a || '|' || b) AS pair_id, cell, CASE WHEN cell = 'quarantine' THEN 'quarantine' WHEN cell = 'C1' THEN 'training' ELSE 'evaluation' END AS role FROM cells")
def al17(spark, d):
    cell = F.col("cell")
    role = F.when(cell == "quarantine", "quarantine").when(cell == "C1", "training").otherwise("evaluation")
    return with_cells(positive_pairs(spark, d)).select("a", "b", I.pair_id(F.col("a"), F.col("b")).alias("pair_id"), "cell", role.alias("role"))


@query("al18_source_exclusive", f"{PAIRS}, {CELLS} SELECT cell, count_if(in_a AND NOT in_r) AS only_a, count_if(in_r AND NOT in_a) AS only_r FROM cells GROUP BY cell")
def al18(spark, d):
    return with_cells(positive_pairs(spark, d)).groupBy("cell").agg(F.count_if(F.col("in_a") & ~F.col("in_r")).alias("only_a"), F.count_if(F.col("in_r") & ~F.col("in_a")).alias("only_r"))


SCORED = "t AS (SELECT l_linestatus AS cell, l_discount AS score, l_returnflag = 'R' AS pos, l_quantity AS w FROM lineitem), g AS (SELECT cell, score, sum(CASE WHEN pos THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS u FROM t GROUP BY ALL)"


def scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("cell"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("pos"), F.col("l_quantity").alias("w"))


@query("al19_weighted_concordance", f"WITH {SCORED}, c AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT cell, round(sum(p * (below + u / 2)) / (sum(p) * sum(u)), 9) AS concordance FROM c GROUP BY cell")
def al19(spark, d):
    return M.concordance(scored(spark, d), ["cell"], "score", F.col("pos"), F.col("w")).withColumn("concordance", F.round("concordance", 9))


@query("al20_average_precision", f"WITH {SCORED}, c AS (SELECT *, sum(p) OVER w AS cp, sum(u) OVER w AS cu FROM g WINDOW w AS (PARTITION BY cell ORDER BY score DESC)) SELECT cell, round(sum(p * cp / (cp + cu)) / sum(p), 9) AS average_precision FROM c GROUP BY cell")
def al20(spark, d):
    return M.average_precision(scored(spark, d), ["cell"], "score", F.col("pos"), F.col("w")).withColumn("average_precision", F.round("average_precision", 9))


UNPIVOT = "t AS (SELECT l_linestatus AS cell, unnest([{'s': 'discount', 'x': l_discount}, {'s': 'tax', 'x': l_tax}, {'s': 'quantity', 'x': l_quantity}], recursive := true), l_returnflag = 'R' AS pos, 1.0::DOUBLE AS w FROM lineitem), g AS (SELECT cell, s AS scorer, x AS score, sum(CASE WHEN pos THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS u FROM t GROUP BY ALL)"


@query("al23_point_metrics", f"WITH {UNPIVOT}, c AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell, scorer ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT cell, scorer, round(sum(p * (below + u / 2)) / (sum(p) * sum(u)), 9) AS concordance FROM c GROUP BY cell, scorer")
def al23(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("cell"), (F.col("l_returnflag") == "R").alias("pos"), F.expr("stack(3, 'discount', l_discount, 'tax', l_tax, 'quantity', l_quantity) as (scorer, score)"))
    return M.concordance(t, ["cell", "scorer"], "score", F.col("pos"), F.lit(1.0)).withColumn("concordance", F.round("concordance", 9))


@query("al24_hub_diagnostics", f"{GRAPH}, h AS (SELECT node FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS r, count(*) OVER () AS n FROM dg) WHERE r <= ceil(0.05 * n)) SELECT a IN (SELECT node FROM h) OR b IN (SELECT node FROM h) AS hub, count(*) AS pairs, round(avg(n), 9) AS reports FROM pp GROUP BY ALL")
def al24(spark, d):
    p = positive_pairs(spark, d)
    top = hubs(degrees(p), 5).select("node", F.lit(True).alias("h"))
    j = p.join(top.toDF("a", "ha"), "a", "left").join(top.toDF("b", "hb"), "b", "left")
    return j.groupBy((F.col("ha").isNotNull() | F.col("hb").isNotNull()).alias("hub")).agg(F.count("*").alias("pairs"), F.round(F.avg("n"), 9).alias("reports"))


@query("al25_novel_only", "SELECT count(*) AS novel FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O') x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_linestatus = 'F' AND x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey)")
def al25(spark, d):
    of = lambda s: table(spark, d, "lineitem").where(F.col("l_linestatus") == s).select("l_partkey", "l_suppkey").distinct()
    return of("O").join(of("F"), ["l_partkey", "l_suppkey"], "left_anti").agg(F.count("*").alias("novel"))


@query("al26_selection", f"WITH {UNPIVOT}, c AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell, scorer ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g), m AS (SELECT cell, scorer, sum(p * (below + u / 2)) / (sum(p) * sum(u)) AS k FROM c GROUP BY cell, scorer), z AS (SELECT scorer, round(CAST(min(k) AS DECIMAL(18, 9)), 3) AS worst FROM m GROUP BY scorer) SELECT scorer, CAST(worst AS DOUBLE) AS worst, worst < 0.45 AS killed FROM z ORDER BY worst DESC, scorer LIMIT 1")
def al26(spark, d):
    m = al23(spark, d).groupBy("scorer").agg(F.round(F.min("concordance").cast("decimal(18,9)"), 3).alias("worst"))
    return m.orderBy(F.desc("worst"), "scorer").limit(1).select("scorer", F.col("worst").cast("double").alias("worst"), (F.col("worst") < 0.45).alias("killed"))


@query("al27_deterministic_scorers", f"{GRAPH}, {PD}, m AS (SELECT pd.*, x.p_retailprice AS ma, y.p_retailprice AS mb FROM pd JOIN part x ON a = 'P' || x.p_partkey JOIN part y ON b = 'P' || y.p_partkey) SELECT a, b, round(ln(1 + da + db), 9) AS degree_sum, round(ln(1 + da * db), 9) AS attachment, round(ln(1 + ma * mb), 9) AS mass_product, round(abs(ln(ma / mb)), 9) AS mass_ratio FROM m")
def al27(spark, d):
    p = positive_pairs(spark, d)
    mass = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), "p_retailprice")
    j = with_degrees(p, degrees(p)).join(mass.toDF("a", "ma"), "a").join(mass.toDF("b", "mb"), "b")
    log = lambda x: F.round(F.log1p(x), 9)
    return j.select("a", "b", log(F.col("da") + F.col("db")).alias("degree_sum"), log(F.col("da") * F.col("db")).alias("attachment"), log(F.col("ma") * F.col("mb")).alias("mass_product"), F.round(F.abs(F.log(F.col("ma") / F.col("mb"))), 9).alias("mass_ratio"))


@query("al28_prediction_checks", "SELECT count(*) AS rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated, count_if(NOT isfinite(l_discount)) AS unusable, count_if(o_orderkey IS NULL) AS unknown FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def al28(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct(F.struct("l_orderkey", "l_linenumber"))).alias("repeated"), F.count_if(~X.finite(F.col("l_discount"))).alias("unusable"), F.count_if(F.col("o_orderkey").isNull()).alias("unknown"))


@query("al29_token_evaluation", f"{PAIRS}, {CELLS}, c AS (SELECT 'candidate:' || sha256(concat_ws(':', 'pkg', cell, 'pair:' || sha256(a || '|' || b))) AS token, cell FROM cells), s AS (SELECT 'candidate:' || sha256(concat_ws(':', 'pkg', cell, 'pair:' || sha256(a || '|' || b))) AS token, n AS score, in_a FROM cells), g AS (SELECT cell, CAST(score AS DOUBLE) AS score, sum(CASE WHEN in_a THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN in_a THEN 0 ELSE 1.0::DOUBLE END) AS u FROM c JOIN s USING (token) GROUP BY ALL), k AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT cell, round(sum(p * (below + u / 2)) / (sum(p) * sum(u)), 9) AS concordance FROM k GROUP BY cell")
def al29(spark, d):
    c = durable(with_cells(positive_pairs(spark, d)).select("a", "b", "cell", "n", "in_a"), "tokens")  # both sides read it: the pairs are found once
    released(spark)
    # Tokens have one prefix: their digests' 32 bytes are what the sides meet by.
    c = c.withColumn("token", F.unhex(F.split_part(I.opaque_token("pkg", F.col("cell"), I.pair_id(F.col("a"), F.col("b"))), F.lit(":"), F.lit(2))))
    truth, predictions = c.select("token", "cell", "in_a"), c.select("token", F.col("n").cast("double").alias("score"))
    return M.concordance(truth.join(predictions, "token"), ["cell"], "score", F.col("in_a"), F.lit(1.0)).withColumn("concordance", F.round("concordance", 9))


@query("al33_standardisation", "SELECT i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM (SELECT unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY i")
def al33(spark, d):
    x = table(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return x.groupBy(F.col("i").cast("long").alias("i")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))


@query("al35_summary_reconciliation", f"WITH {EV}, {PE}, x AS (SELECT a, b, count(*) AS detailed FROM pe WHERE source <> 'R' GROUP BY ALL), y AS (SELECT DISTINCT a, b, true AS viewed FROM pe WHERE source <> 'A') SELECT CASE WHEN viewed IS NULL THEN 'detailed_only' WHEN detailed IS NULL THEN 'view_only' ELSE 'matched' END AS match_state, count(*) AS pairs, CAST(coalesce(sum(detailed), 0) AS BIGINT) AS reports FROM x FULL OUTER JOIN y USING (a, b) GROUP BY ALL")
def al35(spark, d):
    from .roles import pair_evidence

    e = pair_evidence(spark, d)
    s = spine(e.where("source <> 'R'").groupBy("a", "b").agg(F.count("*").alias("detailed")), e.where("source <> 'A'").select("a", "b").distinct(), ["a", "b"])
    return s.groupBy("match_state").agg(F.count("*").alias("pairs"), F.coalesce(F.sum("detailed"), F.lit(0)).alias("reports"))


@query("al36_participant_mapping", f"WITH {EV}, {PA} SELECT evidence_id, ordinal, participant, CASE WHEN ordinal = 2 THEN 'not_applicable' WHEN p_partkey IS NULL THEN 'unmapped' WHEN p_size > 25 THEN 'canonical_projection_only' ELSE 'direct_unique' END AS mapping_state, CASE WHEN ordinal = 1 AND p_size <= 25 THEN p_brand END AS mapped_to FROM pa LEFT JOIN part ON ordinal = 1 AND participant = 'P' || p_partkey")
def al36(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("pp"), "p_partkey", "p_size", "p_brand")
    j = participants(spark, d).join(part, (F.col("ordinal") == 1) & (F.col("participant") == F.col("pp")), "left")
    state = F.when(F.col("ordinal") == 2, "not_applicable").when(F.col("p_partkey").isNull(), "unmapped").when(F.col("p_size") > 25, "canonical_projection_only").otherwise("direct_unique")
    return j.select("evidence_id", "ordinal", "participant", state.alias("mapping_state"), F.when((F.col("ordinal") == 1) & (F.col("p_size") <= 25), F.col("p_brand")).alias("mapped_to"))


@query("al37_evidence_mapping", f"WITH {EV}, {PA}, m AS (SELECT evidence_id, count(*) AS members, max(CASE WHEN ordinal = 1 THEN participant END) AS m1, max(CASE WHEN ordinal = 2 THEN participant END) AS m2 FROM pa GROUP BY ALL) SELECT evidence_id, members, 'ordered:' || substr(sha256(concat_ws('|', m1, m2)), 1, 32) AS ordered_id, 'unordered:' || substr(sha256(concat_ws('|', least(m1, m2), greatest(m1, m2))), 1, 32) AS unordered_id FROM m")
def al37(spark, d):
    at = lambda k: F.max(F.when(F.col("ordinal") == k, F.col("participant")))
    m = participants(spark, d).groupBy("evidence_id").agg(F.count("*").alias("members"), at(1).alias("m1"), at(2).alias("m2"))
    low, high = I.unordered(F.col("m1"), F.col("m2"))
    return m.select("evidence_id", "members", I.short_id("ordered", F.col("m1"), F.col("m2")).alias("ordered_id"), I.short_id("unordered", low, high).alias("unordered_id"))


@query("al38_interval_audit", "SELECT CASE WHEN s IS NULL OR e IS NULL THEN 'incomplete' WHEN s > e THEN 'descending' ELSE 'ascending' END AS interval_state, r.p_partkey IS NULL AS orphan, count(*) AS n FROM (SELECT l_partkey, nullif(l_partkey % 50, 0) AS s, nullif(l_suppkey % 50, 0) AS e FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) r ON l_partkey = p_partkey GROUP BY ALL")
def al38(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", F.nullif(F.col("l_partkey") % 50, F.lit(0)).alias("s"), F.nullif(F.col("l_suppkey") % 50, F.lit(0)).alias("e"))  # noqa: E741
    j = l.join(table(spark, d, "part").where("p_size > 10").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy(X.interval_state(F.col("s"), F.col("e")).alias("interval_state"), F.col("p_partkey").isNull().alias("orphan")).agg(F.count("*").alias("n"))


@query("al39_eligibility", "SELECT sha256(text) AS h, min(doc_id) AS representative, count(*) AS members, CASE WHEN count(DISTINCT lang) > 1 THEN 'ambiguous' WHEN min(n_chars) < 200 THEN 'too_short' ELSE 'eligible' END AS state FROM documents GROUP BY ALL")
def al39(spark, d):
    state = F.when(F.count_distinct("lang") > 1, "ambiguous").when(F.min("n_chars") < 200, "too_short").otherwise("eligible")
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("representative"), F.count("*").alias("members"), state.alias("state"))


@query("al43_artifact_rows", f"{GRAPH}, {PD} SELECT 'pair:' || sha256(a || '|' || b) AS pair_id, sha256(a) AS endpoint_a, sha256(b) AS endpoint_b, da, db, false AS label_authorized FROM pd WHERE in_a")
def al43(spark, d):
    p = positive_pairs(spark, d)
    return with_degrees(p, degrees(p)).where("in_a").select(I.pair_id(F.col("a"), F.col("b")).alias("pair_id"), F.sha2("a", 256).alias("endpoint_a"), F.sha2("b", 256).alias("endpoint_b"), "da", "db", F.lit(False).alias("label_authorized"))


@query("al48_positive_loading", "SELECT least(x.p_brand, y.p_brand) AS a, greatest(x.p_brand, y.p_brand) AS b, bool_or(l1.l_returnflag = 'A') AS from_a, bool_or(l1.l_returnflag = 'R') AS from_r FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l1.l_linenumber < l2.l_linenumber JOIN part x ON l1.l_partkey = x.p_partkey JOIN part y ON l2.l_partkey = y.p_partkey WHERE x.p_brand <> y.p_brand GROUP BY ALL")
def al48(spark, d):
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    l = table(spark, d, "lineitem").join(brand, "l_partkey").select("l_orderkey", "l_linenumber", "l_returnflag", "p_brand")  # noqa: E741
    j = l.join(l.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("p_brand").alias("other")), "l_orderkey").where("l_linenumber < n2 and p_brand <> other")
    return j.groupBy(F.least("p_brand", "other").alias("a"), F.greatest("p_brand", "other").alias("b")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("from_a"), F.bool_or(F.col("l_returnflag") == "R").alias("from_r"))
