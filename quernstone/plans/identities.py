"""Projections, predicates, identities and scalar functions (PF-*, FN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from .registry import query
from .roles import BIN, EV, GRAPH, PAIRS, PD, STRATUM, degrees, evidence, positive_pairs, table, with_degrees

CNT = "SELECT {0}, count(*) AS n FROM {1} GROUP BY ALL"


@query("pf01_unordered_pair", f"WITH {EV} SELECT evidence_id, least(part, supp) AS a, greatest(part, supp) AS b FROM ev")
def pf01(spark, d):
    low, high = I.unordered(F.col("part"), F.col("supp"))
    return evidence(spark, d).select("evidence_id", low.alias("a"), high.alias("b"))


@query("pf02_strict_pair", "SELECT o_orderkey, CASE WHEN a <> b AND length(a) > 0 AND length(b) > 0 THEN least(a, b) END AS a, CASE WHEN a <> b AND length(a) > 0 AND length(b) > 0 THEN greatest(a, b) END AS b FROM (SELECT o_orderkey, o_orderstatus AS a, substr(o_orderpriority, 3, 1) AS b FROM orders)")
def pf02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("x"), F.substring("o_orderpriority", 3, 1).alias("y"))
    low, high = I.strict_unordered(F.col("x"), F.col("y"))
    return o.select("o_orderkey", low.alias("a"), high.alias("b"))


@query("pf03_short_id", f"WITH {EV} SELECT evidence_id, concat('ev:', substr(sha256(concat_ws('|', source, evidence_id)), 1, 32)) AS id FROM ev")
def pf03(spark, d):
    return evidence(spark, d).select("evidence_id", I.short_id("ev", F.col("source"), F.col("evidence_id")).alias("id"))


@query("pf04_pair_id", f"{PAIRS} SELECT a, b, 'pair:' || sha256(a || '|' || b) AS pair_id FROM pp")
def pf04(spark, d):
    return positive_pairs(spark, d).select("a", "b", I.pair_id(F.col("a"), F.col("b")).alias("pair_id"))


@query("pf05_framed_id", "SELECT c_custkey, 'c:' || substr(sha256(unhex(concat(lpad(to_hex(strlen(c_name)), 16, '0'), hex(c_name), lpad(to_hex(strlen(c_mktsegment)), 16, '0'), hex(c_mktsegment)))), 1, 32) AS id FROM customer")
def pf05(spark, d):
    return table(spark, d, "customer").select("c_custkey", I.framed_id("c", F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("pf06_state_classes", f"WITH {EV} SELECT CASE WHEN quantity < 10 AND discount > 0.05 THEN 'weak' WHEN quantity < 10 THEN 'low' WHEN state = 'F' THEN 'final' ELSE 'open' END AS mapping_state, count(*) AS n FROM ev GROUP BY ALL")
def pf06(spark, d):
    state = F.when((F.col("quantity") < 10) & (F.col("discount") > 0.05), "weak").when(F.col("quantity") < 10, "low").when(F.col("state") == "F", "final").otherwise("open")
    return evidence(spark, d).groupBy(state.alias("mapping_state")).agg(F.count("*").alias("n"))


@query("pf07_conditional_output", f"WITH {EV} SELECT evidence_id, CASE WHEN state = 'F' THEN part END AS usable_part FROM ev")
def pf07(spark, d):
    return evidence(spark, d).select("evidence_id", F.when(F.col("state") == "F", F.col("part")).alias("usable_part"))


@query("pf08_constant_columns", "SELECT s_suppkey, false AS label_authorized, 'v1' AS schema_version FROM supplier")
def pf08(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.lit(False).alias("label_authorized"), F.lit("v1").alias("schema_version"))


@query("pf09_null_safe_difference", "SELECT c_custkey, nullif(c_nationkey, 5) IS DISTINCT FROM nullif(c_custkey % 25, 5) AS differs FROM customer")
def pf09(spark, d):
    a, b = F.nullif(F.col("c_nationkey"), F.lit(5)), F.nullif(F.col("c_custkey") % 25, F.lit(5))
    return table(spark, d, "customer").select("c_custkey", (~a.eqNullSafe(b)).alias("differs"))


@query("pf10_empty_list_default", "SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN [lang, source] END, []::VARCHAR[]) AS items FROM documents")
def pf10(spark, d):
    items = F.when(F.col("lang") == "en", F.array("lang", "source"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(items, F.array().cast("array<string>")).alias("items"))


@query("pf11_interval_state", "SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL OR e IS NULL THEN 'incomplete' WHEN s > e THEN 'descending' ELSE 'ascending' END AS interval_state, CASE WHEN s <= e THEN e <= 2000 END AS in_bounds FROM (SELECT l_orderkey, l_linenumber, nullif(l_partkey % 50, 0) AS s, nullif(l_suppkey % 50, 0) AS e FROM lineitem)")
def pf11(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_partkey") % 50, F.lit(0)).alias("s"), F.nullif(F.col("l_suppkey") % 50, F.lit(0)).alias("e"))
    return t.select("l_orderkey", "l_linenumber", X.interval_state(F.col("s"), F.col("e")).alias("interval_state"), F.when(F.col("s") <= F.col("e"), F.col("e") <= 2000).alias("in_bounds"))


@query("pf12_gate_precedence", "SELECT CASE WHEN p_size IS NULL THEN 'missing' WHEN p_size > 40 THEN 'oversize' WHEN p_retailprice > 1500 THEN 'costly' ELSE 'eligible' END AS gate, count(*) AS n FROM part GROUP BY ALL")
def pf12(spark, d):
    gate = F.when(F.col("p_size").isNull(), "missing").when(F.col("p_size") > 40, "oversize").when(F.col("p_retailprice") > 1500, "costly").otherwise("eligible")
    return table(spark, d, "part").groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


@query("pf13_structural_validity", "SELECT count(*) AS invalid FROM lineitem WHERE l_quantity IS NULL OR NOT isfinite(l_extendedprice) OR l_quantity NOT BETWEEN 2 AND 49 OR l_discount < 0 OR l_tax > 0.07")
def pf13(spark, d):
    bad = F.col("l_quantity").isNull() | ~X.finite(F.col("l_extendedprice")) | ~F.col("l_quantity").between(2, 49) | (F.col("l_discount") < 0) | (F.col("l_tax") > 0.07)
    return table(spark, d, "lineitem").where(bad).agg(F.count("*").alias("invalid"))


@query("pf14_tolerant_threshold", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount + 1e-12 >= 0.06")
def pf14(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_discount") + 1e-12 >= 0.06).select("l_orderkey", "l_linenumber")


@query("pf15_closed_vocabulary", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY ALL")
def pf15(spark, d):
    return table(spark, d, "events").where(~F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("pf16_projection_precedence", f"WITH {EV}, m AS (SELECT evidence_id, CASE WHEN p.p_partkey IS NULL THEN 'unmapped' WHEN p.p_size > 45 THEN 'ineligible' WHEN s.s_acctbal < 0 THEN 'negative' WHEN ev.partkey = ev.suppkey THEN 'self' ELSE 'projected' END AS class FROM ev LEFT JOIN part p ON p.p_partkey = ev.partkey LEFT JOIN supplier s ON s.s_suppkey = ev.suppkey) SELECT class, count(*) AS n FROM m GROUP BY class")
def pf16(spark, d):
    e = evidence(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("partkey") == F.col("p_partkey"), "left").join(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("suppkey") == F.col("s_suppkey"), "left")
    c = F.when(F.col("p_partkey").isNull(), "unmapped").when(F.col("p_size") > 45, "ineligible").when(F.col("s_acctbal") < 0, "negative").when(F.col("partkey") == F.col("suppkey"), "self").otherwise("projected")
    return e.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("pf17_mapping_class", "SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 0 THEN 'unmapped' WHEN count(DISTINCT p_type) = 1 THEN 'unique' ELSE 'ambiguous' END AS class FROM part GROUP BY p_brand")
def pf17(spark, d):
    n = F.size(F.collect_set("p_type"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.when(n == 0, "unmapped").when(n == 1, "unique").otherwise("ambiguous").alias("class"))


ROLE = "CAST(CAST('0x' || substr(sha256(concat_ws('|', 'salt', '7', a, b)), 1, 16) AS UBIGINT) % 10000 AS INTEGER)"


@query("pf18_hash_role", f"{PAIRS} SELECT a, b, CASE WHEN r < 7000 THEN 'train' WHEN r < 8500 THEN 'development' ELSE 'test' END AS role FROM (SELECT a, b, {ROLE} AS r FROM pp)")
def pf18(spark, d):
    return positive_pairs(spark, d).select("a", "b", I.hash_role(F.col("a"), F.col("b"), "salt", "7").alias("role"))


PART_OF = "CASE WHEN CAST(CAST('0x' || substr(sha256('split' || {0}), 1, 16) AS UBIGINT) % 100 AS INTEGER) < 70 THEN 'train' WHEN CAST(CAST('0x' || substr(sha256('split' || {0}), 1, 16) AS UBIGINT) % 100 AS INTEGER) < 85 THEN 'development' ELSE 'test' END"


def partition_of(node):
    at = (I.hash_prefix(F.concat(F.lit("split"), node)) % 100).cast("int")
    return F.when(at < 70, "train").when(at < 85, "development").otherwise("test")


CELL = "CASE WHEN qa = 'train' AND qb = 'train' THEN 'C1' WHEN qa = 'train' THEN 'C2/' || qb WHEN qb = 'train' THEN 'C2/' || qa WHEN qa = qb THEN 'C3/' || qa ELSE 'quarantine' END"
CELLS = f"cells AS (SELECT *, {CELL} AS cell FROM (SELECT *, {PART_OF.format('a')} AS qa, {PART_OF.format('b')} AS qb FROM pp))"


def cell_of(a="qa", b="qb"):
    """C1: both ends in training; C2: one held-out end; C3: both held out alike; ends held out differently are quarantined."""
    qa, qb = F.col(a), F.col(b)
    return F.when((qa == "train") & (qb == "train"), "C1").when(qa == "train", F.concat(F.lit("C2/"), qb)).when(qb == "train", F.concat(F.lit("C2/"), qa)).when(qa == qb, F.concat(F.lit("C3/"), qa)).otherwise("quarantine")


def with_cells(pairs):
    return pairs.withColumns({"qa": partition_of(F.col("a")), "qb": partition_of(F.col("b"))}).withColumn("cell", cell_of())


@query("pf19_evaluation_cell", f"{PAIRS}, {CELLS} SELECT cell, count(*) AS n FROM cells GROUP BY cell")
def pf19(spark, d):
    return with_cells(positive_pairs(spark, d)).groupBy("cell").agg(F.count("*").alias("n"))


@query("pf20_role_or_quarantine", f"{PAIRS}, {CELLS} SELECT a, b, CASE WHEN cell = 'quarantine' THEN 'quarantine:crossing' WHEN n > 3 THEN 'quarantine:multiple' ELSE cell END AS state FROM cells")
def pf20(spark, d):
    state = F.when(F.col("cell") == "quarantine", "quarantine:crossing").when(F.col("n") > 3, "quarantine:multiple").otherwise(F.col("cell"))
    return with_cells(positive_pairs(spark, d)).select("a", "b", state.alias("state"))


@query("pf21_degree_bin", f"{GRAPH} SELECT {BIN.format('degree')} AS bin, count(*) AS n FROM dg GROUP BY ALL")
def pf21(spark, d):
    return degrees(positive_pairs(spark, d)).groupBy(I.degree_bin(F.col("degree")).alias("bin")).agg(F.count("*").alias("n"))


@query("pf22_degree_pair_strata", f"{GRAPH}, {PD} SELECT {STRATUM} AS stratum, count(*) AS n FROM pd GROUP BY ALL")
def pf22(spark, d):
    pairs = positive_pairs(spark, d)
    return with_degrees(pairs, degrees(pairs)).groupBy(I.degree_pair_stratum(F.col("da"), F.col("db")).alias("stratum")).agg(F.count("*").alias("n"))


@query("pf23_source_membership", f"{PAIRS} SELECT CASE WHEN in_a AND in_r THEN 'both' WHEN in_a THEN 'only_a' WHEN in_r THEN 'only_r' ELSE 'neither' END AS membership, count(*) AS n FROM pp GROUP BY ALL")
def pf23(spark, d):
    m = F.when(F.col("in_a") & F.col("in_r"), "both").when(F.col("in_a"), "only_a").when(F.col("in_r"), "only_r").otherwise("neither")
    return positive_pairs(spark, d).groupBy(m.alias("membership")).agg(F.count("*").alias("n"))


@query("pf24_opaque_token", f"{PAIRS}, {CELLS} SELECT 'candidate:' || sha256(concat_ws(':', 'pkg', cell, 'pair:' || sha256(a || '|' || b))) AS token FROM cells")
def pf24(spark, d):
    return with_cells(positive_pairs(spark, d)).select(I.opaque_token("pkg", F.col("cell"), I.pair_id(F.col("a"), F.col("b"))).alias("token"))


@query("pf25_scorer_projection", f"{PAIRS} SELECT a, b FROM pp")
def pf25(spark, d):
    return positive_pairs(spark, d).select("a", "b")


@query("pf26_tier_and_overlays", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'F' THEN 'ME-2' WHEN o_totalprice > 200000 THEN 'ME-1' ELSE 'CF' END AS tier, list_filter([CASE WHEN o_orderstatus = 'F' THEN 'CF-D' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'CF-B' END], lambda x: x IS NOT NULL) AS overlays FROM orders")
def pf26(spark, d):
    dear, closed = F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "F"
    tier = F.when(dear & closed, "ME-2").when(dear, "ME-1").otherwise("CF")
    return table(spark, d, "orders").select("o_orderkey", tier.alias("tier"), X.flags(("CF-D", closed), ("CF-B", F.col("o_orderpriority").startswith("1"))).alias("overlays"))


@query("pf27_call_semantics", "SELECT CASE WHEN value IS NULL THEN 'untested' WHEN event_type = 'purchase' THEN 'positive' WHEN value < 1 THEN 'negative' WHEN value < 5 THEN 'weak' ELSE 'invalid' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def pf27(spark, d):
    o = F.when(F.col("value").isNull(), "untested").when(F.col("event_type") == "purchase", "positive").when(F.col("value") < 1, "negative").when(F.col("value") < 5, "weak").otherwise("invalid")
    return table(spark, d, "events").groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query("pf29_outcome_dimension", "SELECT o_orderkey, d.outcome, d.attempted FROM orders LEFT JOIN (VALUES ('F', 'positive', true), ('O', 'negative', true), ('P', 'untested', false)) AS d(code, outcome, attempted) ON o_orderstatus = d.code")
def pf29(spark, d):
    dim = spark.createDataFrame([("F", "positive", True), ("O", "negative", True), ("P", "untested", False)], "code string, outcome string, attempted boolean")
    return table(spark, d, "orders").join(F.broadcast(dim), F.col("o_orderstatus") == F.col("code"), "left").select("o_orderkey", "outcome", "attempted")


@query("pf30_token_map", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'returned' WHEN 'N' THEN 'none' END AS assay_state, count(*) AS n FROM lineitem GROUP BY ALL")
def pf30(spark, d):
    m = F.create_map(*[F.lit(x) for x in ("A", "active", "R", "returned", "N", "none")])
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("assay_state", F.element_at(m, F.col("l_returnflag")))


@query("pf31_interaction_semantics", "SELECT conv_id, CASE WHEN count(*) = 1 THEN 'self' WHEN count(*) = 2 THEN 'physical' WHEN bool_or(role = 'system') THEN 'guided' ELSE 'association' END AS semantics FROM conversations GROUP BY conv_id")
def pf31(spark, d):
    n = F.count("*")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.when(n == 1, "self").when(n == 2, "physical").when(F.bool_or(F.col("role") == "system"), "guided").otherwise("association").alias("semantics"))


@query("pf32_assay_family", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'e') THEN 'other_e' ELSE 'other' END AS family FROM part")
def pf32(spark, d):
    t = F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(t.contains("brass"), "brass").when(t.contains("steel"), "steel").when(t.contains("e"), "other_e").otherwise("other").alias("family"))


@query("pf33_cardinality", "SELECT conv_id, CAST(count(*) AS INTEGER) AS participant_count, count(*) > 2 AS original_nary, CASE WHEN count(*) = 1 THEN 'unary' WHEN count(*) = 2 THEN 'binary' ELSE 'n-ary' END AS kind FROM conversations GROUP BY conv_id")
def pf33(spark, d):
    n = F.count("*")
    return table(spark, d, "conversations").groupBy("conv_id").agg(n.cast("int").alias("participant_count"), (n > 2).alias("original_nary"), F.when(n == 1, "unary").when(n == 2, "binary").otherwise("n-ary").alias("kind"))


@query("pf34_support_floor", f"{PAIRS}, {CELLS} SELECT cell, CASE WHEN count(*) >= 100 AND count(DISTINCT a) >= 10 THEN 'quantitative' ELSE 'descriptive' END AS status FROM cells GROUP BY cell")
def pf34(spark, d):
    status = F.when((F.count("*") >= 100) & (F.count_distinct("a") >= 10), "quantitative").otherwise("descriptive")
    return with_cells(positive_pairs(spark, d)).groupBy("cell").agg(status.alias("status"))


HELD = "(SELECT p_brand FROM (SELECT p_brand, sum(n) OVER (ORDER BY sha256('held' || p_brand), p_brand) - n AS before, sum(n) OVER () AS total FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)) WHERE before < 0.15 * total)"


def heldout_brands(spark, d):
    """WN-09: groups in hash order until 15 % of the members are reached."""
    from pyspark.sql import Window as W

    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit("held"), "p_brand"), 256))
    before = F.sum("n").over(W.orderBy("h", "p_brand").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return n.withColumns({"before": before, "total": F.sum("n").over(W.partitionBy())}).where(F.col("before") < 0.15 * F.col("total")).select("p_brand")


@query("wn09_running_prefix", HELD[1:-1])
def wn09(spark, d):
    return heldout_brands(spark, d)


@query("pf35_nested_cell", f"{PAIRS}, k AS (SELECT 'P' || p_partkey AS node, p_brand IN {HELD} AS held FROM part) SELECT CASE WHEN x.held AND y.held THEN 'C3' WHEN x.held OR y.held THEN 'C2' ELSE 'C1' END AS nested_cell, count(*) AS n FROM pp JOIN k x ON a = x.node JOIN k y ON b = y.node GROUP BY ALL")
def pf35(spark, d):
    held = heldout_brands(spark, d).withColumn("h", F.lit(True))
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), "p_brand").join(F.broadcast(held), "p_brand", "left").select("node", F.coalesce("h", F.lit(False)).alias("held"))
    j = positive_pairs(spark, d).join(nodes.select(F.col("node").alias("a"), F.col("held").alias("ha")), "a").join(nodes.select(F.col("node").alias("b"), F.col("held").alias("hb")), "b")
    return j.groupBy(F.when(F.col("ha") & F.col("hb"), "C3").when(F.col("ha") | F.col("hb"), "C2").otherwise("C1").alias("nested_cell")).agg(F.count("*").alias("n"))


@query("fn01_03_identifiers", "SELECT page_id, split_part(x, '.', 1) AS base, regexp_replace(x, '\\.\\d+$', '') AS versionless, CASE WHEN ends_with(x, '-1') THEN left(x, length(x) - 2) END AS isoform_base FROM (SELECT page_id, concat('A', page_id, CASE page_id % 4 WHEN 0 THEN '.3' WHEN 1 THEN '.1.2' WHEN 2 THEN '-1' ELSE '' END) AS x FROM pages)")
def fn01(spark, d):
    k = F.col("page_id") % 4
    x = F.concat(F.lit("A"), "page_id", F.when(k == 0, ".3").when(k == 1, ".1.2").when(k == 2, "-1").otherwise(""))
    t = table(spark, d, "pages").select("page_id", x.alias("x"))
    return t.select("page_id", X.before_dot(F.col("x")).alias("base"), X.without_version(F.col("x")).alias("versionless"), X.isoform_base(F.col("x")).alias("isoform_base"))


@query("fn04_06_digest_and_length", "SELECT doc_id, sha256(text) AS digest, CAST(length(text) AS INTEGER) AS chars, length(text) = n_chars AS length_agrees, concat_ws('', lang, NULL, source) AS skipping, lang || '/' || source AS joined FROM documents")
def fn04(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"), (F.length("text") == F.col("n_chars")).alias("length_agrees"), F.concat_ws("", "lang", F.lit(None).cast("string"), "source").alias("skipping"), F.concat("lang", F.lit("/"), "source").alias("joined"))


@query("fn07_09_fields", "SELECT event_id, CAST(len(string_split(props, ',')) AS INTEGER) AS mentions, TRY_CAST(nullif(event_type, '') AS DOUBLE) AS number, props->>'$.k' AS k FROM events")
def fn07(spark, d):
    return table(spark, d, "events").select("event_id", F.size(F.split("props", ",")).alias("mentions"), X.safe_number(F.col("event_type")).alias("number"), F.get_json_object("props", "$.k").alias("k"))


@query("fn10_11_json", "SELECT n_nationkey, CAST(to_json({'a': n_name, 'b': nullif(n_regionkey, 1)}) AS VARCHAR) AS j FROM nation")
def fn10(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.canonical_json(F.col("n_name").alias("a"), F.nullif(F.col("n_regionkey"), F.lit(1)).alias("b")).alias("j"))


@query("fn12_14_lists", "SELECT p_partkey, list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: upper(x)))) AS words, list_contains(string_split(p_name, ' '), 'red') AS has, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, string_split(p_name, ' ')[1] AS first_item FROM part")
def fn12(spark, d):
    l = F.split("p_name", " ")  # noqa: E741
    return table(spark, d, "part").select("p_partkey", X.sorted_set(F.transform(l, lambda x: F.upper(x))).alias("words"), F.array_contains(l, "red").alias("has"), F.size(l).alias("n"), F.element_at(l, 1).alias("first_item"))


@query("fn15_16_identity_and_coverage", "SELECT l_orderkey, l_linenumber, round((greatest(l_quantity, 10) + least(l_quantity, 10) - abs(l_quantity - 10)) / (l_quantity + 10), 9) AS identity, (abs(l_suppkey - l_partkey) + 1) / CAST(greatest(l_partkey, l_suppkey) AS DOUBLE) AS coverage FROM lineitem")
def fn15(spark, d):
    q = F.col("l_quantity")
    ident = F.round((F.greatest(q, F.lit(10)) + F.least(q, F.lit(10)) - F.abs(q - 10)) / (q + 10), 9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ident.alias("identity"), ((F.abs(F.col("l_suppkey") - F.col("l_partkey")) + 1) / F.greatest("l_partkey", "l_suppkey").cast("double")).alias("coverage"))


@query("fn17_20_source_fields", "SELECT nullif(regexp_extract(x, '(MI:\\d+)\"?\\((.*)\\)$', 1), '') AS acc, nullif(regexp_extract(x, '(MI:\\d+)\"?\\((.*)\\)$', 2), '') AS name, list_filter(list_transform(string_split(y, '|'), lambda i: trim(i)), lambda i: i <> '' AND i <> '-') AS items, TRY_CAST(regexp_extract(z, ':([^:-]*)-([^:-]*)$', 1) AS BIGINT) AS lo, TRY_CAST(regexp_extract(z, ':([^:-]*)-([^:-]*)$', 2) AS BIGINT) AS hi FROM (SELECT concat('psi-mi:\"MI:', lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), '\"(', s_name, ')') AS x, concat(s_name, '| -|-|', s_suppkey) AS y, concat('tag:', s_nationkey, '-', CASE WHEN s_nationkey % 3 = 0 THEN '?' ELSE CAST(s_suppkey AS VARCHAR) END) AS z FROM supplier)")
def fn17(spark, d):
    t = table(spark, d, "supplier").select(F.concat(F.lit('psi-mi:"MI:'), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit('"('), "s_name", F.lit(")")).alias("x"), F.concat("s_name", F.lit("| -|-|"), "s_suppkey").alias("y"), F.concat(F.lit("tag:"), "s_nationkey", F.lit("-"), F.when(F.col("s_nationkey") % 3 == 0, "?").otherwise(F.col("s_suppkey").cast("string"))).alias("z"))
    acc, name = X.term(F.col("x"))
    lo, hi = X.feature_range(F.col("z"))
    return t.select(acc.alias("acc"), name.alias("name"), X.pipe_list(F.col("y")).alias("items"), lo.alias("lo"), hi.alias("hi"))


@query("fn21_23_tokens", "SELECT n_nationkey, CASE WHEN lower(trim(x)) IN ('1','true','yes','y') THEN true WHEN lower(trim(x)) IN ('0','false','no','n') THEN false END AS flag, CAST(CASE WHEN y IN ('', 'None', '-') THEN NULL ELSE y END AS DOUBLE) AS num, regexp_replace(z, '\\.0$', '') AS orf FROM (SELECT n_nationkey, [' Yes', 'no', '', '1', 'FALSE'][n_nationkey % 5 + 1] AS x, ['-', '1.5', 'None', '', '7'][n_nationkey % 5 + 1] AS y, concat(n_nationkey, '.0') AS z FROM nation)")
def fn21(spark, d):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", X.tri_state(pick(" Yes", "no", "", "1", "FALSE")).alias("flag"), X.optional_number(pick("-", "1.5", "None", "", "7")).alias("num"), F.regexp_replace(F.concat("n_nationkey", F.lit(".0")), r"\.0$", "").alias("orf"))


@query("fn24_translation", "SELECT s_suppkey, concat('M', ['K', 'A', 'W', 'R'][s_suppkey % 4 + 1], ['K', 'A', 'W', 'R'][(s_suppkey + 1) % 4 + 1], ['K', 'A', 'W', 'R'][(s_suppkey + 5) % 4 + 1]) AS protein FROM supplier")
def fn24(spark, d):
    """Proteins of coding sequences spelled from the suppliers' keys, ATG first and a stop last."""
    codon = lambda i: F.element_at(F.array(*map(F.lit, ("AAA", "GCT", "TGG", "CGA"))), ((F.col("s_suppkey") + i) % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", X.translate_cds(F.concat(F.lit("ATG"), codon(0), codon(1), codon(5), F.lit("TAA"))).alias("protein"))


@query("fn25_26_sequence_checks", "SELECT doc_id, sha256(upper(trim(source))) AS digest, list_sort(list_filter(list_distinct(string_split(translate(upper(lang || source), '0123456789', ''), '')), lambda c: NOT contains('ACDEFGHIKLMNPQRSTVWY', c))) AS nonstandard FROM documents")
def fn25(spark, d):
    letters = F.split(F.translate(F.upper(F.concat("lang", "source")), "0123456789", ""), "")
    odd = F.array_sort(F.filter(F.array_distinct(letters), lambda c: ~F.contains(F.lit("ACDEFGHIKLMNPQRSTVWY"), c)))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.upper(F.trim("source")), 256).alias("digest"), odd.alias("nonstandard"))


@query("fn27_28_features", f"{GRAPH}, {PD} SELECT a, b, round(ln(1 + da + db), 9) AS degree_sum, round(ln(1 + da * db), 9) AS attachment, round(CAST(CAST('0x' || substr(sha256(a || '|' || b), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370495, 9) AS hash_score FROM pd")
def fn27(spark, d):
    pairs = positive_pairs(spark, d)
    p = with_degrees(pairs, degrees(pairs))
    return p.select("a", "b", F.round(F.log1p(F.col("da") + F.col("db")), 9).alias("degree_sum"), F.round(F.log1p(F.col("da") * F.col("db")), 9).alias("attachment"), F.round(I.hash_score(F.concat("a", F.lit("|"), "b")), 9).alias("hash_score"))


@query("fn29_30_kmer_cosine", "WITH k AS (SELECT p_brand AS id, g, count(*) AS n FROM (SELECT p_brand, unnest([substr(p_name, i, 3) FOR i IN range(1, length(p_name) - 1)]) AS g FROM part) GROUP BY ALL), s AS (SELECT id, sqrt(sum(n * n)) AS norm FROM k GROUP BY id) SELECT x.id AS a, y.id AS b, round(sum(x.n * y.n) / any_value(sx.norm * sy.norm), 9) AS cosine FROM k x JOIN k y ON x.g = y.g AND x.id < y.id JOIN s sx ON sx.id = x.id JOIN s sy ON sy.id = y.id GROUP BY x.id, y.id")
def fn29(spark, d):
    k = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.explode(X.ngrams(F.col("p_name"))).alias("g")).groupBy("id", "g").agg(F.count("*").alias("n"))
    norm = k.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    k = k.join(norm, "id")
    x, y = k.select(F.col("id").alias("a"), "g", F.col("n").alias("na"), F.col("norm").alias("sa")), k.select(F.col("id").alias("b"), "g", F.col("n").alias("nb"), F.col("norm").alias("sb"))
    j = x.join(y, "g").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"), F.any_value(F.col("sa") * F.col("sb")).alias("s"))
    return j.select("a", "b", F.round(F.col("dot") / F.col("s"), 9).alias("cosine"))


@query("fn31_cosine_features", "SELECT x.vec_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 6) AS cosine, round(list_sum([abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE) FOR i IN range(1, len(x.embedding) + 1)]), 6) AS abs_diff FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def fn31(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    return j.select("vec_id", F.round(dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))), 6).alias("cosine"), F.round(total(F.zip_with("x", "y", lambda p, q: F.abs(p - q))), 6).alias("abs_diff"))


@query("fn34_36_exact_numbers", "SELECT l_orderkey, l_linenumber, CAST((2 * CAST(l_partkey AS HUGEINT) * 1000000000 + l_partkey + l_suppkey) // (2 * (l_partkey + l_suppkey)) AS BIGINT) AS ratio, CAST(round(CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(10, 4)) * 0.5, 3) AS DECIMAL(10, 3)) AS half_up, CAST(l_partkey * (l_partkey - 1) // 2 AS BIGINT) AS pairs FROM lineitem")
def fn34(spark, d):
    ratio = F.expr("cast((cast(2 as decimal(38,0)) * l_partkey * 1000000000 + l_partkey + l_suppkey) div (2 * (l_partkey + l_suppkey)) as bigint)")
    half = F.round(F.col("l_discount").cast("string").cast("decimal(10,4)") * F.lit("0.5").cast("decimal(2,1)"), 3).cast("decimal(10,3)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"), half.alias("half_up"), I.choose_two(F.col("l_partkey")).alias("pairs"))


@query("fn37_log_ratio", "SELECT l_orderkey, l_linenumber, round(log2(l_quantity / greatest(l_discount, l_tax + 0.01)), 9) AS log_ratio FROM lineitem")
def fn37(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.log2(F.col("l_quantity") / F.greatest(F.col("l_discount"), F.col("l_tax") + 0.01)), 9).alias("log_ratio"))


@query("fn39_accessions", "SELECT s_suppkey, regexp_extract(x, '^([^-]+)', 1) AS accession, nullif(regexp_extract(x, '-(\\d+)$', 1), '') AS isoform FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('Q', s_suppkey, '-', s_nationkey) ELSE concat('Q', s_suppkey) END AS x FROM supplier)")
def fn39(spark, d):
    x = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Q"), "s_suppkey", F.lit("-"), "s_nationkey")).otherwise(F.concat(F.lit("Q"), "s_suppkey"))
    acc, iso = X.accession_and_isoform(F.col("x"))
    return table(spark, d, "supplier").select("s_suppkey", x.alias("x")).select("s_suppkey", acc.alias("accession"), iso.alias("isoform"))


@query("fn40_seeds", "SELECT o_orderkey, CAST(CAST('0x' || substr(sha256(concat_ws(':', '20260803', 'bootstrap', o_orderkey)), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM orders")
def fn40(spark, d):
    """A 64-bit seed for every order from its key; text, as longs have a sign."""
    return table(spark, d, "orders").select("o_orderkey", I.seed_u64(F.lit("20260803"), F.lit("bootstrap"), F.col("o_orderkey")).cast("string").alias("seed"))
