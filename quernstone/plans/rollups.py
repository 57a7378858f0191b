"""Roll-ups of evidence, pools, leakage and designs to summary tables (AG-40, AG-49 to AG-56, PF-28, AL-34, QC-09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.identity import degree_bin
from ..operators import metrics as M
from ..operators import segments as S
from ..operators.durable import durable
from .identities import CELLS, PART_OF, partition_of, with_cells
from .registry import query
from .roles import BIN, EV, PAIRS, PE, degrees, evidence, pair_evidence, positive_pairs, table

TOKENS = ("0", "1", "0.0", "1.0", "AA", "", "nan", "1")


@query("pf28_reported_outcome", """WITH t AS (SELECT l_orderkey, l_linenumber, ['0', '1', '0.0', '1.0', 'AA', '', 'nan', '1'][l_partkey % 8 + 1] AS score,
  ['1', '0', NULL, 'True'][l_suppkey % 4 + 1] AS first_check, ['0', '1', 'nan', 'False'][l_linenumber % 4 + 1] AS second_check FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN score = 'AA' THEN 'Autoactivator' WHEN score IN ('', 'nan') THEN 'Test failed'
  WHEN score IN ('0', '0.0') THEN CASE WHEN second_check IN ('1', '1.0', 'True', 'true') THEN 'Negative' ELSE 'Failed sequence confirmation' END
  ELSE CASE WHEN first_check IN ('1', '1.0', 'True', 'true') THEN 'Positive' ELSE 'Failed sequence confirmation' END END AS outcome FROM t""")
def pf28(spark, d):
    """A raw score and two sequence confirmations to the outcome that is reported."""
    pick = lambda column, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(column) % len(v) + 1).cast("int"))
    outcome = X.reported_outcome(pick("l_partkey", *TOKENS), pick("l_suppkey", "1", "0", None, "True"), pick("l_linenumber", "0", "1", "nan", "False"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


@query("ag40_rollup_document", f"""WITH {EV}, a AS (SELECT source, count(*) AS n, count_if(quantity >= 10) AS usable FROM ev GROUP BY ALL)
SELECT CAST(to_json(struct_pack(sources := count(*), rows := CAST(sum(n) AS BIGINT), usable := CAST(sum(usable) AS BIGINT), feasible := CAST(sum(CASE WHEN usable >= 1000 THEN 1 ELSE 0 END) AS BIGINT), least := min(n), most := max(n))) AS VARCHAR) AS document FROM a""")
def ag40(spark, d):
    """One document of the numbers that decide reliability and feasibility: aggregates of aggregates, one row."""
    a = evidence(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quantity") >= 10).alias("usable"))
    fields = a.agg(F.count("*").alias("sources"), F.sum("n").alias("rows"), F.sum("usable").alias("usable"), F.sum(F.when(F.col("usable") >= 1000, 1).otherwise(0)).alias("feasible"), F.min("n").alias("least"), F.max("n").alias("most"))
    return fields.select(F.to_json(F.struct("*")).alias("document"))


def thresholds(graph, *names):
    """One row for each threshold of one to three reports and each row of graph that reaches it by the named counts."""
    return graph.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("least"), *names)


@query("ag49_rediscovery", f"""WITH {EV}, {PE}, g AS (SELECT a, b, count_if(source = 'A') AS na, count_if(source = 'R') AS nr FROM pe GROUP BY ALL), t AS (SELECT unnest([1, 2, 3]) AS least),
s AS (SELECT least, count_if(na >= least) AS accepted, count_if(nr >= least) AS sensitivity, count_if(na >= least AND nr >= least) AS rediscovered, count_if(na < least AND nr >= least) AS recovered, count_if(na >= least OR nr >= least) AS every FROM g, t GROUP BY ALL)
SELECT *, accepted - rediscovered AS not_rediscovered, CASE WHEN accepted > 0 THEN round(rediscovered / accepted, 9) END AS fraction FROM s""")
def ag49(spark, d):
    """How much of the accepted edges a second search finds again, at each threshold."""
    g = pair_evidence(spark, d).groupBy("a", "b").agg(F.count_if(F.col("source") == "A").alias("na"), F.count_if(F.col("source") == "R").alias("nr"))
    t = thresholds(g, "na", "nr")
    x, y = F.col("na") >= F.col("least"), F.col("nr") >= F.col("least")
    s = t.groupBy("least").agg(F.count_if(x).alias("accepted"), F.count_if(y).alias("sensitivity"), F.count_if(x & y).alias("rediscovered"), F.count_if(~x & y).alias("recovered"), F.count_if(x | y).alias("every"))
    return s.withColumns({"not_rediscovered": F.col("accepted") - F.col("rediscovered"), "fraction": F.when(F.col("accepted") > 0, F.round(F.col("rediscovered") / F.col("accepted"), 9))})


DEFINITIONS = (("accepted", ("A",)), ("full_length", ("A", "R")), ("local", ("A", "R", "N")))


@query("ag50_leakage_tables", f"""WITH {EV}, {PE}, k AS (SELECT * FROM (VALUES ('accepted', ['A']), ('full_length', ['A', 'R']), ('local', ['A', 'R', 'N'])) v(definition, sources)), t AS (SELECT unnest([1, 2, 3]) AS least),
g AS (SELECT definition, a, b, count(*) AS n, {PART_OF.format('a')} AS qa, {PART_OF.format('b')} AS qb FROM pe, k WHERE list_contains(sources, source) GROUP BY ALL),
e AS (SELECT * FROM g, t WHERE n >= least),
s AS (SELECT definition, least, count(*) AS edges, count_if(qa <> qb) AS crossing, count_if(qa = 'train' AND qb = 'test' OR qa = 'test' AND qb = 'train') AS train_test FROM e GROUP BY ALL),
n AS (SELECT definition, least, count(DISTINCT node) AS nodes FROM (SELECT definition, least, a AS node FROM e UNION ALL SELECT definition, least, b FROM e) GROUP BY ALL)
SELECT *, round(crossing / edges, 9) AS crossing_share FROM s JOIN n USING (definition, least)""")
def ag50(spark, d):
    """Leakage of every graph definition at every threshold: one long table of edges, one aggregation."""
    pairs = pair_evidence(spark, d).groupBy("a", "b", "source").agg(F.count("*").alias("k"))
    of = F.array(*(F.struct(F.lit(name).alias("definition"), F.array(*map(F.lit, sources)).alias("sources")) for name, sources in DEFINITIONS))
    g = pairs.select("a", "b", "source", "k", F.explode(of).alias("g")).where(F.array_contains("g.sources", F.col("source"))).groupBy("g.definition", "a", "b").agg(F.sum("k").alias("n"))
    e = durable(thresholds(g, "definition", "a", "b", "n").where("n >= least").withColumns({"qa": partition_of(F.col("a")), "qb": partition_of(F.col("b"))}), "leakage-edges")
    qa, qb = F.col("qa"), F.col("qb")
    ends = (qa == "train") & (qb == "test") | (qa == "test") & (qb == "train")
    s = e.groupBy("definition", "least").agg(F.count("*").alias("edges"), F.count_if(qa != qb).alias("crossing"), F.count_if(ends).alias("train_test"))
    n = e.select("definition", "least", F.explode(F.array("a", "b")).alias("node")).groupBy("definition", "least").agg(F.count_distinct("node").alias("nodes"))
    return s.join(n, ["definition", "least"]).withColumn("crossing_share", F.round(F.col("crossing") / F.col("edges"), 9))


POOLED = f"""{PAIRS}, {CELLS}, td AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM cells WHERE cell = 'C1' UNION ALL SELECT b FROM cells WHERE cell = 'C1') GROUP BY ALL),
j AS (SELECT cells.*, coalesce(x.k, 0) AS ka, coalesce(y.k, 0) AS kb FROM cells LEFT JOIN td x ON a = x.node LEFT JOIN td y ON b = y.node),
pool AS (SELECT * FROM j WHERE CASE WHEN cell = 'C1' THEN ka >= 2 AND kb >= 2 WHEN starts_with(cell, 'C2') THEN CASE WHEN qa = 'train' THEN ka >= 1 ELSE kb >= 1 END ELSE starts_with(cell, 'C3') END)"""


def pooled(spark, d):
    """Pairs of the opportunity pools: both training ends with two training partners, one with a partner, or both ends held out alike."""
    cells = durable(with_cells(positive_pairs(spark, d)), "cells")
    train = degrees(cells.where("cell = 'C1'"))
    j = cells.join(train.toDF("a", "ka"), "a", "left").join(train.toDF("b", "kb"), "b", "left").na.fill(0, ["ka", "kb"])
    return j.where("case when cell = 'C1' then ka >= 2 and kb >= 2 when startswith(cell, 'C2') then case when qa = 'train' then ka >= 1 else kb >= 1 end else startswith(cell, 'C3') end")


@query("ag51_pool_counts", f"""{POOLED}, b AS (SELECT 'P' || p_partkey AS node, p_brand AS component FROM part),
c AS (SELECT cell, count(DISTINCT component) AS components FROM (SELECT cell, a AS node FROM pool UNION ALL SELECT cell, b FROM pool) JOIN b USING (node) GROUP BY ALL)
SELECT cell, count(*) AS pairs, any_value(components) AS components, count_if(in_a) AS a_pairs, count_if(in_r) AS r_pairs FROM pool JOIN c USING (cell) GROUP BY cell""")
def ag51(spark, d):
    """Pairs, participating components and pairs of each source in every opportunity pool."""
    p = pooled(spark, d)
    brand = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_brand").alias("component"))
    c = p.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct().join(brand, "node").groupBy("cell").agg(F.count_distinct("component").alias("components"))
    return p.groupBy("cell").agg(F.count("*").alias("pairs"), F.count_if("in_a").alias("a_pairs"), F.count_if("in_r").alias("r_pairs")).join(c, "cell")


@query("ag52_partition_summary", f"""{PAIRS}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pp UNION ALL SELECT b FROM pp) GROUP BY ALL),
p AS (SELECT {PART_OF.format("('P' || p_partkey)")} AS partition, p_brand, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON node = 'P' || p_partkey)
SELECT partition, count(*) AS nodes, count(DISTINCT p_brand) AS components, CAST(sum(degree) AS BIGINT) AS degree_mass, count_if(degree = 0) AS isolated, max(degree) AS largest_degree, count_if(degree >= 100) AS hubs FROM p GROUP BY partition""")
def ag52(spark, d):
    """Nodes, components and degrees of each partition, nodes without an edge included."""
    node = F.concat(F.lit("P"), "p_partkey")
    p = table(spark, d, "part").select(node.alias("node"), "p_brand").join(degrees(positive_pairs(spark, d)), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return p.groupBy(partition_of(F.col("node")).alias("partition")).agg(
        F.count("*").alias("nodes"), F.count_distinct("p_brand").alias("components"), F.sum("degree").alias("degree_mass"), F.count_if(F.col("degree") == 0).alias("isolated"),
        F.max("degree").alias("largest_degree"), F.count_if(F.col("degree") >= 100).alias("hubs"),
    )


@query("ag53_protocol", f"""{PAIRS}, {CELLS}, e AS (SELECT cell, count(DISTINCT node) AS endpoints FROM (SELECT cell, a AS node FROM cells UNION ALL SELECT cell, b FROM cells) GROUP BY ALL),
s AS (SELECT cell, count(*) AS pairs, count_if(in_a AND NOT in_r) AS only_a, count_if(in_r AND NOT in_a) AS only_r, count_if(in_a AND in_r) AS both_sources, count_if(NOT in_a AND NOT in_r) AS neither, CAST(sum(n) AS BIGINT) AS reports FROM cells GROUP BY ALL)
SELECT *, CASE WHEN cell = 'quarantine' THEN 'quarantined' WHEN pairs >= 100 AND endpoints >= 10 THEN 'quantitative' ELSE 'descriptive' END AS floor_state FROM s JOIN e USING (cell)""")
def ag53(spark, d):
    """Every cell's pairs by source, endpoints and support, quarantined pairs among them."""
    c = durable(with_cells(positive_pairs(spark, d)), "cells")
    a, r = F.col("in_a"), F.col("in_r")
    s = c.groupBy("cell").agg(F.count("*").alias("pairs"), F.count_if(a & ~r).alias("only_a"), F.count_if(r & ~a).alias("only_r"), F.count_if(a & r).alias("both_sources"), F.count_if(~a & ~r).alias("neither"), F.sum("n").alias("reports"))
    e = c.select("cell", F.explode(F.array("a", "b")).alias("node")).groupBy("cell").agg(F.count_distinct("node").alias("endpoints"))
    state = F.when(F.col("cell") == "quarantine", "quarantined").when((F.col("pairs") >= 100) & (F.col("endpoints") >= 10), "quantitative").otherwise("descriptive")
    return s.join(e, "cell").withColumn("floor_state", state)


@query("ag55_candidate_designs", f"""{PAIRS}, {CELLS}, td AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM cells WHERE cell = 'C1' UNION ALL SELECT b FROM cells WHERE cell = 'C1') GROUP BY ALL),
bins AS (SELECT {BIN.format('k')} AS bin, count(*) AS n FROM td GROUP BY ALL), held AS (SELECT {PART_OF.format("('P' || p_partkey)")} AS part, count(*) AS n FROM part GROUP BY ALL),
base AS (SELECT 'C2/' || part AS cell, '0|' || bin AS stratum, held.n * bins.n AS population FROM held, bins WHERE part <> 'train' UNION ALL SELECT 'C3/' || part, '0|0', CAST(n * (n - 1) // 2 AS BIGINT) FROM held WHERE part <> 'train'),
pos AS (SELECT cell, CASE WHEN starts_with(cell, 'C2') THEN '0|' || {BIN.format('k')} ELSE '0|0' END AS stratum, count(*) AS positives FROM cells LEFT JOIN td ON node = CASE WHEN qa = 'train' THEN a ELSE b END WHERE (starts_with(cell, 'C2') AND k IS NOT NULL) OR starts_with(cell, 'C3') GROUP BY ALL)
SELECT cell, stratum, population, coalesce(positives, 0) AS positives, population - coalesce(positives, 0) AS unlabelled FROM base LEFT JOIN pos USING (cell, stratum)""")
def ag55(spark, d):
    """Unlabelled pairs of every held-out cell and stratum from the numbers of nodes in degree bins: no pair is enumerated."""
    cells = durable(with_cells(positive_pairs(spark, d)), "cells")
    train = durable(degrees(cells.where("cell = 'C1'")).withColumn("bin", degree_bin(F.col("degree"))), "training-degrees")
    bins = train.groupBy("bin").agg(F.count("*").alias("m"))  # nine rows at most
    held = table(spark, d, "part").groupBy(partition_of(F.concat(F.lit("P"), "p_partkey")).alias("part")).agg(F.count("*").alias("n")).where("part <> 'train'")  # two rows
    c2 = held.join(F.broadcast(bins.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select(F.concat(F.lit("C2/"), "part").alias("cell"), F.concat(F.lit("0|"), "bin").alias("stratum"), (F.col("n") * F.col("m")).alias("population"))
    base = c2.unionByName(held.select(F.concat(F.lit("C3/"), "part").alias("cell"), F.lit("0|0").alias("stratum"), F.expr("n * (n - 1) div 2").alias("population")))
    end = F.when(F.col("qa") == "train", F.col("a")).otherwise(F.col("b"))
    two = cells.where("startswith(cell, 'C2')").withColumn("node", end).join(train, "node").select("cell", F.concat(F.lit("0|"), "bin").alias("stratum"))
    pos = two.unionByName(cells.where("startswith(cell, 'C3')").select("cell", F.lit("0|0").alias("stratum"))).groupBy("cell", "stratum").agg(F.count("*").alias("positives"))
    out = base.join(pos, ["cell", "stratum"], "left").withColumn("positives", F.coalesce("positives", F.lit(0)))
    return out.withColumn("unlabelled", F.col("population") - F.col("positives"))


@query("ag56_overlap_counters", f"""WITH {EV}, r AS (SELECT DISTINCT part, supp, true AS known FROM ev WHERE source = 'A'), e AS (SELECT part, supp, quantity > 10 AS evaluable, quantity > 10 AND state = 'F' AS analysed FROM ev WHERE source = 'R'),
j AS (SELECT e.*, coalesce(known, false) AS pair_known, EXISTS (SELECT 1 FROM r WHERE r.part = e.part) AS part_known FROM e LEFT JOIN r USING (part, supp)),
k AS (SELECT unnest(['all', CASE WHEN evaluable THEN 'evaluable' END, CASE WHEN analysed THEN 'analysed' END]) AS subset, * FROM j)
SELECT subset, count(*) AS rows, count(DISTINCT part || '|' || supp) AS pairs, count_if(pair_known) AS known_rows, count(DISTINCT CASE WHEN pair_known THEN part || '|' || supp END) AS known_pairs, count_if(part_known AND NOT pair_known) AS endpoint_only FROM k WHERE subset IS NOT NULL GROUP BY subset""")
def ag56(spark, d):
    """Overlap with the other source, by pair and by endpoint, over all rows, the evaluable and the analysed ones."""
    e = evidence(spark, d)
    known = e.where("source = 'A'").select("part", "supp").distinct().withColumn("pair_known", F.lit(True))
    ends = known.select("part").distinct().withColumn("part_known", F.lit(True))
    rows = e.where("source = 'R'").select("part", "supp", (F.col("quantity") > 10).alias("evaluable"), ((F.col("quantity") > 10) & (F.col("state") == "F")).alias("analysed"))
    j = rows.join(known, ["part", "supp"], "left").join(ends, "part", "left").na.fill(False, ["pair_known", "part_known"])
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("evaluable"), "evaluable"), F.when(F.col("analysed"), "analysed")))
    pair = F.concat("part", F.lit("|"), "supp")
    return j.select(F.explode(subsets).alias("subset"), pair.alias("pair"), "pair_known", "part_known").groupBy("subset").agg(
        F.count("*").alias("rows"), F.count_distinct("pair").alias("pairs"), F.count_if("pair_known").alias("known_rows"), F.count_distinct(F.when(F.col("pair_known"), F.col("pair"))).alias("known_pairs"),
        F.count_if(F.col("part_known") & ~F.col("pair_known")).alias("endpoint_only"),
    )


def concordance_sql(name: str, score: str) -> str:
    return f"""{name}_g AS (SELECT l_linestatus AS cell, {score} AS score, sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS u FROM lineitem GROUP BY ALL),
{name} AS (SELECT cell, round(sum(p * (below + u / 2)) / (sum(p) * sum(u)), 9) AS concordance FROM (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_g) GROUP BY cell)"""


@query("al34_local_trigger", f"""WITH {concordance_sql('x', 'l_tax')}, {concordance_sql('y', 'l_discount')}
SELECT cell, x.concordance AS local, y.concordance AS global, round(x.concordance - y.concordance, 9) AS delta, x.concordance >= 0.51 AND round(x.concordance - y.concordance, 9) >= 0.01 AS triggered FROM x JOIN y USING (cell)""")
def al34(spark, d):
    """Whether a local score orders positives enough better than the global one on the same rows."""
    rows = table(spark, d, "lineitem")
    one = lambda score, name: M.concordance(rows.select(F.col("l_linestatus").alias("cell"), F.col(score), (F.col("l_returnflag") == "R").alias("pos"), F.col("l_quantity").alias("w")), ["cell"], score, F.col("pos"), F.col("w")).select("cell", F.round("concordance", 9).alias(name))
    j = one("l_tax", "local").join(one("l_discount", "global"), "cell").withColumn("delta", F.round(F.col("local") - F.col("global"), 9))
    return j.withColumn("triggered", (F.col("local") >= 0.51) & (F.col("delta") >= 0.01))


#: The k-th of sixteen segment pairs of two vectors.
X_SEGMENT, Y_SEGMENT = "x[16 * (k // 4) + 1:16 * (k // 4) + 16]", "y[16 * (k % 4) + 1:16 * (k % 4) + 16]"
COSINE = "coalesce(list_inner_product({0}, {1}) / sqrt(nullif(list_inner_product({0}, {0}) * list_inner_product({1}, {1}), 0)), 0)"
SEGMENTS = f"""v AS (SELECT 'P' || vec_id AS node, [CAST(floor(64 * x::DOUBLE) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64),
m AS (SELECT cell, c.a, c.b, in_a, x.v AS x, y.v AS y FROM cells c JOIN v x ON c.a = x.node JOIN v y ON c.b = y.node),
l AS (SELECT *, list_reverse_sort([{COSINE.format(X_SEGMENT, Y_SEGMENT)} FOR k IN range(16)]) AS s FROM m),
t AS (SELECT cell, in_a, s[1] AS local_max, (((s[1] + s[2]) + s[3]) + s[4]) / 4 AS local_top4, {COSINE.format('x', 'y')} AS "global" FROM l)"""


def ordered_sql(name: str) -> str:
    return f"""g_{name} AS (SELECT cell, "{name}" AS score, sum(CASE WHEN in_a THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN in_a THEN 0 ELSE 1.0::DOUBLE END) AS u FROM t GROUP BY ALL),
c_{name} AS (SELECT cell, round(sum(p * (below + u / 2)) / (sum(p) * sum(u)), 9) AS concordance FROM (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g_{name}) GROUP BY cell)"""


@query("al34_segment_trigger", f"""{PAIRS}, {CELLS}, {SEGMENTS}, {ordered_sql('local_max')}, {ordered_sql('local_top4')}, {ordered_sql('global')},
b AS (SELECT cell, 'local_max' AS score, concordance FROM c_local_max UNION ALL SELECT cell, 'local_top4', concordance FROM c_local_top4)
SELECT cell, score, b.concordance, g.concordance AS global_concordance, round(b.concordance - g.concordance, 9) AS delta, b.concordance >= 0.51 AND round(b.concordance - g.concordance, 9) >= 0.01 AS triggered FROM b JOIN c_global g USING (cell)""")
def al34_segments(spark, d):
    """The trigger on scores of segments: pairs of parts whose vectors are their keys' embeddings, those that source A reports against the others."""
    vectors = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.concat(F.lit("P"), "vec_id").alias("node"), F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("vector"))
    scored = durable(S.segment_scores(with_cells(positive_pairs(spark, d)).select("a", "b", "cell", "in_a"), vectors), "segment-scores")
    unlike = S.scalar_differences(scored, vectors, 4).count()
    if unlike:
        raise ValueError(f"{unlike} of 100 pairs have other scores by the plain form")
    return S.local_trigger(scored, "cell", F.col("in_a"), F.lit(1.0))


EXPECTED = (("region", 5), ("nation", 25), ("supplier", 1))


@query("qc09_frozen_expectations", "SELECT v.name, v.expected, n.observed, v.expected = n.observed AS holds FROM (VALUES ('region', CAST(5 AS BIGINT)), ('nation', CAST(25 AS BIGINT)), ('supplier', CAST(1 AS BIGINT))) v(name, expected) JOIN (SELECT 'region' AS name, count(*) AS observed FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier) n ON v.name = n.name")
def qc09(spark, d):
    """Counts against what the configuration has frozen; a preflight fails where one doesn't hold."""
    rows = [table(spark, d, name).agg(F.lit(name).alias("name"), F.lit(n).cast("long").alias("expected"), F.count("*").alias("observed")) for name, n in EXPECTED]
    return reduce(lambda x, y: x.unionByName(y), rows).withColumn("holds", F.col("expected") == F.col("observed"))
