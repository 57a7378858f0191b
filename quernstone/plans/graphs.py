"""Components, leakage and splits (AL-01..11, AL-40)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.graph import component_id, connected_components, nearest_rank, nested_components
from ..operators.split import PARTITIONS, feasibility, search, selected, trials
from .identities import PART_OF, partition_of, with_cells
from .registry import query
from .roles import EV, PAIRS, PE, pair_evidence, positive_pairs, table

#: Components by recursion over the edges that both sources report.
CC = f"""{PAIRS.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT a AS x, b AS y FROM pp WHERE in_a AND in_r UNION SELECT b, a FROM pp WHERE in_a AND in_r),
w AS (SELECT 'P' || p_partkey AS node, 'P' || p_partkey AS rep FROM part UNION SELECT e.y, w.rep FROM w JOIN e ON w.node = e.x),
cc AS (SELECT node, min(rep) AS representative FROM w GROUP BY node)"""


def nodes(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"))


def components(spark, d):
    return connected_components(nodes(spark, d), positive_pairs(spark, d).where("in_a and in_r").select("a", "b"))


@query("al01_connected_components", f"{CC} SELECT node, representative FROM cc")
def al01(spark, d):
    return components(spark, d)


@query("al02_component_ids", f"{CC} SELECT representative, 'component:' || substr(sha256(list_aggregate(list_sort(list(node)), 'string_agg', '|')), 1, 32) AS component_id, count(*) AS size FROM cc GROUP BY representative")
def al02(spark, d):
    return components(spark, d).groupBy("representative").agg(component_id(F.collect_list("node"), "component").alias("component_id"), F.count("*").alias("size"))


#: Components of nested graphs: labels sink along the edges of a level (ed: a, b, level) and of those before it.
NESTED = """nd AS (SELECT 'P' || p_partkey AS node FROM part),
ln AS (SELECT x.level, a, b FROM ed JOIN lv x ON ed.level <= x.level), e2 AS (SELECT level, a AS x, b AS y FROM ln UNION SELECT level, b, a FROM ln),
cn(level, node, rep) USING KEY (level, node) AS (SELECT level, node, node FROM nd, lv
  UNION (SELECT u.level, u.node, min(v.rep) FROM recurring.cn u JOIN e2 ON e2.level = u.level AND e2.x = u.node JOIN cn v ON v.level = e2.level AND v.node = e2.y WHERE v.rep < u.rep GROUP BY u.level, u.node))"""
RECURSIVE_PAIRS = PAIRS.replace("WITH", "WITH RECURSIVE", 1)


@query("al03_sizes_at_thresholds", f"""{RECURSIVE_PAIRS}, lv AS (SELECT unnest([1, 2, 3]) AS level), ed AS (SELECT a, b, 4 - least(n, 3) AS level FROM pp), {NESTED},
sz AS (SELECT level, rep, count(*) AS size FROM cn GROUP BY ALL)
SELECT CAST(4 - level AS INTEGER) AS least_reports, count(*) AS components, max(size) AS largest, quantile_disc(size, 0.25) AS q25, quantile_disc(size, 0.5) AS q50, quantile_disc(size, 0.75) AS q75, quantile_disc(size, 0.99) AS q99 FROM sz GROUP BY level""")
def al03(spark, d):
    """Component counts, quantiles of the sizes and the largest size when edges need three, two or one reports, each graph grown from the one before."""
    edges = positive_pairs(spark, d).select("a", "b", (4 - F.least("n", F.lit(3))).alias("level"))
    members, _ = nested_components(nodes(spark, d), edges, [1, 2, 3])
    s = members.groupBy("level", "representative").agg(F.count("*").alias("size"))
    quantiles = [nearest_rank("size", q).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75, 0.99)]
    return s.groupBy("level").agg(F.count("*").alias("components"), F.max("size").alias("largest"), *quantiles).select((4 - F.col("level")).cast("int").alias("least_reports"), "components", "largest", "q25", "q50", "q75", "q99")


#: The three graphs, each with the reports that its added pairs need; other pairs are in none.
LEAKAGE_NAMES = ("accepted", "full_length", "local")
LEVEL_OF = "CASE WHEN n >= 3 AND in_a AND in_r THEN 1 WHEN n >= 3 THEN 2 WHEN n >= 2 THEN 3 END"
NAME_OF = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(LEAKAGE_NAMES, 1))


@query("al06_leakage_components", f"""{RECURSIVE_PAIRS}, lv AS (SELECT unnest([1, 2, 3]) AS level), ed AS (SELECT a, b, {LEVEL_OF} AS level FROM pp WHERE n >= 2), {NESTED},
sz AS (SELECT level, rep, count(*) AS size FROM cn GROUP BY ALL), s AS (SELECT level, count(*) AS components, max(size) AS largest, count_if(size = 1) AS singletons FROM sz GROUP BY ALL),
g AS (SELECT ed.level, count(*) AS added, count_if(coalesce(x.rep, ed.a) <> coalesce(y.rep, ed.b)) AS added_crossing FROM ed LEFT JOIN cn x ON x.level = ed.level - 1 AND x.node = ed.a LEFT JOIN cn y ON y.level = ed.level - 1 AND y.node = ed.b GROUP BY ALL)
SELECT CASE level {NAME_OF} END AS graph, (SELECT count(*) FROM ed WHERE ed.level <= s.level) AS edges, coalesce(added, 0) AS added, coalesce(added_crossing, 0) AS added_crossing, components, largest, singletons FROM s LEFT JOIN g USING (level)""")
def al06_components(spark, d):
    """The accepted, full-length and local graphs: edges, those that a graph adds, those of them that join two components, and the sizes."""
    edges = positive_pairs(spark, d).select("a", "b", F.expr(LEVEL_OF).alias("level")).where("level is not null")
    members, judged = nested_components(nodes(spark, d), edges, [1, 2, 3])
    sizes = members.groupBy("level", "representative").agg(F.count("*").alias("size"))
    s = sizes.groupBy("level").agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons"))
    g = judged.groupBy("level").agg(F.count("*").alias("added"), F.count_if("crossing").alias("added_crossing"))
    upto = F.sum("added").over(W.orderBy("level").rowsBetween(W.unboundedPreceding, 0))  # a row for each level
    j = s.join(g, "level", "left").withColumns({"added": F.coalesce("added", F.lit(0)), "added_crossing": F.coalesce("added_crossing", F.lit(0))}).withColumn("edges", upto)
    return j.select(F.expr(f"CASE level {NAME_OF} END").alias("graph"), "edges", "added", "added_crossing", "components", "largest", "singletons")


@query("al06_nested_graphs", f"WITH {EV}, {PE}, g1 AS (SELECT DISTINCT a, b FROM pe WHERE source = 'A'), g2 AS (SELECT DISTINCT a, b FROM pe WHERE source IN ('A', 'R')), g3 AS (SELECT DISTINCT a, b FROM pe) SELECT (SELECT count(*) FROM g1) AS accepted, (SELECT count(*) FROM g2) AS full_length, (SELECT count(*) FROM g3) AS local")
def al06(spark, d):
    g = pair_evidence(spark, d).groupBy("a", "b").agg(F.bool_or(F.col("source") == "A").alias("g1"), F.bool_or(F.col("source").isin("A", "R")).alias("g2"))
    return g.agg(F.count_if("g1").alias("accepted"), F.count_if("g2").alias("full_length"), F.count("*").alias("local"))


def brand_sizes(spark, d):
    return [(r.p_brand, r.n) for r in table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).collect()]  # a row for each brand


#: A thousand allocations by recursion over the components in the order of their hashes.
TRIALS = """WITH RECURSIVE sizes AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT range AS trial FROM range(1000)),
o AS (SELECT trial, n, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat_ws('|', 1, trial, name)), name) AS i, (SELECT CAST(sum(n) AS BIGINT) FROM sizes) AS total FROM t, sizes),
w AS (SELECT trial, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM t
  UNION ALL
  SELECT trial, i, a + CASE WHEN z <= greatest(x, y) AND y <= x THEN n ELSE 0 END, b + CASE WHEN z <= greatest(x, y) AND y > x THEN n ELSE 0 END, c + CASE WHEN z > greatest(x, y) THEN n ELSE 0 END
  FROM (SELECT w.trial, o.i, a, b, c, n, (70 * total - 100 * a) * 15 AS x, (15 * total - 100 * b) * 70 AS y, (15 * total - 100 * c) * 70 AS z FROM w JOIN o ON o.trial = w.trial AND o.i = w.i + 1)),
r AS (SELECT trial, a AS train, b AS development, c AS test FROM w WHERE i = (SELECT count(*) FROM sizes))"""


@query("al07_08_allocation_trials", f"{TRIALS} SELECT * FROM r")
def al07(spark, d):
    return trials(spark, brand_sizes(spark, d), 1000)


@query("al08_feasibility", f"""{TRIALS}, p AS (SELECT *, train + development + test AS total FROM r),
q AS (SELECT *, abs(100 * train - 70 * total) <= 3 * total AS x, abs(100 * development - 15 * total) <= 3 * total AS y, abs(100 * test - 15 * total) <= 3 * total AS z FROM p)
SELECT count(*) AS trials, count_if(x) AS train_passes, count_if(y) AS development_passes, count_if(z) AS test_passes, count_if(x AND y AND z) AS passes,
  min(train) AS train_least, max(train) AS train_most, min(development) AS development_least, max(development) AS development_most, min(test) AS test_least, max(test) AS test_most,
  CASE WHEN 100 * count_if(x AND y AND z) >= 95 * count(*) THEN 'robust' WHEN count_if(x AND y AND z) > 0 THEN 'feasible' ELSE 'infeasible' END AS status FROM q""")
def al08(spark, d):
    return feasibility(trials(spark, brand_sizes(spark, d), 1000))


#: Floors of pairs, components and source in the searches below.
FLOORS = {"pairs": 50, "components": 20, "source": 10}


def candidate_results(spark, d, n=4096):
    return search(durable(components(spark, d)), durable(positive_pairs(spark, d)), n, FLOORS)


#: Five allocations of the components by recursion, their pools, and the eight criteria in whole millionths.
CRITERIA = f"""{CC}, z AS (SELECT representative AS name, count(*) AS n FROM cc GROUP BY ALL), t AS (SELECT range AS c FROM range(5)),
o AS (SELECT c, name, n, row_number() OVER (PARTITION BY c ORDER BY sha256(concat_ws('|', 9, c, name)), name) AS i, (SELECT CAST(sum(n) AS BIGINT) FROM z) AS total FROM t, z),
g AS (SELECT c, CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS name, 0 AS code, CAST(0 AS BIGINT) AS f0, CAST(0 AS BIGINT) AS f1, CAST(0 AS BIGINT) AS f2 FROM t
  UNION ALL
  SELECT c, i, name, code, f0 + CASE code WHEN 0 THEN n ELSE 0 END, f1 + CASE code WHEN 1 THEN n ELSE 0 END, f2 + CASE code WHEN 2 THEN n ELSE 0 END
  FROM (SELECT *, CASE WHEN z <= greatest(x, y) AND y <= x THEN 0 WHEN z <= greatest(x, y) THEN 1 ELSE 2 END AS code
        FROM (SELECT g.c, o.i, o.name, n, f0, f1, f2, (70 * total - 100 * f0) * 15 AS x, (15 * total - 100 * f1) * 70 AS y, (15 * total - 100 * f2) * 70 AS z FROM g JOIN o ON o.c = g.c AND o.i = g.i + 1))),
deg AS (SELECT cc.node, representative AS name, coalesce(k, 0) AS degree FROM cc LEFT JOIN (SELECT node, count(*) AS k FROM (SELECT a AS node FROM pp UNION ALL SELECT b FROM pp) GROUP BY ALL) e ON e.node = cc.node),
rk AS (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS r, count(*) OVER () AS n FROM deg),
x AS (SELECT g.c, node, rk.name, code, degree, r <= greatest(1, ceil(0.01 * n)) AS h0, r <= greatest(1, ceil(0.05 * n)) AS h1 FROM rk JOIN g ON g.name = rk.name AND g.i > 0),
ed AS (SELECT x.c, pp.a, pp.b, in_a, in_r, x.code AS qa, y.code AS qb, x.name AS ca, y.name AS cb FROM pp JOIN x ON x.node = a JOIN x y ON y.node = b AND y.c = x.c),
p AS (SELECT c, node, count(*) AS k FROM (SELECT c, a AS node FROM ed WHERE qa = 0 AND qb = 0 UNION ALL SELECT c, b FROM ed WHERE qa = 0 AND qb = 0) GROUP BY ALL),
m AS (SELECT ed.*, coalesce(u.k, 0) AS ka, coalesce(v.k, 0) AS kb FROM ed LEFT JOIN p u ON u.c = ed.c AND u.node = a LEFT JOIN p v ON v.c = ed.c AND v.node = b),
l AS (SELECT c, ca, cb, in_a, in_r, unnest([CASE WHEN qa = 0 AND qb = 0 AND ka >= 2 AND kb >= 2 THEN 'C1' END, CASE WHEN (qa = 0 AND qb = 1 AND ka >= 1) OR (qb = 0 AND qa = 1 AND kb >= 1) THEN 'C2d' END,
  CASE WHEN (qa = 0 AND qb = 2 AND ka >= 1) OR (qb = 0 AND qa = 2 AND kb >= 1) THEN 'C2t' END, CASE WHEN qa = 1 AND qb = 1 THEN 'C3d' END, CASE WHEN qa = 2 AND qb = 2 THEN 'C3t' END]) AS pool FROM m),
k AS (SELECT t.c, q.pool, count(l.c) AS pairs, count_if(in_a) AS na, count_if(in_r) AS nr FROM t CROSS JOIN (VALUES ('C1'), ('C2d'), ('C2t'), ('C3d'), ('C3t')) q(pool) LEFT JOIN l ON l.c = t.c AND l.pool = q.pool GROUP BY ALL),
kc AS (SELECT c, pool, count(DISTINCT name) AS components FROM (SELECT c, pool, ca AS name FROM l WHERE pool IS NOT NULL UNION ALL SELECT c, pool, cb FROM l WHERE pool IS NOT NULL) GROUP BY ALL),
kk AS (SELECT k.*, coalesce(components, 0) AS components, (SELECT count(*) FROM pp) AS every, (SELECT count_if(in_a) FROM pp) AS every_a, (SELECT count_if(in_r) FROM pp) AS every_r FROM k LEFT JOIN kc USING (c, pool)),
wt AS (SELECT c, code, share, count(x.c) AS nodes, coalesce(sum(degree), 0) AS mass, count_if(h0) AS h0, count_if(h1) AS h1 FROM t CROSS JOIN (VALUES (0, 70), (1, 15), (2, 15)) s(code, share) LEFT JOIN x USING (c, code) GROUP BY ALL),
ww AS (SELECT *, sum(nodes) OVER v AS an, sum(mass) OVER v AS am, sum(h0) OVER v AS a0, sum(h1) OVER v AS a1 FROM wt WINDOW v AS (PARTITION BY c)),
s AS (SELECT c, max((2000000 * abs(100 * nodes - share * an) + 100 * an) // (200 * an)) AS endpoint, max((2000000 * abs(100 * mass - share * am) + 100 * am) // (200 * am)) AS mass,
  greatest(max((2000000 * abs(100 * h0 - share * a0) + 100 * a0) // (200 * a0)), max((2000000 * abs(100 * h1 - share * a1) + 100 * a1) // (200 * a1))) AS hubs, sum(abs(100 * nodes - share * an)) AS off,
  max(nodes) FILTER (WHERE code = 0) AS train, max(nodes) FILTER (WHERE code = 1) AS development, max(nodes) FILTER (WHERE code = 2) AS test FROM ww GROUP BY c),
v AS (SELECT c, min(least((2000000 * pairs + 50) // 100, (2000000 * components + 20) // 40, (2000000 * na + 10) // 20, (2000000 * nr + 10) // 20)) AS evidence,
  max(greatest((2000000 * abs(na * every - pairs * every_a) + greatest(1, pairs * every)) // (2 * greatest(1, pairs * every)), (2000000 * abs(nr * every - pairs * every_r) + greatest(1, pairs * every)) // (2 * greatest(1, pairs * every)))) AS source,
  bool_or(pairs < 50) AS b1, bool_or(components < 20) AS b2, bool_or(na < 10 OR nr < 10) AS b3 FROM kk GROUP BY c),
hx AS (SELECT d.c, unnest([[d.pairs, e.pairs], [d.na, e.na], [d.nr, e.nr]]) AS y FROM kk d JOIN kk e ON e.c = d.c AND (d.pool, e.pool) IN (('C2d', 'C2t'), ('C3d', 'C3t'))),
h AS (SELECT c, max((2000000 * abs(y[1] - y[2]) + greatest(1, y[1] + y[2])) // (2 * greatest(1, y[1] + y[2]))) AS heldout FROM hx GROUP BY c),
r AS (SELECT c AS candidate, list_filter([CASE WHEN endpoint > 30000 THEN 'endpoint_balance' END, CASE WHEN b1 THEN 'positive_pair_floor' END, CASE WHEN b2 THEN 'component_floor' END, CASE WHEN b3 THEN 'source_floor' END,
  CASE WHEN source > 100000 THEN 'source_composition' END, CASE WHEN heldout > 350000 THEN 'heldout_axis_balance' END, CASE WHEN mass > 100000 THEN 'degree_mass_balance' END, CASE WHEN hubs > 100000 THEN 'hub_balance' END], lambda f: f IS NOT NULL) AS failed,
  [endpoint, -evidence, heldout, source, mass, hubs, off] AS objective, train, development, test FROM s JOIN v USING (c) JOIN h USING (c))"""


@query("al09_candidate_search")
def al09(spark, d):
    """The valid candidate of the least objective among 4096; the same search over five has SQL, and tests hold criteria and objective."""
    return selected(candidate_results(spark, d))


@query("al09_candidate_criteria", f"{CRITERIA} SELECT candidate, len(failed) = 0 AS valid, array_to_string(failed, ',') AS failed, array_to_string(objective, ',') AS objective, train, development, test FROM r")
def al09_criteria(spark, d):
    """Five candidates with the criteria that they fail and their objectives."""
    r = candidate_results(spark, d, 5)
    return r.select("candidate", "valid", F.array_join("failed", ",").alias("failed"), F.array_join(F.col("objective").cast("array<string>"), ",").alias("objective"), "train", "development", "test")


@query("al10_opportunity_counts", f"{PAIRS}, q AS (SELECT {PART_OF.format('a')} AS qa, {PART_OF.format('b')} AS qb FROM pp) SELECT count_if(qa = 'train' AND qb = 'train') AS c1, count_if((qa = 'train') <> (qb = 'train')) AS c2, count_if(qa <> 'train' AND qb = qa) AS c3 FROM q")
def al10(spark, d):
    q = with_cells(positive_pairs(spark, d))
    a, b = F.col("qa") == "train", F.col("qb") == "train"
    return q.agg(F.count_if(a & b).alias("c1"), F.count_if(a != b).alias("c2"), F.count_if(~a & (F.col("qa") == F.col("qb"))).alias("c3"))


@query("al11_leakage", f"{CC} SELECT count(*) AS components, count_if(k > 1) AS leaking FROM (SELECT representative, count(DISTINCT {PART_OF.format('node')}) AS k FROM cc GROUP BY ALL)")
def al11(spark, d):
    c = components(spark, d).groupBy("representative").agg(F.count_distinct(partition_of(F.col("node"))).alias("k"))
    return c.agg(F.count("*").alias("components"), F.count_if(F.col("k") > 1).alias("leaking"))


@query("al40_within_components", f"{CC} SELECT count_if(x.representative = y.representative) AS within, count_if(x.representative <> y.representative) AS across FROM pp JOIN cc x ON a = x.node JOIN cc y ON b = y.node")
def al40(spark, d):
    c = durable(components(spark, d))
    j = positive_pairs(spark, d).join(c.toDF("a", "ra"), "a").join(c.toDF("b", "rb"), "b")
    return j.agg(F.count_if(F.col("ra") == F.col("rb")).alias("within"), F.count_if(F.col("ra") != F.col("rb")).alias("across"))


@query("al41_claims", f"{PAIRS} SELECT CASE WHEN count(*) >= 1000 AND count_if(in_a AND in_r) >= 100 THEN 'supported' WHEN count(*) >= 1000 THEN 'limited' ELSE 'unsupported' END AS claim FROM pp")
def al41(spark, d):
    n, k = F.count("*"), F.count_if(F.col("in_a") & F.col("in_r"))
    return positive_pairs(spark, d).agg(F.when((n >= 1000) & (k >= 100), "supported").when(n >= 1000, "limited").otherwise("unsupported").alias("claim"))


PARTITION_NAMES = tuple(p for p, _ in PARTITIONS)
