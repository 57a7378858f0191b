"""Bootstrap intervals over cells and scorers, paired differences and the rules on them (AL-21, AL-22, AL-26).

Pairs are order lines: a component is the nation of the customer or of the supplier, nations of odd number are held out, so a line
is in C1, C2 or C3; returned lines are positive, others are weighted by their quantity.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import bootstrap as B
from ..operators import metrics as M
from ..operators import selection as S
from ..operators.durable import durable
from .registry import query
from .roles import table

SEED = "20260803"
SOURCES, OUTSIDE, NOVEL = ("source:F:C3", "source:O:C3"), "outside_hubs:C3", "novel:C1"
VIEWS = {"sources": list(SOURCES), "outside": OUTSIDE}
#: Scorers as expressions of both dialects over whole numbers: quantity q, discount d and tax t in hundredths, supplier's degree.
SCORERS = {
    "degree": "degree", "discount": "d", "tax": "t",
    "linear_seed1": "q", "linear_seed2": "q + d", "linear_seed3": "q + 2 * d", "linear": "q + d",
    "no_gate_seed1": "2 * q + t", "no_gate_seed2": "2 * q + t + d", "no_gate_seed3": "2 * q + t + 2 * d", "no_gate": "2 * q + t + d",
    "gated_seed1": "q * (d + 1)", "gated_seed2": "q * (d + 1) + t", "gated_seed3": "q * (d + 1) + 2 * t", "gated": "q * (d + 1) + t",
}
FAMILIES = {"linear": 1, "no_gate": 2, "gated": 3}
BOOTSTRAPPED = ("degree", "discount", "tax", *FAMILIES)


def registry_rows() -> list[tuple]:
    rows = [("degree", "shortcut", None, None, None, 0), ("discount", "simple", None, None, None, 0), ("tax", "simple", None, None, None, 0)]
    for f, k in FAMILIES.items():
        rows += [(f, "candidate", None, f, "r1", k)] + [(f"{f}_seed{i}", "member", f, None, None, k) for i in (1, 2, 3)]
    return rows


def scorer_registry(spark):
    return spark.createDataFrame(registry_rows(), S.REGISTRY)


def viewed_lines(spark, d):
    """Lines with every cell or view that they are in, long in the scorers: cell, scorer, score, ca, cb, positive, weight."""
    line = table(spark, d, "lineitem")
    degree = line.groupBy("l_suppkey").agg(F.count("*").alias("degree"))
    steps = degree.groupBy("degree").agg(F.count("*").alias("k"))  # the top tenth from counts of equal degrees, not from a sort of all
    above = F.coalesce(F.sum("k").over(W.orderBy(F.desc("degree")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select("degree", (10 * above < F.sum("k").over(W.partitionBy())).alias("hub"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nb"))
    ends = degree.join(steps, "degree").join(supplier, "l_suppkey")
    buyer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("na"))
    order = table(spark, d, "orders").join(buyer, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "na")
    whole = lambda c, k: F.round(F.col(c) * k).cast("long")
    j = line.join(ends, "l_suppkey").join(order, "l_orderkey").select(
        F.col("na").cast("string").alias("ca"), F.col("nb").cast("string").alias("cb"), (F.col("na") % 2 + F.col("nb") % 2).alias("held"), (F.col("l_returnflag") == "R").alias("positive"),
        F.col("l_quantity").cast("double").alias("weight"), "degree", "hub", F.col("l_linestatus").alias("source"), whole("l_quantity", 1).alias("q"), whole("l_discount", 100).alias("d"), whole("l_tax", 100).alias("t"),
    )
    held = F.col("held")
    cells = F.array_compact(F.array(
        F.when(held == 0, "C1_development").when(held == 1, "C2_development").otherwise("C3_development"), F.when((held == 0) & (F.col("positive") | (F.col("source") == "O")), NOVEL),
        F.when(held == 2, F.concat(F.lit("source:"), "source", F.lit(":C3"))), F.when((held == 2) & ~F.col("hub"), OUTSIDE),
    ))
    scores = F.expr(f"stack({len(SCORERS)}, {', '.join(f'{n!r}, CAST({x} AS DOUBLE)' for n, x in SCORERS.items())}) AS (scorer, score)")
    return j.withColumn("cell", F.explode(cells)).select("cell", "ca", "cb", "positive", "weight", scores)


def point_metrics(rows):
    return M.concordance(rows, ["cell", "scorer"], "score", F.col("positive"), F.col("weight"))


def bootstrapped(rows, draws, replicates):
    primary = rows.where(F.col("cell").isin(*S.PRIMARY) & F.col("scorer").isin(*BOOTSTRAPPED))
    return B.clustered_bootstrap(primary, draws, replicates)


@query("al21_clustered_bootstrap")
def al21(spark, d):
    """2,000 replicates of three cells and six scorers, from one generator a cell."""
    x = bootstrapped(viewed_lines(spark, d), B.generator_draws(SEED), 2000)
    return x.select("cell", "scorer", F.posexplode("concordances").alias("at", "concordance"), "block").select("cell", "scorer", (F.col("block") * B.BLOCK + F.col("at")).alias("replicate"), "concordance")


@query("al22_interval")
def al22(spark, d):
    return B.intervals(bootstrapped(viewed_lines(spark, d), B.generator_draws(SEED), 2000))


#: The same by SQL over a hundred replicates whose draws are digests.
REPLICATES = 100
SCORES = ", ".join(f"{{'scorer': {n!r}, 'score': CAST({x} AS DOUBLE)}}" for n, x in SCORERS.items())
NAMES = ", ".join(repr(x) for x in BOOTSTRAPPED)
REGISTERED = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in registry_rows())
SQL = f"""WITH dg AS (SELECT l_suppkey, count(*) AS degree FROM lineitem GROUP BY ALL),
hb AS (SELECT *, 10 * (rank() OVER (ORDER BY degree DESC) - 1) < count(*) OVER () AS hub FROM dg),
ln AS (SELECT CAST(c_nationkey AS VARCHAR) AS ca, CAST(s_nationkey AS VARCHAR) AS cb, c_nationkey % 2 + s_nationkey % 2 AS held, l_returnflag = 'R' AS pos, CAST(l_quantity AS DOUBLE) AS w, degree, hub,
  l_linestatus AS src, CAST(round(l_quantity) AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
  FROM lineitem JOIN hb USING (l_suppkey) JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
vw AS (SELECT *, unnest(list_filter([CASE held WHEN 0 THEN 'C1_development' WHEN 1 THEN 'C2_development' ELSE 'C3_development' END, CASE WHEN held = 0 AND (pos OR src = 'O') THEN '{NOVEL}' END,
  CASE WHEN held = 2 THEN 'source:' || src || ':C3' END, CASE WHEN held = 2 AND NOT hub THEN '{OUTSIDE}' END], lambda x: x IS NOT NULL)) AS cell FROM ln),
sc AS MATERIALIZED (SELECT cell, ca, cb, s.scorer, s.score, sum(CASE WHEN pos THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS u FROM (SELECT *, unnest([{SCORES}]) AS s FROM vw) GROUP BY ALL),
p1 AS (SELECT cell, scorer, score, sum(p) AS p, sum(u) AS u FROM sc GROUP BY ALL),
p2 AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell, scorer ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p1),
pt AS MATERIALIZED (SELECT cell, scorer, sum(p * (below + u / 2)) / (sum(p) * sum(u)) AS concordance FROM p2 GROUP BY ALL HAVING sum(p) > 0 AND sum(u) > 0),
cp AS (SELECT cell, component, row_number() OVER (PARTITION BY cell ORDER BY component) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n
  FROM (SELECT cell, ca AS component FROM vw UNION SELECT cell, cb FROM vw) WHERE cell IN ('C1_development', 'C2_development', 'C3_development')),
dr AS MATERIALIZED (SELECT cell, r, CAST(('0x' || substr(sha256(concat_ws('|', '{SEED}', cell, r, i)), 1, 15)) AS BIGINT) % n AS i, count(*) AS k FROM cp, (SELECT range AS r FROM range({REPLICATES})) GROUP BY ALL),
dn AS MATERIALIZED (SELECT cp.cell, component, r, k FROM cp JOIN dr USING (cell, i)),
b1 AS (SELECT cell, scorer, r, score, sum(p * m) AS p, sum(u * m) AS u
  FROM (SELECT sc.*, x.r, CASE WHEN ca = cb THEN x.k ELSE x.k * y.k END AS m FROM sc JOIN dn x ON x.cell = sc.cell AND x.component = ca JOIN dn y ON y.cell = sc.cell AND y.component = cb AND y.r = x.r WHERE scorer IN ({NAMES})) GROUP BY ALL),
b2 AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY cell, scorer, r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b1),
bs AS MATERIALIZED (SELECT cell, scorer, r, sum(p * (below + u / 2)) / (sum(p) * sum(u)) AS x FROM b2 GROUP BY ALL HAVING sum(p) > 0 AND sum(u) > 0),
iv AS (SELECT cell, scorer, count(*) AS defined, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM bs GROUP BY ALL)"""
DELTAS = f"""{SQL}, rg(scorer, kind, candidate, family, recipe, complexity) AS (VALUES {REGISTERED}),
pr AS (SELECT pt.*, kind, family, recipe, complexity FROM pt JOIN rg USING (scorer)),
st AS (SELECT cell, min_by(scorer, (-concordance, scorer)) FILTER (WHERE kind = 'simple' OR family = 'linear') AS simple, min_by(scorer, (-concordance, scorer)) FILTER (WHERE family = 'linear') AS linear
  FROM pr WHERE cell LIKE 'C%development' GROUP BY ALL),
cm AS (SELECT pr.cell, pr.scorer AS candidate, unnest([{{'basis': 'simple', 'comparator': simple}}, {{'basis': 'linear', 'comparator': CASE WHEN pr.family = 'gated' AND pr.cell = 'C3_development' THEN linear END}},
  {{'basis': 'no_gate', 'comparator': CASE WHEN pr.family = 'gated' AND pr.cell = 'C3_development' THEN t.scorer END}}], recursive := true)
  FROM pr JOIN st USING (cell) LEFT JOIN rg t ON t.family = 'no_gate' AND t.recipe = pr.recipe WHERE pr.family IN ('no_gate', 'gated')),
gp AS (SELECT cm.*, x.x - y.x AS gap FROM cm JOIN bs x ON x.cell = cm.cell AND x.scorer = candidate JOIN bs y ON y.cell = cm.cell AND y.scorer = comparator AND y.r = x.r),
dl AS MATERIALIZED (SELECT g.*, l.concordance - r.concordance AS delta FROM (SELECT cell, candidate, comparator, basis, count(*) AS defined, quantile_cont(gap, 0.025) AS low, quantile_cont(gap, 0.975) AS high FROM gp GROUP BY ALL) g
  JOIN pt l ON l.cell = g.cell AND l.scorer = candidate JOIN pt r ON r.cell = g.cell AND r.scorer = comparator)"""
RULES = f"""{DELTAS}, sr AS (SELECT rg.candidate, cell, max(concordance) - min(concordance) <= 0.02 AS steady FROM pt JOIN rg USING (scorer) WHERE kind = 'member' AND cell LIKE 'C%development' GROUP BY ALL),
el AS (SELECT candidate, bool_and(steady) AND count(*) = 3 AS eligible FROM sr GROUP BY ALL),
ky AS (SELECT scorer, complexity, max(CASE WHEN cell LIKE 'C3%' THEN -k END) AS k3, max(CASE WHEN cell LIKE 'C2%' THEN -k END) AS k2, max(CASE WHEN cell LIKE 'C1%' THEN -k END) AS k1
  FROM (SELECT *, round(CAST(concordance AS DECIMAL(18, 9)), 3) AS k FROM pr WHERE kind = 'candidate' AND cell LIKE 'C%development') JOIN el ON el.candidate = scorer AND eligible GROUP BY ALL),
sl AS (SELECT scorer FROM ky ORDER BY k3, k2, k1, complexity, scorer LIMIT 1),
d3 AS (SELECT candidate, basis, comparator, delta, low FROM dl WHERE cell = 'C3_development'),
ot AS (SELECT scorer, concordance FROM pt WHERE cell = '{OUTSIDE}'),
so AS (SELECT s.scorer, bool_or(s.concordance > z.m) AS ok FROM pt s JOIN (SELECT cell, max(concordance) AS m FROM pr WHERE kind = 'simple' OR family = 'linear' GROUP BY ALL) z USING (cell) WHERE cell LIKE 'source:%' GROUP BY ALL),
gc AS (SELECT d3.candidate, unnest([{{'c': 'simple_gain', 'h': bool_or(basis = 'simple' AND delta >= 0.02)}}, {{'c': 'simple_interval', 'h': bool_or(basis = 'simple' AND low > 0)}}, {{'c': 'linear_gain', 'h': bool_or(basis = 'linear' AND delta >= 0.01)}},
  {{'c': 'linear_interval', 'h': bool_or(basis = 'linear' AND low > 0)}}, {{'c': 'no_gate_gain', 'h': bool_or(basis = 'no_gate' AND delta >= 0.005)}}, {{'c': 'no_gate_interval', 'h': bool_or(basis = 'no_gate' AND low > 0)}},
  {{'c': 'source_direction', 'h': coalesce(any_value(so.ok), false)}}, {{'c': 'outside_hubs', 'h': coalesce(bool_or(basis = 'simple' AND o.concordance > b.concordance), false)}}, {{'c': 'seed_ranges', 'h': any_value(eligible)}}], recursive := true)
  FROM d3 JOIN rg ON rg.scorer = d3.candidate AND rg.family = 'gated' LEFT JOIN so ON so.scorer = d3.candidate LEFT JOIN ot o ON o.scorer = d3.candidate LEFT JOIN ot b ON b.scorer = comparator JOIN el ON el.candidate = d3.candidate GROUP BY d3.candidate),
bc AS (SELECT scorer FROM pr WHERE family IN ('no_gate', 'gated') AND cell = 'C3_development' ORDER BY concordance DESC, scorer LIMIT 1),
qd AS (SELECT coalesce(bool_or(cell = 'C3_development'), false) AS qany, coalesce(bool_or(family = 'gated' AND cell IN ('C2_development', 'C3_development')), false) AS qgated FROM dl JOIN rg ON rg.scorer = dl.candidate WHERE basis = 'simple' AND delta >= 0.02 AND low > 0),
b3 AS (SELECT d3.* FROM d3 JOIN bc ON scorer = candidate WHERE basis = 'simple'),
kl AS (SELECT unnest([{{'c': '{S.KILLS[0]}', 'h': NOT qany}}, {{'c': '{S.KILLS[1]}', 'h': (SELECT low <= 0.5 FROM iv JOIN bc USING (scorer) WHERE cell = 'C3_development')}},
  {{'c': '{S.KILLS[2]}', 'h': NOT qgated AND (SELECT max(concordance) FILTER (WHERE kind = 'shortcut') >= max(concordance) FILTER (WHERE family IN ('no_gate', 'gated')) FROM pr WHERE cell = 'C1_development')}},
  {{'c': '{S.KILLS[3]}', 'h': (SELECT delta < 0.01 OR low <= 0 FROM b3)}}, {{'c': '{S.KILLS[4]}', 'h': (SELECT x.concordance <= y.concordance FROM b3 JOIN ot x ON x.scorer = candidate JOIN ot y ON y.scorer = comparator)}},
  {{'c': '{S.KILLS[5]}', 'h': NOT (SELECT bool_or(eligible) FROM el)}}], recursive := true) FROM qd)"""


@query("al21_paired_bootstrap", f"{SQL} SELECT cell, scorer, round(concordance, 9) AS concordance, defined, round(low, 9) AS low, round(high, 9) AS high FROM iv JOIN pt USING (cell, scorer)")
def al21_hashed(spark, d):
    """Points and intervals of three cells and six scorers over a hundred replicates that SQL draws too."""
    rows = viewed_lines(spark, d)
    x = B.intervals(bootstrapped(rows, B.hashed_draws(SEED), REPLICATES)).join(point_metrics(rows), ["cell", "scorer"])
    return x.select("cell", "scorer", *[F.round(c, 9).alias(c) for c in ("concordance", "low", "high")], "defined")


def compared(spark, d):
    rows, registry = viewed_lines(spark, d), scorer_registry(spark)
    points = durable(point_metrics(rows), "points")
    spread = bootstrapped(rows, B.hashed_draws(SEED), REPLICATES)
    deltas = durable(B.paired_deltas(spread, points, S.comparisons(points, registry)), "deltas")
    return points, B.intervals(spread), deltas, registry


@query("al26_paired_deltas", f"{DELTAS} SELECT cell, candidate, comparator, basis, defined, round(delta, 9) AS delta, round(low, 9) AS low, round(high, 9) AS high, low > 0 AS excludes_zero FROM dl")
def al26_deltas(spark, d):
    """Complex candidates against the strongest simple scorer, the linear one and the one without a gate, from the same draws."""
    x = compared(spark, d)[2]
    return x.select("cell", "candidate", "comparator", "basis", "defined", *[F.round(c, 9).alias(c) for c in ("delta", "low", "high")], (F.col("low") > 0).alias("excludes_zero"))


@query("al26_selection_rules", f"""{RULES} SELECT 'selected' AS rule, scorer AS subject, true AS holds FROM sl UNION ALL SELECT 'eligible', candidate, eligible FROM el UNION ALL SELECT 'gate', candidate || ':' || c, h FROM gc UNION ALL SELECT 'kill', c, h FROM kl
UNION ALL SELECT 'disposition', CASE WHEN (SELECT bool_or(h) FROM kl) THEN '{S.DISPOSITIONS[0]}' WHEN (SELECT bool_and(h) FROM gc JOIN sl ON scorer = candidate) THEN '{S.DISPOSITIONS[1]}' ELSE '{S.DISPOSITIONS[2]}' END, true""")
def al26_rules(spark, d):
    """The selected candidate, who is eligible, the checks of gated candidates, the criteria that stop, and what follows."""
    points, spreads, deltas, registry = compared(spark, d)
    chosen, checks, kills = S.selected_candidate(points, registry), S.gate_checks(points, deltas, registry, VIEWS), S.kill_criteria(points, deltas, spreads, registry, VIEWS)
    row = lambda t, rule, subject, holds: t.select(F.lit(rule).alias("rule"), subject.alias("subject"), holds.alias("holds"))
    c, yes = F.col, F.lit(True)
    out = row(chosen, "selected", c("candidate"), yes).union(row(S.eligible_candidates(points, registry), "eligible", c("candidate"), c("eligible")))
    out = out.union(row(checks, "gate", F.concat_ws(":", "candidate", "check"), c("holds"))).union(row(kills, "kill", c("criterion"), c("fired")))
    return out.union(row(S.disposition(kills, checks, chosen), "disposition", c("disposition"), yes))
