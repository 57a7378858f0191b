"""Selection of a candidate and the rules that keep or stop it, from point metrics, paired differences and intervals (AL-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The primary cells in the order of selection, the limits of differences and ranges, and the names of the criteria.
PRIMARY = ("C3_development", "C2_development", "C1_development")
GAINS = {"simple": 0.02, "linear": 0.01, "no_gate": 0.005}
RANGE, QUANTUM_DIGITS, EXPLAINED, CHANCE = 0.02, 3, 0.01, 0.5
KILLS = (
    "no_complex_candidate_C3_gain_0_02_with_positive_interval", "best_complex_C3_lower_bound_not_above_0_5", "shortcut_explains_C1_and_no_qualifying_C2_or_C3",
    "interolog_or_linear_explains_complex_C3", "gain_absent_outside_top_10_percent_hubs", "all_candidates_ineligible_or_failed",
)
DISPOSITIONS = ("stop_complex_model_claim_and_stop_before_protected_evaluation", "advance_frozen_partner_gated_scorer_toward_separate_protected_authorization", "retain_only_simpler_frozen_baseline")

#: Columns of the registry of scorers: kind is shortcut, simple, member or candidate; members name their candidate, candidates their family and recipe.
REGISTRY = "scorer string, kind string, candidate string, family string, recipe string, complexity int"
SIMPLE = "kind = 'simple' or family = 'linear'"
COMPLEX = "kind = 'candidate' and family in ('no_gate', 'gated')"


def best(of: Column) -> Column:
    """The scorer of the highest concordance among those of a condition, of equal ones the first name."""
    return F.min_by("scorer", F.when(of, F.struct(-F.col("concordance"), F.col("scorer"))))


def seed_ranges(points: DataFrame, registry: DataFrame) -> DataFrame:
    """(candidate, cell, spread, steady): the range of the members' concordance in each primary cell."""
    members = points.where(F.col("cell").isin(*PRIMARY)).join(registry.where("kind = 'member'").select("scorer", "candidate"), "scorer")
    spread = F.max("concordance") - F.min("concordance")
    return members.groupBy("candidate", "cell").agg(spread.alias("spread"), (spread <= RANGE).alias("steady"))


def eligible_candidates(points: DataFrame, registry: DataFrame) -> DataFrame:
    """(candidate, eligible): steady in every primary cell; a candidate without members in one of them isn't."""
    r = seed_ranges(points, registry).groupBy("candidate").agg((F.bool_and("steady") & (F.count("*") == len(PRIMARY))).alias("ok"))
    named = registry.where("kind = 'candidate'").select(F.col("scorer").alias("candidate"))
    return named.join(r, "candidate", "left").select("candidate", F.coalesce("ok", F.lit(False)).alias("eligible"))


def selected_candidate(points: DataFrame, registry: DataFrame) -> DataFrame:
    """(candidate) of at most one row: highest C3, then C2, then C1 in thousandths rounded half up, then the less complex, then the id."""
    c = registry.where("kind = 'candidate'").select("scorer", "complexity").join(points, "scorer")
    at = lambda cell: F.max(F.when(F.col("cell") == cell, -F.round(F.col("concordance").cast("decimal(18,9)"), QUANTUM_DIGITS)))
    keys = c.groupBy(F.col("scorer").alias("candidate"), "complexity").agg(*[at(p).alias(p) for p in PRIMARY])
    free = keys.join(eligible_candidates(points, registry).where("eligible"), "candidate")
    return free.agg(F.min_by("candidate", F.struct(*PRIMARY, "complexity", "candidate")).alias("candidate")).where("candidate is not null")


def comparisons(points: DataFrame, registry: DataFrame) -> DataFrame:
    """(cell, candidate, comparator, basis): complex candidates against the best simple scorer of each primary cell; in C3 the gated
    ones against the best linear one and the one of their recipe without a gate as well."""
    p = points.where(F.col("cell").isin(*PRIMARY)).join(registry.drop("candidate"), "scorer")
    strongest = p.groupBy("cell").agg(best(F.expr(SIMPLE)).alias("simple"), best(F.col("family") == "linear").alias("linear"))
    own = p.where(COMPLEX).select("cell", F.col("scorer").alias("candidate"), "family", "recipe")
    twins = registry.where("family = 'no_gate'").select("recipe", F.col("scorer").alias("no_gate"))
    rows = own.join(strongest, "cell").join(twins, "recipe", "left")
    gated = (F.col("family") == "gated") & (F.col("cell") == PRIMARY[0])
    each = [F.struct(F.lit(b).alias("basis"), (F.col(b) if b == "simple" else F.when(gated, F.col(b))).alias("comparator")) for b in GAINS]
    return rows.select("cell", "candidate", F.explode(F.array(*each)).alias("x")).select("cell", "candidate", "x.comparator", "x.basis").where("comparator is not null")


def wide_gain(least: float) -> Column:
    return (F.col("delta") >= least) & (F.col("low") > 0)


def gate_checks(points: DataFrame, deltas: DataFrame, registry: DataFrame, views: dict) -> DataFrame:
    """(candidate, check, holds) of every gated candidate; it is retained if all hold.

    ``views`` names the cells of the sources' own C3 and of C3 outside hubs: {"sources": [...], "outside": ...}.
    """
    gated = registry.where("family = 'gated' and kind = 'candidate'").select(F.col("scorer").alias("candidate"))
    d = gated.join(deltas.where(F.col("cell") == PRIMARY[0]), "candidate")
    of = lambda b, what: F.coalesce(F.bool_or(F.when(F.col("basis") == b, what)), F.lit(False))
    checks = d.groupBy("candidate").agg(
        *[x for b, g in GAINS.items() for x in (of(b, F.col("delta") >= g).alias(f"{b}_gain"), of(b, F.col("low") > 0).alias(f"{b}_interval"))],
        F.max(F.when(F.col("basis") == "simple", F.col("comparator"))).alias("simple"),
    )
    p = points.join(registry.drop("candidate"), "scorer")
    seen = p.where(F.col("cell").isin(*views["sources"])).groupBy("cell").agg(F.max(F.when(F.expr(SIMPLE), F.col("concordance"))).alias("simple_point"))
    own = points.select("cell", F.col("scorer").alias("candidate"), F.col("concordance").alias("own"))
    direction = seen.join(own, "cell").groupBy("candidate").agg(F.bool_or(F.col("own") > F.col("simple_point")).alias("source_direction"))
    outside = own.where(F.col("cell") == views["outside"]).select("candidate", "own")
    base = outside.toDF("simple", "base")
    wide = checks.join(direction, "candidate", "left").join(outside, "candidate", "left").join(base, "simple", "left").join(eligible_candidates(points, registry), "candidate")
    wide = wide.withColumn("outside_hubs", F.col("own") > F.col("base")).withColumnRenamed("eligible", "seed_ranges")
    names = [f"{b}_{x}" for b in GAINS for x in ("gain", "interval")] + ["source_direction", "outside_hubs", "seed_ranges"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(n, F.lit(False)).alias("holds")) for n in names]))
    return wide.select("candidate", rows.alias("x")).select("candidate", "x.check", "x.holds")


def kill_criteria(points: DataFrame, deltas: DataFrame, spreads: DataFrame, registry: DataFrame, views: dict) -> DataFrame:
    """(criterion, fired) for the criteria that data decide; one that fires stops the evaluation. What is undefined counts as failed."""
    c3, c2, c1 = PRIMARY
    p = points.join(registry.drop("candidate"), "scorer").withColumn("complex", F.expr(COMPLEX))
    most = lambda of: F.max(F.when(of, F.col("concordance")))
    in1 = F.col("cell") == c1
    head = p.agg(
        F.lit(c3).alias("cell"), best(F.col("complex") & (F.col("cell") == c3)).alias("candidate"),
        F.coalesce(most(in1 & (F.col("kind") == "shortcut")) >= most(in1 & F.col("complex")), F.lit(True)).alias("shortcut"),
    )
    d = deltas.where("basis = 'simple'").join(registry.select(F.col("scorer").alias("candidate"), "family"), "candidate")
    wide, gated = wide_gain(GAINS["simple"]), F.col("family") == "gated"
    some = d.agg(
        F.lit(c3).alias("cell"), F.coalesce(F.bool_or(wide & (F.col("cell") == c3)), F.lit(False)).alias("any"),
        F.coalesce(F.bool_or(wide & gated & F.col("cell").isin(c2, c3)), F.lit(False)).alias("gated_any"),
    )
    own = points.where(F.col("cell") == views["outside"])
    row = head.join(some, "cell").join(spreads.select("cell", F.col("scorer").alias("candidate"), F.col("low").alias("bound")), ["cell", "candidate"], "left")
    row = row.join(deltas.where("basis = 'simple'").select("cell", "candidate", "comparator", "delta", "low"), ["cell", "candidate"], "left")
    row = row.join(own.select(F.col("scorer").alias("candidate"), F.col("concordance").alias("x")), "candidate", "left").join(own.select(F.col("scorer").alias("comparator"), F.col("concordance").alias("y")), "comparator", "left")
    free = eligible_candidates(points, registry).agg(F.lit(c3).alias("cell"), F.coalesce(F.bool_or("eligible"), F.lit(False)).alias("free"))
    sure = lambda x: F.coalesce(x, F.lit(True))
    fired = (
        ~F.col("any"), sure(F.col("bound") <= CHANCE), F.col("shortcut") & ~F.col("gated_any"), sure((F.col("delta") < EXPLAINED) | (F.col("low") <= 0)),
        sure(F.col("x") <= F.col("y")), ~F.col("free"),
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), f.alias("fired")) for n, f in zip(KILLS, fired)]))
    return row.join(free, "cell").select(rows.alias("x")).select("x.criterion", "x.fired")


def disposition(kills: DataFrame, checks: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: stop if a criterion fired, advance if the selected candidate's gate is retained, else keep the simpler one."""
    kept = checks.groupBy("candidate").agg(F.bool_and("holds").alias("kept")).join(selected, "candidate").agg(F.lit(1).alias("k"), F.coalesce(F.bool_or("kept"), F.lit(False)).alias("advance"))
    stop = kills.agg(F.lit(1).alias("k"), F.bool_or("fired").alias("stop"))
    return stop.join(kept, "k").select(F.when(F.col("stop"), DISPOSITIONS[0]).when(F.col("advance"), DISPOSITIONS[1]).otherwise(DISPOSITIONS[2]).alias("disposition"))
