"""Table contracts: types, required columns, closed vocabularies, primary and foreign keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract language's types and Spark's.
TYPES = {"string": "string", "int32": "int", "int64": "bigint", "float64": "double", "bool": "boolean", "list<string>": "array<string>"}


class ContractError(ValueError):
    pass


@dataclass
class Contract:
    """columns: name to type of TYPES, in order."""

    name: str
    columns: dict[str, str]
    required: tuple[str, ...] = ()
    vocabularies: dict[str, tuple[str, ...]] = field(default_factory=dict)
    key: tuple[str, ...] = ()

    def __post_init__(self):
        if odd := sorted(set(self.columns.values()) - set(TYPES)):
            raise ContractError(f"{self.name}: unknown types {odd}")

    def conform(self, df: DataFrame) -> DataFrame:
        """The columns in order and type; a missing one is null, an unknown one an error."""
        if unknown := sorted(set(df.columns) - set(self.columns)):
            raise ContractError(f"{self.name}: unknown columns {unknown}")
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(TYPES[t]).alias(c) for c, t in self.columns.items()])


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(check, column, violations) in one pass, and one more for the primary key."""
    checks = [("required", c, F.col(c).isNull()) for c in contract.required]
    checks += [("vocabulary", c, F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in contract.vocabularies.items()]
    spark, out = df.sparkSession, None
    if checks:
        one = df.agg(*[F.count_if(x).alias(f"c{i}") for i, (_, _, x) in enumerate(checks)])
        pieces = ", ".join(f"'{k}', '{c}', c{i}" for i, (k, c, _) in enumerate(checks))
        out = one.selectExpr(f"stack({len(checks)}, {pieces}) as (check, column, violations)")
    if contract.key:
        repeated = df.groupBy(*contract.key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        repeated = repeated.select(F.lit("primary_key").alias("check"), F.lit(",".join(contract.key)).alias("column"), "violations")
        out = repeated if out is None else out.union(repeated)
    return out if out is not None else spark.createDataFrame([], "check string, column string, violations long")


def assert_valid(df: DataFrame, contract: Contract) -> None:
    if bad := violations(df, contract).where("violations > 0").collect():  # a row for each check
        raise ContractError(f"{contract.name}: " + "; ".join(f"{r.check} {r.column}: {r.violations}" for r in bad))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The rows whose non-null foreign key has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def uniform(df: DataFrame, **values) -> DataFrame:
    """One row: for each column how many rows differ from the value given, nulls included."""
    return df.agg(*[F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(c) for c, v in values.items()])


def relation_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(state, rows) of two relations on a key: only_left, only_right, different, equal."""
    rest = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.struct(*rest).alias("l"))  # noqa: E741
    r = right.select(*keys, F.struct(*rest).alias("r"))
    state = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("l") == F.col("r"), "equal").otherwise("different")
    return l.join(r, keys, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


FORBIDDEN = ("pair_id", "evidence_id", "endpoint", "sequence")


def leaking_keys(document, forbidden: tuple[str, ...] = FORBIDDEN, at: str = "$") -> list[str]:
    """Paths in a public report whose keys name single records."""
    if isinstance(document, dict):
        own = [f"{at}.{k}" for k in document if any(f in k for f in forbidden)]
        return own + [x for k, v in document.items() for x in leaking_keys(v, forbidden, f"{at}.{k}")]
    if isinstance(document, list):
        return [x for i, v in enumerate(document) for x in leaking_keys(v, forbidden, f"{at}[{i}]")]
    return []


class Ledger:
    """Checks that are all made before any failure is reported."""

    def __init__(self):
        self.rows: list[dict] = []

    def check(self, name: str, passed: bool, detail: str = "", warning: bool = False) -> None:
        self.rows.append({"check": name, "status": "pass" if passed else "warning" if warning else "fail", "detail": detail})

    def verdict(self) -> str:
        states = {r["status"] for r in self.rows}
        return "fail" if "fail" in states else "warning" if "warning" in states else "pass"


def ensemble_census(scores: DataFrame, ensembles: dict[str, list[str]]) -> DataFrame:
    """(ensemble, rows, incomplete, unequal, largest): whether each ensemble's column is the mean of its members' columns, exactly.

    Rows where one of the columns is null or not finite are incomplete and not compared. A name listed twice among an ensemble's
    members, an ensemble without members or a column that is not there raises ValueError before anything runs.
    """
    for name, members in ensembles.items():
        if not members or len(set(members)) != len(members) or name in members:
            raise ValueError(f"members of {name}: {members}")
        if missing := {name, *members} - set(scores.columns):
            raise ValueError(f"no columns {sorted(missing)}")
    quoted = lambda c: F.col(f"`{c}`").cast("double")
    each = []
    for name, members in ensembles.items():
        values = [quoted(c) for c in (name, *members)]
        sound = reduce(lambda x, y: x & y, [F.coalesce(F.abs(v) < float("inf"), F.lit(False)) for v in values])
        gap = F.abs(values[0] - reduce(lambda x, y: x + y, values[1:]) / len(members))
        each.append(F.struct(F.lit(name).alias("ensemble"), sound.alias("sound"), gap.alias("gap")))
    x = scores.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    gap = F.when(F.col("sound"), F.col("gap"))
    return x.groupBy("ensemble").agg(F.count("*").alias("rows"), F.count_if(~F.col("sound")).alias("incomplete"), F.count_if(gap > 0).alias("unequal"), F.max(gap).alias("largest"))
