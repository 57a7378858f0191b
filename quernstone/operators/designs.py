"""Sampling designs of every evaluation cell from the sizes of pools of nodes, and their samples by unranking: no pair is enumerated.

A pool is a partition's nodes of one training-degree bin. A stratum's pairs are those of two pools, or of one with itself, so they are numbered by
arithmetic, and a number gives its pair back. What grows with the tables is the places of nodes and the count of positives; all else is bounded by the
pools (ten) and the strata (54 at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import DEGREE_BINS, degree_bin, degree_pair_stratum
from .durable import discard, durable
from .geometry import exposed_cell
from .sampling import bottom_hash_sample, design, hamilton

BLOCK = 4096
#: A stratum's pairs are all listed while they are at most so many times its positives and its sample; beyond, numbers are drawn.
LISTED = 4

DESIGN = "cell string, stratum string, pool_x string, pool_y string, population long, positives long, unlabelled long, sample_size long, p_num long, p_den long"


def pool_of(partition: Column, degree: Column) -> Column:
    """The pool of a node; null for a training node that no training pair shows."""
    return F.when(partition != "train", partition).when(degree > 0, F.concat(F.lit("train/"), degree_bin(degree)))


def pool_places(nodes: DataFrame) -> DataFrame:
    """(pool, node, place): a node's place, from 0, in its pool in the order of names. nodes: node, partition, training_degree; a node stands once.

    Places come from range partitions and the sizes of those before; no task sees more than its range.
    """
    pooled = nodes.select(pool_of(F.col("partition"), F.col("training_degree")).alias("pool"), "node").where("pool is not null")
    laid = pooled.repartitionByRange("pool", "node").sortWithinPartitions("pool", "node")
    laid = durable(laid.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "pools")
    runs = laid.groupBy("part", "pool").agg(F.min("row").alias("first"), F.count("*").alias("k"))  # a row for each range and pool
    before = F.coalesce(F.sum("k").over(W.partitionBy("pool").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return laid.join(runs.select("part", "pool", "first", before.alias("before")), ["part", "pool"]).select("pool", "node", (F.col("before") + F.col("row") - F.col("first")).alias("place"))


def stratum_positives(positives: DataFrame) -> DataFrame:
    """Positive pairs of each cell and stratum. positives: qa, qb, da, db, the partitions and training degrees of the ends."""
    cell = exposed_cell(F.col("qa"), F.col("qb"), F.col("da"), F.col("db"))
    return positives.select(cell.alias("cell"), degree_pair_stratum(F.col("da"), F.col("db")).alias("stratum")).where("cell is not null").groupBy("cell", "stratum").agg(F.count("*").alias("positives"))


def cell_designs(places: DataFrame, positives: DataFrame, cap: int) -> DataFrame:
    """A row for each cell and stratum that has pairs: population, positives, unlabelled rest, sample size of at most ``cap`` a cell and inclusion probability.

    The sizes of pools and the positives of strata meet on the driver: ten rows and 54. More positives than pairs are an error.
    """
    spark = places.sparkSession
    sizes = {r.pool: r.n for r in places.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    known = {(r.cell, r.stratum): r.positives for r in stratum_positives(positives).collect()}
    bins = [label for _, label in sorted(DEGREE_BINS) if f"train/{label}" in sizes]
    held = [p for p in sizes if not p.startswith("train/")]
    strata = [("C1", f"{x}|{y}", f"train/{x}", f"train/{y}") for i, x in enumerate(bins) for y in bins[i:]]
    strata += [(f"C2/{p}", f"0|{y}", p, f"train/{y}") for p in held for y in bins] + [(f"C3/{p}", "0|0", p, p) for p in held]
    rows = {}
    for cell, stratum, x, y in strata:
        n = sizes[x] * (sizes[x] - 1) // 2 if x == y else sizes[x] * sizes[y]
        if n:
            rows[cell, stratum] = [cell, stratum, x, y, n, known.pop((cell, stratum), 0)]
    if known or any(r[5] > r[4] for r in rows.values()):
        raise ValueError("more positive pairs than pairs in a stratum")
    seats = {}
    for cell in {c for c, _ in rows}:
        rest = {s: r[4] - r[5] for (c, s), r in rows.items() if c == cell and r[4] > r[5]}
        seats |= {(cell, s): k for s, k in hamilton(rest, cap).items()}
    out = []
    for key, r in rows.items():
        n, rest = seats.get(key, 0), r[4] - r[5]
        out.append((*r, rest, n, *(design(rest, n)[:2] if n else (0, 1))))
    return spark.createDataFrame(out, DESIGN)


def pair_places(number: Column, same: Column, width: Column) -> tuple[Column, Column]:
    """The places of a pair's ends from its number: by rows of ``width``, or among the pairs i < j of one pool, j (j - 1) / 2 + i. Numbers up to 2^59."""
    guess = F.floor((1 + F.sqrt(8 * number.cast("double") + 1)) / 2).cast("long")
    below = lambda j: F.shiftright(j * (j - 1), 1)
    j = F.when(below(guess) > number, guess - 1).when(below(guess + 1) <= number, guess + 1).otherwise(guess)
    return F.when(same, number - below(j)).otherwise(F.call_function("div", number, width)), F.when(same, j).otherwise(number % width)


def _numbers(designs: DataFrame, salt: str, factor: int) -> DataFrame:
    """Numbers of pairs with their keys: all of a listed stratum with a digest each, else drawn ones with the first draw that gave them."""
    listed = F.col("population") <= LISTED * (F.col("sample_size") + F.col("positives"))
    wanted = F.when(listed, F.col("population")).otherwise(factor * F.col("sample_size") + 64)
    d = designs.where("sample_size > 0").select("cell", "stratum", "pool_x", "pool_y", "population", "unlabelled", "sample_size", listed.alias("listed"), wanted.alias("wanted"))
    blocks = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(wanted - 1) div {BLOCK}")))).repartition("cell", "stratum", "block")
    at = F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("wanted"), (F.col("block") + 1) * BLOCK) - 1))
    rows = blocks.withColumn("draw", at)
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit(salt), "cell", "stratum", F.col("draw").cast("string")), 256))
    number = F.when(F.col("listed"), F.col("draw")).otherwise(F.conv(F.substring("h", 1, 15), 16, 10).cast("long") % F.col("population"))
    key = F.when(F.col("listed"), F.col("h")).otherwise(F.format_string("%020d", "draw"))
    rows = rows.withColumns({"number": number, "key": key})
    return rows.groupBy("cell", "stratum", "number").agg(F.min("key").alias("key"), *[F.any_value(c).alias(c) for c in ("pool_x", "pool_y", "population", "unlabelled", "sample_size", "listed")])


def unranked_sample(designs: DataFrame, places: DataFrame, positives: DataFrame, salt: str) -> DataFrame:
    """The samples of ``cell_designs``: cell, stratum, a, b, sample_rank, unlabelled, sample_size; unlabelled pairs, uniform and without repetition.

    A stratum that is mostly positives or sample is listed and takes the least digests; of others numbers are drawn one after the other, repeated and positive ones
    passed over, and where the draws don't reach they are doubled, which changes none of the earlier ones. Reruns agree. positives: a, b.
    """
    spark: SparkSession = designs.sparkSession
    sizes = places.groupBy("pool").agg(F.count("*").alias("width")).select(F.col("pool").alias("pool_y"), "width")
    factor = 3
    while True:
        numbers = _numbers(designs, salt, factor).join(F.broadcast(sizes), "pool_y")  # ten rows
        x, y = pair_places(F.col("number"), F.col("pool_x") == F.col("pool_y"), F.col("width"))
        ends = numbers.withColumns({"place_x": x, "place_y": y})
        ends = ends.join(places.toDF("pool_x", "node_x", "place_x"), ["pool_x", "place_x"]).join(places.toDF("pool_y", "node_y", "place_y"), ["pool_y", "place_y"])
        pairs = ends.withColumns({"a": F.least("node_x", "node_y"), "b": F.greatest("node_x", "node_y")})
        free = durable(pairs.join(positives.select("a", "b"), ["a", "b"], "left_anti").select("cell", "stratum", "a", "b", "key", "unlabelled", "sample_size", "listed"), "unranked")
        if free.where("not listed").groupBy("cell", "stratum").agg((F.count("*") < F.any_value("sample_size")).alias("short")).where("short").isEmpty():
            break
        discard(free)
        factor *= 2
    stratum = F.concat_ws("|", "cell", "stratum").alias("of")
    listed = designs.select(stratum, F.col("unlabelled").alias("population"), "sample_size").where("sample_size > 0")
    least = bottom_hash_sample(free.where("listed").select(stratum, "cell", "stratum", "a", "b", "key", "unlabelled"), listed, "of", "key", ["a", "b"])
    rank = F.row_number().over(W.partitionBy("cell", "stratum").orderBy("key"))  # a few times the sample's size
    drawn = free.where("not listed").withColumn("sample_rank", rank).where("sample_rank <= sample_size")
    columns = ["cell", "stratum", "a", "b", "sample_rank", "unlabelled", "sample_size"]
    return least.select(*columns).unionByName(drawn.select(*columns))
