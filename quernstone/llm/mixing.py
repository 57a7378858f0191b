"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

The level that fills all sources is found in one pass over the sources in the order in which they reach their caps
(cap / weight), by running sums of caps and weights; integers throughout, so no order of additions matters.
A document is then repeated whole as often as its source's target holds its source, and once more if the
seeded hash of its id and text is among the lowest of its source, up to the words still missing. The cut is found
through sums over hash buckets, one bucket of each source being read to the group of equal rows, so no source, however large, is sorted or
gathered. The words by which that misses the target (half a document at most) are then made up by the one
document whose size comes nearest to them: it joins, or leaves, the repeated ones.

Rows that are equal in all columns are interchangeable. They are one group, of which the cut may take a part: such groups, two in a source at most,
are counted and given out again, so many rows with and so many without the further repetition.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own, the last; a source without words has target 0;
null and repeated ids are told apart by their texts, equal rows are taken one by one; an empty table gives an empty table.
Reruns agree: only the seed and the rows decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, durable

#: Weights by the sources' order, repeating; a source is taken so often at most.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Seed of the hash, and the leading hexadecimal digits that make a bucket.
SEED, BUCKET_DIGITS = "mix-1", 4
WIDE = "decimal(38,0)"


def sized(docs: DataFrame, text: str = "text", seed: str = SEED) -> DataFrame:
    """docs with size (words of the whole text) and key (hash of id and text)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.split(F.translate(whole, SPACES, " " * len(SPACES)), " ")
    return docs.withColumns({
        "size": F.size(F.filter(words, lambda w: w != "")).cast("long"),
        "key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(whole))),
    })


def row_hash(docs: DataFrame, names: list[str]):
    """A hash of all columns; those of a kind that Spark doesn't hash go in as JSON."""
    own = [F.to_json(F.struct(f"`{c}`")) if "map<" in docs.schema[c].dataType.simpleString() or "variant" in docs.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in names]
    return F.xxhash64(*own) if own else F.lit(0).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> with target (double): weighted shares of all sizes, none above epochs x source_size.

    One row for each source is all that meets in one task.
    """
    every, least = W.partitionBy(), 1
    for w in weights:
        least *= w
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    df = sizes.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * epochs).cast(WIDE).alias("cap"))
    df = df.withColumns({"total": F.sum(F.col("source_size").cast(WIDE)).over(every), "all_w": F.sum("w").over(every)})
    order = W.orderBy((F.col("cap") * F.lit(least).cast(WIDE) / F.col("w")).cast(WIDE), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    full = (F.col("total") - before("cap")) * F.col("w") >= F.col("cap") * (F.col("all_w") - before("w"))
    df = df.withColumn("full", full)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    left_w = F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((left * F.col("w")).cast("double") / left_w.cast("double"))
    return df.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target (of its source), copies (int) and taken (size x copies).

    Columns of docs with these five names give way, all others stay as they are, whatever their names.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    names = [c for c in docs.columns if c not in made]
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    docs = docs.select("doc_id", F.col(text).alias("__text"), F.col(source).cast("string").alias("__source"), row_hash(docs, names).alias("__same"), row)
    docs = sized(docs, "__text", seed).withColumn("__bucket", F.substring("key", 1, BUCKET_DIGITS))
    slim = docs.select(F.col("__source").alias("source"), F.col("__bucket").alias("bucket"), "key", F.col("__same").alias("same"), "size")
    # Groups of equal rows: m rows of size words each.
    slim = durable(slim.groupBy("source", "bucket", "key", "same", "size").agg(F.count("*").alias("m")), "mix-sizes")
    buckets = durable(slim.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("n")), "mix-buckets")
    plan = water_fill(buckets.groupBy("source").agg(F.sum("n").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = durable(plan, "mix-plan")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "missing")

    # The bucket of each source in which the running sum passes the missing words, and the sum before it.
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    edge = buckets.withColumn("upto", upto).join(p, same("source", "p_source")).where(F.col("upto") >= F.col("missing"))
    edge = edge.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "missing")).alias("e")).select(F.col("source").alias("e_source"), "e.*")
    edge = durable(edge, "mix-edge")
    # Within it, the rows of each group that are taken: the sum up to the middle of the last one isn't above the missing words.
    inside = slim.join(edge.withColumnRenamed("bucket", "e_bucket"), same("source", "e_source") & (F.col("bucket") == F.col("e_bucket")) & (F.col("size") > 0))
    upto = F.sum(F.col("size") * F.col("m")).over(W.partitionBy("e_source").orderBy("key", "same").rowsBetween(W.unboundedPreceding, -1))
    inside = inside.withColumn("before", F.col("before") + F.coalesce(upto, F.lit(0)))
    inside = inside.withColumn("part", F.least(F.col("m"), F.greatest(F.lit(0), F.floor((F.col("missing") - F.col("before")) / F.col("size") + 0.5))).cast("long"))
    last = inside.where("part > 0").groupBy("e_source").agg(F.max(F.struct("key", "same", "part")).alias("last"))
    cuts = p.join(edge.select("e_source", "bucket"), same("p_source", "e_source"), "left").drop("e_source").join(last, same("p_source", "e_source"), "left").drop("e_source")
    cuts = durable(cuts, "mix-cuts")

    # Rows of a group that are repeated once more: all before the last one taken, the part of that one, none behind it; where none in the edge bucket is, all below that bucket;
    # without an edge, all.
    group, end = F.struct("key", "same"), F.struct(F.col("last.key").alias("key"), F.col("last.same").alias("same"))
    below = F.when(F.col("last").isNotNull(), group < end).when(F.col("bucket").isNotNull(), F.substring("key", 1, BUCKET_DIGITS) < F.col("bucket")).otherwise(F.lit(True))
    more = F.when(F.col("missing") <= 0, F.lit(0)).when(F.col("last").isNotNull() & (group == end), F.col("last.part")).when(below, F.col("m")).otherwise(F.lit(0)).cast("long")
    blocks = slim.drop("bucket").join(cuts, same("source", "p_source")).withColumn("more", more)
    blocks = durable(blocks.select("source", "key", "same", "size", "m", "missing", "more"), "mix-blocks")
    gaps = blocks.groupBy("source", "missing").agg((F.col("missing") - F.sum(F.col("more") * F.col("size"))).alias("gap")).select(F.col("source").alias("g_source"), "gap")
    off = F.abs("gap")
    able = F.when(F.col("gap") < 0, F.col("more") > 0).otherwise(F.col("more") < F.col("m"))
    turned = blocks.join(gaps, same("source", "g_source")).where(able & (F.col("gap") != 0) & (F.col("missing") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * off))
    turn = F.struct(F.abs(off - F.col("size")).alias("rest"), "key", "same", (F.col("more") + F.signum("gap").cast("long")).alias("more"))
    turned = turned.groupBy("source").agg(F.min(turn).alias("turned")).select(F.col("source").alias("t_source"), "turned")
    cuts = durable(cuts.join(turned, same("p_source", "t_source"), "left").drop("t_source"), "mix-cuts")

    out = docs.select("__row", "size", "key", F.col("__same").alias("same"), "__source").join(cuts, same("__source", "p_source"))
    flipped = F.coalesce(group == F.struct(F.col("turned.key").alias("key"), F.col("turned.same").alias("same")), F.lit(False))
    at_end = F.coalesce(group == end, F.lit(False))
    parted = (flipped | at_end) & (F.col("missing") > 0)
    plain = out.where(~parted).withColumn("more", F.when(below & (F.col("missing") > 0), 1).otherwise(0))
    taken = F.when(flipped, F.col("turned.more")).otherwise(F.col("last.part"))
    made_of = ("size", "source_size", "target", "whole")
    few = out.where(parted).withColumn("more", taken).groupBy("__source", "key", "same", "more", *made_of).agg(F.any_value("__row").alias("__row"), F.count("*").alias("m"))
    few = few.select("__row", *made_of, "more", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("i")).withColumn("more", F.when(F.col("i") <= F.col("more"), 1).otherwise(0))
    columns = ("__row", *made_of, "more")
    out = plain.select(*columns).union(few.select(*columns)).withColumn("copies", F.col("whole") + F.col("more"))
    return out.select(*(F.col("__row")[c].alias(c) for c in names), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_MIX = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 3 AS cap FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
             coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before FROM w
      WINDOW o AS (ORDER BY cap * 10 // w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - cap_before) * w >= cap * (all_w - w_before) AS is_full FROM c),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
             ELSE CAST((total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) * w AS DOUBLE)
                  / CAST(all_w - coalesce(sum(w) FILTER (WHERE is_full) OVER (), 0) AS DOUBLE) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT id, doc_id, source, key, size AS n, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM d),
m AS (SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS missing FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, missing > 0 AND 2 * upto - n <= 2 * missing AS more FROM m),
g AS (SELECT source, missing - CAST(sum(CASE WHEN more THEN n ELSE 0 END) AS BIGINT) AS gap FROM b GROUP BY source, missing),
x AS (SELECT b.source, arg_min(id, {'rest': abs(abs(gap) - n), 'key': key, 'id': id}) AS turned FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source
      WHERE more = (gap < 0) AND missing > 0 AND n > 0 AND n < 2 * abs(gap) GROUP BY b.source)
SELECT b.doc_id, b.n AS size, b.source_size, b.target, b.n * (b.whole + CASE WHEN b.more <> (b.id IS NOT DISTINCT FROM x.turned) THEN 1 ELSE 0 END) AS taken
FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
