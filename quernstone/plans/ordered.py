"""Windows, top-k and sorts (WN-*, TK-*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.graph import hubs
from ..operators.sampling import bottom_hash_sample, hamilton_table
from .registry import query
from .roles import GRAPH, PD, STRATUM, degrees, positive_pairs, table, with_degrees
from ..functions.identity import degree_pair_stratum

SAMPLE = f"""{GRAPH}, {PD}, st AS (SELECT a, b, {STRATUM} AS stratum, sha256(a || '|' || b) AS h FROM pd),
sz AS (SELECT stratum, count(*) AS population FROM st GROUP BY ALL),
q AS (SELECT *, sum(population) OVER () AS total, count(*) OVER () AS n FROM sz),
w AS (SELECT *, CAST(((500 - n) * (population - 1)) // greatest(total - n, 1) + 1 AS BIGINT) AS whole, ((500 - n) * (population - 1)) % greatest(total - n, 1) AS rest FROM q),
s AS (SELECT stratum, population, CAST(CASE WHEN total <= 500 THEN population ELSE whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 500 - sum(whole) OVER () THEN 1 ELSE 0 END END AS BIGINT) AS sample_size FROM w)"""


def sized_strata(spark, d):
    p = positive_pairs(spark, d)
    st = with_degrees(p, degrees(p)).select("a", "b", degree_pair_stratum(F.col("da"), F.col("db")).alias("stratum"), F.sha2(F.concat("a", F.lit("|"), "b"), 256).alias("h"))
    return st, hamilton_table(st.groupBy("stratum").agg(F.count("*").alias("population")), "stratum", "population", 500)


@query("al12_13_hamilton_design", f"{SAMPLE} SELECT stratum, population, sample_size, CAST(sample_size // gcd(population, sample_size) AS BIGINT) AS p_num, CAST(population // gcd(population, sample_size) AS BIGINT) AS p_den FROM s")
def al12(spark, d):
    from ..operators.sampling import design

    _, sizes = sized_strata(spark, d)
    rows = [(r.stratum, r.population, r.sample_size, *design(r.population, r.sample_size)[:2]) for r in sizes.collect()]  # a row for each stratum, 45 at most
    return spark.createDataFrame(rows, "stratum string, population long, sample_size long, p_num long, p_den long")


@query("wn01_al15_bottom_hash_sample", f"{SAMPLE}, r AS (SELECT st.*, population, sample_size, row_number() OVER (PARTITION BY stratum ORDER BY h, a, b) AS sample_rank FROM st JOIN s USING (stratum)) SELECT stratum, a, b, population, sample_size, CAST(sample_rank AS INTEGER) AS sample_rank FROM r WHERE sample_rank <= sample_size")
def wn01(spark, d):
    st, sizes = sized_strata(spark, d)
    return bottom_hash_sample(st, sizes, "stratum", "h", ["a", "b"]).select("stratum", "a", "b", "population", "sample_size", "sample_rank")


@query("al16_sample_proof", f"{SAMPLE}, r AS (SELECT st.*, population, sample_size, row_number() OVER (PARTITION BY stratum ORDER BY h, a, b) AS k FROM st JOIN s USING (stratum)), m AS (SELECT stratum, max(h) AS edge FROM r WHERE k <= sample_size GROUP BY ALL) SELECT stratum, any_value(sample_size) AS sample_size, count_if(h <= edge) AS at_or_below, count(*) AS population FROM r JOIN m USING (stratum) GROUP BY stratum")
def al16(spark, d):
    st, sizes = sized_strata(spark, d)
    edge = bottom_hash_sample(st, sizes, "stratum", "h", ["a", "b"]).groupBy("stratum").agg(F.max("h").alias("edge"), F.any_value("sample_size").alias("sample_size"))
    return st.join(F.broadcast(edge), "stratum").groupBy("stratum").agg(F.any_value("sample_size").alias("sample_size"), F.count_if(F.col("h") <= F.col("edge")).alias("at_or_below"), F.count("*").alias("population"))


@query("wn02_group_filters", "WITH a AS (SELECT l_orderkey, l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 5), b AS (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS any_r FROM a), c AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS k FROM b WHERE any_r = 1), e AS (SELECT *, max(k) OVER (PARTITION BY l_orderkey) AS suppliers FROM c) SELECT (SELECT count(*) FROM a) AS s1, (SELECT count(*) FROM c) AS s2, (SELECT count(*) FROM e WHERE suppliers >= 2) AS s3")
def wn02(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 5").select("l_orderkey", "l_suppkey", "l_returnflag")
    g = W.partitionBy("l_orderkey")
    b = a.withColumn("any_r", F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(g))
    c = b.withColumn("suppliers", F.size(F.collect_set("l_suppkey").over(g)))
    return c.agg(F.count("*").alias("s1"), F.count_if(F.col("any_r") == 1).alias("s2"), F.count_if((F.col("any_r") == 1) & (F.col("suppliers") >= 2)).alias("s3"))


@query("wn05_member_rank", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS member_rank FROM part")
def wn05(spark, d):
    return table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("member_rank"))


@query("wn06_hubs", f"{GRAPH} SELECT node, degree FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS r, count(*) OVER () AS n FROM dg) WHERE r <= ceil(0.05 * n)")
def wn06(spark, d):
    return hubs(degrees(positive_pairs(spark, d)), 5)


@query("wn07_cumulative_weight", "SELECT l_discount, round(sum(w) OVER (ORDER BY l_discount), 3) AS upto FROM (SELECT l_discount, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)")
def wn07(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_discount").agg(F.sum("l_quantity").alias("w"))
    return g.select("l_discount", F.round(F.sum("w").over(W.orderBy("l_discount").rowsBetween(W.unboundedPreceding, 0)), 3).alias("upto"))


@query("wn10_greedy_packing", """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations),
w AS (SELECT conv_id, turn, i, 0 AS batch, n AS held FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN held > 0 AND held + t.n > 600 THEN batch + 1 ELSE batch END, CASE WHEN held > 0 AND held + t.n > 600 THEN t.n ELSE held + t.n END FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)
SELECT conv_id, turn, batch FROM w""")
def wn10(spark, d):
    """Batches of a conversation's turns by running length, a new one where the next turn would overflow 600 characters."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))
    def step(s, x):
        full = (s["held"] > 0) & (s["held"] + x["n"] > 600)
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(batch.alias("batch"), F.when(full, x["n"]).otherwise(s["held"] + x["n"]).alias("held"), F.array_append(s["out"], batch).alias("out"))
    packed = turns.select("conv_id", F.arrays_zip(F.transform("t", lambda x: x["turn"]).alias("turn"), F.aggregate("t", start, step)["out"].alias("batch")).alias("z"))
    return packed.select("conv_id", F.inline("z")).toDF("conv_id", "turn", "batch")


@query("wn11_sequence_windows", "SELECT doc_id, unnest(CASE WHEN n_chars <= 1022 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, n_chars - 1022 + 1, 894), [n_chars - 1022]))) END) AS start FROM documents")
def wn11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.window_starts(F.col("n_chars"), 1022, 894).cast("array<bigint>")).alias("start"))


@query("wn12_segments", "WITH k AS (SELECT doc_id, n_chars, greatest(1, least(32, CAST(ceil(n_chars / 128) AS INTEGER))) AS n FROM documents) SELECT doc_id, CAST(i * n_chars // n AS INTEGER) AS s, CAST((i + 1) * n_chars // n AS INTEGER) AS e FROM k, LATERAL (SELECT unnest(range(0, n)) AS i)")
def wn12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(X.segments(F.col("n_chars")))).toDF("doc_id", "s", "e")


@query("wn13_deterministic_order", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(concat_ws('|', 'seed1', c_custkey)), c_custkey) AS INTEGER) AS place FROM customer")
def wn13(spark, d):
    h = F.sha2(F.concat_ws("|", F.lit("seed1"), "c_custkey"), 256)
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy(h, "c_custkey")).alias("place"))


@query("tk01_total_order", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def tk01(spark, d):
    return table(spark, d, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("tk02_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def tk02(spark, d):
    r = F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").withColumn("r", r).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("tk03_top_four_mean", "SELECT vec_id, round(list_sum(list_reverse_sort(embedding::DOUBLE[])[1:4]) / 4, 9) AS top4 FROM embeddings")
def tk03(spark, d):
    top = F.slice(F.sort_array(F.col("embedding").cast("array<double>"), asc=False), 1, 4)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / 4, 9).alias("top4"))


@query("tk04_05_lexicographic_best", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice, p_partkey LIMIT 1")
def tk04(spark, d):
    return table(spark, d, "part").agg(F.min(F.struct("p_size", "p_retailprice", "p_partkey")).alias("m")).select("m.p_partkey", "m.p_size", "m.p_retailprice")


@query("tk06_salted_order", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY sha256('salt' || n_name), n_nationkey) AS INTEGER) AS place FROM nation")
def tk06(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(W.orderBy(F.sha2(F.concat(F.lit("salt"), "n_name"), 256), "n_nationkey")).alias("place"))


@query("tk07_cyclic_permutation", "SELECT n_nationkey, (7 + n_nationkey * 4) % 25 AS place FROM nation")
def tk07(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.pmod(7 + F.col("n_nationkey") * 4, F.lit(25)).alias("place"))
