"""Scans and sinks (SC-*, SK-*): the readers that the test tables can feed; the formats have their own tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.durable import durable, shared_dir
from ..sources import archives, readers, sequences, sinks
from .contracts import ORDERS
from .registry import query
from .roles import table


def place(spark, name):
    return f"{shared_dir(spark)}/quernstone/{name}-{uuid.uuid4().hex}"


@query("sc01_parquet_scan", "SELECT r_regionkey, r_name FROM region")
def sc01(spark, d):
    return spark.read.schema("r_regionkey int, r_name string").parquet(f"{d}/region.parquet")


@query("sc02_file_list", "SELECT n_name AS name FROM nation UNION ALL SELECT n_name FROM nation")
def sc02(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet", f"{d}/nation.parquet").select(F.col("n_name").alias("name"))


@query("sc03_projection_and_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 30")
def sc03(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 30)).select("l_orderkey", "l_quantity")


@query("sc04_registered_rows", "SELECT code, n_name FROM (VALUES (1, 'one'), (2, 'two')) AS t(k, code) JOIN nation ON n_regionkey = k")
def sc04(spark, d):
    rows = spark.createDataFrame([(1, "one"), (2, "two")], "k int, code string")
    return table(spark, d, "nation").join(F.broadcast(rows), F.col("n_regionkey") == F.col("k")).select("code", "n_name")


@query("sc05_typed_tsv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sc05(spark, d):
    path = place(spark, "tsv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("sep", "\t").option("quote", "").csv(path)
    return readers.tsv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("sc08_pair_list", "SELECT least(x, y) AS a, greatest(x, y) AS b, x = y AS self_pair, count(*) AS n FROM (SELECT CAST(l_partkey AS VARCHAR) AS x, CAST(l_suppkey AS VARCHAR) AS y FROM lineitem) GROUP BY ALL")
def sc08(spark, d):
    path = place(spark, "pairs")
    table(spark, d, "lineitem").select(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).write.option("sep", "\t").csv(path)
    return readers.pair_list(spark, path).groupBy("a", "b", "self_pair").agg((F.max("occurrence") + 1).cast("long").alias("n"))


@query("sc11_fasta_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS header, repeat(upper(replace(p_name, ' ', '')), 9) AS sequence FROM part")
def sc11(spark, d):
    path = place(spark, "fasta")
    records = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("header"), F.repeat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), 9).alias("sequence"))
    sinks.fasta_lines(records).write.text(path)
    return readers.fasta(spark, path)


@query("sk01_05_contract_publish", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def sk01(spark, d):
    from dataclasses import replace

    path = place(spark, "published")
    loose = replace(ORDERS, vocabularies={}, key=("o_orderkey",))
    sinks.publish(table(spark, d, "orders").drop("o_orderdate"), path, loose, order=["o_orderkey"])
    return spark.read.parquet(path)


@query("sk06_manifest_rows", "SELECT count(*) AS rows FROM customer")
def sk06(spark, d):
    path = place(spark, "manifest")
    sinks.publish(table(spark, d, "customer"), path)
    return spark.createDataFrame([(sinks.manifest(spark, path)["rows"],)], "rows long")


ARCHIVED = "WITH m AS (SELECT l_orderkey % 16 AS archive, 'orders/' || l_orderkey || '.tsv' AS member, encode('line\tpart\tsupplier\n' || string_agg(l_linenumber || '\t' || l_partkey || '\t' || l_suppkey || '\n', '' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS payload FROM lineitem GROUP BY l_orderkey)"
MEMBER_COLUMNS = ["line", "part", "supplier"]


def order_archives(spark, d):
    """The folder of sixteen ZIP archives with a member for each order, its lines as a small table with a header."""
    path = place(spark, "archives")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    text = F.transform(F.sort_array(F.collect_list(line)), lambda x: F.concat(F.concat_ws("\t", x["l_linenumber"], x["l_partkey"], x["l_suppkey"]), F.lit("\n")))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("\t".join(MEMBER_COLUMNS) + "\n"), F.array_join(text, "")).alias("text"))
    sinks.zip_archives(orders.select((F.col("l_orderkey") % 16).alias("archive"), F.format_string("orders/%d.tsv", "l_orderkey").alias("member"), F.encode("text", "UTF-8").alias("payload")), path)
    return path


def archive_number():
    return F.regexp_extract("archive", r"(\d+)\.zip$", 1).cast("long").alias("archive")


@query("sc22_archive_members", f"{ARCHIVED} SELECT archive, member, octet_length(payload) AS size, sha256(payload) AS sha256 FROM m")
def sc22(spark, d):
    """Members of archives read by range, a task for about 64 kB of each: number of the archive, name, size and digest."""
    return archives.members(spark, order_archives(spark, d), split=2**16).select(archive_number(), "member", "size", "sha256")


@query("sc21_member_tables", f"{ARCHIVED} SELECT l_orderkey % 16 AS archive, 'orders/' || l_orderkey || '.tsv' AS member, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordinal, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supplier FROM lineitem")
def sc21(spark, d):
    """The rows of all members' tables, streamed from the archives with each member's header checked."""
    rows = archives.member_table(spark, order_archives(spark, d), r"\.tsv$", MEMBER_COLUMNS, split=2**16)
    return rows.select(archive_number(), "member", "ordinal", *MEMBER_COLUMNS)


@query("sk03_row_groups", "SELECT count(*) AS rows, min(l_orderkey) AS low, max(l_orderkey) AS high, true AS within, CAST(0 AS BIGINT) AS faults FROM lineitem")
def sk03(spark, d):
    """What the footers of an ordered table say: rows, bounds, whether row groups keep their size, and faults of order, numbering and schema."""
    path = place(spark, "row-groups")
    sinks.publish_ordered(table(spark, d, "lineitem"), path, ["l_orderkey", "l_linenumber"], rows_per_group=10_000)
    groups = sinks.footers(spark, path, "l_orderkey")
    faults = sinks.footer_faults(groups, 10_000).agg(F.count("*").alias("faults"))
    return groups.agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and(F.col("rows") <= 10_000).alias("within")).join(faults)


@query("sk04_positions", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem")
def sk04(spark, d):
    """A row's place in the order of the whole table: its place in its part behind the rows of earlier parts, which the footers count."""
    path = place(spark, "ordered")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sinks.publish_ordered(table(spark, d, "lineitem").select(*keys), path, keys, rows_per_group=100_000)
    return sinks.positions(spark, path, keys[0]).select(*keys, "position")


def staged_sequences(spark, d):
    """Parts as proteins, written as FASTA and flat files and read again: (canonical, additional, flat). Some keys are left out, changed or repeated, as ``PROTEINS`` says."""
    k, path = F.col("p_partkey"), place(spark, "proteins")
    part = table(spark, d, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("seq"))
    head = lambda db, name, of=F.lit(""): F.concat(F.lit(f"{db}|"), name, F.lit("|E"), k, F.lit("_X "), of, F.lit("Part "), k, F.lit(" OS=x OX=9606 GN=G"), k, F.lit(" PE=1 SV=2"))
    record = lambda db, name, seq, *of: F.struct(head(db, name, *of).alias("header"), seq.alias("sequence"))
    own = F.concat(F.lit("P"), k)
    canonical = part.select(F.explode(F.when(k % 83 == 7, F.array_repeat(record("sp", own, F.col("seq")), 2)).otherwise(F.array(record("sp", own, F.col("seq"))))).alias("r")).select("r.*")
    isoform_of = F.concat(F.lit("Isoform of "), F.when(k % 101 == 8, "X").otherwise("P"), k, F.lit("-1, "))
    additional = part.where(k % 4 == 0).select(record("sp", F.concat(F.lit("I"), k), F.concat("seq", F.lit("M")), isoform_of).alias("r")).union(part.where(k % 7 == 1).select(record("tr", F.concat(F.lit("A"), k), F.col("seq")).alias("r"))).select("r.*")
    seq = F.when(k % 89 == 3, F.concat("seq", F.lit("A"))).otherwise(F.col("seq"))
    flat = F.concat(F.lit("ID   E"), k, F.lit("_X   Reviewed;   "), F.length(seq), F.lit(" AA.\nAC   P"), k, F.lit(";\nGN   Name=G"), k, F.lit(";\nSQ   SEQUENCE\n     "), seq, F.lit("\n//"))
    for name, rows in (("canonical", sinks.fasta_lines(canonical)), ("additional", sinks.fasta_lines(additional)), ("flat", part.where(k % 97 != 5).select(flat.alias("value")))):
        rows.write.text(f"{path}/{name}")
    stated = lambda name: sequences.stated(readers.fasta(spark, f"{path}/{name}"))
    return stated("canonical"), stated("additional"), sequences.flat_entries(readers.flat_file(spark, f"{path}/flat"))


PROTEINS = "WITH p AS (SELECT p_partkey AS k, upper(replace(p_name, ' ', '')) AS seq FROM part)"


@query("sc14_sequence_faults", f"""{PROTEINS} SELECT 'P' || k AS sequence_id, 'absent_from_flat_file' AS fault FROM p WHERE k % 97 = 5 UNION ALL SELECT 'P' || k, 'sequence_mismatch' FROM p WHERE k % 89 = 3 AND k % 97 <> 5
UNION ALL SELECT 'P' || k, 'repeated_id' FROM p WHERE k % 83 = 7 UNION ALL SELECT 'I' || k, 'missing_parent' FROM p WHERE k % 4 = 0 AND (k % 101 = 8 OR k % 97 = 5)""")
def sc14_faults(spark, d):
    """What FASTA and flat files disagree about, row by row."""
    return sequences.sequence_faults(*staged_sequences(spark, d))


@query("sc14_loaded_sequences", f"""{PROTEINS}, bad AS (SELECT 'P' || k AS id FROM p WHERE k % 97 = 5 OR k % 89 = 3 OR k % 83 = 7), r AS (
SELECT 'P' || k AS sequence_id, 'P' || k AS uniprot_accession, CAST(NULL AS VARCHAR) AS isoform_id, 'canonical' AS sequence_view, k, seq FROM p
UNION ALL SELECT 'I' || k, CASE WHEN k % 101 = 8 THEN 'X' ELSE 'P' END || k, 'I' || k, 'additional_isoform', k, seq || 'M' FROM p WHERE k % 4 = 0
UNION ALL SELECT 'A' || k, 'A' || k, NULL, 'additional_non_isoform', k, seq FROM p WHERE k % 7 = 1)
SELECT sequence_id, uniprot_accession, isoform_id, 'E' || k || '_X' AS entry_name, sequence_view <> 'additional_non_isoform' AS reviewed, sequence_view = 'canonical' AS canonical, sequence_view, CAST(9606 AS BIGINT) AS taxid, 'G' || k AS gene_names,
CASE WHEN isoform_id IS NULL THEN '' ELSE 'Isoform of ' || uniprot_accession || '-1, ' END || 'Part ' || k AS protein_names, CAST(2 AS INTEGER) AS sequence_version, CAST(NULL AS INTEGER) AS entry_version, CAST(length(seq) AS BIGINT) AS sequence_length, seq AS sequence, sha256(seq) AS sequence_sha256 FROM r WHERE sequence_id NOT IN (SELECT id FROM bad)""")
def sc14_loaded(spark, d):
    """The relation after the accessions with faults that stop a load have been set aside in all three files."""
    c, a, f = (durable(x, "staged") for x in staged_sequences(spark, d))
    bad = durable(sequences.sequence_faults(c, a, f).where(~F.col("fault").isin(*sequences.REPORTED)).select("sequence_id").distinct(), "faults")
    without = lambda x, key: x.join(bad.select(F.col("sequence_id").alias(key)), key, "left_anti")
    rows = sequences.loaded_sequences(without(c, "sequence_id"), without(a, "sequence_id"), without(f, "accession"))
    return rows.withColumns({"gene_names": F.array_join("gene_names", ","), "protein_names": F.array_join("protein_names", ",")})
