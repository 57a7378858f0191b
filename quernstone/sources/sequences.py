"""Loading protein sequences from FASTA files and the flat file that must agree with them: one relation, or none where they don't.

Every disagreement is a row (sequence_id, fault), found by one full outer join of digests, so sequences themselves don't move for it:

* absent_from_flat_file, absent_from_canonical: an accession that only one of both has
* sequence_mismatch: equal accessions with different sequences
* repeated_id: an id that stands twice among canonical and additional sequences
* repeated_record: an accession that two flat records begin with
* malformed_header, empty_sequence: a FASTA record that can't be a row
* missing_parent: an isoform whose parent accession no flat record has; reported, not failing
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the public format says of what a sequence is an isoform.
ISOFORM_OF = r"\bIsoform of ([A-Z0-9]+(?:-\d+)?)\b"

#: Faults that don't stop a load: the flat file may hold more than the canonical set, and parents may be retired.
REPORTED = ("missing_parent", "absent_from_canonical")


def stated(records: DataFrame) -> DataFrame:
    """What FASTA headers state, with the digest: sequence_id, parent, parent_as_reported, isoform_id, entry_name, reviewed, taxid, gene, sequence_version, protein_name, sequence, sequence_sha256.

    ``records``: header and sequence, as ``readers.fasta`` has them. A description that says "Isoform of" an accession makes an isoform of it,
    parent_as_reported with its suffix; any other sequence is its own parent. A header without three fields has a null sequence_id.
    """
    take = lambda p, c="rest": F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit(""))
    fields = F.split("header", r"\|", 3)
    df = records.withColumns({"database": F.get(fields, F.lit(0)), "sequence_id": F.nullif(F.when(F.size(fields) == 3, F.get(fields, F.lit(1))), F.lit("")), "rest": F.coalesce(F.get(fields, F.lit(2)), F.lit(""))})
    df = df.withColumn("reported", take(ISOFORM_OF))
    isoform = F.col("reported").isNotNull()
    return df.select(
        "sequence_id", F.when(isoform, F.split_part("reported", F.lit("-"), F.lit(1))).otherwise(F.col("sequence_id")).alias("parent"), F.col("reported").alias("parent_as_reported"), F.when(isoform, F.col("sequence_id")).alias("isoform_id"),
        take(r"^(\S+)").alias("entry_name"), (F.col("database") == "sp").alias("reviewed"), take(r"\bOX=(\d+)").cast("long").alias("taxid"), take(r"\bGN=([^=]+?)(?=\s[A-Z]{2}=|$)").alias("gene"), take(r"\bSV=(\d+)").cast("int").alias("sequence_version"),
        take(r"^\S+\s+(.*?)(?:\sOS=.*)?$").alias("protein_name"), "sequence", F.sha2("sequence", 256).alias("sequence_sha256"),
    )


def flat_entries(records: DataFrame) -> DataFrame:
    """One row for each flat record's first accession, with its digest and fields; null accessions and repetitions stay."""
    return records.select(F.get("accessions", F.lit(0)).alias("accession"), "entry_name", "reviewed", "taxid", "all_gene_names", "protein_names", "entry_version", "sequence_version", F.sha2("sequence", 256).alias("sequence_sha256"))


def sequence_faults(canonical: DataFrame, additional: DataFrame, flat: DataFrame) -> DataFrame:
    """(sequence_id, fault) of ``stated`` canonical and additional sequences against ``flat_entries``; each fault of an id once."""
    fault = lambda name, when: F.when(when, F.lit(name))
    of_flat = flat.where("accession is not null").groupBy(F.col("accession").alias("sequence_id")).agg(F.count("*").alias("records"), F.array_agg("sequence_sha256").alias("flat_shas"))
    ids = canonical.select("sequence_id", "sequence_sha256", F.lit(True).alias("canonical"), F.lit(None).cast("string").alias("parent")).unionByName(
        additional.select("sequence_id", "sequence_sha256", F.lit(False).alias("canonical"), F.when(F.col("isoform_id").isNotNull(), F.col("parent")).alias("parent")))
    per_id = ids.where("sequence_id is not null").groupBy("sequence_id").agg(
        F.count("*").alias("times"), F.bool_or("canonical").alias("canonical"), F.min(F.when(F.col("canonical"), F.col("sequence_sha256"))).alias("low"), F.max(F.when(F.col("canonical"), F.col("sequence_sha256"))).alias("high"))
    met = per_id.join(of_flat, "sequence_id", "full_outer")
    is_canonical, has_flat = F.coalesce("canonical", F.lit(False)), F.col("records").isNotNull()
    # a repeated record or id agrees if all its sequences do
    unlike = (F.col("low") != F.col("high")) | F.exists("flat_shas", lambda s: s != F.col("low"))
    found = F.array_compact(F.array(
        fault("absent_from_flat_file", is_canonical & ~has_flat), fault("absent_from_canonical", ~is_canonical & has_flat), fault("sequence_mismatch", is_canonical & has_flat & unlike),
        fault("repeated_id", F.col("times") > 1), fault("repeated_record", F.col("records") > 1)))
    rows = met.select("sequence_id", F.explode(found).alias("fault"))
    orphans = ids.where("parent is not null").join(of_flat.select(F.col("sequence_id").alias("parent")), "parent", "left_anti").select("sequence_id", F.lit("missing_parent").alias("fault"))
    every = canonical.select("sequence_id", "sequence").unionByName(additional.select("sequence_id", "sequence"))
    single = every.select("sequence_id", F.explode(F.array_compact(F.array(fault("malformed_header", F.col("sequence_id").isNull()), fault("empty_sequence", F.col("sequence") == "")))).alias("fault"))
    return rows.unionByName(orphans.unionByName(single).distinct())


def fault_census(faults: DataFrame) -> DataFrame:
    """fault, n, and the first and last id by name that has it."""
    return faults.groupBy("fault").agg(F.count("*").alias("n"), F.min("sequence_id").alias("first_id"), F.max("sequence_id").alias("last_id"))


def loaded_sequences(canonical: DataFrame, additional: DataFrame, flat: DataFrame) -> DataFrame:
    """The relation of all sequences, after ``sequence_faults`` has found none that stops a load; otherwise an error that names them.

    sequence_id, uniprot_accession, isoform_id, entry_name, reviewed, canonical, sequence_view, taxid, gene_names, protein_names, versions, length, sequence and digest.
    What the flat record states goes before the header; null where neither does.
    """
    stops = fault_census(sequence_faults(canonical, additional, flat).where(~F.col("fault").isin(*REPORTED))).collect()  # a row for each kind
    if stops:
        raise ValueError("; ".join(f"{r.n} {r.fault} ({r.first_id} to {r.last_id})" for r in sorted(stops)))
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    or_listed = lambda listed, c: F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(one(c))
    shared = lambda: ("sequence_id", F.col("parent").alias("uniprot_accession"), "isoform_id")
    tail = (F.length("sequence").cast("long").alias("sequence_length"), "sequence", "sequence_sha256")
    f = flat.select(F.col("accession").alias("sequence_id"), *[F.col(c).alias(f"flat_{c}") for c in ("entry_name", "reviewed", "taxid", "all_gene_names", "protein_names", "entry_version", "sequence_version")])
    c = canonical.join(f, "sequence_id").select(
        *shared(), F.col("flat_entry_name").alias("entry_name"), F.col("flat_reviewed").alias("reviewed"), F.lit(True).alias("canonical"), F.lit("canonical").alias("sequence_view"), F.coalesce("flat_taxid", "taxid").alias("taxid"),
        F.coalesce("flat_all_gene_names", F.array().cast("array<string>")).alias("gene_names"), or_listed(F.col("flat_protein_names"), "protein_name").alias("protein_names"), F.coalesce("sequence_version", "flat_sequence_version").alias("sequence_version"),
        F.col("flat_entry_version").alias("entry_version"), *tail)
    view = F.when(F.col("isoform_id").isNotNull(), "additional_isoform").otherwise("additional_non_isoform")
    a = additional.select(
        *shared(), "entry_name", "reviewed", F.lit(False).alias("canonical"), view.alias("sequence_view"), "taxid", one("gene").alias("gene_names"), one("protein_name").alias("protein_names"), "sequence_version", F.lit(None).cast("int").alias("entry_version"), *tail)
    return c.unionByName(a)


def identifier_mappings(spark: SparkSession, path: str) -> DataFrame:
    """uniprot_accession, database, identifier and identifier_versionless of a three-column table; a row of another width or with an empty field fails the job."""
    f = F.split("value", "\t", -1)
    bad: Column = (F.size(f) != 3) | F.exists(f, lambda x: x == "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed mapping: "), "value")).cast("boolean")).otherwise(True)
    rows = spark.read.text(path).withColumn("value", F.regexp_replace("value", r"\r$", "")).where(checked)
    item = lambda i: F.get(f, F.lit(i))
    return rows.select(item(0).alias("uniprot_accession"), item(1).alias("database"), item(2).alias("identifier"), F.regexp_replace(item(2), r"\.\d+$", "").alias("identifier_versionless"))
