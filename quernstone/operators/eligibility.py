"""Which genes have one reference sequence, and the sequences that eligible genes stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the twenty standard amino acids.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"


def gene_eligibility(genes: DataFrame, identifiers: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each gene, and a row for each distinct sequence of the eligible ones.

    genes: gene (distinct); identifiers: gene, accession; sequences: accession, sequence. A gene is eligible if all its accessions
    have the same sequence; of several ones none is chosen. Sequences are known by their digests, and their rows hold
    counts and the least accession, no lists, which could grow with the corpus.
    """
    known = sequences.select("accession", "sequence", F.sha2("sequence", 256).alias("sha"))
    found = genes.select("gene").join(identifiers.select("gene", "accession").distinct(), "gene").join(known, "accession")
    of = found.groupBy("gene").agg(
        F.array_sort(F.collect_set("accession")).alias("accessions"), F.count_distinct("sha").alias("hashes"), F.min("sha").alias("sha"), F.min(F.length("sequence")).alias("length")
    )
    j = genes.select("gene").join(of, "gene", "left").withColumns({"accessions": F.coalesce("accessions", F.array().cast("array<string>")), "hashes": F.coalesce("hashes", F.lit(0).cast("long"))})
    state = F.when(F.col("hashes") == 0, "unmapped").when(F.col("hashes") > 1, "ambiguous_multiple_sequences").when(F.size("accessions") > 1, "sequence_equivalent_accessions").otherwise("unique_reference_sequence")
    usable = F.col("hashes") == 1
    rows = j.select(
        "gene", state.alias("mapping_state"), F.col("accessions").alias("candidate_accessions"), F.size("accessions").cast("long").alias("accession_count"), F.col("hashes").alias("sequence_count"),
        F.when(usable, F.col("sha")).alias("selected_sha256"), F.when(usable, F.col("length")).alias("selected_length"), usable.alias("usable"), F.when(usable, "none").otherwise(state).alias("exclusion_reason"),
    )
    eligible = found.join(rows.where("usable").select("gene"), "gene", "left_semi")
    odd = F.array_sort(F.array_distinct(F.filter(F.split(F.any_value("sequence"), ""), lambda x: (x != "") & ~F.contains(F.lit(STANDARD), x))))
    groups = eligible.groupBy("sha").agg(
        F.any_value(F.length("sequence")).alias("length"), F.min("accession").alias("representative"), F.count_distinct("accession").alias("accession_count"), F.count_distinct("gene").alias("gene_count"),
        F.contains(F.any_value("sequence"), F.lit("U")).alias("contains_selenocysteine"), odd.alias("nonstandard_symbols"),
    )
    return rows, groups
