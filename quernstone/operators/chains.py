"""Audit of mappings from structure chains to frozen sequences: taxonomy, accession, interval and state of each mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain_audit(mapping: DataFrame, taxonomy: DataFrame, sequences: DataFrame, home: int) -> DataFrame:
    """One row for each mapping.

    mapping: mapping_id, structure, chain, accession, start, end; taxonomy: structure, chain, taxid; sequences: sequence_id,
    accession, isoform_id, length, canonical. An accession matches its canonical sequence, else only some sequence of it, else an
    isoform's own id. Bounds are judged for ascending intervals on a found sequence. No state authorizes a mapping: releases differ.
    """
    taxa = taxonomy.groupBy("structure", "chain").agg(
        F.array_sort(F.collect_set(F.col("taxid").cast("string"))).alias("chain_taxids"), F.bool_or(F.col("taxid") == home).alias("at_home"), F.bool_or(F.col("taxid") != home).alias("elsewhere")
    )
    primary = sequences.select("accession").distinct().withColumn("primary", F.lit(True))
    canonical = sequences.where("canonical").select("accession", F.col("sequence_id").alias("canonical_id"), F.col("length").alias("canonical_length"))
    others = sequences.where("isoform_id is not null").select(F.col("sequence_id").alias("accession"), F.col("sequence_id").alias("other_id"), F.col("length").alias("other_length"))
    j = mapping.join(taxa, ["structure", "chain"], "left").join(primary, "accession", "left").join(canonical, "accession", "left").join(others, "accession", "left")
    known = F.coalesce("primary", F.lit(False))
    found = lambda c, o: F.coalesce(c, F.when(~known, F.col(o)))
    home_, other = F.coalesce("at_home", F.lit(False)), F.coalesce("elsewhere", F.lit(False))
    j = j.withColumns({
        "chain_taxids": F.coalesce("chain_taxids", F.array().cast("array<string>")),
        "taxonomy_resolution": F.when(home_ & other, "home_and_other").when(home_, "home_only").when(other, "other_only").otherwise("no_taxonomy"),
        "accession_match_state": F.when(F.col("canonical_id").isNotNull(), "primary_canonical_sequence").when(known, "primary_without_canonical").when(F.col("other_id").isNotNull(), "additional_sequence").otherwise("absent"),
        "frozen_sequence_id": found("canonical_id", "other_id"), "frozen_length": found("canonical_length", "other_length"),
        "interval_state": F.when(F.col("start").isNull() | F.col("end").isNull(), "incomplete").when(F.col("start") > F.col("end"), "complete_descending").otherwise("complete_ascending"),
    })
    judged = F.col("frozen_length").isNotNull() & (F.col("interval_state") == "complete_ascending")
    state = F.when(F.col("taxonomy_resolution") == "no_taxonomy", "unresolved_taxonomy").when(~home_, "out_of_scope").when(F.col("interval_state") == "complete_descending", "blocked_descending_interval")
    state = state.when(F.col("frozen_sequence_id").isNull(), "unmatched_sequence").otherwise("blocked_release_mismatch")
    return j.select(
        F.concat(F.lit("chain-audit:"), F.substring(F.sha2("mapping_id", 256), 1, 32)).alias("audit_id"), "mapping_id", "structure", "chain", "accession", "chain_taxids", "taxonomy_resolution",
        (home_ & other).alias("mixed_taxonomy"), "accession_match_state", "frozen_sequence_id", "frozen_length", "interval_state",
        F.when(judged, (F.col("start") >= 1) & (F.col("end") <= F.col("frozen_length"))).alias("within_bounds"), state.alias("mapping_state"), F.lit(False).alias("authorized"),
    )
