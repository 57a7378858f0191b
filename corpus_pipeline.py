"""A training corpus in four stages: quality rules, near-duplicates, mixture weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``, whatever their names.

Defined cases: texts that are null, empty or of fewer than 50 words go by the first stage, and whole long texts count; rows with null or repeated ids are rows
like any other, and of near copies one of the least id stays (null is larger than any); a null source is one of its own in the mix; equal rows that the mix takes stand
in the result as often as it takes them; without labels the base rule alone decides; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.bpe import bpe_encode
from quernstone.llm.common import durable, table
from quernstone.llm.mixing import mix
from quernstone.llm.quality import accepted
from quernstone.llm.queries import tokenizer
from quernstone.llm.simhash import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, one of the least doc_id: five-word shingles, similarity 0.8 or more."""
    return kept_documents(docs, shingle=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them: not at all, once, or up to three times."""
    whole = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row"))
    taken = mix(whole).where("copies > 0").select("whole_row", F.explode(F.sequence(F.lit(1), "copies")))
    return taken.select(*(F.col("whole_row")[c].alias(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digest of what the ids decode to, for each row."""
    coded = bpe_encode(docs, tokenizer("word_bpe_49k.json"), keep=("doc_id", "source"), outputs=("n_tokens", "ids", "decoded"))
    return coded.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("mixing", mixture), ("BPE", token_ids)]

#: XXH64 and byte-pair encoding have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "pipeline")
    return docs
