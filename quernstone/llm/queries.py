"""The thin queries over the operators of this subpackage, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, kmeans, licences, mixing, topk, url_filter
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-sharing trie BPE over every whole document: token count and digests of ids and decoded text."""
    from .bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"), outputs=("n_tokens", "ids_text", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every whole document by the positional rare-token index."""
    from .licences import scan, summary

    return summary(scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the learned decision list's verdict on every whole document."""
    from .quality import COUNTS, judge

    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return judge(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent-network scores of every whole document."""
    from .lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector by the Voronoi join."""
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda vec_id: vec_id % 20 == 0, k=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole document."""
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wildcard automaton's verdict on every page's URL."""
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op8_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document through a content-addressed store and back."""
    from .store import new_path, read_store, write_store

    path = new_path(spark)
    write_store(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return read_store(spark, path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of all sources and the words taken of every document."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-tier token counts of every whole document."""
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = count_tokens(docs, tokenizer("byte_bpe_50k.json"), keep=("doc_id", "n_bytes"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document inside ten-word windows of benchmark items, by the prefix-filtered join."""
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen centroids over three rounds by kd-tree filtering: every vector's cluster and distance."""
    from .kmeans import cluster, summarised

    return summarised(*cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, merged from partial tries."""
    from .conversations import prefix_trie

    found = prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_licences": op2_licences,
    "op3_quality": op3_quality,
    "op4_lm": op4_lm,
    "op5_topk": op5_topk,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_store": op8_store,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_decontamination": op11_decontamination,
    "op12_kmeans": op12_kmeans,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op2_licences": licences.oracle(), "op5_topk": topk.ORACLE_TOP_K, "op7_url_filter": url_filter.oracle(), "op9_mixing": mixing.ORACLE_MIX,
    "op11_decontamination": decontaminate.ORACLE, "op12_kmeans": kmeans.oracle(), "op13_conversations": conversations.ORACLE,
}
