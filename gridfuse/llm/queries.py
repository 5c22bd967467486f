"""One query per operator, with its production parameters over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gridfuse.llm.clusters import clusters
from gridfuse.llm.common import documents
from gridfuse.llm.conversations import prefix_trie
from gridfuse.llm.decontaminate import contamination
from gridfuse.llm.maxent import text_scores
from gridfuse.llm.near_dedup import near_duplicates
from gridfuse.llm.packing import packed
from gridfuse.llm.pii import span_report
from gridfuse.llm.quality import quality_report
from gridfuse.llm.sharding import byte_shards
from gridfuse.llm.sql import ORACLE as ORACLE
from gridfuse.llm.substring_dedup import repeated_passages
from gridfuse.llm.suffix_dedup import repeated_bytes
from gridfuse.llm.token_counts import token_counts
from gridfuse.llm.toxicity import fit, fold, toxicity_scores


def op1_suffix_dedup(spark, sf_dir):
    return repeated_bytes(documents(spark, sf_dir))


def op2_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packed(documents(spark, sf_dir), path, end_id=2, size=4096)


def op3_personal_data(spark, sf_dir):
    return span_report(documents(spark, sf_dir))


def op4_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(documents(spark, sf_dir), path, limit=1024)


def op5_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0), per_class=2000)
    return toxicity_scores(docs, model, folds=5)


def op6_quality_rules(spark, sf_dir):
    return quality_report(documents(spark, sf_dir))


def op7_byte_shards(spark, sf_dir):
    return byte_shards(documents(spark, sf_dir), shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_lm_scoring(spark, sf_dir):
    return text_scores(documents(spark, sf_dir), folds=10)


def op9_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), benchmark).drop("row", "text_key")


def op10_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op11_conversation_trie(spark, sf_dir):
    """The prefix trie of all conversations; rows without an id belong to none."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_centroid_clusters(spark, sf_dir):
    """40 clusters after five rounds; vectors that are not 64 finite numbers give no row."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), number=40, rounds=5)


def op13_substring_dedup(spark, sf_dir):
    """Passages of 50 words that earlier documents have; null and short texts lose nothing."""
    return repeated_passages(documents(spark, sf_dir))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_personal_data": op3_personal_data,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_shards": op7_byte_shards,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_substring_dedup": op13_substring_dedup,
}
