"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage but the last returns the columns of documents; a stage that changes a text
counts its characters anew.  Rows with a null id stay themselves through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm.common import Workspace, documents
from gridfuse.llm.decontaminate import contamination
from gridfuse.llm.near_dedup import near_duplicates
from gridfuse.llm.packing import packed
from gridfuse.llm.pii import masked_documents
from gridfuse.llm.quality import clean_documents


#: A column that no table of documents has.
ROW = "__row_of_corpus_pipeline__"


def counted_anew(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines; null and empty texts fail.

    Repeated rows and rows with a null id are judged like any other.
    """
    return counted_anew(clean_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows that share an id are judged each by its own text, so of a repeated row one stays,
    and a text that only one of them has stays.  Rows with a null id all stay.  Null and
    wordless texts are copies of nothing.
    """
    given = docs.where("doc_id is not null")
    if given.groupBy("doc_id").count().where("count > 1").isEmpty():
        copies = near_duplicates(docs).where("not kept").select("doc_id").distinct()
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    # A number of its own for every row, in the order of the ids.
    ordered = given.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    rows = Workspace(spark).written(ordered.withColumn(ROW, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    copies = found.where("not kept").select(F.col("doc_id").alias(ROW))
    kept = rows.join(copies, ROW, "left_anti").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages.

    Rows are told apart by id and text, so each is judged by itself, null ids too; a null
    text has no words.  An empty benchmark contaminates nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark).where("contaminated")
    found = found.select(F.col("doc_id").alias("_id"), "text_key").distinct()
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["text_key"])
    return docs.join(found, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; a null text stays null."""
    return counted_anew(masked_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; null ids, repeated rows and empty texts have theirs."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packed(docs, path, end_id=2, size=4096)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Tokens, MinHash tables and packing by cost have no SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    tables, docs = Workspace(spark), documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir))
    return docs
