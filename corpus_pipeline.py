"""A training corpus from documents: quality rules, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import packing, quality, repeats, simhash, toxicity
from lattica.llm.common import table, table_in_shared_folder

#: Rows of a batch that goes between an executor and its Python workers, at most: both hold it, with texts of some KB each.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in a batch to BATCH_ROWS; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees let pass: null and blank texts go, repeated rows are judged alike."""
    small_batches(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; null and empty texts have a score too, and equal texts the same one."""
    small_batches(spark)
    return toxicity.drop(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; texts without words are one group, of rows equal in id and text one stays, a null id only where its group has no other."""
    small_batches(spark)
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have too, n_chars set anew; documents of which nothing is left go, null and empty texts stay as they are, passages shared by rows of one id stay in both."""
    small_batches(spark)
    return repeats.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null or empty text is its end sign alone, and repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash near-duplicates", near_duplicates),
    ("suffix-array repeats", repeated_passages),
    ("packing", packed),
]

#: SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table_in_shared_folder(docs)
    return docs
