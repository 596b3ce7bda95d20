"""A corpus pipeline of five stages; each stage is written as Parquet and read again as the next one's documents.

All stages take documents with the columns of ``documents``; further columns, whatever their names, are left behind. Null
ids and null, empty or very long texts, ties, repeated rows and empty tables are defined for each stage below; a table
without one of the columns is refused by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.llm import decontam, jaccard_join, mixing, quality_clf, token_pack
from condmon.llm.common import table, written
from condmon.llm.queries import END_ID, THRESHOLD, tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good.

    Null and empty texts score the share of good labels, so they stay where that reaches the threshold. Repeated rows share one
    verdict; rows with a null id are judged, though never learnt from. Without labels (share 0.5) nothing stays.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality_clf.train(docs, labels, usable=~quality_clf.held_out(F.col("doc_id")))
    return quality_clf.score(docs.select(COLUMNS), model, threshold=THRESHOLD).where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that with the smallest id; rows without an id come last.

    Rows are told apart by id and text, so texts that share an id or have none are judged one by one, and of rows that repeat
    both one stays. Null and empty texts are like nothing, so one row of each such id stays. Ties go by the hash of id and text.
    """
    keyed = docs.select(COLUMNS).withColumn("key", F.xxhash64("doc_id", "text"))
    found = jaccard_join.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    ids = keyed.select("key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = found.distinct().join(ids, "key").groupBy("component_id").agg(F.min(order).alias("row")).select("row.key")
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts stay; repeated rows, shared and null ids are judged text by text."""
    return decontam.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, a null source among them; repeated rows get equal counts."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row for each document they hold. A null or empty text holds the end id alone; equal ids go by the text's hash."""
    return token_pack.token_index(docs, tokenizer_json(), END_ID)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
    ("token output", tokens),
]
#: SQL can express neither the classifier nor the token files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
