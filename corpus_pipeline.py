"""The corpus pipeline: quality rules, line dedup, near-duplicate join, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read as the next one's docs. All but
the last return the columns of docs; where a stage changes texts, n_chars follows.

Defined cases, for every stage: a null text counts as an empty one and stays null (quality rules reject it); equal rows are
judged alike, and the near-duplicate stage keeps one of them; rows of a null id are documents; texts of any length are whole;
columns besides doc_id and text pass through under any name; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm import jaccard, linededup, packing, pii, quality
from tallyveil.llm.shared import documents, forget_since, mark, stored


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their repeated lines taken out."""
    return _measured(linededup.dedup_lines(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind."""
    return _measured(pii.redact_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express learned rules, the join at scale, or packing; the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        point = mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage_{k}")
            # what the stage wrote on its way is read by nothing that is left
            forget_since(spark, point, keep=1)
    return docs
