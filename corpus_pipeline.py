"""From raw documents to token ids: five stages over the whole table, each written and read again.

No stage fails on null, empty or very long texts, repeated rows, no rows, or columns of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.llm import bpe, decontaminate, line_dedup, minhash, quality
from arcwright.llm._graph import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as of low quality or toxic, go. So do those without words, null and empty ones among them; without labels all stay."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated runs go, and documents of which nothing is left; n_chars of changed ones is their length now. Null and empty texts stay as they are."""
    found = line_dedup.dedup_lines(docs.withColumnRenamed("removed_lines", "__removed_lines"))  # a column of the documents' own, if any
    found = found.where((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    found = found.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return found.drop("removed_lines").withColumnRenamed("__removed_lines", "removed_lines").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the lowest doc_id stays, and every row of that doc_id. Texts without words and rows of null doc_id stay."""
    return minhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, and documents that are mostly such go; n_chars is the text's length now, if that is less; null stays null. Null and empty texts stay."""
    clean = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.least("n_chars", F.length("text").cast("bigint")))).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them; null for null text."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenise", tokenise),
]

#: The classifier's training can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the others return is written to the shared folder, read as the next one's documents, and removed when that one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                _drop(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
