"""The corpus pipeline: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm import decontaminate, line_dedup, packing, quality, similar
from wharfline.llm.names import quoted
from wharfline.session import drop_scratch, scratch_mark, shared_dir
from wharfline.sources.tables import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut out; ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs).select(*[F.col(quoted(c)) for c in docs.columns])
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 0.8 of their five-word shingles connect, by SimHash and an exact search for the rest."""
    return similar.deduplicate(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which training sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", unrepeated_lines),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("packing", packed_sequences),
]

#: SQL can't express the first and the third stage; tests hold all against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        mark = scratch_mark(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_scratch(spark, mark)
        docs = spark.read.parquet(path)
    return docs
