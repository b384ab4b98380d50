"""A corpus from raw documents to training windows: quality rules, near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm import ngram_join, packing, pii, quality
from flowsift.llm.common import free_name, read, without
from flowsift.session import intermediates, materialise, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content; all columns as they are.

    A missing or empty text fails. Repeated rows are judged alike.
    """
    return quality.keep(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Rows without words are in no group and stay. Groups are of rows, so repeated rows of one id leave one row, and
    rows without an id are grouped like any other; they stand behind rows with one.
    """
    row, number = free_name(docs.columns, "row"), free_name(docs.columns, "number")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), F.col(number).alias("n"))
    path = scratch_path(spark, "removed")
    with intermediates(spark):  # the join's own tables go before the next stage begins
        groups = ngram_join.similar_groups(numbered.select(key.alias(row), "text"), width=5, percent=80, key=row)
        groups.where(F.col("component_id") != F.col(row)).select(F.col(row)["n"].alias(number)).write.parquet(path)
    removed = spark.read.schema(f"`{number}` long").parquet(path)
    return without(numbered, removed, number).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked and their lengths renewed."""
    return pii.mask(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack_windows)]

#: The line labels, tokens and disguises of the stages are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
