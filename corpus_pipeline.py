"""The corpus pipeline: language id, line dedup, near-duplicate removal, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents,
extra ones too, with their own values. Nulls and texts are handled as the operators say; rows that
repeat an id share its decisions; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import jaccard_join, language_id, line_dedup, packing
from leafmill.llm.common import written


MADE = "pipeline_made_"  # before the names of columns that stages add and take away again


def named(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, fitted on their own labels, can tell; ``und`` ones go."""
    found = language_id.identify(docs, language_id.fit(docs), pred_col=f"{MADE}lang", score_col=f"{MADE}score")
    return found.where(F.col(f"{MADE}lang") != language_id.UNKNOWN).select(*named(docs))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has are cut out of the texts; no document goes. ``n_chars``, if there, follows."""
    cut = line_dedup.line_dedup(docs, lines_col=f"{MADE}lines", dropped_col=f"{MADE}dropped")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(f"{MADE}dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return cut.select(*named(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram Jaccard links reach, the one with the smallest id; null ids name no group and stay."""
    groups = jaccard_join.jaccard_components(docs)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull())).select(*named(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the stages that predict and tokenise; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
