"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one
reads as its documents; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import mixing, neardup, packing, quality, repeats
from topicloom.session import cut_lineage

#: How far shares are flattened: 1 keeps them, 0 makes them equal.
MIX = {"source": 0.7, "lang": 0.9, "topic": 0.9}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy."""
    return quality.drop_failed(docs, "v1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return neardup.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows the text."""
    cleaned = repeats.remove_spans(docs, repeats.repeated_spans(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and kinds of text have their target shares of the words."""
    # mixed beside the whole row, so that no column of it is replaced
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "lang", "text")
    mixed = mixing.mix(mixing.with_topic(rows).drop("text"), MIX)
    return mixed.where("sampled").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.cut_documents(docs, path))


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("packing", packed),
]

#: Neither the alignment of near copies nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
