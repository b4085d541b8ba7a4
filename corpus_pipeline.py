"""From raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from structmine.llm import decontaminate, near_dedup, packing, quality_classifier, quality_rules
from structmine.llm.shared import kept, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.select(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules reject go."""
    return quality_rules.select(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.select(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.select(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER), END_ID))


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("near-duplicates", near_copies),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packed),
]

#: A fitted classifier, estimated accuracies and a tokenizer decide: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
