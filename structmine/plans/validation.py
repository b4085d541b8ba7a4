"""Validate a raw corpus and write the clean one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from structmine.session import cut_lineage
from structmine.sources import corpus


def validate_corpus(
    spark: SparkSession, schema_folder: str, document_folder: str, clean_schemas: str, clean_documents: str
) -> DataFrame:
    """Write the schemas and documents of valid datasets; the funnel of the checks comes back."""
    schemas = cut_lineage(corpus.read_schemas(spark, schema_folder))
    statuses = cut_lineage(corpus.validate(schemas, corpus.file_listing(spark, document_folder)))
    corpus.write_schemas(schemas, statuses, clean_schemas)
    valid = statuses.where("status = 'ok'").select("dataset")
    lines = corpus.read_documents(spark, document_folder).join(valid, "dataset", "left_semi")
    corpus.write_clean_documents(lines, clean_documents)
    return corpus.funnel(statuses, corpus.VALIDATION_STATUSES)
