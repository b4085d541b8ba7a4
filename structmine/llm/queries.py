"""The operators of this package over their whole tables."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structmine.llm import (
    decontaminate,
    lattice_lm,
    licence_scan,
    near_dedup,
    packing,
    periodic_runs,
    private_data,
    quality_classifier,
    quality_rules,
    token_store,
    toxicity,
    warc_source,
    whitening,
)
from structmine.llm.shared import new_folder, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    failed = quality_rules.base_failed()
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "votes", "p_good",
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_verified_links")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), folder, _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_store.digests(token_store.read(spark, folder))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, _tokenizer("byte_bpe_50k.json"), end_id=0))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    warc_source.write(warc_source.dedupe(table(spark, sf_dir, "pages")), folder)
    page = warc_source.page_of(F.col("record_id")).alias("page_id")
    responses = warc_source.read(spark, folder, ["record_id", "record_type", "payload"])
    revisits = warc_source.read(
        spark, folder, ["record_id", "record_type", "payload_digest", "refers_to", "payload_length"]
    )
    return (
        responses.where("record_type = 'response'")
        .select(
            page, F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
        )
        .unionByName(
            revisits.where("record_type = 'revisit'").select(
                page, F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
                warc_source.page_of(F.col("refers_to")).alias("refers_to"),
            )
        )
    )


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids, told by their checksum, the words that repeat from some word on; a null id is in no tenth."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find(table(spark, sf_dir, "documents"), repeated_words).drop("n_words", "n_kept")


QUERIES = (
    op1_quality_classifier, op2_decontaminate, op3_near_dedup, op4_lattice_lm, op5_token_store,
    op6_packing, op7_licence_scan, op8_warc, op9_toxicity, op10_quality_rules, op11_private_data,
    op12_whitening, op13_periodic_runs,
)

#: What SQL can express of the above: roles of records need no archive to be told.
SQL: dict[str, str] = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS bytes FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, bytes AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN bytes >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM r
    """,
}
