"""Token ids of documents in Parquet: list columns with dictionary or delta encoding and page indexes.

Documents are dealt by ranges of their id, so every file holds consecutive documents in order.  A row is a
document: ``doc_id`` (delta encoding), ``shard`` and ``shard_start`` (the ids before it in its file),
``n_tokens`` and ``tokens`` (a list column, dictionary encoding: a row group meets few thousand distinct
ids).  Row groups and pages are bounded, and the writer adds column and offset indexes, so a filter on
``doc_id`` reads the pages concerned and metadata is read without tokens.

Edge cases: a null or empty text has the end id alone; rows with equal ids are written each, in no
defined order among them; an empty table gives an empty folder that reads as an empty table; other
columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structmine.llm import spans
from structmine.llm.shared import tasks_for, texts_of
from structmine.llm.token_ids import AT_ONCE, encoder, with_end

SHARD_BYTES = 32 * 1024 * 1024
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, tokens array<int>"

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
}


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the ids in ascending ``doc_id`` order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in spans.slices(batches, "text", AT_ONCE):
            ids, ends = with_end(*coder.encode(spans.texts(batch.column("text"))), end_id)
            values = pa.array(ids.view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.full(batch.num_rows, shard, np.int32)),
                    pa.array(ends[:-1] + start),
                    pa.array(np.diff(ends).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values),
                ],
                ["doc_id", "shard", "shard_start", "n_tokens", "tokens"],
            )
            start += int(ends[-1])

    wanted = texts_of(docs)
    dealt = wanted.repartitionByRange(tasks_for(wanted, "text", shard_bytes), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as written, with ``start``: the ids of all documents before it.

    The starts of the shards come from one row a shard, read without the tokens, and are broadcast: a shard
    holds ``SHARD_BYTES`` of text, so they are a few bytes for tens of millions.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            at = (np.asarray(lists.offsets).astype(np.int64) * 4).tolist()
            sums = np.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])], np.int64)
            n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(n), pa.array(sums)],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    wanted = rows.select("doc_id", "start", "tokens")
    return wanted.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
