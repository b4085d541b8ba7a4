"""Session settings, lineage cutting and checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024
#: Text of a partition whose rows are taken apart by the steps that follow.
SPREAD_CHARS = 4 << 20
#: Rows of a partition of counted members.
PART_ROWS = 1 << 17
#: Shuffled bytes of a task.  Names and paths repeat, so a shuffled byte stands for some 40 bytes of rows.
TASK_BYTES = 4 << 20
#: Partitions of a shuffle before those too small for a task are joined up.
SHUFFLE_PARTITIONS = 1024


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on.

    Arrow batches are bounded by bytes, so a batch of large documents still fits a worker;
    duplicate keys follow the last-wins rule wherever the variant parser is used.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": 32 * 1024 * 1024,
    }
    _set(spark, settings)
    return spark


#: Settings that tables dealt by a key need.
DEALT = {
    # tables dealt by some columns of a key are joined and grouped by the whole key where they are
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    # a task of a dealt table has one bucket, so its rows need no sort before they are written
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # a union of dealt scans says that it is dealt alike but doesn't bring their partitions together (Spark 4.1):
    # a group would be summed once a table
    "spark.sql.unionOutputPartitioning": "false",
}


def _set(spark: SparkSession, settings: dict) -> None:
    for key, value in settings.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, str(value))


def configure_tables(spark: SparkSession, chars: int = 0) -> SparkSession:
    """``configure``, and tasks over tables of names and paths whose rows don't grow with the tables.

    Such rows shrink to a fortieth where they are shuffled or written, so tasks are cut by far fewer bytes than
    Spark does by itself.  ``chars`` is the text that the tables come from; the partitions of a shuffle grow with it.
    """
    configure(spark)
    partitions = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    settings = {
        partitions: max(int(spark.conf.get(partitions, "1")), SHUFFLE_PARTITIONS, chars // SPREAD_CHARS),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": TASK_BYTES,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": 1 << 20,
        "spark.sql.sources.fileCompressionFactor": "40.0",
        "spark.sql.files.maxPartitionBytes": 16 << 20,
    }
    _set(spark, settings | DEALT)
    return spark


def _shared(spark: SparkSession) -> str:
    # the warehouse is shared by the whole cluster as well
    return spark.conf.get("spark.checkpoint.dir", f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every machine of the cluster sees, for files that are written and read back."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder shared by the cluster and go on from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(spark))
    return df.checkpoint()


def parts_of(df: DataFrame) -> int:
    """Partitions of a table that is there already; a plan with shuffles would be run for the answer."""
    return df.rdd.getNumPartitions()


def stored(df: DataFrame, *keys: str, like: DataFrame | int | None = None, placed: bool = False) -> DataFrame:
    """``df`` written by columns to the folder shared by the cluster, and read from there.

    As ``cut_lineage``, for tables read several times: a reader takes the columns it needs, many rows at once.
    Partitions are those of the read.  With ``keys`` the rows are dealt by them (Spark's buckets) over as many partitions
    as ``like`` has or names, so tables dealt alike are joined, and grouped by these and more columns, without a shuffle.
    ``placed`` says that the rows lie in such partitions already, though the plan may not show it.
    """
    spark = df.sparkSession
    out = shared_folder(spark, "table")
    if not keys:
        df.write.parquet(out)
        return spark.read.schema(df.schema).parquet(out)
    _set(spark, DEALT)
    parts = like if isinstance(like, int) else parts_of(df if like is None else like)
    name = f"table_{uuid.uuid4().hex}"
    dealt = df if placed else df.repartition(parts, *keys)
    dealt.write.bucketBy(parts, *keys).option("path", out).saveAsTable(name)
    table = spark.table(name)
    # the files stay, only the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def spread(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``df`` dealt over as many partitions as its ``text`` needs, none of much more than ``SPREAD_CHARS``.

    Small files that hold many rows are read by few tasks; steps that make many rows of one would run in those alone.
    With ``keys`` rows are dealt by these and stored.
    """
    size = df.agg(F.sum(F.length(text))).first()[0] or 0
    configure_tables(df.sparkSession, size)
    parts = 1 + size // SPREAD_CHARS
    return stored(df, *keys, like=parts) if keys else df.repartition(parts)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is below ``limit`` bytes.

    The size is that of the rows as JSON text, one cheap aggregate over a table that has been
    reduced before.  Beyond the limit the join is left to Spark (sort merge, adaptive skew).
    """
    row = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size < limit else df
