"""Reading documents and keeping tables in the cluster's shared folder."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import structmine
from structmine.session import configure

#: Bytes of text a task of a shuffle is meant to hold.
TASK_BYTES = 16 * 1024 * 1024
#: Bytes of an Arrow batch, as tasks of the same executor hold several.
BATCH_BYTES = 8 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, as a whole URI; where it is unset, one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: later steps don't depend on executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once a session: they need no installed copy."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package, data = Path(structmine.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    uri = new_folder(spark, "code")
    store, folder = fs.FileSystem.from_uri(local_path(uri))
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/structmine.zip", compression=None) as out:
        out.write(data.getvalue())
    context.addPyFile(f"{uri}/structmine.zip")


def local_path(uri: str) -> str:
    """A URI as pyarrow takes it: Hadoop writes local ones with one slash."""
    return uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the columns named, whatever else the table holds; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def tasks_for(docs: DataFrame, column: str = "text", most: int = TASK_BYTES) -> int:
    """Tasks to deal the bytes of a text column over, from one narrow aggregate."""
    size = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, -(-size // most))
