"""The shared folder: written tables that cut lineage, and plain files read and written by URI."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own below the shared one; it goes when the session's JVM ends."""
    uri = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return system.makeQualified(path).toString().replace("file:/", "file:///", 1) if uri.startswith("/") else uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later plans neither recompute nor lose it."""
    spark, folder = df.sparkSession, f"{new_folder(df.sparkSession, name)}/table"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


BATCH_ROWS = 2000  # of a table handed to Python at once


def small_batches(spark: SparkSession) -> None:
    """From here on a task hands at most so many rows to Python at once (Spark's own limit is 10,000, whatever their bytes).

    A batch is in memory several times: in Spark's buffers, in the pipe and in Python, for every running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


READ_BYTES = 32 << 20  # of written files that one task reads back


def readers(total_bytes: int | None) -> int:
    """Number of tasks that read so many bytes back. Given as a number, adaptive execution does not merge them: it would
    judge by the size of the listing, not of the files."""
    return max(1, -(-(total_bytes or 0) // READ_BYTES))


def release_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect the handles of finished jobs, whose shuffle files Spark's cleaner then deletes.

    Without it they stay until the driver happens to run a collection, and the phases of a long operator add up on disk.
    """
    spark._jvm.System.gc()


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    """A stream to a new file in any store pyarrow knows (local, HDFS, S3, GCS)."""
    system, path = _system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def open_input(uri: str):
    """A seekable file for range reads."""
    system, path = _system(uri)
    return system.open_input_file(path)
