"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and the master is local, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if given:
        return given
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024, size: str = "16m") -> None:
    """Bound what one Arrow batch of whole texts holds: rows, and bytes where Spark knows that setting.

    The settings are read when a plan is run, which is after the operator has returned, so they stay set for the
    session. They bound memory and change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def storage(path: str):
    """pyarrow's file system of a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def names(path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds, in order; a missing one holds nothing."""
    from pyarrow import fs

    disk, at = storage(path)
    found = disk.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.base_name, f.type == fs.FileType.Directory) for f in found)


def put(path: str, name: str, raw: bytes) -> None:
    """Write a file that is either there as a whole or not at all; an older one of that name is replaced."""
    disk, at = storage(path)
    disk.create_dir(at, recursive=True)
    hidden = f"{at}/.{name}-{uuid.uuid4().hex}"
    with disk.open_output_stream(hidden) as out:
        out.write(raw)
    disk.move(hidden, f"{at}/{name}")
