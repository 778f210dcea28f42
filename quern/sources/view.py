"""A view that streams write into and batches read: a sink of Spark with commit and abort.

Each task writes a file of its own. A batch counts from the moment that its list of files is put in place under the batch's
number; a batch that is run again finds its list, and its new files go. So a batch is in the view once, whatever is lost and
repeated, and a commit costs as much as its batch: nothing that the view holds is read. Keep repeated rows out before, by the
stream's own state (``streaming.sessions.live_rows``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from .shared import names, put, storage

FORMAT = "view"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class ViewWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.kind = path, schema.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        disk, at = storage(self.path)
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                disk.create_dir(f"{at}/data", recursive=True)
                sink = disk.open_output_stream(f"{at}/data/{name}")
                out = pq.ParquetWriter(sink, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        sink.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        name = f"{batchId:012d}.json"
        if any(n == name for n, _ in names(f"{self.path}/batches")):
            self.abort(messages, batchId)
            return
        files = [m.file for m in messages if m and m.file]
        put(f"{self.path}/batches", name, json.dumps({"files": files, "rows": sum(m.rows for m in messages if m), "schema": self.kind}).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        disk, at = storage(self.path)
        for m in messages:
            if m and m.file:
                disk.delete_file(f"{at}/data/{m.file}")


def lists(path: str) -> list[dict]:
    """What the committed batches hold, in order."""
    disk, at = storage(path)
    out = []
    for name, _ in names(f"{path}/batches"):
        if name.endswith(".json") and not name.startswith("."):
            with disk.open_input_file(f"{at}/batches/{name}") as source:
                out.append({"batch": int(name.removesuffix(".json")), **json.loads(source.read())})
    return out


class Part(InputPartition):
    def __init__(self, file: str, batch: int):
        super().__init__((file, batch))
        self.file, self.batch = file, batch


class ViewReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(file, b["batch"]) for b in lists(self.path) for file in b["files"]] or [Part("", -1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            disk, at = storage(self.path)
            with disk.open_input_file(f"{at}/data/{partition.file}") as source:
                for batch in pq.ParquetFile(source).iter_batches(10_000):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([partition.batch] * batch.num_rows, pa.int64())], [*batch.schema.names, "batch"])


class View(DataSource):
    """Option: ``path``. Read, a view has one column more: the ``batch`` that a row came with."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        known = lists(self.options["path"])
        if not known:
            raise ValueError("the view holds no batch yet, so its columns aren't known; give a schema")
        kind = known[0]["schema"]
        return StructType.fromJson(json.loads(kind)).add("batch", "long")

    def reader(self, schema: StructType) -> ViewReader:
        return ViewReader(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> ViewWriter:
        return ViewWriter(self.options["path"], schema)


def read_view(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(View)
    return spark.read.format(FORMAT).option("path", path).load()


def keep_view(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream that adds its rows to the view, each batch once."""
    stream.sparkSession.dataSource.register(View)
    return stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint)
