"""Folders of raw mail as a data source of Spark, in batches and as a stream.

A mailbox is a folder of folders; each holds files of mails in order of their numbers (uid), named by the first and the last.
A file has for each mail a line with its number and size, then its bytes. So a range of numbers is found by the names of
files, and a reader that wants headers alone reads the start of each mail and seeks past the rest.

Folders and ranges of numbers are options, by which files are chosen. With the option ``pushdown`` the source takes such conditions
from the query's own filters. That is for a relation that is read once: Spark 4.1 keeps what a first query has pushed,
and a second one of the same relation that pushes nothing would find the first one's files. As a stream the last number of each folder is the offset: a batch
holds what has come behind the one before, in files that are complete, since a file gets its name when it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from email.parser import BytesHeaderParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .mime import _people, _shown
from .shared import names, storage

FORMAT, SUFFIX = "mailbox", ".mails"
ENVELOPE = "folder string, uid long, size long, message_id string, in_reply_to string, subject string, sender string, date string, content_type string"
#: Bytes that a look at the headers reads at once, mails of a batch, bytes of bodies of a batch.
HEAD, ROWS, BODIES = 1 << 14, 1_000, 1 << 24


@dataclass
class Files(InputPartition):
    """Some files of a folder, of which the mails from ``low`` to ``high`` are meant."""

    folder: str
    files: list[str]
    low: int
    high: int

    def __init__(self, folder: str, files: list[str], low: int, high: int):
        super().__init__((folder, files, low, high))
        self.folder, self.files, self.low, self.high = folder, files, low, high


def ends(name: str) -> tuple[int, int]:
    first, last = name.removesuffix(SUFFIX).split("-")
    return int(first), int(last)


def files_of(path: str, folder: str) -> list[str]:
    return [n for n, is_folder in names(f"{path}/{folder}") if n.endswith(SUFFIX) and not is_folder and not n.startswith(".")]


def folders_of(path: str) -> list[str]:
    return [n for n, is_folder in names(path) if is_folder and not n.startswith(".")]


def header(raw: bytes) -> dict:
    """What an envelope says; headers that aren't there are null."""
    m = BytesHeaderParser().parsebytes(raw)
    lone = lambda name: _shown(m[name]).strip() if m[name] is not None else None
    people = _people(m, "from")
    return {"message_id": lone("message-id"), "in_reply_to": lone("in-reply-to"), "subject": lone("subject"), "sender": people[0]["address"] if people else None, "date": lone("date"), "content_type": m.get_content_type()}


def head_end(raw: bytes) -> int:
    """Where the blank line that ends the headers starts, or -1."""
    found = [i for i in (raw.find(b"\r\n\r\n"), raw.find(b"\n\n")) if i >= 0]
    return min(found, default=-1)


def mails(path: str, part: Files, bodies: bool) -> Iterator[dict]:
    disk, at = storage(path)
    for name in part.files:
        with disk.open_input_file(f"{at}/{part.folder}/{name}") as source:
            place, size = 0, source.size()
            while place < size:
                raw = source.read_at(min(HEAD, size - place), place)
                line = raw.index(b"\n")
                uid, length = map(int, raw[:line].split())
                start, place = place + line + 1, place + line + 1 + length
                if part.low <= uid <= part.high:
                    raw = raw[line + 1 : line + 1 + length]
                    while len(raw) < length and (bodies or head_end(raw) < 0):
                        raw += source.read_at(min(length - len(raw), length if bodies else max(HEAD, len(raw))), start + len(raw))
                    end = head_end(raw)
                    yield {"folder": part.folder, "uid": uid, "size": length, **header(raw if end < 0 else raw[:end])} | ({"raw": raw} if bodies else {})


def batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("raw", b""))
        if len(held) >= ROWS or size >= BODIES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


@dataclass
class MailReader(DataSourceReader):
    path: str
    bodies: bool
    schema: pa.Schema
    folders: set[str] | None = None
    low: int = 0
    high: int = (1 << 63) - 1

    def partitions(self) -> list[Files]:
        out = []
        for folder in folders_of(self.path):
            if self.folders is None or folder in self.folders:
                out += [Files(folder, [n], self.low, self.high) for n in files_of(self.path, folder) if ends(n)[1] >= self.low and ends(n)[0] <= self.high]
        return out or [Files("", [], 0, -1)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(mails(self.path, partition, self.bodies), self.schema)


class FilteredMailReader(MailReader):
    """A reader that takes conditions on the folder and the number over from the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name == "folder" and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.folders = some if self.folders is None else self.folders & some
            elif name == "uid" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f


class MailStream(DataSourceStreamReader):
    def __init__(self, path: str, bodies: bool, schema: pa.Schema, since: str):
        self.path, self.bodies, self.schema, self.since = path, bodies, schema, since

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.since == "latest" else {}

    def latestOffset(self) -> dict:
        return {folder: max(ends(n)[1] for n in files) for folder in folders_of(self.path) if (files := files_of(self.path, folder))}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        out = []
        for folder, last in end.items():
            first = start.get(folder, -1) + 1
            out += [Files(folder, [n], first, last) for n in files_of(self.path, folder) if ends(n)[1] >= first and ends(n)[0] <= last]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(mails(self.path, partition, self.bodies), self.schema)

    def commit(self, end: dict) -> None:
        pass


class MailSource(DataSource):
    """Options: ``path``; ``bodies`` (true: the raw mail, too); ``folders`` (a list as JSON), ``low``, ``high`` and ``pushdown`` of a batch; ``since`` of a stream (earliest, or latest: new mail only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _bodies(self) -> bool:
        return self.options.get("bodies", "false").lower() == "true"

    def schema(self) -> str:
        return ENVELOPE + (", raw binary" if self._bodies() else "")

    def _arrow(self) -> pa.Schema:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in self.schema().split(", ")])

    def reader(self, schema: StructType) -> MailReader:
        kind = FilteredMailReader if self.options.get("pushdown", "false").lower() == "true" else MailReader
        folders = json.loads(self.options["folders"]) if "folders" in self.options else None
        return kind(self.options["path"], self._bodies(), self._arrow(), None if folders is None else set(folders), int(self.options.get("low", 0)), int(self.options.get("high", (1 << 63) - 1)))

    def streamReader(self, schema: StructType) -> MailStream:
        return MailStream(self.options["path"], self._bodies(), self._arrow(), self.options.get("since", "earliest"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)


def read_mail(spark: SparkSession, path: str, bodies: bool = False, folders: list[str] | None = None, low: int = 0, high: int | None = None, pushdown: bool = False) -> DataFrame:
    """The mails of some folders, or of all, whose numbers are from ``low`` to ``high``."""
    register(spark)
    options = {"path": path, "bodies": bodies, "low": low, "pushdown": pushdown} | ({"folders": json.dumps(folders)} if folders is not None else {}) | ({"high": high} if high is not None else {})
    return spark.read.format(FORMAT).options(**options).load()


def stream_mail(spark: SparkSession, path: str, bodies: bool = False, since: str = "earliest") -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).option("path", path).option("bodies", str(bodies).lower()).option("since", since).load()


def write_mail(df: DataFrame, path: str, each: int = 1_000) -> DataFrame:
    """Add mails (folder, uid, raw) to a mailbox, in files of ``each`` numbers; (folder, file, n) of the files written.

    A file is made under a hidden name and named when it is whole; the same numbers make the same name, so that a task that runs
    twice leaves one file.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["folder", "piece"]
    dealt = df.select("folder", F.col("uid").cast("long").alias("uid"), "raw", F.floor(F.col("uid") / each).alias("piece"))
    dealt = dealt.repartition(n, *keys).sortWithinPartitions(*keys, "uid")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, at = storage(path)
        key, out, hidden, first, last, count = None, None, "", 0, 0, 0

        def done() -> pd.DataFrame:
            out.close()
            name = f"{first:012d}-{last:012d}{SUFFIX}"
            disk.move(hidden, f"{at}/{key[0]}/{name}")
            return pd.DataFrame({"folder": [key[0]], "file": [name], "n": [count]})

        for part in parts:
            for folder, piece, uid, raw in zip(part["folder"], part["piece"], part["uid"], part["raw"]):
                if (folder, piece) != key:
                    if out:
                        yield done()
                    key, first, count = (folder, piece), uid, 0
                    disk.create_dir(f"{at}/{folder}", recursive=True)
                    hidden = f"{at}/{folder}/.{uuid.uuid4().hex}"
                    out = disk.open_output_stream(hidden)
                raw = raw or b""
                out.write(b"%d %d\n" % (uid, len(raw)) + raw)
                last, count = uid, count + 1
        if out:
            yield done()

    return dealt.mapInPandas(run, "folder string, file string, n long")
