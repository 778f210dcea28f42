"""Operator 11: token ids in binary files, coded by Simple-8b in words of 64 bits.

Texts are dealt over files by ranges of their key; each file's task encodes its texts in order, appends the end id to each
and packs the ids. A word holds a selector in its top four bits and as many ids as fit into the other sixty at the
selector's width (``COUNTS``, ``WIDTHS``); the selector for the most ids that fit is taken, and the blocks of a
buffer advance in step, so that packing is array work. An id of more than 60 bits is an escape: its word is a
selector alone, and the id follows the block's words as a plain word. Blocks hold ``BLOCK`` ids and don't know of
documents, so a reader finds the ids from a to b by the offsets of blocks a // BLOCK to (b - 1) // BLOCK and
decodes these blocks at once, selector by selector.

A file: ``MAGIC``, blocks, table of documents (key, flag of a null key, ids before it in the file), table of blocks (byte
offset, words, escapes), ``TAIL``. Numbers are little-endian. An attempt of a task writes a file with a name of its own; the
manifest, a table that Spark commits, names the files that count. So a lost executor or a second attempt leaves a
file that nobody reads, never a wrong one.

Defined results: a null or empty text has the end id alone; null keys come last; rows of equal key are ordered by a hash of
their text, and repeated rows follow each other; special strings of the vocabulary inside a text are single ids, the
library's default; texts are read whole, however long (a task holds one text and its ids, and a buffer); an empty table
gives a manifest without rows, and no rows; other columns of the input, whatever their names, are neither read nor written.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

#: Selector 0 is an escape; selector s packs COUNTS[s] ids of WIDTHS[s] bits.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK, BUFFER = 4_096, 1 << 20
MAGIC, TAIL = b"QS8BLK01", struct.Struct("<QQQQQ8s")
#: Pieces of a generation that a worker keeps (two generations), and the longest that is kept.
KEPT, KEPT_CHARS = 500_000, 40
MANIFEST = "part int, file string, docs long, ids long, bytes long"

# A piece starts where byte-level splitting always starts a new run: before a blank that a solid character follows, around the
# last of other white space, and behind Latin letters that end at white space or ASCII punctuation. So pieces are encoded apart.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = re.compile(rf" ?[{_LETTERS}]+(?=[\s!-/:-@\[-`{{-~]|$)| ?\S+|\s+(?=\s\S)|\s+")
_RUN, _CONTROL = re.compile(rf" ?[{_LETTERS}]+").fullmatch, re.compile("[\x1c-\x1f]").search
_SMALL = np.searchsorted(np.left_shift(np.uint64(1), WIDTHS[1:].astype(np.uint64)), np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def classes(x: np.ndarray) -> np.ndarray:
    """For each number the first width that holds it: 0 for the selector 1, 15 for an escape."""
    if not len(x) or int(x.max()) < 1 << 16:
        return _SMALL[x]
    return np.searchsorted(np.left_shift(np.uint64(1), WIDTHS[1:].astype(np.uint64)), x, side="right").astype(np.uint8)


def selectors(x: np.ndarray) -> np.ndarray:
    """For each place of rows of numbers the selector of the most numbers that fit from there; behind a row come zeros."""
    rows, n = x.shape
    wide = {1: np.zeros((rows, n + 120), np.uint8)}
    wide[1][:, :n] = classes(x.ravel()).reshape(x.shape)
    # The widest of the next c numbers, from those of shorter windows.
    for c, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30), (120, 60, 60)):
        wide[c] = np.maximum(wide[a][:, : wide[a].shape[1] - b], wide[b][:, a:][:, : wide[a].shape[1] - b])
    out = np.where(wide[1][:, :n] == 15, 0, 15).astype(np.uint8)
    for s in range(14, 0, -1):
        out[wide[int(COUNTS[s])][:, :n] < s] = s
    return out


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of these ids, and for each block (bytes, words, escapes)."""
    blocks = -(-len(ids) // BLOCK)
    x = np.zeros((blocks, BLOCK + 120), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    x[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    sel = selectors(x[:, :BLOCK])
    ends = np.full(blocks, BLOCK)
    if blocks:
        ends[-1] = len(ids) - (blocks - 1) * BLOCK
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        here = at[live]
        steps.append((live, here))
        at[live] = here + COUNTS[sel[live, here]]
        live = live[at[live] < ends[live]]
    if not steps:
        return b"", np.zeros((0, 3), np.int64)
    block, place = (np.concatenate(part) for part in zip(*steps))
    order = np.lexsort((place, block))
    block, place = block[order], place[order]
    chosen = sel[block, place]
    flat, start = x.ravel(), block * x.shape[1] + place
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        for k in range(COUNTS[s] if len(rows) else 0):
            words[rows] |= flat[start[rows] + k] << np.uint64(WIDTHS[s] * k)
    escaped = np.flatnonzero(chosen == 0)
    n_words, n_escapes = np.bincount(block, minlength=blocks), np.bincount(block[escaped], minlength=blocks)
    # Each block's escapes stand behind its words.
    all_words = np.concatenate([words, flat[start[escaped]]])
    owner = np.concatenate([2 * block, 2 * block[escaped] + 1])
    raw = all_words[np.argsort(owner, kind="stable")].astype("<u8").tobytes()
    return raw, np.stack([8 * (n_words + n_escapes), n_words, n_escapes], 1)


def unpack(raw: bytes, n_words: np.ndarray, n_escapes: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks that hold so many words, escapes and ids."""
    both = np.frombuffer(raw, "<u8")
    sizes = np.stack([n_words, n_escapes], 1).ravel()
    kind = np.repeat(np.tile([True, False], len(n_words)), sizes)
    words, escapes = both[kind], both[~kind]
    block = np.repeat(np.arange(len(n_words)), n_words)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    before = np.cumsum(count) - count
    first = np.cumsum(n_words) - n_words
    place = before - before[first][block] + block * (BLOCK + 120)  # each block starts in a row of its own
    out = np.zeros(len(n_words) * (BLOCK + 120), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s] if len(rows) else 0):
            out[place[rows] + k] = (words[rows] >> np.uint64(WIDTHS[s] * k)) & mask
    out[place[sel == 0]] = escapes
    rows = out.reshape(len(n_words), -1)
    if (n_ids == BLOCK).all():
        return rows[:, :BLOCK].ravel()
    return rows[np.arange(rows.shape[1]) < n_ids[:, None]]


class Pieces(dict):
    """Ids of pieces of text as little-endian unsigned 32-bit numbers, encoded by the library when missing.

    A full generation of pieces becomes the old one, from which pieces that are met again are taken over.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.old: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        split = spec["pre_tokenizer"] or {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.apart = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.model = self.library.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.plain(piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if self.apart and _RUN(text):  # one run of letters is split no further, so the library's model has it at once
            shown = text.replace(" ", self.shown[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.shown)
            return array("I", [t.id for t in self.model(shown)]).tobytes()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """A whole text's ids; one with special strings, or with control characters that not every table of white space has, goes to the library as it is."""
        if not text:
            return b""
        if not self.apart or any(s in text for s in self.special) or _CONTROL(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _PIECES.findall(text)))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def storage(folder: str):
    """pyarrow's file system of a folder's URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Writer:
    """One file: ids are added by document, and packed and written by whole blocks."""

    def __init__(self, folder: str, name: str):
        self.disk, at = storage(folder)
        self.name, self.out = name, self.disk.open_output_stream(f"{at}/{name}")
        self.out.write(MAGIC)
        self.at, self.count = len(MAGIC), 0
        self.rest, self.held, self.blocks = [], 0, []
        self.keys, self.nulls, self.starts = [], [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.starts.append(self.count)
        self.count += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BUFFER:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint64)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for low in range(0, end, BUFFER):
            raw, table = pack(ids[low : min(end, low + BUFFER)])
            self.blocks.append(np.concatenate([(self.at + np.cumsum(table[:, 0]) - table[:, 0])[:, None], table[:, 1:]], 1))
            self.out.write(raw)
            self.at += len(raw)
        self.rest, self.held = [ids[end:]], len(ids) - end

    def close(self) -> tuple[str, int, int, int]:
        self.flush(True)
        blocks = np.concatenate(self.blocks) if self.blocks else np.zeros((0, 3), np.int64)
        docs = np.stack([np.array(x, "<i8") for x in (self.keys, self.nulls, self.starts)], 1)
        self.out.write(docs.tobytes() + blocks.astype("<i8").tobytes())
        self.out.write(TAIL.pack(self.at, len(docs), len(blocks), self.count, BLOCK, MAGIC))
        self.out.close()
        return self.name, len(docs), self.count, self.at + 24 * (len(docs) + len(blocks)) + TAIL.size


class Reader:
    """One file, read by ranges."""

    def __init__(self, folder: str, name: str):
        disk, at = storage(folder)
        self.source = disk.open_input_file(f"{at}/{name}")
        size = self.source.size()
        tail = TAIL.unpack(self.source.read_at(TAIL.size, size - TAIL.size))
        at, docs, blocks, self.count, self.block, magic = tail
        if magic != MAGIC or self.block != BLOCK:
            raise ValueError(f"{name} isn't a file of packed ids")
        raw = self.source.read_at(24 * (docs + blocks), at)
        both = np.frombuffer(raw, "<i8").reshape(-1, 3)
        self.end, self.keys, self.nulls, self.starts = at, both[:docs, 0], both[:docs, 1] != 0, both[:docs, 2]
        self.blocks = both[docs:]

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b of the file."""
        if a >= b:
            return np.zeros(0, np.uint64)
        low, high = a // BLOCK, (b - 1) // BLOCK + 1
        table = self.blocks[low:high]
        begin, end = int(table[0, 0]), int(self.blocks[high, 0]) if high < len(self.blocks) else self.end
        sizes = np.full(high - low, BLOCK)
        if high == len(self.blocks):
            sizes[-1] = self.count - (high - 1) * BLOCK
        return unpack(self.source.read_at(end - begin, begin), table[:, 1], table[:, 2], sizes)[a - low * BLOCK : b - low * BLOCK]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end, their ids), about a buffer of ids at once."""
        edges = np.append(self.starts, self.count)
        low = 0
        while low < len(self.keys):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + BUFFER, side="right")) - 1)
            yield low, high, self.ids(int(edges[low]), int(edges[high]))
            low = high


def write_ids(docs: DataFrame, vocabulary: str, folder: str, end: int, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encode ``docs`` into files of ``folder`` by ascending key and commit their manifest, which is returned.

    ``vocabulary`` is a file of the tokenizers library that every executor can read; ``files`` is the number of ranges, that of
    shuffle partitions if not given.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    slim = slim.withColumns({"last": F.col("key").isNull(), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # The last one parts repeated rows, should they be very many.
    by = ["last", "key", "hash", "row"]
    ordered = slim.repartitionByRange(n, *by).sortWithinPartitions(*by).select("key", "last", "text")
    storage(folder)[0].create_dir(storage(folder)[1], recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        coder, writer, closing = pieces(vocabulary), None, np.array([end], np.uint64)
        for batch in batches:
            for k, last, t in zip(batch["key"], batch["last"], batch["text"]):
                writer = writer or Writer(folder, f"{part:06d}-{uuid.uuid4().hex}.ids")
                ids = np.frombuffer(coder.ids(t), "<u4").astype(np.uint64)
                writer.add(None if last else int(k), np.concatenate([ids, closing]))
        if writer:
            yield pd.DataFrame([(part, *writer.close())], columns=["part", "file", "docs", "ids", "bytes"])

    ordered.mapInPandas(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder that count."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", width: int = 4) -> DataFrame:
    """(key, start, n_tokens, ids) of every document in the files of ``folder``; ids are little-endian and unsigned, of ``width`` bytes each.

    ``start`` counts the ids of all documents before it; the sums of files are taken over the manifest, a row for each file.
    """
    files = manifest(spark, folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, offset in zip(batch["file"], batch["before"]):
                file = Reader(folder, name)
                edges = np.append(file.starts, file.count)
                for low, high, ids in file.documents():
                    own = edges[low : high + 1] - edges[low]
                    raw = ids.astype(f"<u{width}").tobytes()
                    yield pd.DataFrame(
                        {
                            "key": file.keys[low:high],
                            "null": file.nulls[low:high],
                            "start": offset + edges[low:high],
                            "n_tokens": np.diff(own),
                            "ids": [raw[width * a : width * b] for a, b in zip(own, own[1:])],
                        }
                    )

    read = placed.repartition(n, "part").mapInPandas(run, "key long, null boolean, start long, n_tokens long, ids binary")
    return read.select(F.when(~F.col("null"), F.col("key")).alias(key), "start", "n_tokens", "ids")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
