"""Operator 3: byte-level BPE encoding and decoding, with long texts in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. All chunks are pre-tokenised in parallel, each
from its own start. The pattern never looks back, so once two neighbours start a pre-token at the same
place of their overlap, they agree from there on: the first such place is where the text is cut. Cuts are only
made after a character that isn't blank and not near a chunk's end, where the pattern could have looked
further. The pieces between cuts are then encoded in parallel and their ids put together in order.
From the first overlap of a text that holds no common place on, nothing is known of its later chunks, so the rest
of that text is one piece, which is exact as well. Decoding concatenates the raw bytes of the ids.

Defined results: null is the empty text, with no ids; equal rows each get their ids; special tokens
are ordinary text; texts are encoded whole, however long; an empty table gives no rows; extra columns stay, but for
those named like the new column or with two leading underscores, which go. ``ids`` is binary: little-endian unsigned 32-bit integers, one for each token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe, public, released, small_batches

CHUNK, OVERLAP, GUARD = 65_536, 4_096, 8
#: Texts and bytes of an Arrow batch: a worker holds a vocabulary beside its batch, and Spark a copy of the batch outside its heap.
ROWS, SIZE = 256, "4m"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _encoder(path: str, pattern: str):
    @F.pandas_udf("binary")
    def encode_piece(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in texts:
            yield pd.Series([np.array(encode(t), "<u4").tobytes() if t else b"" for t in batch], dtype=object)
        released()

    return encode_piece


def starts(text: str, pattern: str) -> np.ndarray:
    """Where a pre-token starts right after a character that isn't blank."""
    return np.array([m.start() for m in splitter(pattern).finditer(text) if m.start() and not text[m.start() - 1].isspace()], np.int64)


def chunk_rows(pattern: str, chunk: int, overlap: int):
    """Maps long texts to chunks, and chunks to the places that their neighbours may share."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = chunk - overlap
        for batch in batches:
            for key, text in zip(batch["__key"], batch["__text"]):
                for no, at in enumerate(range(0, max(1, len(text) - overlap), step)):
                    yield pd.DataFrame({"__key": [key], "no": [no], "at": [at], "last": [at + chunk >= len(text)], "piece": [text[at : at + chunk]]})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads, tails = [], []
            for at, last, piece in zip(batch["at"], batch["last"], batch["piece"]):
                found = starts(piece, pattern)
                heads.append((found[found < overlap] + at).tolist() if at else [])
                tail = found[(found >= chunk - overlap) & (found <= len(piece) - GUARD)]
                tails.append([] if last else (tail + at).tolist())
            yield pd.DataFrame({"__key": batch["__key"], "no": batch["no"], "head": heads, "tail": tails})

    return cut, places


def cuts_of(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """__key, cuts: the inner cut places of each long text, up to the first neighbours that share none."""
    cut, places = chunk_rows(pattern, chunk, overlap)
    chunks = texts.mapInPandas(cut, "__key string, no int, at int, last boolean, piece string")
    n = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = chunks.repartition(int(n), "__key", "no").mapInPandas(places, "__key string, no int, head array<int>, tail array<int>")
    w = Window.partitionBy("__key").orderBy("no")
    shared = found.withColumn("cut", F.array_min(F.array_intersect(F.lag("tail").over(w), F.col("head")))).filter("no > 0")
    upto = Window.partitionBy("__key").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    proven = shared.withColumn("ok", F.bool_and(F.col("cut").isNotNull()).over(upto)).filter("ok")
    return proven.groupBy("__key").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, text, cuts in zip(batch["__key"], batch["__text"], batch["cuts"]):
            edges = [0, *([] if cuts is None else [int(c) for c in cuts]), len(text)]
            for no, (a, b) in enumerate(zip(edges, edges[1:])):
                yield pd.DataFrame({"__key": [key], "no": [no], "piece": [text[a:b]]})


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with the ids of each text.

    Texts within one chunk are encoded where they are read. Only longer ones are shuffled, by content.
    """
    if chunk < 2 * overlap + GUARD:
        raise ValueError("a chunk must hold two overlaps")
    docs = public(docs, out)
    small_batches(docs.sparkSession, ROWS, SIZE)
    encode_piece = _encoder(vocabulary, pattern)
    long_text = F.coalesce(F.char_length(F.col(text)), F.lit(0)) > chunk
    short = docs.filter(~long_text).withColumn(out, encode_piece(F.coalesce(F.col(text), F.lit(""))))
    longs = docs.filter(long_text).withColumn("__key", F.sha2(F.col(text), 256))
    texts = longs.select("__key", F.col(text).alias("__text")).dropDuplicates(["__key"])
    cuts = cuts_of(texts, pattern, chunk, overlap)
    pieces = texts.join(cuts, "__key", "left").mapInPandas(_slices, "__key string, no int, piece string")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = pieces.repartition(n, "__key", "no").select("__key", "no", encode_piece("piece").alias("i"))
    parts = coded.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("no", "i"))).alias("p"))
    whole = parts.select("__key", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["i"])).alias(out))
    return short.unionByName(null_safe(longs, whole, ["__key"]).drop("__key").select(*docs.columns, out))


def decode(coded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the raw bytes that its ids stand for."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = encoding(vocabulary, pattern).decode_bytes
        for batch in batches:
            yield pd.Series([back(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in batch], dtype=object)
        released()

    return public(coded, out).withColumn(out, raw(F.col(ids)))
