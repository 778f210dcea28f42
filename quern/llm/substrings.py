"""Operator 10: removal of repeated byte strings by blockwise suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller key.
All places where such a string could start are suffixes of the corpus cut to ``length`` bytes; equal ones
are neighbours in suffix order. The suffixes are sorted one bucket at a time. Rows are dealt into parts of some
megabytes by their place, so that neither a key nor a passage makes a part large, and the steps are:

1. *Anchors.* In each string of ``length`` bytes the 16-byte window with the smallest hash is its anchor. Equal
   strings have equal anchors at equal offsets, so an anchor's hash names a bucket of suffixes that holds all
   copies of its strings. Each part sends each anchor's hash once, with its smallest key.
2. *Shared anchors.* A bucket tells each part which of its hashes more than one document has.
3. *Suffix sorting.* Each part sends what stands around its shared anchors, each different surrounding once with its
   smallest key, so that a passage in very many documents is few rows for each part. A bucket sorts the suffixes in
   its surroundings, which are aligned at their anchors. Every eighth column is in the cover sample, whose
   suffixes are ranked first, each from eight bytes and the rank of the next sample. A suffix at any other column
   is ordered by the bytes up to the next sample column and that sample's rank, so that sorting never compares long
   ties byte by byte; whether two neighbours are equal in ``length`` bytes is then read from these bytes. (A difference cover must give any two suffixes a common distance to the sample;
   aligned at anchors, suffixes that can be equal always stand in the same column, where the plain cover
   of every eighth column does that.) Runs of neighbours equal in all ``length`` bytes share their smallest key.
   The bucket answers each surrounding with a mask of the starts that a smaller key than its own has too.
4. *Removal.* Each part finds its occurrences again: one with a larger key than its surrounding's smallest loses all
   strings around the anchor, another the masked ones.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; texts are read whole, however long,
in pieces that overlap; a null key comes after all others, with 2^63 - 1; rows with equal keys, so repeated rows,
don't remove from each other; repeats inside one document stay; all strings are judged on the input; extra
columns stay, but for those named like a new column or with two leading underscores, which go; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import public, utf8_len

LENGTH, GRAM, STRIDE = 50, 16, 8
#: Text bytes for each bucket and each part at most on average; and at least, where there are more tasks than that gives.
MOST_BYTES, LEAST_BYTES, PARTS_A_TASK = 8_000_000, 1_000_000, 4
LAST_KEY = (1 << 63) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE, _SENT = np.uint64(0xFFFFFF), np.uint64((1 << 40) - 1)
#: Texts are worked on in pieces of this many bytes, which overlap by a string.
PIECE = 1 << 18
#: Anchors whose surroundings are cut out together.
TOGETHER = 1 << 13


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each 16-byte window, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    for half in (1, 2, 4, 8):
        h = h[:-half] * np.uint64(pow(int(_M1), half, 1 << 64)) + h[half:]
    return mix(h)


def anchors(whole: np.ndarray, offset: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """hash, place, first and last start of the strings of each anchor, and its text, of texts that lie one after the other.

    Texts begin at ``offset``, whose last is the end of all; strings never cross from one to the next.
    """
    found: list[tuple] = []
    width = length - GRAM + 1
    owner = np.repeat(np.arange(len(offset) - 1, dtype=np.int32), np.diff(offset))
    for at in range(0, max(0, len(whole) - length + 1), PIECE):
        h = gram_hashes(whole[at : at + PIECE + length - 1])
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        mine = owner[at : at + len(low)]
        start = np.flatnonzero(offset[mine + 1] >= np.arange(at + length, at + length + len(low)))
        if not len(start):
            continue
        place, mine = (low[start] & _PLACE).astype(np.int64), mine[start]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (mine[1:] != mine[:-1])]))
        end = np.concatenate([new[1:], [len(start)]]) - 1
        found.append((h[place[new]], place[new] + at, start[new] + at, start[end] + at, mine[new]))
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def pack(h: np.ndarray) -> bytes:
    """The low 40 bits, byte by byte of all numbers: sorted ones compress well."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return out.view(np.uint64).ravel()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    for name, rows in zip(names, np.split(order, at[1:])):
        yield int(name), rows


class Part:
    """The rows of a part in the order of their places, their texts one after the other, and their anchors."""

    def __init__(self, rows: pa.Table, text: str, length: int):
        self.rows = rows.sort_by("__row")
        self.keys = self.rows["__key"].to_numpy()
        texts = self.rows[text].cast(pa.large_string()).combine_chunks().fill_null("")
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        self.offset = ends - ends[0]
        self.hash, self.place, self.first, self.last, self.owner = anchors(self.bytes, self.offset, length)

    def surroundings(self, length: int, shared: dict[int, np.ndarray], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bucket: the different surroundings of shared anchors, and each occurrence's surrounding and anchor."""
        width = length - GRAM
        full = length + width
        of = bucket_of(self.hash, buckets)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *[h | np.uint64(b & 0xFFFFFF) << np.uint64(40) for b, h in shared.items()]]))
        mine = self.hash & _SENT | (of.astype(np.uint64) & np.uint64(0xFFFFFF)) << np.uint64(40)
        at = np.searchsorted(known, mine)
        picked = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == mine) if len(known) else np.zeros(0, np.int64)
        for name, rows in _by_bucket(of[picked]):
            which = picked[rows]
            cuts = np.zeros((len(which), full + 2), np.uint8)
            for low in range(0, len(which), TOGETHER):
                some = which[low : low + TOGETHER]
                self._cut(some, cuts[low : low + TOGETHER], length)
            once, back = np.unique(cuts.view(f"V{full + 2}").ravel(), return_inverse=True)
            yield name, once.view(np.uint8).reshape(-1, full + 2), back, which

    def _cut(self, which: np.ndarray, out: np.ndarray, length: int) -> None:
        """What stands around these anchors, zero outside their strings, and their first and last start's column."""
        width = length - GRAM
        full = length + width
        place, first, last = self.place[which], self.first[which], self.last[which]
        at = (place - width)[:, None] + np.arange(full)
        inside = (at >= first[:, None]) & (at < last[:, None] + length)
        out[:, :full] = np.where(inside, self.bytes[np.clip(at, 0, len(self.bytes) - 1)], 0)
        out[:, full], out[:, full + 1] = first - place + width, last - place + width


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def opened(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


ANCHORS = "bucket int, part int, h binary, code binary, docs binary"
SHARED = "part int, bucket int, h binary"
AROUND = "bucket int, part int, rows binary, doc binary, docs binary"
MASKS = "part int, bucket int, mask binary"


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(names)})


def sketch(text: str, length: int, buckets: int):
    """Step 1: each hash of a part once, its smallest key, and whether two documents of the part have it."""

    def run(rows: pa.Table) -> pa.Table:
        part, number = Part(rows, text, length), rows["__part"][0].as_py()
        by_key = np.argsort(part.keys, kind="stable")
        rank = np.empty_like(by_key)
        rank[by_key] = np.arange(len(by_key))
        order = np.lexsort((rank[part.owner], part.hash))
        h, key = part.hash[order], part.keys[part.owner[order]]
        if not len(h):
            return table_of(ANCHORS, [])
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        end = np.concatenate([start[1:], [len(h)]]) - 1
        many = key[start] != key[end]
        h, low = h[start], key[start]
        out = []
        for name, mine in _by_bucket(bucket_of(h, buckets)):
            docs, place = np.unique(low[mine], return_inverse=True)
            code = (place << 1 | many[mine]).astype("<u2" if len(docs) < 32_000 else "<u4")
            out.append((name, number, pack(h[mine]), code.tobytes(), docs.tobytes()))
        return table_of(ANCHORS, out)

    return run


def shared(group: pd.DataFrame) -> pd.DataFrame:
    """Step 2: for each part the hashes that another document has as well."""
    hashes, keys, many = [], [], []
    for h, code, docs in zip(group["h"], group["code"], group["docs"]):
        h, docs = unpack(h), np.frombuffer(docs, np.int64)
        code = np.frombuffer(code, "<u2" if len(docs) < 32_000 else "<u4").astype(np.int64)
        hashes.append(h)
        keys.append(docs[code >> 1])
        many.append((code & 1).astype(bool))
    h, k, m = np.concatenate(hashes), np.concatenate(keys), np.concatenate(many)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    two = np.maximum.reduceat(k[order], start) != np.minimum.reduceat(k[order], start)
    two |= np.logical_or.reduceat(m[order], start)
    good = np.empty(len(h), bool)
    good[order] = np.repeat(two, np.diff(np.concatenate([start, [len(h)]])))
    ends = np.cumsum([len(x) for x in hashes])
    out = [(p, b, pack(x[g])) for p, b, x, g in zip(group["part"], group["bucket"], hashes, np.split(good, ends[:-1])) if g.any()]
    return pd.DataFrame(out, columns=["part", "bucket", "h"])


def received(answers: pa.Table, name: str) -> dict[int, bytes]:
    return {b: x for b, x in zip(answers["bucket"].to_pylist(), answers[name].to_pylist()) if x is not None}


def around(text: str, length: int, buckets: int):
    """Step 3 in the parts: each different surrounding once for each bucket, with its smallest key."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return table_of(AROUND, [])
        part, number, out = Part(rows, text, length), rows["__part"][0].as_py(), []
        for name, once, back, which in part.surroundings(length, {b: unpack(h) for b, h in received(answers, "h").items()}, buckets):
            low = np.full(len(once), LAST_KEY, np.int64)
            np.minimum.at(low, back, part.keys[part.owner[which]])
            docs, doc = np.unique(low, return_inverse=True)
            out.append((name, number, squeezed(once.tobytes()), squeezed(doc.astype("<u4").tobytes()), docs.tobytes()))
        return table_of(AROUND, out)

    return run


def words(m: np.ndarray, at: int, n: int) -> np.ndarray:
    """n <= 8 bytes of each row from a column, as one big-endian number; columns beyond the end are zero."""
    part = np.zeros((len(m), 8), np.uint8)
    have = max(0, min(n, m.shape[1] - at))
    part[:, :have] = m[:, at : at + have]
    return part.view(">u8").ravel().astype(np.uint64)


def dense_rank(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    order = np.lexsort((then, first))
    f, t = first[order], then[order]
    step = np.concatenate([[False], (f[1:] != f[:-1]) | (t[1:] != t[:-1])])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def smallest_keys(m: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each start column, each row's smallest key among the rows with an equal string there."""
    width, full = length - GRAM, m.shape[1]
    rank = {c: None for c in range(0, full + STRIDE, STRIDE)}
    rank[max(rank)] = np.zeros(len(m), np.int64)
    for c in sorted(rank, reverse=True)[1:]:
        rank[c] = dense_rank(words(m, c, STRIDE), rank[c + STRIDE])
    for c in range(width + 1):
        rows = np.flatnonzero((first <= c) & (c <= last))
        if not len(rows):
            continue
        sample = -(-c // STRIDE) * STRIDE
        order = rows[np.lexsort((rank[sample][rows], words(m[rows], c, sample - c)))]
        text = m[order, c : c + length]
        new = np.concatenate([[True], (text[1:] != text[:-1]).any(1)])
        start = np.flatnonzero(new)
        best = np.full(len(m), LAST_KEY, np.int64)
        best[order] = np.minimum.reduceat(key[order], start)[np.cumsum(new) - 1]
        yield c, best


def sort_bucket(length: int):
    """Step 3 in the buckets: for each part's surroundings the masks of starts that a smaller key has too."""
    full = 2 * length - GRAM

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(opened(r), np.uint8).reshape(-1, full + 2) for r in group["rows"]]
        low = np.concatenate([np.frombuffer(docs, np.int64)[np.frombuffer(opened(doc), "<u4")] for doc, docs in zip(group["doc"], group["docs"])])
        once, at = np.unique(np.concatenate(rows).view(f"V{full + 2}").ravel(), return_inverse=True)
        m = once.view(np.uint8).reshape(-1, full + 2)
        least = np.full(len(m), LAST_KEY, np.int64)
        np.minimum.at(least, at, low)
        mask = np.zeros(len(at), np.int64)
        for c, best in smallest_keys(m[:, :full], m[:, full].astype(np.int64), m[:, full + 1].astype(np.int64), least, length):
            mask |= (best[at] < low).astype(np.int64) << c
        ends = np.cumsum([len(r) for r in rows])
        parts = np.split(mask, ends[:-1])
        out = [(p, b, squeezed(x.view(np.uint8).reshape(-1, 8).T.tobytes())) for p, b, x in zip(group["part"], group["bucket"], parts) if x.any()]
        return pd.DataFrame(out, columns=["part", "bucket", "mask"])

    return run


def removed(part: Part, at: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a part go, given anchors and the masks of their strings to remove.

    Strings that start one after the other cover one run; only its two ends are noted.
    """
    depth = np.zeros(len(part.bytes) + 1, np.int32)
    start = part.place[at] - (length - GRAM)
    first, last = masks & ~(masks << 1), masks & ~(masks >> 1)
    for c in range(length - GRAM + 1):
        np.add.at(depth, start[(first >> c) & 1 == 1] + c, 1)
        np.add.at(depth, start[(last >> c) & 1 == 1] + c + length, -1)
    return np.cumsum(depth[:-1]) > 0


def left_over(part: Part, gone: np.ndarray, as_text: bool) -> list[pa.Array]:
    """n_bytes, n_removed, spans and kept bytes of each text; or, as text, without the stray bytes of cut characters."""
    offset = part.offset
    total = np.concatenate([[0], np.cumsum(gone)])
    edge = np.zeros(len(gone) + 1, bool)  # a run ends with its text
    edge[offset] = True
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    start = np.flatnonzero(gone & (~before | edge[:-1]))
    end = np.flatnonzero(gone & (~after | edge[1:])) + 1
    owner = np.searchsorted(offset, start, "right") - 1
    counts = np.searchsorted(start, offset)
    spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(start - offset[owner]), pa.array(end - offset[owner])], ["start", "end"]))
    kept, cuts = part.bytes[~gone].tobytes(), offset - total[offset]
    n_removed = np.diff(total[offset])
    left = [kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    left = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
    return [pa.array(np.diff(offset)), pa.array(n_removed), spans, left]


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def strip(text: str, length: int, buckets: int, names: list[str], columns: list[str], as_text: bool):
    """Step 4: the rows of a part with what is removed and what is left."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(rows, text, length)
        at, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        told = received(answers, "mask")
        for name, once, back, which in part.surroundings(length, {b: unpack(h) for b, h in received(answers, "h").items()}, buckets):
            key = part.keys[part.owner[which]]
            low = np.full(len(once), LAST_KEY, np.int64)
            np.minimum.at(low, back, key)
            first, last = once[:, -2].astype(np.int64), once[:, -1].astype(np.int64)
            whole = (np.int64(1) << (last + 1)) - (np.int64(1) << first)
            some = np.zeros(len(once), np.int64)
            if name in told:
                some = np.ascontiguousarray(np.frombuffer(opened(told[name]), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
            mask = np.where(key > low[back], whole[back], some[back])
            at.append(which[mask != 0])
            masks.append(mask[mask != 0])
        new = left_over(part, removed(part, np.concatenate(at), np.concatenate(masks), length), as_text)
        return pa.table([*[part.rows[c] for c in columns], *new], names=[*columns, *names])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, prefix: str = "", as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, the removed spans (byte offsets) and the kept bytes, all named with ``prefix``.

    With ``as_text`` what is kept is a text, without the stray bytes of characters that were cut.
    """
    spark = docs.sparkSession
    names = [prefix + n for n in ("n_bytes", "n_removed", "spans", "kept")]
    docs = public(docs, *names)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(utf8_len(F.col(text)))).first()[0] or 0
    # Each part sends a row to each bucket, so neither is made smaller than that is worth.
    buckets, n_parts = (max(1, -(-size // MOST_BYTES), min(n, -(-size // LEAST_BYTES))) for n in (tasks, PARTS_A_TASK * tasks))
    placed = docs.withColumns({"__row": F.monotonically_increasing_id(), "__key": F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY))})
    # The same shuffle of the parts serves all three steps.
    parts = placed.withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(n_parts)).cast("int"))
    sent = parts.groupBy("__part").applyInArrow(sketch(text, length, buckets), ANCHORS)
    told = sent.groupBy("bucket").applyInPandas(shared, SHARED)
    cuts = parts.groupBy("__part").cogroup(told.groupBy("part")).applyInArrow(around(text, length, buckets), AROUND)
    masks = cuts.groupBy("bucket").applyInPandas(sort_bucket(length), MASKS)
    none = F.lit(None).cast("binary")
    answers = told.select("part", "bucket", "h", none.alias("mask")).union(masks.select("part", "bucket", none.alias("h"), "mask"))
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(names, (LongType(), LongType(), SPANS, StringType() if as_text else BinaryType()))]])
    return parts.groupBy("__part").cogroup(answers.groupBy("part")).applyInArrow(strip(text, length, buckets, names, docs.columns, as_text), schema)
