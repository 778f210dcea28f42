"""Operator 4: token counts of byte-level BPE by heap-and-linked-list merging.

Each text is cut into pre-tokens; a pre-token starts as its bytes. A heap holds the adjacent pairs that a
merge rule knows, by rank and place; a doubly linked list of live symbols gives each pair's neighbours. The
lowest pair is popped, stale ones are skipped, the pair becomes one symbol, and the two new pairs are pushed.
The count is the bytes minus the merges; identifiers are never written out. Counts of short pre-tokens
are kept in a bounded table of each worker.

Defined results: a null or empty text has no tokens and no bytes; the vocabulary's own special strings in a
text count as one token each, as the library counts them by default; equal texts have equal counts; texts are counted
whole, however long; an empty table gives no rows; extra columns stay, but for those named like a new one or with two
leading underscores, which go.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import public, small_batches, utf8_len

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept by a worker, and the longest that is kept.
KEPT, KEPT_CHARS = 400_000, 48


def _bytes_of_chars() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable character; this maps them back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class Counter(dict):
    """Token counts by pre-token; looked up with [], computed when missing."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = _bytes_of_chars()
        self.first = [0] * 256
        for c, b in chars.items():
            self.first[b] = vocab[c]
        self.rules = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode())
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def merged(self, raw: bytes) -> int:
        """Symbols left after all merges of one pre-token."""
        n = len(raw)
        rules, first = self.rules, self.first
        symbols = [first[b] for b in raw]
        heap = []
        for i in range(n - 1):
            rule = rules.get((symbols[i], symbols[i + 1]))
            if rule:
                heap.append((rule[0], i, rule[1]))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            rule = rules.get((symbols[i], symbols[j]))
            if rule is None or rule[1] != made:
                continue
            merges += 1
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rule = rules.get((made, symbols[k]))
                if rule:
                    heapq.heappush(heap, (rule[0], i, rule[1]))
            h = before[i]
            if h >= 0:
                rule = rules.get((symbols[h], made))
                if rule:
                    heapq.heappush(heap, (rule[0], h, rule[1]))
        return n - merges

    def count(self, text: str) -> int:
        get, find = self.__getitem__, self.find
        if self.special is None or not self.special.search(text):
            return sum(map(get, find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, find(p))) for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit. Nothing is shuffled.

    ``vocabulary`` is the path of a byte-level BPE vocabulary that every executor can read.
    """
    docs = public(docs, "n_bytes", "n_tokens", "over_limit")
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary).count
        for batch in texts:
            yield pd.Series([count(t) if t else 0 for t in batch], dtype="int64")

    counted = docs.withColumns({"n_bytes": utf8_len(F.col(text)), "n_tokens": tokens(F.col(text))})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
