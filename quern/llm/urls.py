"""Operator 2: url filters by a bit-parallel wildcard automaton.

Glob rules over host and path are compiled together into one Shift-And automaton. Each rule takes a
start bit and one bit for each symbol; the bits of all rules lie side by side in 64-bit words. For each
byte of the canonical url the whole state is shifted by one, masked by the byte's word row, and joined
with the bits that a star keeps alive. All rules advance at once, over all urls of a batch at once.

The canonical url is ``.host#path``: neither ``#`` nor ``?`` can stand in a host or path, so a star in
the host cannot run into the path. A rule whose host is ``org`` and path ``/`` is the glob ``*.org#/*``.

Defined results: a null url, or one without ``://``, has an empty host and path, which only a glob for
empty hosts can match; equal urls are judged alike; of several rules that match, the longest decides,
and among equally long ones the first blocks before the first allows; urls are read whole, however long; an empty table
gives no rows; extra columns stay, but for those named like a new one or with two leading underscores, which go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import public

STAR, ONE = -1, -2


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains and paths that start with ``path``; or, if ``glob``, both are globs."""

    verdict: str
    host: str
    path: str
    glob: bool = False

    @property
    def name(self) -> str:
        return self.host + self.path

    def pattern(self) -> list[int]:
        """Bytes of the canonical form, with STAR and ONE for wildcards."""
        if self.glob:
            text = f".{self.host}#{self.path}"
            return [{42: STAR, 63: ONE}.get(b, b) for b in text.encode()]
        return [STAR, *f".{self.host}#{self.path}".encode(), STAR]


#: The rules asked for.
PREFIX_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: The method's own verdict where no rule above fits: these globs block, all else is allowed.
GLOB_RULES = (
    Rule("block", "*", "*.exe", True),
    Rule("block", "*", "*.zip", True),
    Rule("block", "*", "*/wp-admin/*", True),
    Rule("block", "ads.*", "*", True),
    Rule("block", "*.doubleclick.net", "*", True),
)
DEFAULT = "allow"


class Automaton:
    """The packed masks of many patterns."""

    def __init__(self, patterns: list[list[int]]):
        literal, loops, starts, self.final = [], [], [], []
        for pattern in patterns:
            starts.append(len(literal))
            literal.append(None)
            for symbol in pattern:
                if symbol == STAR:
                    loops.append(len(literal) - 1)
                else:
                    literal.append(symbol)
            self.final.append(len(literal) - 1)
        n = len(literal)
        self.words = -(-n // 64) if n else 1
        self.start, self.loop = self._mask(starts), self._mask(loops)
        self.by_byte = np.zeros((256, self.words), np.uint64)
        for i, symbol in enumerate(literal):
            if symbol is not None:
                rows = slice(None) if symbol == ONE else symbol
                self.by_byte[rows, i // 64] |= np.uint64(1 << (i % 64))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def _wide(self, words: np.ndarray) -> int:
        return int.from_bytes(np.ascontiguousarray(words, "<u8").tobytes(), "little")

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by pattern."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(texts) else np.zeros(0, np.int64)
        size = lengths[order]
        state = np.repeat(self.start[None, :], len(texts), 0)
        one, top = np.uint64(1), np.uint64(63)
        step, live = 0, int((size > 0).sum())
        while live >= 8:
            now = state[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = (shifted & self.by_byte[flat[at[:live] + step]]) | (now & self.loop)
            step += 1
            live = int(np.searchsorted(-size, -step, "left"))
        if live:  # a few long ones: the same automaton on Python's own long integers
            masks, loop = [self._wide(row) for row in self.by_byte], self._wide(self.loop)
            full = (1 << (64 * self.words)) - 1
            for i in range(live):
                wide = self._wide(state[i])
                for b in flat[at[i] + step : at[i] + size[i]].tobytes():
                    wide = ((wide << 1) & full & masks[b]) | (wide & loop)
                state[i] = np.frombuffer(wide.to_bytes(8 * self.words, "little"), "<u8")
        back = np.empty_like(state)
        back[order] = state
        final = np.array(self.final, np.int64)
        return (back[:, final // 64] >> (final % 64).astype(np.uint64)) & one == one


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple = PREFIX_RULES, globs: tuple = GLOB_RULES, default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, the deciding rule's name and the verdict. Nothing is shuffled."""
    pages = public(pages, "host", "path", "rule", "verdict")
    ranked = sorted(rules, key=lambda r: (-len(r.name.encode()), r.verdict != "block"))
    ranked += sorted(globs, key=lambda r: (-len(r.name.encode()), r.verdict != "block"))
    machine = Automaton([r.pattern() for r in ranked])
    names = np.array([r.name for r in ranked[: len(rules)]] + [None] * (len(globs) + 1), object)
    verdicts = np.array([r.verdict for r in ranked] + [default], object)

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            hit = machine.matches([x.encode() for x in batch])
            best = np.where(hit.any(1), hit.argmax(1), len(ranked)) if hit.size else np.full(len(batch), len(ranked))
            yield pd.DataFrame({"rule": names[best], "verdict": verdicts[best]})

    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = parts.withColumn("__judged", judge(F.concat(F.lit("."), "host", F.lit("#"), "path")))
    return judged.withColumns({"rule": F.col("__judged")["rule"], "verdict": F.col("__judged")["verdict"]}).drop("__judged")
