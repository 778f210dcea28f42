"""Operator 5: quality rules by cross-document line frequency.

One pass over the texts takes the base figures of each document and the hashes of its normalised lines
(lower case, single blanks). Then the distinct documents of each host that hold a line are counted. Lines
above the host's limit are boilerplate: their words don't count for the document, and a document that keeps
less than ``least_left`` of its words is rejected. The host is the ``source`` column.

Copies aren't evidence of boilerplate: documents of a host with the same set of normalised lines count as one.
Near copies differ in a line, so each of them counts.

Defined results: a null text has no words and fails the base rules; the null host is a host; a repeated row
gets the verdict of its text; texts are read whole, however long; a line exactly at its host's limit isn't above it, and
a document that keeps exactly the least share stays; a line without a word is never counted; an empty table gives
no rows; extra columns stay, but for those named like a new one or with two leading underscores, which go.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe, public, small_batches, table

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
#: A line is boilerplate above this many documents of its host, or this share of them if that is more.
MAX_DOCS, MAX_SHARE = 10, 0.01
#: The share of its words that a document must keep.
LEAST_LEFT = 0.5
#: Frequent lines that are broadcast at most (24 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 200_000
#: The columns that the operator adds; ``document`` and ``lines`` stay inside.
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "words_left", "kept", "document", "lines")
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, document binary, lines array<struct<line:bigint,words:int>>"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    if n <= 100_000:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == n - 2:
            return 0
        count = Counter(windows)
        again = np.fromiter((count[w] > 1 for w in windows), bool, n - 2)
    else:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, at, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = count[at] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def normal(line: str) -> bytes:
    return b" ".join(line.lower().encode().split())


def figures(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    solid = raw.translate(None, BLANKS)
    chars = len(solid) if solid.isascii() else len(solid.decode())
    seen, again, counted = set(), 0, {}
    for line in raw.split(b"\n"):
        bare = line.split()
        if bare:
            again += line in seen
            seen.add(line)
            key = md5(normal(line.decode())).digest()
            counted[key] = counted.get(key, 0) + len(bare)
    lines = [{"line": int.from_bytes(k[:8], "big", signed=True), "words": n} for k, n in counted.items()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated_words(words), md5(b"".join(sorted(counted))).digest(), lines


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the base figures and the lines of each document."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(FIGURES)
    def all_figures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "document", "lines"]
        for batch in texts:
            yield pd.DataFrame([figures(t) for t in batch], columns=names)

    return docs.withColumn("__f", all_figures(F.col(text))).select(*[c for c in docs.columns if c != text], "__f.*")


def frequent_lines(measured: DataFrame, host: str, max_docs: int, max_share: float) -> DataFrame:
    """host, line: the lines above their host's limit."""
    rows = measured.filter("n_words > 0").select(F.col(host).alias("__host"), "document", F.explode("lines.line").alias("line"))
    counts = rows.groupBy("__host", "line", "document").agg(F.lit(1).alias("one")).groupBy("__host", "line").agg(F.count("one").alias("n"))
    hosts = measured.filter("n_words > 0").groupBy(F.col(host).alias("__host"), "document").agg(F.lit(1).alias("one")).groupBy("__host").agg(F.count("one").alias("n_docs"))
    limited = null_safe(counts.filter(F.col("n") > max_docs), hosts, ["__host"])
    return limited.filter(F.col("n") > F.greatest(F.lit(float(max_docs)), F.lit(max_share) * F.col("n_docs"))).select("__host", "line")


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """``docs`` without the text, with the base figures, base_failed, removed (hashes), words_left and kept."""
    docs = public(docs, *NEW)
    columns = [c for c in docs.columns if c != text]
    measured = table(measure(docs, text).withColumn("__row", F.monotonically_increasing_id()), "quality")
    frequent = table(frequent_lines(measured, host, max_docs, max_share), "lines")
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    lines = measured.select("__row", F.col(host).alias("__host"), F.explode("lines").alias("l")).select("__row", "__host", "l.line", "l.words")
    hits = lines.join(
        frequent.select(F.col("__host").alias("__h"), F.col("line").alias("__l")), F.col("__host").eqNullSafe(F.col("__h")) & (F.col("line") == F.col("__l")), "left_semi"
    )
    removed = hits.groupBy("__row").agg(F.sum("words").alias("__words"), F.collect_set("line").alias("removed"))
    out = measured.join(removed, "__row", "left")
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    left = F.col("n_words") - F.coalesce("__words", F.lit(0))
    out = out.withColumns({"base_failed": base, "words_left": left})
    kept = ~base & (F.col("words_left") >= F.lit(least_left) * F.col("n_words"))
    figures_ = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*columns, *figures_, "base_failed", F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"), "words_left", kept.alias("kept"))


def without_lines(text: str, removed: str) -> Column:
    """The text without the lines whose hashes are in the array ``removed``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hashes in batches:
            yield pd.Series([keep_lines(t, h) for t, h in zip(texts, hashes)], dtype=object)

    return run(F.col(text), F.col(removed))


def keep_lines(text: str | None, removed) -> str | None:
    if text is None or removed is None or not len(removed):
        return text
    gone = {int(h) for h in removed}
    return "\n".join(x for x in text.split("\n") if not normal(x) or line_hash(x) not in gone)


def line_hash(line: str) -> int:
    return int.from_bytes(md5(normal(line)).digest()[:8], "big", signed=True)
