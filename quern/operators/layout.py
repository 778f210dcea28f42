"""Laying text out in lines and pages, and easing pen strokes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small_batches

# Rests after a character in milliseconds, and the speed they are meant for.
RESTS = {",": 120, ";": 150, ":": 150, "—": 160, ".": 250, "!": 250, "?": 250, " ": 18}
REST_SPEED = 52.0
EASE, TREMOR = 0.35, 0.35


class _Sizes(dict):
    """Widths of words, each measured once; those of characters that ``widths`` leaves out are kept as they come."""

    MOST = 100_000

    def __init__(self, widths: dict[str, int] | None, other: int):
        self.widths, self.other = dict(widths or {}), other

    def __missing__(self, word: str) -> int:
        if not self.widths:
            return len(word) * self.other
        try:
            n = sum(map(self.widths.__getitem__, word))
        except KeyError:
            self.widths.update((c, self.other) for c in set(word) - self.widths.keys())
            n = sum(map(self.widths.__getitem__, word))
        if len(self) >= self.MOST:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def measured(text: Column, widths: dict[str, int], other: int) -> Column:
    """The width of a whole text: as if all its characters were ``other`` wide, and for each other width what its characters add."""
    total = F.char_length(text) * other
    for width in sorted(set(widths.values()) - {other}):
        chars = "".join(c for c, w in widths.items() if w == width)
        total = total + (F.char_length(text) - F.char_length(F.translate(text, chars, ""))) * (width - other)
    return total


def wrap(text: str, width: int, widths: dict[str, int] | None = None, other: int = 1, sizes: _Sizes | None = None) -> list[str]:
    """Lines of at most ``width``; a word that is wider is cut; two line ends of a run count at most.

    A character is as wide as ``widths`` says, or as ``other``; without widths all count one. Widths are whole numbers of any
    unit, so that sums are exact. Blanks at the end of a line count, as they do where a line is measured. ``sizes`` keeps what is
    measured from one text to the next.
    """

    def cut(word: str) -> list[str]:
        if not widths:
            step = max(1, width // other)
            return [word[i : i + step] for i in range(0, len(word), step)]
        parts, start, used = [], 0, 0
        for i, c in enumerate(word):
            if i > start and used + widths.get(c, other) > width:
                parts.append(word[start:i])
                start, used = i, 0
            used += widths.get(c, other)
        return [*parts, word[start:]]

    lines, line, used = [], "", 0
    sizes = _Sizes(widths, other) if sizes is None else sizes
    gap = sizes[" "]
    for blank, word in re.findall(r"(\s+)|(\S+)", text):
        if "\n" in blank:
            lines += [line, ""][: min(blank.count("\n"), 2)]
            line, used = "", 0
        elif blank:
            line, used = (line + " ", used + gap) if line else ("", 0)
        elif line and used + (size := sizes[word]) <= width:
            line, used = line + word, used + size
        else:
            if line:
                lines.append(line)
            if (size := sizes[word]) <= width:
                line, used = word, size
            else:
                *full, line = cut(word)
                lines += full
                used = sizes[line]
    return [*lines, line] if line else lines


def wrapped(df: DataFrame, key: str, text: str, width: int, widths: dict[str, int] | None = None, other: int = 1) -> DataFrame:
    """(key, line_no, line) of each text; ``widths`` is a table of characters, such as a font has."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<string>")
    def lines(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(widths, other)
        for batch in texts:
            yield batch.map(lambda t: wrap(t or "", width, widths, other, sizes))

    return df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def placed(lines: DataFrame, per_page: int) -> DataFrame:
    """Lines with their page and their row on it."""
    return lines.withColumns({"page": F.floor(F.col("line_no") / per_page), "row": F.col("line_no") % per_page})


def char_duration(char: Column, width: Column, em: float, speed: float, rate: float = 1.0) -> Column:
    """Milliseconds for a character, without jitter."""
    rest = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RESTS.items() for x in kv]), char), F.lit(0))
    shape = F.greatest(F.lit(0.35), F.least(F.lit(2.6), F.lit(0.45) + F.lit(0.9) * width / F.lit(em)))
    return (F.lit(speed) * shape + rest * F.lit(speed / REST_SPEED)) / F.lit(rate)


def hastened(rate: Column) -> Column:
    return F.least(F.lit(3.0), rate * 2.2)


def smoothed(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Midpoints of the last three points, as the ends of a curve."""
    w = Window.partitionBy(*keys).orderBy(*order)
    b, a = F.lag("x", 1).over(w), F.lag("x", 2).over(w)
    return points.withColumns({"from_x": (a + b) / 2, "to_x": (b + F.col("x")) / 2})


def bounds(points: DataFrame, keys: list[str], width: float) -> DataFrame:
    """The box of each stroke, with half its width and two around."""
    pad = width / 2 + 2
    sides = {"left": F.min("x") - pad, "right": F.max("x") + pad}
    if "y" in points.columns:
        sides |= {"top": F.min("y") - pad, "bottom": F.max("y") + pad}
    return points.groupBy(*keys).agg(*[v.alias(k) for k, v in sides.items()], F.count(F.lit(1)).alias("n_points"))


def eased(points: DataFrame, keys: list[str], order: list[str], ease: float = EASE, piece: int = 256) -> DataFrame:
    """Pressure that follows its input by a share of the difference, from the first point of a stroke on.

    A stroke is folded in pieces. What a piece starts from is the end of the one before, folded alone: after
    ``piece`` steps its own start has shrunk by (1 - ease) ** piece, far below what a double holds.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    placed = points.withColumn("__n", n).withColumn("__piece", F.floor(F.col("__n") / piece))
    rows = placed.groupBy(*keys, "__piece").agg(F.array_sort(F.collect_list(F.struct("__n", *order, "p"))).alias("r"))

    def follow(last: Column, p: Column) -> Column:
        return F.when(last.isNull(), p).otherwise(last + (p - last) * ease)

    alone = F.aggregate("r", F.when(F.col("__piece") > 0, F.lit(0.0)), lambda last, r: follow(last, r["p"].cast("double")))
    start = F.lag("__end").over(Window.partitionBy(*keys).orderBy("__piece"))
    begun = rows.withColumn("__end", alone).withColumn("__start", start)
    first = F.struct(F.col("__start").alias("last"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, r: Column) -> Column:
        value = follow(acc["last"], r["p"].cast("double"))
        return F.struct(value.alias("last"), F.concat(acc["all"], F.array(value)).alias("all"))

    folded = begun.withColumn("e", F.aggregate("r", first, step, lambda a: a["all"]))
    return folded.select(*keys, F.explode(F.arrays_zip("r", "e")).alias("z")).select(*keys, *[F.col(f"z.r.{c}").alias(c) for c in order], F.col("z.e").alias("eased"))


def steady(points: DataFrame, keys: list[str], order: list[str], least: float = TREMOR) -> DataFrame:
    """Points that lie far enough (in squared distance) from the last one kept; sorted rows are walked with one point of memory."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stroke, x, y = None, 0.0, 0.0
        for batch in batches:
            kept = []
            for key, a, b in zip(zip(*[batch[k] for k in keys]), batch["x"], batch["y"]):
                far = key != stroke or (a - x) ** 2 + (b - y) ** 2 >= least
                kept.append(far)
                if far:
                    stroke, x, y = key, a, b
            yield batch[kept] if kept else batch

    return points.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, points.schema)


def advances(chars: DataFrame, keys: list[str], order: str, width: str) -> DataFrame:
    """How far each character of a line has come: the widths before it, its own included."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chars.withColumn("advance", F.sum(width).over(w))
