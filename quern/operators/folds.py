"""Folds along sequences of any length, walked in pieces at once.

A fold gives one sequence to one task, since each step needs the state that the one before left. Here a sequence is cut into
ranges, and each is walked from a guess of its starting state. In the next round each piece starts where the one before it
ended, and the rounds go on until no end changes; then every piece has been walked from the true state, by induction from the
first one. States forget their past quickly (the last point kept, the tag that is open), so that two rounds are the rule; at
worst each round makes one more piece right, which is the sequential walk.

A piece that leaves its state as it was is passed through: the next one starts from the last state that was made before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import table
from .ranges import PIECE, dealt


def folded(rows: DataFrame, keys: list[str], order: list[str], out: str, feed: Callable, first: object, guess: Callable, finish: Callable | None = None, pieces: int | None = None) -> DataFrame:
    """What ``feed`` gives for every row of each sequence (rows of equal ``keys``, by ``order``), as columns ``out``.

    ``feed(state, row)`` takes a row (a tuple in the order of the columns) and returns the new state and rows of ``out``; a state
    is anything that JSON can hold. ``first`` is the state before a sequence, ``guess(row)`` that before a piece which starts
    with this row. ``finish(state, row)`` gives what comes behind the last row.
    """
    placed = dealt(rows, keys, [F.col(c).asc() for c in order], pieces)
    columns, n = rows.columns, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in out.split(", ")]
    groups = placed.select(*keys, PIECE).distinct()
    w = Window.partitionBy(*keys).orderBy(PIECE)
    marked = table(groups.withColumns({"__opens": F.row_number().over(w) == 1, "__closes": F.lead(PIECE).over(w).isNull()}), "pieces")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keys}
    schema = f"{out}, {', '.join(f'__k_{c} {k}' for c, k in kinds.items())}, {PIECE} int, __end string"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, row, closes, start = None, None, None, False, None

        def end() -> tuple[list, tuple]:
            made = [*finish(state, row)] if finish and closes else []
            text = json.dumps(state)
            return made, (*[None] * len(names), *held, None if text == start else text)

        def frame(made: list, ends: list) -> pd.DataFrame:
            wide = [(*r, *[None] * (len(keys) + 2)) for r in made]
            return pd.DataFrame(wide + ends, columns=[*names, *[f"__k_{c}" for c in keys], PIECE, "__end"], dtype=object)

        for batch in batches:
            made, ends = [], []
            group = list(zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in keys], batch[PIECE]))
            for i, values in enumerate(zip(*[batch[c] for c in columns])):
                if group[i] != held:
                    if held is not None:
                        last, mark = end()
                        made += last
                        ends.append(mark)
                    held, closes = group[i], bool(batch["__closes"].iat[i])
                    given = batch["__start"].iat[i]
                    start = given if isinstance(given, str) else None
                    state = first if batch["__opens"].iat[i] else json.loads(start) if start is not None else guess(values)
                row = values
                state, some = feed(state, values)
                made += some
            yield frame(made, ends)
        if held is not None:
            last, mark = end()
            yield frame(last, [mark])

    def walked(starts: DataFrame) -> DataFrame:
        named = starts.select(*[F.col(c).alias(f"__w_{c}") for c in keys], F.col(PIECE).alias("__p"), "__opens", "__closes", "__start")
        on = F.col(PIECE) == F.col("__p")
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
        met = placed.join(named, on).drop("__p", *[f"__w_{c}" for c in keys])
        by = [*keys, PIECE]
        return table(met.repartition(n, *by).sortWithinPartitions(*by, *order).mapInPandas(walk, schema), "walked")

    def ends(done: DataFrame) -> DataFrame:
        return done.filter(F.col(PIECE).isNotNull()).select(*[F.col(f"__k_{c}").alias(c) for c in keys], PIECE, "__end")

    none = F.lit(None).cast("string")
    starts = marked.withColumn("__start", none)
    while True:
        done = walked(starts)
        on = [F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*keys, PIECE]]
        joined = marked.alias("m").join(ends(done).alias("e"), on).select("m.*", "e.__end")
        # The last state that was made before; a first piece starts a sequence, so it has none.
        before = F.last("__end", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = table(joined.withColumn("__start", before).drop("__end"), "starts")
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, PIECE]]
        moved = new.alias("a").join(starts.alias("b"), on).filter(~F.col("a.__opens") & ~F.col("a.__start").eqNullSafe(F.col("b.__start")))
        if moved.isEmpty():
            return done.filter(F.col(PIECE).isNull()).select(*names)
        starts = new


def steady(points: DataFrame, keys: list[str], order: list[str], least: float, pieces: int | None = None) -> DataFrame:
    """``layout.steady`` for strokes of any length: the points that lie far enough (in squared distance) from the last one kept."""
    at = [points.columns.index(c) for c in ("x", "y")]

    def feed(state, row):
        x, y = float(row[at[0]]), float(row[at[1]])
        if state is None or (x - state[0]) ** 2 + (y - state[1]) ** 2 >= least:
            return [x, y], [row]
        return state, []

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return folded(points, keys, order, kinds, feed, None, lambda row: None, pieces=pieces)


def split_streams(chunks: DataFrame, pieces: int | None = None) -> DataFrame:
    """``replies.split_streams`` for streams of any length; a piece is guessed to start in the midst of plain text."""
    from ..streaming.replies import FRESH, OUT, fed

    def feed(state, row):
        state = {**state}
        return state, [(row[0], row[1], *x) for x in fed(state, row[2] or "")]

    def finish(state, row):
        return [(row[0], row[1] + 1, *x) for x in fed({**state}, "", True)]

    return folded(chunks.select("stream_id", "seq", "chunk"), ["stream_id"], ["seq"], OUT, feed, {**FRESH}, lambda row: {**FRESH, "heading": None, "begun": True}, finish, pieces)
