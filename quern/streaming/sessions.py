"""Pauses, debounces, chords and live views over timed events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TURNS = "turn long, role string, text string"


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two moments, from whole microseconds, so that a gap of just the limit counts as that."""
    return (later - earlier) / 1_000_000


def sessions(events: DataFrame, key: str, ts: str, pause_seconds: float, commit: Column | None = None) -> DataFrame:
    """Number the sessions of each key from 0: a new one starts after a pause, or after an event that commits."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = _seconds(_micros(ts), F.lag(_micros(ts)).over(w)) >= pause_seconds
    new = F.coalesce(gap, F.lit(False))
    if commit is not None:
        new = new | F.coalesce(F.lag(commit).over(w), F.lit(False))
    return events.withColumn("session", F.sum(new.cast("long")).over(w))


def live_sessions(events: DataFrame, key: str, ts: str, pause: str, late: str = "1 hour") -> DataFrame:
    """The streaming form without commits: one row for each session once its pause and the allowed lateness are over."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, pause).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def debounced(events: DataFrame, key: str, ts: str, wait_seconds: float) -> DataFrame:
    """The last event of each burst: no other of its key follows within the wait."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    following = F.lead(_micros(ts)).over(w)
    return events.withColumn("__next", following).filter(F.col("__next").isNull() | (_seconds(F.col("__next"), _micros(ts)) >= wait_seconds)).drop("__next")


def live_debounced(events: DataFrame, key: str, ts: str, wait: str, late: str = "1 hour") -> DataFrame:
    """The streaming form: the last event of each burst, once its wait and the allowed lateness are over."""
    rest = F.struct(*[c for c in events.columns if c != key])
    bursts = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, wait).alias("s")).agg(F.max_by(rest, F.struct(ts, "event_id")).alias("e"))
    return bursts.select(key, "e.*")


def live_history(turns: DataFrame, kept: int = 60) -> DataFrame:
    """(conv_id, turn, role, text) to the turns that each conversation keeps after every batch: its last ones, in a state of that size."""

    class Kept(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.turns = handle.getListState("turns", TURNS)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
            for batch in rows:
                held += zip(batch["turn"].tolist(), batch["role"].tolist(), batch["text"].tolist())
            held = sorted(held)[-kept:]
            self.turns.put(held)
            yield pd.DataFrame([(key[0], *t) for t in held], columns=["conv_id", "turn", "role", "text"])

        def close(self) -> None:
            pass

    return turns.groupBy("conv_id").transformWithStateInPandas(Kept(), outputStructType=f"conv_id long, {TURNS}", outputMode="Append", timeMode="None")


def chords(events: DataFrame, key: str, ts: str, first: Column, within_seconds: float) -> DataFrame:
    """Events right after a ``first`` one of the same key, soon enough."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    soon = _seconds(_micros(ts), F.lag(_micros(ts)).over(w)) <= within_seconds
    marked = events.withColumns({"__f": F.lag(first).over(w), "__s": soon})
    return marked.filter("__f and __s").drop("__f", "__s")


def accepted(events: DataFrame, key: str, ts: str, kind: str, touch: bool = True) -> DataFrame:
    """Pen events always; others until a pen has been seen; touch if allowed."""
    w = Window.partitionBy(key).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    pen = F.col(kind) == "pen"
    seen = F.coalesce(F.bool_or(pen).over(w), F.lit(False))
    allowed = F.when(F.col(kind) == "touch", F.lit(touch)).otherwise(True)
    return events.withColumn("__ok", pen | (~seen & allowed)).filter("__ok").drop("__ok")


def latest_answers(responses: DataFrame, key: str, token: str) -> DataFrame:
    """Of the answers of each key that of the latest request."""
    return responses.groupBy(key).agg(F.max_by(F.struct(*responses.columns), F.col(token)).alias("r")).select("r.*")


def visible(rows: DataFrame, folder: str, query: str, kind: str) -> DataFrame:
    """New rows that a live view shows: of its folder, while nothing is searched and no filter of theirs is set."""
    if query or kind in ("flagged", "attachments"):
        return rows.filter(F.lit(False))
    return rows.filter(F.col("folder") == folder)


def live_rows(stream: DataFrame, folder: str, late: str = "1 hour") -> DataFrame:
    """The streaming form: each (folder, id) once."""
    return visible(stream, folder, "", "all").withWatermark("date", late).dropDuplicatesWithinWatermark(["folder", "id"])


def watched(spark: SparkSession, path: str, schema: str, at_once: int = 100) -> DataFrame:
    """New messages as they arrive: a stream over Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def inserted(new: DataFrame, shown: DataFrame) -> DataFrame:
    """New rows that the view doesn't hold yet, in front of it: each (folder, id) once."""
    return new.dropDuplicates(["folder", "id"]).join(shown.select("folder", "id"), ["folder", "id"], "left_anti")


def gated(parts: DataFrame, keys: list[str], order: str, text: str, last: str) -> DataFrame:
    """Pieces of a text with only whole words let through: each piece gives what it completes, the last one the rest.

    What is let through up to a piece ends at the last blank so far, so it is the text between two such places;
    their pieces are found by a window, and no stream is gathered in one row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    blank = F.col(text).rlike(r"\s")
    until = F.regexp_extract(F.col(text), r"(?s)\A(.*\s)", 1)
    rest = F.when(blank, F.substring(F.col(text), F.char_length(until) + 1, F.char_length(text))).otherwise(F.col(text))
    # Pieces between two that hold a blank belong to the word that the later one completes.
    group = F.coalesce(F.sum(blank.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = parts.withColumns({"__rest": rest, "__until": until, "__opens": blank | F.col(last), "__group": group})
    held = marked.groupBy(*keys, "__group").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), "__opens", "__until", F.col(last).alias("l"))) ).alias("p"))
    before = marked.filter(F.col("__until") != "").select(*keys, (F.col("__group") + 1).alias("__group"), F.col("__rest").alias("__lead"))
    joined = held.join(before, [*keys, "__group"], "left").withColumn("__lead", F.coalesce("__lead", F.lit("")))
    end = F.element_at("p", -1)
    whole = F.concat("__lead", F.array_join(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: x["t"]), ""), F.when(end["l"], end["t"]).otherwise(end["__until"]))
    return joined.filter(end["__opens"]).select(*keys, end["o"].alias(order), whole.alias("let_through")).filter("let_through <> ''")


def live_scores(stream: DataFrame) -> DataFrame:
    """Contact scores as a running aggregate; its state holds one row for each address that ever wrote."""
    return stream.groupBy(F.lower("address").alias("address")).agg(F.sum("weight").alias("score"))
