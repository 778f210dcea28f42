"""Streams with timers and small states: undo-send, pauses, chords, pens and the word gate; and their batch forms.

A live form gives the rows of its batch form, however the events are cut into micro-batches and in whatever order they come
within the lateness allowed. Events wait in their key's state until the watermark has passed them, and are then taken in order
of time (``Ordered``); so a state holds the events of the allowed lateness, and beside them one value: a session, a key press, a
flag. The word gate goes by numbers, not by time, and holds one tail and the pieces that came too early.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What waits for the watermark: when (microseconds), which, what kind, and a number that the kind explains.
EVENT = "at long, event_id long, kind string, number long"


def sends(actions: DataFrame, key: str = "send_id") -> DataFrame:
    """What goes out, and when: (key, event_id, due).

    An id names one send, its earliest; its delay (``number``) is counted in milliseconds. It goes out when its delay is over,
    unless a cancellation of that id comes after the send and before that moment. A delay of 0 can't be cancelled, and a
    cancellation undoes no send but its own.
    """
    whole = Window.partitionBy(key)
    first = F.min(F.when(F.col("kind") == "send", F.struct("ts", "event_id", "number"))).over(whole)
    due = F.timestamp_micros(F.unix_micros(first["ts"]) + 1000 * first["number"].cast("long"))
    later = F.struct("ts", "event_id") > F.struct(first["ts"], first["event_id"])
    undone = F.bool_or((F.col("kind") == "cancel") & later & (F.col("ts") < due)).over(whole)
    rows = actions.withColumns({"__first": first["event_id"], "due": due, "__undone": F.coalesce(undone, F.lit(False))})
    return rows.filter((F.col("event_id") == F.col("__first")) & ~F.col("__undone")).select(key, "event_id", "due").distinct()


def pauses(events: DataFrame, key: str, ended: str = "end") -> DataFrame:
    """Sessions of each key: (key, start, end, n, forced).

    ``number`` is the key's pause in milliseconds; an event that comes a pause or more after the one before starts a session, but a
    pause of 0 never ends one. An event of the kind ``ended`` belongs to its session and closes it at once (forced). What
    neither a pause nor such an event has closed is still open and not part of the result, unless it is the last of a key whose
    pause ends it later anyway.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = (F.col("number") > 0) & (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) >= 1000 * F.col("number").cast("long"))
    new = F.coalesce(gap, F.lit(False)) | F.coalesce(F.lag(F.col("kind")).over(w) == ended, F.lit(False))
    rows = events.withColumn("__s", F.sum(new.cast("long")).over(w))
    last = F.max_by(F.struct("kind", "number"), F.struct("ts", "event_id"))
    out = rows.groupBy(key, "__s").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), last.alias("__last"))
    numbered = out.withColumn("__after", F.lead("start").over(Window.partitionBy(key).orderBy("__s")))
    closed = (F.col("__last.kind") == ended) | (F.col("__last.number") > 0) | F.col("__after").isNotNull()
    return numbered.filter(closed).select(key, "start", "end", "n", (F.col("__last.kind") == ended).alias("forced"))


class Ordered(StatefulProcessor):
    """Takes a key's events in order of time once the watermark has passed them.

    ``step(state, event)`` and ``lapse(state, watermark)`` give the new state and the rows that go out; ``due(state)`` is the
    time at which the state lapses by itself, or None.
    """

    def __init__(self, state: str, columns: list[str], step: Callable, lapse: Callable, due: Callable):
        self.schema, self.columns, self.step, self.lapse, self.due = state, columns, step, lapse, due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.state = handle.getValueState("state", self.schema)

    def taken(self, key, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting = sorted([*(self.waiting.get() if self.waiting.exists() else []), *new])
        state, out = (self.state.get() if self.state.exists() else None), []
        ready = [e for e in waiting if e[0] <= watermark]
        rest = waiting[len(ready) :]
        for event in ready:
            state, rows = self.step(state, tuple(event))
            out += rows
        state, rows = self.lapse(state, watermark)
        out += rows
        if rest:
            self.waiting.put([tuple(e) for e in rest])
        elif self.waiting.exists():
            self.waiting.clear()
        if state is not None:
            self.state.update(tuple(state))
        elif self.state.exists():
            self.state.clear()
        times = [rest[0][0]] if rest else []
        if (due := self.due(state)) is not None:
            times.append(due)
        wanted = {-(-min(times) // 1000)} if times else set()  # in milliseconds, not before
        held = {t for t in self.handle.listTimers()}
        for t in held - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - held:
            self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [e for batch in rows for e in zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["kind"].tolist(), batch["number"].tolist())]
        yield from self.taken(key, new, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.taken(key, [], 1000 * timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _ordered(events: DataFrame, key: str, late: str, state: str, out: str, step: Callable, lapse: Callable = lambda state, now: (state, []), due: Callable = lambda state: None) -> DataFrame:
    slim = events.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), "event_id", "kind", F.coalesce(F.col("number").cast("long"), F.lit(0)).alias("number"))
    kind = slim.schema[key].dataType.simpleString()
    columns = [key, *[c.split()[0] for c in out.split(", ")]]
    return slim.groupBy(key).transformWithStateInPandas(Ordered(state, columns, step, lapse, due), outputStructType=f"{key} {kind}, {out}", outputMode="Append", timeMode="EventTime")


def _times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in names})


def live_sends(actions: DataFrame, key: str = "send_id", late: str = "1 minute") -> DataFrame:
    """``sends`` as a stream: a send sets its timer, and its cancellation keeps it back.

    The state of a send goes once its delay is over; an id that is used again after that names a new send here."""

    def step(state, event):
        at, event_id, kind, delay = event
        if state is None and kind == "send":
            return (event_id, at + 1000 * delay, True), []
        if state is not None and kind == "cancel" and at < state[1]:
            return (state[0], state[1], False), []  # repeats of the send find it undone until it is over
        return state, []

    def lapse(state, now):
        if state is None or now < state[1]:
            return state, []
        return None, [(state[0], state[1])] if state[2] else []

    out = _ordered(actions, key, late, "event_id long, due long, goes boolean", "event_id long, due long", step, lapse, lambda state: state and state[1])
    return _times(out, "due")


def live_pauses(events: DataFrame, key: str, ended: str = "end", late: str = "1 minute") -> DataFrame:
    """``pauses`` as a stream: each event sets the timer anew, an event that ends a session commits it at once."""

    def step(state, event):
        at, _, kind, pause = event
        out = []
        if state is not None and pause > 0 and at - state[1] >= 1000 * pause:
            state, out = None, [(*state[:3], False)]
        state = (state[0], at, state[2] + 1, pause) if state is not None else (at, at, 1, pause)
        return (None, [*out, (*state[:3], True)]) if kind == ended else (state, out)

    def lapse(state, now):
        if state is None or not state[3] or now < state[1] + 1000 * state[3]:
            return state, []
        return None, [(*state[:3], False)]

    due = lambda state: state[1] + 1000 * state[3] if state and state[3] else None
    return _times(_ordered(events, key, late, "start long, end long, n long, pause long", "start long, end long, n long, forced boolean", step, lapse, due), "start", "end")


def live_chords(events: DataFrame, key: str, first: str, within_ms: int, late: str = "1 minute") -> DataFrame:
    """``sessions.chords`` as a stream: the state is the last key press."""

    def step(state, event):
        at, event_id, kind, _ = event
        hit = state is not None and state[1] == first and at - state[0] <= 1000 * within_ms
        return (at, kind), [(event_id, at, kind)] if hit else []

    def lapse(state, now):
        # A press that nothing can follow soon enough any more is as good as none.
        return (None if state is not None and now > state[0] + 1000 * within_ms else state), []

    return _times(_ordered(events, key, late, "at long, kind string", "event_id long, ts long, kind string", step, lapse, lambda state: state and state[0] + 1000 * within_ms + 1), "ts")


def live_accepted(events: DataFrame, key: str, touch: bool = True, late: str = "1 minute") -> DataFrame:
    """``sessions.accepted`` as a stream: the state says that a pen has been seen."""

    def step(state, event):
        at, event_id, kind, _ = event
        pen = kind == "pen"
        ok = pen or (state is None and (touch or kind != "touch"))
        return (True,) if pen else state, [(event_id, at, kind)] if ok else []

    return _times(_ordered(events, key, late, "seen boolean", "event_id long, ts long, kind string", step), "ts")


def let_through(tail: str, text: str, last: bool) -> tuple[str, str]:
    """(what a piece completes, the new tail): up to the last blank, or all at the end."""
    whole = tail + text
    if last:
        return whole, ""
    end = max((i + 1 for i in range(len(whole) - 1, len(tail) - 1, -1) if whole[i] in " \t\n\x0b\f\r"), default=0)
    return whole[:end], whole[end:]


def live_gated(parts: DataFrame, key: str, order: str = "seq", text: str = "text", last: str = "last", forget: str = "1 hour") -> DataFrame:
    """``sessions.gated`` as a stream: pieces are numbered from 0 and may come in any order; (key, seq, let_through).

    A key's state is its tail, the next number and what came too early; the last piece clears it, and so does silence.
    """
    ttl = int(pd.Timedelta(forget).total_seconds() * 1000)

    class Gate(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.tail = handle.getValueState("tail", "next long, tail string", ttlDurationMs=ttl)
            self.early = handle.getMapState("early", "seq long", "text string, last boolean", ttlDurationMs=ttl)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            at, tail = self.tail.get() if self.tail.exists() else (0, "")
            new = {n: (t or "", bool(z)) for batch in rows for n, t, z in zip(batch[order].tolist(), batch[text].tolist(), batch[last].tolist())}
            out, over = [], False
            while not over:
                if at in new:
                    piece, over = new.pop(at)
                elif self.early.containsKey((at,)):
                    piece, over = self.early.getValue((at,))
                    self.early.removeKey((at,))
                else:
                    break
                through, tail = let_through(tail, piece, over)
                if through:
                    out.append((key[0], at, through))
                at += 1
            for n, value in new.items():
                if n > at and not over:
                    self.early.updateValue((n,), value)
            if over:
                self.tail.clear()
                self.early.clear()
            else:
                self.tail.update((at, tail))
            yield pd.DataFrame(out, columns=[key_name, order, "let_through"])

        def close(self) -> None:
            pass

    key_name = key
    kind = parts.schema[key].dataType.simpleString()
    slim = parts.select(key, F.col(order).cast("long").alias(order), text, last)
    return slim.groupBy(key).transformWithStateInPandas(Gate(), outputStructType=f"{key} {kind}, {order} long, let_through string", outputMode="Append", timeMode="ProcessingTime")
