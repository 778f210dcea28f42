"""Streams with timers against their batch forms, for many cuts and orders."""

import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import sessions, timers

SCHEMA = "k long, ms long, event_id long, kind string, number long"


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000)).drop("ms")


def streamed(spark, tmp_path, df, live, name, cuts):
    """The rows of the live form over ``df`` in so many files, taken one by one, and an event far ahead of them that ends all waiting."""
    rows = df.collect()
    parts = [rows[i * len(rows) // cuts : (i + 1) * len(rows) // cuts] for i in range(cuts)]
    ahead = df.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("k"), F.lit(-1).cast("long").alias("event_id"), F.lit("none").alias("kind"), F.lit(0).cast("long").alias("number"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"))
    for i, part in enumerate([p for p in parts if p]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    ahead.select(*df.columns).write.parquet(str(tmp_path / "in/999"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = live(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination(240)
    return sorted(tuple(r) for r in spark.table(name).collect() if r[0] != -1)


def plain(df):
    return sorted(map(tuple, df.collect()))


SENDS = [
    (1, 0, 1, "send", 5000), (2, 10, 2, "send", 5000), (2, 4000, 3, "cancel", None),  # the second is undone
    (3, 20, 4, "send", 10000), (3, 10020, 5, "cancel", None),  # too late by nothing
    (4, 30, 6, "cancel", None), (4, 40, 7, "send", 5000),  # before its send
    (5, 50, 8, "send", 0), (5, 50, 9, "cancel", None),  # nothing to undo
    (6, 60, 10, "send", 20000), (6, 61, 11, "send", 20000), (6, 70, 12, "cancel", None),  # a repeat of the send
    (7, 80, 13, "cancel", None),
]


def test_sends(spark):
    assert [r[:2] for r in plain(timers.sends(events(spark, SENDS), "k"))] == [(1, 1), (3, 4), (4, 7), (5, 8)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_live_sends(spark, tmp_path, cuts):
    df = events(spark, SENDS)
    assert streamed(spark, tmp_path, df, lambda s: timers.live_sends(s, "k", "1 hour"), f"sends{cuts}", cuts) == plain(timers.sends(df, "k"))


def random_events(kinds, seed, n=120, mess=0):
    """Events of four keys in order of time, each moved by ``mess`` places at most."""
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 100, 700, 1200, 1800, 2800, 5000])
        k = rng.randrange(4)
        rows.append((k, at, i, rng.choice(kinds), [1200, 1800, 2800, 0][k]))
    order = sorted(range(n), key=lambda i: i + rng.uniform(0, mess))
    return [rows[i] for i in order]


@pytest.mark.parametrize("cuts, mess", [(1, 0), (5, 0), (6, 15)])
def test_live_pauses(spark, tmp_path, cuts, mess):
    df = events(spark, random_events(["stroke"] * 6 + ["end"], cuts, mess=mess))
    want = plain(timers.pauses(df, "k"))
    assert len(want) > 30 and {r[4] for r in want} == {True, False} and {r[0] for r in want} == {0, 1, 2, 3}
    assert streamed(spark, tmp_path, df, lambda s: timers.live_pauses(s, "k", late="2 minutes"), f"pauses{cuts}", cuts) == want


@pytest.mark.parametrize("cuts, mess", [(4, 12)])
def test_live_chords_and_pens(spark, tmp_path, cuts, mess):
    df = events(spark, random_events(["g", "x", "y"], 3, mess=mess))
    want = plain(sessions.chords(df, "k", "ts", F.col("kind") == "g", 1.2).select("k", "event_id", "ts", "kind"))
    assert len(want) > 5
    assert streamed(spark, tmp_path / "a", df, lambda s: timers.live_chords(s, "k", "g", 1200, "2 minutes"), "chords", cuts) == want
    df = events(spark, random_events(["touch", "mouse"] * 9 + ["pen"], 4, mess=mess))
    for touch in (True, False):
        want = plain(sessions.accepted(df, "k", "ts", "kind", touch).select("k", "event_id", "ts", "kind"))
        assert streamed(spark, tmp_path / str(touch), df, lambda s: timers.live_accepted(s, "k", touch, "2 minutes"), f"pens{touch}", cuts) == want  # noqa: B023


@pytest.mark.parametrize("cuts, mess", [(1, 0), (3, 0), (4, 9)])
def test_live_gate(spark, tmp_path, cuts, mess):
    rng = random.Random(7)
    rows = []
    for k in range(3):
        text = "".join(rng.choice(["one", " ", "two\n", "\t", "é", "  x"]) for _ in range(30))
        at = sorted(rng.sample(range(1, len(text)), 12))
        pieces = [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
        rows += [(k, i, p, i == 12) for i, p in enumerate(pieces)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] * 3 + rng.uniform(0, 3 * mess))
    df = spark.createDataFrame([rows[i] for i in order], "k long, seq long, text string, last boolean")
    want = plain(sessions.gated(df, ["k"], "seq", "text", "last").select("k", "seq", "let_through"))
    parts = df.collect()
    for i in range(cuts):
        spark.createDataFrame(parts[i * len(parts) // cuts : (i + 1) * len(parts) // cuts], df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = timers.live_gated(source, "k").writeStream.format("memory").queryName(f"gate{cuts}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination(240)
    assert plain(spark.table(f"gate{cuts}")) == want
