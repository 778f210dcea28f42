"""Token streams: published cases, every way to cut one, batch against streaming."""

import pytest
from pyspark.sql import functions as F

from quern.streaming import replies, sessions
from quern.streaming.replies import FRESH, fed


def read(*chunks):
    state, out = {**FRESH}, []
    for c in chunks:
        out += fed(state, c)
    out += fed(state, "", True)
    return next((t for k, t in out if k == "transcript"), None), "".join(t for k, t in out if k == "text")


def cleaner():
    """A stream whose heading is over; its leading blanks count."""
    state = {**FRESH, "heading": None, "begun": True}
    return lambda chunk, last=False: "".join(t for _, t in fed(state, chunk, last))


def clean(*chunks):
    feed = cleaner()
    return "".join(feed(x) for x in chunks) + feed("", True)


def test_transcript():
    assert read("⟦Hello there⟧\n", "How do you do. ", "I am here.") == ("Hello there", "How do you do. I am here.")
    assert read("no bracket") == (None, "no bracket")
    assert read("⟦never closed") == (None, "never closed")
    assert read("") == (None, "") and read("  \n ") == (None, "")


def test_every_cut():
    whole = "⟦What is your name?⟧\nMy name. And yours?"
    for i in range(len(whole) + 1):
        assert read(whole[:i], whole[i:]) == ("What is your name?", "My name. And yours?")
    assert read(*whole) == ("What is your name?", "My name. And yours?")


@pytest.mark.parametrize("chunks, out", [
    (["Good ", "<em", "phasis>", "evening."], "Good evening."),
    (["**Curious.** I have _read_ …  ## no"], "Curious. I have read … no"),
    (["It is 3 < 5, plainly, and this goes on for far longer than any tag would ever run on."], "It is 3 < 5, plainly, and this goes on for far longer than any tag would ever run on."),
    (["One.\n\n\n\n\nTwo."], "One.\n\nTwo."),
    (["One.\n\n", "\n\nTwo."], "One.\n\n\n\nTwo."),
    (["Before. <thin", "king>secret", " more</thin", "king>After."], "Before. After."),
    (["Kept. <thought>never closed"], "Kept. "),
    (["a\r\nb\rc"], "a\nb\nc"),
])
def test_clean(chunks, out):
    assert clean(*chunks) == out


def test_runaway_block():
    feed = cleaner()
    assert feed("<scratchpad>" + "x" * 5000) == "" and feed("visible tail") == "visible tail"


def test_held_bracket():
    feed = cleaner()
    assert feed("done <") == "done " and feed("", True) == "<"


def test_names_of_hiding_tags():
    assert clean("a<Thoughts >x</thoughts>y</Thoughts>b") == "ab" and clean("a<thoughtful>x</thoughtful>b") == "axb"
    assert clean("a</thought>b") == "ab" and clean("< thought>x</thought>b") == "b" and clean("<thinking k='1'>x</thinking>b") == "b"


def test_long_open_bracket():
    assert read("⟦" + "x" * 3999, "yy") == (None, "x" * 3999 + "yy") and read("⟦" + "x" * 4000, "⟧z") == ("x" * 4000, "z")


def test_batch_equals_stream(spark, tmp_path):
    rows = [(s, i, c) for s, text in enumerate(["⟦hi⟧\nA <b>bold</b> word", "plain  text", "<thinking>x</thinking>y"]) for i, c in enumerate([text[k : k + 4] for k in range(0, len(text), 4)])]
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string")
    batch = sorted(map(tuple, replies.joined(replies.split_streams(df)).collect()))
    last = df.groupBy("stream_id").agg(F.max("seq").alias("m"))
    marked = df.join(last, "stream_id").select("stream_id", "seq", "chunk", (F.col("seq") == F.col("m")).alias("last"))
    for half in (0, 1):
        marked.filter(f"seq % 10 {'<' if half == 0 else '>='} 3").coalesce(1).write.parquet(str(tmp_path / f"in/{half}"))
    source = spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = replies.live_replies(source).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination(120)
    live = sorted(map(tuple, replies.joined(spark.table("live")).collect()))
    assert [x[:1] for x in live] == [x[:1] for x in batch] and live == batch


def test_sessions(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "a"), (2, 1, "2024-01-01 00:00:01", "b"), (3, 1, "2024-01-01 00:00:05", "a"), (4, 2, "2024-01-01 00:00:05", "a")]
    df = spark.createDataFrame(rows, "event_id long, k long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r["session"] for r in sessions.sessions(df, "k", "ts", 1.8).orderBy("event_id").collect()]
    assert got == [0, 0, 1, 0]
    forced = [r["session"] for r in sessions.sessions(df, "k", "ts", 1.8, F.col("kind") == "a").orderBy("event_id").collect()]
    assert forced == [0, 1, 2, 0]


def test_live_view(spark, tmp_path):
    rows = spark.createDataFrame([(1, "inbox"), (1, "inbox"), (2, "work")], "id long, folder string").withColumn("date", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = sessions.live_rows(stream, "inbox").writeStream.format("memory").queryName("view").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["id"] for r in spark.table("view").collect()] == [1]
    assert sessions.visible(rows, "inbox", "x", "all").count() == 0


def test_split_orders_chunks(spark):
    df = spark.createDataFrame([(1, 1, "b"), (2, 0, "<x"), (1, 0, "a"), (2, 1, None), (3, 0, "")], "stream_id long, seq long, chunk string")
    got = replies.joined(replies.split_streams(df)).collect()
    assert {r["stream_id"]: r["text"] for r in got} == {1: "ab", 2: "<x"}
    assert replies.split_streams(df.limit(0)).count() == 0


def drained(stream, name, path, mode="append"):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).outputMode(mode).start().awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_live_scores(spark, tmp_path):
    df = spark.createDataFrame([("A@x.org", 1), ("a@X.org", 3), ("b@x.org", 2)], "address string, weight long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert {r["address"]: r["score"] for r in drained(sessions.live_scores(stream), "scores", str(tmp_path / "cp"), "complete")} == {"a@x.org": 4, "b@x.org": 2}


def test_live_bursts(spark, tmp_path):
    rows = [(1, 1, 0), (2, 1, 1), (3, 1, 5), (4, 2, 5), (5, 3, 9000)]
    df = spark.createDataFrame(rows, "event_id long, k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = {r["event_id"] for r in sessions.debounced(df, "k", "ts", 3).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r["event_id"] for r in drained(sessions.live_debounced(stream, "k", "ts", "3 seconds", "1 second"), "bursts", str(tmp_path / "cp"))}
    assert got == want - {5} and want == {2, 3, 4, 5}  # the last burst may still go on


def test_live_history(spark, tmp_path):
    rows = [(c, t, "user", f"{c}-{t}") for c in (1, 2) for t in range(5 * c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for half in (0, 1):
        df.filter(f"turn {'<' if half == 0 else '>='} 3").coalesce(1).write.parquet(str(tmp_path / f"in/{half}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = drained(sessions.live_history(stream, 4), "kept", str(tmp_path / "cp"))
    last = {c: sorted({r["turn"] for r in out if r["conv_id"] == c})[-4:] for c in (1, 2)}
    assert last == {1: [1, 2, 3, 4], 2: [6, 7, 8, 9]} and len(out) == 3 + 3 + 4 + 4
