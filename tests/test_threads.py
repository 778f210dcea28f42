"""Threads through chains of replies, and keyed tables, against plain walks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import changes, threads
from quern.sources.keyed import Keyed


def walked(links):
    out = {}
    for k in links:
        path, at = [k], k
        while links.get(at) in links and links[at] != at and links[at] not in path:
            at = links[at]
            path.append(at)
        to = links.get(at)
        if to in path and to != at:
            out[k] = (min(path[path.index(to) :]), None)
        else:
            out[k] = (at, len(path) - 1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_roots(spark, seed):
    rng = random.Random(seed)
    links = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(130)}  # a long chain
    links |= {f"s{i}": "c000" for i in range(60)}  # many answers to one message
    links |= {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {f"t{i}": f"t{i + 1}" for i in range(20)} | {"t20": "r4"}  # a circle and what hangs on it
    links |= {"self": "self", "lost": "nowhere", "a": "b", "b": "a", "d": "a"}
    links |= {f"x{i}": f"x{rng.randrange(40)}" for i in range(40)}
    rows = [*links.items(), (None, "c000"), ("c005", "c004")]
    rng.shuffle(rows)
    got = threads.roots(spark.createDataFrame(rows, "message_id string, in_reply_to string")).collect()
    assert {r["message_id"]: (r["root"], r["depth"]) for r in got} == walked(links) and len(got) == len(links)


def rings():
    """Circles of 2 to 9 and of 64 messages, with tails of up to 70 whose keys are smaller or larger than the circle's."""
    links = {}
    for n in (2, 3, 4, 5, 7, 8, 9, 64):
        ring = [f"k{n:02d}-{(i * 37) % n:03d}" for i in range(n)]
        ring = ring if len(set(ring)) == n else [f"k{n:02d}-{i:03d}" for i in range(n)]
        links |= dict(zip(ring, ring[1:] + ring[:1]))
        for name, at in (("a", 0), ("z", n - 1)):
            tail = [f"{name}{n:02d}-{i:03d}" for i in range(70 if n in (3, 8) else 5)]
            links |= dict(zip(tail, tail[1:] + [ring[at]]))
    return links


def test_circles_of_any_length(spark):
    links = rings()
    got = threads.roots(spark.createDataFrame([*links.items()], "message_id string, in_reply_to string")).collect()
    assert {r["message_id"]: (r["root"], r["depth"]) for r in got} == walked(links) and len(got) == len(links)


def test_rounds_follow_the_longest_way_not_the_number_of_messages(spark, monkeypatch):
    """Two thousand circles of three are found as soon as a pointer has gone around, in three rounds and not in thirteen."""
    made = []
    kept = threads.table
    monkeypatch.setattr(threads, "table", lambda df, name: made.append(name) or kept(df, name))
    links = spark.range(6000).select(F.concat(F.lit("m"), "id").alias("message_id"), F.concat(F.lit("m"), F.floor(F.col("id") / 3) * 3 + (F.col("id") + 1) % 3).alias("in_reply_to"))
    got = threads.roots(links)
    assert made.count("jumps") <= 3
    wrong = got.withColumn("n", F.substring("message_id", 2, 9).cast("long")).filter(F.col("depth").isNotNull() | (F.col("root") != F.array_min(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("m"), (F.floor(F.col("n") / 3) * 3 + i).cast("string"))))))
    assert got.count() == 6000 and wrong.count() == 0


def test_no_messages(spark):
    assert threads.roots(spark.createDataFrame([], "message_id string, in_reply_to string")).count() == 0


def test_a_reply_to_a_reply_joins_the_thread(spark):
    """Three mails sent at once, each an answer to the one before, to a message that has a thread."""
    kind = "id long, message_id string, in_reply_to string, thread_key string, folder string, subject string, seen boolean, answered boolean"
    held = spark.createDataFrame([(1, "m1", None, "T", "inbox", "s", True, False)], kind)
    sent = spark.createDataFrame([(i, f"m{i}", f"m{i - 1}", None, "drafts", "s", False, False) for i in (2, 3, 4)] + [(9, "m9", "gone", None, "drafts", "", False, False)], kind)
    whole = threads.threaded(changes.send(held, sent))
    assert {r["id"]: (r["thread_key"], r["folder"]) for r in whole.collect()} == {1: ("T", "inbox"), 2: ("T", "sent"), 3: ("T", "sent"), 4: ("T", "sent"), 9: ("m9", "sent")}


SCHEMA = "key long, saved_at long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {os.path.join(d, f) for d, _, some in os.walk(f"{path}/data") for f in some if f.endswith(".parquet")}


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Keyed(spark, path, "key", SCHEMA, 16)
    assert table.read().count() == 0 and table.compact() == 0
    rng, want = random.Random(1), {}
    for version in range(5):
        change = [(rng.randrange(40), rng.randrange(100), rng.choice(["a", "b", None])) for _ in range(25)]
        table.upsert(spark.createDataFrame(change, SCHEMA))
        for k in {k for k, _, _ in change}:
            want[k] = max((c for c in change if c[0] == k), key=lambda c: (c[1], c[2] is not None, c[2] or ""))
        gone = rng.sample(range(45), 4)
        table.delete(spark.createDataFrame([(k,) for k in gone], "key long"))
        want = {k: v for k, v in want.items() if k not in gone}
        if version == 2:
            table.compact()
        assert rows(Keyed(spark, path, "key", SCHEMA, 16).read()) == sorted(want.values())
    assert rows(table.get([1, 2, 3, 999])) == sorted(v for k, v in want.items() if k in (1, 2, 3))
    table.compact()
    assert rows(table.read()) == sorted(want.values())
    assert sum(map(len, table.state()["files"].values())) <= 16


def test_a_change_writes_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Keyed(spark, path, "key", SCHEMA, 64)
    table.upsert(spark.range(2_000).selectExpr("id AS key", "id AS saved_at", "'x' AS text"))
    before = files(path)
    assert len(before) == 64
    table.upsert(spark.range(10).selectExpr("id AS key", "id AS saved_at", "'y' AS text"))
    written = files(path) - before
    assert 0 < len(written) <= 10
    table.compact()
    assert len(files(path) - before - written) == len(written) and table.read().filter("text = 'y'").count() == 10 and table.read().count() == 2_000


def test_unfinished_changes_do_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    table, other = (Keyed(spark, path, "key", SCHEMA, 4) for _ in range(2))
    table.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    table._write(table._merged(table.state()["files"]).select(*table.stored.names))  # written, never listed
    assert rows(table.read()) == [(1, 1, "a")]
    late = other.state()
    table.upsert(spark.createDataFrame([(1, 2, "b")], SCHEMA))
    with pytest.raises(RuntimeError):
        other._commit({"version": late["version"] + 1, "files": {}})
    assert rows(other.read()) == [(1, 2, "b")]
