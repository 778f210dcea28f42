"""Threads through chains of replies, by pointer jumping.

Each message points at the one it answers. A round lets every pointer jump to where its target points, so that a chain of n
replies is followed in log n rounds of one join each. Messages whose pointer stands at a root are done and leave the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import table


def roots(messages: DataFrame, key: str = "message_id", parent: str = "in_reply_to") -> DataFrame:
    """(key, root, depth): the oldest ancestor of each message and how many replies lie between.

    A message that answers nothing, itself, or one that isn't there, is its own root. Of a key's rows the one with the smallest
    parent counts, and null keys are left out. Messages that answer each other in a circle have the smallest key of the circle
    as their root, and so has everything that hangs on it; their depth is null.
    """
    links = messages.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(parent).alias("to"))
    known = links.select(F.col("key").alias("__k"))
    linked = links.join(known, F.col("to") == F.col("__k"), "left")
    linked = table(linked.select("key", F.when(F.col("__k") != F.col("key"), F.col("__k")).alias("to")), "links")
    done = linked.filter("to is null").select("key", F.col("key").alias("root"), F.lit(0).cast("long").alias("depth"))
    open_ = linked.filter("to is not null").select("key", "to", F.lit(1).cast("long").alias("steps"), F.col("key").alias("low"))
    parts = [done]
    # A message is done when its pointer stands at one that is done; what a round finishes is a table of its own.
    finished = table(done, "roots")
    while True:
        ahead = open_.select(F.col("key").alias("__k"), F.col("to").alias("__to"), F.col("steps").alias("__s"), F.col("low").alias("__low"))
        ends = finished.select(F.col("key").alias("__e"), F.col("root").alias("__r"), F.col("depth").alias("__d"))
        met = open_.join(ends, F.col("to") == F.col("__e"), "left").join(ahead, F.col("to") == F.col("__k"), "left")
        # What lies ahead of the target holds the message itself: it is on a circle, all of which it has seen, and is its smallest key.
        ring = (F.col("low") == F.col("key")) & F.coalesce(F.col("__low") == F.col("key"), F.lit(False))
        met = met.select("key", "__r", (F.col("steps") + F.col("__d")).alias("depth"), "__to", (F.col("steps") + F.col("__s")).alias("steps"), F.least("low", "__low").alias("low"), ring.alias("ring"))
        met = table(met, "jumps")
        if met.filter("ring").limit(1).count():
            # Who has seen a circle's smallest key hangs on that circle.
            circles = met.filter("ring").select(F.col("key").alias("__c"))
            met = met.join(circles, F.col("low") == F.col("__c"), "left").withColumn("__r", F.coalesce("__r", "__c")).drop("__c")
            met = table(met, "circles")
        parts.append(met.filter("__r is not null").select("key", F.col("__r").alias("root"), "depth"))
        open_ = met.filter("__r is null").select("key", F.col("__to").alias("to"), "steps", "low")
        if not open_.limit(1).count():
            break
        finished = parts[0]
        for part in parts[1:]:
            finished = finished.union(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.col("key").alias(key), "root", "depth")


def threaded(messages: DataFrame, thread: str = "thread_key", key: str = "message_id", parent: str = "in_reply_to") -> DataFrame:
    """``messages`` in the thread of their oldest ancestor: its own thread, or its key where it has none.

    So a reply to a reply that was sent in the same table joins the thread, too; messages without a key keep what they have.
    """
    found = roots(messages, key, parent).select(F.col(key).alias("__key"), "root")
    named = messages.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__root")).agg(F.min(F.col(thread).cast("string")).alias("__thread"))
    whole = found.join(named, F.col("root") == F.col("__root")).select("__key", F.coalesce("__thread", "root").alias("__thread"))
    joined = messages.join(whole, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(thread, F.coalesce("__thread", F.col(thread).cast("string"))).select(*messages.columns)
