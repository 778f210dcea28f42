"""Operator 1: sharding by jump consistent hashing.

A key is the seed of a 64-bit linear congruential generator whose draws say to which shard
numbers the key jumps as shards are appended; the last number below the shard count is its shard.
Nothing is stored, and appending a shard moves only the keys that jump onto it.

All of it is column arithmetic. Spark checks 64-bit multiplication for overflow, so the generator's
state is kept as two 32-bit halves and multiplied by 16-bit pieces.

Defined results: a null key is the key 0; a null text has no bytes and the checksum 0; rows with the
same key share a shard and get different slots; ties of key are ordered by checksum and size, and rows equal in all
three may swap slots, which changes no result as a whole; texts are measured whole, however long; an empty table
gives no rows; other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, utf8_len

# The multiplier of the published generator.
MULTIPLIER = 2862933555777941757
#: Draws tried in one step of the inner loop.
BLOCK = 32
MASK = 0xFFFFFFFF


def _seed(key: Column, kind: str) -> Column:
    whole = key.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    return F.coalesce(whole, F.lit(0).cast("long"))


def _draw(state: Column) -> Column:
    """The state after one more draw and jump."""
    low, high = MULTIPLIER & MASK, MULTIPLIER >> 32
    m0, m1 = F.lit(low & 0xFFFF).cast("long"), F.lit(low >> 16).cast("long")
    hi, lo = state["hi"], state["lo"]
    p0, p1 = lo * m0 + F.lit(1), lo * m1
    small = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    new_lo = small.bitwiseAND(F.lit(MASK))
    big = (
        F.shiftright(small, 32)
        + F.shiftright(p1, 16)
        + hi * m0
        + F.shiftleft((hi * m1).bitwiseAND(F.lit(0xFFFF)), 16)
        + lo * F.lit(high).cast("long")
    )
    new_hi = big.bitwiseAND(F.lit(MASK))
    reach = F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + F.lit(1)).cast("double")
    jump = F.floor((state["j"] + F.lit(1)).cast("double") * reach).cast("long")
    return F.struct(new_hi.alias("hi"), new_lo.alias("lo"), state["j"].alias("b"), jump.alias("j"))


def jump(key: Column, kind: str, shards: int) -> Column:
    """Struct of ``b``, the shard among ``shards``, and ``j``, the next shard number to take the key.

    ``kind`` is the key's Spark type: whole numbers are seeds as they are, others are hashed first.
    """
    seed = _seed(key, kind)
    start = F.struct(
        F.shiftrightunsigned(seed, 32).alias("hi"),
        seed.bitwiseAND(F.lit(MASK)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    n = F.lit(shards).cast("long")
    some = F.array(*[F.lit(0)] * min(BLOCK, shards))

    def step(state: Column, _: Column) -> Column:
        return F.when(state["j"] < n, _draw(state)).otherwise(state)

    if shards <= BLOCK:
        return F.aggregate(some, start, step)
    outer = F.sequence(F.lit(1), F.lit(-(-shards // BLOCK)))
    return F.aggregate(outer, start, lambda s, _: F.when(s["j"] < n, F.aggregate(some, s, step)).otherwise(s))


def assign(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with the shard of each row among ``shards``, and among one more."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = jump(F.col(key), df.schema[key].dataType.simpleString(), shards)
    after = F.when(F.col("__jump")["j"] == shards, F.lit(shards)).otherwise(F.col("__jump")["b"])
    return df.withColumn("__jump", state).withColumns({out: F.col("__jump")["b"].cast("int"), grown: after.cast("int")}).drop("__jump")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", buckets: int = 512) -> DataFrame:
    """Every document's shard and its gapless slot in that shard.

    One narrow shuffle carries key, size and checksum; texts stay in the scan.
    """
    narrow = docs.select(
        F.col(key).alias(key),
        (utf8_len(F.col(text)) + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = assign(narrow, key, shards).withColumn("law", F.lit("key"))
    return gapless_rank(placed, ["shard"], [key, "text_crc32", "size"], "slot", buckets)
