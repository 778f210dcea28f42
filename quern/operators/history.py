"""Conversation history as it is sent to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import ordinal
from .mailbox import last_of_each


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("role").isin("user", "assistant") & F.col("text").rlike(r"\S"))


def tail(df: DataFrame, n: int = 40, most: int = 4000) -> DataFrame:
    """The last ``n`` valid turns of each conversation, each cut to ``most`` characters."""
    return last_of_each(valid(df), ["conv_id"], [F.col("turn").desc()], n).withColumn("text", F.substring("text", 1, most))


def ledger(df: DataFrame, them: str, me: str) -> DataFrame:
    """The sitting read back: who said what, in order."""
    who = F.when(F.col("role") == "assistant", them).otherwise(me)
    return df.select("conv_id", "turn", who.alias("who"), F.col("text").alias("content"))


def turn_numbers(df: DataFrame) -> DataFrame:
    return df.groupBy("conv_id").agg((F.count_if(F.col("role") == "user") + 1).alias("turn_number"))


def clean_turn(x: Column) -> Column:
    """A finite number of 1 or more, rounded down; anything else is 1."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(1).cast("long"), F.floor(x))).otherwise(F.lit(1).cast("long"))


def frame(turn: Column, first: str, later: str) -> Column:
    """The prompt of a turn; ``later`` has {} for the turn's ordinal."""
    a, b = later.split("{}")
    return F.when(turn == 1, first).otherwise(F.concat(F.lit(a), ordinal(turn), F.lit(b)))


def assembled(df: DataFrame, prompt: Column, n: int = 40) -> DataFrame:
    """One row for each conversation: its messages in order, and the prompt as the last of the user's."""
    turns = tail(df, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    told = turns.join(turn_numbers(df), "conv_id")
    said = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return told.select("conv_id", F.concat(said, F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))).alias("messages"))


def reply_source(df: DataFrame, key: str, mine: Column, order: str) -> DataFrame:
    """The message to answer in each thread: the last that isn't mine, else the last."""
    return df.groupBy(key).agg(F.coalesce(F.max_by("id", F.when(~mine, F.col(order))), F.max_by("id", order)).alias("reply_to_id"))


def appended(df: DataFrame, said: DataFrame, blank: str = "…") -> DataFrame:
    """History with a user's turn and, if there is one, its answer added to each conversation; (conv_id, transcript, answer)."""
    last = df.groupBy("conv_id").agg(F.max("turn").alias("__last"))
    new = said.join(last, "conv_id", "left").withColumn("__last", F.coalesce("__last", F.lit(-1)))
    user = new.select("conv_id", (F.col("__last") + 1).alias("turn"), F.lit("user").alias("role"), F.coalesce(F.nullif("transcript", F.lit("")), F.lit(blank)).alias("text"))
    answer = new.filter(F.coalesce("answer", F.lit("")) != "").select("conv_id", (F.col("__last") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(user).unionByName(answer)


def first_turns(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter(F.col("__r") <= n).drop("__r")
