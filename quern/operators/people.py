"""Participants, contacts and recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_name

AUTOMATIC = r"(?i)no-?reply|notifications?@|mailer-daemon"


def participants(messages: DataFrame, key: str, lists: list[str], me: str | None = None) -> DataFrame:
    """Distinct addresses over all address arrays of a thread, all and without mine."""
    people = messages.select(key, F.explode(F.concat(*lists)).alias("p"))
    mine = F.lower("p.address") == F.lit((me or "").lower())
    return people.groupBy(key).agg(F.count_distinct("p.address").alias("n_people"), F.count_distinct(F.when(~mine, F.col("p.address"))).alias("n_others"))


def contact_scores(people: DataFrame) -> DataFrame:
    """(address, name, weight, seq) to one scored contact for each address; the last name that isn't empty stays."""
    good = people.filter(F.col("address").isNotNull() & (F.col("address") != "") & ~F.col("address").rlike(AUTOMATIC))
    named = F.when(F.col("name") != "", F.col("seq"))
    return good.groupBy(F.lower("address").alias("address")).agg(F.coalesce(F.max_by("name", named), F.lit("")).alias("name"), F.sum("weight").alias("score"), F.min("seq").alias("first_seq"))


def kept_contacts(contacts: DataFrame, most: int = 800) -> DataFrame:
    return contacts.orderBy(F.col("score").desc(), "first_seq").limit(most)


def suggest(contacts: DataFrame, query: str, exclude: tuple[str, ...] = (), most: int = 6) -> DataFrame:
    """The best contacts whose address or name contains the query, or a word of whose name starts with it."""
    q = query.strip().lower()
    if not q:
        return contacts.limit(0)
    name = F.lower("name")
    hit = F.contains("address", F.lit(q)) | F.exists(F.split(name, r"\s+"), lambda w: F.startswith(w, F.lit(q))) | F.contains(name, F.lit(q))
    rows = contacts.filter(hit)
    if exclude:
        rows = rows.filter(~F.col("address").isin(*exclude))
    return rows.orderBy(F.col("score").desc(), "first_seq").limit(most)


def reply_to_all(me: str, sender: Column, reply_to: Column, to: Column, cc: Column) -> Column:
    """(to, cc) of a reply to all: mine and those already in ``to`` leave ``cc``, first mention stays."""
    from_me = F.lower(sender["address"]) == F.lit(me.lower())
    answered = F.when(from_me, to).when(F.size(reply_to) > 0, reply_to).otherwise(F.array(sender))
    others = F.concat(F.when(from_me, F.slice(to, 1, 0)).otherwise(to), cc)
    mails = F.transform(answered, lambda a: a["address"])

    def add(kept: Column, a: Column) -> Column:
        known = F.array_contains(mails, a["address"]) | F.exists(kept, lambda k: k["address"] == a["address"])
        return F.when((F.lower(a["address"]) == F.lit(me.lower())) | known, kept).otherwise(F.concat(kept, F.array(a)))

    return F.struct(answered.alias("to"), F.aggregate(others, F.slice(others, 1, 0), add).alias("cc"))


def envelope(to: Column, cc: Column, bcc: Column) -> Column:
    return F.transform(F.concat(to, cc, bcc), lambda a: a["address"])


def without_bcc(df: DataFrame) -> DataFrame:
    """What is stored and sent on: blind copies stand in the envelope only."""
    return df.withColumn("envelope", envelope(F.col("to"), F.col("cc"), F.col("bcc"))).drop("bcc")


def promoted(to: Column, cc: Column) -> Column:
    """Copies become recipients where there are none."""
    empty = (F.size(to) == 0) & (F.size(cc) > 0)
    return F.struct(F.when(empty, cc).otherwise(to).alias("to"), F.when(empty, F.slice(cc, 1, 0)).otherwise(cc).alias("cc"))


def first_names(messages: DataFrame, key: str, order: list[str], me: str, most: int = 3) -> DataFrame:
    """The last distinct first names of a thread by their first mention, oldest first, and its messages; mine is a word of its own.

    Each name is one row before a thread's names are ranked, so that no thread's messages meet in one row.
    """
    shown = F.when(F.lower("from.address") == me.lower(), "я").otherwise(F.get(F.split(display_name(F.col("from.name"), F.col("from.address")), r"\s+"), F.lit(0)))
    names = messages.select(key, F.struct(*order).alias("at"), shown.alias("who")).groupBy(key, "who").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    counts = names.groupBy(key).agg(F.sum("n").alias("n"))
    last = names.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").desc()))).filter(F.col("__r") <= most)
    lists = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "who"))).alias("r"))
    return lists.join(counts, key).select(key, F.array_join(F.transform("r", lambda x: x["who"]), ", ").alias("who"), "n")


def people_line(to: Column, cc: Column, me: str) -> Column:
    def listed(people: Column) -> Column:
        return F.array_join(F.transform(people, lambda a: F.when(F.lower(a["address"]) == me.lower(), "мне").otherwise(display_name(a["name"], a["address"]))), ", ")

    return F.concat_ws(" · ", F.when(F.size(to) > 0, F.concat(F.lit("кому: "), listed(to))), F.when(F.size(cc) > 0, F.concat(F.lit("копия: "), listed(cc))))
