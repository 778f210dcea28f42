"""Changes of messages as new tables: flags, moves, deletion, sending, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all

FLAGS = ("seen", "flagged", "answered")


def set_flags(messages: DataFrame, ids: DataFrame, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> DataFrame:
    """Flags of the named messages: first those to add, then those to remove. Unknown flags are refused."""
    unknown = {*add, *remove} - {*FLAGS}
    if unknown:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    marked = messages.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    changed = {f: F.when(hit, F.lit(f not in remove)).otherwise(F.col(f)) for f in FLAGS if f in add or f in remove}
    return marked.withColumns(changed).select(*messages.columns)


def flags_from_log(log: DataFrame) -> DataFrame:
    """(id, flag, value, seq) to the last value of each flag of each message."""
    return log.groupBy("id").pivot("flag", list(FLAGS)).agg(F.max_by("value", "seq")).select("id", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])


def move(messages: DataFrame, ids: DataFrame, folders: DataFrame, to: str) -> DataFrame:
    """The named messages in the folder whose role or id is ``to``, the first by ``seq`` (or id); virtual and unknown targets change nothing."""
    place = F.col("seq") if "seq" in folders.columns else F.col("id")
    target = folders.filter(((F.col("role") == to) | (F.col("id") == to)) & ~F.col("virtual")).agg(F.min_by("id", place).alias("t")).scalar()
    marked = messages.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumn("folder", F.when(F.col("__hit"), F.coalesce(target, F.col("folder"))).otherwise(F.col("folder"))).select(*messages.columns)


def destroy(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("id").distinct(), "id", "left_anti")


def action(kind: str, folder: Column) -> Column:
    """What a key does in a folder: (action, target). Deletion in trash is final; archive and junk go back from there."""
    if kind == "delete":
        return F.struct(F.when(folder == "trash", "destroy").otherwise("move").alias("action"), F.when(folder != "trash", "trash").alias("target"))
    return F.struct(F.lit("move").alias("action"), F.when(folder == kind, "inbox").otherwise(kind).alias("target"))


def send(messages: DataFrame, mail: DataFrame, no_subject: str = "(без темы)") -> DataFrame:
    """Messages with the sent ones added: a reply joins the thread of its original, which is then answered.

    Both have message_id, in_reply_to and thread_key; ``mail`` brings the same columns. Answers to mails that are sent with them
    join their thread by ``threads.threaded``.
    """
    originals = messages.select(F.col("message_id").alias("__o"), F.col("thread_key").alias("__t")).dropDuplicates(["__o"])
    sent = mail.join(originals, F.col("in_reply_to") == F.col("__o"), "left")
    subject = F.when(F.trim(F.coalesce("subject", F.lit(""))) == "", no_subject).otherwise(F.col("subject"))
    sent = sent.withColumns({"thread_key": F.coalesce("__t", "thread_key"), "folder": F.lit("sent"), "subject": subject, "seen": F.lit(True)}).select(*messages.columns)
    replied = mail.select(F.col("in_reply_to").alias("message_id")).filter("message_id is not null").distinct().withColumn("__r", F.lit(True))
    marked = messages.join(replied, "message_id", "left").withColumn("answered", F.col("answered") | F.coalesce("__r", F.lit(False))).select(*messages.columns)
    return marked.unionByName(sent)


def latest_drafts(log: DataFrame) -> DataFrame:
    """(key, saved_at, deleted, ...) to the last state of each draft; deleted ones go. Newest first."""
    last = log.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "key"]), F.col("saved_at")).alias("d"))
    return last.select("key", "d.*").filter("not deleted").orderBy(F.col("saved_at").desc(), "key")


def read_all(messages: DataFrame, shown: DataFrame) -> DataFrame:
    """Everything that is shown and unread becomes seen."""
    return set_flags(messages, shown.filter(~F.col("seen")), add=("seen",))


def is_empty_draft(lead: Column, attachments: Column, answers: Column, recipients: Column, subject: Column) -> Column:
    """Nothing written or attached; recipients and a subject count unless they come from the message answered."""
    written = (trim_all(F.coalesce(lead, F.lit(""))) != "") | (F.size(attachments) > 0)
    given = (F.size(recipients) > 0) | (trim_all(F.coalesce(subject, F.lit(""))) != "")
    return ~written & (answers | ~given)


def kept_files(attachments: Column, draft: bool, most: int = 3 * 1024 * 1024 // 2) -> Column:
    """The attachments that are loaded; a draft keeps only small ones."""
    return F.filter(attachments, lambda a: a["loaded"] & (a["size"] < most if draft else F.lit(True)))


def discarded(log: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """The log of drafts with a tombstone for each of these keys."""
    return log.unionByName(_again(log, keys, at, True))


def restored(log: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """The log of drafts with the last state before deletion written again for each of these keys."""
    return log.unionByName(_again(log.filter("not deleted"), keys, at, False))


def _again(log: DataFrame, keys: DataFrame, at: Column, deleted: bool) -> DataFrame:
    rest = [c for c in log.columns if c not in ("key", "saved_at", "deleted")]
    last = log.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct(*rest), F.col("saved_at")).alias("d"))
    return last.select("key", at.alias("saved_at"), F.lit(deleted).alias("deleted"), "d.*").select(*log.columns)


def cleared(history: DataFrame, started: DataFrame) -> DataFrame:
    """History without what was said before the last new start of its conversation (conv_id, turn)."""
    last = started.groupBy("conv_id").agg(F.max("turn").alias("__start"))
    return history.join(last, "conv_id", "left").filter(F.col("__start").isNull() | (F.col("turn") >= F.col("__start"))).drop("__start")


def merged_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, value): stored values over the defaults."""
    s = stored.select("key", F.col("value").alias("__v"))
    return defaults.join(s, "key", "full").select("key", F.coalesce("__v", "value").alias("value"))
