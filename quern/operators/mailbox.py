"""Listing, searching, paging, counting and threading of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_to_text, snippet, strip_subject, thread_subject, trim_all
from .ranges import breaks as breaks_ranged
from .ranges import next_known

FLAGGED = "flagged"
HIDDEN = ("trash", "junk")
# How a server is asked for attachments, in its own search language and by a header.
ATTACHED_WORD, ATTACHED_TYPE = "has:attachment", "multipart/mixed"


def in_folder(df: DataFrame, folder: str) -> DataFrame:
    """The rows of a folder; the virtual one holds what is flagged outside trash and junk."""
    if folder == FLAGGED:
        return df.filter(F.col("flagged") & ~F.col("folder").isin(*HIDDEN))
    return df.filter(F.col("folder") == folder)


def contains_text(fields: list[Column], query: str) -> Column:
    """The fields, joined by single blanks, contain the query, whatever its case. A hit may span two fields."""
    parts = []
    for f in fields:
        parts += [F.coalesce(f, F.lit("")), F.lit(" ")]
    return F.contains(F.lower(F.concat(*parts[:-1])), F.lit(query.lower()))


def searched(df: DataFrame, fields: list[Column], query: str, folder: str = "inbox") -> DataFrame:
    """All folders but trash, unless trash is the open one; a literal query."""
    scope = df if folder == "trash" else df.filter(F.col("folder") != "trash")
    return scope.filter(contains_text(fields, query))


def any_field_contains(fields: list[Column], query: str) -> Column:
    """The server-side form of the search: one of the fields alone contains the query."""
    out = F.lit(False)
    for f in fields:
        out = out | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(query.lower()))
    return out


def narrowed(df: DataFrame, kind: str) -> DataFrame:
    """Unread, flagged or with attachments; any other kind keeps all."""
    terms = {"unread": lambda: ~F.col("seen"), "flagged": lambda: F.col("flagged"), "attachments": lambda: F.col("has_attachments")}
    return df.filter(terms[kind]()) if kind in terms else df


def with_attachments(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Messages with has_attachments: at least one that isn't inline."""
    some = attachments.filter(~F.coalesce(F.col("inline"), F.lit(False))).select(F.col("message_id").alias("id")).distinct().withColumn("has_attachments", F.lit(True))
    return messages.join(some, "id", "left").withColumn("has_attachments", F.coalesce("has_attachments", F.lit(False)))


def criteria(fields: list[Column], query: str, kind: str, content_type: Column) -> Column:
    """The server-side form of a listing's conditions: any one field has the query; attachments show in the content type."""
    out = any_field_contains(fields, query) if query else F.lit(True)
    terms = {"unread": ~F.col("seen"), "flagged": F.col("flagged"), "attachments": F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(ATTACHED_TYPE))}
    return out & terms[kind] if kind in terms else out


def asked_criteria(query: Column, kind: Column, raw: Column) -> Column:
    """What a server is asked for a listing: (raw, text, seen, flagged, content_type), or null where nothing is.

    A server with a search language of its own (``raw``) gets the query as it is, and attachments by a word of that language;
    others get a text that one of the fields must contain, and a content type.
    """
    q = F.nullif(query, F.lit(""))
    files = kind == "attachments"
    own = F.nullif(F.concat_ws(" ", q, F.when(files, F.lit(ATTACHED_WORD))), F.lit(""))
    out = F.struct(
        F.when(raw, own).alias("raw"), F.when(~raw, q).alias("text"), F.when(kind == "unread", F.lit(False)).alias("seen"),
        F.when(kind == "flagged", F.lit(True)).alias("flagged"), F.when(files & ~raw, F.lit(ATTACHED_TYPE)).alias("content_type"),
    )
    return F.when(F.coalesce(out["raw"], out["text"], out["content_type"]).isNotNull() | kind.isin("unread", "flagged"), out)


def summaries(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Rows of a listing: no bodies, but a snippet and whether there are attachments that aren't inline."""
    marked = with_attachments(messages, attachments)
    body = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(html_to_text(F.col("html"))) if "html" in messages.columns else F.col("text")
    return marked.withColumn("snippet", snippet(body)).drop("text", "html")


def full(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Messages with the list of their attachments in order, without contents."""
    about = [c for c in attachments.columns if c not in ("message_id", "content")]
    files = attachments.groupBy(F.col("message_id").alias("__m")).agg(F.array_sort(F.collect_list(F.struct("index", *[c for c in about if c != "index"]))).alias("attachments"))
    none = F.array().cast(files.schema["attachments"].dataType)
    return messages.join(files, F.col("id") == F.col("__m"), "left").withColumn("attachments", F.coalesce("attachments", none)).drop("__m")


def shown_person(folder: Column, sender: Column, to: Column, me: str) -> Column:
    """Whom a row names: the first recipient of what I wrote, else the sender."""
    mine = folder.isin("sent", "drafts") | (F.lower(sender["address"]) == F.lit(me.lower()))
    return F.when(mine, F.coalesce(F.try_element_at(to, F.lit(1)), sender)).otherwise(sender)


def expanded(thread_rows: DataFrame, key: str, toggled: DataFrame) -> DataFrame:
    """Marks the messages of threads that stand open: the last, unread ones, and what a reader has toggled (folder, id, open)."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("date").desc(), F.col("id").desc())) == 1
    marked = thread_rows.withColumn("__open", last | ~F.col("seen"))
    chosen = toggled.select(F.col("folder").alias("__f"), F.col("id").alias("__i"), F.col("open").alias("__o"))
    joined = marked.join(chosen, (F.col("folder") == F.col("__f")) & (F.col("id") == F.col("__i")), "left")
    return joined.withColumn("open", F.coalesce("__o", "__open")).drop("__open", "__f", "__i", "__o")


def forced_open(thread_rows: DataFrame, unread: DataFrame) -> DataFrame:
    """Marks rows that were unread when their thread was opened, and so stay open."""
    known = unread.select("folder", "id").distinct().withColumn("forced", F.lit(True))
    return thread_rows.join(known, ["folder", "id"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)))


def thread_search(messages: DataFrame, folder: str, message_id, sent: str = "sent", each: int = 12, last: int = 15) -> DataFrame:
    """The thread of a message by its subject, in its folder and among the sent ones, oldest first.

    ``messages`` have folder, id, subject, message_id and date. In each folder the newest hits are taken whose subject
    contains the root's bare one, then those of the same thread subject stay; of copies with one message id the
    first wins, the root's folder before the sent one. The root is in any case part of the result, once.
    """
    root = messages.filter((F.col("folder") == folder) & (F.col("id") == message_id))
    subject = root.select("subject").limit(1).scalar()
    base, needle = thread_subject(subject), F.substring(strip_subject(subject), 1, 80)
    places = messages.filter(F.col("folder").isin(folder, sent)).withColumns({"__base": base, "__needle": needle})
    hits = places.filter((F.col("__base") != "") & F.contains(F.lower("subject"), F.lower("__needle")))
    newest = last_of_each(hits, ["folder"], [F.col("id").desc()], each).filter(thread_subject(F.col("subject")) == F.col("__base"))
    key = F.coalesce(F.nullif(F.col("message_id"), F.lit("")), F.concat("folder", F.lit(":"), F.col("id").cast("string")))
    ranked = newest.withColumns({"__key": key, "__place": (F.col("folder") != folder).cast("int")})
    once = first_of_each(ranked, ["__key"], [F.col("__place").asc(), F.col("id").desc()]).drop("__key", "__place", "__base", "__needle")
    missing = root.join(once.select("folder", "id"), ["folder", "id"], "left_anti").select(*once.columns)
    return once.unionByName(missing).orderBy(F.col("date").desc(), F.col("id").desc()).limit(last).orderBy("date", "id")


def clamp(offset, limit, query: str | None = None) -> tuple[int, int, str]:
    """Request values made safe: offset from 0, limit from 1 to 100 (50 if missing), 200 characters of query."""

    def number(x) -> int:
        try:
            return int(float(x))
        except (TypeError, ValueError, OverflowError):
            return 0

    return max(0, number(offset)), min(100, max(1, number(limit) or 50)), (query or "").strip()[:200]


def clamped(offset: Column, limit: Column, query: Column) -> tuple[Column, Column, Column]:
    """The same for columns of request values."""
    whole = lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(x).cast("long")
    n = whole(limit)
    size = F.when(n == 0, F.lit(50)).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), n))).cast("long")
    return F.greatest(F.lit(0), whole(offset)).cast("long"), size, F.substring(trim_all(F.coalesce(query, F.lit(""))), 1, 200)


def page(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page, newest first; rows of equal date in order of arrival."""
    return df.orderBy(F.col("date").desc(), F.col("seq").asc()).offset(offset).limit(limit)


def page_with_total(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page with the number of all rows and the next offset, or null at the end."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = page(df, offset, limit).withColumn("total", total)
    return out.withColumn("next", F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit)))


def arrival_page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page by arrival: the latest rows, sorted by date inside the page only."""
    return df.orderBy(F.col("seq").desc()).offset(offset).limit(limit).orderBy(F.col("date").desc(), F.col("seq").desc())


def envelope_scan(df: DataFrame, folder: str, first: int | None = None, last: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The envelopes of a folder's messages by a range of their places in it, counted from 1 in order of arrival, or by ids."""
    own = df.filter(F.col("folder") == folder)
    if ids is not None:
        return own.join(ids.select("id").distinct(), "id", "left_semi")
    placed = gapless_places(own)
    return placed.filter(F.col("place").between(first or 1, last if last is not None else (1 << 62)))


def gapless_places(df: DataFrame, piece: int = 100_000) -> DataFrame:
    """Rows of a folder with their ``place`` from 1 in order of arrival; pieces of ``seq`` are counted first, so that no task ranks a whole folder."""
    rows = df.withColumn("__piece", F.floor(F.col("seq") / piece))
    counts = rows.groupBy("folder", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("folder").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.join(counts.withColumn("__off", before).drop("__n"), ["folder", "__piece"])
    rank = F.row_number().over(Window.partitionBy("folder", "__piece").orderBy("seq"))
    return joined.withColumn("place", (rank + F.col("__off")).cast("long")).drop("__piece", "__off")


def folder_counts(messages: DataFrame, folders: DataFrame) -> DataFrame:
    """total and unread of each folder, empty and virtual ones too; the messages are read once."""
    own = F.array("folder")
    places = F.when(F.col("flagged") & ~F.col("folder").isin(*HIDDEN), F.concat(own, F.array(F.lit(FLAGGED)))).otherwise(own)
    rows = messages.select(F.explode(places).alias("folder"), "seen")
    counts = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("seen")).alias("unread"))
    out = folders.join(counts, folders["id"] == counts["folder"], "left")
    return out.select("id", "name", "role", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "unread")])


def conversations(messages: DataFrame) -> DataFrame:
    """One row for each thread: its newest message, size and flags; a row without a thread is its own."""
    key = F.coalesce(F.nullif(F.col("thread_key").cast("string"), F.lit("")), F.concat("folder", F.lit(":"), F.col("id").cast("string")))
    newest = F.struct("date", (-F.col("seq")).alias("s"))
    return messages.groupBy(key.alias("thread")).agg(
        F.max_by("id", newest).alias("latest_id"),
        F.max("date").alias("latest"),
        F.count(F.lit(1)).alias("n"),
        F.bool_or(~F.col("seen")).alias("unread"),
        F.bool_or("flagged").alias("flagged"),
    )


def conversation_items(messages: DataFrame) -> DataFrame:
    """Each message with its conversation and its place in it, newest first, and the newest one's id.

    Rows, not lists: a conversation of any size stays spread over rows.
    """
    key = F.coalesce(F.nullif(F.col("thread_key").cast("string"), F.lit("")), F.concat("folder", F.lit(":"), F.col("id").cast("string")))
    w = Window.partitionBy("thread").orderBy(F.col("date").desc(), "seq")
    rows = messages.withColumn("thread", key)
    return rows.withColumns({"item": F.row_number().over(w) - 1, "latest_id": F.first("id").over(w)})


def ids_by(rows: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """(key, batch, ids): ids to be changed or fetched together, by folder or body part, in batches of neighbouring ids."""
    return rows.groupBy(key, F.floor(F.col("id") / size).alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def toggles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a key press does to the chosen rows: read them if any is unread, unflag them if all are flagged."""
    flags = rows.groupBy(*keys).agg(F.bool_or(~F.col("seen")).alias("any_unread"), F.bool_and("flagged").alias("all_flagged"), F.bool_or("has_attachments").alias("attach"))
    return flags.withColumns({"set_seen": F.col("any_unread"), "set_flagged": ~F.col("all_flagged")})


def status_line(count: Column, unread: Column, selected: Column) -> Column:
    """How many rows there are, how many unread and how many chosen; empty parts go."""
    part = lambda label, n: F.when(n > 0, F.concat(F.lit(f"{label}: "), n.cast("string")))
    return F.concat_ws(" · ", F.concat(F.lit("Элементов: "), F.coalesce(count, F.lit(0)).cast("string")), part("Не прочитано", unread), part("Выделено", selected))


def folder_badges(counts: DataFrame, local_drafts: int) -> DataFrame:
    """The number at each folder: unread ones; for drafts all, local ones too; none for folders that are only kept."""
    n = F.when(F.col("role") == "drafts", F.col("total") + local_drafts).when(F.col("role").isin("sent", "trash", "all", "flagged"), 0).otherwise(F.col("unread"))
    return counts.withColumn("badge", n)


def move_targets(folders: DataFrame, current: str) -> DataFrame:
    """Folders that messages may be moved to from the open one."""
    return folders.filter((F.col("id") != current) & ~F.coalesce("role", F.lit("")).isin("flagged", "drafts", "sent", "all"))


def targets(rows: DataFrame, selected: Column, open_key: Column, cursor: Column) -> DataFrame:
    """The rows an action is meant for: the chosen ones; if there are none the open one; else the one at the cursor."""
    meant = F.when(F.size(selected) > 0, F.array_contains(selected, F.col("key"))).when(open_key.isNotNull(), F.col("key") == open_key).otherwise(F.col("key") == cursor)
    return rows.filter(F.coalesce(meant, F.lit(False)))


def clean_ids(ids: Column) -> Column:
    """Ids as strings; what isn't a list has none, and empty ones go."""
    return F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.coalesce(x.cast("string"), F.lit(""))), lambda x: x != "")


def palette(commands: DataFrame, query: str) -> DataFrame:
    """Commands that fit a query, best first and else in their order (``seq``); without one all, marked where a section starts."""
    from ..functions.labels import palette_score

    q = query.strip().lower()
    scored = commands.withColumn("score", palette_score(F.col("title"), F.col("keywords"), q)).filter("score > 0")
    if q:
        return scored.withColumn("starts_section", F.lit(False)).orderBy(F.col("score").desc(), "seq")
    return breaks_ranged(scored, "section", [F.col("seq").asc()], [], "starts_section").orderBy("seq")


def thread(messages: DataFrame, message_id, last: int | None = None) -> DataFrame:
    """All messages of the thread of a message, trash excluded, oldest first; or its last ones."""
    root = messages.filter(F.col("id") == message_id).select(F.col("thread_key").alias("__t")).distinct()
    rows = messages.filter(F.col("folder") != "trash").join(root, F.col("thread_key") == F.col("__t"), "left_semi")
    if last is not None:
        rows = rows.orderBy(F.col("date").desc(), F.col("id").desc()).limit(last)
    return rows.orderBy("date", "id")


def last_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key by ``order`` (given descending)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: a dedupe over an ordered list."""
    return last_of_each(df, keys, order, 1)


def breaks(df: DataFrame, bucket: str, order: list[Column], within: list[str]) -> DataFrame:
    """Marks rows whose bucket differs from that of the row before."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("is_break", ~F.col(bucket).eqNullSafe(F.lag(bucket).over(w)))


def neighbours(df: DataFrame, order: list[Column], within: list[str], gone: str) -> DataFrame:
    """Previous and next row, and the row to open when the rows marked ``gone`` leave: the next that stays, else the one before."""
    w = Window.partitionBy(*within).orderBy(*order)
    stays = F.when(~F.col(gone), F.col("id"))
    before = F.last("__stays", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__stays", stays).withColumns({"prev_id": F.lag("id").over(w), "next_id": F.lead("id").over(w), "advance_to": F.coalesce(next_known("__stays", w), before)}).drop("__stays")


def between_rows(df: DataFrame, order: list[Column], within: list[str], *ends) -> DataFrame:
    """The rows from one of these ids to another, both included, whichever comes first; only lists that hold one are ranked."""
    held = df.join(df.filter(F.col("id").isin(*ends)).select(*within).distinct(), within, "left_semi")
    whole = Window.partitionBy(*within)
    ranked = held.withColumn("__n", F.row_number().over(whole.orderBy(*order)))
    end = F.when(F.col("id").isin(*ends), F.col("__n"))
    return ranked.withColumns({"__a": F.min(end).over(whole), "__b": F.max(end).over(whole)}).filter("__n between __a and __b").drop("__n", "__a", "__b")


def ranked_folders(folders: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Folders by the rank of their role, then by name in Russian order."""
    return folders.orderBy(*_folder_order(roles))


def placed_folders(folders: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Folders with their place in that order, from 1."""
    return folders.withColumn("place", F.row_number().over(Window.orderBy(*_folder_order(roles))))


def _folder_order(roles: tuple[str, ...]) -> list[Column]:
    rank = F.array_position(F.array(*map(F.lit, roles)), F.coalesce("role", F.lit("")))
    return [F.when(rank > 0, rank).otherwise(len(roles) + 1), F.collate(F.col("name"), "ru")]


def attachment(attachments: DataFrame, message_id, index: int) -> DataFrame:
    return attachments.filter((F.col("message_id") == message_id) & (F.col("index") == index))


def not_shown(rows: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a further page that aren't shown yet."""
    return rows.join(shown.select(*keys).distinct(), keys, "left_anti")


def references(source: DataFrame) -> DataFrame:
    """The chain of a reply: the source's references and its own id, empty ones dropped."""
    chain = F.filter(F.concat(F.coalesce("refs", F.array().cast("array<string>")), F.array("message_id")), lambda x: F.coalesce(x, F.lit("")) != "")
    return source.withColumn("references", chain)


def folder_roles(folders: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Folders with the role that one of their flags names; a role stays with the first folder that has it."""
    known = F.create_map(*[F.lit(x) for kv in flags.items() for x in kv])
    role = F.get(F.filter(F.transform("flags", lambda f: F.element_at(known, f)), lambda r: r.isNotNull()), F.lit(0))
    first = Window.partitionBy("__role").orderBy("seq")
    marked = folders.filter(~F.arrays_overlap("flags", F.array(F.lit("\\Noselect"), F.lit("\\NonExistent")))).withColumn("__role", role)
    return marked.withColumn("role", F.when(F.row_number().over(first) == 1, F.col("__role"))).drop("__role")
