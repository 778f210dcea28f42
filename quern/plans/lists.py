"""Queries over lists and threads as they are shown: rows, people, conversations, targets, folders, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import changes, history, mailbox, people
from ..sources import views as V
from ..streaming import sessions
from .mail import AS_OF
from .registry import query
from .texts import snippet_sql

ME = "customer#000000007@example.com"


@query(
    sql=f"""SELECT s.id, s.folder, s.snippet, d.subject, d.seen, coalesce(x.n > 0, false) AS has_attachments FROM ({snippet_sql("text", "id, folder, ")}) s JOIN d ON d.id = s.id
        LEFT JOIN (SELECT message_id, count(*) AS n FROM a WHERE NOT inline GROUP BY message_id) x ON x.message_id = s.id""",
    views="da",
)
def message_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.summaries(V.messages_doc(spark, sf_dir, wide=True), V.attachments_rel(spark, sf_dir))
    return rows.select("id", "folder", "snippet", "subject", "seen", "has_attachments")


@query(
    sql="""SELECT m.id, m.folder, from_address, coalesce(files, '') AS files, coalesce(n, 0) AS n_files FROM m
        LEFT JOIN (SELECT message_id, string_agg(index || ':' || filename || ':' || size || CASE WHEN inline THEN '*' ELSE '' END, '|' ORDER BY index) AS files, count(*) AS n FROM a GROUP BY message_id) x ON x.message_id = m.id""",
    views="ma",
)
def full_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.full(V.messages_rel(spark, sf_dir), V.attachments_rel(spark, sf_dir).withColumn("content", F.lit(None).cast("binary")))
    shown = lambda f: F.concat(f["index"].cast("string"), F.lit(":"), f["filename"], F.lit(":"), f["size"].cast("string"), F.when(f["inline"], "*").otherwise(""))
    return rows.select("id", "folder", F.col("from.address").alias("from_address"), F.array_join(F.transform("attachments", shown), "|").alias("files"), F.size("attachments").cast("long").alias("n_files"))


@query(
    sql=f"""SELECT id, CASE WHEN id % 5 = 0 OR from_address = '{ME}' THEN CASE WHEN id % 3 = 0 THEN from_address ELSE 'to' || id % 3 || '@x.org' END ELSE from_address END AS person FROM m""",
    views="m",
)
def displayed_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.array(V.address(F.lit(""), F.concat(F.lit("to"), (F.col("id") % 3).cast("string"), F.lit("@x.org"))))
    to = F.when(F.col("id") % 3 == 0, F.slice(to, 1, 0)).otherwise(to)
    folder = F.when(F.col("id") % 5 == 0, "sent").otherwise(F.col("folder"))
    return V.messages_rel(spark, sf_dir).select("id", mailbox.shown_person(folder, F.col("from"), to, ME.upper())["address"].alias("person"))


@query(
    sql="""SELECT id, CASE WHEN id % 11 = 0 THEN id % 2 = 0 ELSE NOT seen OR row_number() OVER (PARTITION BY thread_key ORDER BY date DESC, id DESC) = 1 END AS open, id % 13 = 0 AND NOT seen AS forced FROM m""",
    views="m",
)
def expanded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir)
    toggled = rows.filter("id % 11 = 0").select("folder", "id", (F.col("id") % 2 == 0).alias("open"))
    marked = mailbox.expanded(rows, "thread_key", toggled)
    return mailbox.forced_open(marked, rows.filter("id % 13 = 0 and not seen")).select("id", "open", "forced")


_THREADED = """SELECT id, CASE WHEN id % 3 = 0 THEN 'sent' ELSE 'inbox' END AS folder, ['Re: ', '', 'FW: Re: ', '[EXT] '][id % 4 + 1] || 'Case ' || from_name AS subject,
    CASE WHEN id % 7 = 0 THEN '' ELSE 'm' || id // 2 END AS message_id, date, from_name FROM m"""


@query(
    sql=f"""SELECT id, folder, subject FROM (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY CASE WHEN message_id = '' THEN folder || ':' || id ELSE message_id END ORDER BY folder <> 'inbox', id DESC) AS r FROM (
            SELECT * FROM ({_THREADED}) WHERE from_name = 'Customer#000000010' QUALIFY row_number() OVER (PARTITION BY folder ORDER BY id DESC) <= 12)) WHERE r = 1
        UNION SELECT *, 1 FROM ({_THREADED}) WHERE id = (SELECT min(id) FROM ({_THREADED}) WHERE folder = 'inbox' AND from_name = 'Customer#000000010')
        ORDER BY date DESC, id DESC LIMIT 15)""",
    views="m",
)
def thread_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    lead = F.element_at(F.array(*map(F.lit, ["Re: ", "", "FW: Re: ", "[EXT] "])), (i % 4 + 1).cast("int"))
    rows = V.messages_rel(spark, sf_dir).select(
        "id", F.when(i % 3 == 0, "sent").otherwise("inbox").alias("folder"), F.concat(lead, F.lit("Case "), "from.name").alias("subject"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("m"), F.floor(i / 2).cast("string"))).alias("message_id"), "date", F.col("from.name").alias("name"),
    )
    root = rows.filter("folder = 'inbox' and name = 'Customer#000000010'").agg(F.min("id").alias("id")).scalar()
    return mailbox.thread_search(rows.drop("name"), "inbox", root).select("id", "folder", "subject")


@query(
    sql="""SELECT id, CAST(thread_key AS VARCHAR) AS thread, row_number() OVER w - 1 AS item, first_value(id) OVER w AS latest_id FROM m WINDOW w AS (PARTITION BY thread_key ORDER BY date DESC, seq)""",
    views="m",
)
def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.conversation_items(V.messages_slim(spark, sf_dir)).select("id", "thread", "item", "latest_id")


@query(sql="SELECT folder, id // 1000 AS batch, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM m GROUP BY folder, id // 1000", views="m")
def ids_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.ids_by(V.messages_slim(spark, sf_dir), "folder")
    return rows.select("folder", "batch", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    sql="""SELECT thread_key, bool_or(NOT seen) AS any_unread, bool_and(flagged) AS all_flagged, bool_or(coalesce(x.n > 0, false)) AS attach, bool_or(NOT seen) AS set_seen, NOT bool_and(flagged) AS set_flagged
        FROM m LEFT JOIN (SELECT message_id, count(*) AS n FROM a WHERE NOT inline GROUP BY message_id) x ON x.message_id = m.id GROUP BY thread_key""",
    views="ma",
)
def row_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.toggles(mailbox.with_attachments(V.messages_slim(spark, sf_dir), V.attachments_rel(spark, sf_dir)), ["thread_key"])


@query(
    sql="""SELECT folder, 'Элементов: ' || count(*) || CASE WHEN count(*) FILTER (NOT seen) > 0 THEN ' · Не прочитано: ' || count(*) FILTER (NOT seen) ELSE '' END
          || CASE WHEN count(*) FILTER (answered AND flagged) > 0 THEN ' · Выделено: ' || count(*) FILTER (answered AND flagged) ELSE '' END AS line FROM m GROUP BY folder""",
    views="m",
)
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.messages_slim(spark, sf_dir).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("seen")).alias("u"), F.count_if(F.col("answered") & F.col("flagged")).alias("s"))
    return counts.select("folder", mailbox.status_line(F.col("n"), F.col("u"), F.col("s")).alias("line"))


_FOLDERS = "(VALUES ('inbox','Inbox','inbox'), ('flagged','Flagged','flagged'), ('archive','Archive','archive'), ('work','Work',NULL), ('sent','Sent','sent'), ('drafts','Drafts','drafts'), ('junk','Junk','junk'), ('trash','Trash','trash')) f(id, name, role)"


@query(
    sql=f"""SELECT f.id, CASE WHEN role = 'drafts' THEN coalesce(t, 0) + 3 WHEN role IN ('sent', 'trash', 'all', 'flagged') THEN 0 ELSE coalesce(u, 0) END AS badge,
        CASE WHEN role IS NULL THEN CASE WHEN lower(name) LIKE '%work%' THEN 'briefcase' ELSE 'folder' END ELSE map {{'inbox': 'inbox', 'flagged': 'star', 'drafts': 'draft', 'sent': 'send', 'archive': 'archive', 'junk': 'spam', 'trash': 'trash'}}[role] END AS icon
        FROM {_FOLDERS} LEFT JOIN (SELECT folder, count(*) AS t, count(*) FILTER (NOT seen) AS u FROM m GROUP BY folder) ON folder = f.id""",
    views="m",
)
def folder_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mailbox.folder_counts(V.messages_slim(spark, sf_dir), V.folders(spark))
    return mailbox.folder_badges(counts, 3).select("id", F.col("badge").cast("long").alias("badge"), L.folder_icon(F.col("role"), F.col("name")).alias("icon"))


@query(
    sql="""SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey <> 4 AND n_regionkey NOT IN (0, 1) AND NOT (n_regionkey = 3 AND n_nationkey % 2 = 0)"""
)
def move_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as folders, with roles by their region."""
    role = F.when(F.col("n_regionkey") == 0, "sent").when(F.col("n_regionkey") == 1, "drafts").when(F.col("n_regionkey") == 2, "archive").when((F.col("n_regionkey") == 3) & (F.col("n_nationkey") % 2 == 0), "all")
    rows = V.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), role.alias("role"))
    return mailbox.move_targets(rows, 4).select("id", "name")


@query(
    sql="""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END || CASE p_size % 4 WHEN 1 THEN ' has:attachment' ELSE '' END), '') END AS raw,
          CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 <> 0 THEN p_type END AS text, CASE WHEN p_size % 4 = 2 THEN false END AS seen, CASE WHEN p_size % 4 = 3 THEN true END AS flagged,
          CASE WHEN p_partkey % 2 = 1 AND p_size % 4 = 1 THEN 'multipart/mixed' END AS content_type FROM part WHERE p_partkey % 3 <> 0 OR p_size % 4 <> 0"""
)
def asked_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What servers of two kinds are asked for each part's listing; nothing where there is nothing to ask."""
    kind = F.element_at(F.array(*map(F.lit, ["all", "attachments", "unread", "flagged"])), (F.col("p_size") % 4 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    rows = V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), mailbox.asked_criteria(text, kind, F.col("p_partkey") % 2 == 0).alias("c"))
    return rows.filter("c is not null").select("id", "c.*")


@query(
    sql=r"""SELECT id, name, CASE WHEN row_number() OVER (PARTITION BY r ORDER BY id) = 1 THEN r END AS role FROM (
          SELECT n_nationkey AS id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'junk' WHEN 2 THEN NULL ELSE 'trash' END AS r FROM nation WHERE n_regionkey <> 0)"""
)
def folder_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags name the roles; folders that can't be opened go, and the first folder with a role keeps it."""
    flag = F.element_at(F.array(*map(F.lit, ["\\Sent", "\\Junk", "\\Marked", "\\Trash"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    flags = F.when(F.col("n_regionkey") == 0, F.array(flag, F.lit("\\Noselect"))).otherwise(F.array(F.lit("\\HasNoChildren"), flag))
    rows = V.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), flags.alias("flags"), F.col("n_nationkey").alias("seq"))
    return mailbox.folder_roles(rows, {"\\Sent": "sent", "\\Junk": "junk", "\\Trash": "trash"}).select("id", "name", "role")


@query(
    sql="""SELECT id, name, row_number() OVER (ORDER BY coalesce(list_position(['inbox', 'flagged', 'drafts', 'sent', 'archive', 'all', 'junk', 'trash'], role), 9), name) AS place FROM (
        SELECT n_nationkey AS id, n_name AS name, CASE n_nationkey WHEN 3 THEN 'trash' WHEN 7 THEN 'inbox' WHEN 9 THEN 'sent' END AS role FROM nation)"""
)
def ranked_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("n_nationkey") == 3, "trash").when(F.col("n_nationkey") == 7, "inbox").when(F.col("n_nationkey") == 9, "sent")
    rows = V.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), role.alias("role"))
    return mailbox.placed_folders(rows, tuple(L.ROLE_ORDER)).select("id", "name", "place")


@query(
    sql="""SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE 'r' || id || CASE WHEN id % 2 = 0 THEN '|' ELSE '' END END || CASE WHEN id % 2 = 0 THEN 'm' || id ELSE '' END AS chain FROM m""",
    views="m",
)
def reference_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id").cast("string")
    refs = F.when(F.col("id") % 9 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), i), F.lit("")))
    rows = V.messages_slim(spark, sf_dir).select("id", refs.alias("refs"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("m"), i)).otherwise("").alias("message_id"))
    return mailbox.references(rows).select("id", F.array_join("references", "|").alias("chain"))


@query(
    sql="""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 't' || c_custkey || '@x.org|' END || 'c' || c_nationkey || '@x.org|b@x.org' AS envelope,
        CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_nationkey || '@x.org' ELSE 't' || c_custkey || '@x.org' END AS to_line, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'c' || c_nationkey || '@x.org' END AS cc_line FROM customer"""
)
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def person(lead: str, n: str):
        return F.array(V.address(F.lit("N"), F.concat(F.lit(lead), F.col(n).cast("string"), F.lit("@x.org"))))

    to = F.when(F.col("c_custkey") % 3 == 0, F.slice(person("t", "c_custkey"), 1, 0)).otherwise(person("t", "c_custkey"))
    rows = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), to.alias("to"), person("c", "c_nationkey").alias("cc"), F.array(V.address(F.lit(""), F.lit("B@x.org"))).alias("bcc"))
    moved = people.promoted(F.col("to"), F.col("cc"))
    line = lambda p: F.array_join(F.transform(p, lambda a: a["address"]), "|")
    return people.without_bcc(rows).select("id", F.array_join("envelope", "|").alias("envelope"), line(moved["to"]).alias("to_line"), line(moved["cc"]).alias("cc_line"))


@query(
    sql="""SELECT event_id, greatest(0, CAST(trunc(value - 20) AS BIGINT)) AS offset_, CASE WHEN trunc(value / 2) = 0 THEN 50 ELSE least(100, greatest(1, CAST(trunc(value / 2) AS BIGINT))) END AS limit_,
        CASE WHEN event_id % 5 = 0 THEN 1 ELSE greatest(1, CAST(floor(value / 10) AS BIGINT)) END AS turn, length(trim(repeat(event_type || ' ', 60))[1:200]) AS query_length FROM events"""
)
def request_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.read(spark, sf_dir, "events")
    offset, limit, text = mailbox.clamped(F.col("value") - 20, F.col("value") / 2, F.repeat(F.concat("event_type", F.lit(" ")), F.lit(60)))
    turn = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 10)
    return rows.select("event_id", offset.alias("offset_"), limit.alias("limit_"), history.clean_turn(turn).alias("turn"), F.char_length(text).cast("long").alias("query_length"))


@query(sql="SELECT id, folder FROM m WHERE folder = 'inbox' AND id % 2 = 0 AND id NOT IN (SELECT id FROM m WHERE id % 4 = 0)", views="m")
def live_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive twice or are shown already come once or not at all."""
    rows = V.messages_slim(spark, sf_dir).select("id", "folder")
    new = sessions.visible(rows.filter("id % 2 = 0"), "inbox", "", "unread")
    return sessions.inserted(new.union(new), rows.filter("id % 4 = 0")).select("id", "folder")


@query(
    sql="""SELECT p_partkey AS id, s AS score, CASE WHEN p_partkey % 2 = 0 THEN 'ship' ELSE 'stock' END AS section FROM (SELECT *, greatest(
          CASE WHEN starts_with(lower(p_name), 'al') THEN 100.0 WHEN contains(lower(p_name), 'al') THEN 60.0 - (strpos(lower(p_name), 'al') - 1) WHEN regexp_matches(lower(p_name), 'a.*l') THEN 10.0 ELSE 0.0 END,
          CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE 0.8 * CASE WHEN starts_with(lower(p_type), 'al') THEN 100.0 WHEN contains(lower(p_type), 'al') THEN 60.0 - (strpos(lower(p_type), 'al') - 1) WHEN regexp_matches(lower(p_type), 'a.*l') THEN 10.0 ELSE 0.0 END END) AS s FROM part) WHERE s > 0"""
)
def palette_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.palette(_commands(spark, sf_dir), " AL ").select("id", "score", "section")


@query(sql="SELECT p_partkey AS id, section IS DISTINCT FROM lag(section) OVER (ORDER BY p_partkey) AS starts_section FROM (SELECT *, CASE WHEN p_partkey // 7 % 2 = 0 THEN 'a' ELSE 'b' END AS section FROM part)")
def palette_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commands(spark, sf_dir).withColumn("section", F.when(F.floor(F.col("id") / 7) % 2 == 0, "a").otherwise("b"))
    return mailbox.palette(rows, "").select("id", "starts_section")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("p_partkey") % 2 == 0, "ship").otherwise("stock")
    return V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("keywords"), section.alias("section"))


@query(
    sql="""SELECT message_id, index, CASE filename[-4:] WHEN '.pdf' THEN message_id % 2 = 0 WHEN '.png' THEN true WHEN 'jpeg' THEN true ELSE false END AS opens, size < 1572864 AND NOT inline AS in_draft FROM a""",
    views="a",
)
def file_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.substring_index("filename", ".", -1)
    kind = F.when(ext == "pdf", "application/PDF").when(ext.isin("png", "jpeg"), F.concat(F.lit("image/"), ext)).otherwise(F.concat(F.lit("application/"), ext))
    download = (ext == "pdf") & (F.col("message_id") % 2 == 1)
    kept = changes.kept_files(F.array(F.struct((~F.col("inline")).alias("loaded"), "size")), draft=True)
    return V.attachments_rel(spark, sf_dir).select("message_id", "index", L.opens_inline(kind, download).alias("opens"), (F.size(kept) == 1).alias("in_draft"))


@query(
    sql="""SELECT id, (id % 3 <> 0 AND id % 5 <> 0) AND (id % 2 = 0 OR (id % 7 = 0 AND id % 11 = 0)) AS empty,
        contains(lower(text), 'attach') AND id % 5 <> 0 AS warns FROM d""",
    views="d",
)
def draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    one = F.array(F.lit("x"))
    none = F.slice(one, 1, 0)
    lead, files = F.when(i % 3 == 0, "written").otherwise(" \t"), F.when(i % 5 == 0, one).otherwise(none)
    to, subject = F.when(i % 7 == 0, none).otherwise(one), F.when(i % 11 == 0, " ").otherwise("s")
    rows = V.messages_doc(spark, sf_dir)
    return rows.select("id", changes.is_empty_draft(lead, files, i % 2 == 0, to, subject).alias("empty"), T.misses_attachment(F.col("text"), files).alias("warns"))


@query(sql="SELECT id, CASE WHEN id % 3 = 0 THEN id % 9 = 0 WHEN id % 3 = 1 THEN id = 7 ELSE id = 5 END AS meant FROM m", views="m")
def action_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen rows, else the open one, else the one at the cursor."""
    rows = V.messages_slim(spark, sf_dir).select("id", F.col("id").alias("key"))
    i = F.col("id")
    selected = F.when(i % 3 == 0, F.when(i % 9 == 0, F.array("key")).otherwise(F.array(F.lit(-1).cast("long")))).otherwise(F.array().cast("array<long>"))
    meant = mailbox.targets(rows, selected, F.when(i % 3 == 1, F.lit(7)), F.lit(5)).select("id", F.lit(True).alias("m"))
    return rows.join(meant, "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("meant"))


@query(sql="SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Them' ELSE 'You' END AS who, text AS content FROM conversations")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ledger(V.history(spark, sf_dir), "Them", "You").select("conv_id", "turn", "who", "content")


@query(sql="SELECT id, seen OR folder = 'work' AS seen FROM m", views="m")
def mark_all_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir)
    return changes.read_all(rows, rows.filter("folder = 'work'")).select("id", "seen")


@query(
    sql="""SELECT key, value, deleted FROM (SELECT user_id AS key, arg_max(value, event_id) FILTER (event_type <> 'error') AS v, arg_max(value, event_id) AS l, arg_max(event_type, event_id) = 'error' AS d, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY user_id),
        LATERAL (SELECT CASE WHEN key % 3 = 1 AND n > 0 THEN v ELSE l END AS value, CASE WHEN key % 3 = 0 THEN true WHEN key % 3 = 1 AND n > 0 THEN false ELSE d END AS deleted)"""
)
def draft_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of every third key are discarded, those of the next are brought back."""
    log = V.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("saved_at"), (F.col("event_type") == "error").alias("deleted"), "value")
    end = F.lit(1 << 60).cast("long")
    done = changes.restored(changes.discarded(log, log.filter("key % 3 = 0"), end), log.filter("key % 3 = 1"), end)
    return done.groupBy("key").agg(F.max_by("value", "saved_at").alias("value"), F.max_by("deleted", "saved_at").alias("deleted"))


@query(sql="SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 OR turn >= 2")
def history_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.history(spark, sf_dir)
    return changes.cleared(turns, turns.filter("conv_id % 3 = 0 and turn <= 2").select("conv_id", F.lit(2).alias("turn"))).select("conv_id", "turn", "role")


@query(
    sql="""SELECT o_orderkey AS id, CASE WHEN n <= 0 THEN 'сегодня' WHEN n = 1 THEN 'вчера' ELSE ['вс','пн','вт','ср','чт','пт','сб'][dayofweek(o_orderdate) + 1] || ', ' || day(o_orderdate) || ' ' ||
          ['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'][month(o_orderdate)] || CASE WHEN year(o_orderdate) = 2001 THEN '' ELSE ' ' || year(o_orderdate) || ' г.' END END || ', ' || strftime(o_orderdate, '%H:%M') AS long_date,
        CASE WHEN o_orderkey % 4 = 0 THEN '2001-08-02T00:00:00.000Z' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS iso,
        date_diff('minute', date_trunc('day', o_orderdate - INTERVAL 90 MINUTE), o_orderdate) AS minutes
        FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS n FROM orders)"""
)
def long_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of, ts = F.lit(AS_OF).cast("timestamp"), F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 8 == 0, "no date").when(F.col("o_orderkey") % 8 != 4, ts.cast("string"))
    day = L.start_of_day(L.ago(F.lit(90), ts))
    seconds = lambda x: x.cast("timestamp").cast("double")
    minutes = ((seconds(ts) - seconds(day)) / 60).cast("long")
    return V.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.long_date(ts, as_of).alias("long_date"), L.to_iso(text, as_of).alias("iso"), minutes.alias("minutes"))


@query(
    sql="""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_custkey || '|' END || c_name AS ids FROM customer"""
)
def coerced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_custkey").cast("string")), F.lit(None).cast("string"), F.col("c_name"))
    return V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(mailbox.clean_ids(ids), "|").alias("ids"))


@query(
    sql="""SELECT id FROM d WHERE (contains(lower(subject), 'en') OR contains(lower(text), 'en')) AND id % 3 = 0""",
    views="d",
)
def server_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, "Multipart/Mixed; boundary=x").otherwise("text/plain")
    rows = V.messages_doc(spark, sf_dir).withColumn("kind", kind)
    return rows.filter(mailbox.criteria([F.col("subject"), F.col("text")], "EN", "attachments", F.col("kind"))).select("id")


@query(sql="SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY seq) AS place FROM m WHERE folder = 'inbox') WHERE place BETWEEN 100 AND 400 UNION ALL SELECT id, -1 FROM m WHERE folder = 'work' AND id % 3 = 0", views="m")
def envelope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder by a range of places, another by ids."""
    rows = V.messages_slim(spark, sf_dir)
    some = mailbox.envelope_scan(rows, "work", ids=rows.filter("id % 3 = 0")).select("id", F.lit(-1).cast("long").alias("place"))
    return mailbox.envelope_scan(rows, "inbox", 100, 400).select("id", "place").union(some)
