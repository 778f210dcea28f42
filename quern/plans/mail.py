"""Queries over the message model: lists, threads, people, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import changes, mailbox, people
from ..sources import views as V
from .registry import query

AS_OF = "2001-08-02 00:00:00"
LISTED = ["id", "folder", "from_address", "date", "seen", "flagged"]


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("from_address", F.col("from.address"))


@query(sql="SELECT id, folder, from_address, date, seen, flagged FROM m WHERE folder = 'inbox' AND NOT seen ORDER BY date DESC, seq LIMIT 50", views="m")
def list_unread_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.narrowed(mailbox.in_folder(V.messages_rel(spark, sf_dir), "inbox"), "unread")
    return _listed(mailbox.page(rows, 0, 50)).select(*LISTED)


@query(
    sql="""SELECT id, date, (SELECT count(*) FROM m WHERE folder = 'work') AS total, CASE WHEN 75 < (SELECT count(*) FROM m WHERE folder = 'work') THEN 75 END AS next
        FROM m WHERE folder = 'work' ORDER BY date DESC, seq LIMIT 25 OFFSET 50""",
    views="m",
)
def list_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.in_folder(V.messages_slim(spark, sf_dir), "work").select("id", "date", "seq")
    return mailbox.page_with_total(rows, 50, 25).select("id", "date", "total", "next")


@query(sql="SELECT id, date FROM (SELECT * FROM m WHERE folder = 'inbox' ORDER BY seq DESC LIMIT 20 OFFSET 20)", views="m")
def arrival_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.arrival_page(mailbox.in_folder(V.messages_rel(spark, sf_dir), "inbox").select("id", "date", "seq"), 20, 20).select("id", "date")


_FIELDS = ["subject", "text", "from.name", "from.address"]


@query(
    sql="""SELECT id, folder, subject FROM d WHERE folder <> 'trash'
        AND contains(lower(coalesce(subject, '') || ' ' || coalesce(text, '') || ' ' || coalesce(from_name, '') || ' ' || coalesce(from_address, '')), 'license')""",
    views="d",
)
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.searched(V.messages_doc(spark, sf_dir), [F.col(f) for f in _FIELDS], "LICENSE").select("id", "folder", "subject")


@query(
    sql="SELECT id FROM d WHERE NOT seen AND (contains(lower(coalesce(subject, '')), 'fr') OR contains(lower(coalesce(from_address, '')), 'fr') OR contains(lower(coalesce(text, '')), 'fr'))",
    views="d",
)
def search_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(f) for f in ("subject", "from.address", "text")]
    return mailbox.narrowed(V.messages_doc(spark, sf_dir), "unread").filter(mailbox.any_field_contains(fields, "fr")).select("id")


@query(
    sql="SELECT id, folder FROM m WHERE folder = 'archive' AND EXISTS (SELECT 1 FROM a WHERE message_id = id AND NOT inline)",
    views="ma",
)
def filter_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.in_folder(V.messages_slim(spark, sf_dir), "archive")
    return mailbox.narrowed(mailbox.with_attachments(rows, V.attachments_rel(spark, sf_dir)), "attachments").select("id", "folder")


@query(sql="SELECT id, folder, date FROM m WHERE flagged AND folder NOT IN ('trash', 'junk')", views="m")
def virtual_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.in_folder(V.messages_slim(spark, sf_dir), "flagged").select("id", "folder", "date")


@query(
    sql="""SELECT f.id, f.name, f.role, coalesce(t, 0) AS total, coalesce(u, 0) AS unread
        FROM (VALUES ('inbox','Inbox','inbox'), ('flagged','Flagged','flagged'), ('archive','Archive','archive'), ('work','Work',NULL),
          ('sent','Sent','sent'), ('drafts','Drafts','drafts'), ('junk','Junk','junk'), ('trash','Trash','trash')) f(id, name, role)
        LEFT JOIN (SELECT folder, count(*) AS t, count(*) FILTER (NOT seen) AS u FROM
          (SELECT folder, seen FROM m UNION ALL SELECT 'flagged', seen FROM m WHERE flagged) GROUP BY folder) ON folder = f.id""",
    views="m",
)
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.folder_counts(V.messages_slim(spark, sf_dir), V.folders(spark))


@query(
    sql="""SELECT CAST(thread_key AS VARCHAR) AS thread, arg_max(id, (date, -seq)) AS latest_id, max(date) AS latest, count(*) AS n, bool_or(NOT seen) AS unread, bool_or(flagged) AS flagged
        FROM m GROUP BY thread_key""",
    views="m",
)
def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.conversations(V.messages_slim(spark, sf_dir))


@query(sql="SELECT id, date, folder FROM m WHERE thread_key = (SELECT thread_key FROM m WHERE id = 7)", views="m")
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.thread(V.messages_slim(spark, sf_dir), 7).select("id", "date", "folder")


@query(sql="SELECT id, date FROM m WHERE thread_key = (SELECT thread_key FROM m WHERE id = 7) ORDER BY date DESC, id DESC LIMIT 5", views="m")
def thread_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.thread(V.messages_slim(spark, sf_dir), 7, last=5).select("id", "date")


@query(sql="SELECT id, thread_key, date FROM m QUALIFY row_number() OVER (PARTITION BY thread_key ORDER BY date DESC, id DESC) <= 15", views="m")
def last_of_each_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.last_of_each(V.messages_slim(spark, sf_dir).select("id", "thread_key", "date"), ["thread_key"], [F.col("date").desc(), F.col("id").desc()], 15)


_GROUP = """CASE WHEN date_diff('day', CAST(date AS DATE), DATE '2001-08-02') <= 0 THEN 'Сегодня' WHEN date_diff('day', CAST(date AS DATE), DATE '2001-08-02') = 1 THEN 'Вчера'
    WHEN date_diff('day', CAST(date AS DATE), DATE '2001-08-02') < 7 THEN 'На этой неделе' WHEN date_diff('day', CAST(date AS DATE), DATE '2001-08-02') < 30 THEN 'В этом месяце' ELSE 'Ранее' END"""


@query(sql=f"SELECT folder, {_GROUP} AS date_group, count(*) AS n FROM m GROUP BY ALL", views="m")
def date_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = L.date_group(F.col("date"), F.lit(AS_OF).cast("timestamp"))
    return V.messages_slim(spark, sf_dir).groupBy("folder", group.alias("date_group")).agg(F.count(F.lit(1)).alias("n"))


@query(
    sql=f"""SELECT id, thread_key, g AS date_group, g IS DISTINCT FROM lag(g) OVER (PARTITION BY thread_key ORDER BY date DESC, id) AS is_break FROM (SELECT *, {_GROUP} AS g FROM m)""",
    views="m",
)
def group_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir).withColumn("date_group", L.date_group(F.col("date"), F.lit(AS_OF).cast("timestamp")))
    return mailbox.breaks(rows, "date_group", [F.col("date").desc(), F.col("id").asc()], ["thread_key"]).select("id", "thread_key", "date_group", "is_break")


@query(
    sql="""SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id,
          coalesce(first_value(CASE WHEN NOT flagged THEN id END IGNORE NULLS) OVER (PARTITION BY thread_key ORDER BY date DESC, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
                   last_value(CASE WHEN NOT flagged THEN id END IGNORE NULLS) OVER (PARTITION BY thread_key ORDER BY date DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS advance_to
        FROM m WINDOW w AS (PARTITION BY thread_key ORDER BY date DESC, id)""",
    views="m",
)
def row_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("date").desc(), F.col("id").asc()]
    return mailbox.neighbours(V.messages_slim(spark, sf_dir), order, ["thread_key"], "flagged").select("id", "prev_id", "next_id", "advance_to")


@query(
    sql="""SELECT id, thread_key FROM (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY date DESC, id) AS n FROM m)
        QUALIFY n BETWEEN min(CASE WHEN id IN (2, 1001, 2002) THEN n END) OVER (PARTITION BY thread_key) AND max(CASE WHEN id IN (2, 1001, 2002) THEN n END) OVER (PARTITION BY thread_key)""",
    views="m",
)
def range_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("date").desc(), F.col("id").asc()]
    return mailbox.between_rows(V.messages_slim(spark, sf_dir), order, ["thread_key"], 2, 1001, 2002).select("id", "thread_key")


@query(
    sql="""SELECT folder, count(DISTINCT from_address) AS n_people, count(DISTINCT from_address) FILTER (from_address <> 'customer#000000007@example.com') AS n_others FROM m GROUP BY folder""",
    views="m",
)
def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_rel(spark, sf_dir).withColumn("people", F.array("from"))
    return people.participants(rows, "folder", ["people"], "Customer#000000007@example.com")


@query(
    sql="""SELECT thread_key, count(a.message_id) FILTER (NOT inline) AS n_attachments, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, coalesce(sum(size), 0) > 26214400 AS too_large
        FROM m LEFT JOIN a ON a.message_id = m.id GROUP BY thread_key""",
    views="ma",
)
def attachment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.attachments_rel(spark, sf_dir).select("message_id", "size", "inline")
    sums = files.groupBy("message_id").agg(F.count_if(~F.col("inline")).alias("n"), F.sum("size").alias("s"))
    rows = V.messages_slim(spark, sf_dir).select("id", "thread_key").join(sums, F.col("id") == F.col("message_id"), "left")
    out = rows.groupBy("thread_key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_attachments"), F.coalesce(F.sum("s"), F.lit(0)).alias("total_bytes"))
    return out.withColumn("too_large", F.col("total_bytes") > 25 * 1024 * 1024)


@query(sql="SELECT index, filename, size, inline FROM a WHERE message_id = 7 AND index = 0", views="a")
def attachment_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox.attachment(V.attachments_rel(spark, sf_dir), 7, 0).select("index", "filename", "size", "inline")


_WEIGHT = "CASE WHEN answered THEN 3 WHEN flagged THEN 2 ELSE 1 END"


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("answered"), 3).when(F.col("flagged"), 2).otherwise(1)
    rows = V.messages_rel(spark, sf_dir).select(F.col("from.name").alias("name"), F.col("from.address").alias("address"), weight.alias("weight"), "seq")
    return people.contact_scores(rows)


@query(sql=f"SELECT from_address AS address, arg_max(from_name, seq) AS name, CAST(sum({_WEIGHT}) AS BIGINT) AS score, min(seq) AS first_seq FROM m GROUP BY from_address", views="m")
def contact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir)


@query(
    sql=f"""SELECT address, name, score FROM (SELECT from_address AS address, arg_max(from_name, seq) AS name, CAST(sum({_WEIGHT}) AS BIGINT) AS score, min(seq) AS f FROM m GROUP BY from_address)
        WHERE contains(address, '11') AND address <> 'customer#000000011@example.com' ORDER BY score DESC, f LIMIT 6""",
    views="m",
)
def contact_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.suggest(_contacts(spark, sf_dir), " 11 ", ("customer#000000011@example.com",)).select("address", "name", "score")


@query(sql=f"SELECT from_address AS address, CAST(sum({_WEIGHT}) AS BIGINT) AS score FROM m GROUP BY from_address ORDER BY score DESC, min(seq) LIMIT 800", views="m")
def contacts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.kept_contacts(_contacts(spark, sf_dir)).select("address", "score")


@query(
    sql="""SELECT id, folder FROM (SELECT * FROM m WHERE folder = 'inbox' ORDER BY date DESC, seq LIMIT 60 OFFSET 20)
        WHERE id NOT IN (SELECT id FROM (SELECT * FROM m WHERE folder = 'inbox' ORDER BY date DESC, seq LIMIT 40))""",
    views="m",
)
def page_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailbox.in_folder(V.messages_slim(spark, sf_dir), "inbox").select("id", "folder", "date", "seq")
    return mailbox.not_shown(mailbox.page(rows, 20, 60), mailbox.page(rows, 0, 40), ["folder", "id"]).select("id", "folder")


@query(sql="SELECT id, folder FROM m WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)", views="m")
def bulk_destroy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.read(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"))
    return changes.destroy(V.messages_slim(spark, sf_dir), ids).select("id", "folder")


@query(
    sql="""SELECT user_id AS id, coalesce(arg_max(v, event_id) FILTER (f = 'seen'), false) AS seen, coalesce(arg_max(v, event_id) FILTER (f = 'flagged'), false) AS flagged,
          coalesce(arg_max(v, event_id) FILTER (f = 'answered'), false) AS answered
        FROM (SELECT *, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'flagged' ELSE 'answered' END AS f, value > 10 AS v FROM events WHERE event_type IN ('view', 'click', 'purchase'))
        GROUP BY user_id"""
)
def apply_flags_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_type") == "view", "seen").when(F.col("event_type") == "click", "flagged").when(F.col("event_type") == "purchase", "answered")
    log = V.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), flag.alias("flag"), (F.col("value") > 10).alias("value"), F.col("event_id").alias("seq"))
    return changes.flags_from_log(log.filter("flag is not null"))


@query(sql="SELECT id, seen OR amount > 300000 AS seen, flagged AND NOT (amount > 300000) AS flagged FROM m", views="m")
def set_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir)
    return changes.set_flags(rows, rows.filter("amount > 300000"), ("seen", "flagged"), ("flagged",)).select("id", "seen", "flagged")


@query(sql="SELECT CASE WHEN amount < 50000 THEN 'archive' ELSE folder END AS folder, count(*) AS n FROM m GROUP BY 1", views="m")
def move_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir)
    moved = changes.move(rows, rows.filter("amount < 50000"), V.folders(spark), "archive")
    return moved.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql="""SELECT id, CASE WHEN folder = 'archive' THEN 'inbox' ELSE 'archive' END AS archive_to, CASE WHEN folder = 'trash' THEN 'destroy' ELSE 'move' END AS delete_action FROM m""",
    views="m",
)
def key_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir)
    return rows.select("id", changes.action("archive", F.col("folder"))["target"].alias("archive_to"), changes.action("delete", F.col("folder"))["action"].alias("delete_action"))


@query(
    sql="""SELECT id, folder, thread_key, answered FROM (SELECT id, folder, thread_key, answered OR id % 50 = 0 AS answered FROM m
        UNION ALL SELECT id + 10000000, 'sent', thread_key, false FROM m WHERE id % 50 = 0)""",
    views="m",
)
def send_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir).withColumns({"message_id": F.concat(F.lit("m"), F.col("id").cast("string")), "in_reply_to": F.lit(None).cast("string"), "subject": F.lit("")})
    mail = rows.filter("id % 50 = 0").withColumns({"in_reply_to": F.col("message_id"), "id": F.col("id") + 10_000_000, "thread_key": F.lit(-1).cast("long"), "answered": F.lit(False)})
    mail = mail.withColumn("message_id", F.concat(F.lit("m"), F.col("id").cast("string")))
    return changes.send(rows, mail).select("id", "folder", "thread_key", "answered")


@query(
    sql="""SELECT key, value FROM (SELECT user_id AS key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t <> 'error'"""
)
def latest_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("saved_at"), (F.col("event_type") == "error").alias("deleted"), "value")
    return changes.latest_drafts(log).select("key", "value")


@query(sql="SELECT n_nationkey AS key, coalesce(s.v, n_name) AS value FROM nation LEFT JOIN (SELECT r_regionkey AS k, r_name AS v FROM region) s ON s.k = n_nationkey")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    stored = V.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return changes.merged_settings(base, stored)


@query(
    sql="""SELECT DISTINCT from_address FROM m WHERE from_address IN (SELECT lower(c_name) || '@example.com' FROM customer WHERE c_mktsegment = 'BUILDING')""",
    views="m",
)
def known_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lower("c_name"), F.lit("@example.com")).alias("from_address"))
    return _listed(V.messages_rel(spark, sf_dir)).join(known, "from_address", "left_semi").select("from_address").distinct()


@query(
    sql="""SELECT thread_key, coalesce(arg_max(id, (date, id)) FILTER (NOT answered), arg_max(id, (date, id))) AS reply_to_id FROM m GROUP BY thread_key""",
    views="m",
)
def reply_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.history import reply_source

    rows = V.messages_slim(spark, sf_dir).withColumn("ord", F.struct("date", "id"))
    return reply_source(rows, "thread_key", F.col("answered"), "ord")


_TO, _CC, _OWN = "'p' || c_custkey % 7 || '@x.org'", "'p' || c_custkey % 3 || '@x.org'", "'p' || c_custkey % 5 || '@x.org'"


@query(
    sql=f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN {_TO} ELSE {_OWN} END AS to_line,
        array_to_string(list_filter(CASE WHEN {_TO} = {_CC} THEN [{_TO}] ELSE CASE WHEN c_custkey % 5 = 1 THEN [{_CC}] ELSE [{_TO}, {_CC}] END END,
          lambda x: x <> 'p1@x.org' AND x <> CASE WHEN c_custkey % 5 = 1 THEN {_TO} ELSE {_OWN} END), '|') AS cc_line FROM customer"""
)
def reply_all_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    def person(n: int):
        return F.struct(F.lit("").alias("name"), F.concat(F.lit("p"), (F.col("c_custkey") % n).cast("string"), F.lit("@x.org")).alias("address"))

    rows = V.read(spark, sf_dir, "customer")
    none = F.slice(F.array(person(5)), 1, 0)
    both = people.reply_to_all("P1@x.org", person(5), none, F.array(person(7)), F.array(person(3)))
    out = rows.select(F.col("c_custkey").alias("id"), both.alias("r"))
    line = lambda p: F.array_join(F.transform(p, lambda a: a["address"]), "|")
    return out.select("id", line(F.col("r.to")).alias("to_line"), line(F.col("r.cc")).alias("cc_line"))


@query(
    sql="""SELECT thread_key, array_to_string(list_distinct_ordered[greatest(1, len(list_distinct_ordered) - 2):], ', ') AS who, n FROM (
        SELECT thread_key, count(*) AS n, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list([w] ORDER BY date, id)), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_ordered
        FROM (SELECT thread_key, date, id, CASE WHEN flagged THEN 'я' ELSE folder END AS w FROM m) GROUP BY thread_key)""",
    views="m",
)
def sender_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("flagged"), V.address(F.lit(""), F.lit("me@x.org"))).otherwise(V.address(F.concat("folder", F.lit(" Box")), F.lit("b@x.org")))
    rows = V.messages_rel(spark, sf_dir).withColumn("from", sender)
    return people.first_names(rows, "thread_key", ["date", "id"], "ME@x.org")


@query(
    sql="""SELECT c_custkey AS id, 'кому: ' || CASE WHEN c_custkey % 4 = 0 THEN 'мне' ELSE c_name END || CASE WHEN c_nationkey % 2 = 0 THEN ' · копия: n' || c_nationkey ELSE '' END AS line FROM customer"""
)
def people_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.read(spark, sf_dir, "customer")
    to = F.array(F.when(F.col("c_custkey") % 4 == 0, V.address(F.lit("Me"), F.lit("Me@x.org"))).otherwise(V.address(F.col("c_name"), F.lit("c@x.org"))))
    copy = F.array(V.address(F.lit(""), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("@x.org"))))
    cc = F.when(F.col("c_nationkey") % 2 == 0, copy).otherwise(F.slice(copy, 1, 0))
    return rows.select(F.col("c_custkey").alias("id"), people.people_line(to, cc, "me@x.org").alias("line"))
