"""Queries by indexes and ranges: search by postings, windows over whole folders, deep pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import folds, layout, mailbox, ranges, threads
from ..operators.postings import Postings
from ..sources import mailbox as mailfiles
from ..sources import views as V
from ..sources.keyed import Keyed, settings, settings_store
from ..sources.shared import fresh_path
from .mail import _FIELDS, _GROUP, AS_OF
from .registry import query

#: From one character to a whole line; the last one is in no text.
SEARCHED = ("LICENSE", "ß", "q", "th", "e. ", "permission is hereby", "ation, ", "no such words 7f3a")


def _newest() -> list[Column]:
    return [F.col("date").desc(), F.col("id").asc()]


@query(
    sql=f"""SELECT q AS query, id FROM d, (VALUES {", ".join(f"('{q}')" for q in SEARCHED)}) x(q)
        WHERE folder <> 'trash' AND contains(lower(coalesce(subject, '') || ' ' || coalesce(text, '') || ' ' || coalesce(from_name, '') || ' ' || coalesce(from_address, '')), lower(q))""",
    views="d",
)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of ``SEARCHED`` by one index of all messages."""
    index = Postings.build(V.messages_doc(spark, sf_dir), _FIELDS, fresh_path(spark, "postings"), 256)
    out = None
    for q in SEARCHED:
        hits = index.search(q).filter("folder <> 'trash'").select(F.lit(q).alias("query"), "id")
        out = hits if out is None else out.union(hits)
    return out


@query(sql=f"SELECT id, folder, g AS date_group, g IS DISTINCT FROM lag(g) OVER (PARTITION BY folder ORDER BY date DESC, id) AS is_break FROM (SELECT *, {_GROUP} AS g FROM m)", views="m")
def list_breaks_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.messages_slim(spark, sf_dir).withColumn("date_group", L.date_group(F.col("date"), F.lit(AS_OF).cast("timestamp")))
    return ranges.breaks(rows, "date_group", _newest(), ["folder"]).select("id", "folder", "date_group", "is_break")


@query(
    sql="""SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id,
          coalesce(first_value(CASE WHEN NOT seen THEN id END IGNORE NULLS) OVER (PARTITION BY folder ORDER BY date DESC, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
                   last_value(CASE WHEN NOT seen THEN id END IGNORE NULLS) OVER (PARTITION BY folder ORDER BY date DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS advance_to
        FROM m WINDOW w AS (PARTITION BY folder ORDER BY date DESC, id)""",
    views="m",
)
def list_navigation_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every folder as one list; the read messages leave."""
    return ranges.neighbours(V.messages_slim(spark, sf_dir), _newest(), ["folder"], "seen").select("id", "prev_id", "next_id", "advance_to")


@query(
    sql="""SELECT id, folder FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY date DESC, id) AS n FROM m)
        QUALIFY n BETWEEN min(CASE WHEN id % 1000 = 1 THEN n END) OVER (PARTITION BY folder) AND max(CASE WHEN id % 1000 = 1 THEN n END) OVER (PARTITION BY folder)""",
    views="m",
)
def range_selection_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last of some rows of each folder."""
    rows = V.messages_slim(spark, sf_dir)
    ends = [r["id"] for r in rows.filter("id % 1000 = 1").select("id").collect()]
    return ranges.between(rows, _newest(), ["folder"], *ends).select("id", "folder")


@query(sql="SELECT event_id, CAST(sum(event_id % 7 + 1) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS advance FROM events")
def text_advances_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one line of text."""
    rows = V.read(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 7 + 1).alias("width"))
    return ranges.advances(rows, [], [F.col("ts").asc(), F.col("event_id").asc()], "width").select("event_id", "advance")


@query(
    sql="""SELECT id, date, (SELECT count(*) FROM m WHERE folder = 'work' AND flagged) AS total, CASE WHEN 125 < (SELECT count(*) FROM m WHERE folder = 'work' AND flagged) THEN 125 END AS next
        FROM m WHERE folder = 'work' AND flagged ORDER BY date DESC, seq LIMIT 50 OFFSET 75
        """,
    views="m",
)
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of flagged messages by the counts of stored ranges."""
    order = [F.col("date").desc(), F.col("seq").asc()]
    pages = ranges.Pages.build(V.messages_slim(spark, sf_dir).select("id", "folder", "date", "seq", "seen", "flagged"), order, fresh_path(spark, "pages"))
    return pages.page_with_total("work", 75, 50, flagged=F.col("flagged")).select("id", "date", "total", "next")


@query(
    sql="""SELECT id, date FROM (SELECT * FROM m WHERE folder = 'inbox' AND NOT seen AND (contains(lower(from_name), '1') OR contains(lower(from_address), '1')) ORDER BY seq DESC LIMIT 20 OFFSET 40)""",
    views="m",
)
def criteria_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a server answers to a search: the latest hits by arrival are cut out, then sorted by date inside the page."""
    rows = V.messages_rel(spark, sf_dir).select("id", "folder", "date", "seq", "seen", "flagged", "from")
    pages = ranges.Pages.build(rows, [F.col("seq").desc()], fresh_path(spark, "pages"))
    where = mailbox.criteria([F.col("from.name"), F.col("from.address")], "1", "unread", F.lit(None).cast("string"))
    return pages.page("inbox", 40, 20, where=where).orderBy(F.col("date").desc(), F.col("seq").desc()).select("id", "date")


#: Chains of about fifty replies; in every tenth the first answers the last, in the next the first answers what isn't there.
_CHAINED = "SELECT id, seq // 200 AS chain, lag(id) OVER (PARTITION BY seq // 200 ORDER BY id) AS before, max(id) OVER (PARTITION BY seq // 200) AS last FROM m"


@query(
    sql=f"""SELECT * FROM (WITH RECURSIVE l AS MATERIALIZED (SELECT id, chain, CASE WHEN before IS NOT NULL THEN 'm' || before WHEN chain % 10 = 0 AND last <> id THEN 'm' || last WHEN chain % 10 = 1 THEN 'gone' END AS parent FROM ({_CHAINED})),
        r AS (SELECT id, 'm' || id AS root, 0 AS depth FROM l WHERE parent IS NULL OR parent = 'gone' UNION ALL SELECT l.id, r.root, r.depth + 1 FROM r JOIN l ON l.parent = 'm' || r.id),
        rings AS (SELECT chain, min('m' || id) AS root FROM l WHERE chain NOT IN (SELECT chain FROM l WHERE parent IS NULL OR parent = 'gone') GROUP BY chain)
        SELECT id, root, CAST(depth AS BIGINT) AS depth FROM r UNION ALL SELECT id, root, NULL FROM l JOIN rings USING (chain))""",
    views="m",
)
def reply_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest ancestor of each message, through all replies."""
    w = Window.partitionBy("chain").orderBy("id")
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    rows = V.messages_slim(spark, sf_dir).withColumn("chain", F.floor(F.col("seq") / 200))
    rows = rows.withColumns({"before": F.lag("id").over(w), "last": F.max("id").over(Window.partitionBy("chain"))})
    first = F.when((F.col("chain") % 10 == 0) & (F.col("last") != F.col("id")), name(F.col("last"))).when(F.col("chain") % 10 == 1, F.lit("gone"))
    mails = rows.select("id", name(F.col("id")).alias("message_id"), F.coalesce(name(F.col("before")), first).alias("in_reply_to"))
    return threads.roots(mails).select(F.substring("message_id", 2, 30).cast("long").alias("id"), "root", "depth")


@query(sql="""SELECT key, value FROM (SELECT user_id AS key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t <> 'error'""")
def keyed_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each draft, from a table that takes the log in four changes, with a compaction between them."""
    log = V.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("saved_at"), F.col("event_type").alias("t"), "value")
    drafts = Keyed(spark, fresh_path(spark, "drafts"), "key", "key long, saved_at long, value double", 32)
    cuts = [r[0] for r in log.agg(F.explode(F.percentile("saved_at", F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1.0))))).collect()]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = log.filter((F.col("saved_at") >= low) & ((F.col("saved_at") < high) if i < 3 else F.lit(True)))
        last = part.groupBy("key").agg(F.max_by(F.struct("saved_at", "t", "value"), "saved_at").alias("r")).select("key", "r.*")
        drafts.upsert(last.filter("t <> 'error'").select("key", "saved_at", "value"))
        drafts.delete(last.filter("t = 'error'").select("key"))
        if i == 1:
            drafts.compact()
    return drafts.read().select("key", "value")


@query(
    sql="""SELECT folder, id AS uid, 'No ' || id || ' of ' || folder AS subject, from_address AS sender, '<m' || id || '@x>' AS message_id, md5(coalesce(text, '')) AS body FROM d
        WHERE folder IN (SELECT min(folder) FROM d UNION SELECT max(folder) FROM d) AND id BETWEEN 30 AND 900""",
    views="d",
)
def mailbox_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as raw mail in a mailbox; of two folders a range of numbers is read."""
    rows = V.messages_doc(spark, sf_dir)
    number = F.col("id").cast("string")
    head = F.concat(F.lit("From: "), F.col("from.address"), F.lit("\r\nSubject: No "), number, F.lit(" of "), "folder", F.lit("\r\nMessage-ID: <m"), number, F.lit("@x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"))
    path = fresh_path(spark, "mailbox")
    written = mailfiles.write_mail(rows.select("folder", F.col("id").alias("uid"), F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "UTF-8").alias("raw")), path, 100)
    folders = [r["folder"] for r in written.groupBy("folder").agg(F.sum("n").alias("n")).orderBy("folder").collect()]
    mails = mailfiles.read_mail(spark, path, bodies=True, folders=[folders[0], folders[-1]], low=30, high=900)
    text = F.decode("raw", "UTF-8")
    body = F.substring(text, F.instr(text, "\r\n\r\n") + 4, F.char_length(text))
    return mails.select("folder", "uid", "subject", "sender", "message_id", F.md5(F.encode(body, "UTF-8")).alias("body"))


@query(
    sql="""WITH RECURSIVE p AS (SELECT user_id % 3 AS pen, event_id, value / 100 AS x, CAST(event_id % 3 / 10 AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events),
        k AS (SELECT pen, event_id, n, x AS kx, y AS ky, true AS far FROM p WHERE n = 1 UNION ALL
          SELECT p.pen, p.event_id, p.n, CASE WHEN f THEN p.x ELSE kx END, CASE WHEN f THEN p.y ELSE ky END, f FROM k JOIN p ON p.pen = k.pen AND p.n = k.n + 1,
            LATERAL (SELECT (p.x - kx) * (p.x - kx) + (p.y - ky) * (p.y - ky) >= 0.35 AS f))
        SELECT event_id, pen FROM k WHERE far"""
)
def steady_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three strokes that hold all events, walked in pieces at once."""
    points = V.strokes(spark, sf_dir).select("event_id", (F.col("pointer_id") % 3).alias("pen"), "ts", (F.col("x") / 100).alias("x"), (F.col("event_id") % 3 / 10).cast("double").alias("y"))
    return folds.steady(points, ["pen"], ["ts", "event_id"], layout.TREMOR).select("event_id", "pen")


@query(
    sql="""WITH s AS (SELECT CAST(c_custkey % 40 AS VARCHAR) AS key, max(c_custkey) AS last FROM customer GROUP BY 1),
        v AS (SELECT key, CASE WHEN key IN ('3', '4') THEN NULL WHEN key = '5' THEN NULL ELSE '{"by":' || last || '}' END AS v FROM s WHERE key <> '6')
        SELECT coalesce(n.key, v.key) AS key, coalesce(v.v, n.value) AS value FROM (SELECT CAST(n_nationkey AS VARCHAR) AS key, '"' || n_name || '"' AS value FROM nation) n FULL JOIN (SELECT * FROM v WHERE v IS NOT NULL) v ON v.key = n.key"""
)
def kept_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of nations by default, changed by each customer in turn; broken, null and deleted ones fall back."""
    store = settings_store(spark, fresh_path(spark, "settings"))
    rows = V.read(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).cast("string").alias("key"), "c_custkey")
    last = rows.groupBy("key").agg(F.max("c_custkey").alias("n"))
    store.upsert(last.select("key", F.lit("{}").alias("value")))
    by = F.concat(F.lit('{"by":'), F.col("n").cast("string"), F.lit("}"))
    broken = F.when(F.col("key").isin("3", "4"), "{broken").when(F.col("key") == "5", "null").otherwise(by)
    store.upsert(last.select("key", broken.alias("value")))
    store.delete(last.filter("key = '6'").select("key"))
    defaults = V.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit('"'), "n_name", F.lit('"')).alias("value"))
    return settings(store, defaults)
