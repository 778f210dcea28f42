"""Queries over message bodies and requests: MIME trees, previews, HTML bodies, images, settings, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import layout, mailbox
from ..sources import frames, mime
from ..sources import views as V
from .mail import AS_OF
from .registry import query
from .texts import _ENDED, _ESCAPED, ended, quotes_sql


def _linked(x: str) -> str:
    """SQL of a piece of a message as HTML."""
    web = rf'''regexp_replace({_ESCAPED.format(x)}, '(https?://[^\s<]+[^\s<.,;:!?)\]\x27"])', '<a href="\1">\1</a>', 'g')'''
    return rf'''regexp_replace({web}, '(^|[\s(])([\w.+-]+@[\w-]+\.[\w.-]+)', '\1<a href="mailto:\2">\2</a>', 'g')'''


_FOLD = '<details class="aq"><summary title="Показать цитату">•••</summary><div class="plain quoted">'
_MAILED = _ENDED.replace("text ||", "text || ' see https://a.b/c?x=1. or (me@x.org), ok' ||")


@query(
    sql=f"""SELECT id, '<div class="plain">' || {_linked("body")} || '</div>' || CASE WHEN quoted IS NULL THEN '' ELSE '{_FOLD}' || {_linked("quoted")} || '</div></details>' END AS html FROM ({quotes_sql(_MAILED)})""",
    views="d",
)
def plain_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, ["", "\n> a\n>b\n\n> c", "\n-- Original Message --\nold", "\nOn Monday, Ann wrote:\n> x\ny"])), (F.col("id") % 4 + 1).cast("int"))
    text = F.concat("text", F.lit(" see https://a.b/c?x=1. or (me@x.org), ok"), end)
    return V.messages_doc(spark, sf_dir, wide=True).select("id", T.plain_to_html(text).alias("html"))


@query(
    sql=rf"""SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 AS as_plain, NOT as_plain AND regexp_matches(html, $$(?i)<img[^>]+src\s*=\s*["']?\s*(?:https?:)?//|url\(\s*["']?\s*(?:https?:)?//|\sbackground\s*=\s*["']?\s*https?:$$) AS remote,
        as_plain OR NOT (regexp_matches(html, '(?i)<table|bgcolor|background(?:-color)?\s*:|<style') OR len(regexp_extract_all(html, '(?i)color\s*:')) > 3) AS themed,
        CASE WHEN as_plain THEN '<div class="plain">' || {_linked("url")} || '</div>' ELSE html END AS body FROM pages"""
)
def shown_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, none = F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0
    rows = V.read(spark, sf_dir, "pages").withColumn("s", T.shown_body(plain, F.col("url"), F.when(~none, F.col("html"))))
    return rows.select("page_id", (plain | none).alias("as_plain"), F.coalesce("s.remote", F.lit(False)).alias("remote"), F.coalesce("s.themed", F.lit(True)).alias("themed"), "s.body")


@query(
    sql=f"""SELECT id, '<div class="attrib"><br>вчера, 10:00, ' || {_ESCAPED.format("who")} || ' пишет:</div><blockquote type="cite">' || replace({_ESCAPED.format("text")}, chr(10), '<br>') || '</blockquote>' AS quote,
        '<div class="fwd"><br>---------- Пересланное сообщение ----------<br><b>От:</b> ' || {_ESCAPED.format("who")} || '<br><b>Дата:</b> вчера, 10:00<br>' || CASE WHEN subject = '' THEN '' ELSE '<b>Тема:</b> ' || {_ESCAPED.format("subject")} || '<br>' END
          || '<b>Кому:</b> a@x.org, B &lt;b@x.org&gt;<br><br>' || replace({_ESCAPED.format("text")}, chr(10), '<br>') || '</div>' AS forward
        FROM (SELECT *, CASE WHEN id % 2 = 0 THEN from_name || ' <' || from_address || '>' ELSE from_address END AS who FROM d)""",
    views="d",
)
def quote_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.struct(F.when(F.col("id") % 2 == 0, F.col("from.name")).otherwise("").alias("name"), F.col("from.address").alias("address"))
    when = L.long_date(F.lit("2001-08-01 10:00:00").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    to = F.array(V.address(F.lit(""), F.lit("a@x.org")), V.address(F.lit("B"), F.lit("b@x.org")))
    forward = T.forward_block(sender, when, F.col("subject"), to, F.slice(to, 1, 0), F.col("text"))
    return V.messages_doc(spark, sf_dir).select("id", T.quote_block(sender, when, F.col("text")).alias("quote"), forward.alias("forward"))


#: A raw message around each document: an alternative of two texts, and for some an attached file or an inline image.
_HEADERS = 'From: "Ann B" <Ann@X.org>\r\nTo: b@x.org, C <c@x.org>\r\nSubject: Part\r\nMessage-ID: <m{}@x>\r\nReferences: <r1@x> <r2@x>\r\nMIME-Version: 1.0\r\n'
_SENT_AS = "Content-Type: text/{}; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"


def raw_messages(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """id, raw: a lone text, an alternative, or a mixture of an alternative and a file, by turns.

    Not ``labelled``, they are the bare documents, for what drops the texts and is joined with the labels (``V.labelled``) after that.
    """
    i, body = F.col("id"), F.base64(F.encode("text", "UTF-8"))
    number = i.cast("string")
    head = F.concat(F.lit(_HEADERS.split("{}")[0]), number, F.lit(_HEADERS.split("{}")[1]))
    both = F.concat(F.lit("Content-Type: multipart/alternative; boundary=alt\r\n\r\n--alt\r\n" + _SENT_AS.format("plain")), body, F.lit("\r\n--alt\r\n" + _SENT_AS.format("html")), body, F.lit("\r\n--alt--\r\n"))
    file = F.lit('\r\n--mix\r\nContent-Type: application/pdf; name="a.pdf"\r\nContent-Disposition: attachment; filename="a.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJDRA==\r\n--mix--\r\n')
    mixed = F.concat(F.lit("Content-Type: multipart/mixed; boundary=mix\r\n\r\n--mix\r\n"), both, file)
    lone = F.concat(F.lit(_SENT_AS.format("html")), body)
    rows = V.messages_doc(spark, sf_dir, wide=True) if labelled else V.spread(V.read(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "id")
    return rows.select("id", F.encode(F.concat(head, F.when(i % 3 == 0, lone).when(i % 3 == 1, both).otherwise(mixed)), "UTF-8").alias("raw"))


@query(
    sql="""SELECT id, unnest(CASE id % 3 WHEN 0 THEN ['1'] WHEN 1 THEN ['1', '2'] ELSE ['1.1', '1.2', '2'] END) AS part, unnest(CASE id % 3 WHEN 0 THEN ['text/html'] WHEN 1 THEN ['text/plain', 'text/html'] ELSE ['text/plain', 'text/html', 'application/pdf'] END) AS type,
        unnest(CASE id % 3 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] ELSE [0, 1, 2] END) AS ord, unnest(CASE id % 3 WHEN 0 THEN [''] WHEN 1 THEN ['', ''] ELSE ['', '', 'a.pdf'] END) AS filename FROM d""",
    views="d",
)
def message_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = mime.message_parts(raw_messages(spark, sf_dir, labelled=False), "id", "raw", bodies=False)
    return V.labelled(spark, sf_dir, parts).select("id", "part", "type", "ord", F.coalesce("filename", F.lit("")).alias("filename"))


@query(
    sql="SELECT id, CASE id % 3 WHEN 2 THEN '1.1' ELSE '1' END AS part, id % 3 = 2 AS has_attachments, text[1:500] AS preview FROM d",
    views="d",
)
def part_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of each message's text part, read from its first 3,000 bytes as sent."""
    rows = mime.previewed(raw_messages(spark, sf_dir), "raw")
    return rows.select("id", "part", "has_attachments", F.substring("preview", 1, 500).alias("preview"))


@query(sql="SELECT CASE id % 3 WHEN 2 THEN '1.1' ELSE '1' END AS part, id // 1000 AS batch, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM d GROUP BY 1, 2", views="d")
def ids_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages whose preview is fetched from the same part."""
    trees = mime.part_arrays(raw_messages(spark, sf_dir, labelled=False), "raw", bodies=False)
    first = trees.select("id", mime.shown_part(F.col("parts"))["part"].alias("part")).filter("part is not null")
    return mailbox.ids_by(V.labelled(spark, sf_dir, first), "part").select("part", "batch", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    sql="""SELECT id, 'Part' AS subject, 'ann@x.org' AS sender, 2 AS n_to, '<m' || id || '@x>' AS message_id, 2 AS n_refs, CASE WHEN id % 3 = 0 THEN NULL ELSE text END AS text, text AS html, CASE WHEN id % 3 = 2 THEN 'a.pdf:4' ELSE '' END AS files FROM d""",
    views="d",
)
def parsed_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mime.parsed_messages(raw_messages(spark, sf_dir), "raw")
    files = F.array_join(F.transform("attachments", lambda a: F.concat(a["filename"], F.lit(":"), a["size"].cast("string"))), "|")
    return rows.select("id", "subject", F.col("sender.address").alias("sender"), F.size("to").alias("n_to"), "message_id", F.size("refs").alias("n_refs"), "text", "html", files.alias("files"))


@query(
    sql="""SELECT page_id AS id, '<img src="/attachment/' || page_id || '/0"><a href="cid:none">' || CASE WHEN page_id % 2 = 0 THEN '<img src="/attachment/' || page_id || '/3">' ELSE '<img src="cid:Second%20One">' END || html AS html FROM pages"""
)
def inlined_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.bodies_html(spark, sf_dir)
    bodies = pages.select(F.col("page_id").alias("id"), F.concat(F.lit('<img src="CID:First"><a href="cid:none"><img src="cid:Second%20One">'), "html").alias("html"))
    file = lambda n, cid: F.struct(F.lit(n).alias("index"), F.lit(cid).alias("cid"))
    cids = F.when(F.col("page_id") % 2 == 0, F.array(file(0, "<first>"), file(3, "second one"))).otherwise(F.array(file(0, "FIRST")))
    files = pages.select(F.col("page_id").alias("message_id"), F.inline(cids))
    return mime.inline_images(bodies, files)


@query(sql="SELECT page_id, replace(url, chr(160), ' ') || chr(10) || 'two' AS lead FROM pages")
def lead_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = mime.html_function(mime.lead_of)
    html = F.concat(F.lit("<div>"), T.escape_html(F.col("url")), F.lit("</div><p>t<b>wo</b></p>"), F.when(F.col("page_id") % 2 == 0, '<div class="x sig">--<br>me</div>').otherwise("<blockquote>old</blockquote>"), F.lit("<div>later</div>"))
    return V.read(spark, sf_dir, "pages").select("page_id", lead(html).alias("lead"))


@query(
    sql="""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'file' ELSE c_name || '__' || c_mktsegment || '_' END AS safe, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS name, lower(c_name) || '@x.org' AS address,
        'a@x.org|' || lower(c_name) || '@x.org|' AS listed FROM customer"""
)
def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, mail = F.col("c_name"), F.concat("c_name", F.lit("@X.org"))
    raw = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.concat("c_name", F.lit('\r"'), "c_mktsegment", F.lit("\\")))
    typed = T.typed_recipient(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(' "'), name, F.lit('" <'), mail, F.lit(">,;"))).otherwise(F.concat(F.lit(" "), mail, F.lit(";"))))
    person = lambda n, a: F.struct(n.alias("name"), a.alias("address"))
    groups = F.array(F.array(person(F.lit("A"), F.lit("A@X.org")), person(F.lit(""), F.lit(""))), F.array(person(name, mail)), F.array(person(F.lit("only a name"), F.lit(None).cast("string"))))
    listed = F.array_join(F.transform(T.address_list(groups), lambda a: a["address"]), "|")
    return V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.safe_name(raw).alias("safe"), typed["name"].alias("name"), typed["address"].alias("address"), listed.alias("listed"))


@query(sql="SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS n FROM events WHERE event_id % 9 <> 0")
def parsed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies over the limit are refused, broken ones are null."""
    n = F.col("event_id").cast("string")
    good = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "n": '), n, F.lit("}"))
    body = F.when(F.col("event_id") % 9 == 0, F.rpad(good, 200, " ")).when(F.col("event_id") % 4 == 0, '{"kind": "x", "n": ').otherwise(good)
    rows = V.read(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return frames.requests(rows, "body", "kind string, n long", 150).select("event_id", "request.kind", "request.n")


@query(
    sql="""SELECT n_nationkey AS id, 'KEY_' || n_nationkey AS key, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' = x' ELSE '"' || n_name END AS value FROM nation WHERE n_nationkey % 5 <> 4"""
)
def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey")
    value = F.when(i % 3 == 0, F.concat(F.lit(' "'), "n_name", F.lit('" '))).when(i % 3 == 1, F.concat("n_name", F.lit(" = x"))).otherwise(F.concat(F.lit('"'), "n_name"))
    line = F.when(i % 10 == 4, "# KEY=comment").when(i % 10 == 9, " no pair ").otherwise(F.concat(F.lit("  KEY_"), i.cast("string"), F.lit(" = "), value))
    rows = V.read(spark, sf_dir, "nation").select(line.alias("line"))
    return frames.settings_lines(rows, "line").select(F.regexp_extract("key", "([0-9]+)", 1).cast("int").alias("id"), "key", "value")


@query(
    sql="""SELECT c_custkey AS id, 'u' || c_custkey AS user_name, CASE WHEN c_custkey % 3 = 0 THEN 'imap.big.org' ELSE 'imap.own.org' END AS imap, CASE WHEN c_custkey % 3 = 0 THEN 'smtp.big.org' ELSE 'smtp.own.org' END AS smtp,
        CASE WHEN c_custkey % 2 = 0 THEN 143 ELSE 993 END AS imap_port, c_custkey % 2 = 1 AS imap_secure, CASE WHEN c_custkey % 3 = 0 THEN 587 ELSE 465 END AS smtp_port, c_custkey % 3 <> 0 AS smtp_secure
        FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0"""
)
def resolved_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("c_custkey"), F.lit(None).cast("string")
    rows = V.read(spark, sf_dir, "customer").select(
        i.alias("id"), F.when(i % 3 == 0, "BIG").alias("provider"), F.when(i % 3 == 1, "imap.own.org").alias("imap_host"), none.alias("smtp_host"), none.alias("imap_user"), F.concat(F.lit("u"), i.cast("string")).alias("mail_user"),
        F.when(i % 7 != 0, "secret").alias("imap_pass"), none.alias("mail_pass"), F.when(i % 2 == 0, 143).alias("imap_port"), F.lit(None).cast("int").alias("smtp_port"), F.lit(None).cast("boolean").alias("imap_secure"), F.lit(None).cast("boolean").alias("smtp_secure"), (i % 11 == 0).alias("demo"),
    )
    presets = spark.createDataFrame([("big", "imap.big.org", "smtp.big.org", 587)], "provider string, imap string, smtp string, smtp_port int")
    return frames.resolved_accounts(rows, presets).select("id", F.col("user").alias("user_name"), "imap", "smtp", "imap_port", "imap_secure", "smtp_port", "smtp_secure")


@query(
    sql="""SELECT event_id, round((40 * greatest(0.35, least(2.6, 0.45 + 0.9 * (value % 30) / 16)) + CASE event_type[1:1] WHEN 'c' THEN 120 WHEN 'e' THEN 250 WHEN 'p' THEN 18 ELSE 0 END * 40 / 52.0) / 1.5, 6) AS ms, least(3.0, value / 50 * 2.2) AS rate FROM events"""
)
def char_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("event_type", 1, 1)
    char = F.when(first == "c", ",").when(first == "e", ".").when(first == "p", " ").otherwise("x")
    ms = layout.char_duration(char, F.col("value") % 30, 16.0, 40.0, 1.5)
    return V.read(spark, sf_dir, "events").select("event_id", F.round(ms, 6).alias("ms"), layout.hastened(F.col("value") / 50).alias("rate"))


@query(sql="SELECT user_id, event_id, CAST(sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS advance FROM events")
def text_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7 + 1).alias("width"))
    return layout.advances(rows, ["user_id"], "event_id", "width").select("user_id", "event_id", "advance")
