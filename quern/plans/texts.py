"""Queries over texts: subjects, HTML, snippets, labels, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import layout
from ..sources import frames, mime
from ..sources import views as V
from .registry import query

_S = r"[\s\x{A0}\x{FEFF}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_S}+|{_S}+\z', '', 'g')"


_LEAD = rf"(?i)\A(?:{_S}*(?:(?:re|fw|fwd|aw|wg|sv|vs|ответ|отв|пересл)(?:\[\d+\])?{_S}*:|\[(?:ext|external)\]){_S}*)+"
_PREFIXED = "['Re: ', 'FW[2]: RE: ', '[EXT] Ответ: ', '[team] ', '  Sv:re :', ''][id % 6 + 1] || subject"


@query(sql=f"SELECT id, lower(regexp_replace({_trim(f'regexp_replace(s, $${_LEAD}$$, $$$$)')}, '{_S}+', ' ', 'g')) AS subject_key FROM (SELECT id, {_PREFIXED} AS s FROM d)", views="d")
def subject_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = F.array(*map(F.lit, ["Re: ", "FW[2]: RE: ", "[EXT] Ответ: ", "[team] ", "  Sv:re :", ""]))
    return V.messages_doc(spark, sf_dir).select("id", T.thread_subject(F.concat(F.element_at(prefixes, (F.col("id") % 6 + 1).cast("int")), "subject")).alias("subject_key"))


_QUOTED = "text || ['', chr(10) || '> quoted' || chr(10) || 'more', chr(10) || '-- ' || chr(10) || 'Sig', chr(10) || 'On Tue, somebody wrote:' || chr(10) || 'old'][id % 4 + 1]"


def snippet_sql(text: str, columns: str = "id, ") -> str:
    """SQL of the snippet of an expression over view d."""
    return rf"""SELECT {columns}CASE WHEN length(f) > 180 THEN regexp_replace(f[1:179], '{_S}+\z', '') || '…' ELSE f END AS snippet FROM (
        SELECT *, {_trim(f"regexp_replace(array_to_string(list_filter(l[1:n], lambda x: NOT regexp_matches(x, '^{_S}*>')), ' '), '{_S}+', ' ', 'g')")} AS f FROM (
          SELECT *, coalesce(list_position(list_transform(l, lambda x: NOT regexp_matches(x, '^{_S}*>') AND (regexp_matches(x, '^--{_S}*$') OR regexp_matches(x, '(?i)^(?:On|В|Le|Am) .{{4,120}}(?:wrote|написал|a écrit|schrieb)'))), true), len(l) + 1) - 1 AS n
          FROM (SELECT *, regexp_split_to_array({text}, '\r?\n') AS l FROM d)))"""


@query(sql=snippet_sql(_QUOTED), views="d")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, ["", "\n> quoted\nmore", "\n-- \nSig", "\nOn Tue, somebody wrote:\nold"]))
    return V.messages_doc(spark, sf_dir, wide=True).select("id", T.snippet(F.concat("text", F.element_at(ends, (F.col("id") % 4 + 1).cast("int")))).alias("snippet"))


def entities_sql(text: str) -> str:
    """SQL that reads each entity of a text once."""
    named = " ".join(f"WHEN lower(p) = '&{k};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in T.ENTITIES.items())
    number = r"CAST(CASE WHEN p[3:3] IN ('x', 'X') THEN CASE WHEN length(ltrim(p[4:-2], '0')) <= 6 THEN '0x' || p[4:-2] END WHEN length(ltrim(p[3:-2], '0')) <= 7 THEN p[3:-2] END AS BIGINT)"
    return rf"""array_to_string(list_transform(regexp_extract_all({text}, '(?s)&(?:#[xX][0-9a-fA-F]+|#\d+|[a-zA-Z]+);|[^&]+|&'), lambda p: CASE WHEN p[1:1] <> '&' OR length(p) < 3 THEN p {named}
        WHEN p[2:2] = '#' AND {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr(CAST({number} AS INTEGER)) ELSE p END), '')"""


_UNROLLED = "html"
for _tag in ("head", "script", "style", "title"):
    _UNROLLED = rf"regexp_replace({_UNROLLED}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_BARE = rf"regexp_replace(regexp_replace(regexp_replace({_UNROLLED}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|blockquote)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_LINES = rf"regexp_replace(regexp_replace({entities_sql('b')}, '[ \t\x{{A0}}]+', ' ', 'g'), '{_S}*\n{_S}*', chr(10), 'g')"


@query(sql=f"SELECT page_id, {_trim(_LINES)} AS text FROM (SELECT page_id, {_BARE} AS b FROM pages)")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL takes one tag after the other, which is the same where none of them holds another's end."""
    return V.spread(V.bodies_html(spark, sf_dir)).select("page_id", T.html_to_text(F.col("html")).alias("text"))


_ODD = "'&amp;lt; &#0; &#x1F600; &#128516; &unknown; &AMP; &#xD800; &#99999999; & &;'"


@query(sql=f"SELECT page_id, {entities_sql('h')} AS plain FROM (SELECT page_id, {_ODD} || html AS h FROM pages)")
def decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bodies_html(spark, sf_dir).select("page_id", T.decode_entities(F.concat(F.lit(_ODD.strip("'")), "html")).alias("plain"))


@query(
    sql=r"""SELECT page_id, regexp_matches(html, $$(?i)<img[^>]+src\s*=\s*["']?\s*(?:https?:)?//|url\(\s*["']?\s*(?:https?:)?//|\sbackground\s*=\s*["']?\s*https?:$$) AS is_remote,
        regexp_matches(html, '(?i)<table|bgcolor|background(?:-color)?\s*:|<style') OR len(regexp_extract_all(html, '(?i)color\s*:')) > 3 AS is_designed,
        length(regexp_replace(regexp_replace(regexp_replace(html, $$(?i)<meta[^>]+http-equiv\s*=\s*["']?refresh[^>]*>$$, '', 'g'), '(?i)<base[^>]*>', '', 'g'), '(?is)<script.*?</script>', '', 'g')) AS clean_chars FROM pages"""
)
def remote_or_designed(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return V.bodies_html(spark, sf_dir).select("page_id", T.is_remote(html).alias("is_remote"), T.is_designed(html).alias("is_designed"), F.char_length(T.clean_html(html)).cast("long").alias("clean_chars"))


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    sql=rf"""SELECT id, regexp_replace(regexp_replace({_ESCAPED.format("text || ' see https://a.b/c?x=1. <b>'")}, '(https?://[^\s<]+[^\s<.,;:!?)\]])', '<a href="\1">\1</a>', 'g'), '\r?\n', '<br>', 'g') AS html FROM d""",
    views="d",
)
def escape_linkify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.messages_doc(spark, sf_dir).select("id", T.text_to_html(F.concat("text", F.lit(" see https://a.b/c?x=1. <b>"))).alias("html"))


@query(
    sql="""SELECT c_custkey AS id, c_name || '|' AS names, lower(c_name) || '@x.org|n' || c_nationkey || '@y.com' AS addresses FROM customer"""
)
def recipients_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.concat(F.lit('"'), "c_name", F.lit('" <'), F.lower("c_name"), F.lit("@x.org>, nope; n"), F.col("c_nationkey").cast("string"), F.lit("@y.com\n bad@host"))
    rows = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.parse_recipients(typed).alias("r"))
    return rows.select("id", F.array_join("r.name", "|").alias("names"), F.array_join("r.address", "|").alias("addresses"))


@query(
    sql="""SELECT id, seed, seed % 360 AS h1, (seed % 360 + 40 + ((CASE WHEN seed >= 2147483648 THEN seed - 4294967296 ELSE seed END) >> 9) % 60) % 360 AS h2 FROM (
        SELECT c_custkey AS id, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(lower(c_name), ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda x, c: CAST((xor(CAST(x AS BIGINT), CAST(c AS BIGINT)) * CAST(16777619 AS HUGEINT)) % 4294967296 AS HUGEINT))::BIGINT AS seed FROM customer)"""
)
def avatar_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), L.fnv1a(F.lower("c_name")).alias("seed"))
    return rows.select("id", "seed", L.hues(F.col("seed"))["h1"].alias("h1"), L.hues(F.col("seed"))["h2"].alias("h2"))


@query(
    sql="""SELECT p_partkey AS id, CASE WHEN strpos(lower(p_name), 'ri') = 1 THEN 100 WHEN strpos(lower(p_name), 'ri') > 1 THEN 60 - (strpos(lower(p_name), 'ri') - 1)
        WHEN regexp_matches(lower(p_name), 'r.*i') THEN 10 ELSE 0 END AS score FROM part"""
)
def fuzzy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), L.fuzzy_score(F.col("p_name"), "RI").cast("int").alias("score"))


@query(
    sql="""SELECT message_id, index, CASE WHEN size < 1024 THEN size || ' Б' WHEN size < 1048576 THEN CAST(floor(size / 1024.0 + 0.5) AS BIGINT) || ' КБ'
        WHEN size < 10485760 THEN format('{:.1f}', floor(size / 1048576.0 * 10 + 0.5) / 10) || ' МБ' ELSE CAST(floor(size / 1048576.0 + 0.5) AS BIGINT) || ' МБ' END AS label,
        upper(split_part(filename, '.', 2)[1:4]) AS ext,
        CASE split_part(filename, '.', 2)[1:4] WHEN 'pdf' THEN '#e5484d' WHEN 'docx' THEN '#3e63dd' WHEN 'xlsx' THEN '#30a46c' WHEN 'zip' THEN '#8e4ec6' WHEN 'txt' THEN '#6f6e77' ELSE '#6e5bff' END AS color FROM a""",
    views="a",
)
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    badge = L.file_badge(F.col("filename"))
    return V.attachments_rel(spark, sf_dir).select("message_id", "index", L.file_size(F.col("size")).alias("label"), badge["ext"].alias("ext"), badge["color"].alias("color"))


@query(
    sql="""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 1 AND c_custkey % 100 <> 11 THEN 'письмо' WHEN c_custkey % 10 BETWEEN 2 AND 4 AND c_custkey % 100 NOT BETWEEN 12 AND 14 THEN 'письма' ELSE 'писем' END AS noun,
        c_custkey || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
        upper(c_name[1:1]) || regexp_extract(c_mktsegment, '[A-Z]') AS initials FROM customer"""
)
def plural_and_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    shown = F.concat(F.lit("«"), F.regexp_extract("c_name", "^([A-Za-z]+)", 1), F.lit(" - "), "c_mktsegment", F.lit("» x"))
    return V.read(spark, sf_dir, "customer").select(n.alias("id"), L.plural(n, "письмо", "письма", "писем").alias("noun"), L.ordinal(n).alias("nth"), T.initials(shown).alias("initials"))


@query(
    sql="""SELECT o_orderkey AS id, CASE WHEN n <= 0 THEN strftime(o_orderdate, '%H:%M') WHEN n = 1 THEN 'вчера' WHEN n < 7 THEN ['вс','пн','вт','ср','чт','пт','сб'][dayofweek(o_orderdate) + 1]
        WHEN year(o_orderdate) = 2001 THEN d ELSE d || '. ' || strftime(o_orderdate, '%y') || ' г.' END AS short_date
        FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS n, day(o_orderdate) || ' ' || ['янв','февр','мар','апр','мая','июн','июл','авг','сент','окт','нояб','дек'][month(o_orderdate)] AS d FROM orders)"""
)
def short_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.short_date(F.col("o_orderdate"), F.lit("2001-08-02 00:00:00").cast("timestamp")).alias("short_date"))


@query(
    sql="""SELECT id, CASE WHEN regexp_matches(s, '(?i)^\\s*(?:re|ответ)\\s*:') THEN s ELSE 'Re: ' || s END AS reply, CASE WHEN regexp_matches(s, '(?i)^\\s*(?:fwd?|пересл)\\s*:') THEN s ELSE 'Fwd: ' || s END AS forward,
        CASE WHEN strpos(lower(s), 'the') > 0 THEN {0} || '<mark>' || {1} || '</mark>' || {2} ELSE {3} END AS marked
        FROM (SELECT id, ['', 'RE: ', 'Fwd: ', 'ответ :'][id % 4 + 1] || subject AS s FROM d)""".replace("\\\\", "\\").format(
        _ESCAPED.format("s[1:strpos(lower(s), 'the') - 1]"), _ESCAPED.format("s[strpos(lower(s), 'the'):strpos(lower(s), 'the') + 2]"), _ESCAPED.format("s[strpos(lower(s), 'the') + 3:]"), _ESCAPED.format("s")
    ),
    views="d",
)
def reply_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ["", "RE: ", "Fwd: ", "ответ :"])), (F.col("id") % 4 + 1).cast("int"))
    rows = V.messages_doc(spark, sf_dir).select("id", F.concat(lead, "subject").alias("s"))
    return rows.select("id", T.reply_subject(F.col("s")).alias("reply"), T.forward_subject(F.col("s")).alias("forward"), T.highlight(F.col("s"), "THE").alias("marked"))


_HEAD = r"(?i)^(?:On|В|Le|Am)\s.{4,160}(?:wrote|написал|написала|написал\(а\)|a écrit|schrieb):?\s*$"
_DIVIDER = r"(?i)^-{2,}\s*(?:Original Message|Исходное сообщение|Пересылаемое сообщение)"


def quotes_sql(text: str) -> str:
    """SQL of (id, body, quoted) of an expression over view d."""
    return rf"""SELECT id, regexp_replace(array_to_string(CASE WHEN cut > 1 THEN l[1:cut - 1] ELSE l END, chr(10)), '\n+\z', '') AS body,
          CASE WHEN cut > 1 THEN array_to_string(list_transform(l[cut:], lambda x: regexp_replace(x, '^\s*>\s?', '')), chr(10)) END AS quoted
        FROM (SELECT id, l, list_min(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches({_trim("l[i]")}, '{_HEAD}') OR regexp_matches({_trim("l[i]")}, '{_DIVIDER}') OR (i > own AND regexp_matches(l[i], '^\s*>')) THEN i END)) AS cut
          FROM (SELECT id, l, coalesce(list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN NOT regexp_matches(l[i], '^\s*(?:>|$)') THEN i END)), 0) AS own
            FROM (SELECT id, string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM d)))"""


_ENDED = "text || ['', chr(10) || '> a' || chr(10) || '>b' || chr(10) || chr(10) || '> c', chr(10) || '-- Original Message --' || chr(10) || 'old', chr(10) || 'On Monday, Ann wrote:' || chr(10) || '> x' || chr(10) || 'y'][id % 4 + 1]"
ENDINGS = ("", "\n> a\n>b\n\n> c", "\n-- Original Message --\nold", "\nOn Monday, Ann wrote:\n> x\ny")


@query(sql=quotes_sql(_ENDED), views="d")
def plain_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended(spark, sf_dir).select("id", T.plain_parts(F.col("t")).alias("p")).select("id", "p.body", "p.quoted")


def ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, most of them with quoted history at their end."""
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("id") % 4 + 1).cast("int"))
    return V.messages_doc(spark, sf_dir, wide=True).select("id", F.concat("text", end).alias("t"))


@query()
def folded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = mime.html_function(mime.fold_html)
    body = F.concat("html", F.lit('<blockquote type="cite">old</blockquote>'))
    return V.bodies_html(spark, sf_dir).select("page_id", fold(body).alias("html"))


@query(
    sql=r"""SELECT doc_id AS id, ['base64', '8bit', 'Quoted-Printable', 'BASE64', 'binary'][doc_id % 5 + 1] AS encoding,
        CASE WHEN doc_id % 5 = 1 THEN regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') ELSE text END AS decoded FROM documents"""
)
def decoded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as parts of five kinds: cut base64, Latin bytes, quoted bytes, base64 of another charset, and bytes as they are."""
    narrow = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
    kinds = [
        ("base64", "utf-8", F.encode(F.concat(F.base64(F.encode("text", "UTF-8")), F.lit("0")), "UTF-8")),
        ("8bit", "ISO-8859-1", F.encode(narrow, "ISO-8859-1")),
        ("Quoted-Printable", "UTF-8", F.encode(F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "=$1"), "UTF-8")),
        ("BASE64", "utf-16le", F.encode(F.base64(F.encode("text", "UTF-16LE")), "UTF-8")),
        ("binary", None, F.encode("text", "UTF-8")),
    ]
    sent = F.lit(None).cast("struct<encoding:string,charset:string,raw:binary>")
    for i, (encoding, charset, raw) in enumerate(kinds):
        sent = F.when(F.col("doc_id") % len(kinds) == i, F.struct(F.lit(encoding).alias("encoding"), F.lit(charset).alias("charset"), raw.alias("raw"))).otherwise(sent)
    rows = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sent.alias("s")).select("id", "s.*")
    return rows.select("id", "encoding", mime.decode_part(F.col("raw"), F.col("encoding"), F.col("charset"), F.col("encoding") == "binary").alias("decoded"))


@query(
    sql="""SELECT message_id, min(CASE WHEN filename LIKE '%.txt' THEN index END) IS NOT NULL AS has_text, bool_or(NOT inline AND filename NOT LIKE '%.txt') AS has_files FROM a GROUP BY message_id""",
    views="a",
)
def mime_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.attachments_rel(spark, sf_dir)
    text = F.col("filename").endswith(".txt")
    parts = files.select("message_id", F.col("index").alias("ord"), F.col("index").cast("string").alias("part"), F.when(text, "text/plain").otherwise("application/x").alias("type"), F.when(~F.col("inline") & ~text, "attachment").alias("disposition"), F.lit(None).cast("string").alias("filename"))
    first = mime.text_part(parts, "message_id").select("message_id", F.lit(True).alias("has_text"))
    return mime.attached(parts, "message_id").join(first, "message_id", "left").select("message_id", F.coalesce("has_text", F.lit(False)).alias("has_text"), F.col("has_attachments").alias("has_files"))


@query(
    sql="""SELECT event_id AS id, event_type AS event, '{"value": ' || event_id || '}' AS data FROM events WHERE event_type <> 'error'"""
)
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = T.sse_frame(F.col("event_type"), F.when(F.col("event_type") == "error", "{bad").otherwise(F.concat(F.lit('{"value": '), F.col("event_id").cast("string"), F.lit("}"))))
    body = F.concat(F.lit(": ping\n\n"), frame)
    return frames.event_frames(V.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), body.alias("body")), "body").select("id", "event", "data")


@query(sql="SELECT doc_id AS id, ['image/png', 'image/jpeg', 'image/webp', NULL][doc_id % 4 + 1] AS media_type, CASE WHEN doc_id % 4 < 3 THEN octet_length(encode(text)) END AS n_bytes FROM documents")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the content of an image, or of what isn't one and is refused; lines of the code are broken."""
    kind = F.element_at(F.array(*map(F.lit, ["image/png", "image/jpeg", "image/webp", "text/plain"])), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(F.encode("text", "UTF-8")), F.lit("\n"))
    rows = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), frames.data_url(url).alias("u"))
    return rows.select("id", "u.media_type", F.octet_length("u.content").cast("long").alias("n_bytes"))


@query()
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.placed(layout.wrapped(V.messages_doc(spark, sf_dir, wide=True).select("id", "text"), "id", "text", 60), 25)


#: Widths of characters in sixty-fourths of a unit; all others are 36 wide.
WIDTHS = {**dict.fromkeys("iIjlt.,;:'!|", 18), **dict.fromkeys("mwMW@—", 54), " ": 16}


@query()
def wrap_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by measured widths, and how far each has come."""
    lines = layout.wrapped(V.messages_doc(spark, sf_dir, wide=True).select("id", "text"), "id", "text", 2_400, WIDTHS, 36)
    return layout.placed(lines.withColumn("advance", layout.measured(F.col("line"), WIDTHS, 36)), 25)


@query(
    sql="""WITH RECURSIVE p AS (SELECT user_id, event_id, value / 500.0 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        e AS (SELECT user_id, event_id, n, v FROM p WHERE n = 1 UNION ALL SELECT p.user_id, p.event_id, p.n, e.v + (p.v - e.v) * 0.35 FROM e JOIN p ON p.user_id = e.user_id AND p.n = e.n + 1)
        SELECT event_id, v AS eased FROM e"""
)
def smooth_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 500.0).alias("p"))
    return layout.eased(points, ["user_id"], ["ts", "event_id"]).select("event_id", "eased")


@query(
    sql="""SELECT event_id, round((a + b) / 2, 6) AS from_x, round((b + value) / 2, 6) AS to_x FROM (SELECT *, lag(value, 1) OVER w AS b, lag(value, 2) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
)
def smooth_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.smoothed(V.strokes(spark, sf_dir), ["pointer_id"], ["ts", "event_id"])
    return rows.select("event_id", F.round("from_x", 6).alias("from_x"), F.round("to_x", 6).alias("to_x"))


@query(
    sql="""WITH RECURSIVE p AS (SELECT user_id, event_id, value / 100 AS x, CAST(event_id % 3 / 10 AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        k AS (SELECT user_id, event_id, n, x AS kx, y AS ky, true AS far FROM p WHERE n = 1 UNION ALL
          SELECT p.user_id, p.event_id, p.n, CASE WHEN f THEN p.x ELSE kx END, CASE WHEN f THEN p.y ELSE ky END, f FROM k JOIN p ON p.user_id = k.user_id AND p.n = k.n + 1,
            LATERAL (SELECT (p.x - kx) * (p.x - kx) + (p.y - ky) * (p.y - ky) >= 0.35 AS f))
        SELECT event_id, user_id AS pointer_id FROM k WHERE far"""
)
def steady_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.strokes(spark, sf_dir).select("event_id", "pointer_id", "ts", (F.col("x") / 100).alias("x"), (F.col("event_id") % 3 / 10).cast("double").alias("y"))
    return layout.steady(points, ["pointer_id"], ["ts", "event_id"]).select("event_id", "pointer_id")
