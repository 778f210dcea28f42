"""Raw mail, MIME parts and HTML trees: what column functions can't express."""

from __future__ import annotations

import base64
import quopri
import re
from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches

PARSED = (
    "subject string, sender struct<name:string,address:string>, to array<struct<name:string,address:string>>, cc array<struct<name:string,address:string>>, "
    "message_id string, in_reply_to string, refs array<string>, date string, text string, html string, "
    "attachments array<struct<index:int,filename:string,content_type:string,size:long,cid:string,inline:boolean>>"
)


def decode_bytes(raw: bytes | None, encoding: str | None, charset: str | None, binary: bool = False) -> str:
    """Transfer decoding, then the charset; a cut base64 text loses its last, partial group."""
    raw = raw or b""
    kind = (encoding or "7bit").lower()
    if not binary and kind == "base64":
        clean = re.sub(rb"[^A-Za-z0-9+/=]", b"", raw)
        raw = base64.b64decode(clean[: len(clean) // 4 * 4])
    elif not binary and kind == "quoted-printable":
        raw = quopri.decodestring(raw)
    try:
        return raw.decode((charset or "utf-8").lower(), "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def decode_part(raw: Column, encoding: Column, charset: Column, binary: Column) -> Column:
    small_batches(SparkSession.active())

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([decode_bytes(*x) for x in zip(a, b, c, d)], dtype=object)

    return run(raw, encoding, charset, binary)


def _shown(value) -> str:
    """A header's value on one line, with encoded words read."""
    return str(make_header(decode_header(re.sub(r"[\r\n]+", "", str(value)))))


def _people(message: Message, name: str) -> list[dict]:
    values = [re.sub(r"[\r\n]+", "", str(x)) for x in message.get_all(name, [])]
    return [{"name": _shown(n), "address": a.lower()} for n, a in getaddresses(values) if n or a]


def _text(part: Message) -> str:
    return decode_bytes(part.get_payload(decode=True), None, part.get_content_charset() or "ascii")


def parse_message(raw: bytes | None) -> dict:
    m = message_from_bytes(raw or b"")
    files, text, html = [], None, None
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, place = part.get_content_type(), part.get_content_disposition()
        if place != "attachment" and kind == "text/plain" and text is None:
            text = _text(part)
        elif place != "attachment" and kind == "text/html" and html is None:
            html = _text(part)
        elif place or part.get_filename():
            body = part.get_payload(decode=True) or b""
            name = part.get_filename()
            files.append({"index": len(files), "filename": name and _shown(name), "content_type": kind, "size": len(body), "cid": str(part["content-id"] or "").strip("<> ") or None, "inline": place == "inline"})
    lone = lambda name: _shown(m[name]).strip() if m[name] else None
    return {
        "subject": lone("subject"), "sender": (_people(m, "from") or [None])[0], "to": _people(m, "to"), "cc": _people(m, "cc"), "message_id": lone("message-id"),
        "in_reply_to": lone("in-reply-to"), "refs": (lone("references") or "").split(), "date": lone("date"), "text": text, "html": html, "attachments": files,
    }


def parsed_messages(df: DataFrame, raw: str) -> DataFrame:
    """Raw RFC 822 bytes with the parsed message as columns."""
    small_batches(df.sparkSession)

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_message(x) for x in batch], columns=[c.split()[0] for c in re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", PARSED).split(", ")])

    return df.withColumn("__m", run(F.col(raw))).select(*df.columns, "__m.*")


PART = "part string, ord int, type string, disposition string, filename string, body binary, encoding string, charset string, binary boolean"


def numbered_parts(message: Message) -> list[dict]:
    """The leaves of a message's tree with their numbers: a.b for the b-th child of part a, and 1 for a lone part."""
    leaves: list[dict] = []
    todo = [(message, "")]
    while todo:
        node, number = todo.pop()
        children = node.get_payload() if node.is_multipart() else []
        if children:
            todo += [(c, f"{number}.{k}" if number else str(k)) for k, c in reversed([*enumerate(children, 1)])]
            continue
        body = node.get_payload() if not node.is_multipart() else ""
        encoding = str(node["content-transfer-encoding"] or "7bit").lower()
        leaves.append({
            "part": number or "1", "ord": len(leaves), "type": node.get_content_type(), "disposition": node.get_content_disposition(), "filename": node.get_filename(),
            "body": body.encode("utf-8", "surrogateescape"), "encoding": encoding, "charset": node.get_content_charset(), "binary": encoding == "binary",
        })
    return leaves


def part_arrays(df: DataFrame, raw: str, out: str = "parts", bodies: bool = True) -> DataFrame:
    """``df`` with the leaves of each raw message's MIME tree in order, as one array.

    Without ``bodies`` the tree alone leaves the Python worker, which is all that numbers and types need.
    The function is called nondeterministic, though it isn't, for Spark copies any other below a join or under a filter on the tree
    or its explosion; each mail would then be parsed twice, by two workers for each task.
    """
    small_batches(df.sparkSession)
    kind = PART if bodies else PART.replace("body binary, ", "")

    @F.pandas_udf(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: [p if bodies else {k: v for k, v in p.items() if k != "body"} for p in numbered_parts(message_from_bytes(x or b""))])

    return df.withColumn(out, run.asNondeterministic()(F.col(raw)))


def message_parts(df: DataFrame, key: str, raw: str, bodies: bool = True) -> DataFrame:
    """One row for each leaf of a raw message's MIME tree: key, its number, place, type, disposition, name and body as sent."""
    return part_arrays(df, raw, "__parts", bodies).select(key, F.explode("__parts").alias("p")).select(key, "p.*")


def _is_text(part: Column) -> Column:
    return F.lower(part["type"]).startswith("text/") & (F.coalesce(part["disposition"], F.lit("")) != "attachment")


def _is_file(part: Column) -> Column:
    named = (F.coalesce(part["filename"], F.lit("")) != "") & ~F.lower(part["type"]).startswith("text/")
    return (F.coalesce(part["disposition"], F.lit("")) == "attachment") | named


def shown_part(parts: Column) -> Column:
    """The leaf to preview of an array of leaves: the first text that isn't an attachment."""
    return F.get(F.filter(parts, _is_text), F.lit(0))


def previewed(df: DataFrame, raw: str, most: int = 3000) -> DataFrame:
    """``df`` with part, type, has_attachments and preview of each raw message, from its own tree and without a shuffle."""
    trees = part_arrays(df, raw, "__parts").withColumns({"__first": shown_part(F.col("__parts")), "has_attachments": F.exists("__parts", _is_file)})
    first = F.col("__first")
    preview = decode_part(F.substring(first["body"], 1, most), first["encoding"], first["charset"], first["binary"])
    shown = trees.withColumns({"part": first["part"], "type": first["type"], "preview": F.when(first.isNotNull(), preview)})
    return shown.drop("__parts", "__first")


def previews(parts: DataFrame, key: str, most: int = 3000) -> DataFrame:
    """The decoded start of each message's text part: key, part, type, preview; only its first bytes are looked at."""
    first = text_part(parts, key).select(F.col(key).alias("__k"), F.col("part").alias("__p"))
    mine = parts.join(first, (F.col(key) == F.col("__k")) & (F.col("part") == F.col("__p"))).drop("__k", "__p")
    return mine.select(key, "part", "type", decode_part(F.substring("body", 1, most), F.col("encoding"), F.col("charset"), F.col("binary")).alias("preview"))


def text_part(parts: DataFrame, key: str) -> DataFrame:
    """The part to preview of each message: its first text leaf in order that isn't an attachment.

    ``parts`` has one row for each leaf: key, ord, part, type, disposition, filename.
    """
    texts = parts.filter(_is_text({c: F.col(c) for c in ("type", "disposition")}))
    return texts.groupBy(key).agg(F.min_by("part", "ord").alias("part"), F.min_by("type", "ord").alias("type"))


def attached(parts: DataFrame, key: str) -> DataFrame:
    """Whether a message has an attachment: a leaf that says so, or a named leaf that isn't text."""
    return parts.groupBy(key).agg(F.bool_or(_is_file({c: F.col(c) for c in ("type", "disposition", "filename")})).alias("has_attachments"))


class _Fold(HTMLParser):
    """Copies HTML and wraps the outermost quoted blocks in a fold."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.depth, self.stack, self.rest = [], 0, [], False
        self.before: list[str] | None = []

    def _quote(self, tag: str, attrs: dict) -> str:
        kinds = (attrs.get("class") or "").split()
        if attrs.get("id") in ("divRplyFwdMsg", "appendonsend"):
            return "rest"
        if {"gmail_quote", "yahoo_quoted", "moz-cite-prefix"} & set(kinds) or (tag == "blockquote" and attrs.get("type") == "cite"):
            return "block"
        return ""

    def handle_starttag(self, tag, attrs):
        kind = "" if any(k for _, k in self.stack) else self._quote(tag, dict(attrs))
        if kind:
            self.out.append("<details>")
        self.out.append(self.get_starttag_text())
        if tag not in self.VOID:
            self.stack.append((tag, kind))
        elif kind:
            self.out.append("</details>")

    def handle_startendtag(self, tag, attrs):
        self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        while self.stack:
            name, kind = self.stack[-1]
            if kind == "rest" and name == tag:
                self.stack[-1] = ("", "following")
                self.out.append(f"</{tag}>")
                return
            self.stack.pop()
            if kind == "following":
                self.out.append("</details>")
                continue
            self.out.append(f"</{name}>")
            if kind:
                self.out.append("</details>")
            if name == tag:
                return

    def handle_data(self, data):
        self.out.append(data)

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")

    def result(self) -> str:
        self.close()
        while self.stack:
            name, kind = self.stack.pop()
            self.out.append("</details>" if kind == "following" else f"</{name}>" + ("</details>" if kind else ""))
        return "".join(self.out)


def fold_html(html: str | None) -> str:
    """HTML with its outermost quoted history in ``details``; a reply marker takes what follows it along."""
    p = _Fold()
    p.feed(html or "")
    return p.result()


class _Lead(HTMLParser):
    """The text in front of a signature or quote."""

    def __init__(self):
        super().__init__()
        self.parts, self.depth, self.over = [], 0, False

    def handle_starttag(self, tag, attrs):
        kinds = set((dict(attrs).get("class") or "").split())
        if self.depth == 0 and (tag == "blockquote" or kinds & {"sig", "attrib", "fwd"}):
            self.over = True
        if self.depth == 0 and not self.over:
            self.parts.append("")
        self.depth += tag not in _Fold.VOID

    def handle_endtag(self, tag):
        self.depth -= tag not in _Fold.VOID

    def handle_data(self, data):
        if not self.over:
            if self.depth == 0 or not self.parts:
                self.parts.append("")
            self.parts[-1] += data


def lead_of(html: str | None) -> str:
    p = _Lead()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts).replace("\xa0", " ")


def html_function(fn) -> object:
    """A column function from a function of one text."""
    small_batches(SparkSession.active())

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(fn)

    return run


def inline_images(bodies: DataFrame, attachments: DataFrame, link: str = "/attachment/{}/{}") -> DataFrame:
    """cid references of each body replaced by the attachment of that id; unknown ones stay.

    ``bodies`` has id and html, ``attachments`` message_id, index and cid.
    """
    known = attachments.filter("cid is not null and cid <> ''").groupBy("message_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.lower(F.regexp_replace("cid", "^<|>$", "")), F.col("index")))).alias("cids")
    )
    joined = bodies.join(known, bodies["id"] == known["message_id"], "left").drop("message_id")
    pieces = F.regexp_extract_all("html", F.lit(r"(?is)(cid:[^\"'\s)>]+|(?:(?!cid:).)+|.)"), 1)
    a, b, c = link.split("{}")

    def one(p: Column) -> Column:
        at = F.element_at("cids", F.lower(F.try_url_decode(F.substring(p, 5, 1 << 20))))
        return F.when(F.lower(p).startswith("cid:") & at.isNotNull(), F.concat(F.lit(a), F.col("id").cast("string"), F.lit(b), at.cast("string"), F.lit(c))).otherwise(p)

    return joined.withColumn("html", F.when(F.col("cids").isNull(), F.col("html")).otherwise(F.array_join(F.transform(pieces, one), ""))).drop("cids")
