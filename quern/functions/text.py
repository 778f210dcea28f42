"""Text functions over columns: subjects, entities, HTML, snippets, recipients, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All blanks, the no-break space included, as a class body.
BLANK = r"\s\x{A0}\x{FEFF}"
# Reply and forward prefixes, and the tags that mark mail from outside.
PREFIXES = ("re", "fw", "fwd", "aw", "wg", "sv", "vs", "ответ", "отв", "пересл")
OUTSIDE = ("ext", "external")
# Named entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
# The words around a quoted reply.
QUOTE_LEADS, QUOTE_VERBS = ("On", "В", "Le", "Am"), ("wrote", "написал", "a écrit", "schrieb")
# Patterns whose form is their meaning.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
LINK = r"(https?://[^\s<]+[^\s<.,;:!?)\]])"
LINK_IN_MAIL = r"(https?://[^\s<]+[^\s<.,;:!?)\]'\"])"
MAIL_IN_TEXT = r"(^|[\s(])([\w.+-]+@[\w-]+\.[\w.-]+)"
REMOTE = r"""(?i)<img[^>]+src\s*=\s*["']?\s*(?:https?:)?//|url\(\s*["']?\s*(?:https?:)?//|\sbackground\s*=\s*["']?\s*https?:"""
DESIGNED, COLOR = r"(?i)<table|bgcolor|background(?:-color)?\s*:|<style", r"(?i)color\s*:"
REFRESH, BASE, SCRIPT = r"(?i)<meta[^>]+http-equiv\s*=\s*[\"']?refresh[^>]*>", r"(?i)<base[^>]*>", r"(?is)<script.*?</script>"
ATTACHMENT_WORDS = r"(?iu)прикреп|влож|attach|во вложении"
QUOTE_HEAD = r"(?:On|В|Le|Am)\s.{4,160}(?:wrote|написал|написала|написал\(а\)|a écrit|schrieb):?"
QUOTE_DIVIDER = r"-{2,}\s*(?:Original Message|Исходное сообщение|Пересылаемое сообщение)"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` is evaluated for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def collapse(s: Column) -> Column:
    return F.regexp_replace(s, rf"[{BLANK}]+", " ")


def strip_subject(s: Column) -> Column:
    """The subject without any run of reply prefixes and outside tags, with single blanks."""
    lead = rf"[{BLANK}]*(?:(?:{'|'.join(PREFIXES)})(?:\[\d+\])?[{BLANK}]*:|\[(?:{'|'.join(OUTSIDE)})\])"
    return collapse(trim_all(F.regexp_replace(F.coalesce(s, F.lit("")), rf"(?iu)\A(?:{lead}[{BLANK}]*)+", "")))


def thread_subject(s: Column) -> Column:
    return F.lower(strip_subject(s))


def code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_entities(s: Column) -> Column:
    """Named and numbered references, each read once; what isn't known stays."""
    pieces = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"(?s)(&(?:#[xX][0-9a-fA-F]+|#\d+|[a-zA-Z]+);|[^&]+|&)"), 1)

    def one(p: Column) -> Column:
        body = F.substring(p, 2, 1 << 20)
        name = F.lower(F.regexp_extract(p, r"^&([a-zA-Z]+);$", 1))
        named = F.lit(None).cast("string")
        for k, v in ENTITIES.items():
            named = F.when(name == k, F.lit(v)).otherwise(named)
        digits = F.ltrim(F.regexp_extract(body, r"^#(\d+);", 1), F.lit("0"))
        hexes = F.ltrim(F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]+);", 1), F.lit("0"))
        n = F.when(hexes != "", F.when(F.length(hexes) <= 6, F.conv(hexes, 16, 10))).otherwise(F.when(F.length(digits).between(1, 7), digits)).cast("long")
        numbered = F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), code_point(n))
        return F.when(F.length(p) < 3, p).when(~p.startswith("&"), p).otherwise(F.coalesce(named, numbered, p))

    return F.array_join(F.transform(pieces, one), "")


def html_to_text(html: Column) -> Column:
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head|title)[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|blockquote)>", "\n")
    s = decode_entities(F.regexp_replace(s, r"<[^>]+>", " "))
    s = F.regexp_replace(s, r"[ \t\x{A0}]+", " ")
    return trim_all(F.regexp_replace(s, rf"[{BLANK}]*\n[{BLANK}]*", "\n"))


def escape_html(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def text_to_html(s: Column) -> Column:
    linked = F.regexp_replace(escape_html(s), LINK, '<a href="$1">$1</a>')
    return F.regexp_replace(linked, r"\r?\n", "<br>")


def snippet(s: Column, most: int = 180) -> Column:
    """One line of preview: quoted lines are skipped, a signature or the head of a quoted reply ends it.

    The first characters of a text decide it where they give enough; else the whole text is looked at.
    """
    lead = rf"(?iu)^(?:{'|'.join(QUOTE_LEADS)}) .{{4,120}}(?:{'|'.join(QUOTE_VERBS)})"
    sign = rf"^--[{BLANK}]*$"
    quoted = lambda x: x.rlike(rf"^[{BLANK}]*>")

    def flat(lines: Column) -> Column:
        stops = F.transform(lines, lambda x: (x.rlike(sign) | x.rlike(lead)) & ~quoted(x))
        end = F.coalesce(F.nullif(F.array_position(stops, True), F.lit(0)) - 1, F.size(lines))
        return trim_all(collapse(F.array_join(F.filter(F.slice(lines, F.lit(1), end.cast("int")), lambda x: ~quoted(x)), " ")))

    text = F.coalesce(s, F.lit(""))
    first = F.split(F.substring(text, 1, 8 * most), r"\r?\n")
    # The last line of these may go on: it counts if what is there of it says what kind of line it is.
    told = lambda lines: (F.length(F.element_at(lines, -1)) > most) & ~F.element_at(lines, -1).rlike(sign)
    start = let(first, lambda lines: flat(F.when(told(lines), lines).otherwise(F.slice(lines, F.lit(1), F.size(lines) - 1))))
    enough = F.when(F.length(text) > 8 * most, start)
    cut = lambda f: F.concat(F.regexp_replace(F.substring(f, 1, most - 1), rf"[{BLANK}]+\z", ""), F.lit("…"))
    line = let(enough, lambda f: F.when(F.length(f) > most, f).otherwise(let(F.split(text, r"\r?\n"), flat)))
    return let(line, lambda f: F.when(F.length(f) > most, cut(f)).otherwise(f))


def parse_recipients(s: Column) -> Column:
    """Typed recipients as an array of (name, address); pieces without a valid address go."""
    pieces = F.transform(F.split(F.coalesce(s, F.lit("")), r"[,;\n]"), trim_all)

    def one(p: Column) -> Column:
        named = r"(?s)^(.*?)<([^>]+)>$"
        has = p.rlike(named)
        name = F.regexp_replace(trim_all(F.regexp_extract(p, named, 1)), r'^"|"$', "")
        return F.struct(F.when(has, name).otherwise("").alias("name"), F.when(has, trim_all(F.regexp_extract(p, named, 2))).otherwise(p).alias("address"))

    return F.filter(F.transform(pieces, one), lambda a: a["address"].rlike(EMAIL))


def address_list(groups: Column) -> Column:
    """Nested lists of addresses as one list: those with a name or address, addresses in lower case."""
    kept = F.filter(F.flatten(groups), lambda a: (F.coalesce(a["address"], F.lit("")) != "") | (F.coalesce(a["name"], F.lit("")) != ""))
    return F.transform(kept, lambda a: F.struct(F.coalesce(a["name"], F.lit("")).alias("name"), F.lower(F.coalesce(a["address"], F.lit(""))).alias("address")))


def typed_recipient(s: Column) -> Column:
    bare = F.regexp_replace(trim_all(s), r"[,;]+$", "")
    named = r"^(.*?)<([^>]+)>$"
    name = F.regexp_replace(trim_all(F.regexp_extract(bare, named, 1)), r'^"|"$', "")
    mail = F.when(bare.rlike(named), trim_all(F.regexp_extract(bare, named, 2))).otherwise(bare)
    return F.struct(name.alias("name"), F.lower(mail).alias("address"))


def reply_subject(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.when(s.rlike(r"(?iu)^\s*(?:re|ответ)\s*:"), s).otherwise(F.concat(F.lit("Re: "), s))


def forward_subject(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.when(s.rlike(r"(?iu)^\s*(?:fwd?|пересл)\s*:"), s).otherwise(F.concat(F.lit("Fwd: "), s))


def safe_name(s: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(s, F.lit("")), r'[\r\n"\\]', "_")
    return F.when(clean == "", "file").otherwise(clean)


def display_name(name: Column, mail: Column, nobody: str = "Без имени") -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.substring_index(mail, "@", 1), F.lit("")), F.lit(nobody))


def initials(shown: Column) -> Column:
    parts = F.filter(F.split(trim_all(F.regexp_replace(shown, r"""[«»"'()\[\]]""", "")), rf"[{BLANK}._-]+"), lambda p: p.rlike(r"[\p{L}\d]"))
    firsts = F.transform(F.slice(parts, 1, 2), lambda p: F.regexp_extract(p, r"([\p{L}\d])", 1))
    return F.when(F.size(parts) == 0, "?").otherwise(F.upper(F.array_join(firsts, "")))


def highlight(s: Column, query: str) -> Column:
    """The first hit, whatever its case, in a mark; everything escaped."""
    if not query:
        return escape_html(s)
    at, n = F.locate(query.lower(), F.lower(s)), len(query)
    marked = F.concat(
        escape_html(F.substring(s, F.lit(1), at - 1)), F.lit("<mark>"), escape_html(F.substring(s, at, F.lit(n))), F.lit("</mark>"), escape_html(F.substring(s, at + n, F.length(s)))
    )
    return F.when(at > 0, marked).otherwise(escape_html(s))


def is_remote(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(REMOTE)


def is_designed(html: Column) -> Column:
    html = F.coalesce(html, F.lit(""))
    return html.rlike(DESIGNED) | (F.regexp_count(html, F.lit(COLOR)) > 3)


def clean_html(html: Column) -> Column:
    """Without meta refresh, base and script tags."""
    for pattern in (REFRESH, BASE, SCRIPT):
        html = F.regexp_replace(html, pattern, "")
    return html


def misses_attachment(text: Column, attachments: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(ATTACHMENT_WORDS) & (F.size(attachments) == 0)


def pieces(s: Column, width: int = 14) -> Column:
    """Pieces of at most ``width`` characters that prefer to end after a blank; line ends are dropped."""
    return F.regexp_extract_all(s, F.lit(rf"(.{{1,{width}}}(?:\s|$)|.{{1,{width}}})"), 1)


def quote_start(lines: Column) -> Column:
    """Index from 0 of the first line of quoted history, or -1: a head line, a divider, or only quotes from there on."""
    own = F.transform(lines, lambda x, i: F.when(~x.rlike(r"^\s*(?:>|$)"), i))
    last_own = F.coalesce(F.array_max(own), F.lit(-1))

    # One look at each line: blanks around a head line are part of the pattern, so that no line is trimmed for it.
    head = rf"(?iu)^[{BLANK}]*(?:{QUOTE_HEAD}[{BLANK}]*$|{QUOTE_DIVIDER})"

    def marks(last: Column) -> Column:
        return F.array_min(F.transform(lines, lambda x, i: F.when(x.rlike(head) | ((i > last) & x.rlike(r"^\s*>")), i)))

    at = F.coalesce(let(last_own, marks), F.lit(-1))
    return F.when(at == 0, -1).otherwise(at).cast("int")


def plain_parts(text: Column) -> Column:
    """(body, quoted): a plain message split where quoted history starts; one quote mark goes from each line."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")

    def parts(z: Column) -> Column:
        ls, at = z["lines"], z["at"]
        body = F.when(at > 0, F.slice(ls, F.lit(1), F.greatest(at, F.lit(0)))).otherwise(ls)
        quoted = F.when(at > 0, F.transform(F.slice(ls, at + 1, F.size(ls)), lambda x: F.regexp_replace(x, r"^\s*>\s?", "")))
        return F.struct(F.regexp_replace(F.array_join(body, "\n"), r"\n+\z", "").alias("body"), F.array_join(quoted, "\n").alias("quoted"))

    return let(let(lines, lambda ls: F.struct(ls.alias("lines"), quote_start(ls).alias("at"))), parts)


def mail_html(part: Column) -> Column:
    """A piece of a plain message as HTML: escaped, with links for addresses of the web and of mail."""
    linked = F.regexp_replace(escape_html(part), LINK_IN_MAIL, '<a href="$1">$1</a>')
    return F.regexp_replace(linked, MAIL_IN_TEXT, '$1<a href="mailto:$2">$2</a>')


def plain_to_html(text: Column) -> Column:
    """A plain message as HTML; quoted history is folded away."""

    def whole(p: Column) -> Column:
        body = F.concat(F.lit('<div class="plain">'), mail_html(p["body"]), F.lit("</div>"))
        fold = F.concat(F.lit('<details class="aq"><summary title="Показать цитату">•••</summary><div class="plain quoted">'), mail_html(p["quoted"]), F.lit("</div></details>"))
        return F.when(p["quoted"].isNull(), body).otherwise(F.concat(body, fold))

    return let(plain_parts(text), whole)


def shown_body(plain: Column, text: Column, html: Column) -> Column:
    """(body, remote, themed): the plain text as HTML where there is no other, and what the frame must know of it."""
    as_plain = F.coalesce(plain, F.lit(False)) | (F.coalesce(html, F.lit("")) == "")
    body = F.when(as_plain, plain_to_html(text)).otherwise(html)
    return F.struct(body.alias("body"), (~as_plain & is_remote(html)).alias("remote"), (as_plain | ~is_designed(html)).alias("themed"))


def person_line(p: Column) -> Column:
    name = F.coalesce(p["name"], F.lit(""))
    return F.when(name != "", F.concat(name, F.lit(" <"), p["address"], F.lit(">"))).otherwise(p["address"])


def breaks(text: Column) -> Column:
    return F.replace(escape_html(text), F.lit("\n"), F.lit("<br>"))


def quote_block(sender: Column, when: Column, text: Column) -> Column:
    """What a reply holds of its original; ``when`` is the shown date."""
    return F.concat(F.lit('<div class="attrib"><br>'), escape_html(when), F.lit(", "), escape_html(person_line(sender)), F.lit(' пишет:</div><blockquote type="cite">'), breaks(text), F.lit("</blockquote>"))


def forward_block(sender: Column, when: Column, subject: Column, to: Column, cc: Column, text: Column) -> Column:
    """What a forwarded message holds of its original; empty rows go."""

    def row(label: str, value: Column) -> Column:
        value = F.coalesce(value, F.lit(""))
        return F.when(value == "", "").otherwise(F.concat(F.lit(f"<b>{label}:</b> "), escape_html(value), F.lit("<br>")))

    listed = lambda people: F.array_join(F.transform(people, person_line), ", ")
    return F.concat(
        F.lit('<div class="fwd"><br>---------- Пересланное сообщение ----------<br>'), row("От", person_line(sender)), row("Дата", when), row("Тема", subject),
        row("Кому", listed(to)), row("Копия", listed(cc)), F.lit("<br>"), breaks(text), F.lit("</div>"),
    )


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
