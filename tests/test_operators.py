"""Mailbox, people, changes, layout and sources on small tables."""

import pytest
from pyspark.sql import functions as F

from quern.operators import changes, layout, mailbox, people
from quern.sources import frames, mime, views

SCHEMA = "id long, folder string, thread_key string, date string, seen boolean, flagged boolean, answered boolean, seq long, message_id string, in_reply_to string, subject string"
ROWS = [
    (1, "inbox", "a", "2024-01-01", False, False, False, 1, "m1", None, "S"),
    (2, "inbox", "a", "2024-01-02", True, True, False, 2, "m2", None, "S"),
    (3, "trash", "a", "2024-01-03", True, True, False, 3, "m3", None, "S"),
    (4, "work", None, "2024-01-02", False, True, False, 4, "m4", None, "S"),
]


@pytest.fixture(scope="module")
def box(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("date", F.col("date").cast("timestamp"))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_folders(box, spark):
    assert sorted(ids(mailbox.in_folder(box, "flagged"))) == [2, 4]
    counts = {r["id"]: (r["total"], r["unread"]) for r in mailbox.folder_counts(box, views.folders(spark)).collect()}
    assert counts["inbox"] == (2, 1) and counts["flagged"] == (2, 1) and counts["sent"] == (0, 0)


def test_pages_join_to_the_list(box):
    everything = ids(mailbox.page(box, 0, 100))
    assert everything == [3, 2, 4, 1]
    assert sum((ids(mailbox.page(box, o, 2)) for o in (0, 2)), []) == everything
    first, second = mailbox.page_with_total(box, 0, 2).first(), mailbox.page_with_total(box, 2, 2).first()
    assert (first["total"], first["next"], second["next"]) == (4, 2, None)
    assert ids(mailbox.arrival_page(box, 0, 2)) == [3, 4]


@pytest.mark.parametrize("given, out", [((None, None), (0, 50)), (("-3", 0), (0, 50)), ((5, 1000), (5, 100)), (("x", "nan"), (0, 50)), ((1, -4), (1, 1))])
def test_clamp(given, out):
    assert mailbox.clamp(*given)[:2] == out


def test_search(box):
    fields = [F.col("subject"), F.col("folder")]
    assert sorted(ids(mailbox.searched(box, fields, "s IN"))) == [1, 2]
    assert ids(mailbox.searched(box, fields, "100%")) == []
    assert 3 in ids(mailbox.searched(box, fields, "s", "trash"))


def test_threads(box):
    assert ids(mailbox.thread(box, 1)) == [1, 2]
    assert ids(mailbox.thread(box, 1, last=1)) == [2]
    rows = {r["thread"]: r for r in mailbox.conversations(box).collect()}
    assert rows["a"]["latest_id"] == 3 and rows["a"]["n"] == 3 and rows["work:4"]["n"] == 1


def test_changes(box, spark):
    some = spark.createDataFrame([(1,), (99,)], "id long")
    flagged = {r["id"]: (r["seen"], r["flagged"]) for r in changes.set_flags(box, some, ("seen",)).collect()}
    assert flagged[1] == (True, False) and flagged[4] == (False, True)
    with pytest.raises(ValueError):
        changes.set_flags(box, some, ("constructor",))
    assert {r["id"]: r["folder"] for r in changes.move(box, some, views.folders(spark), "archive").collect()}[1] == "archive"
    assert {r["id"]: r["folder"] for r in changes.move(box, some, views.folders(spark), "flagged").collect()}[1] == "inbox"
    assert sorted(ids(changes.destroy(box, some))) == [2, 3, 4]


def test_send(box, spark):
    mail = spark.createDataFrame([(9, "x", None, "2024-02-01", False, False, False, 9, "m9", "m1", " ")], SCHEMA).withColumn("date", F.col("date").cast("timestamp"))
    out = {r["id"]: r for r in changes.send(box, mail).collect()}
    assert out[9]["folder"] == "sent" and out[9]["thread_key"] == "a" and out[9]["subject"] == "(без темы)"
    assert out[1]["answered"] and not out[2]["answered"]


def test_contacts(spark):
    rows = [("Ann", "A@x.io", 1, 1), ("", "a@x.io", 3, 2), ("Bob", "bob@x.io", 2, 3), ("N", "no-reply@x.io", 9, 4), (None, None, 1, 5)]
    scores = people.contact_scores(spark.createDataFrame(rows, "name string, address string, weight long, seq long"))
    got = {r["address"]: (r["name"], r["score"]) for r in scores.collect()}
    assert got == {"a@x.io": ("Ann", 4), "bob@x.io": ("Bob", 2)}
    assert [r["address"] for r in people.suggest(scores, "x.io").collect()] == ["a@x.io", "bob@x.io"]
    assert [r["address"] for r in people.suggest(scores, "x.io", ("a@x.io",)).collect()] == ["bob@x.io"]


def test_blind_copies_stay_in_the_envelope(spark):
    mail = spark.sql("select array(named_struct('name','','address','a')) to, array(named_struct('name','','address','b')) cc, array(named_struct('name','','address','c')) bcc")
    out = people.without_bcc(mail).first()
    assert out["envelope"] == ["a", "b", "c"] and "bcc" not in out.asDict()


@pytest.mark.parametrize("text, width, lines", [
    ("one two three", 7, ["one two", "three"]), ("abcdefghij", 4, ["abcd", "efgh", "ij"]), ("a\n\n\n\nb", 9, ["a", "", "b"]), ("", 5, []), ("a b", 9, ["a b"]),
])
def test_wrap(text, width, lines):
    got = layout.wrap(text, width)
    assert [x.rstrip() for x in got] == lines and all(len(x.rstrip()) <= width for x in got)


def test_strokes(spark):
    points = spark.createDataFrame([(1, i, float(x), 0.0, float(p)) for i, (x, p) in enumerate([(0, 1), (0.1, 3), (1, 2), (1.2, 2)])], "s long, i long, x double, y double, p double")
    assert sorted(ids(layout.steady(points, ["s"], ["i"]).withColumnRenamed("i", "id"))) == [0, 2]
    eased = [r["eased"] for r in layout.eased(points, ["s"], ["i"]).orderBy("i").collect()]
    assert eased[:3] == pytest.approx([1, 1.7, 1.805])
    assert layout.bounds(points, ["s"], 3.0).first()["left"] == pytest.approx(-3.5)


@pytest.mark.parametrize("raw, encoding, charset, binary, out", [
    (b"0J/RgNC40LLQtdGC", "base64", "utf-8", False, "Привет"), (b"0J/RgNC40LLQtdGC0", "base64", None, False, "Привет"),
    (b"caf=C3=A9 =\r\nok", "quoted-printable", "utf-8", False, "café ok"), (b"\xcf\xf0\xe8", None, "windows-1251", False, "При"),
    (b"already", "base64", "utf-8", True, "already"), (None, None, None, False, ""), (b"x", "7bit", "no-such", False, "x"),
])
def test_decode(raw, encoding, charset, binary, out):
    assert mime.decode_bytes(raw, encoding, charset, binary) == out


def test_parts(spark):
    rows = [("m", 0, "1.1", "text/plain", None, None), ("m", 1, "1.2", "text/html", None, None), ("m", 2, "2", "application/pdf", "attachment", "x.pdf"), ("n", 0, "1", "text/html", None, None)]
    parts = spark.createDataFrame(rows, "id string, ord int, part string, type string, disposition string, filename string")
    assert {r["id"]: r["part"] for r in mime.text_part(parts, "id").collect()} == {"m": "1.1", "n": "1"}
    assert {r["id"]: r["has_attachments"] for r in mime.attached(parts, "id").collect()} == {"m": True, "n": False}


def test_raw_mail(spark):
    raw = b"From: Ann <A@x.io>\r\nTo: b@y.io, c@z.io\r\nSubject: Hi\r\nMessage-ID: <1@x>\r\nReferences: <0@x> <00@x>\r\nContent-Type: text/plain\r\n\r\nbody\r\n"
    got = mime.parsed_messages(spark.createDataFrame([(bytearray(raw),)], "raw binary"), "raw").first()
    assert got["subject"] == "Hi" and got["sender"]["address"] == "a@x.io" and len(got["to"]) == 2 and got["refs"] == ["<0@x>", "<00@x>"] and got["text"].strip() == "body"


def test_raw_mail_in_other_charsets():
    head = "From: =?utf-8?B?0JDQvdC90LA=?= <A@x.ru>\r\nTo: b@x.org,\r\n \"C, D\" <c@x.org>\r\nSubject: =?utf-8?Q?caf=C3=A9?=\r\n =?utf-8?Q?_ok?=\r\nContent-Type: text/plain; charset={}\r\n\r\n"
    got = mime.parse_message(head.format("windows-1251").encode() + "При".encode("cp1251"))
    assert got["sender"] == {"name": "Анна", "address": "a@x.ru"} and got["subject"] == "café ok" and got["text"] == "При"
    assert [p["name"] for p in got["to"]] == ["", "C, D"]
    assert mime.parse_message(head.format("no-such-charset").encode() + "caf\u00e9".encode())["text"] == "café" and mime.parse_message(None)["subject"] is None


def test_html_trees():
    assert mime.fold_html('a<blockquote type="cite">x<div class="gmail_quote">y</div></blockquote>b') == 'a<details><blockquote type="cite">x<div class="gmail_quote">y</div></blockquote></details>b'
    assert mime.fold_html('<div>a<div id="appendonsend"></div>rest<p>x</p></div>') == '<div>a<details><div id="appendonsend"></div>rest<p>x</p></details></div>'
    assert mime.lead_of('Hello <b>you</b><div class="sig">--</div>after') == "Hello \nyou"


def test_inline_images(spark):
    bodies = spark.createDataFrame([(1, '<img src="cid:A%40b"> cid:zz'), (2, "cid:q")], "id long, html string")
    files = spark.createDataFrame([(1, 3, "<a@B>")], "message_id long, index int, cid string")
    got = {r["id"]: r["html"] for r in mime.inline_images(bodies, files).collect()}
    assert got == {1: '<img src="/attachment/1/3"> cid:zz', 2: "cid:q"}


def test_frames(spark):
    body = ': ping\n\nevent: ink\ndata: {"a": 1}\n\ndata: {bad\n\ndata: 5\n\n'
    got = [(r["event"], r["data"]) for r in frames.event_frames(spark.createDataFrame([(body,)], "b string"), "b").collect()]
    assert got == [("ink", '{"a": 1}'), ("message", "5")]
    url = spark.createDataFrame([("data:image/png;base64,aGk=",), ("data:text/plain;base64,aGk=",)], "u string").select(frames.data_url(F.col("u")).alias("x")).collect()
    assert bytes(url[0]["x"]["content"]) == b"hi" and url[1]["x"] is None
    lines = spark.createDataFrame([("# c",), ("A=1",), ("B = 'x=y' ",), ("",), ("=z",)], "line string")
    assert [tuple(r) for r in frames.settings_lines(lines, "line").collect()] == [("A", "1"), ("B", "x=y")]


def test_accounts(spark):
    presets = spark.createDataFrame([("mailco", "imap.mail.co", "smtp.mail.co", 587)], "provider string, imap string, smtp string, smtp_port int")
    schema = "provider string, imap_user string, mail_user string, imap_pass string, mail_pass string, imap_host string, imap_port int, smtp_host string, smtp_port int, imap_secure boolean, smtp_secure boolean, demo boolean"
    rows = [("MailCo", None, "u", None, "p", None, None, None, None, None, None, None), (None, "u", None, "p", None, "imap.x.io", 143, None, None, None, None, False), (None, None, "u", None, None, "imap.x.io", None, None, None, None, None, None)]
    got = [tuple(r) for r in frames.resolved_accounts(spark.createDataFrame(rows, schema), presets).select("imap", "imap_port", "imap_secure", "smtp", "smtp_port", "smtp_secure").orderBy("imap").collect()]
    assert got == [("imap.mail.co", 993, True, "smtp.mail.co", 587, False), ("imap.x.io", 143, False, "smtp.x.io", 465, True)]


def test_folder_roles(spark):
    rows = [(1, ["\\Inbox"]), (2, ["\\Sent"]), (3, ["\\Sent"]), (4, ["\\Noselect"]), (5, ["x"])]
    got = mailbox.folder_roles(spark.createDataFrame(rows, "seq long, flags array<string>"), {"\\Inbox": "inbox", "\\Sent": "sent"})
    assert {r["seq"]: r["role"] for r in got.collect()} == {1: "inbox", 2: "sent", 3: None, 5: None}


def test_folded_html_takes_whole_pages(spark, tmp_path):
    """Quotes and reply markers far into a page, against a walk over its tree."""
    from xml.etree import ElementTree

    from quern.plans import QUERIES

    def walk(e, inside=False):
        quote = not inside and (e.get("class") == "gmail_quote" or (e.tag == "blockquote" and e.get("type") == "cite"))
        attrs = "".join(f' {k}="{v}"' for k, v in e.attrib.items())
        body = (e.text or "") + "".join(walk(x, inside or quote) + (x.tail or "") for x in e)
        whole = f"<{e.tag}{attrs}>{body}</{e.tag}>"
        return f"<details>{whole}</details>" if quote else whole

    long, planted = "<p>some words</p>" * 60, '<blockquote type="cite">old</blockquote>'
    pages = [
        f'<div>{long}<blockquote type="cite">x<div class="gmail_quote">y</div></blockquote>z</div>',
        f'<div class="gmail_quote">a{long}<div><blockquote type="cite">b</blockquote></div></div>',
        f"<div>{long}<b>end</b></div>",
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["html"] for r in QUERIES["folded_html"](spark, str(tmp_path)).collect()}
    for i, page in enumerate(pages):
        tree = ElementTree.fromstring(f"<root>{page}{planted}</root>")
        assert got[i] == "".join(map(walk, tree))
