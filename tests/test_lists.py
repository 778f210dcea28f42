"""Threads by subject, MIME trees, gated pieces, folds over long strokes, views that are kept, drafts."""

import random
import re
from email import message_from_string

import pytest
from pyspark.sql import functions as F

from quern.functions import labels, text
from quern.operators import changes, layout, mailbox
from quern.sources import mime
from quern.streaming import sessions

MAIL = "folder string, id long, subject string, message_id string, date string"


def test_thread_by_subject(spark):
    rows = [
        ("inbox", 1, "Plan", "a", "2024-01-01"), ("inbox", 2, "Re: plan", "b", "2024-01-02"), ("sent", 2, "RE: Plan", "b", "2024-01-02"), ("sent", 9, "Fwd: Plan", "", "2024-01-03"),
        ("sent", 10, "Fwd: Plan", None, "2024-01-04"), ("inbox", 3, "Plan B", "c", "2024-01-02"), ("work", 4, "Plan", "d", "2024-01-02"), ("inbox", 5, "", "e", "2024-01-05"),
    ]
    df = spark.createDataFrame(rows, MAIL)
    got = lambda f, i, **k: [(r["folder"], r["id"]) for r in mailbox.thread_search(df, f, i, **k).collect()]
    assert got("inbox", 1) == [("inbox", 1), ("inbox", 2), ("sent", 9), ("sent", 10)]
    assert got("inbox", 1, each=1) == [("inbox", 1), ("sent", 10)]  # the newest hit is another subject; the root is forced
    assert got("inbox", 1, last=2) == [("sent", 9), ("sent", 10)]
    assert got("inbox", 5) == [("inbox", 5)] and got("sent", 10)[-1] == ("sent", 10)


def parts_of(raw):
    return mime.numbered_parts(message_from_string(raw))


LONE = "Content-Type: text/html\n\n<p>x"
ALT = 'Content-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/{}\n\none\n--b\nContent-Type: text/{}\n\ntwo\n--b--\n'
MIXED = 'Content-Type: multipart/mixed; boundary="m"\n\n--m\n{}\n--m\nContent-Type: application/pdf; name="r.pdf"\nContent-Disposition: attachment; filename="r.pdf"\n\nx\n--m--\n'


def test_part_numbers(spark):
    assert [p["part"] for p in parts_of(LONE)] == ["1"]
    assert [(p["part"], p["type"]) for p in parts_of(MIXED.format(ALT.format("plain", "html")))] == [("1.1", "text/plain"), ("1.2", "text/html"), ("2", "application/pdf")]
    raws = [LONE, ALT.format("plain", "html"), ALT.format("html", "plain"), MIXED.format(ALT.format("plain", "html")), ""]
    df = spark.createDataFrame([(i, r.encode()) for i, r in enumerate(raws)], "id long, raw binary")
    parts = mime.message_parts(df, "id", "raw")
    first = {r["id"]: (r["part"], r["type"], r["preview"].strip()) for r in mime.previews(parts, "id").collect()}
    assert first[0] == ("1", "text/html", "<p>x") and first[1] == ("1", "text/plain", "one") and first[3] == ("1.1", "text/plain", "one")
    assert first[2] == ("1", "text/html", "one")  # the first text wins, whatever its kind
    assert {r["id"]: r["has_attachments"] for r in mime.attached(parts, "id").collect()} == {0: False, 1: False, 2: False, 3: True, 4: False}


@pytest.mark.parametrize("seed", range(4))
def test_gated_pieces(spark, seed):
    rng = random.Random(seed)
    streams = [["".join(rng.choice("ab \n") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 12))] for _ in range(30)]
    rows = [(s, i, p, i == len(ps) - 1) for s, ps in enumerate(streams) for i, p in enumerate(ps)]
    want = []
    for s, ps in enumerate(streams):
        held = ""
        for i, p in enumerate(ps):
            held += p
            cut = len(held) if i == len(ps) - 1 else max([k + 1 for k, c in enumerate(held) if c.isspace()], default=0)
            if held[:cut]:
                want.append((s, i, held[:cut]))
            held = held[cut:]
    got = sessions.gated(spark.createDataFrame(rows, "s long, i long, t string, last boolean"), ["s"], "i", "t", "last")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_eased_in_pieces(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.random() * 3) for k, n in (("a", 700), ("b", 64), ("c", 1)) for i in range(n)]
    got = {(r["k"], r["i"]): r["eased"] for r in layout.eased(spark.createDataFrame(rows, "k string, i long, p double"), ["k"], ["i"], piece=64).collect()}
    last = {}
    for k, i, p in rows:
        last[k] = last[k] + (p - last[k]) * layout.EASE if k in last else p
        assert got[k, i] == pytest.approx(last[k], rel=1e-9)


def test_steady_walk(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.random(), rng.random()) for k in "abc" for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double")
    want, at = [], {}
    for k, i, x, y in rows:
        if k not in at or (x - at[k][0]) ** 2 + (y - at[k][1]) ** 2 >= layout.TREMOR:
            at[k] = (x, y)
            want.append((k, i))
    assert sorted((r["k"], r["i"]) for r in layout.steady(df, ["k"], ["i"]).collect()) == want
    assert layout.steady(df.limit(0), ["k"], ["i"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_wrap_keeps_words(seed):
    """No line is too wide, nothing is lost but blanks and line ends, and no line could have held the next word."""
    rng = random.Random(seed)
    whole = "".join(rng.choice(["ab", "c", "longer", " ", " ", "\n", "\n\n\n", "x" * 25]) for _ in range(300))
    lines = layout.wrap(whole, 20)
    assert all(len(x.rstrip(" ")) <= 20 for x in lines) and "".join("".join(lines).split()) == "".join(whole.split())


def laid(text, width, size):
    """Word by word and character by character, each line measured as a whole."""
    lines = [""]
    for token in re.split(r"(\s+)", text):
        if not token.strip():
            if token.count("\n"):
                lines += [""] * min(token.count("\n"), 2)
            elif token and lines[-1]:
                lines[-1] += " "
        elif lines[-1] and size(lines[-1] + token) <= width:
            lines[-1] += token
        else:
            if lines[-1]:
                lines.append("")
            for c in token:
                if lines[-1] and size(lines[-1] + c) > width:
                    lines.append("")
                lines[-1] += c
    return lines if lines[-1] else lines[:-1]


@pytest.mark.parametrize("seed", range(6))
def test_wrap_by_widths(seed):
    rng = random.Random(seed)
    widths = {"i": 2, "m": 9, " ": 3, "é": 7}
    whole = "".join(rng.choice(["im", "mmm", "é", "i" * 30, "mi" * 12, " ", " ", "\t ", "\n", "\n\n\n", "日本"]) for _ in range(200))
    for known, other in ((widths, 5), (None, 1), (None, 3)):
        size = lambda part: sum((known or {}).get(c, other) for c in part)  # noqa: B023, E731
        assert layout.wrap(whole, 60, known, other) == laid(whole, 60, size)


def test_measured_lines(spark):
    """Widths of whole lines without a walk over their characters in Spark, and of words that are kept from text to text."""
    widths, other = {"i": 2, "l": 2, "m": 9, " ": 3, "é": 7, "-": 2, "^": 5}, 5
    lines = ["", "im l", "日本 é", "𝔘m-^]i", "x", "mmm" * 50]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("n", layout.measured(F.col("line"), widths, other))
    assert [r["n"] for r in df.orderBy("id").collect()] == [sum(widths.get(c, other) for c in x) for x in lines]
    kept = layout._Sizes(widths, other)
    kept.MOST = 3
    size = lambda part: sum(widths.get(c, other) for c in part)
    for whole in ("im mmm é 日本 x", "é é im " * 9 + "日" * 200, "new w𝔘rds here im"):
        assert layout.wrap(whole, 60, widths, other, kept) == laid(whole, 60, size)
    assert 0 < len(kept) <= 3 and all(n == size(word) for word, n in kept.items())


def test_measured_query_has_no_walk_over_characters(spark, sf):
    from quern.plans.texts import WIDTHS, wrap_measured

    out = wrap_measured(spark, sf)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["advance"] == sum(WIDTHS.get(c, 36) for c in r["line"]) for r in out.limit(2000).collect())


def test_bodies(spark):
    row = spark.range(1).select(
        text.plain_to_html(F.lit("Hi <me@x.org>, see http://a.b/c.\n\n> old\n> http://d.e")).alias("both"), text.plain_to_html(F.lit("> all\n> quoted")).alias("all"),
        text.plain_to_html(F.lit(None).cast("string")).alias("none"), text.shown_body(F.lit(False), F.lit("t"), F.lit('<img src="http://x/y">')).alias("html"), text.shown_body(F.lit(None), F.lit("t"), F.lit("")).alias("plain"),
        labels.folder_icon(F.lit("junk"), F.lit("x")).alias("junk"), labels.folder_icon(F.lit(None), F.lit("My Trips")).alias("trip"), labels.folder_icon(F.lit("odd"), F.lit("Work")).alias("odd"),
    ).first()
    assert row["both"].startswith('<div class="plain">Hi &lt;me@x.org&gt;, see <a href="http://a.b/c">http://a.b/c</a>.</div><details')
    assert row["both"].endswith('<div class="plain quoted">old\n<a href="http://d.e">http://d.e</a></div></details>')
    assert "<details" not in row["all"] and row["none"] == '<div class="plain"></div>'
    assert tuple(row["html"])[1:] == (True, True) and tuple(row["plain"]) == ('<div class="plain">t</div>', False, True)
    assert (row["junk"], row["trip"], row["odd"]) == ("spam", "plane", "folder")


def test_palette(spark):
    rows = [(1, "go", "Archive", "box store"), (2, "go", "Mark read", None), (3, "set", "Dark theme", "archive night")]
    df = spark.createDataFrame(rows, "seq long, section string, title string, keywords string")
    assert [(r["seq"], r["score"]) for r in mailbox.palette(df, "Arch").collect()] == [(1, 100.0), (3, 80.0)]
    assert [r["starts_section"] for r in mailbox.palette(df, " ").collect()] == [True, False, True]


def test_drafts(spark):
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, False, "y"), ("b", 1, False, "z")], "key string, saved_at long, deleted boolean, text string")
    gone = changes.discarded(log, log.filter("key = 'a'"), F.lit(3).cast("long"))
    assert [r["key"] for r in changes.latest_drafts(gone).collect()] == ["b"]
    back = changes.restored(gone, log.filter("key = 'a'"), F.lit(4).cast("long"))
    assert [(r["key"], r["text"]) for r in changes.latest_drafts(back).collect()] == [("a", "y"), ("b", "z")]
