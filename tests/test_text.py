"""Published cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from quern.functions import labels as L
from quern.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("out")).first()["out"]


@pytest.mark.parametrize("given, key", [
    ("Re: Fwd: RE: Hello  world", "hello world"), ("Ответ: Отв: Привет", "привет"), ("AW: [EXT] Release", "release"),
    ("[aether/core] PR #1".replace("aether", "team"), "[team/core] pr #1"), (None, ""),
])
def test_thread_subject(spark, given, key):
    assert one(spark, T.thread_subject, given) == key


def test_html_to_text(spark):
    html = "<style>p{}</style><p>Hi&nbsp;there</p><p>Line&#33;<br>Two &amp; three</p>"
    assert one(spark, T.html_to_text, html) == "Hi there\nLine!\nTwo & three"
    assert one(spark, T.html_to_text, None) == ""


def test_entities(spark):
    assert one(spark, T.decode_entities, "&amp;lt; &#128516; &#x41; &bogus; &#0; &#1114112; & x &") == "&lt; 😄 A &bogus; &#0; &#1114112; & x &"


@pytest.mark.parametrize("given, out", [("Thanks!\n\nOn Tue, Bob wrote:\n> old stuff", "Thanks!"), ("Hello\n-- \nSig", "Hello"), ("a\n> q\nb", "a b"), (None, "")])
def test_snippet(spark, given, out):
    assert one(spark, T.snippet, given) == out


def test_snippet_length(spark):
    out = one(spark, T.snippet, "a" * 300)
    assert len(out) == 180 and out.endswith("…")


def test_recipients(spark):
    got = one(spark, T.parse_recipients, 'Anna <anna@x.ru>, bob@y.com; nope; "Q" <q@z.io>')
    assert [tuple(x) for x in got] == [("Anna", "anna@x.ru"), ("", "bob@y.com"), ("Q", "q@z.io")]


def test_text_to_html(spark):
    got = one(spark, T.text_to_html, "<b>hi</b>\nhttps://a.b/c.")
    assert got == '&lt;b&gt;hi&lt;/b&gt;<br><a href="https://a.b/c">https://a.b/c</a>.'


def test_small_ones(spark):
    assert one(spark, T.safe_name, 'a"b\\c\r\n') == "a_b_c__"
    assert one(spark, T.safe_name, "") == "file"
    assert tuple(one(spark, T.typed_recipient, ' "Al" <A@X.io>, ')) == ("Al", "a@x.io")
    assert one(spark, T.initials, "«Anna»  van.Berg") == "AV"
    assert one(spark, T.initials, "--") == "?"
    assert one(spark, T.display_name, "", "bob@x.io") == "bob"
    assert one(spark, T.display_name, None, None) == "Без имени"
    assert one(spark, T.pieces, "one two three four five six") == ["one two three ", "four five six"]


def test_quotes(spark):
    got = one(spark, T.plain_parts, "hi\n> a\n>b\n\n> c")
    assert (got["body"], got["quoted"]) == ("hi", "a\nb\n\nc")
    assert one(spark, T.plain_parts, "> only quote")["quoted"] is None
    assert one(spark, T.plain_parts, "a\n> q\nb")["quoted"] is None


def test_predicates(spark):
    assert one(spark, T.is_remote, '<img src="https://x/y">') and not one(spark, T.is_remote, "<p>")
    assert one(spark, T.is_designed, "<TABLE>") and not one(spark, T.is_designed, "color: color: color:")
    assert one(spark, T.clean_html, "<base x><script>1</script>a<meta http-equiv=refresh>") == "a"


def test_labels(spark):
    number = lambda fn, n: spark.range(1).select(fn(F.lit(n)).alias("o")).first()["o"]
    assert [number(L.file_size, n) for n in (5, 1536, 1572864, 20 * 2**20)] == ["5 Б", "2 КБ", "1.5 МБ", "20 МБ"]
    assert [number(L.ordinal, n) for n in (1, 2, 3, 4, 11, 112, 121)] == ["1st", "2nd", "3rd", "4th", "11th", "112th", "121st"]
    assert [number(lambda c: L.plural(c, "a", "b", "c"), n) for n in (1, 2, 5, 11, 12, 21, 22)] == ["a", "b", "c", "c", "c", "a", "b"]
    assert [number(lambda c: L.cycling_line(c, ("a", "b", "c", "d"), 2), n) for n in (1, 4, 5, 6, 7)] == ["a", "d", "c", "d", "c"]
    badge = one(spark, L.file_badge, "x.PDF")
    assert tuple(badge) == ("PDF", "#e5484d")
    assert [spark.range(1).select(L.fuzzy_score(F.lit("Inbox rules"), q).alias("o")).first()["o"] for q in ("", "in", "rules", "ibx", "zz")] == [1, 100, 54, 10, 0]


def test_fnv(spark):
    def fnv(s):
        x = 2166136261
        for c in s:
            x = (x ^ ord(c)) * 16777619 % 2**32
        return x

    assert one(spark, L.fnv1a, "a@b.c") == fnv("a@b.c")


def test_snippets_of_long_texts(spark):
    """The first characters decide a snippet where they can; it is that of the whole text in any case."""
    import random
    import re

    blank = "[\\s ﻿]"

    def plain(s, most=180):
        kept = []
        for x in re.split(r"\r?\n", s):
            quoted = re.match(rf"{blank}*>", x)
            if not quoted and (re.fullmatch(rf"--{blank}*", x) or re.match(r"(?i)(?:On|В|Le|Am) .{4,120}(?:wrote|написал|a écrit|schrieb)", x)):
                break
            kept += [] if quoted else [x]
        flat = re.sub(rf"^{blank}+|{blank}+$", "", re.sub(rf"{blank}+", " ", " ".join(kept)))
        return flat if len(flat) <= most else re.sub(rf"{blank}+$", "", flat[: most - 1]) + "…"

    rng = random.Random(4)
    parts = ["word", "a b", "> quoted " * 40, "", " ", "--", "-- ", "--" + " " * 400, "-- x", "On Monday Ann wrote:", "On " + "y" * 200 + " wrote", "long " * 60, "z" * 700, " " * 500, " ", "> x"]
    texts = ["\n".join(rng.choices(parts[:1] * 4 + parts, k=rng.randint(0, 30))) for _ in range(400)]
    texts += ["x" * n + end + "y" * 900 for n in (150, 178, 179, 180, 181, 1438, 1439, 1440, 1441) for end in ("", "\n--\n", "\r\n--\r\n", "\n> ", " ")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select("id", T.snippet(F.col("t")).alias("s"))
    assert {r["id"]: r["s"] for r in df.collect()} == {i: plain(t) for i, t in enumerate(texts)}
