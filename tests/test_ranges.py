"""Ranged windows, deep pages and the search index against plain windows, sorts and scans."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import mailbox, postings, ranges
from quern.operators.postings import Postings, runs_of


@pytest.fixture(scope="module")
def listed(spark):
    """One folder with nearly all rows, a small one, one without a name; dates with many ties; long runs of equal and null values."""
    rng = random.Random(3)
    rows = [(i, "big" if i % 50 else ("small" if i % 100 else None), i // 40, rng.choice(["a", "a", "a", "b", None]) if i % 300 > 100 else "c", rng.random() < (0.9 if i < 700 else 0.02), rng.randrange(5)) for i in range(1500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, folder string, date long, bucket string, gone boolean, width long")


ORDER = lambda: [F.col("date").desc(), F.col("id").asc()]


def plan(df):
    return df._jdf.queryExecution().toString()


def sought(df, column):
    """The folders of a partitioned table that a plan reads."""
    filters = re.findall(r"PartitionFilters: \[(.*?)\], ", plan(df))
    found = [f for f in filters if re.search(rf"\b{column}#", f)]
    assert found
    return {n for f in found for part in re.findall(rf"{column}#\d+L? (?:IN|INSET) \((.*?)\)|{column}#\d+L? = (\d+)", f) for n in re.findall(r"\d+", " ".join(part))}


def same(got, want, *columns):
    assert "SinglePartition" not in plan(got)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_windows_over_ranges(listed, pieces):
    same(ranges.breaks(listed, "bucket", ORDER(), ["folder"], pieces=pieces), mailbox.breaks(listed, "bucket", ORDER(), ["folder"]), "id", "is_break")
    same(ranges.neighbours(listed, ORDER(), ["folder"], "gone", pieces), mailbox.neighbours(listed, ORDER(), ["folder"], "gone"), "id", "prev_id", "next_id", "advance_to")
    w = Window.partitionBy("folder").orderBy(*ORDER())
    carried = ranges.Carried(listed, ["folder"], ORDER(), pieces).place("n").total("advance", F.when(F.col("width") > 0, F.col("width"))).rows()
    same(carried, listed.withColumns({"n": F.row_number().over(w), "advance": F.sum(F.when(F.col("width") > 0, F.col("width"))).over(w)}), "id", "n", "advance")


@pytest.mark.parametrize("neighbours", [ranges.neighbours, mailbox.neighbours])
def test_neighbours_take_one_pass(spark, neighbours):
    """One list of 300,000 rows, of which the last one and one in the middle stay: no frame is folded anew for each row."""
    n = 300_000
    rows = spark.range(0, n, 1, 4).select("id", F.lit("all").alias("folder"), (~F.col("id").isin(n // 2, n - 1)).alias("gone"))
    out = neighbours(rows, [F.col("id").asc()], ["folder"], "gone")
    assert "unboundedfollowing" not in plan(out).lower()
    got = out.groupBy("advance_to").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()
    assert sorted(map(tuple, got)) == [(n // 2, n // 2 + 1, 0, n - 1), (n - 1, n // 2 - 1, n // 2, n - 2)]


def test_list_of_all_rows(listed):
    order = [F.col("date").desc(), F.col("id").asc()]
    w = Window.orderBy(*order)
    same(ranges.advances(listed, [], order, "width", 9), listed.withColumn("advance", F.sum("width").over(w)), "id", "advance")
    same(ranges.breaks(listed, "bucket", order, [], pieces=9), listed.withColumn("is_break", ~F.col("bucket").eqNullSafe(F.lag("bucket").over(w))), "id", "is_break")
    assert ranges.advances(listed.limit(0), [], order, "width").count() == 0


def test_between(listed):
    big = listed.filter("folder = 'big'")
    for ends in ((3, 1399), (1399, 3), (77, 77), (3, 801, 1203)):
        same(ranges.between(big, ORDER(), ["folder"], *ends, pieces=11), mailbox.between_rows(big, ORDER(), ["folder"], *ends), "id")


def test_pages_read_what_they_show(spark, listed, tmp_path):
    rows = listed.withColumns({"seen": F.col("gone"), "flagged": F.col("width") == 1, "seq": F.col("id")})
    pages = ranges.Pages.build(rows, ORDER(), str(tmp_path / "p"), pieces=25)
    whole = rows.orderBy(*ORDER())
    for offset, limit in ((0, 20), (700, 50), (1400, 100), (1460, 50), (5000, 10)):
        got = pages.page("big", offset, limit)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in whole.filter("folder = 'big'").offset(offset).limit(limit).collect()]
        if 0 < offset < 1400:
            assert 0 < len(sought(got, "piece")) <= 4 < pages.counts.select("piece").distinct().count()
    unread = lambda: whole.filter("folder = 'big' and not seen and flagged")
    n = unread().count()
    for offset in (0, 30, n - 5, n, n + 5):
        got = pages.page_with_total("big", offset, 10, flagged=~F.col("seen") & F.col("flagged")).collect()
        assert [r["id"] for r in got] == [r["id"] for r in unread().offset(offset).limit(10).collect()]
        assert all(r["total"] == n and r["next"] == (offset + 10 if offset + 10 < n else None) for r in got)
    where = F.col("bucket") == "b"
    assert [r["id"] for r in pages.page("big", 40, 15, where=where).collect()] == [r["id"] for r in whole.filter("folder = 'big' and bucket = 'b'").offset(40).limit(15).collect()]


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["Alpha", "beta", "γάμμα", "delta%_", "e", "ZÜRICH", "\n", "it's", "日本語", "x" * 250]
    rows = [(i, i * 3, None if i % 40 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 9))), "ab" if i % 7 else None) for i in range(600)]
    rows += [(600, 1801, "needle in alpha", None), (601, 1801, "needle out", ""), (602, 5000, None, None), (603, 5001, "q", None)]
    df = spark.createDataFrame(rows, "id long, seq long, text string, sender string")
    return df, Postings.build(df, ["text", "sender"], str(tmp_path_factory.mktemp("index")), 50)


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_index_rows_are_gathered_part_by_part(monkeypatch, most):
    """Runs of neighbouring messages against plain sets; a part holds no more than it should, and each message is in one part."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(4), rng.randrange(30), "".join(rng.choices("abc日𝔘 \n", k=rng.choice([0, 1, 2, 3, 9, 40])))) for _ in range(120))
    monkeypatch.setattr(postings, "PART", most)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7])], ["block", "at", "text"]) for i in range(0, len(rows), 7)]
    got = [r for b in postings._gathered(iter(batches)) for r in b.to_pylist()]
    want = {(b, at, run) for b, at, text in rows for run in ({text[i : i + 3] for i in range(len(text) - 2)} or {text})}
    assert {(r["block"], at, r["run"]) for r in got for at in r["ats"]} == want
    assert len({(r["block"], r["part"], r["run"]) for r in got}) == len(got)
    assert all(r["ats"] == sorted(set(r["ats"])) and r["n"] == len(r["ats"]) for r in got)
    parts = len({(r["block"], r["part"]) for r in got})
    assert parts == len({r[0] for r in rows}) if most == 10_000 else parts > 10
    assert list(postings._gathered(iter([]))) == []


@pytest.mark.parametrize("query", ["needle", "NEEDLE IN ALPHA", "a", "q", "ab", "%_", "ü", "γάμ", "x" * 200, "beta ab", "a beta", " ", "  ", "\n ", "'s z", "zzz", "alpha alpha", "日本", "q ", "", "本語 ab"])
def test_index_finds_what_a_scan_finds(searched, query):
    df, index = searched
    want = df.filter(mailbox.contains_text([F.col("text"), F.col("sender")], query))
    assert sorted(r["id"] for r in index.search(query).collect()) == sorted(r["id"] for r in want.collect())


def test_index_reads_few_blocks(searched):
    df, index = searched
    assert sought(index.search("needle"), "block") == {"36"} and index.texts.select("block").distinct().count() > 30
    assert runs_of("abcd") == ["abc", "bcd"]
    scan = plan(index.rows.filter(F.col("run").isin(["nee", "eed"])))
    assert re.search(r"PushedFilters: \[In\(run, \[eed,nee\]\)", scan)
