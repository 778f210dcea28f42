"""The pipeline's stages against brute force on the smallest tables."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as C
from quern.llm import bpe, quality
from tests_llm_brute import near_brute, strip_brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.table(stage(spark, out[-1], sf), "test"))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_stage(stages):
    kept = dict(rows(stages[1]))
    verdicts = {r["doc_id"]: r for r in quality.judge(stages[0]).collect()}
    assert set(kept) == {k for k, v in verdicts.items() if v["kept"]}
    assert all(kept[k] == quality.keep_lines(t, verdicts[k]["removed"]) for k, t in rows(stages[0]) if k in kept)


def test_near_stage(stages):
    before = rows(stages[1])
    want = {k for (k, c, _) in near_brute(before) if k == c}
    assert {k for k, _ in rows(stages[2])} == want and len(rows(stages[2])) == len(want)


def test_passage_stage(stages):
    before, after = dict(rows(stages[2])), dict(rows(stages[3]))
    assert set(before) == set(after)
    want = {k: (h, n) for (k, _, n, _, h) in strip_brute(list(before.items()))}
    same = [k for k in before if hashlib.sha256((after[k] or "").encode()).hexdigest() == want[k][0]]
    assert len(same) >= len(before) - 2  # cut characters lose their stray bytes
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_mix_stage(stages):
    before, after = dict(rows(stages[3])), collections.Counter(rows(stages[4]))
    assert all(before[k] == t and n <= 3 for (k, t), n in after.items())
    words = lambda t: len((t or "").encode().split())
    assert sum(words(t) * n for (_, t), n in after.items()) == pytest.approx(sum(words(t) for t in before.values()), rel=0.05)


def test_token_stage(stages):
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = collections.Counter()
    for k, t in rows(stages[4]):
        ids = enc.encode_ordinary(t or "")
        want[(k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages[5].collect())
    assert got == want


def test_hard_rows_pass(spark):
    """Which of the hard rows each stage keeps, alone and one after the other."""
    from tests_llm_brute import HARD, LONG, SCHEMA

    solid = [(20 + i, " ".join(f"w{(7 * i + 3 * k) % 97}x{i}" for k in range(60)), "en", ["a", "b", None][i % 3], 1) for i in range(12)]
    docs = spark.createDataFrame(HARD + solid, SCHEMA)
    keys = lambda df: collections.Counter(None if r["doc_id"] is None else int(r["doc_id"]) for r in df.collect())
    alone = [keys(stage(spark, docs, "")) for _, stage in C.STAGES]
    own = collections.Counter(r[0] for r in solid)
    everything = collections.Counter(r[0] for r in HARD) + own
    assert alone[0] == own  # the hard ones have too few words, or words that repeat all through the text
    # Of the three long texts that are equal the smallest key stays; all others are groups of their own.
    assert alone[1] == everything - collections.Counter({4: 2})
    assert alone[2] == everything and set(alone[3]) <= set(everything) and set(alone[4]) == set(everything)
    passages = {r["doc_id"]: r["text"] for r in C.repeated_passages(spark, docs, "").filter("doc_id in (3, 4, 5, 7)").collect()}
    assert passages[3] == LONG and passages[4] == "" and passages[5] == "x" * 70_000 and passages[7] == HARD[8][1]
    for _, stage in C.STAGES:
        docs = C.table(stage(spark, docs, ""), "hard")
    assert 0 < len(keys(docs)) <= 12 and set(keys(docs)) <= set(own)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        empty = C.table(stage(spark, empty, ""), "empty")
    assert empty.count() == 0


def test_quality_stage_against_plain_rules(spark):
    """Lines of a host that too many documents have go, and with them documents of which too little is left."""
    menu = [" ".join(f"menu{k}n{j}" for j in range(5)) for k in range(30)]
    usual = {"Subscribe to our letter now", "All rights reserved by the house", *menu}
    rows = []
    for i in range(40):
        own = [" ".join(f"q{i}x{k}y{j}" for j in range(10)) for k in range(8)]
        rows.append((i, "\n".join(own + (menu if i % 3 == 0 else []) + sorted(usual - {*menu})), "en", "h", 1))
    rows += [(100 + i, "short text", "en", "h", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in C.quality(spark, docs, "").collect()}
    want = {}
    for k, text, *_ in rows:
        words, lines = text.split(), text.split("\n")
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {j + d for j, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
        left = [x for x in lines if x not in usual]
        if len(words) >= 50 and 2 * len(hit) <= len(words) and sum(len(x.split()) for x in left) >= 0.5 * len(words):
            want[k] = "\n".join(left)
    assert set(got) == set(want) == {i for i in range(40) if i % 3}
    assert all(got[k].split() == want[k].split() for k in want)


def test_extra_columns_stay(spark, sf):
    from pyspark.sql import functions as F

    names = ["row_key", "row_lines", "row_copies", "__key", "__n_removed", "kept", "__k"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for _, stage in C.STAGES[:-1]:
        docs = C.table(stage(spark, docs, sf), "extra")
        assert docs.columns[-len(names) :] == names
    assert docs.count() and docs.filter(" or ".join(f"`{c}` <> '{c}' || doc_id" for c in names)).count() == 0
