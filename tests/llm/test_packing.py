"""Packed ids, sort-means and spelling variants against plain versions, and on hard rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import packed, sortmeans, spelling
from tests_llm_brute import HARD, SCHEMA

VOCABULARY = P.path("byte_bpe_50k.json")
CLASH = ["key", "hash", "row", "last", "v", "cluster", "word", "n", "kind", "block", "run", "start"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def whole(v):
    return None if v is None or v != v else int(v)


# 11


@pytest.mark.parametrize("n", [0, 1, 119, packed.BLOCK - 1, packed.BLOCK, packed.BLOCK + 1, 30_000])
@pytest.mark.parametrize("high", [0, 1, 5_000, 50_256, (1 << 40) - 1, (1 << 64) - 1])
def test_packing_round_trip(n, high):
    rng = np.random.default_rng(n + 1)
    ids = rng.integers(0, high, n, np.uint64, endpoint=True)
    ids[rng.random(n) < 0.6] %= np.uint64(90)
    raw, table = packed.pack(ids)
    sizes = np.full(len(table), packed.BLOCK)
    if n:
        sizes[-1] = n - (len(table) - 1) * packed.BLOCK
    assert table[:, 0].sum() == len(raw)
    assert n == 0 or (packed.unpack(raw, table[:, 1], table[:, 2], sizes) == ids).all()


def test_words_take_the_most_ids_that_fit():
    ids = np.array([1] * 60 + [900] * 6 + [40_000] * 3 + [1 << 62] + [0] * 120, np.uint64)
    raw, table = packed.pack(ids)
    assert table.tolist() == [[8 * 6, 5, 1]]  # 60 x 1, 6 x 10, 3 x 20, an escape and its id, 120 x 0


def test_reader_seeks_blocks(tmp_path):
    ids = np.random.default_rng(3).integers(0, 50_257, 100_000, np.uint64)
    writer = packed.Writer(str(tmp_path), "a.ids")
    for k, low in enumerate(range(0, len(ids), 777)):
        writer.add(k, ids[low : low + 777])
    name, docs, count, size = writer.close()
    assert (docs, count, size) == (-(-len(ids) // 777), len(ids), (tmp_path / name).stat().st_size)
    file = packed.Reader(str(tmp_path), name)
    for a, b in ((0, 1), (4_095, 4_097), (99_999, 100_000), (50, 50), (12_345, 54_321), (0, 100_000)):
        assert (file.ids(a, b) == ids[a:b]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab Z9'sé.\n\t\r  \u0085\x1c　日<|endoftext|>"), max_size=40))
def test_pieces_are_encoded_apart(text):
    coder = packed.pieces(VOCABULARY)
    assert coder.ids(text) == coder.plain(text)


def ids_brute(library, rows):
    out, at = [], 0
    order = lambda r: (r[0] is None, r[0] or 0)
    for k, t in sorted(rows, key=order):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_packed_ids(spark, sf, library, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    packed.write_ids(docs.withColumns({c: F.lit("clash") for c in CLASH}), VOCABULARY, str(tmp_path / "a"), 2, files=5)
    got = packed.read_ids(spark, str(tmp_path / "a")).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got) == ids_brute(library, rows)
    assert packed.manifest(spark, str(tmp_path / "a")).agg(F.sum("docs")).first()[0] == len(rows)


def test_packed_hard_rows(spark, library, tmp_path):
    rows = [(r[0], r[1]) for r in HARD] + [(10, "a<|endoftext|>b"), (11, "say 'em\x1c\x1f  x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed.write_ids(docs.repartition(3), VOCABULARY, str(tmp_path / "a"), 2, files=3)
    got = packed.read_ids(spark, str(tmp_path / "a")).collect()
    # Rows of equal key are the same text here, so their order doesn't show.
    assert sorted(((whole(r["doc_id"]), r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got), key=lambda r: r[1]) == ids_brute(library, rows)
    packed.write_ids(docs.limit(0), VOCABULARY, str(tmp_path / "b"), 2)
    assert packed.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_files_of_lost_attempts_do_not_count(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    packed.write_ids(docs, VOCABULARY, str(tmp_path / "a"), 2, files=2)
    stray = packed.Writer(str(tmp_path / "a"), "000000-stray.ids")
    stray.add(7, np.arange(9, dtype=np.uint64))
    stray.close()
    assert packed.read_ids(spark, str(tmp_path / "a")).count() == 20


# 12


def means_brute(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        to = nearest()
        for c in range(len(centroids)):
            if own := [v for (_, v), (_, j) in zip(kept, to) if j == c]:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    to = nearest()
    inertia = collections.Counter()
    for d, j in to:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, to))


def clusters(df):
    return collections.Counter((whole(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_sort_means(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (10, 64))
    x = centres[rng.integers(0, 10, 300)] + rng.normal(0, spread, (300, 64))
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (5, x[5].tolist()), (5, x[5].tolist())]
    bad = [(900, None), (901, [1.0] * 63), (902, [nan] * 64), (903, [inf] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, []), (906, [-inf] * 64)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASH})
    out = sortmeans.sort_means(df)
    assert clusters(out) == means_brute(rows + bad)
    if spread < 0.1:  # well-separated clusters: most centroids are never looked at
        assert out.agg(F.avg("scanned")).first()[0] < 8


def test_sort_means_small_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert sortmeans.sort_means(spark.createDataFrame([], kind)).count() == 0
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [0.5] * 64)]
    assert clusters(sortmeans.sort_means(spark.createDataFrame(few, kind))) == means_brute(few)
    same = [(i, [0.25] * 64) for i in range(40)]  # all centroids tie: the smallest number wins
    assert clusters(sortmeans.sort_means(spark.createDataFrame(same, kind))) == means_brute(same)
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], kind)
    assert sortmeans.sort_means(huge).count() == 2


def test_scan_keeps_ties_at_the_bound():
    centroids = np.array([[4, 0], [0, 0], [2, 2]], np.int64)
    cluster, distance, scanned = sortmeans.assign(np.array([[2, 0], [0, 0], [4, 1]], np.int64), centroids, np.array([1, 1, 0]))
    assert cluster.tolist() == [0, 1, 0] and distance.tolist() == [4, 0, 1] and scanned.tolist() == [3, 1, 1]


# 13


def spelling_brute(rows, shortest=7):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    return groups_brute({w: c for w, c in n.items() if c >= 2})


def groups_brute(n):
    beside = {w: {v for v in n if spelling.near(v, w)} for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in beside.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(beside[w]), n.get(form.get(w))) for w in n}


def spelled(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_near_is_one_edit():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(120)]
    assert all(spelling.near(a, b) == (distance(a, b) == 1) for a in words for b in words)


def test_words(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})
    assert spelled(spelling.spelling_groups(spelling.words_of(docs))) == spelling_brute(rows)


def test_spelling_hard_rows(spark):
    rows = [(r[0], r[1]) for r in HARD] + [(None, "ÀÉÎÕÜßÿ naïveté×÷ naïveté×÷ " * 3), (12, "Zwölftel zwölftel ZWÖLFTEL zwÖlftel " * 30), (13, "abcdefg ABCDEFG abcdefgh " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert spelled(spelling.spelling_groups(spelling.words_of(docs))) == spelling_brute(rows)
    assert spelling.spelling_groups(spelling.words_of(docs.limit(0))).count() == 0


@pytest.mark.parametrize("words, shards", [("ab", 1), ("abc", 3), ("common", 2)])
def test_common_halves(spark, monkeypatch, words, shards):
    """Few letters, and a stem that all words share: lists far above ``LIST``, several shards and blocks."""
    rng = random.Random(5)
    if words == "common":
        made = {"interstellar" + "".join(rng.choices("xyz", k=rng.randint(3, 6))) for _ in range(700)} | {"".join(rng.choices("xyz", k=4)) + "interstellar" for _ in range(60)}
    else:
        made = {"".join(rng.choices(words, k=rng.randint(7, 10))) for _ in range(900)}
    n = {w: rng.choice([2, 3, 25, 300, 4_000]) for w in sorted(made)}
    monkeypatch.setattr(spelling, "SHARD_WORDS", len(n) // shards)
    monkeypatch.setattr(spelling, "BLOCK", len(n) // shards)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert spelled(spelling.spelling_groups(df)) == groups_brute(n)


def test_roots_follow_chains(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2_000, "abcdefghijk": 20_000, "zzzzzzzz": 9}
    got = spelled(spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == groups_brute(n) and {r[2] for r in got} == {"abcdefghijk", "zzzzzzzz"}
