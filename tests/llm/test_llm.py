"""The training-data operators against brute force, and on hard rows."""

import collections
import hashlib
import os

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, hnsw, jaccard, langid, mixing, quality, sharding, substrings, tokencount, urls
from quern.llm.components import block_pairs, components
from quern.llm.queries import ORACLE, QUERIES
from tests_llm_brute import HARD, SCHEMA, near_brute, strip_brute

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CLASH = ["shard", "size", "ids", "kept", "n_words", "__key", "rule", "spans", "removed", "lang_pred", "__row", "N_TOKENS", "lines"]
MULTI, RANKS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def whole(v):
    return None if v is None or v != v else int(v)


def test_queries_are_complete():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == {*range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE[name]).df()
    cell = lambda v: None if pd.isna(v) else int(v) if isinstance(v, (float, np.integer)) and v == int(v) else v
    rows = lambda df: sorted(str([cell(v) for v in row]) for row in df[sorted(want.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# 1


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 7, 24, 33, 700])
def test_jump(spark, n):
    rows = sharding.assign(spark.range(-200, 200), "id", n).collect()
    assert all((r["shard"], r["grown_shard"]) == (jump(r["id"], n), jump(r["id"], n + 1)) for r in rows)


def test_sharding_hard_rows(hard):
    out = sharding.shard_documents(hard, 3).toPandas()
    assert len(out) == len(HARD)
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert out.loc[out.doc_id == 2, "size"].item() == 8 and out.loc[out.doc_id == 2, "text_crc32"].item() == 0
    assert sharding.shard_documents(hard.limit(0)).count() == 0


def test_sharding_query(spark, sf):
    import zlib

    out = QUERIES["op1_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25)) and r["grown_shard"] in (r["shard"], 24)
    for shard in range(24):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))


# 2


def test_rules(spark):
    cases = [
        ("http://EXAMPLE.org/es/x", "example.org", "/es/x", "example.org/es/", "block"), ("http://a.b.org/", "a.b.org", "/", "org/", "allow"), ("http://org", "org", "", None, "allow"),
        ("https://x.example.org/en/12?q#f", "x.example.org", "/en/12", "example.org/en/1", "block"), ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("ftp://a.com/de/#x", "a.com", "/de/", "com/de/", "block"), ("//a.com/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://a.net/q.org/", "a.net", "/q.org/", None, "allow"), ("http://a.net/x.zip", "a.net", "/x.zip", None, "block"), ("http://ads.net/", "ads.net", "/", None, "block"),
        ("http://a.com?x/de/", "a.com", "", None, "allow"), ("http://" + "a" * 90_000 + ".com/fr/", "a" * 90_000 + ".com", "/fr/", "com/fr/", "allow"), ("x://y\n.com/de/\nz", "y\n.com", "/de/\nz", "com/de/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id int, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_automaton():
    import fnmatch
    import random

    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    globs = [word("ab*?", 9) for _ in range(60)] + ["a" * 100 + "*b"]
    texts = [word("abc", 14) for _ in range(300)] + ["a" * 120 + "b", ""]
    machine = urls.Automaton([[{42: urls.STAR, 63: urls.ONE}.get(b, b) for b in g.encode()] for g in globs])
    got = machine.matches([t.encode() for t in texts])
    assert all(got[i, j] == fnmatch.fnmatchcase(t, g) for i, t in enumerate(texts) for j, g in enumerate(globs))


# 3


@pytest.mark.parametrize("chunk, overlap", [(400, 60), (65_536, 4_096)])
def test_encoding(spark, docs, hard, chunk, overlap):
    enc = bpe.encoding(MULTI, P.PATTERN)
    rows = docs.unionByName(hard.select(docs.columns)).withColumn("ids", F.lit("clash"))
    coded = bpe.encode(rows, MULTI, P.PATTERN, chunk=chunk, overlap=overlap)
    out = bpe.decode(coded, MULTI, P.PATTERN).toPandas()
    assert len(out) == rows.count()
    for text, ids, back in zip(out["text"], out["ids"], out["decoded"]):
        assert bytes(ids) == np.array(enc.encode_ordinary(text or ""), "<u4").tobytes() and bytes(back) == (text or "").encode()
    assert bpe.encode(docs.limit(0), MULTI, P.PATTERN).count() == 0


# 4


def test_token_counts(docs, hard):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(RANKS)
    extra = ["<|endoftext|>", "a<|endoftext|> b", "don't I'll\n\n  x", "é" * 3000, "".join(chr(i) for i in range(1, 0x2FFF))]
    counter = tokencount.counter(RANKS)
    assert [counter.count(t) for t in extra] == [len(library.encode(t, add_special_tokens=False).ids) for t in extra]
    out = tokencount.count_tokens(docs.unionByName(hard.select(docs.columns)), RANKS).toPandas()
    for text, n_bytes, n, over in zip(out["text"], out["n_bytes"], out["n_tokens"], out["over_limit"]):
        assert n == len(library.encode(text or "", add_special_tokens=False).ids) and n_bytes == len((text or "").encode()) and over == (n > 1024)
    assert tokencount.count_tokens(hard, RANKS).count() == len(HARD) and tokencount.count_tokens(hard.limit(0), RANKS).count() == 0


# 5


def brute_figures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(docs, hard):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.unionByName(hard.select(docs.columns))
    out = quality.judge(rows).toPandas()
    texts = collections.Counter((whole(r["doc_id"]), brute_figures(r["text"])) for r in rows.collect())
    assert collections.Counter((whole(i), tuple(int(x) for x in f)) for i, *f in out[["doc_id", *names]].itertuples(index=False)) == texts
    assert (out["base_failed"] == ((out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"]))).all()
    assert len(quality.judge(hard).toPandas()) == len(HARD) and quality.judge(hard.limit(0)).count() == 0


def test_frequent_lines(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    menu = "Home  About US Contact " + " ".join(f"m{k}" for k in range(80))
    rows = [(i, f"{body(i)}\n{menu if i % 2 else menu.upper()}", "h") for i in range(30)]
    rows += [(100 + i, body(100) + "\nshared tail of copies", "h") for i in range(40)]
    rows += [(200 + i, f"{body(200 + i)}\n{menu}", "other") for i in range(5)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    assert not out.loc[range(30), "kept"].any() and out.loc[range(100, 140), "kept"].all() and out.loc[range(200, 205), "kept"].all()
    assert (out.loc[range(30), "words_left"] == 60).all()
    gone = out.loc[0, "removed"]
    assert quality.keep_lines(rows[0][1], gone) == body(0)
    assert quality.repeated_words([b"a", b"b", b"c"] * 40_000) == 120_000


def test_boilerplate_does_not_hide_itself(spark):
    """Pages of many shared lines and one of their own are as many documents, whichever line hash is smallest."""
    menu = [" ".join(f"m{j}x{k}" for k in range(2)) for j in range(60)]
    rows = [(i, "\n".join([*menu, " ".join(f"w{i}x{k}" for k in range(30))]), "h") for i in range(40)]
    rows += [(1000 + i, rows[0][1].upper(), "h") for i in range(50)]
    rows += [(2000 + i, rows[i][1], "few") for i in range(quality.MAX_DOCS)] + [(3000 + i, rows[0][1], "few") for i in range(50)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    hashes = {quality.line_hash(x) for x in menu}
    assert all(set(r) == hashes for r in out.loc[out.index < 2000, "removed"]) and (out.loc[out.index < 2000, "words_left"] == 30).all()
    assert not out.loc[out.index < 2000, "kept"].any() and out.loc[out.index >= 2000, "kept"].all()


# 6


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:40].repeat(5, 0) + rng.normal(size=(200, 16)) * 0.08
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32).astype(float))]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (901, rows[0][1]), (None, rows[0][1]), (902, None), (903, []), (904, [0.0] * 16), (905, [float("nan")] + [1.0] * 15), (906, [None] + [1.0] * 15), (907, [1.0, 2.0]), (908, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("__key", F.lit(1))
    out = hnsw.near_vectors(df, shards=3, block=2 * hnsw.LEAST).toPandas()
    links, low = collections.Counter(), {}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    stored = [None if v is None else np.array([np.nan if x is None else x for x in v], np.float32).astype(float) for _, v in rows]
    solid = [v is not None and len(v) and np.isfinite(v).all() and v.any() for v in stored]
    for i in range(len(rows)):
        for j in range(i):
            if solid[i] and solid[j] and len(stored[i]) == len(stored[j]) and stored[i] @ stored[j] / np.linalg.norm(stored[i]) / np.linalg.norm(stored[j]) >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    want = collections.Counter((k, links[i], low.get(find(i))) for i, (k, _) in enumerate(rows))
    got = collections.Counter((whole(k), n, whole(c)) for k, n, c in zip(out.vec_id, out.n_links, out.component_id))
    assert got == want
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 24)) * 0.05
    shard = hnsw.Shard(np.arange(3000), x, 0.95, 0.99)
    found = shard.matches(shard.unit)
    assert all(len(f) == len(set(f)) for f in found)
    assert sum(len(f) for f in found) >= 0.98 * (shard.unit @ shard.unit.T >= 0.95).sum()


class Blind(hnsw.Shard):
    """A shard whose graph finds one match of each query at most."""

    def matches(self, q):
        if self.beam >= len(self.ids):
            return self.exact(q)
        return [f[:1] for f in self.exact(q)]


def test_audit_needs_no_near_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    shard = hnsw.Shard(np.arange(3000), x, 0.95, 0.995)
    q = shard.planted(500)
    assert shard.beam < 3000 and shard.recall >= 0.995
    best = (q @ shard.unit.T).max(1)
    assert best.min() > 0.95 - 1e-9 and np.median(best) < 0.98 and all(len(f) for f in shard.exact(q * (1 + 1e-12)))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 24)) * 0.01
    blind = Blind(np.arange(3000), x, 0.95, 0.9)
    assert blind.beam >= 3000 and blind.recall == 1


class Searching(hnsw.Shard):
    """A shard that may compare with all its vectors in its audit only."""

    inside = False

    def audit(self, recall):
        self.inside = True
        try:
            return super().audit(recall)
        finally:
            self.inside = False

    def exact(self, q):
        assert self.inside
        return super().exact(q)


@pytest.mark.parametrize("sparse", [False, True])
def test_graphs_find_the_links(sparse):
    """Near pairs among the table's own vectors over eight shards, or in one sparse shard of 20,000: the graphs' links are all there are."""
    rng = np.random.default_rng(8)
    if sparse:
        x, shards = rng.normal(size=(20_000, 32)), 1
    else:
        rows = duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()
        x, shards = np.array([v for (v,) in rows], np.float64), 8
    x = np.concatenate([x, x[:400] + rng.normal(size=(400, x.shape[1])) * 0.25 * np.linalg.norm(x[:400], axis=1, keepdims=True) / np.sqrt(x.shape[1])])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [np.flatnonzero(r) for r in unit[-400:] @ unit.T >= 0.95]
    assert sum(map(len, want)) > 600
    found = [set() for _ in want]
    for s in range(shards):
        ids = np.arange(s, len(x), shards)
        shard = Searching(ids, x[ids], 0.95, 0.995)
        assert shard.recall >= 0.995 and shard.beam < len(ids)
        for have, places in zip(found, shard.matches(unit[-400:])):
            have.update(ids[places].tolist())
    assert sum(map(len, found)) >= 0.995 * sum(map(len, want)) and all(f <= {*w.tolist()} for f, w in zip(found, want))


def test_questions_do_not_grow_with_the_shards(spark):
    """Eight times the vectors and shards: each vector still asks a few shards, not eight times as many."""
    x = np.random.default_rng(12).normal(size=(16_000, 64))
    asked = []
    for n in (2_000, 16_000):
        classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "id long, v array<float>")
        routes = hnsw.routers(classes, 0.95, 2, 250)
        assert len(routes[64].pivots) == n // 250
        rows = hnsw.dealt(classes, routes, 250)
        assert rows.filter("kind = 0").count() == n
        asked.append(rows.count() / n)
    assert asked[0] < asked[1] < 10


def test_pairs_meet_in_a_shard():
    """Pairs at the threshold, of a table with many pivots in one dense place: nearly all ask each other's shard, certainly where a pivot is near."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(6_000, 48))
    x[:1_500] = x[0] + rng.normal(size=(1_500, 48)) * 0.1
    order = rng.permutation(len(x))
    router = hnsw.Router(x[order[:120]], x[order[120:2_000]], 0.95)
    a = hnsw.unit_rows(x)
    b = hnsw.turned(a, rng.normal(size=a.shape), 0.95, rng)
    left, right = router.shards(a), router.shards(b)
    met = np.array([p[0] in q or q[0] in p for p, q in zip(left, right)])
    assert met.mean() >= 0.998 and np.mean([len(p) for p in left[1_500:]]) < 15
    assert all(len(set(p.tolist())) == len(p) for p in left + right)


def test_links_over_many_shards(spark, monkeypatch):
    """Shards of 64 with pairs, a group that is cut into pieces, questions in blocks, and vectors between two groups, against brute force."""
    monkeypatch.setattr(hnsw, "QUERIES", 150)
    rng = np.random.default_rng(14)
    x = hnsw.unit_rows(rng.normal(size=(3_000, 32)))
    pairs = hnsw.turned(x[:300], rng.normal(size=(300, 32)), 0.95, rng)
    dense = x[400] + rng.normal(size=(500, 32)) * 0.01
    other = hnsw.turned(x[400:401], rng.normal(size=(1, 32)), 0.85, rng)[0]
    ring = other + rng.normal(size=(300, 32)) * 0.01
    between = hnsw.unit_rows(x[400] + other + rng.normal(size=(30, 32)) * 0.02)
    y = np.concatenate([x, pairs, dense, ring, between, -np.zeros((1, 32)) + [[0.0] * 31 + [1.0]], [[-0.0] * 31 + [1.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>")
    out = hnsw.near_vectors(df, shard_rows=64).toPandas().set_index("vec_id").sort_index()
    u = hnsw.unit_rows(y)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = out["n_links"].to_numpy()
    assert len(out) == len(y) and (got <= want).all() and (got != want).sum() <= 2
    first = out["component_id"].to_numpy()
    assert len(set(first[3_300:4_130])) == 1 and first[-1] == first[-2] == len(y) - 2


def test_members_find_themselves():
    """Some points of a graph are hard to reach from its top; its own points start where they are."""
    rng = np.random.default_rng(16)
    shard = hnsw.Shard(np.arange(2_048), rng.normal(size=(2_048, 64)), 0.95, 0)
    found = shard.matches(shard.unit, np.arange(2_048))
    assert all(f.tolist() == [i] for i, f in enumerate(found))
    assert sum(len(f) for f in shard.matches(shard.unit)) < 2_048


def test_near_copies_do_not_hide_a_shard():
    """Near copies that fill any beam: the audit gives the graph up soon, and the shard is compared in full."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(1_800, 64))
    x[:600] = x[0] + rng.normal(size=(600, 64)) * 0.2 * rng.random((600, 1))
    x[1_700:] = x[700:800] + rng.normal(size=(100, 64)) * 0.1
    shard = hnsw.Shard(np.arange(1_800), x, 0.95, 0.999)
    assert shard.beam <= 8 * hnsw.BEAM or shard.beam == 1_800
    assert shard.recall >= 0.999 and sum(map(len, shard.matches(shard.unit))) >= 0.999 * (shard.unit @ shard.unit.T >= 0.95).sum()


def test_graph_forest():
    """One large group of near copies gives a forest, not pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24))
    x[100:] = x[0] + rng.normal(size=(800, 24)) * 0.05
    shard = hnsw.Shard(np.arange(900), x, 0.95, 0.99)
    found = shard.matches(shard.unit)
    left, right = hnsw.joined(np.arange(900), shard.ids, shard.ids, found)
    assert sum(map(len, found)) > 600_000 and len(left) < 2 * 900 and (left != right).all()
    parent = {i: i for i in range(900)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(left, right):
        parent[root(a)] = root(b)
    assert len({root(i) for i in [0, *range(100, 900)]}) == 1 and len({root(i) for i in range(900)}) == 100


# 7


def test_near_duplicates(spark, docs, hard):
    import random

    rng = random.Random(2)
    words = docs.filter("doc_id = 1").first()["text"].split()
    copies = []
    for i in range(120):
        w = list(words)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{i}"
        copies.append((5000 + i, " ".join(w)))
    rows = docs.select("doc_id", "text").union(hard.select("doc_id", "text")).union(spark.createDataFrame(copies, "doc_id long, text string"))
    out = jaccard.near_duplicates(rows.withColumn("cid", F.lit("clash"))).toPandas()
    got = collections.Counter((whole(k), whole(c), int(n)) for k, c, n in zip(out.doc_id, out.class_id, out.n_links))
    assert got == near_brute([tuple(r) for r in rows.collect()])
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_word_hashes_over_pieces():
    text = ("ab cd " * 10 + "q" * 2_300_000 + " ab  cd ").encode()
    h = jaccard.word_hashes(text)
    assert len(h) == len(text.split()) and h[0] == h[-2] and h[1] == h[-1] and len(set(h.tolist())) == 3


def test_runs_reach_the_recall():
    """By simulation of embeddings and runs, not by the formula."""
    rng = np.random.default_rng(8)
    runs, pairs, extra = jaccard.runs_for(0.999, 0.8, jaccard.DEPTH), 20_000, 0.25
    equal = rng.random((pairs, jaccard.TOKENS)) < 0.8
    lost = np.ones(pairs, bool)
    for _ in range(runs):
        paths = np.ones(pairs, int)  # places of the tree where the pair still is together
        for _ in range(jaccard.DEPTH):
            share = equal.mean(1)
            draws = paths + rng.binomial(paths, extra)
            paths = rng.binomial(draws, share)
        lost &= paths == 0
    lost |= equal.sum(1) < jaccard.PROPOSE * jaccard.TOKENS
    assert lost.mean() <= 0.0015


def test_recall_of_planted_pairs(spark):
    """A thousand pairs just above the threshold (178 of 222 runs of words shared): all but a few are found."""
    rows = []
    for i in range(1_000):
        words = [f"{i}w{k}" for k in range(204)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:182] + [f"{i}z{k}" for k in range(22)]))]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [r for r in out if r["n_links"] == 1 and r["class_id"] == r["doc_id"] // 2 * 2]
    assert len(found) >= 2 * 996 and all(r["n_links"] in (0, 1) for r in out) and {r["set_size"] for r in out} == {200}


def test_repeated_rows_count_once(spark):
    """Near copies over several blocks, each row five times, some far from the pivot."""
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):
        w = list(words)
        at = rng.randrange(100)
        for k in range(rng.randrange(0, 9)):
            w[at + k] = f"z{i}x{k}"
        rows += [(i, " ".join(w))] * (5 if i % 3 else 1)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert collections.Counter((k, c, n) for k, c, n in zip(out.doc_id, out.class_id, out.n_links)) == near_brute(rows)


def test_core_counts_as_members(spark):
    """A large group of near vectors with a ring around its core, and many copies."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=32)
    x = np.concatenate([base + rng.normal(size=(300, 32)) * 0.05, base + rng.normal(size=(200, 32)) * 0.22, rng.normal(size=(50, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist()) for i in range(0, 500, 7)]
    out = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=2, block=40 * hnsw.LEAST).toPandas().set_index("vec_id")
    y = np.array([v for _, v in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.95).sum(1) - 1
    assert want.max() > 300 and all(out.loc[k, "n_links"] == n for (k, _), n in zip(rows, want))


def test_graphs_survive_storage():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 16))
    x[1200:2400] = x[:1200] + rng.normal(size=(1200, 16)) * 0.02
    shard = hnsw.Shard(np.arange(2500), x, 0.95, 0.99)
    again = hnsw.Shard.loaded([{**p} for p in shard.stored()][::-1], 0.95)
    assert again.beam == shard.beam < 2500
    assert all((a == b).all() for a, b in zip(shard.matches(shard.unit), again.matches(again.unit)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (300, 300)] + [(1000, 1000 + k) for k in range(1, 80)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(51), 100]) and got[201] == 200 and 300 not in got and got[1079] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_rows_fill_their_blocks(spark):
    rng = np.random.default_rng(9)
    weight = {i: int(w) for i, w in enumerate(np.minimum(5_000, 10 * rng.pareto(0.7, 300) + 1))}
    rows = spark.createDataFrame([("g", i, w) for i, w in weight.items()], "grp string, id long, w long")
    met = block_pairs(rows, "grp", "id", 1_000, 8, weight=F.col("w")).toPandas()
    blocks = met[met.i == met.j].groupby("i").id.apply(list)
    assert sorted(sum(blocks, [])) == sorted(weight)
    assert all(sum(weight[k] for k in ids) - max(weight[k] for k in ids) < 1_000 for ids in blocks)
    assert len(met) == len(weight) * -(-sum(weight.values()) // 1_000)


def test_shared_counts_by_ranges(monkeypatch):
    rng = np.random.default_rng(10)
    pool = np.unique(rng.integers(0, 1 << 63, 4_000, np.uint64) * np.uint64(2))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 1, 7, 900, 2_500, 3_000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for size in (1 << 18, 1_000, 50):
        monkeypatch.setattr(jaccard, "RANGE", size)
        got = jaccard.shared_counts(sets)
        assert all(got[i, j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_a_block_of_long_texts_is_small():
    """Blocks of the longest texts, compared in a process whose memory is limited."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from quern.llm import jaccard as J
rng = np.random.default_rng(1)
base = np.unique(rng.integers(0, 1 << 63, 200_000, np.uint64) * np.uint64(2))
rows = 2 * (J.SET_ITEMS // len(base) + 1)  # two blocks of sets of 200,000 items, and one set more in each
loads = []
for _ in range(rows):
    s = base.copy()
    s[rng.choice(len(s), 5_000, replace=False)] += np.uint64(1)
    loads.append(J.packed(0, np.unique(s), s[:0]))
now = int(open('/proc/self/statm').read().split()[0]) * 4096
resource.setrlimit(resource.RLIMIT_AS, (now + 160_000_000, now + 160_000_000))
assert J.compare_sets(0.8)(loads).all()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env={**os.environ, "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"})


def test_block_pairs_meet_once(spark):
    rows = spark.createDataFrame([("g", i) for i in range(23)] + [("h", 100), ("h", 101)], "grp string, id long")
    pairs = collections.Counter()
    met = block_pairs(rows, "grp", "id", 5).toPandas()
    for (_, i, j), part in met.groupby(["grp", "i", "j"]):
        for a in part.itertuples():
            for b in part.itertuples():
                if a.id < b.id and (i == j or a.mine != b.mine):
                    pairs[(a.id, b.id)] += 1
    assert set(pairs.values()) == {1} and len(pairs) == 23 * 22 // 2 + 1


# 8


def test_mixing(docs, hard):
    out = mixing.mix(docs).toPandas()
    words = [r["text"] for r in docs.select("text").collect()]
    assert out["size"].sum() == sum(len((t or "").encode().split()) for t in words)
    by = out.groupby("source").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["given"]).all()
    assert by["target"].sum() == pytest.approx(out["size"].sum())
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 30).all()
    assert (out["taken"] <= 3 * out["size"]).all() and (out["rate"] <= 3).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    rough = mixing.mix(hard).toPandas()
    assert len(rough) == len(HARD) and (rough["taken"] <= 3 * rough["size"]).all()
    assert mixing.mix(hard.limit(0)).count() == 0


def test_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 90), (None, 900)]
    rows = spark.createDataFrame(sizes, "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    weight, cap = {"a": 1, "b": 2, "c": 3, None: 1}, {k: 3 * v for k, v in sizes}
    want, total = {}, 2000.0
    while True:
        free = [k for k in cap if k not in want]
        level = (total - sum(want.values())) / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > cap[k]]
        if not over:
            want |= {k: weight[k] * level for k in free}
            break
        want |= {k: cap[k] for k in over}
    assert got == pytest.approx(want)


def test_rates_solve_the_dual(spark):
    """Rates hit the targets, lie between 0 and the cap, and are bounded tilts of one multiplier for each source."""
    rows = spark.createDataFrame([(s, n) for s, k in (("a", 40), ("b", 9), (None, 25)) for n in [*range(1, k), 500] for _ in range(3)], "source string, size long")
    histogram = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    wanted = mixing.targets(rows)
    out = mixing.balance(histogram, wanted).toPandas()
    for _, g in out.groupby("source", dropna=False):
        target, size = g["target"].iloc[0], g["source_size"].iloc[0]
        assert (g["rate"] * g["n"] * g["size"]).sum() == pytest.approx(min(target, 3 * size), rel=1e-4) and g["rate"].between(0, 3).all()
        x = g["size"] * g["n_docs"].iloc[0] / size
        tilt = np.log(2 * g["rate"] / (3 - g["rate"]).clip(lower=1e-12)) / x
        if target < 2.99 * size:
            assert tilt.max() - tilt.min() < 1e-4 * max(1, abs(tilt).max())


@pytest.mark.parametrize("seed", range(3))
def test_rounding_misses_little(spark, seed):
    """Copies are whole, within the cap, and no change of one copy at one size brings a source nearer to its target."""
    rng = np.random.default_rng(seed)
    rows = [(s, int(z)) for s in ("a", "b", "c") for z in rng.choice([0, 1, 3, 7, 20, 55, 400], 30)]
    sizes = spark.createDataFrame(rows, "source string, size long")
    histogram = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    out = mixing.round_copies(mixing.balance(histogram, mixing.targets(sizes))).toPandas()
    assert (out["copies"] >= 0).all() and (out["copies"] <= 3 * out["n"]).all()
    for _, g in out.groupby("source"):
        miss = g["target"].iloc[0] - (g["copies"] * g["size"]).sum()
        better = [abs(miss - d * z) for z, c, n in zip(g["size"], g["copies"], g["n"]) if z for d in (1, -1) if 0 <= c + d <= 3 * n]
        assert abs(miss) <= min(better, default=abs(miss)) + 1e-6


# 9


def test_languages(spark, docs, hard):
    keyed = docs.withColumn("held", langid.held_out(F.col("doc_id")))
    model = langid.learn(keyed.filter("not held"))
    out = langid.identify(keyed, model).toPandas()
    held = out[out["held"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and out["score"].between(0, 1).all()
    rough = {whole(r["doc_id"]): r["lang_pred"] for r in langid.identify(hard, model).collect()}
    assert rough[1] == rough[2] == rough[6] == rough[9] == "und" and rough[7] != "und"
    assert langid.identify(hard, langid.learn(hard.limit(0))).filter("lang_pred <> 'und'").count() == 0
    one = langid.learn(spark.createDataFrame([(1, "hello there", "xx")], "doc_id long, text string, lang string"))
    assert one.predict("anything") == ("xx", 1.0) and one.predict("1 2") == ("und", 0.0)


def test_votes():
    """Families before languages; the most votes win, ties go to the larger summed margin, then to the first by code."""
    x = np.zeros((12, langid.SIZE), np.float32)
    names = ["de", "en", "es", "fr", "it", "zz"] * 2
    for i, name in enumerate(names):
        x[i, sorted(set(names)).index(name)] = 1
    model = langid.fit(x, names)
    assert {frozenset(p) for p in model.machines} >= {frozenset(("germanic", "romance")), frozenset(("de", "en")), frozenset(("fr", "it"))}
    assert frozenset(("de", "fr")) not in model.machines
    again = langid.fit(x[::-1].copy(), names[::-1])
    assert set(again.machines) == set(model.machines)


def test_ties_of_votes():
    one = np.zeros(langid.SIZE, np.float32)
    machine = lambda yes, no, bias: langid.Svm(yes, no, one, bias)
    ring = {frozenset("ab"): machine("a", "b", 1.0), frozenset("bc"): machine("b", "c", 2.0), frozenset("ca"): machine("c", "a", 3.0)}
    model = langid.Model({"f": ["a", "b", "c"]}, ring)
    assert model.predict("text")[0] == model._choose(["a", "b", "c"], one)[0]
    margins = {"a": 1.0 - 3.0, "b": 2.0 - 1.0, "c": 3.0 - 2.0}
    assert model._choose(["a", "b", "c"], one)[0] == max("abc", key=lambda n: margins[n])
    even = {k: langid.Svm(m.yes, m.no, one, 1.0) for k, m in ring.items()}
    assert langid.Model({"f": ["a", "b", "c"]}, even)._choose(["a", "b", "c"], one)[0] == "a"


# 10


def test_repeats(spark, docs, hard):
    passage = docs.filter("doc_id = 3").first()["text"][:120]
    extra = [(700 + i, f"{'abcde fgh'[: i % 9]}{passage}{i}", None, None, None) for i in range(300)] + [(10, "q" * 49, None, None, None), (11, "q" * 51, None, None, None), (12, "ab" * 200, None, None, None), (13, "x" + "ab" * 100, None, None, None)]
    slim = hard.select(docs.columns).filter("doc_id is null or doc_id <> 5")
    rows = docs.unionByName(slim).union(spark.createDataFrame(extra, SCHEMA))
    out = substrings.remove_repeats(rows.withColumn("spans", F.lit("clash")).withColumn("__key", F.lit("clash"))).toPandas()
    got = collections.Counter((whole(k), b, n, len(s), hashlib.sha256(x).hexdigest()) for k, b, n, s, x in zip(out.doc_id, out.n_bytes, out.n_removed, out.spans, out.kept))
    assert got == strip_brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_anchors_are_local(seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(97, 100, 2000).astype(np.uint8).tobytes()
    chosen = {}
    plain = lambda x: (np.frombuffer(x, np.uint8), np.array([0, len(x)]))
    for h, p, a, b, _ in zip(*substrings.anchors(*plain(raw))):
        for s in range(a, b + 1):
            chosen[s] = (h, p - s)
    assert sorted(chosen) == list(range(len(raw) - 49))
    for s in range(0, len(raw) - 49, 37):
        h, p, *_ = substrings.anchors(*plain(raw[s : s + 50]))
        assert (h[0], p[0]) == chosen[s]


def test_strings_stay_in_their_texts():
    texts = [b"", b"x" * 49, b"abc" * 40, b"", b"y" * 50, b"z" * 10]
    offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, _, first, last, owner = substrings.anchors(np.frombuffer(b"".join(texts), np.uint8), offset)
    starts = sorted((int(o), s - offset[o]) for a, b, o in zip(first, last, owner) for s in range(a, b + 1))
    assert starts == [(2, k) for k in range(71)] + [(4, 0)]
