"""Folds in pieces against folds in one walk."""

import random

import pytest

from quern.operators import folds, layout
from quern.streaming import replies

POINTS = "pen long, n long, x double, y double"


def points(seed):
    rng = random.Random(seed)
    rows, x, y = [], 0.0, 0.0
    for n in range(600):  # one long stroke that creeps, stands still and leaps
        kind = n // 60 % 4
        dx = [rng.uniform(-0.2, 0.25), 0.0, rng.uniform(-3, 3), 0.05][kind]
        x, y = x + dx, y + rng.uniform(-0.1, 0.1) * (kind != 1)
        rows.append((1, n, x, y))
    rows += [(2, n, 5.0, 5.0) for n in range(200)] + [(None, n, float(n % 2), 0.0) for n in range(30)] + [(3, 0, 1.0, 1.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("pieces", [1, 6, 40])
def test_steady_in_pieces(spark, pieces):
    df = spark.createDataFrame(points(pieces), POINTS)
    kept = lambda d: sorted((r["pen"] or 0, r["n"], r["x"]) for r in d.collect())
    want = kept(layout.steady(df.fillna({"pen": 0}), ["pen"], ["n"]))
    got = folds.steady(df, ["pen"], ["n"], layout.TREMOR, pieces)
    assert kept(got) == want and 100 < len(want) < 500
    assert folds.steady(df.limit(0), ["pen"], ["n"], layout.TREMOR, pieces).count() == 0


@pytest.mark.parametrize("pieces", [1, 7, 30])
def test_streams_in_pieces(spark, pieces):
    rng = random.Random(pieces)
    parts = ["plain text. ", "<b>bold</b> ", "<thinking>", "</thinking>", "x" * 30, " ", "\n\n", "<", "> ", "*_", "⟦", "⟧\n", "< notes and more", "<scratchpad>" + "s" * 60 + "</scratchpad>"]
    rows = []
    for stream in range(4):
        text = ("⟦said⟧\n" if stream % 2 else "") + "".join(rng.choices(parts, k=250))
        at = sorted(rng.sample(range(1, len(text)), 220))
        rows += [(stream, i, text[a:b]) for i, (a, b) in enumerate(zip([0, *at], [*at, len(text)]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string")
    same = lambda d: sorted(map(tuple, d.collect()))
    assert same(folds.split_streams(df, pieces)) == same(replies.split_streams(df))


def test_a_state_that_never_forgets(spark):
    """A sum: every guess is wrong, and the rounds end all the same with the sequential result."""
    df = spark.createDataFrame([(1, n, float(n)) for n in range(40)], "k long, n long, v double")
    feed = lambda state, row: (state + row[2], [(row[1], state + row[2])])
    out = folds.folded(df, ["k"], ["n"], "n long, s double", feed, 0.0, lambda row: -1.0, pieces=5)
    assert {r["n"]: r["s"] for r in out.collect()} == {n: n * (n + 1) / 2 for n in range(40)}
