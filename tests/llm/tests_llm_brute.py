"""Hard rows, and what the operators must give, computed plainly."""

import collections
import hashlib

import numpy as np

from quern.llm import substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 12_000
HARD = [
    (1, "", "en", "a", 0), (2, None, "en", "a", None), (None, "null key " * 20, None, None, None), (3, LONG, "en", "a", 1), (4, LONG, "de", None, 1), (4, LONG, "de", None, 1),
    (5, "x" * 70_000, "en", "b", 1), (6, " " * 5_000, "en", "b", 1), (7, "\x00\u0085\u00a0 日本語 \U0001f600 end", "fr", "", 1), (8, "one\ntwo\none\n\n", None, "b", 1), (9, "12345 !!", "es", "a", 1),
]


def near_brute(rows):
    sets, where = [], collections.defaultdict(list)
    for i, (_, text) in enumerate(rows):
        w = (text or "").encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set())
        for g in sets[-1]:
            where[g].append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in where[g] if j != i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return collections.Counter((k, low.get(find(i)), links[i]) for i, (k, _) in enumerate(rows))


def strip_brute(rows):
    key = lambda k: substrings.LAST_KEY if k is None else k
    first = {}
    for k, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            first[w] = min(first.get(w, key(k)), key(k))
    out = collections.Counter()
    for k, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key(k):
                gone[i + 1 : i + 51] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes()
        out[(k, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out
