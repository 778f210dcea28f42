"""Operator 7: n-gram Jaccard join by chosen paths.

A text's set holds the hashes of its runs of five words (a shorter text has one, of all its words). Equal sets
are one class. Each class has a MinHash embedding: equal entries of two embeddings are shared tokens, and
their share estimates the Jaccard similarity.

The join repeats runs of a random recursion. A run's root holds all classes; a node samples one of the 64
coordinates, or with a chance two, so that 1.25 = 1 / 0.8 are expected, and sends each class to the child named by its
token there. Nodes of one class end. Nodes within ``LEAF`` are compared by sketches at once. Larger ones are split
on, ``DEPTH`` times at most; what is then still too large is compared in blocks. A pair at the
threshold survives a run of that depth with a known chance, and runs are repeated until the chance to miss it in
all of them is below 1 - ``RECALL``.

Sketches only propose. Classes joined by proposals form candidate groups; each group's full sets meet in
blocks of ``SET_ITEMS`` items, where every pair of the group is compared exactly. In a group of more than a block each set is sent
as its difference to the group's pivot, and sets that share nine tenths with the pivot link with each other for
certain and are counted as members (``link_counts``). Blocks return link counts and a spanning forest, not pairs.

Defined results: a null text or one without words is in no pair and is its own class; a null key counts as a
document, and a class of null keys only has a null id; repeated rows are documents of one class; a class's id is
its smallest key; texts are read whole, however long (a set takes 8 bytes for each word); ties don't matter, since
every pair at the threshold or above is a link; other columns of the input, whatever their names, are neither read
nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, small_batches, table
from .components import block_pairs, components, groups_in_partition, link_counts, ranked_groups, with_group

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
TOKENS, LEAF, DEPTH = 64, 64, 4
#: Sketch agreement from which a pair is proposed: four standard deviations below the threshold.
PROPOSE = 0.6
#: Rows of a block of sketches. Items of a block of sets, or of differences to a pivot; what a small set counts for, so that
#: a block is 256 rows at most; and items of a range of hashes that are counted at once.
SKETCH_BLOCK, SET_ITEMS, SET_LEAST, RANGE = 2_048, 1 << 20, 1 << 12, 1 << 18
#: Candidate classes that are broadcast at most (about 56 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 400_000
_P, _P_BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _RNG.integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
PIECE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, PIECE + 1), _powers(_P_BACK, PIECE + 1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, from running polynomial sums over pieces that end at blanks."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            cuts = np.flatnonzero(_BLANK[np.frombuffer(raw, np.uint8, end - at, at)])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:  # a word longer than a piece
                rest = raw[at:].split(None, 1)[0]
                out.append(mix(np.array([hash_long(rest)], np.uint64)))
                at += len(rest)
                continue
        b = np.frombuffer(raw, np.uint8, end - at, at)
        solid = ~_BLANK[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)], dtype=np.uint64)])
        out.append(mix((sums[stop] - sums[start]) * _DOWN[start]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hash_long(word: bytes) -> int:
    total = 0
    for at in range(0, len(word), PIECE):
        b = np.frombuffer(word[at : at + PIECE], np.uint8).astype(np.uint64) + np.uint64(1)
        part = int((b * _UP[: len(b)]).sum(dtype=np.uint64))
        total = (total + part * pow(_P, at, 1 << 64)) % (1 << 64)
    return total


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``n`` words."""
    w = word_hashes((text or "").encode())
    n = min(n, len(w))
    if not n:
        return w
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total += w[k : len(w) - n + 1 + k] * _PLACES[k]
    return np.unique(mix(total))


def embed(s: np.ndarray) -> np.ndarray:
    """The MinHash embedding: 64 tokens of 32 bits."""
    out = np.empty(TOKENS, np.uint32)
    for i in range(TOKENS):
        out[i] = ((s * _MULTIPLY[i]) >> np.uint64(32)).min() if len(s) else 0
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(s):
        return 0
    twice = mix(s + np.uint64(0xD1B54A32D192ED03))
    both = np.array([twice.sum(dtype=np.uint64) ^ np.uint64(len(s)), np.bitwise_xor.reduce(mix(twice))], np.uint64)
    h = mix(both) * np.array([1, _P], np.uint64)
    return int(np.bitwise_xor.reduce(h).astype(np.int64))


def packed(base: int, added: np.ndarray, removed: np.ndarray) -> bytes:
    """A set as its difference to a pivot of ``base`` items; without a pivot all its items are added."""
    return np.array([base, len(added)], np.uint64).tobytes() + added.tobytes() + removed.tobytes()


def unpacked(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.uint64)
    return int(x[0]), x[2 : 2 + int(x[1])], x[2 + int(x[1]) :]


def signature(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Each text's class, set size and embedding."""
    for batch in texts:
        out = []
        for t in batch:
            s = shingles(t)
            out.append((class_of(s), len(s), embed(s).tobytes() if len(s) else b""))
        yield pd.DataFrame(out, columns=["cid", "size", "tokens"])
    released()


def whole_set(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Each text's class and its whole set."""
    for batch in texts:
        sets = [shingles(t) for t in batch]
        yield pd.DataFrame({"cid": [class_of(s) for s in sets], "items": [packed(0, s, s[:0]) for s in sets]})
    released()


def survival(share: float, similarity: float, depth: int) -> float:
    """The chance that a pair with that share of equal coordinates stays together on some path of a run."""
    extra = 1 / similarity - 1
    lost = 0.0
    for _ in range(depth):
        apart = 1 - share * (1 - lost)
        lost = (1 - extra) * apart + extra * apart**2
    return 1 - lost


def missed(runs: int, similarity: float, depth: int) -> float:
    """The chance to miss a pair at the threshold in so many runs, over the number of coordinates that it happens to share."""
    total = 0.0
    for k in range(TOKENS + 1):
        chance = math.comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k)
        total += chance * (1.0 if k < PROPOSE * TOKENS else (1 - survival(k / TOKENS, similarity, depth)) ** runs)
    return total


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """The runs that reach the recall, but for what no number of runs would find (pairs whose sketches differ)."""
    least = missed(1 << 20, similarity, depth)
    return next(n for n in range(1, 1 << 20) if missed(n, similarity, depth) <= max(1 - recall, 1.01 * least))


def children(similarity: float):
    """(node, tokens) to the child nodes: the coordinates are drawn from the node's own hash."""
    extra = 1 / similarity - 1

    @F.pandas_udf("array<long>")
    def run(nodes: pd.Series, tokens: pd.Series) -> pd.Series:
        node = nodes.to_numpy(np.int64).astype(np.uint64)
        t = np.frombuffer(b"".join(tokens), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
        draw = mix(node + np.uint64(_P))
        one = (draw % np.uint64(TOKENS)).astype(np.int64)
        two = (one + 1 + ((draw >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
        both = (draw >> np.uint64(32)).astype(np.float64) / 2**32 < extra
        rows = np.arange(len(node))
        a, b = (mix(mix(node ^ np.uint64(k)) + mix(t[rows, k] + (k.astype(np.uint64) << np.uint64(40)))).astype(np.int64) for k in (one, two))
        return pd.Series([[x, y] if z else [x] for x, y, z in zip(a, b, both)])

    return run


def leaf_pairs(propose: float, similarity: float):
    """Proposed pairs of classes in small nodes; rows come sorted by node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = whole["node"].iloc[-1] if len(whole) else None
            rest = whole[whole["node"] == last]
            yield compare(whole[whole["node"] != last], propose, similarity)
        if rest is not None:
            yield compare(rest, propose, similarity)
        released()

    return run


def compare(rows: pd.DataFrame, propose: float, similarity: float) -> pd.DataFrame:
    node, cid, size = (rows[c].to_numpy() for c in ("node", "cid", "size"))
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, TOKENS)
    found = []
    for d in range(1, len(node)):
        i = np.flatnonzero(node[d:] == node[:-d])
        if not len(i):
            break
        close = np.minimum(size[i], size[i + d]) >= similarity * np.maximum(size[i], size[i + d])
        i = i[close]
        i = i[(sketch[i] == sketch[i + d]).mean(1) >= propose] if len(i) else i
        found.append(np.stack([cid[i], cid[i + d]], 1))
    both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    both = np.unique(np.sort(both, 1), axis=0)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def sketch_blocks(propose: float, similarity: float):
    """Proposals inside a large node, for two of its blocks: a spanning forest of them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cid, size = group["cid"].to_numpy(), group["size"].to_numpy()
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, TOKENS)
        left = np.arange(len(cid))
        roots, todo = {}, np.ones(len(cid), bool)
        for i in left:
            if not todo[i]:
                continue
            front = [i]
            todo[i] = False
            while front:
                k = front.pop()
                near = np.flatnonzero(todo)
                near = near[np.minimum(size[near], size[k]) >= similarity * np.maximum(size[near], size[k])]
                near = near[(sketch[near] == sketch[k]).mean(1) >= propose]
                todo[near] = False
                front.extend(near.tolist())
                roots.update((int(x), int(i)) for x in near)
        return pd.DataFrame({"a": cid[list(roots.values())].astype("int64"), "b": cid[list(roots)].astype("int64")})

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of sorted sets, from products of 0/1 matrices over the items that two sets have.

    Hashes are spread evenly, so the sets are cut at the same hashes into ranges that are counted one after the other.
    """
    total = np.zeros((len(sets), len(sets)), np.float64)
    ranges = -(-sum(map(len, sets)) // RANGE)
    ends = [np.uint64((k << 64) // ranges) for k in range(1, ranges)]
    cuts = [np.concatenate([[0], np.searchsorted(s, ends), [len(s)]]).astype(np.int64) for s in sets]
    wide = max(256, 1_000_000 // max(1, len(sets)))
    for k in range(ranges):
        parts = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in parts])
        _, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        rank = np.cumsum(count > 1) - 1
        use = count[at] > 1
        owner, at = owner[use], rank[at[use]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
            a, b = np.searchsorted(at, [low, low + wide])
            m = np.zeros((len(sets), min(wide, int(at[-1]) + 1 - low)), np.float32)
            m[owner[a:b], at[a:b] - low] = 1
            total += m @ m.T
    return total


def relate(similarity: float):
    """Sets as differences to their group's pivot; the core within half of the distance, what is near within one and a half."""
    apart = 1 - similarity

    def run(pivot: bytes, loads: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        _, base, _ = unpacked(pivot)
        out, share = [], []
        for raw in loads:
            _, s, _ = unpacked(raw)
            added, removed = np.setdiff1d(s, base, True), np.setdiff1d(base, s, True)
            out.append(packed(len(base), added, removed))
            share.append((len(s) - len(added)) / (len(base) + len(added)))
        share = np.array(share)
        return out, share >= 1 - apart / 2, share >= 1 - 1.5 * apart - 1e-9

    return run


def compare_sets(similarity: float):
    """Which of these sets link, exactly."""

    def run(loads: list[bytes]) -> np.ndarray:
        base, added, removed = zip(*map(unpacked, loads))
        base = np.array(base, np.float64)
        n_added, n_removed = (np.array([len(x) for x in part], np.float64) for part in (added, removed))
        size = base - n_removed + n_added
        # Both hold what the pivot has and neither lacks, and what both add.
        both = base[:, None] - (n_removed[:, None] + n_removed[None, :] - shared_counts(list(removed))) + shared_counts(list(added))
        return both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9

    return run


def propose(classes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """Pairs (a, b) of classes that chosen paths bring together and whose sketches agree."""
    runs = runs_for(recall, similarity, depth)
    child = children(similarity)
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = classes.select("cid", "size", "sketch")
    roots = classes.withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(runs)).cast("array<long>")))
    rows = cut(roots.select("cid", F.explode(child("node", "tokens")).alias("node")))
    pairs = None
    for level in range(1, depth + 1):
        live = cut(with_group(rows, "node", F.count(F.lit(1)).alias("n")).filter("n > 1"))
        small = live.filter(F.col("n") <= leaf).select("node", "cid").join(slim, "cid")
        near = small.repartition(n, "node").sortWithinPartitions("node").mapInPandas(leaf_pairs(PROPOSE, similarity), "a long, b long")
        pairs = near if pairs is None else pairs.union(near)
        big = live.filter(F.col("n") > leaf).select("node", "cid")
        if big.isEmpty():
            break
        if level == depth:
            met = block_pairs(big.join(slim, "cid"), "node", "cid", SKETCH_BLOCK)
            keys = ["node", "i", "j"]
            met = met.repartition(n, *keys).sortWithinPartitions(*keys)
            pairs = pairs.union(met.mapInPandas(groups_in_partition(sketch_blocks(PROPOSE, similarity), keys), "a long, b long"))
        else:
            rows = cut(big.join(classes.select("cid", "tokens"), "cid").select("cid", F.explode(child("node", "tokens")).alias("node")))
    return cut(pairs.distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each document: key, class_id (smallest key of its group), n_links, set_size."""
    spark = docs.sparkSession
    small_batches(spark)
    sign = F.pandas_udf(signature, "cid long, size int, tokens binary")
    full = F.pandas_udf(whole_set, "cid long, items binary")
    signed = table(docs.select(F.col(key).alias("__key"), sign(F.col(text)).alias("s")).select("__key", "s.*"), "signed")
    sketch = F.expr("transform(sequence(0, 63), i -> substring(tokens, 4 * i + 1, 1))")
    classes = signed.filter("size > 0").groupBy("cid").agg(
        F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.min("__key").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    classes = table(classes.withColumn("sketch", F.aggregate(sketch, F.lit(b""), lambda a, x: F.concat(a, x))), "classes")
    proposed = propose(classes, similarity, recall)
    grouped = cut(components(proposed)).withColumnRenamed("component", "group")
    wanted = grouped.join(classes.select("cid", "rep", "copies", "size"), F.col("id") == F.col("cid"))
    wanted = ranked_groups(wanted, F.greatest("size", F.lit(SET_LEAST)))
    wanted = cut(wanted.select(F.col("cid").alias("__cid"), F.col("rep").alias("__rep"), "copies", "group", "rank", "n"))
    count = wanted.count()
    side = F.broadcast(wanted) if count <= BROADCAST_CLASSES else wanted
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(side, F.col("__key").eqNullSafe(F.col("__rep")))
    sets = texts.withColumn("w", full("__text")).filter(F.col("w.cid") == F.col("__cid"))
    # A repeated row, or a key that stands for several rows, gives its class once.
    sets = sets.select(F.col("w.cid").alias("id"), F.col("__rep").alias("rep"), "copies", "group", "rank", "n", F.col("w.items").alias("load")).dropDuplicates(["id"])
    weight = F.greatest(F.octet_length("load") / 8, F.lit(SET_LEAST))
    checked = cut(link_counts(table(sets, "sets"), "binary", relate(similarity), compare_sets(similarity), weight, SET_ITEMS))
    links = checked.groupBy(F.col("id").alias("cid")).agg(F.sum("links").alias("links"))
    same = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = cut(same.join(classes.select(F.col("cid").alias("id"), "rep"), "id"))
    joined = with_group(named, "component", F.min("rep").alias("class_id")).select(F.col("id").alias("cid"), "class_id")
    about = classes.select("cid", "rep", "copies").join(links, "cid", "left").join(joined, "cid", "left")
    about = table(about.select("cid", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "about")
    empty = F.col("size") == 0
    out = signed.select("__key", "cid", "size").join(about, "cid", "left")
    return out.select(
        F.col("__key").alias(key),
        F.when(empty, F.col("__key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.col("size").cast("long").alias("set_size"),
    )
