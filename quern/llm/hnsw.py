"""Operator 6: near-duplicate vectors by navigable small-world graphs per shard.

Equal vectors are one class. A sample of the classes are pivots, one for each shard; a class is a member of its nearest
pivot's shard, and asks every shard whose pivot is nearly as near. So a class's searches don't grow with the number of shards,
but with that of the pivots near it. How near is near enough (``Router``) is measured on planted pairs: a pair is found if
either end asks the other's shard. A shard builds its own hierarchical navigable small-world graph of its members, audits it,
and answers its own members and those who ask. A shard with too many members is cut by a hash, and its queries ask
every piece; too many queries are dealt in blocks.

A query keeps a beam of the best candidates and expands them until none is left. A beam that is full of matches may
hide more of them, so such a query is searched again with a beam twice as wide, and compared with its whole shard once that
costs less than the search. The beam of a shard is widened until its audit passes: members of the shard, turned by a random
angle so that their cosine is at the threshold or little above it, are compared with the whole shard, and the graph must find
their matches. So every shard has matches to be measured by, however few its vectors have among themselves. The recall
reached stands in the table ``searched`` beside the links.

A task returns a spanning forest of what its queries found, not the pairs. The forests' components are candidate
groups, in which every cosine is taken in double precision: in blocks, but for vectors within half of the angle of
a large group's pivot, which link with each other for certain and are counted as members (``link_counts``).

Defined results: a vector that is null, empty, zero or holds null, NaN or infinite components links with nothing and
is its own component; vectors of different lengths never link; a null id links like any other vector, but its own
component is the smallest id that isn't null; repeated rows count as vectors of their own; ties don't matter, since
every pair at the threshold or above is a link; texts and other columns of the input, whatever their
names, are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, table
from .components import components, link_counts, ranked_groups, with_group

SIMILARITY, RECALL = 0.95, 0.995
#: Shards at least where each gets FEW vectors, vectors and numbers of a shard on average, and how many times as many it has before it is cut.
SHARDS, FEW, SHARD_ROWS, SHARD_NUMBERS, CUT = 8, 64, 2_048, 12_800_000, 4
#: Share of planted pairs that meet in a shard, pairs planted, sampled vectors for them, and numbers of pivots and samples in all at most.
MEET, PAIRS, SAMPLE, PIVOT_NUMBERS = 0.9995, 32_768, 2_048, 4_000_000
DEGREE, BUILD_BEAM, BEAM = 12, 24, 8
#: A search of beam b takes as long as comparing with the whole shard where that has about so many times b vectors (measured).
SCAN = 1_400
#: Planted queries of an audit, how many of its matches one may count for, and queries searched together.
PLANTED, EACH, TOGETHER = 1_024, 10, 512
#: Similarities held at once; numbers of a block of a candidate group, and what a short vector counts for, so that a block is
#: 1,024 vectors at most; vectors of a block of queries at most; numbers of a stored piece of a graph.
CELLS, BLOCK, LEAST, QUERIES, PIECE = 16_000_000, 1 << 16, 64, 100_000, 1 << 18


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def turned(u: np.ndarray, w: np.ndarray, similarity: float, rng: np.random.Generator) -> np.ndarray:
    """Unit rows ``u`` turned towards ``w`` to a cosine at the similarity, or up to two fifths of the way from it to one."""
    w = w - (w * u).sum(1, keepdims=True) * u
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-30)
    cosine = similarity + (1 - similarity) * rng.uniform(0, 0.4, (len(u), 1))
    return unit_rows(cosine * u + np.sqrt(1 - cosine**2) * w)


class Router:
    """Pivots of vectors of one length. A vector's own shard is its nearest pivot's; it asks those at most ``slack`` of a cosine farther.

    Two vectors at an angle meet for certain if each asks all pivots that are farther than its own by no more than that angle: the one
    that is farther from its own pivot is within that of the other's. Nothing beyond is asked; below it, the slack is the least with which
    the share MEET of planted pairs meet, half of them turned at random and half towards other vectors.
    """

    def __init__(self, pivots: np.ndarray, members: np.ndarray, similarity: float, share: float = MEET):
        self.pivots = unit_rows(pivots).astype(np.float32)
        self.angle, self.slack = math.acos(similarity), 2.0
        rng = np.random.Generator(np.random.PCG64(7))
        members = unit_rows(members)
        lost = []
        for low in range(0, PAIRS, 1_024):
            m = members[rng.integers(0, len(members), 1_024)]
            w = rng.normal(size=m.shape)
            w[::2] = members[rng.integers(0, len(members), 512)]
            lost.append(self.lost(m, turned(m, w, similarity, rng)))
        self.slack = float(np.sort(np.concatenate(lost))[math.ceil(share * PAIRS) - 1]) + 1e-6

    def lost(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slack with which each pair of unit rows meets."""
        near = [x.astype(np.float32) @ self.pivots.T for x in (a, b)]
        own = [x.argmax(1) for x in near]
        rows, out = np.arange(len(a)), np.full(len(a), 2.0)
        for x, mine, other in ((near[0], own[0], own[1]), (near[1], own[1], own[0])):
            best, there = x[rows, mine], x[rows, other]
            out = np.where(there >= self.least(best), np.minimum(out, best - there), out)
        return out

    def least(self, best: np.ndarray) -> np.ndarray:
        """The cosine of a pivot that is asked, by that of the nearest one."""
        return np.maximum(best - self.slack, np.cos(np.minimum(math.pi, np.arccos(np.clip(best, -1, 1)) + self.angle)) - 1e-5)

    def shards(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The shards of each row, its own first."""
        out: list = []
        step = max(1, CELLS // len(self.pivots))
        for low in range(0, len(vectors), step):
            near = unit_rows(vectors[low : low + step].astype(np.float64)).astype(np.float32) @ self.pivots.T
            own, rows = near.argmax(1), np.arange(len(near))
            asked = near >= self.least(near[rows, own])[:, None]
            asked[rows, own] = False
            row, shard = np.nonzero(asked)
            ends = np.cumsum(np.bincount(row, minlength=len(near)))
            out += [np.concatenate(([o], shard[a:b])).astype(np.int32) for o, a, b in zip(own, [0, *ends[:-1]], ends)]
        return out


class Graph:
    """One shard's graph. Points are unit rows; nearer means a larger product."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.n, self.degree = points, len(points), degree
        if links is not None:
            self.links, self.top, self.entry = links, len(links) - 1, entry
            return
        rng = np.random.Generator(np.random.PCG64(11))
        levels = np.floor(-np.log(1 - rng.random(self.n)) / np.log(degree)).astype(int)
        self.top = int(levels.max()) if self.n else 0
        self.links = [np.full((self.n, degree * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(self.top + 1)]
        order = np.argsort(-levels, kind="stable")  # the sparse levels first
        self.entry = int(order[0]) if self.n else 0
        done = 1
        while done < self.n:
            block = order[done : done + max(64, min(TOGETHER, done // 2))]
            self._insert(block, levels, order[:done], beam)
            done += len(block)

    def _insert(self, block: np.ndarray, levels: np.ndarray, old: np.ndarray, beam: int) -> None:
        q = self.x[block]
        start = np.full((len(block), 1), self.entry)
        for lv in range(self.top, -1, -1):
            mine = levels[block] >= lv
            found, _ = self.search(q, start, lv, beam if mine.any() else 1)
            start = found[:, : max(1, min(4, found.shape[1]))]
            if not mine.any():
                continue
            rows = np.flatnonzero(mine)
            near = q[rows] @ q[rows].T
            np.fill_diagonal(near, -2)
            best = np.argsort(-near, 1)[:, :beam]
            inside = np.where(np.take_along_axis(near, best, 1) > -2, block[rows][best], -1)
            picked = self._diverse(block[rows], np.concatenate([found[rows], inside], 1), self.degree)
            self.links[lv][block[rows], : self.degree] = picked
            self._back(block[rows], picked, lv)

    def _back(self, new: np.ndarray, picked: np.ndarray, lv: int) -> None:
        """Add the reverse links; a node with too many keeps a diverse choice."""
        a, b = picked.ravel(), np.repeat(new, picked.shape[1])
        a, b = a[a >= 0], b[picked.ravel() >= 0]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        node, at, count = np.unique(a, return_index=True, return_counts=True)
        extra = np.full((len(node), int(count.max()) if len(count) else 0), -1)
        extra[np.repeat(np.arange(len(node)), count), np.arange(len(a)) - np.repeat(at, count)] = b
        have = self.links[lv][node]
        extra[(extra[:, :, None] == have[:, None, :]).any(2)] = -1  # two new points may choose each other
        both = np.concatenate([have, extra], 1)
        room = (both >= 0).sum(1) <= have.shape[1]
        width = have.shape[1]
        if room.any():
            packed = np.take_along_axis(both[room], np.argsort(both[room] < 0, 1, kind="stable"), 1)
            self.links[lv][node[room]] = packed[:, :width]
        if (~room).any():
            self.links[lv][node[~room]] = self._diverse(node[~room], both[~room], width)

    def _diverse(self, of: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """For each point the nearest candidates that are nearer to it than to one already chosen, then the rest."""
        out = np.full((len(of), most), -1, np.int32)
        for low in range(0, len(of), 128):
            own, c = of[low : low + 128], candidates[low : low + 128]
            sims = np.einsum("bkd,bd->bk", self.x[c], self.x[own])
            sims[(c < 0) | (c == own[:, None])] = -3
            order = np.argsort(-sims, 1)
            c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
            again = np.zeros(c.shape, bool)
            again[:, 1:] = (c[:, 1:] == c[:, :-1])
            ok = (sims > -3) & ~again
            x = self.x[c]
            among = x @ x.transpose(0, 2, 1)
            chosen = np.zeros(c.shape, bool)
            for k in range(c.shape[1]):
                rival = np.where(chosen, among[:, k, :], -3).max(1)
                chosen[:, k] = ok[:, k] & (rival < sims[:, k]) & (chosen.sum(1) < most)
            rank = np.where(chosen, 0, np.where(ok, 1, 2))
            take = np.argsort(rank, 1, kind="stable")[:, :most]
            got = np.where(np.take_along_axis(rank, take, 1) < 2, np.take_along_axis(c, take, 1), -1)
            out[low : low + 128, : got.shape[1]] = got
        return out

    def search(self, q: np.ndarray, start: np.ndarray, lv: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step; (ids, similarities), best first, -1 where there are fewer."""
        links, b = self.links[lv], len(q)
        seen = np.zeros((b, self.n + 1), bool)
        rows = np.arange(b)[:, None]
        ids = np.full((b, max(beam, start.shape[1])), -1, np.int64)
        ids[:, : start.shape[1]] = start
        sims = np.einsum("bkd,bd->bk", self.x[ids], q)
        sims[ids < 0] = -3
        seen[rows, ids] = True
        order = np.argsort(-sims, 1)
        ids, sims = np.take_along_axis(ids, order, 1)[:, :beam], np.take_along_axis(sims, order, 1)[:, :beam]
        open_ = ids >= 0
        live = np.flatnonzero(open_.any(1))
        while len(live):
            pick = open_[live].argmax(1)
            node = ids[live, pick]
            open_[live, pick] = False
            near = links[node].astype(np.int64)
            at = live[:, None]
            fresh = (near >= 0) & ~seen[at, near]
            seen[at, np.where(near >= 0, near, self.n)] = True
            s = np.einsum("bkd,bd->bk", self.x[near], q[live])
            s[~fresh] = -3
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam] if all_sims.shape[1] > beam else np.broadcast_to(np.arange(all_sims.shape[1]), all_sims.shape)
            by = np.take_along_axis(all_sims, best, 1)
            best = np.take_along_axis(best, np.argsort(-by, 1), 1)
            ids[live], sims[live], open_[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_open))
            live = live[open_[live].any(1)]
        return ids, sims

    def descend(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Search from the top; points of the graph, whose numbers are ``own``, start from themselves too."""
        start = np.full((len(q), 1), self.entry)
        for lv in range(self.top, 0, -1):
            start = self.search(q, start, lv, 1)[0]
        if own is not None:
            start = np.concatenate([np.where(start == own[:, None], -1, start), own[:, None]], 1)
        return self.search(q, start, 0, beam)


class Shard:
    """A graph with its audited beam."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, similarity: float, recall: float):
        self.ids, self.similarity = ids, similarity
        self.unit = unit_rows(vectors)
        self.graph = Graph(self.unit.astype(np.float32))
        self.beam = BEAM
        self.recall = self.audit(recall)

    def planted(self, n: int) -> np.ndarray:
        """Unit rows whose cosine with a member is at the similarity, or up to two fifths of the way from it to one."""
        rng = np.random.Generator(np.random.PCG64(5))
        u = self.unit[rng.permutation(len(self.ids))[:n] if n <= len(self.ids) else rng.integers(0, len(self.ids), n)]
        return turned(u, rng.normal(size=u.shape), self.similarity, rng)

    def audit(self, recall: float) -> float:
        """Widen the beam until the graph finds that share of the planted queries' matches; the share that it finds.

        Where near copies are a large part of a shard, they fill any beam; from a beam of a 32nd of the shard on the whole shard is compared.
        """
        q = self.planted(PLANTED)
        true = np.array([len(f) for f in self.exact(q)], np.int64)
        weight = np.minimum(true, EACH) / np.maximum(true, 1)
        while True:
            found = np.array([len(f) for f in self.matches(q)], np.int64)
            share = float((weight * found).sum() / max(1e-9, (weight * true).sum()))
            if share >= recall or self.beam >= len(self.ids):
                return share
            self.beam *= 2
            if self.beam > max(8 * BEAM, len(self.ids) // 32):
                self.beam = len(self.ids)

    def exact(self, q: np.ndarray) -> list[np.ndarray]:
        """The matches of each unit row by comparison with the whole shard."""
        step = max(1, CELLS // max(1, len(self.ids)))
        return [np.flatnonzero(f) for low in range(0, len(q), step) for f in q[low : low + step] @ self.unit.T >= self.similarity]

    def matches(self, q: np.ndarray, own: np.ndarray | None = None) -> list[np.ndarray]:
        """For each unit row, the places in the shard at the similarity or above it, in double precision; ``own``: the rows' places, if they are members."""
        out: list = [None] * len(q)
        rows, beam = np.arange(len(q)), self.beam
        while len(rows) and beam < len(self.ids) and beam * SCAN <= max(len(self.ids), self.beam * SCAN):
            full = []
            together = max(8, min(TOGETHER, 20_000_000 // len(self.ids)))
            for low in range(0, len(rows), together):
                some = rows[low : low + together]
                ids, sims = self.graph.descend(q[some].astype(np.float32), beam, None if own is None else own[some])
                near = sims >= self.similarity - 1e-5
                full += some[near.all(1)].tolist()
                near[near.all(1)] = False
                row, col = np.nonzero(near)
                place = ids[row, col]
                linked = np.einsum("nd,nd->n", self.unit[place], q[some[row]]) >= self.similarity
                ends = np.cumsum(np.bincount(row[linked], minlength=len(some)))
                for r, f in zip(some, np.split(place[linked], ends[:-1])):
                    out[r] = f
            rows, beam = np.array(full, np.int64), 2 * beam
        if len(rows):
            for r, f in zip(rows, self.exact(q[rows])):
                out[r] = f
        return out

    def stored(self) -> Iterator[dict]:
        """The shard in pieces: beam, entry, ids, unit rows, and links by level."""
        step = max(1, PIECE // max(1, self.unit.shape[1]))
        for part, low in enumerate(range(0, len(self.ids), step)):
            some = slice(low, low + step)
            yield {
                "part": part, "beam": self.beam, "recall": self.recall, "entry": self.graph.entry, "ids": self.ids[some].tobytes(),
                "unit": np.ascontiguousarray(self.unit[some]).tobytes(), "links": [np.ascontiguousarray(lv[some]).tobytes() for lv in self.graph.links],
            }

    @classmethod
    def loaded(cls, parts: list[dict], similarity: float) -> Shard:
        self = cls.__new__(cls)
        parts = sorted(parts, key=lambda p: p["part"])
        self.similarity, self.beam, self.recall = similarity, int(parts[0]["beam"]), float(parts[0]["recall"])
        self.ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
        self.unit = np.concatenate([np.frombuffer(p["unit"], np.float64) for p in parts]).reshape(len(self.ids), -1)
        levels = [np.concatenate([np.frombuffer(p["links"][lv], np.int32) for p in parts]).reshape(len(self.ids), -1) for lv in range(len(parts[0]["links"]))]
        self.graph = Graph(self.unit.astype(np.float32), links=levels, entry=int(parts[0]["entry"]))
        return self


def joined(parent: np.ndarray, members: np.ndarray, ids: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect each query with its matches, given what earlier queries have connected in ``parent``."""
    left, right = [], []
    for query, places in zip(ids, found):
        if not len(places) or len(places) == 1 and members[places[0]] == query:
            continue
        roots = places
        while len(roots) and (parent[roots] != roots).any():
            roots = parent[roots]
        roots = np.unique(roots)
        parent[places] = parent[roots] = roots[0]
        others = members[roots]
        others = others[others != query]
        left.append(np.full(len(others), query))
        right.append(others)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


SEARCHED = "a long, b long, dim int, shard int, piece int, block int, members int, beam int, recall double"
PLACE = ["dim", "shard", "piece", "block"]


def search(similarity: float, recall: float):
    """Rows come by place, members (kind 0) before others who ask (kind 1); a spanning forest of the links found goes out, and a row with each graph's recall."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, shard, parent = None, [], None, None

        def answered(ids: np.ndarray, unit: np.ndarray, own: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
            step = max(1, CELLS // 4 // len(shard.ids))
            for low in range(0, len(ids), step):
                left, right = joined(parent, shard.ids, ids[low : low + step], shard.matches(unit[low : low + step], None if own is None else own[low : low + step]))
                if len(left):
                    yield filled({"a": np.minimum(left, right), "b": np.maximum(left, right)})

        def built() -> Iterator[pd.DataFrame]:
            """The graph of the members held, and what they find in it themselves."""
            nonlocal held, shard, parent
            if not held:
                return
            ids, vectors, asks = (np.concatenate(x) for x in zip(*held))
            held, shard = [], Shard(ids, vectors, similarity, recall)
            parent = np.arange(len(ids))
            yield filled({**{k: [x] for k, x in zip(PLACE, key)}, "members": [len(ids)], "beam": [shard.beam], "recall": [shard.recall]})
            yield from answered(ids[asks], shard.unit[asks], np.flatnonzero(asks))

        for batch in batches:
            if not len(batch):
                continue
            names = list(zip(*[batch[k] for k in PLACE], batch["kind"]))
            edges = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            for a, b in zip(edges, edges[1:]):
                if names[a][:-1] != key:
                    yield from built()
                    key, shard = names[a][:-1], None
                some = batch.iloc[a:b]
                ids, vectors = some["id"].to_numpy(np.int64), np.stack(some["v"].to_numpy()).astype(np.float64)
                if names[a][-1] == 0:
                    held.append((ids, vectors, some["asks"].to_numpy(bool)))
                    continue
                yield from built()
                if shard is not None:
                    yield from answered(ids, unit_rows(vectors))
        yield from built()
        released()

    return run


def filled(columns: dict) -> pd.DataFrame:
    """Rows of SEARCHED in which the other columns are null."""
    out = pd.DataFrame(columns)
    kinds = [c.split() for c in SEARCHED.split(", ")]
    return pd.DataFrame({name: out[name] if name in out else pd.Series([None] * len(out), dtype="float64" if kind == "double" else "Int64") for name, kind in kinds})


def relate(similarity: float):
    """Vectors against their group's pivot: the core within half of the angle, what is near within one and a half."""
    angle = math.acos(similarity)

    def run(pivot, loads: list) -> tuple[list, np.ndarray, np.ndarray]:
        x, p = np.stack(loads).astype(np.float64), np.asarray(pivot, np.float64)
        cosine = x @ p / np.linalg.norm(x, axis=1) / np.linalg.norm(p)
        return loads, cosine >= math.cos(angle / 2 - 1e-7), cosine >= math.cos(min(math.pi, 1.5 * angle + 1e-7))

    return run


def compare(similarity: float):
    """Which of these vectors link, in double precision."""

    def run(loads: list) -> np.ndarray:
        x = np.stack(loads).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = np.empty((len(x), len(x)), bool)
        for low in range(0, len(x), 512):
            linked[low : low + 512] = x[low : low + 512] @ x.T >= similarity
        return linked | linked.T

    return run


def routers(classes: DataFrame, similarity: float, shards: int, shard_rows: int) -> dict[int, Router]:
    """For each length of vectors with more than one shard, its pivots; samples of a bounded size go to the driver."""
    dim, place = F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30))
    sizes = classes.groupBy(dim).count().filter(F.col("count") >= 2 * FEW).collect()
    room, wanted = PIVOT_NUMBERS, {}
    for size, count in sorted(((r["dim"], r["count"]) for r in sizes), key=lambda r: (-r[0] * r[1], r)):
        n = max(min(shards, count // FEW), -(-count // shard_rows), -(-count * size // SHARD_NUMBERS))
        n = min(n, room // size // 2)
        sample = min(SAMPLE, count, room // size - n)
        if n > 1:
            room -= (n + sample) * size
            wanted[size] = n, min(1.0, (n + sample) / count)
    if not wanted:
        return {}
    drawn = F.create_map(*[F.lit(x) for d, (_, share) in wanted.items() for x in (d, int(share * (1 << 30)))])
    rows = classes.select(dim, place.alias("place"), "v").filter(F.col("place") < F.try_element_at(drawn, "dim")).toArrow()
    dims, order = rows["dim"].to_numpy(), rows["place"].to_numpy()
    out = {}
    for d, (n, _) in wanted.items():
        at = np.flatnonzero(dims == d)
        at = at[np.argsort(order[at], kind="stable")]
        if len(at) > 1:
            x = rows["v"].take(at).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1).astype(np.float64)
            out[d] = Router(x[:n], x[n:] if len(at) > n else x, similarity)
    return out


def dealt(classes: DataFrame, routes: dict[int, Router], shard_rows: int) -> DataFrame:
    """``classes`` (id, v) as rows (place, kind, asks, id, v): members, kind 0, in every block of their piece, in one of which they ask; kind 1 where else they ask."""
    if routes:

        @F.pandas_udf("array<int>")
        def route(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                sizes, out = v.map(len).to_numpy(), np.empty(len(v), object)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    found = routes[size].shards(np.stack(v.iloc[at].to_numpy())) if size in routes else [[0]] * len(at)
                    for i, f in zip(at, found):
                        out[i] = f
                yield pd.Series(out)

        shards = route("v")
    else:
        shards = F.array(F.lit(0))
    size = F.size("v").alias("dim")
    told = classes.select(size, F.posexplode(shards).alias("nth", "shard")).groupBy("dim", "shard").agg(F.count(F.when(F.col("nth") == 0, 1)).alias("members"), F.count(F.lit(1)).alias("asked"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("members") / (CUT * shard_rows)), F.ceil(F.col("members") * F.col("dim") / SHARD_NUMBERS))
    sized = cut(told.select("dim", "shard", pieces.cast("int").alias("pieces"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("blocks")))
    own, mine = (F.pmod(F.xxhash64("id", F.lit(k)), F.col(k)).cast("int") for k in ("pieces", "blocks"))
    row = lambda piece, block, kind, asks: F.struct(piece.alias("piece"), block.alias("block"), F.lit(kind).alias("kind"), asks.alias("asks"))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    member = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: row(own, b, 0, b == mine))
    asks = F.transform(F.filter(every, lambda p: (F.col("nth") > 0) | (p != own)), lambda p: row(p, mine, 1, F.lit(True)))
    rows = F.concat(F.when(F.col("nth") == 0, member).otherwise(F.array().cast("array<struct<piece:int,block:int,kind:int,asks:boolean>>")), asks)
    listed = classes.select(size, "id", "v", F.posexplode(shards).alias("nth", "shard"))
    return listed.join(F.broadcast(sized), ["dim", "shard"]).select("dim", "shard", "id", "v", F.explode(rows).alias("r")).select("dim", "shard", "r.*", "id", "v")


def candidates(classes: DataFrame, similarity: float, recall: float, shards: int, shard_rows: int) -> DataFrame:
    """Edges (a, b) of spanning forests of the links that the shards' graphs find between classes (id, v)."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routes = routers(classes, similarity, shards, shard_rows)
    # More shards than tasks are dealt finer, as they are of different sizes.
    finer = max(tasks, min(4 * tasks, sum(len(r.pivots) for r in routes.values())))
    met = dealt(classes, routes, shard_rows).repartition(finer, *PLACE).sortWithinPartitions(*PLACE, "kind")
    return table(met.mapInPandas(search(similarity, recall), SEARCHED), "searched").filter("a is not null").select("a", "b")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """One row for each vector: key, n_links, component_id and kept."""
    v = F.col(vector)
    solid = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    slim = rows.select(F.col(key).cast("long").alias("__key"), v.alias("v"), F.coalesce(solid, F.lit(False)).alias("solid"))
    grouped = slim.filter("solid").groupBy("v").agg(F.min("__key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    grouped = cut(components(candidates(classes, similarity, recall, shards, shard_rows))).withColumnRenamed("component", "group")
    width = grouped.join(classes.select("id", F.size("v").alias("dim")), "id")
    grouped = ranked_groups(width, F.greatest("dim", F.lit(LEAST))).drop("dim")
    sets = table(grouped.join(classes.select("id", "rep", "copies", F.col("v").alias("load")), "id"), "groups")
    checked = cut(link_counts(sets, "", relate(similarity), compare(similarity), F.greatest(F.size("load"), F.lit(LEAST)), block))
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    same = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = cut(same.join(classes.select("id", "rep"), "id"))
    joined_ = with_group(named, "component", F.min("rep").alias("first")).select("id", "first")
    about = classes.join(links, "id", "left").join(joined_, "id", "left")
    about = table(about.select("v", F.coalesce("first", "rep").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "about")
    # By a hash first, as comparing arrays is what sorting by them would cost.
    good, about = (df.withColumn("__h", F.xxhash64("v")) for df in (slim.filter("solid"), about))
    good = good.join(about, ["__h", "v"]).select("__key", "links", "first")
    bad = slim.filter("not solid").select("__key", F.lit(0).cast("long").alias("links"), F.col("__key").alias("first"))
    out = good.union(bad)
    return out.select(F.col("__key").alias(key), F.col("links").cast("long").alias("n_links"), F.col("first").alias("component_id"), F.coalesce(F.col("__key") == F.col("first"), F.lit(False)).alias("kept"))
