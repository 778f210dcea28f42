"""Operator 12: clusters of vectors by sort-means.

Vectors are turned into integers, so that every distance and mean is exact. Each round orders, for each centroid, the
other centroids by their distance from it. A vector starts at the centroid of its previous assignment, at distance d,
and scans the others in that order; by the triangle inequality none that lies strictly beyond 2 d of that
centroid can be as near as it, so the scan stops there. What lies at 2 d exactly may tie and is still scanned. Scans
run over all vectors of a batch in step. The first round, without an assignment, starts all vectors at centroid 0.

A round reads a table of vectors and assignments and writes the next one, from which each task sums up its clusters; the
table before it is deleted. Centroids, ``k`` rows, are all that passes through the driver, and nothing is shuffled but
a row of sums for each task, cluster and component.

Defined results: vectors that are null, of another number of components, or hold null, NaN or infinite components are
left out; a null id is kept and clustered, but starts no centroid unless too few others do; repeated rows count each; of equal
distances the smaller centroid wins; equal hashes are ordered by their vectors; with fewer vectors than ``k`` there are
fewer centroids, and an empty table gives no rows; components whose integer passes 2^27 are cut there, since their
distances would pass 64 bits; other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, table

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
LIMIT = 1 << 27


def assign(x: np.ndarray, centroids: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each integer row the nearest centroid, its squared distance, and the number of distances taken."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(between, 1, kind="stable")
    best, scanned = previous.copy(), np.ones(len(x), np.int64)
    near = ((x - centroids[previous]) ** 2).sum(1)
    # 2 d is compared as a square: 4 times the first distance's square, halved on the other side so that it stays within 64 bits.
    reach, least = near.copy(), near
    live = np.arange(len(x))
    for k in range(len(centroids)):
        other = order[previous[live], k]
        inside = -(-between[previous[live], other] // 4) <= reach[live]
        live, other = live[inside], other[inside]
        if not len(live):
            break
        apart = other != previous[live]
        rows, to = live[apart], other[apart]
        d = ((x[rows] - centroids[to]) ** 2).sum(1)
        scanned[rows] += 1
        better = (d < least[rows]) | ((d == least[rows]) & (to < best[rows]))
        least[rows[better]], best[rows[better]] = d[better], to[better]
    return best, least, scanned


def integers(vectors: pd.Series, dim: int, scale: int) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, dim), np.int64)
    return np.clip(np.floor(scale * np.stack(vectors.to_numpy()).astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def unpacked(raw: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i4").reshape(-1, dim).astype(np.int64)


def kept(rows: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(key, v): the ids and integer components of the vectors that are whole; v packs them in 4 bytes each."""
    v = F.col(vector)
    whole = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([row.tobytes() for row in integers(batch, dim, scale).astype("<i4")], dtype=object)

    return rows.select(F.col(key).cast("long").alias("key"), v.alias("v")).filter(F.coalesce(whole, F.lit(False))).select("key", packed("v").alias("v"))


def seeds(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """The ``k`` vectors with the smallest hashes of their ids."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    return vectors.withColumn("hash", name).orderBy(F.col("hash").asc_nulls_last(), "v").limit(k)


def step(centroids: np.ndarray, dim: int):
    """Rows (key, v, cluster) to the same rows, newly assigned, with their squared distance and the distances taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = unpacked(batch["v"], dim)
            cluster, distance, scanned = assign(x, centroids, batch["cluster"].to_numpy(np.int64))
            yield batch.assign(cluster=cluster.astype(np.int32), distance=distance, scanned=scanned)

    return run


def totals(dim: int):
    """A task's vectors to a row of sums for each cluster: (cluster, n, sums)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            x, c = unpacked(batch["v"], dim), batch["cluster"].to_numpy()
            for k in np.unique(c).tolist():
                sums[k] = sums.get(k, 0) + x[c == k].sum(0)
                count[k] = count.get(k, 0) + int((c == k).sum())
        if sums:
            yield pd.DataFrame({"cluster": list(sums), "n": list(count.values()), "sums": [s.tolist() for s in sums.values()]})

    return run


ROWS = "key long, v binary, cluster int, distance long, scanned long"


def sort_means(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row for each kept vector: key, cluster, distance, scanned, cluster_inertia, inertia and centroid_sha256."""
    spark = rows.sparkSession
    state = table(kept(rows, key, vector, dim, scale).withColumn("cluster", F.lit(0)), "vectors")
    start = seeds(state, k, seed).select("v").toPandas()["v"]
    centroids = unpacked(start, dim)
    if not len(centroids):
        centroids = np.zeros((1, dim), np.int64)
    for _ in range(rounds):
        new = table(state.select("key", "v", "cluster").mapInPandas(step(centroids, dim), ROWS), "vectors")
        dropped(state)
        state = new
        sums = state.select("v", "cluster").mapInPandas(totals(dim), "cluster int, n long, sums array<long>")
        parts = sums.select("cluster", "n", F.posexplode("sums").alias("place", "x"))
        means = parts.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for c, place, x, n in means.collect():  # k * dim numbers
            centroids[c, place] = int(x) // n
    last = table(state.select("key", "v", "cluster").mapInPandas(step(centroids, dim), ROWS).drop("v"), "assigned")
    dropped(state)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = {c: int(x) for c, x in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    by = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return last.select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        "scanned",
        by([each.get(c) for c in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(sum(each.values())).cast("long").alias("inertia"),
        by(names, "string").alias("centroid_sha256"),
    )
