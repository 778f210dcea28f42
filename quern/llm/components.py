"""Connected components by alternating stars, and link counts inside candidate groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank, released, table


def with_group(rows: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``rows`` (a checkpoint or table) with aggregates of all rows of their key.

    The aggregates are taken with partial sums and written, so that both sides of the join are plain shuffles: Spark
    splits the partition of a hot key there, and broadcasts the aggregates where they are few.
    """
    return rows.join(cut(rows.groupBy(key).agg(*aggregates)), key)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); the component is its smallest id.

    Each round hangs larger neighbours, then smaller ones, onto the smallest neighbour (``with_group``), so that a
    node with very many edges is never one group in a task. Only the number of edges and a checksum of them
    reach the driver.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = with_group(both, "u", F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # A larger neighbour goes to the smallest; the node itself keeps its edge to it.
        end = F.when(F.col("v") > F.col("u"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))).when(F.col("v") == F.col("m"), F.struct("u", "v"))
        large = cut(near.select(end.alias("e")).filter("e is not null").select("e.*").filter("u <> v").distinct())
        down = with_group(large, "u", F.min("v").alias("m"))
        end = F.when(F.col("v") == F.col("m"), F.struct("u", "v")).otherwise(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        pairs = cut(down.select(end.alias("e")).select("e.*").distinct())
        row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def block_pairs(rows: DataFrame, group: str, by: str, block: int, buckets: int = 64, weight: Column | None = None) -> DataFrame:
    """``rows`` dealt so that any two rows of a group meet in one (group, i, j) with i <= j.

    A group of n rows is cut into blocks of ``block`` rows, or of that sum of weights and one row more at most; a row of block k
    goes to every pair with k. A group within one block has the single pair (0, 0) and is not copied. ``mine`` is the row's block.
    """
    ranked = gapless_rank(rows, [group], [by], "__rank", buckets, total="__total", weight=weight)
    blocks = F.ceil(F.col("__total") / block).cast("int")
    met = ranked.withColumns({"mine": F.floor(F.col("__rank") / block).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return met.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("__rank", "__total", "other")


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    todo = np.ones(len(linked), bool)
    for i in range(len(linked)):
        if not todo[i]:
            continue
        front = np.zeros(len(linked), bool)
        front[i] = True
        while front.any():
            todo &= ~front
            label[front] = i
            front = linked[front].any(0) & todo
    return label


def groups_in_partition(work: Callable, columns: list[str]):
    """Apply ``work`` to each run of rows with equal ``columns``; rows come sorted by them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        key = None
        for batch in batches:
            if not len(batch):
                continue
            names = list(zip(*[batch[c] for c in columns]))
            edges = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            for a, b in zip(edges, edges[1:]):
                if rest and names[a] != key:
                    yield work(pd.concat(rest, ignore_index=True))
                    rest = []
                key = names[a]
                rest.append(batch.iloc[a:b])
        if rest:
            yield work(pd.concat(rest, ignore_index=True))
        released()

    return run


def ranked_groups(grouped: DataFrame, weight: Column) -> DataFrame:
    """``grouped`` (id, group, ...) with the weight before each row of its group and the group's weight n, as ``link_counts`` needs them."""
    return gapless_rank(grouped, ["group"], ["id"], "rank", 64, total="n", weight=weight)


def link_counts(rows: DataFrame, load: str, relate: Callable, compare: Callable, weight: Column, block: int) -> DataFrame:
    """(id, links, root): the summed copies of all that each row links with, and edges of a spanning forest.

    ``rows``, a table, have group, rank, n (``ranked_groups``), id (once), rep, copies and ``load``, what the comparison
    needs. ``load`` names the type of related loads if it is another one. ``weight`` is a load's share of the memory of a
    comparison: a block is as many rows as weigh ``block`` together, and one more at most. Only rows of one group can
    link. A group within one block is compared as it is. A larger one has a pivot, its row of the smallest rep:

    * ``relate(pivot's load, loads)`` gives each row's load relative to the pivot, whether it is *core*, so near the
      pivot that any two core rows link, and whether it is *near* enough to link with a core row at all.
    * Core rows link with each other by membership: the group's core is summed up, not paired.
    * Near rows meet the core, and all rows outside the core each other, in blocks.

    ``compare(loads)`` gives the symmetric matrix of links between rows. So a group of near copies of one text costs
    in proportion to its size; what is quadratic is the part of it outside the core.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["load"].dataType.simpleString()
    out = "id long, links long, root long"

    def counted(pairs: DataFrame) -> DataFrame:
        keys = ["group", "i", "j"]

        def work(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id")
            ids, side, copies = part["id"].to_numpy(), part["side"].to_numpy(), part["copies"].to_numpy(np.float64)
            linked = compare(list(part["load"]))
            np.fill_diagonal(linked, False)
            if part["i"].iloc[0] != part["j"].iloc[0]:
                linked &= side[:, None] != side[None, :]
            weight = np.concatenate([linked[low : low + 512] @ copies for low in range(0, len(ids), 512)]).astype(np.int64)
            some = weight > 0
            return pd.DataFrame({"id": ids[some], "links": weight[some], "root": ids[forest(linked)][some]})

        met = pairs.select(*keys, "side", "id", "copies", "load").repartition(tasks, *keys).sortWithinPartitions(*keys)
        return met.mapInPandas(groups_in_partition(work, keys), out)

    parts = counted(rows.filter(F.col("n") <= block).withColumns({k: F.lit(0) for k in ("i", "j", "side")}))
    big = rows.filter(F.col("n") > block).withColumn("i", F.floor(F.col("rank") / block).cast("int"))
    if big.isEmpty():
        return parts
    pivots = big.groupBy("group", "n").agg(F.min_by("id", F.struct(F.col("rep").isNull(), "rep", "id")).alias("id"))
    heads = big.join(pivots.select("id"), "id").select(
        "group", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("i"), F.lit(0).alias("kind"), "id", "copies", "load"
    )
    members = big.select("group", "i", F.lit(1).alias("kind"), "id", "copies", "load")
    keys = ["group", "i"]

    def related(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("kind", kind="stable")
        head, rest = part.iloc[0], part.iloc[1:]
        loads, core, near = relate(head["load"], list(rest["load"]))
        return pd.DataFrame({"group": rest["group"], "pivot": head["id"], "id": rest["id"], "copies": rest["copies"], "load": loads, "core": core, "near": near})

    met = heads.union(members).repartition(tasks, *keys).sortWithinPartitions(*keys)
    placed = table(met.mapInPandas(groups_in_partition(related, keys), f"group long, pivot long, id long, copies long, load {load or kind}, core boolean, near boolean"), "placed")
    core = placed.filter("core")
    own = with_group(core.select("group", "pivot", "id", "copies"), "group", F.sum("copies").alias("all"))
    parts = parts.union(own.select("id", (F.col("all") - F.col("copies")).alias("links"), F.col("pivot").alias("root")))
    parts = parts.union(counted(block_pairs(placed.filter("not core"), "group", "id", block, weight=weight).withColumnRenamed("mine", "side")))
    # The core against what is near it: each block of one side meets each block of the other.
    edge = placed.filter("near and not core")
    width = lambda df, name: df.groupBy("group").agg(F.ceil(F.sum(weight) / block).cast("int").alias(name))
    both = width(core, "cores").join(width(edge, "edges"), "group")
    if both.isEmpty():
        return parts
    numbered = [gapless_rank(df, ["group"], ["id"], "rank", 64, weight=weight).withColumn("b", F.floor(F.col("rank") / block).cast("int")) for df in (core, edge)]
    sized = [on_groups(df, both) for df in numbered]
    left = sized[0].select("group", F.col("b").alias("i"), F.explode(F.sequence(F.lit(1), F.col("edges"))).alias("j"), F.lit(0).alias("side"), "id", "copies", "load")
    right = sized[1].select("group", F.explode(F.sequence(F.lit(0), F.col("cores") - 1)).alias("i"), (F.col("b") + 1).alias("j"), F.lit(1).alias("side"), "id", "copies", "load")
    # i and j number blocks of different sides, so they are never a block with itself.
    crossed = left.union(right).withColumn("i", -1 - F.col("i"))
    return parts.union(counted(crossed))


def on_groups(rows: DataFrame, groups: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` joined with one row for each of few large groups, whose rows are dealt over ``salts``."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    copied = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copied, ["group", "__salt"]).drop("__salt")


