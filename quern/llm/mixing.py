"""Operator 8: mixing sources to target weights by entropy balancing.

Every document starts with the rate 1. For each source the rates nearest to that start in entropy, between
0 and ``cap``, are sought that take the source's target of words. The dual of that convex problem has one
multiplier for each source; the rate of a document of ``z`` words is the bounded exponential tilt
``cap * e^(a x) / (cap - 1 + e^(a x))`` with ``x`` its words over the source's mean. Newton steps find all
multipliers at once: each step is a join and an aggregation over a histogram of (source, size), in which
documents of equal size, and so of equal rate, are one row.

Rates become whole copies for each (source, size): running sums of expected copies, from the largest size
down, are rounded and differenced. The few words by which a source then misses its target are made up
greedily on a few sizes of each power of two, then by the best change of one copy at two of them. Copies of a (source, size) are dealt evenly over its documents
by a gapless rank, so a size that holds a third of all rows is never in one task.

Defined results: a null text has no words and takes none; the null source is a source, sorted last; repeated
rows count as often as they are there, and which of rows with equal keys, source and size gets a copy more doesn't
matter; texts are counted whole, however long; a source without words has the target 0; an empty table gives no rows;
other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, gapless_rank, null_safe

CAP = 3
WEIGHTS = (1, 2, 3)
#: Sizes of each power of two that mend a source's miss.
MENDERS = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, n_docs, target: the words each source is to take.

    Weights repeat over the sources in code point order, null last. No target passes ``cap`` times its
    source's words; the excess goes to the others by weight. Sorted by words for each unit of weight, the
    sources that meet the cap come first, so the level of the rest follows from running sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = by_source.withColumn("__w", F.element_at(cycle, ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    order = [(F.col("source_size") / F.col("__w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    full = F.lit(float(cap)) * F.col("source_size")
    rest = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    level = weighted.withColumn("__level", left / rest)
    capped = full < F.col("__w") * F.col("__level")
    common = F.max(F.when(~capped, F.col("__level"))).over(everything)
    target = F.when(capped, full).otherwise(F.col("__w") * common)
    return level.withColumn("target", F.coalesce(target, full)).select("source", "source_size", "n_docs", "target")


def _rate(a: Column, x: Column, cap: float) -> Column:
    """Bounded exponential tilt: 1 at a = 0, between 0 and cap."""
    slope = F.lit(cap / (cap - 1.0))
    return F.lit(cap) / (F.lit(1.0) + F.lit(cap - 1.0) * F.exp(-slope * a * x))


def balance(histogram: DataFrame, wanted: DataFrame, cap: int = CAP, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """The histogram (source, size, n) with each row's ``rate``.

    Only the largest relative miss of a round goes to the driver. A source at its cap takes ``cap`` copies
    of all, which no finite multiplier gives. The words taken grow with the multiplier; a bracket around
    it is kept, and a Newton step that leaves the bracket becomes a bisection.
    """
    rows = null_safe(histogram, wanted, ["source"])
    rows = rows.filter((F.col("size") > 0) & (F.col("target") < F.lit(cap * (1 - 1e-9)) * F.col("source_size")))
    rows = cut(rows.withColumn("x", F.col("size") * F.col("n_docs") / F.col("source_size")))
    far = 60.0
    dual = rows.groupBy("source").agg(F.lit(0.0).alias("a"), F.lit(-far).alias("low"), F.lit(far).alias("high"))
    # A bracket in the multiplier of the smallest document's x holds every solution; widen by the spread.
    spread = rows.groupBy("source").agg(F.max(F.lit(1.0) / F.col("x")).alias("wide"))
    dual = null_safe(dual, spread, ["source"]).select("source", "a", (F.col("low") * F.greatest("wide", F.lit(1.0))).alias("low"), (F.col("high") * F.greatest("wide", F.lit(1.0))).alias("high"))
    dual = cut(dual)
    for _ in range(rounds):
        tilted = null_safe(rows, dual, ["source"]).withColumn("r", _rate(F.col("a"), F.col("x"), float(cap)))
        slope = F.lit(1.0 / (cap - 1.0)) * F.col("r") * (F.lit(float(cap)) - F.col("r")) * F.col("x")
        sums = tilted.groupBy("source").agg(
            F.first("a").alias("a"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
            F.first("target").alias("target"),
            F.sum(F.col("n") * F.col("size") * F.col("r")).alias("taken"),
            F.sum(F.col("n") * F.col("size") * slope).alias("slope"),
        )
        miss = F.col("taken") - F.col("target")
        sums = sums.withColumns({"low": F.when(miss < 0, F.col("a")).otherwise(F.col("low")), "high": F.when(miss > 0, F.col("a")).otherwise(F.col("high"))})
        newton = F.col("a") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(miss == 0, F.col("a")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        dual = cut(sums.select("source", step.alias("a"), "low", "high", (F.abs(miss) / F.greatest("target", F.lit(1.0))).alias("miss")))
        worst = dual.agg(F.max("miss")).first()[0]
        dual = dual.drop("miss")
        if worst is None or worst <= tolerance:
            break
    solved = null_safe(rows, dual, ["source"]).select("source", "size", _rate(F.col("a"), F.col("x"), float(cap)).alias("r"))
    out = null_safe(histogram, wanted, ["source"])
    out = null_safe(out, solved, ["source", "size"], "left")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.coalesce("r", F.lit(float(cap))))
    return out.withColumn("rate", F.least(rate, F.lit(float(cap)))).drop("r")


def round_copies(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, copies): whole numbers of copies for each size of each source."""
    w = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.floor(F.sum(F.col("rate") * F.col("n")).over(upto) + F.lit(0.5))
    rows = rated.withColumn("__c", total)
    rows = rows.withColumn("copies", (F.col("__c") - F.coalesce(F.lag("__c").over(w), F.lit(0))).cast("long"))
    rows = rows.withColumn("copies", F.greatest(F.lit(0).cast("long"), F.least("copies", F.col("n") * cap))).drop("__c")
    # A few sizes of each power of two, those with the most documents, mend what is missed.
    power = F.floor(F.log2(F.greatest("size", F.lit(1))))
    fullest = Window.partitionBy("source", power).orderBy(F.col("n").desc(), F.col("size").desc())
    chosen = rows.filter("size > 0").withColumn("__i", F.row_number().over(fullest)).filter(F.col("__i") <= MENDERS)
    chosen = chosen.select("source", F.struct("size", "n", "copies").alias("s"))
    miss = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
    menders = null_safe(chosen, miss, ["source"]).groupBy("source").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("s.size", "s.n", "s.copies")))).alias("sizes"), F.first("miss").alias("miss")
    )
    none = F.array().cast("array<struct<size:bigint,extra:bigint>>")

    def mend(state: Column, s: Column) -> Column:
        most = s["n"] * cap - s["copies"]
        extra = F.greatest(-s["copies"], F.least(most, F.round(state["miss"] / s["size"]).cast("long")))
        return F.struct(
            (state["miss"] - extra * s["size"]).cast("double").alias("miss"),
            F.concat(state["done"], F.array(F.struct(s["size"].alias("size"), extra.alias("extra")))).alias("done"),
        )

    greedy = menders.withColumn("g", F.aggregate("sizes", F.struct(F.col("miss").cast("double").alias("miss"), none.alias("done")), mend))
    greedy = greedy.select("source", F.col("g.miss").alias("miss"), F.arrays_zip(F.col("sizes").alias("of"), F.col("g.done").alias("got")).alias("sizes"))

    def moves(d: int) -> Column:
        """The sizes whose copies can still change by d, with 0 for no change."""
        copies = lambda s: s["of"]["copies"] + s["got"]["extra"] + F.lit(d)
        able = F.filter("sizes", lambda s: (copies(s) >= 0) & (copies(s) <= s["of"]["n"] * cap))
        return F.concat(F.array(F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("d"))), F.transform(able, lambda s: F.struct(s["of"]["size"].alias("size"), F.lit(d).alias("d"))))

    def left(x: Column, y: Column) -> Column:
        same = (x["size"] == y["size"]) & (x["size"] > 0)
        return F.struct(F.when(~same, F.abs(F.col("miss") - x["size"] * x["d"] - y["size"] * y["d"])).otherwise(F.lit(float("inf"))).alias("left"), x.alias("x"), y.alias("y"))

    both = F.concat(moves(1), moves(-1))
    best = F.array_min(F.transform("both", lambda x: F.array_min(F.transform("both", lambda y: left(x, y)))))
    final = greedy.withColumn("both", both).withColumn("best", best)
    change = lambda s, x: F.when(s["of"]["size"] == F.col(f"best.{x}.size"), F.col(f"best.{x}.d")).otherwise(0)
    last = F.transform("sizes", lambda s: F.struct(s["of"]["size"].alias("size"), (s["got"]["extra"] + change(s, "x") + change(s, "y")).alias("extra")))
    mended = final.select("source", F.explode(last).alias("m")).select("source", F.col("m.size").alias("size"), F.col("m.extra").alias("extra"))
    out = null_safe(rows, mended, ["source", "size"], "left")
    return out.withColumn("copies", F.col("copies") + F.coalesce("extra", F.lit(0))).drop("extra")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, buckets: int = 64) -> DataFrame:
    """One row for each document: key, source, size, source_size, target, rate, copies and words taken."""
    sizes = cut(docs.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")))
    histogram = cut(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    wanted = cut(targets(sizes, weights, cap))
    plan = cut(round_copies(balance(histogram, wanted, cap), cap))
    joined = null_safe(sizes, plan, ["source", "size"])
    ranked = gapless_rank(joined, ["source", "size"], ["__key"], "__slot", buckets)
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("__slot") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return ranked.select(
        F.col("__key").alias(key), "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )
