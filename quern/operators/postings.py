"""Literal search by an index of three-character runs, which reads no text without a chance to hit.

Messages are cut into blocks of neighbouring ``seq``. For each run of three characters of the lower-cased text and each
block the index has one row: which of the block's messages hold it; a block of very long texts has several parts with rows of
their own. A query's runs must all be in a hit, so the rows of its rarest runs are intersected part by part, rarest first, and what is left is verified on the texts, of which only
the blocks with candidates are read. A query of one or two characters takes the runs that contain it instead.

The texts are dealt by block once, and blocks are indexed where they are; then the rows of all blocks are sorted by their
run, so that a query reads the part of the files that holds its runs. New messages are new blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import small_batches

#: Messages of a block; the rarest runs that are intersected; blocks with candidates up to which only these are read.
BLOCK, RAREST, SEEKS = 65_536, 6, 10_000
RUN = 3
#: Runs of messages that a task holds at once.
PART = 2_000_000


def joined(fields: list[Column]) -> Column:
    """The searched text: all fields in lower case, with single blanks between them."""
    parts = [F.coalesce(f, F.lit("")) for f in fields]
    return F.lower(F.concat_ws(" ", *parts))


def _packed(text: str) -> np.ndarray:
    """Each different run of three characters once, in order, as the 21 bits of each character in one number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _posted(block: int, part: int, ats: list[int], codes: list[np.ndarray], short: dict[str, list[int]]) -> pa.RecordBatch:
    """The rows of some neighbouring messages of a block: the ``ats`` of each run, in order and once."""
    code, at = np.concatenate([np.empty(0, np.int64), *codes]), np.repeat(np.array(ats, np.int32), [len(c) for c in codes])
    order = np.argsort(code, kind="stable")  # the messages came in order of their place
    code, at = code[order], at[order]
    once = np.ones(len(code), bool)
    once[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
    code, at = code[once], at[once]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    found = code[first]
    text = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    names = [text[i : i + RUN] for i in range(0, len(text), RUN)] + [*short]
    whole = [at, *[np.array(sorted(set(x)), np.int32) for x in short.values()]]
    ends = np.concatenate([first, len(at) + np.cumsum([0, *map(len, whole[1:])])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(whole)))
    size = pa.array(np.diff(ends).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([block] * len(names), pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(names, pa.string()), lists, size], ["block", "part", "run", "ats", "n"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index from messages (block, at, text) in order; a part ends with its block, or when it holds ``PART`` runs."""
    block, part, held = None, 0, 0
    ats, codes, short = [], [], {}
    for batch in batches:
        for b, at, text in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "text"))):
            if b != block or held >= PART:
                if ats or short:
                    yield _posted(block, part, ats, codes, short)
                block, part, held = b, part + 1 if b == block else 0, 0
                ats, codes, short = [], [], {}
            if len(text) < RUN:
                short.setdefault(text, []).append(at)
                held += 1
            else:
                ats.append(at)
                codes.append(_packed(text))
                held += len(codes[-1])
    if ats or short:
        yield _posted(block, part, ats, codes, short)


def runs_of(query: str) -> list[str]:
    return sorted({query[i : i + RUN] for i in range(len(query) - RUN + 1)})


class Postings:
    """An index at ``path`` over messages with seq and the searched ``fields``."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str]):
        self.spark, self.path, self.fields = spark, path, fields
        self.texts, self.rows, self.known = (spark.read.parquet(f"{path}/{part}") for part in ("texts", "rows", "known"))

    @classmethod
    def build(cls, messages: DataFrame, fields: list[str], path: str, block: int = BLOCK) -> Postings:
        spark = messages.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        numbered = messages.withColumns({"block": F.floor(F.col("seq") / block).cast("long"), "at": F.pmod("seq", F.lit(block)).cast("int")})
        numbered.repartition("block").write.partitionBy("block").parquet(f"{path}/texts")
        texts = spark.read.schema(numbered.schema).parquet(f"{path}/texts")
        found = texts.select("block", "at", joined([F.col(f) for f in fields]).alias("text"))
        small_batches(spark)
        dealt = found.filter("block is not null").repartition(n, "block").sortWithinPartitions("block", "at")
        dealt.mapInArrow(_gathered, "block long, part int, run string, ats array<int>, n int").write.parquet(f"{path}/blocks")
        blocks = spark.read.parquet(f"{path}/blocks")
        blocks.repartitionByRange(n, "run", "block").sortWithinPartitions("run", "block").write.parquet(f"{path}/rows")
        known = blocks.groupBy("run").agg(F.sum("n").alias("n"))
        known.repartitionByRange(max(1, n // 4), "run").sortWithinPartitions("run").write.parquet(f"{path}/known")
        return cls(spark, path, fields)

    def candidates(self, query: str) -> DataFrame:
        """(block, at) of the messages that may contain the query; all that do are among them."""
        none = self.texts.select("block", "at").filter(F.lit(False))
        if not query:
            return self.texts.select("block", "at")
        if len(query) < RUN:
            wide = self.known.filter(F.contains("run", F.lit(query))).select("run")
            return self.rows.join(wide, "run", "left_semi").select("block", F.explode("ats").alias("at")).distinct()
        wanted = runs_of(query)
        known = {r["run"]: r["n"] for r in self.known.filter(F.col("run").isin(wanted)).collect()}  # at most a row for each run of the query
        if len(known) < len(wanted):
            return none
        chosen = sorted(wanted, key=lambda run: (known[run], run))[:RAREST]
        rows = self.rows.filter(F.col("run").isin(chosen)).groupBy("block", "part").agg(F.array_sort(F.collect_list(F.struct("n", "run", "ats"))).alias("r"))
        met = F.aggregate(F.slice("r", 2, RAREST), F.col("r")[0]["ats"], lambda got, row: F.array_intersect(got, row["ats"]))
        return rows.filter(F.size("r") == len(chosen)).select("block", F.explode(met).alias("at"))

    def search(self, query: str) -> DataFrame:
        """The messages whose joined fields contain the query, whatever its case."""
        q = query.lower()
        found = self.candidates(q)
        texts = self.texts
        if q:
            some = [r["block"] for r in found.select("block").distinct().limit(SEEKS + 1).collect()]
            if len(some) <= SEEKS:  # only these blocks' files are read; with more of them a list would be no help
                texts = texts.filter(F.col("block").isin(some))
        hits = texts.join(found.withColumnsRenamed({"block": "__b", "at": "__a"}), (F.col("block") == F.col("__b")) & (F.col("at") == F.col("__a")), "left_semi")
        return hits.filter(F.contains(joined([F.col(f) for f in self.fields]), F.lit(q))).drop("block", "at")
