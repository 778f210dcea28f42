"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, small_batches  # noqa: F401

#: A word is a run of bytes other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released() -> None:
    """Give back to the system what numpy and Arrow have freed, so that a worker that waits for its next task doesn't hold it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def dropped(df: DataFrame) -> None:
    """Delete the folder of a ``table`` that nothing reads any more; only folders inside the shared one are touched."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
        if path.getParent().toUri().getPath() == root:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def public(df: DataFrame, *new: str) -> DataFrame:
    """``df`` without columns that an operator is about to add, or that start with two underscores.

    So a clash of names has a defined result: the operator's column replaces the input's.
    """
    names = {n.lower() for n in new}
    return df.select(*[c for c in df.columns if c.lower() not in names and not c.startswith("__")])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null equals null; ``keys`` come from the left side."""
    names = {k: f"__r_{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(k).alias(v) for k, v in names.items()], *[c for c in right.columns if c not in keys])
    on = None
    for k, v in names.items():
        term = left[k].eqNullSafe(other[v])
        on = term if on is None else on & term
    return left.join(other, on, how).drop(*names.values())


def gapless_rank(df: DataFrame, keys: list[str], by: list[str], out: str, buckets: int = 512, total: str | None = None, weight: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, however many rows one key holds; ``total`` names the key's count.

    Rows of a key are dealt over ``buckets`` by a hash of ``by``. Each bucket is ranked on its
    own and shifted by the number of rows in the buckets before it, so no task sorts a whole key. With a ``weight`` a row's
    number is the sum of the weights before it, and the total that of all.
    """
    rows = df.withColumn("__b", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy(*keys, "__b").orderBy(*by)
    size, place = F.count(F.lit(1)), F.row_number().over(inner) - 1
    if weight is not None:
        rows = rows.withColumn("__w", weight.cast("long"))
        size, place = F.sum("__w"), F.sum("__w").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")
    counts = rows.groupBy(*keys, "__b").agg(size.alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"__off": F.coalesce(F.sum("__n").over(before), F.lit(0))} | ({total: F.sum("__n").over(Window.partitionBy(*keys))} if total else {})
    offsets = counts.withColumns(sums).drop("__n")
    ranked = rows.withColumn("__r", place)
    joined = null_safe(ranked, offsets, [*keys, "__b"])
    return joined.withColumn(out, (F.col("__r") + F.col("__off")).cast("long")).drop("__b", "__r", "__off", "__w")


def utf8_len(text: Column) -> Column:
    """Bytes of a text in UTF-8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """A string that orders like ``key`` (null last) and is equal for rows of equal key and text only.

    The key's sign bit is turned, so that its hexadecimal digits order like the number.
    """
    place = F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), place), F.lit("1")), F.lit("-"), F.hex(F.xxhash64(F.col(text))), F.hex(F.crc32(F.coalesce(F.col(text), F.lit("")))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
