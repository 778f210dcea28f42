"""Five stages from raw documents to tokens: quality, near copies, repeated passages, mixing, encoding.

Each stage takes what its predecessor kept and gives back documents with the columns of the table, the last
one a row of digests for each document. A row is known by its key and text, so null and repeated keys pass.

Defined results, stage by stage: a null or empty text has too few words and goes in the first stage; a later stage that gets one
keeps it, as one that is its own group, loses nothing, weighs nothing (so that the mixture takes it once or not at all) and
has no tokens. Texts are read whole, however long. Rows of equal key and text are one document: the first stage keeps
each of them, the second one of them, as of any group; of a group's ties the smallest key stays (null last). Null sources
are a source of their own. An empty table gives an empty table in every stage. Columns beyond those of the table stay as
they are, whatever their names, in all stages but the last, which returns its own columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import decode, encode
from quern.llm.common import fresh, row_key, table
from quern.llm.jaccard import near_duplicates
from quern.llm.mixing import mix
from quern.llm.quality import judge, without_lines
from quern.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their host's boilerplate lines."""
    k, gone = fresh(docs, "row_key", "row_lines")
    keyed = docs.withColumn(k, row_key())
    verdicts = judge(keyed.select(k, "text", "source")).filter("kept").select(k, F.col("removed").alias(gone)).dropDuplicates([k])
    kept = keyed.join(verdicts, k)
    changed = F.size(gone) > 0
    text = F.when(changed, without_lines("text", gone)).otherwise(F.col("text"))
    out = kept.withColumn("text", text)
    return out.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest key stays."""
    (k,) = fresh(docs, "row_key")
    keyed = docs.withColumn(k, row_key())
    first = near_duplicates(keyed.select(k, "text"), key=k).filter(F.col(k) == F.col("class_id")).select(k).distinct()
    return keyed.join(first, k).dropDuplicates([k]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more go from all but their first document; stray bytes of cut characters go too."""

    hidden = [c for c in docs.columns if c.startswith("__")]  # the operator would drop them
    shown = dict(zip(hidden, fresh(docs, *[f"row{c}" for c in hidden])))
    plain = docs.toDF(*[shown.get(c, c) for c in docs.columns])
    out = remove_repeats(plain, prefix="__", as_text=True)
    changed = F.col("__n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col("__kept")).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*plain.columns).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    k, n = fresh(docs, "row_key", "row_copies")
    keyed = docs.withColumn(k, row_key())
    copies = mix(keyed.select(k, "text", "source"), key=k).groupBy(k).agg(F.sum("copies").cast("int").alias(n))
    once = keyed.join(copies.filter(F.col(n) > 0), k).dropDuplicates([k])
    return once.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to.

    The ids are written in between, so that a task has one Python worker with its vocabulary, not two.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = table(encode(docs.select("doc_id", "source", "text"), path, pattern).select("doc_id", "source", "ids"), "ids")
    return decode(coded, path, pattern).select(
        "doc_id",
        "source",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: Chosen paths, entropy balancing and BPE aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, f"stage{i}")
    return docs
