"""Views that map the given tables onto the message model.

A message row has id, folder, thread_key, from and to addresses, date, the three flags and attachments;
``seq`` is the order in which rows arrived and breaks ties of dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: id, shown name, role, virtual; virtual folders are saved searches.
FOLDERS = (
    ("inbox", "Inbox", "inbox", False),
    ("flagged", "Flagged", "flagged", True),
    ("archive", "Archive", "archive", False),
    ("work", "Work", None, False),
    ("sent", "Sent", "sent", False),
    ("drafts", "Drafts", "drafts", False),
    ("junk", "Junk", "junk", False),
    ("trash", "Trash", "trash", False),
)
FOLDER_SCHEMA = "id string, name string, role string, virtual boolean"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of few files dealt over all cores, for work that takes long for each row; many files stay as they are read.

    ``df`` must come from a table without joins or groups, so that its partitions are known before anything runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOLDERS, FOLDER_SCHEMA)


def address(name: Column, mail: Column) -> Column:
    return F.struct(name.alias("name"), F.lower(mail).alias("address"))


def messages_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages from their customers."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    sender = address(F.col("c_name"), F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("from")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(*_own_columns(), sender)


def _own_columns() -> list[Column]:
    """What an order says of its message."""
    return [
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "inbox").when(F.col("o_orderstatus") == "F", "archive").otherwise("work").alias("folder"),
        F.col("o_custkey").alias("thread_key"),
        F.col("o_orderdate").alias("date"),
        (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("seen"),
        (F.col("o_orderpriority") == "1-URGENT").alias("flagged"),
        (F.col("o_orderpriority") == "5-LOW").alias("answered"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderkey").alias("seq"),
    ]


def messages_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages without who wrote them, and so without a join; every order has its customer."""
    rows = read(spark, sf_dir, "orders").filter("o_custkey is not null")
    return rows.select(*_own_columns())


def attachments_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attachments: one row each, in a stated order, with their index in the message."""
    from pyspark.sql import Window

    items = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
    kinds = F.array(*[F.lit(x) for x in ("pdf", "docx", "xlsx", "png", "zip", "txt", "jpeg")])
    kind = F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int"))
    return items.select(
        F.col("l_orderkey").alias("message_id"),
        (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1).alias("index"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("."), kind).alias("filename"),
        (F.col("l_quantity") * 65536 + F.col("l_partkey")).cast("long").alias("size"),
        (F.col("l_returnflag") == "R").alias("inline"),
    )


def messages_doc(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Documents as messages; the first line is the subject. ``wide`` deals them over all cores (``spread``)."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    docs = spread(docs) if wide else docs
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("folder"),
        F.substring_index("text", "\n", 1).alias("subject"),
        address(F.col("source"), F.concat("lang", F.lit("@example.com"))).alias("from"),
        "text",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("seen"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("flagged"),
        F.col("doc_id").alias("seq"),
    )


def labelled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` of documents, by their id, as often as ``messages_doc`` has that document: once for each of its labels, or once."""
    return rows.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left")


def bodies_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "html")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pen strokes that start at ``ts``; the value is the position."""
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pointer_id"), "ts", "event_type", F.col("value").alias("x"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as token streams: the turn before in brackets, then the answer, in short pieces."""
    from pyspark.sql import Window

    turns = history(spark, sf_dir)
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    whole = turns.withColumn("before", before).filter("role = 'assistant'")
    text = F.concat(F.lit("⟦"), F.coalesce("before", F.lit("")), F.lit("⟧\n"), "text")
    pieces = whole.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)(.{1,14})"), 1)).alias("seq", "chunk"))
    return pieces.withColumn("seq", F.col("seq").cast("long"))
