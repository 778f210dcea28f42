"""Arrow batches of whole mails are small, so that a worker holds a bounded part of its task."""

import pytest
from pyspark.sql import functions as F

from quern.plans import bodies
from quern.sources import mime

LARGE = ("10000", "256m")
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture
def large_batches(spark):
    """As a session starts: ten thousand rows in an Arrow batch."""
    for name, value in zip(BATCH, LARGE):
        spark.conf.set(name, value)
    yield spark
    for name in BATCH:
        spark.conf.unset(name)


def bounded(spark):
    return int(spark.conf.get(BATCH[0])) <= 1024 and spark.conf.get(BATCH[1]) == "16m"


def mails(spark, n=3000):
    return spark.range(0, n, 1, 1).select("id", F.encode(F.concat(F.lit("Subject: s\r\nMessage-ID: <m"), F.col("id").cast("string"), F.lit("@x>\r\n\r\nbody")), "UTF-8").alias("raw"))


def test_previews_take_small_batches(large_batches):
    """A worker holds a bounded part of the mails at once, however many a task reads."""
    out = mime.previewed(mails(large_batches), "raw")
    assert bounded(large_batches) and out.filter("preview = 'body' and part = '1'").count() == 3000


def test_bodies_of_html_take_small_batches(large_batches):
    lengths = mime.html_function(lambda x: str(len(x)))
    assert bounded(large_batches) and large_batches.range(3).select(lengths(F.lit("abc")).alias("n")).filter("n = '3'").count() == 3


def test_message_tree_leaves_bodies_in_the_worker(large_batches, sf):
    """Numbers and types need no body, so none comes back from Python."""
    out = bodies.message_tree(large_batches, sf)
    assert bounded(large_batches) and "body" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_parsed_mail_takes_small_batches(large_batches):
    out = mime.parsed_messages(mails(large_batches), "raw")
    assert bounded(large_batches) and out.filter("text = 'body' and subject = 's'").count() == 3000


def test_ids_by_part_take_small_batches(large_batches, sf):
    """Its trees come in the same small batches as previews do."""
    out = bodies.ids_by_part(large_batches, sf)
    assert bounded(large_batches) and {r["part"] for r in out.collect()} == {"1", "1.1"}


@pytest.mark.parametrize("query", [bodies.ids_by_part, bodies.message_tree])
def test_each_mail_is_parsed_once(spark, sf, query):
    """A filter on the tree or its explosion takes no second worker beside each task's own."""
    plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_texts_stay_out_of_the_join_with_labels(spark, sf, tmp_path):
    """A shuffle for the labels takes numbers and parts alone; a document with two labels still counts twice."""
    docs = [(1, "a"), (2, "b"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (bodies.ids_by_part, bodies.message_tree):
            plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
            assert plan.index("Join") < plan.index("ArrowEvalPython")
        assert {(r["part"], r["ids"]) for r in bodies.ids_by_part(spark, str(tmp_path)).collect()} == {("1", "1,1,3"), ("1.1", "2")}
        assert sorted(r["part"] for r in bodies.message_tree(spark, str(tmp_path)).filter("id = 1").collect()) == ["1", "1", "2", "2"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bpe_takes_smaller_batches(large_batches, sf):
    """A worker that holds a vocabulary takes 256 texts and 4 MB at once."""
    bpe = pytest.importorskip("quern.llm.bpe")
    import public_tokenizers

    docs = large_batches.read.parquet(f"{sf}/documents.parquet").limit(5)
    bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [large_batches.conf.get(name) for name in BATCH] == ["256", "4m"]
