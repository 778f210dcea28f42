"""The mailbox source in batches and as a stream, and the view that streams write into."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.sources import mailbox, view
from quern.streaming import sessions

LONG = "x-filler: " + "y" * 40_000 + "\r\n"


def raw(folder, uid):
    extra = LONG if uid % 10 == 3 else ""
    return f"From: Ann <Ann@X.org>\r\nSubject: =?utf-8?b?w4k=?= {folder} {uid}\r\n{extra}Message-ID: <{folder}{uid}@x>\r\nContent-Type: text/plain\r\n\r\nbody {uid}\n\nmore {'z' * (uid * 300)}".encode()


def mails(spark, folder, uids):
    return spark.createDataFrame([(folder, u, bytearray(raw(folder, u))) for u in uids], "folder string, uid long, raw binary")


@pytest.fixture
def box(spark, tmp_path):
    path = str(tmp_path / "box")
    rows = mails(spark, "inbox", range(1, 46)).union(mails(spark, "sent", range(5, 12)))
    assert mailbox.write_mail(rows, path, 10).agg(F.sum("n")).first()[0] == 52
    return path


def test_mailbox(spark, box):
    got = {(r["folder"], r["uid"]): r for r in mailbox.read_mail(spark, box).collect()}
    assert set(got) == {*(("inbox", u) for u in range(1, 46)), *(("sent", u) for u in range(5, 12))}
    r = got["inbox", 13]
    assert (r["subject"], r["sender"], r["message_id"], r["content_type"], r["size"], r["date"]) == ("É inbox 13", "ann@x.org", "<inbox13@x>", "text/plain", len(raw("inbox", 13)), None)
    whole = mailbox.read_mail(spark, box, bodies=True)
    assert all(bytes(r["raw"]) == raw(r["folder"], r["uid"]) for r in whole.collect()) and whole.drop("raw").columns == mailbox.read_mail(spark, box).columns
    assert mailbox.read_mail(spark, box + "/none").count() == 0


def test_conditions_choose_files(spark, box):
    read = lambda **options: mailbox.read_mail(spark, box, **options)
    ids = lambda d: sorted((r["folder"], r["uid"]) for r in d.collect())
    assert ids(read(folders=["inbox"], low=12, high=14)) == [("inbox", u) for u in (12, 13, 14)]
    assert ids(read(folders=["sent", "x"], low=10)) == [("sent", 10), ("sent", 11)] and ids(read(folders=[])) == []
    pushed = lambda condition: ids(read(pushdown=True).filter(condition))
    assert pushed("folder = 'inbox' and uid between 12 and 14") == [("inbox", u) for u in (12, 13, 14)]
    assert pushed("folder in ('sent', 'x') and uid > 9") == [("sent", 10), ("sent", 11)]
    assert pushed("uid = 7 and subject like '%sent%'") == [("sent", 7)] and pushed("uid < 2 or uid >= 45") == [("inbox", 1), ("inbox", 45)]
    plain = read()
    assert ids(plain.filter("uid = 7")) == [("inbox", 7), ("sent", 7)] and len(ids(plain)) == 52  # a relation that is read twice
    reader = mailbox.FilteredMailReader(box, False, None)
    rest = [*reader.pushFilters([mailbox.EqualTo(("folder",), "inbox"), mailbox.GreaterThanOrEqual(("uid",), 12), mailbox.LessThan(("uid",), 15), mailbox.EqualTo(("subject",), "s")])]
    assert len(rest) == 1 and [p.files for p in reader.partitions()] == [["000000000010-000000000019.mails"]]


def test_headers_alone_are_read(spark, box, monkeypatch):
    asked = []

    class Watched:
        def __init__(self, source):
            self.source = source

        def read_at(self, n, at):
            asked.append(n)
            return self.source.read_at(n, at)

        def size(self):
            return self.source.size()

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

    disk, _ = mailbox.storage(box)
    monkeypatch.setattr(mailbox, "storage", lambda path: (type("Disk", (), {"open_input_file": staticmethod(lambda name: Watched(disk.open_input_file(name)))}), path))
    part = mailbox.Files("inbox", ["000000000040-000000000045.mails"], 0, 99)
    monkeypatch.setattr(mailbox, "HEAD", 1_000)
    assert [m["uid"] for m in mailbox.mails(box, part, False)] == [40, 41, 42, 43, 44, 45]
    size = os.path.getsize(f"{box}/inbox/000000000040-000000000045.mails")
    heads, asked[:] = sum(asked), []
    assert [len(m["raw"]) for m in mailbox.mails(box, part, True)] == [len(raw("inbox", u)) for u in range(40, 46)]
    assert sum(asked) >= size and heads < size - 5 * 40 * 300 + 8_000


def test_rerun_of_a_writer_leaves_one_file(spark, box):
    before = {f: os.listdir(f"{box}/{f}") for f in ("inbox", "sent")}
    mailbox.write_mail(mails(spark, "inbox", range(1, 46)), box, 10).count()
    assert {f: os.listdir(f"{box}/{f}") for f in before} == before or all(sorted(os.listdir(f"{box}/{f}")) == sorted(before[f]) for f in before)


def test_new_mail_is_a_stream(spark, box, tmp_path):
    """What a batch reads of the whole box a stream reads in parts; an answer that comes after a send is the next batch."""

    def new(name, since="earliest"):
        path, known = str(tmp_path / f"view-{name}"), []
        if os.path.exists(path):
            known = [(r["folder"], r["uid"]) for r in view.read_view(spark, path).collect()]
        view.keep_view(mailbox.stream_mail(spark, box, since=since), path, str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination(120)
        rows = [(r["folder"], r["uid"]) for r in view.read_view(spark, path).collect()] if os.path.exists(path) else []
        assert len(rows) == len(set(rows))
        return sorted(set(rows) - set(known))

    whole = sorted((r["folder"], r["uid"]) for r in mailbox.read_mail(spark, box).collect())
    assert new("all") == whole and new("late", "latest") == []
    mailbox.write_mail(mails(spark, "inbox", [46, 47]).union(mails(spark, "work", [0])), box, 10).count()
    later = [("inbox", 46), ("inbox", 47), ("work", 0)]
    assert new("all") == later and new("all") == [] and new("late", "latest") == later


def test_view_keeps_a_batch_once(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "view"), str(tmp_path / "cp")
    df = spark.createDataFrame([(1, "inbox"), (1, "inbox"), (2, "work"), (3, "inbox")], "id long, folder string").withColumn("date", F.timestamp_seconds(F.col("id")))
    df.filter("id < 3").coalesce(1).write.parquet(source)

    def run():
        stream = sessions.watched(spark, source, "id long, folder string, date timestamp").withWatermark("date", "1 hour").dropDuplicatesWithinWatermark(["folder", "id"])
        view.keep_view(stream, path, checkpoint).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["id"], r["folder"]) for r in view.read_view(spark, path).collect())

    assert run() == [(1, "inbox"), (2, "work")]
    df.coalesce(1).write.mode("append").parquet(source)
    assert run() == [(1, "inbox"), (2, "work"), (3, "inbox")]
    # The last batches lose the note that they are done, as by a crash between the sink's commit and the query's.
    done = sorted((int(n), n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for _, n in done[-1:]:
        os.remove(f"{checkpoint}/commits/{n}")
        crc = f"{checkpoint}/commits/.{n}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    files = sorted(os.listdir(f"{path}/data"))
    assert run() == [(1, "inbox"), (2, "work"), (3, "inbox")]
    listed = sorted(f for b in view.lists(path) for f in b["files"])
    assert listed == files == sorted(os.listdir(f"{path}/data"))


def test_view_commits_and_aborts(spark, tmp_path):
    path = str(tmp_path / "view")
    kind = spark.createDataFrame([], "id long").schema
    writer = view.ViewWriter(path, kind)
    batch = lambda *ids: iter([pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())})])
    writer.commit([writer.write(batch(1, 2)), writer.write(iter([])), None], 0)
    again = [writer.write(batch(1, 2))]
    writer.commit(again, 0)  # the same batch once more
    lost = [writer.write(batch(7))]
    writer.abort(lost, 1)
    writer.commit([writer.write(batch(3))], 1)
    assert sorted(map(tuple, view.read_view(spark, path).collect())) == [(1, 0), (2, 0), (3, 1)]
    assert len(os.listdir(f"{path}/data")) == 2 and json.load(open(f"{path}/batches/000000000000.json"))["rows"] == 2
