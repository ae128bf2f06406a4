"""Snapshots, logs, the first-seen index and the write path: what is read, what is rewritten, and what a second run does."""

import datetime as dt
import json
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from lessonloom import constants as C
from lessonloom.operators import practice as P
from lessonloom.operators import tables as O
from lessonloom.plans.frames import Frames
from lessonloom.sources import readers as R
from lessonloom.sources.seen import SeenIndex
from lessonloom.sources.snapshots import BatchLog, Snapshot, audit_logs
from lessonloom.streaming import write_path as W

FOLDER = "/root/testdata/sf0.001"
new = lambda: tempfile.mkdtemp(prefix="spark-")
rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def test_snapshot_rewrites_touched_buckets_alone(spark):
    base = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("w"))
    table = Snapshot(spark, new(), ["k"], buckets=512)
    assert table.upsert(base) == 1 and table.read().count() == 10_000
    changes = spark.createDataFrame([(i * 997, -1, "y") for i in range(10)] + [(20_000, 5, "z"), (None, 6, "z")], "k long, v long, w string")
    before = table.read()
    assert table.upsert(changes.where("k < 10000"), ["v"]) == 2
    assert table.manifest()["rewritten"] <= 10 < 0.05 * 512
    assert table.manifest()["rewritten"] == 10 - (10 - len(table.touched(changes.where("k < 10000"))))
    table.upsert(changes, ["v"])
    assert rows_of(table.read()) == rows_of(R.upsert(base, changes, ["k"], ["v"]))
    assert rows_of(before) == rows_of(base) and rows_of(table.read(1)) == rows_of(base)  # who reads a version goes on reading it
    assert rows_of(table.lookup(changes.select("k"))) == sorted([(i * 997, -1, "x") for i in range(10)] + [(20_000, 5, "z")], key=repr)
    table.delete(spark.createDataFrame([(0,), (3,)], "k long"))
    assert table.read().count() == 10_000
    table.clear_old(1)
    assert table.read().count() == 10_000 and len(table.folder.names("manifests")) == 1
    with pytest.raises(FileExistsError):
        table.folder.publish(f"manifests/{table.version():010d}.json", {})


def test_snapshot_takes_a_batch_once(spark):
    table = Snapshot(spark, new(), ["k"], buckets=8)
    rows = spark.createDataFrame([(1, 1), (2, 2)], "k long, v long")
    assert (table.upsert(rows, batch=0), table.upsert(rows.withColumn("v", F.lit(9)), ["v"], batch=0)) == (1, 1)
    assert rows_of(table.read()) == [(1, 1), (2, 2)]


def test_log_is_appended_once_and_audited_by_digests(spark, monkeypatch):
    log = Frames(spark, FOLDER).attempts.select("id", "student_id", "item_key", "correct")
    a, b = (BatchLog(spark, new(), ["id"], buckets=16) for _ in range(2))
    for k in range(3):
        part = log.where(F.col("id") % 3 == k)
        assert a.append(part, k) and not a.append(part, k) and b.append(part, k)
    assert a.read().count() == log.count()
    reads = []
    real = BatchLog.read
    monkeypatch.setattr(BatchLog, "read", lambda self, *x, **y: reads.append(y) or real(self, *x, **y))
    assert audit_logs(a, b).count() == 0 and not reads  # equal logs: digests alone
    c = BatchLog(spark, new(), ["id"], buckets=16)
    for k in range(3):
        part = log.where(F.col("id") % 3 == k)
        c.append(part.where("id <> 30").withColumn("item_key", F.when(F.col("id") == 61, "other").otherwise(F.col("item_key"))), k)
    assert rows_of(audit_logs(a, c)) == [(30, "missing"), (61, "changed")]
    assert [x for x in reads if x] and all(len(x["buckets"]) <= 2 and x["batches"] == [0, 1] for x in reads)
    assert audit_logs(a, BatchLog(spark, new(), ["id"], buckets=16)).count() == log.count()


def test_unfinished_batch_of_a_log_is_not_there(spark):
    log = BatchLog(spark, new(), ["id"], buckets=4)
    rows = spark.range(10)
    rows.withColumn("key_bucket", F.lit(0)).write.partitionBy("key_bucket").parquet(f"{log.folder.path}/data/batch=7")  # died before its digests
    assert log.read() is None and log.append(rows.where("id < 3"), 7) and log.read().count() == 3


def test_index_refuses_repeats_after_any_time(spark):
    index = SeenIndex(spark, new(), ["student_id", "client"], buckets=8, fan=3)
    seen, opened = set(), []
    for day in range(10):
        rows = [(s, f"id{day * 40 + k}", day * 1000 + s * 50 + k) for s in range(3) for k in range(40)] + [(1, "id5", day * 1000 + 999), (None, "x", day), (2, None, day)]
        df = spark.createDataFrame(rows, "student_id long, client string, at long")
        got = rows_of(index.first(df, ["at"]))
        want = {}
        for r in sorted(rows, key=lambda r: r[2]):
            if r[:2] not in seen and None not in r[:2]:
                want.setdefault(r[:2], r)
        assert got == sorted([*want.values(), *[r for r in rows if None in r[:2]]], key=repr)
        opened.append(index.opened)
        assert index.add(df, day) and not index.add(df, day)
        seen |= {r[:2] for r in rows}
    levels = index.manifest()["levels"]
    assert sum(map(len, levels)) <= 2 * len(levels) and len(index.folder.names("keys")) == sum(map(len, levels))
    assert index.first(df, ["at"]).count() == 2 and max(opened) <= 8  # of over twenty buckets in segments


def test_repeat_after_31_days_is_refused_on_the_stream(spark):
    start, schema = dt.datetime(2024, 1, 1), "id long, student_id long, client_key string, created_at timestamp"
    days = [[(d * 10 + k, k, f"c{d}-{k}", start + dt.timedelta(days=d)) for k in range(5)] for d in (0, 20, 40, 60)]
    days[3] += [(99, 2, "c0-2", start + dt.timedelta(days=60)), (98, 2, None, start)]
    path, folder = new() + "/in", new()
    index, sink = SeenIndex(spark, f"{folder}/index", ["student_id", "client_key"], buckets=4), BatchLog(spark, f"{folder}/log", ["student_id", "client_key"], buckets=4)
    for rows in days:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = W.dedup_forever(stream, index, sink, ["created_at", "id"], f"{folder}/checkpoint")
    query.awaitTermination()
    assert sorted(r.id for r in sink.read().collect()) == sorted([d * 10 + k for d in (0, 20, 40, 60) for k in range(5)] + [98])
    assert not query.lastProgress["stateOperators"]


# --- write path -------------------------------------------------------------------

UUID = "00000000-0000-4000-8000-{:012d}"


def requests_of(spark, frames):
    """Requests with attempts right, wrong, repeated, out of scope, malformed or of no use."""
    sentences = [r.asDict() for r in P.practice_items(frames.sentences.where("passage_id < 4")).collect()]
    out, n = [], 0
    for k in range(60):
        attempts = []
        for j in range(1 + k % 4):
            s = sentences[(k * 3 + j) % len(sentences)]
            n += 1
            attempts.append({"sentenceId": str(s["id"] if k % 7 else 5), "examId": str(1 if k % 11 else 2), "passageId": str(s["passage_id"]), "step": 1 + j % 2, "arranged": s["answer"] if k % 5 else "wrong order", "mistakes": j % 2, "restarts": 0, "clientAttemptId": "no uuid" if k % 13 == 5 else UUID.format(n - 1 if k % 6 in (1, 4) else n)})
        body = json.dumps({"op": "submit", "attempts": attempts}) if k % 17 else "[]" if k % 2 else '{"op": "x"}'
        out.append((k, 1 + k // 6 % 3, body, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)))
    return spark.createDataFrame(out, "id long, student_id long, body string, arrived_at timestamp")


@pytest.fixture(scope="module")
def judged_by(spark):
    frames = Frames(spark, FOLDER)
    students = spark.createDataFrame([(1, "s", "g", True), (2, "s", "g", True), (3, "s", "g", False)], "id long, school string, grade string, active boolean")
    exams = spark.createDataFrame([(1, "s", "g")], "id long, school string, grade string")
    links = spark.createDataFrame([(1, p) for p in range(3)], "exam_id long, passage_id long")
    passages = spark.createDataFrame([(p, 7) for p in range(5)], "passage_id long, revision long")
    sentences = frames.sentences.where("passage_id < 4").checkpoint()
    return frames, W.Tables(lambda: students, lambda: exams, lambda: links, lambda: sentences, lambda: passages)


def parts(requests):
    return [requests.where(f"id between {a} and {a + 19}") for a in (0, 20, 40)]


def whole_result(path):
    outcomes = {r.id: (r.outcome, r.reason, r.correct) for r in path.outcomes.read().collect()}
    progress = {tuple(r[k] for k in P.PROGRESS_KEY): (r.completed, r.clears, r.correct_clears, r.updated_at) for r in path.progress.read().collect()}
    return outcomes, progress


def test_write_path(spark, judged_by, monkeypatch):
    frames, tables = judged_by
    requests = requests_of(spark, frames)
    path = W.WritePath(spark, new(), tables, buckets=4)
    for k, part in enumerate(parts(requests)):
        assert path.commit(part, k) and not path.commit(part, k)
    outcomes, progress = whole_result(path)
    # The same attempts at once, with nothing stored before.
    attempts, bad = path.attempts_of(requests)
    t = tables
    access = O.authorize_attempts(attempts, t.students(), t.current_exams(), t.links()).where("denied is null").select("student_id", "passage_id", "exam_id")
    none = spark.createDataFrame([], "student_id long, client_attempt_id string, stored_correct boolean")
    items = P.practice_items(t.sentences()).select(F.col("id").alias("sentence_id"), "passage_id", "text")
    want = {r.id: (r.outcome, r.reason, r.correct) for r in P.submit_attempts(attempts, none, access, items, t.passages()).collect()}
    assert {i: x[:2] for i, x in outcomes.items()} == {i: x[:2] for i, x in want.items()}
    assert {x[0] for x in outcomes.values()} == {"stored", "rejected", "replayed"} and len({x[1] for x in outcomes.values()}) > 4
    stored = path.stored.read()
    assert {r.id for r in stored.collect()} == {i for i, x in want.items() if x[0] == "stored"} and stored.count() == len({r.id for r in stored.collect()})
    assert path.rejected.read().count() == bad.count() > 0
    folded = P.cycle_progress(stored)
    assert progress == {tuple(r[k] for k in P.PROGRESS_KEY): (r.completed, r.clears, r.correct_clears, r.updated_at) for r in folded.collect()} and progress
    # Replays tell what was stored.
    first = {(r.student_id, r.client_key): r.correct for r in stored.collect()}
    assert all(r.correct == first[r.student_id, r.client_key] for r in path.outcomes.read().where("outcome = 'replayed'").collect())

    # Killed between any two of its tables and run again, on changed tables: nothing doubled, nothing lost.
    for at in ("stored.append", "progress.upsert", "marks.publish"):
        other = W.WritePath(spark, new(), tables, buckets=4)
        name, method = at.split(".")
        for k, part in enumerate(parts(requests)[:2]):
            if k == 1:
                target, real = getattr(other, name), getattr(getattr(other, name), method)
                monkeypatch.setattr(target, method, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("killed")))
                with pytest.raises(RuntimeError):
                    other.commit(part, k)
                monkeypatch.setattr(target, method, real)
            assert other.commit(part, k)
        got, held = whole_result(other)
        assert got == {i: x for i, x in outcomes.items() if i < 40 * C.BATCH_SIZE}
        assert held == {tuple(r[k] for k in P.PROGRESS_KEY): (r.completed, r.clears, r.correct_clears, r.updated_at) for r in P.cycle_progress(other.stored.read()).collect()}
        assert other.stored.read().count() == stored.where(f"id < {40 * C.BATCH_SIZE}").count()


def test_write_path_as_a_stream(spark, judged_by):
    frames, tables = judged_by
    requests, folder = requests_of(spark, frames), new()
    for part in parts(requests):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    path = W.WritePath(spark, f"{folder}/out", tables, buckets=4)
    path.start(stream, f"{folder}/checkpoint").awaitTermination()
    whole = W.WritePath(spark, new(), tables, buckets=4)
    whole.commit(requests, 0)
    a, b = whole_result(path), whole_result(whole)
    assert {i: x[:2] for i, x in a[0].items()} == {i: x[:2] for i, x in b[0].items()} and a[1] == b[1]
