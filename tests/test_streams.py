"""Streams against their batch forms, from files with an availableNow trigger."""

import datetime as dt
import tempfile
import time

from pyspark.sql import functions as F

from lessonloom.operators import practice as P
from lessonloom.plans.frames import Frames
from lessonloom.streaming import jobs as J
from lessonloom.streaming import keyed as K

FOLDER = "/root/testdata/sf0.001"


def drain(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def as_stream(df, files=3):
    path, top = tempfile.mkdtemp(prefix="spark-") + "/log", df.agg(F.max("id")).first()[0] + 1
    for k in range(files):  # in order of arrival; the source reads the oldest file first
        df.where((F.col("id") * files / top).cast("int") == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_dedup(spark):
    log = Frames(spark, FOLDER).attempts
    got = drain(J.dedup_stream(as_stream(log)), "dedup", "append")
    assert got.count() == P.first_per_key(log, ["student_id", "client_attempt_id"], ["created_at", "id"]).count()


def last_of_each(updates, keys):
    """Updates come in any order; completed and updated_at of a key only grow."""
    order = F.struct("completed", "updated_at", "correct_clears")
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")


def folded(table, keys):
    return {tuple(r[k] for k in keys): (r.completed, r.current_cycle, len(r.clears), r.correct_clears, r.stage, r.semantic_type, r.updated_at) for r in table.collect()}


def test_cycles_by_the_full_key(spark):
    from lessonloom.plans.progress import KEYED

    log = Frames(spark, FOLDER).sql(KEYED).withColumn("created_at", F.col("created_at").cast("timestamp"))
    updates = drain(K.cycle_stream(as_stream(log)), "cycles", "update")
    last = last_of_each(updates, P.PROGRESS_KEY)
    got = {tuple(r[k] for k in P.PROGRESS_KEY): (r.completed, r.current_cycle, r.open_clears, r.correct_clears, r.stage, r.semantic_type, r.updated_at) for r in last.collect()}
    want = folded(P.cycle_progress(log), P.PROGRESS_KEY)
    assert got == want and sum(x[0] for x in want.values()) > 20


def test_cycles_of_items_that_change(spark):
    """Removed items close a stuck cycle, in the stream as in the table; the items of a key change while it runs."""
    rows = [(k, k % 6, 1, 1, "abcdeab"[(k * 5 + k // 6) % 7], True, 4 if k < 150 else 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)) for k in range(300)]
    log = spark.createDataFrame(rows, "id long, student_id long, passage_id long, stage int, item_key string, correct boolean, stage_item_count int, created_at timestamp")
    keys = P.with_progress_key(log).select(*P.PROGRESS_KEY).distinct().where("student_id > 1")
    early = keys.withColumns({"active_items": F.array(*map(F.lit, "abcd")), "created_at": F.lit(dt.datetime(2023, 1, 1)).cast("timestamp")})
    late = keys.where("student_id > 3").withColumns({"active_items": F.array(*map(F.lit, "ab")), "created_at": F.lit(rows[150][-1]).cast("timestamp")})
    path = tempfile.mkdtemp(prefix="spark-") + "/active"
    for part in (early, late, late.where("false")):  # one file with each of the log's three
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    active = spark.readStream.schema(early.schema).option("maxFilesPerTrigger", 1).parquet(path)
    halves = spark.createDataFrame([r for r in rows if r[0] < 150], log.schema), spark.createDataFrame([r for r in rows if 150 <= r[0] < 200], log.schema), spark.createDataFrame([r for r in rows if r[0] >= 200], log.schema)
    path = tempfile.mkdtemp(prefix="spark-") + "/log"
    for part in halves:
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    updates = drain(K.cycle_stream(stream, active), "cycles_of_items", "update")
    want = folded(P.cycle_progress(log, active=early.unionByName(late)), P.PROGRESS_KEY)
    got = {tuple(r[k] for k in P.PROGRESS_KEY): (r.completed, r.current_cycle, r.correct_clears, r.updated_at) for r in last_of_each(updates, P.PROGRESS_KEY).collect()}
    assert got == {k: (v[0], v[1], v[3], v[6]) for k, v in want.items()}
    plain = folded(P.cycle_progress(log), P.PROGRESS_KEY)
    assert any(want[k][0] != plain[k][0] for k in want)


def test_progress_goes_on_from_an_earlier_result(spark):
    from lessonloom.plans.progress import KEYED

    log = Frames(spark, FOLDER).sql(KEYED)
    cut = log.approxQuantile("id", [0.5], 0.0)[0]
    first = P.cycle_progress(log.where(F.col("id") <= cut)).checkpoint()
    assert spark.createDataFrame(log.where("false").rdd, log.schema).count() == 0
    ids = log.where(F.col("id") <= cut).agg(F.max("created_at")).first()[0]
    early, late = log.where(F.col("created_at") <= F.lit(ids)), log.where(F.col("created_at") > F.lit(ids))
    both = P.cycle_progress(late, before=P.cycle_progress(early))
    assert folded(both, P.PROGRESS_KEY) == folded(P.cycle_progress(log), P.PROGRESS_KEY) and first.count()


def test_session_ends_come_by_themselves(spark):
    frames = Frames(spark, FOLDER)
    from lessonloom.plans.progress import ENDINGS

    sessions = frames.sessions.withColumnRenamed("user_id", "student_id").select("id", "student_id", "created_at", "expires_at")
    logouts, codes, gone = (frames.sql(q) for q in ENDINGS.values())
    logouts = logouts.withColumn("student_id", F.floor(F.col("session_id") / 100))
    want = {(r.id, r.student_id, r.created_at, r.ended_at, r.reason) for r in P.session_intervals(sessions, logouts, codes, gone).collect()}
    late = sessions.agg(F.max("expires_at")).first()[0] + dt.timedelta(days=20)

    def stream(df, time_column, marker):
        """Three files in the order of time, and a row far later, so that the watermark passes every end."""
        path, first = tempfile.mkdtemp(prefix="spark-") + "/log", df.agg(F.min(time_column), F.max(time_column)).first()
        step = (first[1] - first[0]) / 3
        edges = [first[0] - dt.timedelta(1), first[0] + step, first[0] + 2 * step, first[1] + dt.timedelta(1)]
        for a, b in zip(edges, edges[1:]):
            df.where((F.col(time_column) > F.lit(a)) & (F.col(time_column) <= F.lit(b))).coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)
        df.limit(1).withColumns({c: F.lit(x).cast(df.schema[c].dataType) for c, x in marker.items()}).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    marks = {"student_id": -1, "happened_at": late}
    inputs = [stream(sessions, "created_at", {"id": -1, "student_id": -1, "created_at": late, "expires_at": late + dt.timedelta(9)}), stream(logouts, "happened_at", marks), stream(codes, "happened_at", marks), stream(gone, "happened_at", marks)]
    got = drain(K.session_stream(*inputs, delay="12 days"), "ends", "append").where("id >= 0")
    rows = [(r.id, r.student_id, r.created_at, r.ended_at, r.reason) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r[4] for r in rows} >= {"expiry", "logout", "code_change"}


def test_summary_and_clears(spark):
    log = Frames(spark, FOLDER).attempts
    got = drain(J.cumulative_clears(as_stream(log)), "clears", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, J.cumulative_clears(log).collect()))
    days = drain(J.period_summary(as_stream(log)), "days", "complete")
    assert days.agg(F.sum("total")).first()[0] == log.count()


def test_store_and_forward(spark):
    log = Frames(spark, FOLDER).attempts
    base = tempfile.mkdtemp(prefix="spark-")
    judge = lambda b: b.withColumn("outcome", F.when(F.col("correct"), "stored").otherwise("rejected"))
    J.store_and_forward(as_stream(log), f"{base}/stored", f"{base}/rejected", f"{base}/checkpoint", judge).awaitTermination()
    assert spark.read.parquet(f"{base}/stored").count() + spark.read.parquet(f"{base}/rejected").count() == log.count()


def test_lockout_and_touches(spark):
    from lessonloom.streaming import stateful as T

    frames = Frames(spark, FOLDER)
    from lessonloom.plans.progress import LIMITS, WINDOW

    tries = frames.logins.withColumns({"at_us": F.unix_micros(F.col("created_at").cast("timestamp")), "realm": F.concat(F.lit("school:"), "realm")})
    got = drain(T.lockout_stream(as_stream(tries), LIMITS, WINDOW), "locked", "append")
    want = P.login_lockout(tries, LIMITS, WINDOW, key="realm").collect()
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    touches = frames.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.lit(None).cast("long").alias("started_us"))
    got = drain(T.thin_stream(as_stream(touches), minutes=600), "touches", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.thin_touches(touches, minutes=600).collect()))


def test_taps(spark):
    from lessonloom.streaming import stateful as T

    words = "the cat saw the dog run".split()
    taps = Frames(spark, FOLDER).events.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 6).cast("int").alias("chip"))
    updates = drain(T.tap_stream(as_stream(taps.withColumn("norm", F.array(*map(F.lit, words)))), step=2), "taps", "update")
    last = updates.groupBy("run_id").agg(F.max_by(F.struct("placed", "mistakes", "restarts", "completed"), F.struct("mistakes", "restarts", "placed")).alias("x"))
    runs = taps.select("run_id").distinct().withColumn("words", F.array(*map(F.lit, words)))
    want = {r.run_id: (r.placed, r.mistakes, r.restarts, r.completed) for r in P.replay_taps(taps, runs, step=2).collect()}
    assert {r.run_id: tuple(r.x) for r in last.collect()} == want


def test_days_kept_by_a_stream(spark):
    """Progress of any period from day cells, as over all attempts; no attempt is read for it."""
    from lessonloom.operators import tables as O
    from lessonloom.sources.snapshots import Snapshot

    frames = Frames(spark, FOLDER)
    cells = Snapshot(spark, tempfile.mkdtemp(prefix="spark-"), ["student_id", "stage", "day"], buckets=8)
    J.keep_days(as_stream(frames.attempts), cells, tempfile.mkdtemp(prefix="spark-")).awaitTermination()
    last = frames.attempts.agg(F.max("created_at")).first()[0]
    midnight = dt.datetime(last.year, last.month, last.day, 15) - dt.timedelta(days=1)
    for back in (0, 7, 30):
        since = str(midnight - dt.timedelta(days=back))
        got = O.learning_progress_of_days(frames.students, cells.read(), since)
        want = O.learning_progress(frames.students, frames.attempts, since)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        files = got.inputFiles()
        assert any("key_bucket" in p for p in files) and not any("events" in p for p in files)
    assert want.agg(F.sum("total_1")).first()[0] > 0


def test_scopes_kept_by_a_stream(spark):
    """Inserts and changes of grades, batch by batch, end as the table form does after each batch."""
    from lessonloom.operators import tables as O
    from lessonloom.sources.snapshots import Snapshot

    scopes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, grade string")
    batches = [[(10, "a", 1), (11, "b", 1), (12, "a", 1)], [(11, "a", 2), (13, "b", 2), (14, "z", 2)], [(10, "b", 3), (10, "z", 4), (12, "b", 3), (11, "b", 3), (15, "a", 3)], [(10, "a", 5), (14, "b", 5)]]
    path = tempfile.mkdtemp(prefix="spark-") + "/in"
    links, passages = spark.createDataFrame([(3, 99, 0)], "exam_id long, passage_id long, position long"), {99: "c"}
    snapshot = Snapshot(spark, tempfile.mkdtemp(prefix="spark-"), ["exam_id"], buckets=4)
    snapshot.change(links, lambda base: links)
    for rows in batches:
        df = spark.createDataFrame(rows, "id long, grade string, changed_at int")
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
        passages |= {i: g for i, g, _ in sorted(rows, key=lambda r: r[2])}
        links = O.sync_grade_scope(links, scopes, spark.createDataFrame(list(passages.items()), "id long, grade string"), ["a", "b", "c"])[0].checkpoint()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    J.sync_scopes(stream, scopes, ["a", "b", "c"], snapshot, tempfile.mkdtemp(prefix="spark-")).awaitTermination()
    show = lambda rows: sorted((r.exam_id, r.passage_id, r.position) for r in rows.collect())
    assert show(snapshot.read()) == show(links) and len(show(links)) == 7


def test_lockout_of_a_stream_without_realms(spark):
    from lessonloom.sources.snapshots import BatchLog

    frames = Frames(spark, FOLDER)
    limits = {"code": 2, "student_client": 4, "admin_client": 2, "admin": 3}
    tries = frames.logins.withColumn("at_us", F.unix_micros(F.col("created_at").cast("timestamp"))).select("id", "at_us", "successful", "admin", "code", "client")
    order = tries.approxQuantile("at_us", [0.33, 0.66], 0.0)
    path = tempfile.mkdtemp(prefix="spark-") + "/in"
    for a, b in zip([float("-inf"), *order], [*order, float("inf")]):
        tries.where((F.col("at_us") > a) & (F.col("at_us") <= b)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(tries.schema).option("maxFilesPerTrigger", 1).parquet(path)
    blocked, failures = (BatchLog(spark, tempfile.mkdtemp(prefix="spark-"), ["id"], buckets=2) for _ in range(2))
    J.lock_out(stream, blocked, failures, tempfile.mkdtemp(prefix="spark-"), limits, 24 * 60).awaitTermination()
    want = {(r.id, r.blocked_by) for r in P.login_lockout(tries, limits, 24 * 60).collect()}
    assert {(r.id, r.blocked_by) for r in blocked.read().collect()} == want and len(want) > 5
