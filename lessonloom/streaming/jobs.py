"""Jobs that run on streams and on tables alike, and the stream pipeline of attempts.

The event time is the time of arrival, which is never late; watermarks only bound state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom import constants as C
from lessonloom.functions.session import shared_folder
from lessonloom.operators.practice import login_lockout
from lessonloom.operators.tables import add_cells, append_members, day_cells, renumber
from lessonloom.sources.readers import batch_queue, merge_queues
from lessonloom.sources.snapshots import BatchLog, Snapshot

STATE_DAYS = "30 days"


def dedup_stream(attempts: DataFrame, watermark: str = STATE_DAYS) -> DataFrame:
    """First write per student and client id within the watermark; rows without an id all pass."""
    timed = attempts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    named = timed.withColumn("dedup_key", F.coalesce(F.lower("client_attempt_id"), F.concat(F.lit("row:"), F.col("id").cast("string"))))
    return named.dropDuplicatesWithinWatermark(["student_id", "dedup_key"]).drop("dedup_key")


def cumulative_clears(attempts: DataFrame) -> DataFrame:
    return attempts.where("correct").groupBy("student_id", "passage_id", "stage").agg(F.count("*").alias("clears"), F.max("created_at").alias("updated_at"))


def period_summary(attempts: DataFrame, watermark: str = STATE_DAYS) -> DataFrame:
    """Counts per student, step and Korean day (midnight is 15:00 UTC)."""
    timed = attempts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    day = F.window("created_at", "1 day", startTime="15 hours")
    counted = timed.groupBy("student_id", "stage", day).agg(F.count("*").alias("total"), F.count_if("correct").alias("clean"))
    return counted.select("student_id", "stage", F.col("window.start").alias("day"), "total", "clean")


def failed_logins(tries: DataFrame, minutes: int = C.FAILURE_WINDOW_MINUTES, watermark: str = "1 hour") -> DataFrame:
    """Failures per identifier in sliding windows that begin every minute."""
    timed = tries.where(~F.col("successful")).withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    counted = timed.groupBy("identifier", F.window("created_at", f"{minutes} minutes", "1 minute")).agg(F.count("*").alias("failures"))
    return counted.select("identifier", F.col("window.start").alias("window_start"), "failures")


def keep_days(attempts: DataFrame, cells: Snapshot, checkpoint: str):
    """Day cells kept by a stream of attempts, for ``learning_progress_of_days``: each micro-batch adds its own cells, once."""

    def add(batch: DataFrame, number: int) -> None:
        fresh = day_cells(batch).checkpoint()
        cells.change(fresh, lambda base: add_cells(base, fresh), batch=number)

    shared_folder(attempts.sparkSession)
    return attempts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_scopes(changes: DataFrame, scopes: DataFrame, grades: list[str], links: Snapshot, checkpoint: str):
    """Scopes kept by a stream of passages that are new or change their grade (id, grade, and changed_at for several in one batch).

    links: a snapshot by exam_id, as ``sync_grade_scope`` has left it. Of a batch only the
    passages in it can leave a scope or come to one; positions are handed out batch by batch.
    """
    own = scopes.where(F.col("grade").isin(*grades))

    def sync(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("id").agg(F.max_by("grade", "changed_at").alias("grade")).checkpoint()
        moved = last.select(F.col("id").alias("passage_id"), F.col("grade").alias("now"))
        exams = own.select(F.col("id").alias("exam_id"), "grade")

        def merge(base: DataFrame) -> DataFrame:
            judged = base.join(moved, "passage_id", "left").join(exams, "exam_id", "left")
            stays = judged.where(F.col("now").isNull() | F.col("grade").isNull() | (F.col("now") == F.col("grade"))).select("exam_id", "passage_id", F.col("position").alias("old"))
            compact = renumber(stays, "exam_id", ["old", "passage_id"]).drop("old")
            extra = moved.join(exams, moved["now"] == exams["grade"]).select("exam_id", "passage_id", F.col("passage_id").alias("ordinal"))
            return append_members(compact, extra).select("exam_id", "passage_id", "position")

        shape = exams.select("exam_id", F.lit(0).cast("long").alias("passage_id"), F.lit(0).cast("long").alias("position"))
        links.change(exams, merge, batch=number, like=shape)

    shared_folder(changes.sparkSession)
    return changes.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lock_out(tries: DataFrame, blocked: BatchLog, failures: BatchLog, checkpoint: str, limits: dict[str, int] = C.LOGIN_LIMITS, minutes: int = C.FAILURE_WINDOW_MINUTES):
    """Login lockout on a stream without realms: each micro-batch is replayed in pieces, from the failures that the batches before it recorded in their last window.

    tries come in the order of time. blocked and failures are logs by batch; the stream keeps no state.
    """
    columns = ["id", "at_us", "admin", "code", "client"]

    def judge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns, "successful").checkpoint()
        first = rows.agg(F.min("at_us")).first()[0]
        before = failures.read(before=number)
        recorded = None if before is None or first is None else before.where(F.col("at_us") >= first - minutes * 60_000_000).select(*columns)
        found = login_lockout(rows, limits, minutes, recorded=recorded).checkpoint()
        failures.append(rows.where(~F.col("successful")).join(found.select("id"), "id", "left_anti").select(*columns), number)
        blocked.append(found, number)

    shared_folder(tries.sparkSession)
    return tries.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forwarded(deliveries: DataFrame, judge: Callable[[DataFrame], DataFrame], key: str = "student_id") -> DataFrame:
    """The table form of ``store_and_forward``: attempts that come at least once, perhaps days late, leave a student's queue in batches in the order of arrival, and each is judged once.

    deliveries: the attempts' columns and arrived_at; what is delivered again is the same
    attempt. An attempt without a client id is only ever itself. judge adds outcome.
    """
    same = F.coalesce(F.lower("client_attempt_id"), F.concat(F.lit("row:"), F.col("id").cast("string")))
    first = merge_queues(deliveries.withColumn("delivery_key", same), [key, "delivery_key"], ["arrived_at", "id"])
    return judge(batch_queue(first, [key], ["arrived_at", "id"]).drop("delivery_key"))


def store_and_forward(outcomes: DataFrame, stored_path: str, rejected_path: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame]):
    """Each micro-batch is judged once; stored and rejected rows go to logs of their own, under the batch's number, so that a batch that is run again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        judged = judge(batch)
        for outcome, path in (("stored", stored_path), ("rejected", rejected_path)):
            judged.where(F.col("outcome") == outcome).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
