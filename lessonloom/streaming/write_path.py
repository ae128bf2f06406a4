"""The write path of attempts as one stream: request, replay, access, item, grade, store, fold.

Each micro-batch ends in several tables under its own number: outcomes of every attempt,
stored attempts, rejected ones with requests that could not be read, and progress. What
is in a table of that number is not written again, progress is folded from what was
stored, and the mark of the batch comes last; so a run that dies anywhere between is
finished by the next run of the same batch, with nothing doubled and nothing lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom import constants as C
from lessonloom.functions.session import shared_folder
from lessonloom.operators.practice import PROGRESS_KEY, cycle_progress, practice_items, submit_attempts, with_progress_key
from lessonloom.operators.tables import authorize_attempts
from lessonloom.sources.readers import parse_attempt_requests
from lessonloom.sources.seen import SeenIndex
from lessonloom.sources.snapshots import BUCKET, BatchLog, Folder, Snapshot, bucket_of


@dataclass
class Tables:
    """What a batch is judged by, read anew for each: students (id, school, grade, active), current_exams (id, school, grade), links (exam_id, passage_id), sentences, passages (passage_id, revision)."""

    students: Callable[[], DataFrame]
    current_exams: Callable[[], DataFrame]
    links: Callable[[], DataFrame]
    sentences: Callable[[], DataFrame]
    passages: Callable[[], DataFrame]


class WritePath:
    """Tables under one folder: ``outcomes``, ``stored``, ``rejected`` (logs by batch), ``progress`` (a snapshot) and the index of stored ids."""

    ID = ["student_id", "client_key"]

    def __init__(self, spark: SparkSession, folder: str, tables: Tables, buckets: int = 64):
        shared_folder(spark)
        self.spark, self.tables, self.marks = spark, tables, Folder(spark, folder)
        self.outcomes = BatchLog(spark, f"{folder}/outcomes", ["student_id", "id"], buckets)
        self.stored = BatchLog(spark, f"{folder}/stored", self.ID, buckets)
        self.rejected = BatchLog(spark, f"{folder}/rejected", ["student_id", "id"], buckets)
        self.progress = Snapshot(spark, f"{folder}/progress", PROGRESS_KEY, buckets)
        self.index = SeenIndex(spark, f"{folder}/index", self.ID, buckets)

    def known(self, attempts: DataFrame, before: int) -> DataFrame:
        """Stored attempts with an id that one of these has: the index names the few buckets of the log that hold them."""
        seen = self.index.seen(attempts).checkpoint()
        keys = self.index.hashed(attempts).join(seen, ["h1", "h2"], "left_semi").select(*self.ID).distinct()
        # At most as many numbers as there are buckets.
        buckets = [r[0] for r in keys.select(bucket_of(self.ID, self.stored.buckets).alias(BUCKET)).distinct().collect()]
        found = self.stored.read(before=before, buckets=buckets) if buckets else None
        if found is None:
            return attempts.where("false").select("student_id", F.col("client_key").alias("client_attempt_id"), F.lit(None).cast("boolean").alias("stored_correct"))
        return found.join(keys, self.ID, "left_semi").select("student_id", "client_attempt_id", F.col("correct").alias("stored_correct"))

    def attempts_of(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(attempts, requests that cannot be read); requests: id, student_id, body, arrived_at. An attempt's id is its request's and its place in it."""
        good, bad = parse_attempt_requests(requests, "body")
        a = F.col("attempt")
        rows = good.select((F.col("id") * C.BATCH_SIZE + F.col("pos")).cast("long").alias("id"), "student_id", a["examId"].cast("long").alias("exam_id"), a["passageId"].cast("long").alias("passage_id"), a["sentenceId"].cast("long").alias("sentence_id"), a["clientAttemptId"].alias("client_attempt_id"), F.lower(a["clientAttemptId"]).alias("client_key"), a["step"].alias("step"), a["arranged"].alias("arranged"), a["mistakes"].alias("mistakes"), a["restarts"].alias("restarts"), F.col("arrived_at").alias("created_at"))
        return rows, bad.select((F.col("id") * C.BATCH_SIZE).cast("long").alias("id"), "student_id", F.col("error").alias("reason"))

    def judge(self, attempts: DataFrame, before: int) -> DataFrame:
        """The outcome of each attempt, as ``submit_attempts`` has it, against what was stored before the batch."""
        t = self.tables
        open_ones = authorize_attempts(attempts, t.students(), t.current_exams(), t.links()).where("denied is null")
        items = practice_items(t.sentences()).select(F.col("id").alias("sentence_id"), "passage_id", "text", "item_key")
        done = submit_attempts(attempts, self.known(attempts, before), open_ones.select("student_id", "passage_id", "exam_id"), items, t.passages())
        facts = attempts.select("id", "student_id", "exam_id", "passage_id", "client_attempt_id", "client_key", F.col("step").alias("stage"), "created_at", "sentence_id")
        return facts.join(done, "id").join(items.select("sentence_id", "item_key"), "sentence_id", "left").drop("sentence_id")

    def commit(self, requests: DataFrame, batch: int) -> bool:
        """Brings a micro-batch in; False if it is in already."""
        mark = f"commits/{batch:010d}.json"
        if self.marks.exists(mark):
            return False
        if batch not in self.outcomes.batches():
            attempts, bad = self.attempts_of(requests)
            judged = self.judge(attempts.checkpoint(), batch)
            self.outcomes.append(judged.withColumn("workbook_key", F.lit(C.WORKBOOK_KEY)).withColumn("stage_contract_version", F.lit(C.CONTRACT)).withColumn("semantic_type", F.concat(F.lit("sentence_order_step"), F.col("stage"))), batch)
            self.rejected.append(bad, batch)
        # From here on what the outcomes say counts, not what the tables would say now.
        written = self.outcomes.read(batches=[batch])
        stored = written.where("outcome = 'stored'").drop("batch", BUCKET) if written is not None else None
        if stored is not None:
            self.stored.append(stored, batch)
            self.fold(stored, batch)
            self.index.add(stored, batch)
        self.marks.publish(mark, {"batch": batch})
        return True

    def fold(self, stored: DataFrame, batch: int) -> None:
        """Takes the progress of the touched keys on by what the batch has stored."""
        if batch <= self.progress.manifest()["batch"]:
            return
        keyed = with_progress_key(stored.where("correct"))
        shape = cycle_progress(keyed.where("false"))
        before = self.progress.lookup(keyed, like=shape)
        after = cycle_progress(keyed, before=before).checkpoint()
        self.progress.upsert(after, [c for c in after.columns if c not in PROGRESS_KEY], batch=batch)

    def start(self, requests: DataFrame, checkpoint: str):
        """The stream of requests into these tables."""
        return requests.writeStream.foreachBatch(lambda rows, number: self.commit(rows, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_forever(stream: DataFrame, index: SeenIndex, sink: BatchLog, order: list, checkpoint: str):
    """Rows of keys that never came before, however long ago, into a log; the stream keeps no state."""

    def write(rows: DataFrame, number: int) -> None:
        if number <= index.manifest()["batch"]:
            return
        sink.append(index.first(rows, order), number)
        written = sink.read(batches=[number])
        index.add(rows.where("false") if written is None else written, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
