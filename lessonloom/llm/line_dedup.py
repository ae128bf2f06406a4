"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of ascending ids. A batch groups its lines' 128-bit hashes to
the least id that holds them (partial sums first, so that a common line costs a row a
task), merge-anti-joins them with the runs there are, and writes the rest as a run of its
own. Runs are bucketed, sorted tables in the shared folder, all in the same number of
buckets: the batch's rows are shuffled once, the runs never. The batch that makes ``fan`` runs
of one level is written together with the others of it, as one run of the next. Buckets are as
many as the lines ask for (``BUCKET_ROWS``), not one a shuffle partition, as each is a file of
each run. A line goes where the runs hold its hash under another id;
the join for it deals lines by hash and id together, so no common line meets in a task.

Defined results: a null or empty text is one empty line; a null id comes after all others
and stays null; rows of one id (or of none) take no lines from one another, and are told
apart by their texts; of repeated rows each comes back; a key is judged by its code points
after trimming and A-Z lower-casing; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.functions.session import NUMBER_KEY
from lessonloom.llm.common import BLANKS, LAST_ID, back_to_null, read_documents, shuffle_partitions, text_key, with_checkpoint_dir

LEAST_KEY = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DATABASE = "lessonloom_line_runs"
HASH = ["h1", "h2"]
#: Lines of all batches (24 bytes each in a run) for which there is a bucket, as long as the session has partitions for it.
BUCKET_ROWS = 500_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased; ``lower`` does the same for ASCII, at less cost."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines whose key counts: id, tag (128 bits of the text), place, and the key's hash as two numbers."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    tagged = rows.withColumn("tag", text_key(F.col("body").cast("binary")))  # once a text: beside the lines it would be hashed whole for each of them
    lines = tagged.select("id", "tag", F.posexplode(F.split("body", "\n")).alias("place", "line"))
    keys = lines.select("id", "tag", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= LEAST_KEY)
    return keys.select("id", "tag", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


@contextmanager
def exchanges_of(spark: SparkSession, partitions: int) -> Iterator[int]:
    """While it lasts, exchanges have so many partitions, so that they fit buckets; gives the number that the session really took."""
    keys = ("spark.sql.shuffle.partitions", NUMBER_KEY)
    before = {key: value for key, value in spark.conf.getAll.items() if key in keys}
    try:
        for key in keys:
            spark.conf.set(key, str(partitions))
        yield shuffle_partitions(spark)
    finally:
        for key in keys:
            spark.conf.set(key, before[key]) if key in before else spark.conf.unset(key)


def buckets_for(spark: SparkSession, lines: int) -> int:
    """One for ``BUCKET_ROWS`` lines, and one a core at least; no more than the session's shuffle partitions."""
    return min(shuffle_partitions(spark), max(spark.sparkContext.defaultParallelism, -(-lines // BUCKET_ROWS)))


class LineRuns:
    """Levels of sorted runs (h1, h2, id): each hash with the document that keeps it."""

    def __init__(self, spark: SparkSession, fan: int = 3, buckets: int | None = None):
        with_checkpoint_dir(spark)
        self.spark, self.fan = spark, fan
        with exchanges_of(spark, buckets or shuffle_partitions(spark)) as self.buckets:
            pass
        self.levels: list[list[str]] = []
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/line_runs"
        spark.sql(f"create database if not exists {DATABASE} location '{folder}'")

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{DATABASE}.run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Adds the hashes that no run holds, under the least id of the batch that has them. Later batches keep out of what earlier ones hold."""
        firsts = lines.groupBy(*HASH).agg(F.min("id").alias("id"))
        fresh = reduce(lambda left, run: left.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), self.runs(), firsts)
        level, done = 0, []
        while level < len(self.levels) and len(self.levels[level]) + 1 >= self.fan:
            done += self.levels[level]
            self.levels[level] = []
            level += 1
        with exchanges_of(self.spark, self.buckets):
            self._write(reduce(DataFrame.unionByName, map(self.spark.table, done), fresh).repartition(self.buckets, *HASH) if done else fresh, level)
        for name in done:
            self.spark.sql(f"drop table {name}")

    def extra(self, lines: DataFrame) -> DataFrame:
        """The lines that another document keeps."""
        runs = self.runs()
        return lines.join(reduce(DataFrame.unionByName, runs), [*HASH, "id"], "left_anti") if runs else lines.where("false")

    def drop(self) -> None:
        for name in (name for level in self.levels for name in level):
            self.spark.sql(f"drop table if exists {name}")
        self.levels = []


def dropped_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fan: int = 3) -> DataFrame:
    """(id, tag, places): of each document that loses lines, the places of these."""
    spark = docs.sparkSession
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/lines_{uuid.uuid4().hex}"
    parts = [k / batches for k in range(1, batches)]
    bounds = set(docs.select(F.col(id_col).cast("double").alias("x")).where("x is not null").approxQuantile("x", parts, 0.01)) if parts else set()
    batch = sum(((F.col("id").cast("double") > b).cast("int") for b in bounds), F.lit(0))
    numbered_lines(docs, id_col, text_col).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema("id long, tag binary, place int, h1 long, h2 long, batch int").parquet(folder)
    runs = LineRuns(spark, fan, buckets_for(spark, lines.count()))
    for k in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == k))
    places = runs.extra(lines).groupBy("id", "tag").agg(F.collect_set("place").alias("places")).checkpoint()
    runs.drop()
    return places


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fan: int = 3) -> DataFrame:
    """One row a document: id, n_lines, n_dropped, kept (the text that stays)."""
    gone = dropped_places(docs, id_col, text_col, batches, fan)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    joined = rows.withColumn("tag", text_key(F.col("body").cast("binary"))).join(gone, ["id", "tag"], "left")
    lines = F.split("body", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("body")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    split = joined.withColumn("lines", F.when(F.col("places").isNotNull(), lines))
    n_lines = (F.octet_length("body") - F.octet_length(F.replace("body", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return split.select(back_to_null("id").alias("id"), n_lines.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeated_lines(read_documents(spark, sf_dir))
    return done.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
