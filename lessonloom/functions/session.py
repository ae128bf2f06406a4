"""What the operators ask of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNION_KEY = "spark.sql.unionOutputPartitioning"
SIZE_KEY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
NUMBER_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Partitions of an exchange before adaptive execution puts them together.
FIRST_PARTITIONS = 1000
#: Ids that may be broadcast, by count.
FEW_IDS = 2_000_000


def plain_unions(spark: SparkSession) -> None:
    """Lets Spark deal the rows of a union anew before they are grouped or joined.

    Spark 4.1 takes a union of sides that are dealt by the same key as dealt itself, even
    where adaptive execution has coalesced the sides differently; rows of one key then stay
    apart and groups are wrong. The setting goes with the session, as plans are made late.
    """
    spark.conf.set(UNION_KEY, "false")


def small_tasks(spark: SparkSession) -> None:
    """Where the session does not say how many shuffled bytes adaptive execution may put together into a task, 8 MB.

    Rows of ids take 15 to 20 times as much in sorts and hash tables, of which a task may hold
    several: Spark's own 64 MB made tasks of over 1 GB. A figure of the session stays. As
    adaptive execution only puts partitions together, exchanges begin with so many of them
    that one of 8 GB has tasks of 8 MB too.
    """
    said = spark.conf.getAll
    if SIZE_KEY not in said:
        spark.conf.set(SIZE_KEY, "8m")
    if NUMBER_KEY not in said:
        spark.conf.set(NUMBER_KEY, str(max(FIRST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def with_plain_unions(f: Callable) -> Callable:
    """For operators that stack rows: sets ``plain_unions`` for the session of their first table."""

    @wraps(f)
    def run(*args, **named):
        for x in [*args, *named.values(), *(y for x in [*args, *named.values()] if isinstance(x, dict) for y in x.values())]:
            if isinstance(x, DataFrame):
                plain_unions(x.sparkSession)
                break
        return f(*args, **named)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; without it only a session of one machine gets a folder of its own."""
    plain_unions(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def once(df: DataFrame) -> DataFrame:
    """The rows, from files in the shared folder: what reads them again does not make them again, and reads the columns it needs.

    What was shuffled to make them goes as soon as they are written, not when the driver
    happens to collect its garbage.
    """
    conf, path = df.sparkSession.conf, f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4()}"
    before = conf.getAll.get(CLEANUP_KEY)
    conf.set(CLEANUP_KEY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP_KEY) if before is None else conf.set(CLEANUP_KEY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def are_few(ids: DataFrame) -> bool:
    """Whether a column of ids (of ``once``, as it is counted) may be broadcast."""
    return ids.count() <= FEW_IDS


def few(ids: DataFrame) -> DataFrame:
    """The ids to join wide rows with: these stay where they are if the ids are few; else the join shuffles both sides."""
    return F.broadcast(ids) if are_few(ids) else ids
