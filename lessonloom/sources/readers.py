"""Sources and sinks: scans, editor rows, JSON requests, queues, logs and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lessonloom import constants as C
from lessonloom.functions.session import with_plain_unions
from lessonloom.functions.text import flatten_space, trim_wide


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """A whole table; only the named columns are read. Rows come in a total order where ``order`` names columns that tell them apart (nulls first)."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    rows = rows.orderBy(*order) if order else rows
    return rows.select(*columns) if columns else rows


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A whole database table, read in parallel by ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def read_sentence_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Editor files (English, tab, translation) as (rows, errors), by file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("source"))
    return parse_sentence_rows(files, "file", "source")


@with_plain_unions
def parse_sentence_rows(df: DataFrame, key: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of editor texts. Blank lines are skipped but counted; a text with neither rows nor errors is an error at line 0."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(source), F.lit("")), r"\r?\n")).alias("pos", "line"))
    cells = F.transform(F.split("line", "\t"), trim_wide)
    cut = lines.where(trim_wide(F.col("line")) != "").select(key, (F.col("pos") + 1).alias("line"), cells.alias("cells"))
    text, translation = F.coalesce(F.get("cells", F.lit(0)), F.lit("")), F.coalesce(F.get("cells", F.lit(1)), F.lit(""))
    further = F.exists(F.slice("cells", F.lit(3), F.greatest(F.size("cells"), F.lit(1))), lambda x: x != "")
    bad = (text == "") | (translation == "") | further
    parsed = cut.select(key, "line", text.alias("text"), translation.alias("translation"), bad.alias("bad"))
    empty = df.select(key, source).where(trim_wide(F.coalesce(F.col(source), F.lit(""))) == "").select(key, F.lit(0).alias("line"))
    return parsed.where("not bad").drop("bad"), parsed.where("bad").select(key, "line").unionByName(empty)


def format_sentence_row(text: Column, translation: Column) -> Column:
    return F.concat_ws("\t", flatten_space(text), flatten_space(translation))


ATTEMPT = "sentenceId string, examId string, passageId string, step int, arranged string, mistakes int, restarts int, clientAttemptId string"


def parse_attempt_requests(df: DataFrame, body: str, most: int = C.BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """(one row an attempt, rejected requests): bodies that are no objects, or without attempts, are rejected; the first ``most`` attempts count."""
    parsed = df.withColumn("request", F.from_json(body, f"op string, attempts array<struct<{ATTEMPT.replace(' string', ':string').replace(' int', ':int')}>>"))
    is_object = F.coalesce(F.trim(F.col(body)).startswith("{") & (F.col("request.op").isNotNull() | F.col("request.attempts").isNotNull()), F.lit(False))
    some = F.coalesce(F.size("request.attempts") > 0, F.lit(False))
    error = F.when(~is_object, "not_an_object").when(~some, "no_attempts")
    judged = parsed.withColumn("error", error)
    good = judged.where("error is null").select("*", F.posexplode(F.slice("request.attempts", 1, most)).alias("pos", "attempt")).drop("request", "error")
    return good, judged.where("error is not null").drop("request")


def merge_queues(both: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First entry per key, in the given order."""
    return both.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("turn = 1").drop("turn")


def batch_queue(queue: DataFrame, keys: list[str], order: list[str], size: int = C.BATCH_SIZE) -> DataFrame:
    """Numbers batches of ``size`` per key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return queue.withColumn("batch", F.floor(at / size).cast("long"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def audit_append_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the old snapshot that the new one lacks or changed; nulls equal nulls and nothing else."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("was"))
    b = new.select(*keys, F.struct(*[F.col(c).cast(old.schema[c].dataType) for c in values]).alias("now"), F.lit(True).alias("there"))
    both = a.join(b, keys, "left")
    change = F.when(F.col("there").isNull(), "missing").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], update: list[str] | None = None, order: list | None = None) -> DataFrame:
    """Insert rows of new keys; for known keys take the incoming ``update`` columns (none: the stored row stays).

    Of several changes of one key the first in ``order`` counts (none given: that of the
    least values). Changes with a null in the key never meet a stored row and all go in.
    """
    rest = [c for c in changes.columns if c not in keys]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or rest)))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first = changes.withColumn("turn", turn).where((F.col("turn") == 1) | ~whole)
    renamed = first.select(*keys, *[F.col(c).alias(f"in_{c}") for c in rest], F.lit(True).alias("incoming"))
    both = base.withColumn("stored", F.lit(True)).join(renamed, keys, "full")
    columns = [
        F.when(F.col("stored").isNull() | (F.col("incoming") & F.lit(c in (update or []))), F.col(f"in_{c}")).otherwise(F.col(c)).alias(c)
        for c in base.columns
        if c not in keys
    ]
    return both.select(*keys, *columns)


def catalog_stage_sizes(df: DataFrame, catalog: str) -> DataFrame:
    """One row a stage of each catalog document, with its number of items."""
    stages = F.from_json(F.get_json_object(catalog, "$.stages"), "array<struct<key:string,items:array<string>>>")
    return df.select("*", F.explode(stages).alias("stage")).select(*df.columns, F.col("stage.key").alias("stage_key"), F.size("stage.items").alias("items"))


def explode_json_rows(df: DataFrame, column: str) -> DataFrame:
    """One row an element of a JSON array, with its ordinal from 0."""
    return df.select("*", F.posexplode(F.from_json(column, "array<string>")).alias("ordinal", "value"))


@with_plain_unions
def seed_rows(df: DataFrame, values: list[tuple], keys: list[str]) -> DataFrame:
    """Adds rows for keys that are not there yet; there is no update."""
    seeds = df.sparkSession.createDataFrame(values, df.schema)
    return df.unionByName(seeds.join(df.select(*keys), keys, "left_anti").select(*df.columns))
