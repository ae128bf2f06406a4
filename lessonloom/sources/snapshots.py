"""Tables on shared storage that are changed by parts: keyed snapshots in versions, and logs that are appended once.

Both lie in hash buckets of their keys. What a reader sees is named by small files that
are written last, so a writer that dies leaves nothing that is read, and runs again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lessonloom.functions.session import plain_unions
from lessonloom.sources.readers import audit_append_only, upsert

BUCKET = "key_bucket"


class Folder:
    """Small files of a folder on any storage that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        store, path = self._at(name)
        return store.exists(path)

    def names(self, name: str = "") -> list[str]:
        store, path = self._at(name)
        return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []

    def read(self, name: str) -> dict:
        store, path = self._at(name)
        stream = store.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, content: dict) -> None:
        """Writes a file whole or not at all; one that is there already is an error."""
        store, path = self._at(name)
        if store.exists(path):
            raise FileExistsError(f"{self.path}/{name}")
        _, draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not store.rename(draft, path):
            raise FileExistsError(f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        store, path = self._at(name)
        store.delete(path, True)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Snapshot:
    """A keyed table in versions. A change reads and rewrites the buckets of its keys only; a manifest names the files of each bucket.

    A null key is a key like any other for its bucket, and meets no stored row.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 256):
        plain_unions(spark)
        self.spark, self.folder, self.keys, self.buckets = spark, Folder(spark, folder), keys, buckets

    def version(self) -> int:
        """The last published version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self.folder.read(f"manifests/{version:010d}.json") if version else {"version": 0, "buckets": {}, "schema": None, "batch": -1}

    def read(self, version: int | None = None, buckets: list[int] | None = None, like: DataFrame | None = None) -> DataFrame:
        """The rows of one version (the last), of all buckets or of some. like: gives the columns of a table that is not there yet."""
        known = self.manifest(version)
        schema = StructType.fromJson(known["schema"]) if known["schema"] else like.schema
        paths = [p for b, p in known["buckets"].items() if buckets is None or int(b) in set(buckets)]
        full = [f"{self.folder.path}/{p}" for p in paths]
        return self.spark.read.schema(schema).parquet(*full) if full else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most as many numbers as there are buckets."""
        return [r[0] for r in rows.select(bucket_of(self.keys, self.buckets).alias(BUCKET)).distinct().collect()]

    def lookup(self, rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
        """Stored rows of the keys in ``rows``, read from their buckets alone."""
        found = self.read(buckets=self.touched(rows), like=like)
        return found.join(rows.select(*self.keys).distinct(), self.keys, "left_semi")

    def change(self, changes: DataFrame, merge: Callable[[DataFrame], DataFrame], batch: int | None = None, like: DataFrame | None = None) -> int:
        """Publishes a version in which ``merge`` has replaced the buckets of the keys in ``changes``; a batch number that is applied already changes nothing."""
        known = self.manifest()
        if batch is not None and batch <= known["batch"]:
            return known["version"]
        touched = self.touched(changes)
        after = merge(self.read(known["version"], touched, like=changes if like is None else like))
        place = f"data/{known['version'] + 1:010d}-{uuid.uuid4().hex}"
        rows = after.withColumn(BUCKET, bucket_of(self.keys, self.buckets))
        rows.repartition(max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder.path}/{place}")
        written = {n.split("=")[1]: f"{place}/{n}" for n in self.folder.names(place) if n.startswith(f"{BUCKET}=")}
        kept = {b: p for b, p in known["buckets"].items() if int(b) not in set(touched)}
        content = {"version": known["version"] + 1, "buckets": kept | written, "schema": after.schema.jsonValue(), "batch": known["batch"] if batch is None else batch, "rewritten": len(written)}
        self.folder.publish(f"manifests/{content['version']:010d}.json", content)
        return content["version"]

    def upsert(self, changes: DataFrame, update: list[str] | None = None, order: list | None = None, batch: int | None = None) -> int:
        """Inserts and updates as the function ``upsert`` does, in the touched buckets."""
        return self.change(changes, lambda base: upsert(base, changes, self.keys, update, order), batch)

    def delete(self, keys: DataFrame, batch: int | None = None) -> int:
        return self.change(keys, lambda base: base.join(keys.select(*self.keys), self.keys, "left_anti"), batch, like=self.read())

    def clear_old(self, keep: int = 2) -> None:
        """Removes manifests before the last ``keep`` and the files that no manifest names any more; readers of what is kept are not touched."""
        names = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        for name in names[:-keep]:
            self.folder.remove(f"manifests/{name}")
        named = {p.split("/")[1] for n in names[-keep:] for p in self.folder.read(f"manifests/{n}")["buckets"].values()}
        for place in set(self.folder.names("data")) - named:
            self.folder.remove(f"data/{place}")


class BatchLog:
    """An append-only log in batches. A batch is there once its digests are: running it again adds nothing.

    For each batch and bucket the digests hold the number of rows and two sums over their
    hashes, so two logs are compared without their rows; only where digests differ are the
    buckets of both read.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, Folder(spark, folder), keys, buckets

    def batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names("digests") if n.startswith("batch=") and self.folder.exists(f"digests/{n}/_SUCCESS"))

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Whether the batch was written now; False if it was there."""
        if self.folder.exists(f"digests/batch={batch}/_SUCCESS"):
            return False
        at = f"{self.folder.path}/data/batch={batch}"
        rows.withColumn(BUCKET, bucket_of(self.keys, self.buckets)).write.mode("overwrite").partitionBy(BUCKET).parquet(at)
        written = self.spark.read.schema(rows.schema).parquet(at) if self._buckets(batch) else self.spark.createDataFrame([], rows.schema)
        sums = self.digest(written.select(*rows.columns))
        self.folder.exists("schema.json") or self.folder.publish("schema.json", rows.schema.jsonValue())
        sums.write.mode("overwrite").parquet(f"{self.folder.path}/digests/batch={batch}")
        return True

    def digest(self, rows: DataFrame) -> DataFrame:
        """(bucket, rows, two sums) of rows."""
        columns = sorted(rows.columns)
        h = lambda seed: F.xxhash64(F.lit(seed), *[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])
        marked = rows.select(bucket_of(self.keys, self.buckets).alias(BUCKET), h(1).alias("a"), h(2).alias("b"))
        return marked.groupBy(BUCKET).agg(F.count("*").alias("rows"), F.bit_xor("a").alias("mixed"), F.sum((F.col("b") % (1 << 31)).cast("long")).alias("total"))

    def _buckets(self, batch: int) -> list[int]:
        return [int(n.split("=")[1]) for n in self.folder.names(f"data/batch={batch}") if n.startswith(f"{BUCKET}=")]

    def digests(self) -> DataFrame:
        schema = f"{BUCKET} int, rows long, mixed long, total long"
        paths = [f"{self.folder.path}/digests/batch={b}" for b in self.batches()]
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.folder.path}/digests").parquet(*paths) if paths else self.spark.createDataFrame([], f"{schema}, batch long")

    def schema(self) -> StructType:
        return StructType.fromJson(self.folder.read("schema.json"))

    def read(self, before: int | None = None, buckets: list[int] | None = None, batches: list[int] | None = None) -> DataFrame:
        """Rows of the batches that are there (before one, or some), of all buckets or of some, with their batch."""
        schema = StructType([*self.schema().fields, *StructType.fromDDL("batch long").fields]) if self.folder.exists("schema.json") else None
        some = [b for b in self.batches() if (before is None or b < before) and (batches is None or b in batches)]
        paths = [f"data/batch={b}" + ("" if buckets is None else f"/{BUCKET}={k}") for b in some for k in self._buckets(b) if buckets is None or k in buckets]
        paths = [f"{self.folder.path}/{p}" for p in dict.fromkeys(paths)]
        if not paths:
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.schema(schema).option("basePath", f"{self.folder.path}/data").parquet(*paths)


def audit_logs(old: BatchLog, new: BatchLog, keys: list[str] | None = None) -> DataFrame:
    """(keys, change) of rows of the old log that the new one lacks or has otherwise, as ``audit_append_only`` tells them; equal logs are found equal by their digests alone."""
    keys = keys or old.keys
    sums = ["rows", "mixed", "total"]
    there = new.digests().select("batch", BUCKET, F.struct(*sums).alias("now"))
    # Batches times buckets at most.
    other = old.digests().select("batch", BUCKET, F.struct(*sums).alias("was")).join(there, ["batch", BUCKET], "left").where("now is null or now <> was").select("batch", BUCKET).collect()
    nothing = old.spark.createDataFrame([], StructType([*[f for f in old.schema().fields if f.name in keys], *StructType.fromDDL("change string").fields]))
    if not other:
        return nothing
    batches, buckets = sorted({r[0] for r in other}), sorted({r[1] for r in other})
    mine, theirs = (log.read(batches=batches, buckets=buckets) for log in (old, new))
    mine = mine.drop("batch", BUCKET)
    theirs = mine.where("false") if theirs is None else theirs.drop("batch", BUCKET)
    return audit_append_only(mine, theirs, keys)
