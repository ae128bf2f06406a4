"""A first-seen index without a bound on its history: what came once is known for good, and stream state stays empty.

Keys are hashed into buckets of segments on shared storage. Each bucket of a segment has a
Bloom filter; a batch reads the filters, and the keys of those buckets alone that a filter
cannot rule out. Segments are written by batch and merged by levels, so they stay few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.functions.session import plain_unions
from lessonloom.sources.snapshots import BUCKET, Folder

#: Bits a key and probes of a filter: less than one key in a thousand passes without being there.
BITS, PROBES = 16, 7
HASHES = ["h1", "h2"]


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """(probes, keys) of bit places by double hashing."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    return (a + np.arange(PROBES, dtype=np.uint64)[:, None] * b) % np.uint64(bits)


def _filter(keys: pa.Table) -> pa.Table:
    bits = 8 * (-(-BITS * len(keys) // 8) or 1)
    found = np.zeros(bits, bool)
    found[_places(keys["h1"].to_numpy(), keys["h2"].to_numpy(), bits).ravel()] = True
    return pa.table({BUCKET: keys[BUCKET].slice(0, 1), "keys": pa.array([len(keys)], pa.int64()), "filter": pa.array([np.packbits(found).tobytes()], pa.binary())})


def _passing(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """Keys that a segment's filter cannot rule out."""
    h1, h2 = asked["h1"].to_numpy(), asked["h2"].to_numpy()
    out = []
    for segment, body in zip(filters["segment"].to_pylist(), filters["filter"].to_pylist()):
        bits = np.unpackbits(np.frombuffer(body, np.uint8)).astype(bool)
        passes = bits[_places(h1, h2, len(bits))].all(axis=0)
        if passes.any():
            out.append(pa.table({"segment": pa.array([segment] * int(passes.sum())), BUCKET: asked[BUCKET].filter(passes), "h1": h1[passes], "h2": h2[passes]}))
    return pa.concat_tables(out) if out else pa.table({"segment": pa.array([], pa.string()), BUCKET: pa.array([], pa.int32()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})


class SeenIndex:
    """Keys seen in the batches so far, in segments by level."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64, fan: int = 4):
        plain_unions(spark)
        self.spark, self.folder, self.keys, self.buckets, self.fan = spark, Folder(spark, folder), keys, buckets, fan
        #: Buckets that the last look at the index had to read.
        self.opened = 0

    def manifest(self) -> dict:
        last = max((n for n in self.folder.names("manifests") if n.endswith(".json")), default=None)
        return self.folder.read(f"manifests/{last}") if last else {"batch": -1, "version": 0, "levels": []}

    def hashed(self, rows: DataFrame) -> DataFrame:
        """Rows with the two hashes and the bucket of their key; a null in the key makes all three null, as such rows are never the same."""
        whole = F.lit(True)
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        h1, h2 = F.xxhash64(*self.keys), F.xxhash64(F.lit("second"), *self.keys)
        return rows.withColumns({"h1": F.when(whole, h1), "h2": F.when(whole, h2), BUCKET: F.when(whole, F.pmod(h1, F.lit(self.buckets)).cast("int"))})

    def seen(self, rows: DataFrame) -> DataFrame:
        """(h1, h2) of those keys in ``rows`` that an earlier batch had."""
        asked = self.hashed(rows).where("h1 is not null").select(BUCKET, *HASHES).distinct().checkpoint()
        segments = [s for level in self.manifest()["levels"] for s in level]
        nothing = asked.select(*HASHES).where("false")
        self.opened = 0
        if not segments:
            return nothing
        filters = self.spark.read.schema(f"{BUCKET} int, keys long, filter binary, segment string").option("basePath", f"{self.folder.path}/filters").parquet(*[f"{self.folder.path}/filters/segment={s}" for s in segments])
        passing = asked.groupBy(BUCKET).cogroup(filters.groupBy(BUCKET)).applyInArrow(_passing, f"segment string, {BUCKET} int, h1 long, h2 long").checkpoint()
        # Segments times buckets at most.
        doubtful = passing.select("segment", BUCKET).distinct().collect()
        self.opened = len(doubtful)
        if not doubtful:
            return nothing
        stored = self.spark.read.schema("h1 long, h2 long").parquet(*[f"{self.folder.path}/keys/segment={r.segment}/{BUCKET}={r[BUCKET]}" for r in doubtful])
        return passing.select(*HASHES).distinct().join(stored, HASHES, "left_semi")

    def first(self, rows: DataFrame, order: list) -> DataFrame:
        """Of each key that no earlier batch had the first row, and every row without a key."""
        named = self.hashed(rows)
        fresh = named.where("h1 is not null").join(self.seen(rows), HASHES, "left_anti")
        best = fresh.groupBy(*HASHES).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")
        return best.unionByName(named.where("h1 is null").select(*rows.columns))

    def _segment(self, keys: DataFrame, name: str) -> None:
        keys.repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder.path}/keys/segment={name}")
        written = self.spark.read.schema(f"h1 long, h2 long, {BUCKET} int").option("basePath", f"{self.folder.path}/keys/segment={name}").parquet(f"{self.folder.path}/keys/segment={name}")
        written.groupBy(BUCKET).applyInArrow(_filter, f"{BUCKET} int, keys long, filter binary").write.mode("overwrite").parquet(f"{self.folder.path}/filters/segment={name}")

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Publishes the keys of a batch; a batch that is in already adds nothing."""
        known = self.manifest()
        if batch <= known["batch"]:
            return False
        levels, old = [list(x) for x in known["levels"]], []
        keys = self.hashed(rows).where("h1 is not null").select(*HASHES, BUCKET).distinct()
        if keys.limit(1).count():
            self._segment(keys, f"{batch}")
            levels = levels or [[]]
            levels[0].append(f"{batch}")
        level = 0
        while level < len(levels) and len(levels[level]) >= self.fan:
            name = f"{batch}-{level + 1}"
            merged = self.spark.read.schema(f"h1 long, h2 long, {BUCKET} int, segment string").option("basePath", f"{self.folder.path}/keys").parquet(*[f"{self.folder.path}/keys/segment={s}" for s in levels[level]])
            self._segment(merged.select(*HASHES, BUCKET), name)
            old += levels[level]
            levels[level] = []
            levels += [[]] if level + 1 == len(levels) else []
            levels[level + 1].append(name)
            level += 1
        self.folder.publish(f"manifests/{known['version'] + 1:010d}.json", {"batch": batch, "version": known["version"] + 1, "levels": levels})
        for name in old:
            self.folder.remove(f"keys/segment={name}")
            self.folder.remove(f"filters/segment={name}")
        return True
