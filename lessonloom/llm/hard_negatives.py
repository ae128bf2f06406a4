"""Hard-negative mining with exact scores from subset-sum tables (Four Russians).

Components are quantised to integers. Every eight dimensions of an anchor give a table of
the 256 sums of their subsets; a candidate's bits of one weight in the same eight
dimensions are one byte, which looks such a sum up. Lookups are added over the groups and
shifted together over the bit planes (two's complement, so the highest plane counts
against): the exact inner product, without a multiplication.

Candidates lie packed in chunks, anchors in blocks. Blocks of both meet in cells of a
bounded size, each a task of its own; a cell keeps for each anchor only what can be among
its first rows, and a window over these few gives the first rows of all cells. A first
round finds the positives, a second the negatives in the band of each positive. Labels
are compared inside the cells and never dealt by, so a common label meets in no task.

Defined results: a null label or vector, or a null or non-finite component, takes a row
out, as does a component that is quantised beyond 2^27 (its scores need not fit into a
long); missing components of shorter vectors count as 0, so an empty vector scores 0; a
null vec_id is no anchor, comes last among equal scores and stays null; rows that are
equal in id, label and vector count once, rows of one id that differ are rows of their
own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lessonloom.functions.session import plain_unions
from lessonloom.llm.common import LAST_ID, back_to_null, shuffle_partitions, with_checkpoint_dir

SCALE = 256
MOST = 1 << 27
GROUP = 8
#: Rows of a chunk, of a block of candidates (about 6 MB at 64 dimensions of 9 bits), and of anchors at most and at least.
CHUNK, CANDIDATES, ANCHORS, FEW_ANCHORS = 4096, 1 << 16, 4096, 32
#: Anchors whose tables are in memory at once.
AT_ONCE = 64
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
BAND = (30, 90)
PACKED = "n int, ids binary, labels binary, keys binary, groups int, bits int, planes binary"
FIRST = "anchor_key long, anchor_id long, anchor_label long, other_key long, other_id long, score long"
NEAR = "anchor_key long, anchor_id long, positive_key long, positive_id long, positive_score long, negative_id long, negative_key long, negative_score long"


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes (bits, rows, groups) of integers (rows, dimensions) in two's complement, a byte for eight dimensions."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    bits = most.bit_length() + 1
    padded = np.pad(values, ((0, 0), (0, -values.shape[1] % GROUP)))
    return np.stack([np.packbits(((padded >> k) & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(bits)])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each byte the sum of the anchor's components that its bits name."""
    padded = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % GROUP))).T.reshape(-1, GROUP, len(anchors))
    sums = np.zeros((padded.shape[0], 1, len(anchors)), anchors.dtype)
    for k in range(GROUP):
        sums = np.concatenate((sums, sums + padded[:, k : k + 1]), axis=1)
    return sums


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, rows) of exact inner products."""
    bits, rows, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    for k in reversed(range(bits)):
        total += total
        for g in range(min(groups, len(tables))):
            found = tables[g].take(planes[k, :, g], axis=0)
            if k == bits - 1:
                total -= found
            else:
                total += found
    return np.ascontiguousarray(total.T)


def fit(anchors: np.ndarray, bits: int) -> np.ndarray:
    """The anchors in the narrower kind of integer that holds every partial score."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << bits
    return anchors.astype(np.int32 if most < 1 << 31 else np.int64)


def packed(vectors: DataFrame) -> DataFrame:
    """Chunks of rows (columns of PACKED) from rows (id, label, key, values)."""
    schema = StructType.fromDDL(PACKED)
    arrow = to_arrow_schema(schema)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, CHUNK):
                piece = part.slice(at, CHUNK)
                values = matrix(piece.column(3))
                ids, labels, keys = (piece.column(c).to_numpy().astype(np.int64) for c in range(3))
                planes = planes_of(values)
                row = [len(ids), ids.tobytes(), labels.tobytes(), keys.tobytes(), planes.shape[2], planes.shape[0], planes.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

    return vectors.mapInArrow(pack, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    ends = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(ends), int(ends.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < ends[:, None]] = flat
    return out


def quantised(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, label, key, values) that take part, each once."""
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("given"))
    whole = F.forall("given", lambda x: F.coalesce(F.abs(x) <= MOST / SCALE, F.lit(False)))  # false for a null, NaN or infinity
    values = F.transform("given", lambda x: F.floor(x * SCALE).cast("int"))
    kept = rows.where(F.col("label").isNotNull() & whole).select("id", "label", values.alias("values"))
    return kept.dropDuplicates(["id", "label", "values"]).select("id", "label", F.xxhash64("label", "values").alias("key"), "values")


def _cells(chunks: DataFrame, anchors: DataFrame, blocks: tuple[int, int], found, schema: str) -> DataFrame:
    """``found(anchors, candidates)`` of every cell; anchors: block, id, label, key, values and more."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rows, columns = blocks
    left = chunks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    right = anchors.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))

    def cell(key: tuple, packs: pa.Table, asked: pa.Table) -> pa.Table:
        out = found(asked.combine_chunks(), packs) if len(asked) and len(packs) else []
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return left.groupBy("a", "c").cogroup(right.withColumnRenamed("block", "a").groupBy("a", "c")).applyInArrow(cell, schema)


def _unpacked(packs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for p in packs.select(["n", "ids", "labels", "keys", "groups", "bits", "planes"]).to_pylist():
        ids, labels, keys = (np.frombuffer(p[c], np.int64) for c in ("ids", "labels", "keys"))
        yield ids, labels, keys, np.frombuffer(p["planes"], np.uint8).reshape(p["bits"], p["n"], p["groups"])


def _best(held: list[tuple], score: np.ndarray, at: np.ndarray, ids: np.ndarray, keys: np.ndarray, most: int) -> list[tuple]:
    """The first rows (-score, id, key) among those held and those at the given places."""
    return sorted(held + list(zip((-score[at]).tolist(), ids[at].tolist(), keys[at].tolist())))[:most]


def _narrow(score: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Places that can be among the first ``most``: all that score no less than the last of these."""
    if len(at) <= most:
        return at
    value = score[at]
    return at[value >= np.partition(value, len(value) - most)[len(value) - most]]


def _positives(asked: pa.Table, packs: pa.Table) -> list[tuple]:
    """The first same-label rows of each anchor in a cell."""
    values, out = matrix(asked["values"].combine_chunks()), []
    ids, labels, keys = (asked[c].to_numpy() for c in ("id", "label", "key"))
    for at in range(0, len(ids), AT_ONCE):
        held: list[list[tuple]] = [[] for _ in ids[at : at + AT_ONCE]]
        for cand_ids, cand_labels, cand_keys, planes in _unpacked(packs):
            found = scores(subset_sums(fit(values[at : at + AT_ONCE], len(planes))), planes)
            for k, score in enumerate(found):
                fits = cand_labels == labels[at + k]
                if len(held[k]) == POSITIVES:
                    fits &= score >= -held[k][-1][0]
                near = np.flatnonzero(fits)
                near = near[(cand_ids[near] != ids[at + k]) | (cand_keys[near] != keys[at + k])]
                held[k] = _best(held[k], score, _narrow(score, near, POSITIVES), cand_ids, cand_keys, POSITIVES)
        out += [(int(keys[at + k]), int(ids[at + k]), int(labels[at + k]), key, i, -s) for k, rows in enumerate(held) for s, i, key in rows]
    return out


def _negatives(asked: pa.Table, packs: pa.Table) -> list[tuple]:
    """The first rows of other labels in the band of each positive, for the anchors of a cell."""
    values, out = matrix(asked["values"].combine_chunks()), []
    ids, labels, keys = (asked[c].to_numpy() for c in ("id", "label", "key"))
    positives = asked["positives"].to_pylist()
    for at in range(0, len(ids), AT_ONCE):
        wanted = positives[at : at + AT_ONCE]
        held: list[list[list[tuple]]] = [[[] for _ in own] for own in wanted]
        for cand_ids, cand_labels, cand_keys, planes in _unpacked(packs):
            found = scores(subset_sums(fit(values[at : at + AT_ONCE], len(planes))), planes)
            for k, score in enumerate(found):
                other = cand_labels != labels[at + k]
                for j, positive in enumerate(wanted[k]):
                    least, most = -(-BAND[0] * positive["score"] // 100), BAND[1] * positive["score"] // 100
                    if len(held[k][j]) == NEGATIVES:
                        least = max(least, -held[k][j][-1][0])
                    if least <= most:
                        near = np.flatnonzero((score >= least) & (score <= most) & other)
                        held[k][j] = _best(held[k][j], score, _narrow(score, near, NEGATIVES), cand_ids, cand_keys, NEGATIVES)
        for k, rows in enumerate(held):
            for positive, own in zip(wanted[k], rows):
                out += [(int(keys[at + k]), int(ids[at + k]), positive["key"], positive["id"], positive["score"], i, key, -s) for s, i, key in own]
    return out


def hard_negatives(vectors: DataFrame, every: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are rows of ids that ``every`` divides."""
    spark = vectors.sparkSession
    with_checkpoint_dir(spark)
    plain_unions(spark)
    rows = quantised(vectors, id_col, label_col, vector_col).checkpoint()
    asked = rows.where((F.col("id") % every == 0) & (F.col("id") != LAST_ID))
    n, n_asked = rows.count(), asked.count()
    columns = math.ceil(n / CANDIDATES) or 1
    least, most = math.ceil(n_asked / ANCHORS), n_asked // FEW_ANCHORS
    blocks = max(1, least, min(most, math.ceil(shuffle_partitions(spark) / columns))), columns
    chunks = packed(rows).withColumn("c", F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int")).checkpoint()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks[0])).cast("int"))
    place = lambda key, score, i: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), i[0], i[1]))
    first = _cells(chunks, asked, blocks, _positives, FIRST).withColumn("place", place(["anchor_key", "anchor_id"], "score", ("other_id", "other_key"))).where(F.col("place") <= POSITIVES)
    pairs = first.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(F.collect_list(F.struct(F.col("other_key").alias("key"), F.col("other_id").alias("id"), "score")).alias("positives"))
    near = _cells(chunks, asked.join(pairs.checkpoint(), ["id", "key"]), blocks, _negatives, NEAR)
    ranked = near.withColumn("rank", place(["anchor_key", "anchor_id", "positive_key", "positive_id"], "negative_score", ("negative_id", "negative_key"))).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", back_to_null("positive_id").alias("positive_id"), "rank", back_to_null("negative_id").alias("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"))
