"""Finding keys that occur more than once among all documents, chunk by chunk.

Documents are dealt into chunks by a hash of their id. Each chunk lists its distinct
64-bit keys, in order; the keys go to buckets by their high bits, packed into one
binary row per chunk and bucket. A bucket answers each chunk with one byte per key:
does the key occur once, repeatedly, or very often among all chunks?
As the chunk can list the same keys again in the same order, the bytes suffice.

A key that a third of all documents hold costs one entry a chunk, not one a document,
so no bucket grows with a hot key. The number of chunks follows the bytes of the texts
(one pass over their lengths) and there are as many buckets, so what one group holds
does not grow with the corpus. An exchange has as many partitions up to ``MOST_PARTITIONS``;
beyond that a partition holds several chunks (or buckets), sorted by Spark and worked one
after another, as the blocks of an exchange are partitions times partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.session import plain_unions
from lessonloom.llm.common import LAST_ID, shuffle_partitions, text_key, word_hashes

CHUNKED = "chunk int, id long, tag binary, body binary"
#: Distinct sorted keys of a chunk, how often each occurs there, and further 64 bits of each (or None).
Keys = tuple[np.ndarray, np.ndarray, np.ndarray | None]
#: Bytes of text in a chunk: the least, and the most of a large corpus; in between there are ``CHUNKS``.
LEAST_CHUNK, MOST_CHUNK, CHUNKS = 4 << 20, 256 << 20, 4096
#: Partitions of an exchange: at most ten million blocks between as many writers and readers.
MOST_BLOCKS = 10_000_000
MOST_PARTITIONS = math.isqrt(MOST_BLOCKS)


def chunks_for(total: int, partitions: int) -> int:
    """Chunks for a corpus of so many bytes."""
    return max(partitions, -(-total // min(max(total // CHUNKS, LEAST_CHUNK), MOST_CHUNK)))


def partitions_for(chunks: int) -> int:
    """Partitions of an exchange between so many chunks or buckets."""
    return min(chunks, MOST_PARTITIONS)


def chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(chunk, id (null last), tag (tells rows of one id but other texts apart) and body (UTF-8 bytes, null as empty)), and the number of chunks, which is that of buckets.

    Documents are dealt by a hash of id and text, so rows without an id, or of one id, spread like others.
    """
    plain_unions(docs.sparkSession)
    partitions = shuffle_partitions(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()["n"] or 0
    chunks = chunks_for(total, partitions)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text_key(body).alias("tag"), body.alias("body"))
    rows = rows.select(F.pmod(F.xxhash64("id", "tag"), F.lit(chunks)).cast("int").alias("chunk"), "id", "tag", "body")
    return rows.repartition(partitions_for(chunks), "chunk"), chunks


def documents_of(table: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
    """(id, tag, body) of the rows of a chunk, one body in memory at a time."""
    for part in table.to_batches():
        ids, tags, body = (part.column(part.schema.get_field_index(c)) for c in ("id", "tag", "body"))
        for k in range(part.num_rows):
            yield ids[k].as_py(), tags[k].as_py(), body[k].as_py()


#: Texts are hashed together up to about this many bytes.
SLICE_BYTES = 1 << 19


def words_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents of a chunk, one after another, and the number of words of each document."""
    hashes, counts, waiting, size = [], [], [], 0

    def hash_waiting() -> None:
        h, starts, _ = word_hashes(np.frombuffer(b" ".join(waiting), np.uint8))
        ends = np.cumsum([len(b) + 1 for b in waiting])
        hashes.append(h)
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        waiting.clear()

    for _, _, body in documents_of(table):
        waiting.append(body)
        size += len(body) + 1
        if size >= SLICE_BYTES:
            hash_waiting()
            size = 0
    if waiting:
        hash_waiting()
    if not counts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def room_of(counts: np.ndarray) -> np.ndarray:
    """For every word, the words from it to its document's end."""
    ends = np.cumsum(counts)
    return np.repeat(ends, counts) - np.arange(ends[-1] if len(ends) else 0)


def groups_of(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, more), and where in it each distinct pair begins."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    first = np.ones(len(keys), bool)
    first[1:] = keys[order[1:]] != keys[order[:-1]]
    if more is not None:
        first[1:] |= more[order[1:]] != more[order[:-1]]
    return order, np.flatnonzero(first)


def count_keys(keys: np.ndarray) -> Keys:
    """Distinct sorted keys, and how often each occurs."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys))), None


def bucket_edges(buckets: int) -> np.ndarray:
    """Least key of every bucket but the first: equal ranges of 64-bit keys, which must be well mixed."""
    return np.array([((b << 64) + buckets - 1) // buckets for b in range(1, buckets)], np.uint64)


ASKED = "chunk int, bucket int, keys binary, counts binary, more binary"
ANSWERED = "chunk int, bucket int, told binary"
#: What is told of a key: it occurs once, at least twice, or at least ``hot`` times.
ONCE, TWICE, HOT = 0, 1, 2


def places(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted keys begins, and the end."""
    return np.concatenate(([0], np.searchsorted(keys, bucket_edges(buckets)), [len(keys)]))


def ask(chunk: int, keys: Keys, buckets: int) -> pa.Table:
    """A chunk's keys as one row a bucket."""
    edges = places(keys[0], buckets)
    some = np.flatnonzero(np.diff(edges))
    counts = np.minimum(keys[1], 65535).astype(np.uint16)
    cut = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary())
    return pa.table(
        {
            "chunk": pa.array(np.full(len(some), chunk), pa.int32()),
            "bucket": pa.array(some, pa.int32()),
            "keys": cut(keys[0]),
            "counts": cut(counts),
            "more": cut(keys[2]) if keys[2] is not None else pa.nulls(len(some), pa.binary()),
        }
    )


def answer(table: pa.Table, hot: int = LAST_ID) -> pa.Table:
    """For one bucket, per chunk what is told of each of its keys."""
    lists = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(lists)
    further = table.column("more").to_pylist()
    more = np.concatenate([np.frombuffer(x, np.uint64) for x in further]) if further[0] is not None else None
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order, at = groups_of(keys, more)
    totals = np.add.reduceat(counts[order], at)
    told = np.empty(len(keys), np.uint8)
    told[order] = np.repeat((totals >= 2).astype(np.uint8) + (totals >= hot), np.diff(np.append(at, len(keys))))
    cuts = np.cumsum([len(k) for k in lists])[:-1]
    return pa.table({"chunk": table.column("chunk").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int32()), "told": pa.array([x.tobytes() for x in np.split(told, cuts)], pa.binary())})


def told_of(keys: Keys, answers: pa.Table, buckets: int) -> np.ndarray:
    """What the answers tell of each of a chunk's keys."""
    edges = places(keys[0], buckets)
    told = np.zeros(len(keys[0]), np.uint8)
    for b, x in zip(answers.column("bucket").to_pylist(), answers.column("told").to_pylist()):
        told[edges[b] : edges[b + 1]] = np.frombuffer(x, np.uint8)
    return told


def is_in(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def with_answers(docs: DataFrame, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f(documents of a chunk, answers to it) for every chunk that has documents."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right)

    back = answers.select(F.col("chunk").alias("for_chunk"), *[F.col(c).alias(c) for c in answers.columns if c != "chunk"])
    return docs.groupBy("chunk").cogroup(back.groupBy("for_chunk")).applyInArrow(one, schema)


def by_bucket(asked: DataFrame, buckets: int, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f(rows of a bucket) for every bucket."""
    return asked.repartition(partitions_for(buckets), "bucket").groupBy("bucket").applyInArrow(f, schema)
