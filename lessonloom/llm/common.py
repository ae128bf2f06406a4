"""Small helpers shared by the training-data operators.

Every operator first selects the columns it was given by name under private
names, so further columns of the input, whatever they are called, cannot clash.
A null id is ordered after all others (``LAST_ID``) and comes back as null.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.functions.session import plain_unions

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"
LAST_ID = (1 << 63) - 1


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in a text, without building the list of them."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def back_to_null(column: str) -> Column:
    """Undo the stand-in for a null id."""
    return F.when(F.col(column) != F.lit(LAST_ID), F.col(column))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bodies(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of every text of a string or binary column, null as empty; one copy at a time."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for value in part:
            yield (value.as_buffer().to_pybytes() if value.is_valid else b"")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of a string column, null as empty; bytes that are no UTF-8 (a string column may hold any) as U+FFFD."""
    return [body.decode("utf-8", "replace") for body in bodies(column)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, so that high bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand.

    ``windows(values, width)`` gives the polynomial hash of every run of ``width``
    values from one cumulative sum, so its cost does not depend on the width.
    """

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(n, 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        n = len(values)
        if n < width or not n:
            return np.empty(0, np.uint64)
        self._grow(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * self.up[:n], out=sums[1:])
        return (sums[width:] - sums[: n + 1 - width]) * self.down[: n + 1 - width]

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[s:e] for each pair."""
        n = len(values)
        self._grow(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * self.up[:n], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


#: Bases are arbitrary odd constants; a byte goes through a scrambled table first.
BYTES = Powers(0x9E3779B97F4A7C15)
WORDS = Powers(0xD6E8FEB86659FD93)
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text's bytes (in UTF-8 the separators are single bytes)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words; the length is part of the hash."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    h = BYTES.spans(BYTE_CODE[data], starts, ends)
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def marked_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of n places of which those in any [start, end) are True."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def text_key(body: Column) -> Column:
    """128 bits that stand for a whole text (binary): rows of one id, or of none, are told apart by it."""
    return F.substring(F.unhex(F.sha2(body, 256)), F.lit(1), F.lit(16))


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names in ``spark.checkpoint.dir``.

    Only a session of one machine (master local[...], as in tests) may do without one and
    gets a folder of its own; on a cluster each executor would write to its own disk.
    """
    plain_unions(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


#: What may be broadcast, counted as rows times a stated width. Wider or more rows are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small_side(rows: DataFrame, width: int) -> DataFrame:
    """Rows of at most ``width`` bytes each to join with, to be broadcast where they are counted as few; else the join shuffles both sides."""
    most = BROADCAST_BYTES // width
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


#: Bytes of rows that travel to Python in one Arrow batch (a batch lies in memory several times).
BATCH_BYTES = 2 << 20


def in_small_batches(rows: DataFrame) -> DataFrame:
    """The rows; gives the session ``BATCH_BYTES`` as the size of its Arrow batches where it names none.

    Texts are long rows of any length, so a number of rows is no bound. A session that
    sets ``spark.sql.execution.arrow.maxBytesPerBatch`` keeps its own value.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return rows
