"""Byte-level BPE encoding and decoding.

Encoding runs the tokenizers library over Arrow batches. The vocabulary and merges
are derived from a rank file, each byte standing as one printable character (the
byte-to-character mapping of byte-level BPE). A text is split by the pattern of the
rank file and each distinct piece is encoded once per task; tokens, with offsets
inside the piece, are then laid out over the text. Decoding reverses the byte table
and joins bytes before it decodes, so a character split over tokens comes back whole.

Each text is encoded alone and whole; there is no shuffle. The rank file is read on
the driver (its size is fixed by the vocabulary, under 1 MB) and travels with the task.

Defined results: a null or empty text has no tokens and decodes to no bytes; bytes that
are no UTF-8 are read as U+FFFD; a null id stays null; repeated rows give repeated results; an empty table gives an empty one;
ids that the vocabulary lacks are an error; other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.llm.common import bodies, in_small_batches, read_documents

#: Pieces whose tokens a task remembers at once; more are encoded again. Bounds memory only.
REMEMBERED = 400_000
#: Pieces handed to the library at once.
AT_ONCE = 4096


def byte_characters() -> list[str]:
    """Character that stands for each byte: printable Latin-1 itself, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


CHARACTERS = byte_characters()
BYTE_OF = {c: b for b, c in enumerate(CHARACTERS)}
TO_CHARACTERS = dict(enumerate(CHARACTERS))


def as_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARACTERS)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """For each token of two bytes or more, the two tokens whose merge makes it: what is left of its bytes after all merges of lower rank."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((as_characters(parts[0]), as_characters(parts[1])))
    return merges


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes):
    """A tokenizers model over byte characters; cached per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer, models

    known = parse_ranks(ranks)
    return Tokenizer(models.BPE(vocab={as_characters(t): r for t, r in known.items()}, merges=merges_of(known)))


class Encoder:
    """Encodes texts piece by piece; known pieces lie in flat arrays, found by their number."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        compiled = regex.compile(pattern)
        self.split, self.match, self.model = compiled.findall, compiled.match, tokenizer(ranks)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends, self.tokens = np.empty(1024, np.int32), np.empty(1024, np.int32), 0
        self.starts = np.zeros(1024, np.int64)  # piece k has the tokens from starts[k] to starts[k + 1]

    def learn(self, pieces: list[str]) -> None:
        new = [p for p in set(pieces) if p not in self.number]
        if not new:
            return
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = list(set(pieces))
        for k in range(0, len(new), AT_ONCE):
            some = new[k : k + AT_ONCE]
            found = self.model.encode_batch([as_characters(p.encode()) for p in some], add_special_tokens=False)
            self.store(some, [i for e in found for i in e.ids], [b for e in found for _, b in e.offsets], list(map(len, found)))

    def numbers_of(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; new ones are encoded first."""
        try:
            return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            self.learn(pieces)
            return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def store(self, pieces: list[str], ids: list[int], ends: list[int], counts: list[int]) -> None:
        """Adds pieces to the flat arrays, which grow by doubling."""
        known, upto = len(self.number), self.tokens + len(ids)
        while len(self.ids) < upto:
            self.ids, self.ends = np.concatenate((self.ids, self.ids)), np.concatenate((self.ends, self.ends))
        while len(self.starts) <= known + len(pieces):
            self.starts = np.concatenate((self.starts, self.starts))
        self.ids[self.tokens : upto], self.ends[self.tokens : upto] = ids, ends
        self.starts[known + 1 : known + 1 + len(pieces)] = self.tokens + np.cumsum(counts)
        self.number.update(zip(pieces, range(known, known + len(pieces))))
        self.tokens = upto

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the texts one after another: ids, byte of its text at which each ends, and tokens per text."""
        split = list(map(self.split, texts))
        pieces = [p for s in split for p in s]
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        which = self.numbers_of(pieces)
        first, counts = self.starts[which], self.starts[which + 1] - self.starts[which]
        total = np.cumsum(counts)
        at = np.arange(total[-1]) + np.repeat(first - (total - counts), counts)
        sizes = self.ends[first + counts - 1].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        pieces_of = np.fromiter(map(len, split), np.int64, len(split))
        piece_to = np.cumsum(pieces_of)
        token_at, byte_at = np.concatenate(([0], total)), np.concatenate((before, [before[-1] + sizes[-1]]))
        per_text = token_at[piece_to] - token_at[piece_to - pieces_of]
        ends = self.ends[at] + np.repeat(before, counts) - np.repeat(byte_at[piece_to - pieces_of], per_text)
        return self.ids[at], ends.astype(np.int32), per_text


@lru_cache(maxsize=2)
def encoder_of(ranks: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker, so that later tasks know the pieces of earlier ones."""
    return Encoder(ranks, pattern)


def listed(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


#: Texts that leave a task at once hold about this many bytes.
SLICE_BYTES = 1 << 20


def encoded_batches(parts: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """(id, ids, ends) of batches of (id, text)."""
    encoder = encoder_of(ranks, pattern)

    def out(names: list, texts: list[str]) -> pa.RecordBatch:
        ids, ends, counts = encoder.many(texts)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), listed(ids, counts), listed(ends, counts)], ["id", "ids", "ends"])

    for part in parts:
        names, texts, size = [], [], 0
        for name, body in zip(part.column(0).to_pylist(), bodies(part.column(1))):
            names.append(name)
            texts.append(body.decode("utf-8", "replace"))
            size += len(body)
            if size >= SLICE_BYTES:
                yield out(names, texts)
                names, texts, size = [], [], 0
        if names:
            yield out(names, texts)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, ends array<int>): tokens and the byte offset after each token."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_batches(parts, ranks, pattern)

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(batches, "id long, ids array<int>, ends array<int>")


def byte_table(ranks: bytes) -> np.ndarray:
    """Bytes of each token id: the byte characters of the vocabulary, reversed."""
    tokens = sorted(parse_ranks(ranks).items(), key=lambda x: x[1])
    return np.array([bytes(map(BYTE_OF.__getitem__, as_characters(t))) for t, _ in tokens], object)


def joined_bytes(lists: pa.ListArray, table: np.ndarray) -> pa.Array:
    """The bytes of each list of ids; a character that is split over tokens is whole again once they are joined."""
    return pa.array([b"".join(table[x.values.to_numpy(zero_copy_only=False)]) if x.is_valid else None for x in lists], pa.binary())


def decode(tokens: DataFrame, ranks: bytes, ids_col: str = "ids") -> DataFrame:
    """Adds body (binary): the bytes of the tokens."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks)
        for part in parts:
            body = joined_bytes(part.column(part.schema.get_field_index(ids_col)), table)
            yield pa.RecordBatch.from_arrays([*part.columns, body], [*part.schema.names, "body"])

    return tokens.mapInArrow(batches, StructType([*tokens.schema.fields, StructField("body", BinaryType())]))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, body): encoded and, from the ids alone, decoded in the same Python worker."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks)
        for part in encoded_batches(parts, ranks, pattern):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), joined_bytes(part.column(1), table)], ["id", "ids", "body"])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(batches, "id long, ids array<int>, body binary")


def default_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = default_vocabulary()
    return round_trip(read_documents(spark, sf_dir), ranks, pattern).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("body", 256).alias("decoded_sha256"),
    )
