"""Edit-aware token counts with segment trees of pre-tokens.

``build`` keeps for each document a segment tree over its pre-tokens: per node the sums
of characters and tokens below it. ``apply_edits`` takes edits (replace ``length``
characters at ``start`` by ``insert``), one after another, and re-encodes only the
pre-tokens that an edit touches, one before them as context, and those after it until
a new boundary falls on an old one; from there on the split must be the same, as the
pattern looks only ahead. Sums change along the paths to the root. The tree travels as
a column, so further edits need no encoding of the rest of the text.

Each document is worked on alone and whole; there is no shuffle. Counts are those of
encoding every match of the pattern by the ranks.

Defined results: a null or empty text has no tokens and takes inserts at place 0; bytes
that are no UTF-8 are read as U+FFFD; null edits are none; places beyond the end mean the end, negative ones the begin; a null
doc_id stays null; repeated rows are worked on alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.llm.byte_bpe import Encoder, default_vocabulary, encoder_of
from lessonloom.llm.common import in_small_batches, read_documents, texts

#: Pre-tokens in a leaf of the tree.
LEAF = 64
#: Characters that a match of the pattern may look ahead.
AHEAD = 3


def token_counts(encoder: Encoder, pieces: list[str]) -> np.ndarray:
    """Tokens of each piece."""
    if not pieces:
        return np.empty(0, np.int64)
    which = encoder.numbers_of(pieces)
    return encoder.starts[which + 1] - encoder.starts[which]


class Tree:
    """Segment tree: leaves of (characters, tokens) per pre-token, and sums of both for every inner node.

    Inner sums lie level by level, each node over two of the level below; a change in a
    leaf updates one node a level. Leaves split when they have grown to twice their size,
    which rebuilds the levels over the leaves' sums (no encoding).
    """

    def __init__(self, rows: np.ndarray):
        at = np.arange(0, len(rows), LEAF)
        self.leaves = [rows[k : k + LEAF] for k in at.tolist()] or [rows]
        self.rebuild(np.add.reduceat(rows, at) if len(at) else None)

    def rebuild(self, sums: np.ndarray | None = None) -> None:
        self.levels = [np.array([leaf.sum(0) for leaf in self.leaves], np.int64).reshape(-1, 2) if sums is None else sums]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            if len(below) % 2:
                below = np.vstack((below, [[0, 0]]))
            self.levels.append(below[::2] + below[1::2])

    @property
    def total(self) -> tuple[int, int]:
        """Characters and tokens of the document."""
        return tuple(self.levels[-1][0].tolist())

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character at a place (the last one beyond the end), and the leaf's first place."""
        node, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if place >= begin + level[node, 0] and node + 1 < len(level):
                begin += int(level[node, 0])
                node += 1
        return node, begin

    def replace(self, leaf: int, rows: np.ndarray) -> None:
        self.leaves[leaf] = rows
        change = rows.sum(0) - self.levels[0][leaf]
        for level in self.levels:
            level[leaf] += change
            leaf //= 2

    def splice(self, first: tuple[int, int], last: tuple[int, int], rows: np.ndarray) -> None:
        """Put rows in place of the pre-tokens from (leaf, row) up to (leaf, row), the latter not included."""
        (a, i), (b, j) = first, last
        if a == b and len(self.leaves[a]) - (j - i) + len(rows) <= 2 * LEAF:
            self.replace(a, np.vstack((self.leaves[a][:i], rows, self.leaves[a][j:])))
            return
        merged = np.vstack((self.leaves[a][:i], rows, self.leaves[b][j:]))
        self.leaves[a : b + 1] = [merged[k : k + LEAF] for k in range(0, len(merged), LEAF)] or [merged]
        self.rebuild()

    def pack(self) -> bytes:
        return np.concatenate(self.leaves).astype(np.int32).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        return cls(np.frombuffer(data, np.int32).reshape(-1, 2).astype(np.int64))


def build_trees(encoder: Encoder, bodies: list[str]) -> list[Tree]:
    """Trees of some texts; new pieces of all of them are encoded together."""
    split = list(map(encoder.split, bodies))
    pieces = [p for s in split for p in s]
    rows = np.stack((np.fromiter(map(len, pieces), np.int64, len(pieces)), token_counts(encoder, pieces)), 1)
    ends = np.cumsum(list(map(len, split)))
    return [Tree(rows[end - len(s) : end]) for s, end in zip(split, ends.tolist())]


def edit(encoder: Encoder, tree: Tree, text: str, start: int, length: int, insert: str) -> tuple[str, int]:
    """The edited text and how many pre-tokens were encoded; the tree is brought up to date."""
    start = min(max(start, 0), len(text))
    end = min(start + max(length, 0), len(text))
    new = text[:start] + insert + text[end:]
    leaf, begin = tree.find(max(start - AHEAD, 0))
    sizes = tree.leaves[leaf][:, 0]
    starts = begin + np.cumsum(sizes) - sizes
    row = max(int(np.searchsorted(starts, max(start - AHEAD, 0), side="right")) - 1, 0)
    at = int(starts[row]) if len(starts) else 0
    shift = len(insert) - (end - start)
    pieces, place = [], at
    # Walk the old boundaries alongside the new ones, leaf by leaf.
    old_leaf, old_row, old_place = leaf, row, at
    match = encoder.match
    while True:
        while old_place + shift < place or old_place < end:
            while old_leaf < len(tree.leaves) and old_row >= len(tree.leaves[old_leaf]):
                old_leaf, old_row = old_leaf + 1, 0
            if old_leaf == len(tree.leaves):
                break
            old_place += int(tree.leaves[old_leaf][old_row, 0])
            old_row += 1
        if (place == old_place + shift and old_place >= end and place >= start + len(insert)) or place >= len(new):
            break
        piece = match(new, place).group()
        pieces.append(piece)
        place += len(piece)
    if old_leaf == len(tree.leaves):
        old_leaf, old_row = len(tree.leaves) - 1, len(tree.leaves[-1])
    rows = np.stack((np.fromiter(map(len, pieces), np.int64, len(pieces)), token_counts(encoder, pieces)), 1) if pieces else np.zeros((0, 2), np.int64)
    tree.splice((leaf, row), (old_leaf, old_row), rows)
    return new, len(pieces)


EDITS = "array<struct<start:int,length:int,insert:string>>"


def build(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None) -> DataFrame:
    """doc_id, text, edits, n_tokens and tree of every document."""
    wanted = edits if edits is not None else F.lit(None).cast(EDITS)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern)
        for part in parts:
            for k in range(0, part.num_rows, 256):
                some = part.slice(k, 256)
                trees = build_trees(encoder, texts(some.column(1)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([t.total[1] for t in trees], pa.int64()), pa.array([t.pack() for t in trees], pa.binary())], ["doc_id", "text", "edits", "n_tokens", "tree"])

    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), wanted.cast(EDITS).alias("edits"))
    return rows.mapInArrow(batches, f"doc_id long, text string, edits {EDITS}, n_tokens long, tree binary")


def apply_edits(trees: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Adds to what ``build`` gives: edited_text, n_tokens_edited, n_pieces, n_reencoded and edited_tree."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    names = ["edited_text", "n_tokens_edited", "n_pieces", "n_reencoded", "edited_tree"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern)
        for part in parts:
            for k in range(0, part.num_rows, 256):
                some = part.slice(k, 256)
                out = []
                get = {c: some.column(some.schema.get_field_index(c)) for c in ("text", "edits", "tree")}
                for text, edits, data in zip(texts(get["text"]), get["edits"].to_pylist(), get["tree"].to_pylist()):
                    tree, encoded = Tree.unpack(data), 0
                    for e in edits or []:
                        if e is not None:
                            text, n = edit(encoder, tree, text, e["start"] or 0, e["length"] or 0, e["insert"] or "")
                            encoded += n
                    out.append((text, tree.total[1], sum(map(len, tree.leaves)), encoded, tree.pack()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], [*some.schema.names, *names])

    kinds = (StringType(), LongType(), LongType(), LongType(), BinaryType())
    return trees.mapInArrow(batches, StructType([*trees.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds)]]))


def some_edits(id_col: str = "doc_id", text_col: str = "text", count: int = 3) -> Column:
    """Edits of a document, from hashes of its id: a piece of the text is put in place of some characters elsewhere."""
    n = F.greatest(F.char_length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1))
    place = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), n).cast("int")
    one = lambda k: F.struct(place(3 * k).alias("start"), F.pmod(F.xxhash64(F.col(id_col), F.lit(3 * k + 1)), F.lit(24)).cast("int").alias("length"), F.substring(F.coalesce(F.col(text_col), F.lit("")), place(3 * k + 2) + 1, F.lit(16)).alias("insert"))
    return F.array(*[one(k) for k in range(count)])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = default_vocabulary()
    trees = build(read_documents(spark, sf_dir), ranks, pattern, edits=some_edits())
    return apply_edits(trees, ranks, pattern).select("doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_reencoded", F.sha2("edited_text", 256).alias("edited_sha256"))
