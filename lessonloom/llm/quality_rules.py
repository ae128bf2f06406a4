"""Quality rules: repetition coverage.

For each text the share of its word characters that lie inside duplicated n-grams
(n = 5 to 10) and inside duplicated lines is measured with rolling hashes in numpy,
one Arrow batch at a time; no shuffle. Every text is judged alone and whole.

Defined results: a null or empty text has no words and fails the base rule; a null
doc_id stays null; repeated rows are judged alike, row by row; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lessonloom.llm.common import BYTE_CODE, BYTES, WORDS, bodies, cover, in_small_batches, mix, read_documents, word_hashes

#: Largest share of word characters allowed in duplicated n-grams, by n, and in duplicated lines.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.30
MAX_SYMBOL_SHARE = 0.10
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars"]
SCHEMA = "id long, n_words long, " + ", ".join(f"{c} long" for c in COUNTS) + "".join(f", gram_chars_{n} long" for n in MAX_NGRAM_SHARE)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the keys that occur at least twice, and of those that equal an earlier one."""
    plain = np.sort(keys)
    if not (plain[1:] == plain[:-1]).any():
        return (none := np.zeros(len(keys), bool)), none
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def measure(body: bytes) -> list[int]:
    """Counts of one text, in the order of SCHEMA after the id."""
    data = np.frombuffer(body, np.uint8)
    hashes, starts, ends = word_hashes(data)
    n = len(hashes)
    if not n:
        return [0, 0, int(SYMBOLS[data].sum()), 0, 0, 0] + [0] * len(MAX_NGRAM_SHARE)
    firsts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    chars = firsts[ends] - firsts[starts]
    feeds = np.flatnonzero(data == 10)
    line_at, line_to = np.concatenate(([0], feeds + 1)), np.concatenate((feeds, [len(data)]))
    with_word = np.searchsorted(starts, line_at) < np.searchsorted(starts, line_to)
    line_at, line_to = line_at[with_word], line_to[with_word]
    line_keys = mix(BYTES.spans(BYTE_CODE[data], line_at, line_to) + (line_to - line_at).astype(np.uint64))
    _, later = repeated(line_keys)
    before = np.concatenate(([0], np.cumsum(chars)))
    line_chars = int((before[np.searchsorted(starts, line_to[later])] - before[np.searchsorted(starts, line_at[later])]).sum())
    shares, words_5 = [], 0
    for size in MAX_NGRAM_SHARE:
        grams = WORDS.windows(hashes, size)
        if not len(grams):
            shares.append(0)
            continue
        twice, later_gram = repeated(grams)
        if size == 5:
            at = np.flatnonzero(twice)
            words_5 = int(cover(n, at, at + size).sum())
        at = np.flatnonzero(later_gram)
        shares.append(int(chars[cover(n, at, at + size)].sum()) if len(at) else 0)
    return [n, int(chars.sum()), int(SYMBOLS[data].sum()), int(later.sum()), words_5, line_chars, *shares]


def repetition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the counts from which the rules are decided (columns of SCHEMA), and row, the document's own columns."""
    names = [f.strip().split()[0] for f in SCHEMA.split(",")]
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts = list(zip(*[measure(body) for body in bodies(part.column(1))])) or [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in counts], part.column(2)], [*names, "row"])

    return rows.mapInArrow(batches, StructType([*[StructField(n, LongType()) for n in names], rows.schema["row"]]))


def judge(counts: DataFrame) -> DataFrame:
    """Adds base_failed and kept to the counts.

    The base rule fails texts of under 10 words, or with over a fifth of the words in
    5-word windows found twice. The method's rule then fails a text whose characters
    in later copies of n-grams or lines, or whose symbols, pass the shares above.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = F.col("line_chars") <= MAX_LINE_SHARE * F.col("word_chars")
    fine &= F.col("n_symbols") <= MAX_SYMBOL_SHARE * F.col("word_chars")
    for n, share in MAX_NGRAM_SHARE.items():
        fine &= F.col(f"gram_chars_{n}") <= share * F.col("word_chars")
    return counts.withColumns({"base_failed": base, "kept": ~base & fine})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed and kept for every document."""
    return judge(repetition_counts(docs, id_col, text_col).drop("row")).withColumnRenamed("id", "doc_id")


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(repetition_counts(docs, id_col, text_col)).where("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", *[f"gram_chars_{n}" for n in MAX_NGRAM_SHARE]
    )
