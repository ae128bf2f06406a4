"""Substring dedup by level-wise doubling.

Which windows of ``window`` words occur more than once in the corpus? Windows that
repeat at one length alone are extended to twice that length, until the last length:

* level 1: from each window one run of 9 words is tried, the first of those of least
  hash, so equal windows try equal runs at equal places; a window whose run is tried at
  no other place is done;
* level 2: of what is left, that run extended to 18 words, forwards where the window
  holds it, else backwards;
* level 3: the windows left are tried at their whole length of 35 words.

(The lengths halve from the window's: 35, 18, 9.) Each level is one exchange of 64-bit
keys packed by chunk and bucket (see ``chunks``), all of them over one shuffle of the
documents. The shorter levels only leave candidates out; the last level, which decides,
compares two 64-bit hashes of a window's words, so that windows that differ are told
apart at any size of corpus that can be stored.

Defined results: a null or empty text has no words; a text of fewer words than the
window keeps all; windows of the same document count as each other's repeats; repeated
rows are repeats of each other; a null doc_id stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.llm.chunks import ANSWERED, ASKED, TWICE, Keys, answer, ask, by_bucket, chunked, count_keys, documents_of, groups_of, is_in, room_of, told_of, with_answers, words_of
from lessonloom.llm.common import WORDS, Powers, back_to_null, cover, marked_runs, mix, read_documents, word_bounds

WINDOW = 35
#: A second hash of word runs, of another base.
CONFIRM = Powers(0xC2B2AE3D27D4EB4F)
FEWEST_LEVEL_WORDS = 9


def levels_of(window: int) -> list[int]:
    """Lengths from short to long, each at most twice the one before."""
    out = [window]
    while out[0] > FEWEST_LEVEL_WORDS and (half := (out[0] + 1) // 2) >= FEWEST_LEVEL_WORDS:
        out.insert(0, half)
    return out


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of every window of ``width`` values, by doubling."""
    at, have = np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


class Windows:
    """The words of a chunk, and what its windows try at each level."""

    def __init__(self, table: pa.Table, window: int):
        self.words, self.counts = words_of(table)
        self.room = room_of(self.counts)
        self.window, self.lengths = window, levels_of(window)
        n = max(len(self.words) - window + 1, 0)
        self.whole = self.room[:n] >= window
        self.alive = self.whole.copy()
        self.at = np.empty(0, np.int32)  # where the run begins that each window tries

    def run_keys(self, length: int) -> np.ndarray:
        return mix(WORDS.windows(self.words, length) + np.uint64(length))

    def keys(self, level: int) -> Keys:
        """Distinct keys of the runs that living windows try at a level, and which of them occur at several places of the chunk."""
        length = self.lengths[level]
        runs = self.run_keys(length)
        if length == self.window:
            self.tries = runs
            keys, more = runs[self.alive], mix(CONFIRM.windows(self.words, length))[self.alive] if len(runs) else runs
            order, at = groups_of(keys, more)
            counts = np.diff(np.append(at, len(keys)))
            self.which = np.empty(len(keys), np.int64)  # which of the distinct pairs each living window has
            self.which[order] = np.repeat(np.arange(len(at)), counts)
            return keys[order[at]], counts, more[order[at]]
        if level:
            self.extend(self.lengths[level - 1], length)
        elif len(self.whole):
            self.at = first_least(runs, self.window - length + 1)
        self.tries = runs[self.at]
        # two windows may try one and the same run, which makes it no repeat: count places
        return count_keys(runs[np.unique(self.at[self.alive])])

    def extend(self, have: int, length: int) -> None:
        """From the run that each window tried to one of ``length`` words: forwards where the window holds it, else backwards."""
        inside = self.at - np.arange(len(self.at), dtype=self.at.dtype)
        self.at = np.where(inside + length <= self.window, self.at, self.at - (length - have))

    def kill(self, level: int, keys: Keys, answers: pa.Table, buckets: int) -> None:
        """Windows live on whose run is repeated."""
        if not len(self.tries):
            return
        told = told_of(keys, answers, buckets) >= TWICE
        if self.lengths[level] == self.window:
            self.alive[self.alive] = told[self.which]
        else:
            self.alive = self.alive & is_in(self.tries, keys[0][told])

    def replay(self, answers: pa.Table, levels: int, buckets: int) -> None:
        """Live through the first levels again, by their answers."""
        which = answers.column("level").to_numpy()
        for level in range(levels):
            self.kill(level, self.keys(level), answers.filter(pa.array(which == level)), buckets)


def asker(level: int, window: int, buckets: int):
    """Function that lists what a chunk tries at a level, given the answers to the levels before."""

    def ask_level(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ask(0, count_keys(np.empty(0, np.uint64)), buckets)
        windows = Windows(table, window)
        windows.replay(told, level, buckets)
        return ask(table.column("chunk")[0].as_py(), windows.keys(level), buckets)

    def ask_first(table: pa.Table) -> pa.Table:
        return ask(table.column("chunk")[0].as_py(), Windows(table, window).keys(0), buckets)

    return ask_level if level else ask_first


def judge_of(level: int):
    def judged(table: pa.Table) -> pa.Table:
        return answer(table).append_column("level", pa.array(np.full(table.num_rows, level), pa.int32()))

    return judged


def repeats(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """Answers to all levels (with a column level) for documents as ``chunked`` gives them."""
    answers = None
    for level in range(len(levels_of(window))):
        f = asker(level, window, buckets)
        asked = with_answers(docs, answers, f, ASKED) if level else docs.groupBy("chunk").applyInArrow(f, ASKED)
        now = by_bucket(asked, buckets, judge_of(level), ANSWERED + ", level int")
        answers = answers.unionByName(now) if level else now
    return answers


REMOVED = "id long, tag binary, n_words long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, tag (128 bits of the text), n_words, n_removed, n_spans and kept (the kept words joined by one space, UTF-8)."""
    rows, buckets = chunked(docs, id_col, text_col)
    answers = repeats(rows, buckets, window)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in REMOVED.split(", ")}
        if table.num_rows:
            windows = Windows(table, window)
            windows.replay(told, len(windows.lengths), buckets)
            at = np.flatnonzero(windows.alive)
            removed = np.split(cover(len(windows.words), at, at + window), np.cumsum(windows.counts)[:-1])
            for (name, tag, body), gone in zip(documents_of(table), removed):
                starts, ends = word_bounds(np.frombuffer(body, np.uint8))
                kept = np.flatnonzero(~gone)
                row = name, tag, len(gone), int(gone.sum()), len(marked_runs(gone)[0]), b" ".join([body[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist())])
                for c, v in zip(out, row):
                    out[c].append(v)
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.binary()]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    return with_answers(rows, answers, cut, REMOVED)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_documents(spark, sf_dir))
    return cut.select(back_to_null("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")
