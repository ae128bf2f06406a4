"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel of two strings counts the three-character subsequences they share, each
occurrence weighted by ``DECAY`` to the power of its span (gaps included, up to
``SPAN``), normalised; so an insult with inserted or missing characters still lies
close to the insult. Landmarks are strings of labelled sentences; Nyström features are
the kernel values against them, whitened; a linear machine with hinge loss is trained on
them. As the kernel is a sum over subsequences, the trained function of a string is one
too, and scoring looks up one weight per subsequence.

Training. The machine is trained on labelled sentences: those of at most ``TRAIN_ROWS``
toxic and as many clean training rows (the ones of least hash). A sentence is a bag of
strings (its words, and rows of single characters joined) and is as toxic as its
strongest string; a toxic text has at least one toxic sentence, a clean text none. So
each round takes, by the machine so far, the strongest string of each toxic text's
strongest sentence as a positive example and the strongest string of every clean
sentence as a negative one, with the number of sentences as its weight, and trains anew
(``ROUNDS`` times). The first round has no machine yet; it starts from strings whose
numbers of sentences in toxic and clean texts differ most, counted by a grouped
aggregation over all training rows; the clearest of them (``SURE_RATIO``) stay examples, as
an insult that stands beside stronger ones is never the strongest. How the two strongest
strings of a text and the number of its strings make its score is fitted on at most
``CALIBRATION_ROWS`` labelled rows: in a long text some string is strong by chance. A word
also counts as what it reads as without inner punctuation, with repeated letters once, or
with a piece of two letters before it. Scoring reads every whole text, in
Arrow batches, with no shuffle. Limits of the method: a phrase that is toxic although each
of its words is harmless is not found, nor an insult of one or two letters.

Defined results: a null or empty text scores like a clean one; bytes that are no UTF-8
are read as U+FFFD; without any toxic
training row all score 0; a null doc_id is not held out and stays null; labels without
a text, of null label, or repeated are ignored; repeated rows are scored alike; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Collection, Iterator
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.llm.common import in_small_batches, read_documents, small_side, text_key, texts, with_checkpoint_dir

DECAY, SPAN = 0.6, 7
#: Longer strings are scored by overlapping parts of this length.
PART = 24
CODES = 64
LANDMARKS = 256
MOST_TOXIC, MOST_CLEAN = 512, 4096
#: Labelled rows of each label whose sentences train the machine, and how often it is trained anew on them.
TRAIN_ROWS, ROUNDS = 3000, 2
CALIBRATION_ROWS = 6000
#: A string marks toxic sentences from this log-likelihood ratio on, in so many sentences and with this share of them.
LEAST_RATIO, LEAST_SENTENCES, LEAST_SHARE = 12.0, 4, 0.9
#: From this ratio on a string stays an example in every round.
SURE_RATIO = 40.0
THRESHOLD = 0.3
REMEMBERED = 300_000
#: Texts scored together.
AT_ONCE = 256
HELD_OUT = 2
SENTENCE_END = re.compile(r"[.!?\n]+")
INNER, RUN = re.compile(r"[^\w]+|_+"), re.compile(r"(.)\1+")
#: A text of fewer strings counts as one of so many.
FEW_STRINGS = 8


# --- the kernel -------------------------------------------------------------------


@lru_cache(maxsize=None)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j < k of all subsequences of a string of n characters within the span, and their weights."""
    i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    keep = (i < j) & (j < k) & (k - i < SPAN)
    i, j, k = i[keep], j[keep], k[keep]
    return i, j, k, DECAY ** (k - i + 1).astype(np.float64)


def codes(word: str) -> list[int]:
    return [c - 97 if 97 <= (c := ord(x)) <= 122 else 26 + c % (CODES - 26) for x in word]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, their subsequence numbers, weights), words of one length together."""
    by_length: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by_length.setdefault(len(w), []).append(at)
    for n, which in by_length.items():
        i, j, k, weight = triples(n)
        if len(i):
            c = np.array([codes(words[at]) for at in which], np.int32)
            yield np.array(which), (c[:, i] * CODES + c[:, j]) * CODES + c[:, k], weight


def grouped(numbers: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, summed weight) of the distinct numbers of each row."""
    order = np.argsort(numbers, axis=1, kind="stable")
    ranked = np.take_along_axis(numbers, order, 1)
    new = np.ones(ranked.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    first = np.flatnonzero(new)
    return first // ranked.shape[1], ranked.ravel()[first], np.add.reduceat(weight[order].ravel(), first)


def norms(numbers: np.ndarray, weight: np.ndarray) -> np.ndarray:
    row, _, sums = grouped(numbers, weight)
    return np.sqrt(np.bincount(row, sums**2, minlength=len(numbers)))


class Landmarks:
    """Normalised subsequence vectors of some strings; only the subsequences that one of them has get a row."""

    def __init__(self, words: list[str]):
        entries = []
        for which, numbers, weight in subsequences(words):
            row, number, sums = grouped(numbers, weight)
            entries.append((which[row], number, sums / norms(numbers, weight)[row]))
        which, numbers, sums = map(np.concatenate, zip(*entries))
        self.numbers, at = np.unique(numbers, return_inverse=True)
        self.table = np.zeros((len(self.numbers) + 1, len(words)))  # the last row stands for all other subsequences
        np.add.at(self.table, (at, which), sums)
        self.row = np.full(CODES**3, len(self.numbers))
        self.row[self.numbers] = np.arange(len(self.numbers))

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        out = np.zeros((len(words), self.table.shape[1]))
        for which, numbers, weight in subsequences(words):
            for k in range(0, len(which), 64):
                n = numbers[k : k + 64]
                out[which[k : k + 64]] = np.einsum("wtl,t->wl", self.table[self.row[n]], weight) / norms(n, weight)[:, None]
        return out

    def spread(self, of_landmarks: np.ndarray) -> np.ndarray:
        """One weight a subsequence from one a landmark."""
        out = np.zeros(CODES**3)
        out[self.numbers] = self.table[:-1] @ of_landmarks
        return out


# --- strings of a text ------------------------------------------------------------


def parts_of(word: str) -> list[str]:
    if len(word) <= PART:
        return [word]
    step = PART // 2
    return [word[a : a + PART] for a in range(0, len(word) - step, step)]


def strings_of(text: str, known: Collection[str] = ()) -> set[str]:
    """Lower-case words without outer punctuation, rows of single characters joined, and what a piece of two letters makes with the word after it, where that is ``known``."""
    out, single, piece = set(), [], ""
    for token in text.lower().split():
        token = token.strip(string.punctuation)
        n = len(token)
        if n == 1:
            single.append(token)
            piece = ""
            continue
        if single:
            if len(single) > 2:
                out.update(parts_of("".join(single)))
            single = []
        if n > 2:
            out.update(parts_of(token) if n > PART else (token,))
            if piece and piece + token in known:
                out.add(piece + token)
            piece = ""
        else:
            piece = token
    if len(single) > 2:
        out.update(parts_of("".join(single)))
    return out


def readings(word: str) -> tuple[str, str]:
    """A word without inner punctuation, and with repeated letters once."""
    bare = word if word.isalpha() else INNER.sub("", word)
    return bare, RUN.sub(r"\1", bare)


# --- the model --------------------------------------------------------------------


class Model:
    """weights: of every subsequence; bias; how the two strongest strings make a score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self.calibration = np.array([1.0, 0.0, 0.0, 0.0])
        self.seen: dict[str, float] = {}
        #: Learnt insults and their values.
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for which, numbers, weight in subsequences(words):
            for k in range(0, len(which), 2048):
                n = numbers[k : k + 2048]
                raw = (self.weights[n] * weight).sum(1)
                some = np.flatnonzero(raw > 0)  # strings without evidence for an insult keep the bias
                if len(some):
                    out[which[k : k + 2048][some]] = raw[some] / norms(n[some], weight) + self.bias
        return out

    def remember(self, words: set[str]) -> None:
        """Values of new strings, of many texts at once; one that reads as a learnt insult is worth that."""
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = list(words)
        if new:
            self.seen.update(zip(new, self.decide(new).tolist()))
            for w in new if self.known else ():
                for reading in readings(w):
                    if reading in self.known:
                        self.seen[w] = max(self.seen[w], self.known[reading])

    def bags(self, bodies: list[str]) -> list[set[str]]:
        return [strings_of(t, self.known) for t in bodies]

    def strongest(self, bags: list[set[str]]) -> list[tuple[float, float, float]]:
        """The two largest values among the strings of each text, and the logarithm of their number: in a long text some string is strong by chance."""
        self.remember(set().union(*bags))
        out = []
        for words in bags:
            values = nlargest(2, map(self.seen.__getitem__, words))
            out.append((*(*values, self.bias, self.bias)[:2], float(np.log(max(len(words), FEW_STRINGS)))))
        return out

    def strongest_strings(self, text: str) -> list[tuple[float, str]]:
        """The strongest string of each sentence that has one, with its value."""
        sentences = [words for x in SENTENCE_END.split(text) if (words := strings_of(x))]
        self.remember(set().union(*sentences))
        return [max((self.seen[w], w) for w in words) for words in sentences]

    def scores(self, bodies: list[str]) -> np.ndarray:
        z = within_margin(np.array(self.strongest(self.bags(bodies)))) @ self.calibration[:3] + self.calibration[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def within_margin(values: np.ndarray) -> np.ndarray:
    """Beyond the margin a string is no surer; the third column is the number of strings."""
    return np.hstack([np.clip(values[:, :2], -1.0, 1.0), values[:, 2:]])


def calibrate(values: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of the two strongest strings, none below 0, and of the number of strings, none above; and a bias."""
    x, free = within_margin(values), [0, 1, 2]
    while True:
        found = train_logistic(x[:, free], toxic)
        wrong = [k for k, w in zip(free, found) if (w > 0 if k == 2 else w < 0)]
        if not wrong:
            w = np.zeros(4)
            w[[*free, 3]] = found
            return w
        free.remove(wrong[0])


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine of hinge loss by dual coordinate ascent; ``weight`` is each example's price of a violation."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, dual, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(1)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(dual[i] + (1 - y[i] * (x[i] @ w)) / square[i], 0.0), weight[i])
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
    return w[:-1], float(w[-1])


def train_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - y) + 1e-3 * w)
    return w


def train(toxic: list[str], clean: list[str]) -> Model:
    """Nyström features against landmarks from both kinds, then the machine, then one weight a subsequence.

    Strings come with the most telling ones first; landmarks are taken from the front.
    """
    words = [w for w in toxic if len(w) >= 3][:MOST_TOXIC], [w for w in clean if len(w) >= 3][:MOST_CLEAN]
    if not words[0] or not words[1]:
        return Model(np.zeros(CODES**3), -30.0)
    half = min(LANDMARKS // 2, len(words[0]))
    landmarks = Landmarks(words[0][:half] + words[1][: LANDMARKS - half])
    values, vectors = np.linalg.eigh(landmarks.kernel(words[0][:half] + words[1][: LANDMARKS - half]))
    white = vectors / np.sqrt(np.maximum(values, 1e-2))
    x = landmarks.kernel(words[0] + words[1]) @ white
    y = np.array([1.0] * len(words[0]) + [-1.0] * len(words[1]))
    # Strings come with the clearest (toxic) or the most common (clean) first; a violation by those costs more.
    rank = np.concatenate([1 + 30 / (1 + np.arange(len(w)) / 64) for w in words])
    w, bias = train_machine(x, y, rank)
    return Model(landmarks.spread(white @ w), bias)


# --- over tables ------------------------------------------------------------------


def remainder(id_col: str):
    """crc32 of the id as text, modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)), F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(h, text_id, toxic) of the training rows: for each distinct text its hash, the least id that holds it, and its label (toxic if any of its rows is)."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(remainder("label_id") != HELD_OUT).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    held = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("text_id"), text_key(F.col(text_col).cast("binary")).alias("h"))
    return held.join(known, held["text_id"] == known["label_id"]).groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("text_id").alias("text_id"))


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of chosen rows; an id that names several texts takes the one of the hash."""
    held = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    return held.join(small_side(chosen, 56), "text_id").where(text_key(F.col("text").cast("binary")) == F.col("h")).select("text", "toxic")


def least_hashed(rows: DataFrame, most: int, total: int) -> DataFrame:
    """The ``most`` rows of least hash, of ``total``; hashes that are too great for them by far are dropped where they lie, so few rows are ever ranked."""
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 31))
    share = min(1.0, 2.0 * most / max(total, 1))
    return rows.where(place < F.lit(int(share * (1 << 31)))).orderBy(place, "h").limit(most)


def examples(sample: DataFrame, model: Model) -> tuple[list[str], list[str]]:
    """Strings that the labelled sentences give the machine, the most frequent first: (toxic, clean)."""

    def strings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[str, int]] = []
            for text, toxic in zip(texts(part.column(0)), part.column(1).to_pylist()):
                found = model.strongest_strings(text)
                if toxic and found:
                    value, word = max(found)
                    out += [(word, 1)] if value > model.bias else []  # no string of the text looks like an insult
                elif not toxic:
                    out += [(word, 0) for _, word in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], ["word", "toxic"])

    counted = sample.mapInArrow(strings, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    bad = counted.where("bad > good").orderBy(F.desc("bad"), "word").limit(MOST_TOXIC).select("word").collect()
    good = counted.where("good >= bad").orderBy(F.desc("good"), "word").limit(MOST_CLEAN // 2).select("word").collect()
    return [r.word for r in bad], [r.word for r in good]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    with_checkpoint_dir(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col, label_col).checkpoint()

    def sentences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text, toxic in zip(texts(part.column(0)), part.column(1).to_pylist()):
                counts: dict[str, int] = {}
                for sentence in SENTENCE_END.split(text):
                    for w in strings_of(sentence):
                        counts[w] = counts.get(w, 0) + 1
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([n * toxic for n in counts.values()], pa.int64()), pa.array([n * (1 - toxic) for n in counts.values()], pa.int64())], ["word", "bad", "good"])

    totals = rows.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not totals or not totals.bad or not totals.good:
        return Model(np.zeros(CODES**3), -30.0)
    counted = texts_of(docs, rows, id_col, text_col).mapInArrow(sentences, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).checkpoint()
    rate = float(totals.bad) / float(totals.bad + totals.good)
    n, share = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    ratio = 2 * (F.col("bad") * F.log(F.greatest(share, F.lit(1e-9)) / rate) + F.col("good") * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - rate)))
    counted = counted.withColumns({"n": n, "share": share, "ratio": ratio})
    marks = (F.col("share") >= LEAST_SHARE) & (F.col("ratio") >= LEAST_RATIO) & (F.col("bad") >= LEAST_SENTENCES)
    ranked = counted.where(marks).orderBy(F.desc("ratio"), "word").limit(MOST_TOXIC).select("word", "ratio").collect()
    toxic, sure = [r.word for r in ranked], [r.word for r in ranked if r.ratio >= SURE_RATIO]
    often = counted.where(F.col("share") < 2 * rate).orderBy(F.desc("n"), "word").limit(MOST_CLEAN // 2).select("word").collect()
    some = counted.where(F.col("bad") == 0).orderBy(F.xxhash64("word"), "word").limit(MOST_CLEAN // 2).select("word").collect()
    clean = list(dict.fromkeys(w.word for pair in zip(often, some) for w in pair)) or [w.word for w in often + some]
    model = train(toxic, clean)
    chosen = least_hashed(rows.where("toxic = 1"), TRAIN_ROWS, totals.bad).unionByName(least_hashed(rows.where("toxic = 0"), TRAIN_ROWS, totals.good))
    sample = texts_of(docs, chosen, id_col, text_col)
    for _ in range(ROUNDS if model.bias > -30 else 0):
        bad, good = examples(sample, model)
        # An insult that stands beside stronger ones is never the strongest, and still one.
        bad = list(dict.fromkeys(sure + bad))[:MOST_TOXIC]
        # Clean sentences are strongest in rare strings; common ones and others stay beside them.
        clean_now = list(dict.fromkeys([w for pair in zip(good, clean) for w in pair] + clean))[:MOST_CLEAN]
        model = train(bad, [w for w in clean_now if w not in set(bad)])
    if model.bias > -30:
        model.known = {w: v for w, v in zip(sure, model.decide(sure).tolist()) if v > 0}
        sample = texts_of(docs, least_hashed(rows, CALIBRATION_ROWS, totals.bad + totals.good), id_col, text_col)

        def strengths(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                got = model.strongest(model.bags(texts(part.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()), part.column(1).cast(pa.int32())], ["a", "b", "n", "toxic"])

        got = sample.mapInArrow(strengths, "a double, b double, n double, toxic int").collect()
        model.calibration = calibrate(np.array([[r.a, r.b, r.n] for r in got]), np.array([float(r.toxic) for r in got]))
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = [model.scores(texts(part.column(1).slice(k, AT_ONCE))) for k in range(0, part.num_rows, AT_ONCE)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs, model)
    return scored.select("doc_id", (remainder("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
