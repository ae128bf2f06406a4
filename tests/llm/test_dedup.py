"""Substring, suffix-array and near-duplicate operators against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lessonloom.llm import chunks
from lessonloom.llm.jaccard_join import bands_and_rows, jaccard_classes, one_of_each
from lessonloom.llm.substring_dedup import Windows, levels_of, remove_repeats
from lessonloom.llm.suffix_dedup import least_ids, remove_shared, sort_column_wise, suffixes_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1
MORE = [(100 + k, " ".join(random.Random(k % 7).choices("alpha beta gamma delta".split(), k=60 + k))) for k in range(12)]


def brute_shared(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, LAST + 1), i)
    out = []
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone.update(range(k, k + length))
        out.append((i, len(b), len(gone), sum(1 for p in gone if p - 1 not in gone), bytes(x for p, x in enumerate(b) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize("common", [4096, 2])
def test_suffix_dedup(spark, docs, plain_docs, common):
    extra = spark.createDataFrame(MORE, "doc_id long, text string")
    df = docs.unionByName(extra, allowMissingColumns=True)
    got = sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_shared(df, common=common).collect())
    assert got == brute_shared([(LAST if r[0] is None else r[0], r[1]) for r in plain_docs] + MORE)


ODD_IDS = [(None, f"{c} shares {' '.join(f'tail{i}' for i in range(40))} {' '.join(f'{c}{i}' for i in range(80))}") for c in "abcdefgh"] + [(7, "one text " * 20), (7, "another text " * 20), (7, "one text " * 20), (None, "one text " * 20), (None, None), (None, ""), (3, None)]


def test_rows_without_an_id_or_of_one_id(spark):
    """Rows are told apart by their texts: none loses what no other row holds, and none stands for another."""
    df = spark.createDataFrame(ODD_IDS, "doc_id long, text string").repartition(3)
    rows = [(LAST if i is None else i, t) for i, t in ODD_IDS]
    assert sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_shared(df).collect()) == brute_shared(rows)
    assert sorted((r.id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in remove_repeats(df).collect()) == brute_windows(rows)
    assert sorted((r.id, r.class_id, r.n_links) for r in jaccard_classes(df).collect()) == brute_links(rows)
    kept = [(r.doc_id, r.text) for r in one_of_each(df).collect()]
    assert {t for i, t in kept if i is None and t} == {t for i, t in ODD_IDS[:8]} and (7, "another text " * 20) in kept and (7, "one text " * 20) in kept


def test_chunks_follow_the_bytes():
    assert chunks.chunks_for(0, 12) == 12 and chunks.chunks_for(10**9, 12) == 239
    assert chunks.chunks_for(10**14, 3000) == -(-(10**14) // chunks.MOST_CHUNK)


def test_blocks_of_an_exchange_are_bounded():
    for total in (10**9, 10**12, 10**13, 10**14):
        n = chunks.partitions_for(chunks.chunks_for(total, 3000))
        assert n * n <= chunks.MOST_BLOCKS


def test_several_chunks_in_a_partition(spark, docs, plain_docs, monkeypatch):
    """Chunks and buckets beyond the partitions of an exchange give the same rows."""
    monkeypatch.setattr(chunks, "LEAST_CHUNK", 1 << 10)
    monkeypatch.setattr(chunks, "MOST_PARTITIONS", 3)
    rows, n = chunks.chunked(docs, "doc_id", "text")
    assert n > 3 and rows.rdd.getNumPartitions() <= 3
    plain = [(LAST if r[0] is None else r[0], r[1]) for r in plain_docs]
    assert sorted((r.id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in remove_repeats(docs).collect()) == brute_windows(plain)
    assert sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_shared(docs).collect()) == brute_shared(plain)


def test_windows_of_equal_keys_are_confirmed():
    keys, more = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 7], np.uint64)
    order, at = chunks.groups_of(keys, more)
    parts = [(keys[order[at]], np.diff(np.append(at, 4)), more[order[at]]), (np.array([5], np.uint64), np.array([1]), np.array([2], np.uint64))]
    import pyarrow as pa

    told = chunks.answer(pa.concat_tables([chunks.ask(k, p, 1) for k, p in enumerate(parts)]))
    assert [list(x) for x in told.column("told").to_pylist()] == [[chunks.TWICE, chunks.TWICE, chunks.ONCE], [chunks.TWICE]]


def test_suffix_dedup_of_nothing(no_docs):
    assert remove_shared(no_docs).count() == 0


def test_column_wise_order():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(5, 14))) for _ in range(40)]
    flat, n = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    starts = np.cumsum(n) - n
    bwt, prefix = sort_column_wise(flat, starts, n, 5)
    string, size = suffixes_of(bwt, n, 1)
    string[: len(n)] = np.arange(len(n))  # the empty suffixes
    suffixes = [texts[s][len(texts[s]) - k :] for s, k in zip(string, size)]
    assert suffixes == sorted(suffixes) and len(suffixes) == n.sum() + len(texts)
    assert [b for b in bwt] == [texts[s][len(texts[s]) - k - 1] if k < len(texts[s]) else 255 for s, k in zip(string, size)]
    for a, b, p in zip(suffixes, suffixes[1:], prefix[1:]):
        assert p == min(5, len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b)))))
    ids = np.arange(100, 140)[::-1].copy()
    for s, o, least in zip(*least_ids(flat, starts, n, ids, 5)):
        assert least == min(i for i, t in zip(ids, texts) if texts[s][o : o + 5] in t)


def brute_windows(rows, window=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    count = collections.Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def test_substring_dedup(spark, docs, plain_docs):
    extra = spark.createDataFrame(MORE, "doc_id long, text string")
    df = docs.unionByName(extra, allowMissingColumns=True)
    got = sorted((r.id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in remove_repeats(df).collect())
    assert got == brute_windows([(LAST if r[0] is None else r[0], r[1]) for r in plain_docs] + MORE)
    assert levels_of(35) == [9, 18, 35]


def test_runs_are_extended():
    """Each run tried at a level holds the one before and lies in its window; equal windows try equal places."""
    words = " ".join(str(k % 50 if k < 150 else (k * 7919) % 1000) for k in range(400))
    table = pa.table({"chunk": pa.array([0], pa.int32()), "id": pa.array([1]), "tag": pa.array([b"t"]), "body": pa.array([words.encode()])})
    w, before = Windows(table, 35), None
    for level, length in enumerate(w.lengths[:-1]):
        w.keys(level)
        begin = w.at - np.arange(len(w.at))
        assert (begin >= 0).all() and (begin + length <= 35).all()
        assert begin[0] == begin[50] == begin[100]
        if before is not None:
            assert (begin <= before).all() and (begin + length >= before + w.lengths[level - 1]).all()
        before = begin


def test_substring_dedup_of_nothing(no_docs):
    assert remove_repeats(no_docs).count() == 0


def brute_links(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    n, parent = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = collections.defaultdict(lambda: LAST)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def near_copies(n):
    rng, base = random.Random(9), [f"w{i}" for i in range(300)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append((1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_jaccard_join(spark, docs, plain_docs, block):
    near = near_copies(40)
    df = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"), allowMissingColumns=True)
    found = jaccard_classes(df, block=block)
    rows = [(LAST if r[0] is None else r[0], r[1]) for r in plain_docs] + near
    assert sorted((r.id, r.class_id, r.n_links) for r in found.collect()) == brute_links(rows)


def test_one_of_each(docs, plain_docs):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {c for _, c, _ in brute_links([(LAST if r[0] is None else r[0], r[1]) for r in plain_docs])}
    assert sorted(LAST if i is None else i for i in ids) == sorted(classes)


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard_classes(no_docs).count() == 0
    assert one_of_each(no_docs).count() == 0


def test_bands_reach_the_recall():
    bands, rows = bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_hot_keys_cost_one_entry_a_chunk():
    keys = chunks.count_keys(np.array([5, 5, 9], np.uint64))
    assert keys[0].tolist() == [5, 9] and keys[1].tolist() == [2, 1]
