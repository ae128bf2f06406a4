"""Stages of the corpus pipeline, each held against brute force on its own input."""

import collections
import re

import corpus_pipeline as P
import tiktoken

from lessonloom.llm import byte_bpe as B
from lessonloom.llm.queries import QUERIES
from lessonloom.llm.quality_rules import quality_rules
from lessonloom.llm.source_mixing import mix
from tests.llm.test_dedup import brute_links, brute_windows

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, before, FOLDER)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if k < 4:
            assert after.columns == COLUMNS
            got = [(r.doc_id, r.text) for r in after.collect()]
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if k == 0:
            good = {r.doc_id for r in quality_rules(before).where("kept").collect()}
            assert sorted(got) == sorted(x for x in rows if x[0] in good)
        elif k == 1:
            heads = {c for _, c, _ in brute_links(rows)}
            assert sorted(got) == sorted(x for x in rows if x[0] in heads)
        elif k == 2:
            told = {i: (n, t) for i, _, n, t in brute_windows(rows)}
            assert sorted(got) == sorted((i, told[i][1] if told[i][0] else t) for i, t in rows if told[i][1])
        elif k == 3:
            words = collections.Counter()
            for i, t in got:
                words[i] += len(WORD.findall(t))
            assert words == collections.Counter({r.doc_id: r.taken for r in mix(before).collect() if r.taken})
        else:
            ranks, pattern = B.default_vocabulary()
            library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.parse_ranks(ranks), special_tokens={})
            want = sorted((i, t, tuple(library.encode_ordinary(t))) for i, t in rows)
            assert sorted((r.doc_id, r.decoded, tuple(r.ids)) for r in after.collect()) == want
        before = after


def test_stages_take_odd_rows(spark, docs, no_docs):
    for name, stage in P.STAGES:
        assert stage(spark, docs, FOLDER).count() > 0, name
        assert stage(spark, no_docs, FOLDER).count() == 0, name


def test_mixing_of_repeated_rows_and_ids(spark):
    """Words that the mixing stage gives, per source, against the takes of each row; equal rows have stretches of their own."""
    rows = [(k % 9 if k % 4 else None, " ".join(f"w{k % 13}x{j}" for j in range(40 + 90 * (k % 13))), "en" if k % 2 else "de", f"src{k % 3}", k % 13) for k in range(90)]
    rows += [(5, " ".join(f"same{j}" for j in range(700)), "en", "src0", 1)] * 25
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    given, told = collections.Counter(), collections.Counter()
    for r in P.mixing(spark, df, FOLDER).collect():
        given[r.source] += len(WORD.findall(r.text))
    for r in mix(df).collect():
        told[r.source] += r.taken
    assert given == told


def test_all_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
