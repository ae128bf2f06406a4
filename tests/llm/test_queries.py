"""The registered queries themselves, on a small folder of tables, and the SQL texts against them."""

import collections
import hashlib
import re

import duckdb
import pytest
import tiktoken

from lessonloom.llm import byte_bpe as B
from lessonloom.llm import source_mixing as M
from lessonloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import rows
from tests.llm.test_dedup import brute_links, brute_shared, brute_windows

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with ids once each (null among them) and odd texts, with labels and pages."""
    at = str(tmp_path_factory.mktemp("tables"))
    seen, docs = set(), []
    for r in rows():
        if r[0] not in seen:
            seen.add(r[0])
            docs.append(r[:5])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, k % 2) for k, (i, *_) in enumerate(docs) if i], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(1, "http://a.de/x", "<html lang='de'><p>" + "wort und satz " * 40 + "</p>"), (2, None, None), (None, "http://b.com", "<script>" + "x" * 100_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at, [(i, t) for i, t, *_ in docs], docs


def result(spark, name, at):
    return {r.doc_id: r for r in QUERIES[name](spark, at).collect()}


def last(i):
    return (1 << 63) - 1 if i is None else i


def test_op1(spark, folder):
    at, texts, _ = folder
    got = result(spark, "op1_suffix_dedup", at)
    for i, n, removed, spans, kept in brute_shared([(last(i), t) for i, t in texts]):
        r = got[None if i == last(None) else i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, sha(kept))


def test_op2_and_op8(spark, folder):
    at, texts, _ = folder
    ranks, pattern = B.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.parse_ranks(ranks), special_tokens={})
    got, counted = result(spark, "op2_byte_bpe", at), result(spark, "op8_token_counts", at)
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
        assert counted[i].n_tokens == len(ids)


def test_op4(spark, folder):
    at, texts, _ = folder
    got = result(spark, "op4_weighted_sampling", at)
    order = sorted(texts, key=lambda x: last(x[0]))
    for (i, t), (_, follow) in zip(order, order[1:] + order[:1]):
        t, follow = t or "", follow or ""
        half = len(t) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(t[: len(t) - half] + follow[:half]))
        assert 0 <= got[i].near_edited <= 1 and (t != follow or got[i].near_next == 1)


def test_op5_and_op6(spark, folder):
    import zlib

    at, texts, _ = folder
    got = result(spark, "op5_toxicity", at)
    for i, _ in texts:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3)
    assert QUERIES["op6_language_id"](spark, at).count() == 3


def test_op7(spark, folder):
    at, _, docs = folder
    got = result(spark, "op7_source_mixing", at)
    sizes = collections.Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, M.share_out([sizes[s] for s in order])))
    for i, t, _, s, _ in docs:
        r = got[i]
        assert (r["size"], r.source_size) == (len(WORD.findall(t or "")), sizes[s]) and r.target == pytest.approx(target[s]) and r.taken <= 3 * r["size"]


def test_op9_and_op10(spark, folder):
    at, texts, _ = folder
    known = [(last(i), t) for i, t in texts]
    got = result(spark, "op9_substring_dedup", at)
    for i, n, removed, kept in brute_windows(known):
        r = got[None if i == last(None) else i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, sha(kept))
    joined = result(spark, "op10_jaccard_join", at)
    for i, c, n in brute_links(known):
        r = joined[None if i == last(None) else i]
        assert (last(r.class_id), r.n_links) == (c, n)


SIZES = "select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::bigint as size, row_number() over (order by source nulls last) - 1 as n from documents group by 1"
#: Shares by weight without a ceiling: what targets are where none stops at three times its source.
TARGETS = f"with s as ({SIZES}), w as (select *, [5, 2, 1][n % 3 + 1] as weight from s) select source, size, sum(size) over () * weight / sum(weight) over () as target from w"
EDITED = "with t as (select doc_id, coalesce(text, '') as t, lead(coalesce(text, '')) over (order by doc_id) as f, first_value(coalesce(text, '')) over (order by doc_id) as g from documents) select doc_id, length(t) as n_chars, sha256(concat(substr(t, 1, length(t) - length(t) // 2), substr(coalesce(f, g), 1, length(t) // 2))) as edited_sha256 from t"


def test_sql(spark):
    """The SQL texts, and SQL for what it can state of op4 and op7, give the queries' results on the smallest tables."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    for name, sql in ORACLES.items():
        found = con.execute(sql)
        columns = sorted(d[0] for d in found.description)
        want = sorted(tuple(dict(zip([d[0] for d in found.description], r))[c] for c in columns) for r in found.fetchall())
        df = QUERIES[name](spark, FOLDER)
        assert sorted(df.columns) == columns
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want, name
    got = QUERIES["op4_weighted_sampling"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(con.execute(EDITED).fetchall())
    mixed = {r.source: (r.source_size, r.target) for r in QUERIES["op7_source_mixing"](spark, FOLDER).collect()}
    shares = con.execute(TARGETS).fetchall()
    ceiling = any(t > 3 * n for _, n, t in shares)
    for s, n, t in shares:
        assert mixed[s][0] == n and (ceiling or mixed[s][1] == pytest.approx(t))
    assert sum(t for _, t in mixed.values()) == pytest.approx(sum(n for _, n, _ in shares))
