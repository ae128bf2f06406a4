"""Rules, tokens, mixing, fingerprints, toxicity and language against brute force or held-out rows."""

import collections
import hashlib
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

from lessonloom.llm import byte_bpe as B
from lessonloom.llm import language_id as L
from lessonloom.llm import source_mixing as M
from lessonloom.llm import token_counts as C
from lessonloom.llm import toxicity as X
from lessonloom.llm import weighted_sampling as S
from lessonloom.llm.quality_rules import good_documents, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def vocabulary():
    return B.default_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks, pattern = vocabulary
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.parse_ranks(ranks), special_tokens={})


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


# --- quality ----------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep = len({p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, len(w) < 10 or 100 * rep > 20 * len(w)


def test_quality(docs, plain_docs):
    got = quality_rules(docs).collect()
    assert sorted((key((r.doc_id,)), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((key((i,)), *brute_quality(t)) for i, t, *_ in plain_docs)
    kept = {r.doc_id for r in got if r.kept}
    assert 17 in kept and 1 in kept and not kept & {2, 3, 11, 12, 18}
    good = good_documents(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in got)


def test_quality_of_nothing(no_docs):
    assert quality_rules(no_docs).count() == 0


# --- tokens -----------------------------------------------------------------------


def test_bpe_round_trip(docs, plain_docs, vocabulary, library):
    ranks, pattern = vocabulary
    rows = B.decode(B.encode(docs, ranks, pattern), ranks).collect()
    want = sorted((key((i,)), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in plain_docs)
    assert sorted((key((r.id,)), tuple(r.ids), bytes(r.body)) for r in rows) == want
    for r in rows:
        at = 0
        for token, end in zip(r.ids, r.ends):
            assert bytes(r.body)[at:end] == library.decode_single_token_bytes(token)
            at = end


def test_bpe_of_nothing(no_docs, vocabulary):
    assert B.encode(no_docs, *vocabulary).count() == 0


def test_merges_match_the_library_file(vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = B.tokenizer(vocabulary[0])
    assert all(own.token_to_id(known.id_to_token(i)) == i for i in range(0, 50256, 97))


def test_edited_counts(docs, vocabulary, library):
    ranks, pattern = vocabulary
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("length"), F.lit(c).alias("insert")) for a, b, c in [(3, 2, " 's ok"), (0, 0, "  "), (40, 7, ""), (10**6, 5, "\n\nend"), (-4, 1, None)]])
    trees = C.build(docs, ranks, pattern, edits=edits)
    for r in C.apply_edits(trees, ranks, pattern).collect():
        assert r.n_tokens == len(library.encode_ordinary(r.text or ""))
        assert r.n_tokens_edited == len(library.encode_ordinary(r.edited_text))
        text = r.text or ""
        for a, b, c in [(3, 2, " 's ok"), (0, 0, "  "), (40, 7, ""), (10**6, 5, "\n\nend"), (0, 1, "")]:
            text = text[:a] + c + text[a + b :] if a < len(text) else text + c
        assert r.edited_text == text
        if r.doc_id == 17:
            assert r.n_reencoded < 40


def test_bytes_that_are_no_utf8(spark, vocabulary, library):
    """A string column may hold any bytes; what is no UTF-8 is read as U+FFFD, and no operator breaks."""
    from lessonloom.llm.jaccard_join import jaccard_classes
    from lessonloom.llm.substring_dedup import remove_repeats
    from lessonloom.llm.suffix_dedup import remove_shared

    df = spark.sql("select 1L as doc_id, cast(X'61FF6220C3' as string) as text, 's' as source")
    text = b"a\xffb \xc3".decode("utf-8", "replace")
    got = B.round_trip(df, *vocabulary).first()
    assert list(got.ids) == library.encode_ordinary(text) and bytes(got.body) == text.encode()
    counted = C.apply_edits(C.build(df, *vocabulary), *vocabulary).first()
    assert counted.n_tokens == counted.n_tokens_edited == len(library.encode_ordinary(text))
    model = X.train(["idiot", "stupid"], ["banana", "window"])
    assert 0 <= X.toxicity(df, model).first().score <= 1
    assert quality_rules(df).first().n_words == 2 and M.mix(df).count() == 1 and S.compare_with_edits(df).count() == 1
    assert bytes(remove_repeats(df).first().kept) == b"a\xffb \xc3" and bytes(remove_shared(df).first().kept) == b"a\xffb \xc3" and jaccard_classes(df).first().class_id == 1


def test_edits_of_nothing(no_docs, vocabulary):
    assert C.apply_edits(C.build(no_docs, *vocabulary), *vocabulary).count() == 0


# --- mixing -----------------------------------------------------------------------


def test_shares():
    assert M.share_out([100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    assert M.share_out([10, 500, 490]) == pytest.approx([30.0, 970 * 2 / 3, 970 / 3])
    assert M.share_out([]) == [] and M.share_out([0, 0]) == [0.0, 0.0]


def test_mix(docs, plain_docs):
    rows = M.mix(docs, block=16).collect()
    assert len(rows) == len(plain_docs)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.mix(docs, block=16).collect()), key=str)
    sizes = collections.defaultdict(int)
    for _, t, _, s in plain_docs:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, M.share_out([sizes[s] for s in order])))
    taken = collections.defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 16 * 12 + 0.02 * target[s]


def test_mix_is_the_stated_schedule(spark):
    """Each document's takes against slots, ranks and blocks counted one by one; sources as many as sites."""
    rows = [(k, " ".join("w" * (1 + k % 3) for _ in range(k * 7 % 50)), f"site{k % 23}" if k % 29 else None) for k in range(300)]
    df, block = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), 16
    got = {r.doc_id: r for r in M.mix(df, block=block).collect()}
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(t.split()) for _, t, x in rows if x == s) for s in order]
    targets = M.share_out(sizes)
    total, edges = sum(targets), [round(sum(targets[: k + 1]) / sum(targets) * M.FRACTION) for k in range(len(order))]
    ranks, takes = collections.Counter(), collections.Counter()
    for slot in range(1, round(total / block) + 1):
        place = slot % M.FRACTION * M.GOLDEN % M.FRACTION
        k = next(k for k, e in enumerate(edges) if place < e or k == len(edges) - 1)
        blocks = -(-sizes[k] // block)
        if blocks and ranks[k] < 3 * blocks:
            takes[k, ranks[k] % blocks] += 1
        ranks[k] += 1
    for k, s in enumerate(order):
        mine = sorted((got[i] for i, _, x in rows if x == s and got[i]["size"]), key=lambda r: r.start)
        at = 0
        for r in mine:  # documents lie end to end
            assert r.start == at
            assert r.taken == sum(takes[k, w // block] for w in range(at, at + r["size"]))
            at += r["size"]
        assert at == sizes[k]


def test_mixed_documents(docs):
    words = {(r.doc_id): 0 for r in docs.collect()}
    for r in M.mixed_documents(docs, block=16).collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    told = collections.Counter()
    for r in M.mix(docs, block=16).collect():
        told[r.doc_id] += r.taken
    once = {i for i, n in collections.Counter(r.doc_id for r in docs.collect()).items() if n == 1}
    assert {i: words[i] for i in once} == {i: told[i] for i in once}


def test_mixed_documents_are_the_blocks_that_were_hit(spark):
    """Every word as often as its block was taken, over rows of which a third are one text."""
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(k * 13 % 90)), f"s{k % 3}", k % 2) for k in range(60)]
    rows += [(7, " ".join(f"same{j}" for j in range(45)), "s1", k % 2) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(4)
    want, got = collections.Counter(), collections.Counter()
    _, parts = M.stretches(M.sized(df, "doc_id", "text", "source"), M.WEIGHTS, 3, 16, None)
    for p in parts.collect():
        texts = [t for i, t, *_ in rows if i == p.id and len(t.split()) == p["size"]]
        for w in texts[0].split()[p.skipped : p.skipped + p.words]:
            want[w] += p.takes
    out = M.mixed_documents(df, block=16).collect()
    for r in out:
        got.update(r.text.split())
        assert r.text.split() and len(set(r.text.split())) == len(r.text.split())
    assert got == +want
    assert sum(want.values()) == sum(r.taken for r in M.mix(df, block=16).collect())
    assert {r.extra for r in out if r.doc_id == 7 and r.text.startswith("same")} == {0, 1}


def test_mix_of_nothing(no_docs):
    assert M.mix(no_docs).count() == 0
    assert M.mix(no_docs.sparkSession.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first().taken == 0


# --- fingerprints -----------------------------------------------------------------


def test_fingerprints(docs, plain_docs):
    rows = S.compare_with_edits(docs).collect()
    assert len(rows) == len(plain_docs)
    prints = collections.defaultdict(set)
    text = {i: t or "" for i, t, *_ in plain_docs}
    order = sorted(i for i in text if i is not None) + [None]
    after = dict(zip(order, order[1:] + order[:1]))
    for r in rows:
        i = None if r.id == S.LAST_ID else r.id
        prints[text[i]].add(r.fingerprint)
        assert r.n_chars == len(text[i]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if i != 14:  # two rows: the first is followed by the second
            t, n, follow = text[i], len(text[i]), text[after[i]]
            assert r.edited_sha256 == hashlib.sha256((t[: n - n // 2] + follow[: n // 2]).encode()).hexdigest()
    assert all(len(p) == 1 for p in prints.values())


@pytest.mark.parametrize("hot", [None, 5, -(1 << 62)])
def test_one_id_of_most_rows_is_cut_by_its_texts(spark, hot):
    """Nine rows of ten have one id: parts rise with (id, tie), none holds many rows, and each row meets the next."""
    ids = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(S.LAST_ID if hot is None else hot))
    rows = S.in_ranges(spark.range(6000).select(ids.alias("id"), F.xxhash64("id").alias("tie")))
    got = sorted((r.id, r.tie, r.part, r.after) for r in S.with_next(rows, ["id", "tie"], "tie", "after").collect())
    assert [r[2] for r in got] == sorted(r[2] for r in got)
    assert [r[3] for r in got] == [r[1] for r in got[1:] + got[:1]]
    assert max(collections.Counter(r[2] for r in got).values()) <= 60


@pytest.mark.xfail(strict=False, reason="its 60 pairs share 16 words, so their errors at 64 samples go together: the bound of 0.03 on the mean is 1.25 standard errors; the two tests below have words of their own")
def test_likeness_is_generalised_jaccard(spark):
    import random

    rng, rows = random.Random(2), []
    for k in range(60):
        a = rng.choices("abcdefghij", k=40)
        b = [x if rng.random() < k / 60 else rng.choice("klmnop") for x in a]
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    one, two = (S.fingerprints(df, ["k"], c).withColumnRenamed("fingerprint", f"f{c}") for c in "ab")
    got = {r.k: r.v for r in one.join(two, "k").select("k", S.likeness("fa", "fb").alias("v")).collect()}
    off = []
    for k, a, b in rows:
        x, y = collections.Counter(a.split()), collections.Counter(b.split())
        off.append(got[k] - sum((x & y).values()) / sum((x | y).values()))
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.25


def test_mean_likeness_over_texts_with_words_of_their_own(spark):
    """240 pairs whose words no other pair has: independent errors, so the mean of 64-sample likenesses is close."""
    import random

    rng, rows = random.Random(3), []
    for k in range(240):
        a = [f"p{k}{x}" for x in rng.choices("abcdefghij", k=40)]
        b = [x if rng.random() < (k % 60) / 60 else f"p{k}{rng.choice('klmnop')}" for x in a]
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(4)
    one, two = (S.fingerprints(df, ["k"], c).withColumnRenamed("fingerprint", f"f{c}") for c in "ab")
    got = {r.k: r.v for r in one.join(two, "k").select("k", S.likeness("fa", "fb").alias("v")).collect()}
    off = []
    for k, a, b in rows:
        x, y = collections.Counter(a.split()), collections.Counter(b.split())
        off.append(got[k] - sum((x & y).values()) / sum((x | y).values()))
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.25


def test_skewed_counts_of_many_words(spark):
    """20,000 distinct words, a fifth of them eight times: heavy words win by their weight, and the likeness holds."""
    words = [f"w{i}" for i in range(20_000)]
    a = [w for i, w in enumerate(words) for _ in range(8 if i % 5 == 0 else 1)]
    b = [w for i, w in enumerate(words) if i % 4 for _ in range(8 if i % 5 == 0 else 1)]
    df, count = spark.createDataFrame([(0, " ".join(a), " ".join(b))], "k int, a string, b string"), 512
    fa, fb = (S.fingerprints(df, ["k"], c, count).first().fingerprint for c in "ab")
    x, y = collections.Counter(a), collections.Counter(b)
    found = sum(fa[j : j + S.HEX_DIGITS] == fb[j : j + S.HEX_DIGITS] for j in range(0, len(fa), S.HEX_DIGITS)) / count
    assert abs(found - sum((x & y).values()) / sum((x | y).values())) < 0.08


def test_likeness_of_long_texts(spark):
    """Half of each text are 100 words that both share, half are words that stand once: 1/3 at any length."""
    rows = []
    for k, n in enumerate((2_000, 20_000, 100_000)):
        shared = [f"s{k}_{i % 100}" for i in range(n // 2)]
        rows.append((k, *(" ".join(shared + [f"{side}{k}_{i}" for i in range(n // 2)]) for side in "ab")))
    df, count = spark.createDataFrame(rows, "k int, a string, b string").repartition(3), 512
    one, two = (S.fingerprints(df, ["k"], c, count).withColumnRenamed("fingerprint", f"f{c}") for c in "ab")
    got = {r.k: (r.fa, r.fb) for r in one.join(two, "k").collect()}
    for k, a, b in rows:
        x, y = collections.Counter(a.split()), collections.Counter(b.split())
        want = sum((x & y).values()) / sum((x | y).values())
        fa, fb = got[k]
        found = sum(fa[j : j + S.HEX_DIGITS] == fb[j : j + S.HEX_DIGITS] for j in range(0, len(fa), S.HEX_DIGITS)) / count
        assert abs(found - want) < 0.08, (k, found, want)


def test_fingerprints_of_nothing(no_docs):
    assert S.compare_with_edits(no_docs).count() == 0


# --- toxicity ---------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(docs, labels)
    rows = X.toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(X.remainder("doc_id") == X.HELD_OUT).collect()
    hit = sum(r.score >= X.THRESHOLD and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.score >= X.THRESHOLD for r in rows) > 0.6
    told = model.decide(["idiot", "idioot", "id-iot", "stupiid", "the", "and"])
    assert min(told[:4]) > max(told[4:]), "gapped and inserted characters stay close to an insult"
    # The score itself: near forms of learnt insults pass the threshold, look-alikes and plain texts do not.
    assert hit / sum(r.toxic for r in rows) >= 0.93 and hit / sum(r.score >= X.THRESHOLD for r in rows) >= 0.83
    for insult in ("you idiot", "you stupid", "you idioot", "you stupiid", "you id-iot", "you idiooot", "you st upid thing", "you s-t-u-p-i-d", "i d i o t", "that is patthetic.", "a lo ser he is", "such tr-ash"):
        assert model.score(insult) >= X.THRESHOLD, insult
    for fine in ("", "the", "you patriot", "a studio there", "this idiom", "and of the", "the clothes", "path and aesthetic"):
        assert model.score(fine) < X.THRESHOLD, fine
    # Scores over the table are those of single texts.
    some = {r.doc_id: r.text for r in docs.where("doc_id % 500 = 3").collect()}
    assert all(r.score == pytest.approx(model.score(some[r.doc_id] or "")) for r in X.toxicity(docs, model).where("doc_id % 500 = 3").collect())


def plain_kernel(a, b):
    """Shared three-character subsequences, each occurrence weighted by its span, one by one."""
    import itertools

    def weights(word):
        out = collections.Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < X.SPAN:
                out[word[i], word[j], word[k]] += X.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q[t] for t, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_is_the_subsequence_kernel():
    words, marks = ["idiot", "idioot", "xidiot", "stupid", "banana", "abcabcabc", "zzz"], ["idiot", "stupid", "bananas", "aaa"]
    got = X.Landmarks(marks).kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(plain_kernel(w, m), abs=1e-9)
    # The machine's function of a string is what its weights of subsequences say.
    model = X.train(["idiot", "stupid", "moron"], ["banana", "window", "garden"])
    values = X.Landmarks(["idiot", "banana"])
    assert values.spread(__import__("numpy").array([1.0, 0.0]))[values.numbers].sum() > 0 and model.decide(["idioot"])[0] > model.decide(["gardens"])[0]


def test_machine_learns_from_sentences(spark):
    """Insults in noisy toxic texts among clean sentences; one that clean texts hold now and then is learnt, too."""
    import random

    rng = random.Random(5)
    common = [f"{a}{b}{c}" for a in ("ma", "lo", "ri", "te") for b in ("nu", "sa", "pe") for c in ("da", "vo", "mi")]
    docs, labels = [], []
    for k in range(400):
        sentences = [" ".join(rng.choices(common, k=8)) for _ in range(6)]
        bad = k % 4 == 0
        if bad:
            sentences[rng.randrange(6)] += " " + rng.choice(["zwurkel", "zwurkkel", "grombuff", "grombufff"])
        docs.append((k, ". ".join(sentences)))
        labels.append((k, int(bad)))
    model = X.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {i: model.score(t) for i, t in docs}
    right = sum((scored[i] >= X.THRESHOLD) == bool(y) for i, y in labels)
    assert right >= 0.97 * len(docs) and model.score("lonuda zwurrkel manuda") > X.THRESHOLD > model.score("lonuda pe manuda")


def test_toxicity_edge_cases(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(docs, none)
    assert {r.score for r in X.toxicity(docs, model).collect()} and all(r.score < 0.3 for r in X.toxicity(docs, model).collect())
    assert X.toxicity(no_docs, model).count() == 0
    assert X.strings_of("") == set() and "idiot" in X.strings_of("you i d i o t!")
    assert X.readings("id-iioot") == ("idiioot", "idiot") and X.strings_of("st upid", {"stupid"}) == {"upid", "stupid"} and X.strings_of("st upid") == {"upid"}


# --- language ---------------------------------------------------------------------


def test_no_language_is_lost(spark):
    """A language of one text in many copies, one of a single short text, and a common one: all are known, with all texts or as many as asked for."""
    rows = [("the same english text in every copy", "en")] * 400 + [(f"ein deutscher text mit der nummer {k}", "de") for k in range(3000)] + [("un seul texte", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    for most in (1, 2, 20):
        assert L.train_text_model(df, rows=most)[0] == ["de", "en", "fr"]
        assert L.train_text_model(df.where("lang <> 'de'"), rows=most)[0] == ["en", "fr"]


def test_language(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    langs, model = L.train_text_model(docs)
    rows = L.identify(pages, langs, model).collect()
    assert len(rows) == pages.count() and sum(r.lang == r.declared for r in rows) > 0.97 * len(rows)


def test_language_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model = L.train_text_model(docs)
    german = docs.where("lang = 'de'").first().text
    pages = [(k, f"http://a.example.de/{k}", f"<html lang='de'><p>{german}</p></html>") for k in range(8)]
    pages += [(20, "http://a.example.de/x", ""), (21, None, None), (None, "odd", "<p></p>"), (22, "http://a.example.de/x", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in L.identify(df, langs, model).collect()}
    assert len(got) == 12 and got[20].lang == got[22].lang == "de", "a page without text follows its host"
    assert got[0].lang == "de" and got[0].host == "a.example.de" and got[21].host == ""
    assert L.identify(df.where("false"), langs, model).count() == 0
    assert L.identify(df, [], model).where("lang is not null").count() == 0


def fused(pages, langs, model):
    """The fusion in plain Python: (lang, confidence) of each page, from its address, declared language and visible text."""
    import numpy as np

    n = len(langs)
    logs, post = [], []
    for url, declared, text in pages:
        places = L.grams(text.lower().encode())
        v = np.array([sum(float(model[k][p]) for p in places) for k in range(n)]) if text.strip() else np.zeros(n)
        v = v * min(1.0, L.MOST_EVIDENCE / len(places))
        v -= v.max()
        logs.append(v)
        post.append(np.exp(v) / np.exp(v).sum())
    hosts = [(url.split("//")[1].split("/")[0] if "//" in url else "") for url, _, _ in pages]
    domains, suffixes = [".".join(h.split(".")[-2:]) for h in hosts], [h.split(".")[-1] for h in hosts]
    total = (sum(post) + L.SMOOTH) / (sum(map(sum, post)) + L.SMOOTH * n)

    def given(kinds):
        by = {k: sum(p for p, x in zip(post, kinds) if x == k) for k in set(kinds)}
        return [(by[k] + L.SMOOTH) / (sum(by.values()) + L.SMOOTH * len(by)) for k in kinds]

    said, ends, out = given([d for _, d, _ in pages]), given(suffixes), []
    for i in range(len(pages)):
        others = lambda names: np.maximum(sum((post[j] for j in range(len(pages)) if names[j] == names[i]), np.zeros(n)) - post[i], 0)
        domain = (others(domains) + L.DOMAIN_WEIGHT * total) / (others(domains).sum() + L.DOMAIN_WEIGHT)
        host = (others(hosts) + L.HOST_WEIGHT * domain) / (others(hosts).sum() + L.HOST_WEIGHT)
        q = logs[i] + np.log(said[i]) + np.log(ends[i]) + np.log(host)
        q = np.exp(q - q.max())
        out.append((langs[int(q.argmax())], q.max() / q.sum()))
    return out


def test_language_is_fused_as_stated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, model = L.train_text_model(docs)
    words = {r.lang: r.text.split() for r in docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    pages = []
    for k in range(60):
        true, size = langs[k % len(langs)], (0, 1, 2, 4, 30)[k % 5]
        declared = ("", true, langs[(k + 1) % len(langs)])[k % 3]
        text = "".join(f" {w}" for w in words[true][k : k + size] if "<" not in w and ">" not in w)
        pages.append((f"http://{'abc'[k % 3]}.site{k % 4}.{'de' if k % 7 else 'com'}/{k}", declared, text))
    html = [f"<html data-lang='xx'{f' lang={d}' if d else ''}><script>var x = 1</script><p>{t}</p><style>p {{}}" for _, d, t in pages]
    df = spark.createDataFrame([(k, u, h) for k, ((u, _, _), h) in enumerate(zip(pages, html))], "page_id long, url string, html string")
    visible = {k: r.v for k, r in enumerate(df.orderBy("page_id").select(L.visible_text(F.col("html")).alias("v")).collect())}
    assert all("var x" not in v and "{" not in v for v in visible.values()), "scripts, and a style that is not closed, are no text"
    want = fused([(u, d, visible[k]) for k, (u, d, _) in enumerate(pages)], langs, model)
    got = {r.page_id: r for r in L.identify(df, langs, model).collect()}
    assert len({lang for lang, _ in want}) > 1
    for k, (lang, sure) in enumerate(want):
        assert got[k].declared == pages[k][1] and got[k].lang == lang and got[k].confidence == pytest.approx(sure, rel=1e-4)


def test_text_model_with_many_partitions(spark):
    """What comes to the driver is one table a language, whatever the number of partitions; rare languages are there."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    docs = docs.unionByName(spark.createDataFrame([("quam multa verba latina", "la")], "text string, lang string"))
    few = L.train_text_model(docs, rows=50)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "500")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        many = L.train_text_model(docs, rows=50)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "la" in few[0] and few[0] == many[0] and (few[1] == many[1]).all()
