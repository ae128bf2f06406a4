"""Lexical documents: parsed once, tokens found beside their concepts, odd ones by a join."""

import json

from lessonloom.functions import session
from lessonloom.operators import lexical as L
from lessonloom.plans.compositions import lexical
from lessonloom.plans.frames import Frames


def test_tokens_beside_concepts(spark):
    c = lambda key, occurrence, *at: {"key": key, "occurrence": occurrence, "tokenIndexes": list(at)}
    documents = {
        1: [{"id": 11, "tokens": ["a", "b", None], "concepts": [c("k", "o1", 1, 0), c("l", "o2", 3), c("m", "o3", -1, 2), c("n", "o4", None, 1), {"key": "p", "occurrence": "o5"}]}, {"id": 12, "tokens": None, "concepts": [c("k", "o1", 0)]}, {"id": 13, "tokens": ["x"]}],
        2: [{"id": 21, "tokens": ["a"], "concepts": [c("k", "o1", 0)]}, {"id": 21, "tokens": ["b", "c"], "concepts": [c("k", "o2", 1)]}],
        3: [{"id": 31, "tokens": ["a", "b"], "concepts": [c("k", "o1", 0), c("l", "o1", 1), c("m", None, 0)]}, {"id": 32, "tokens": ["z"], "concepts": [c("q", "o1", 0)]}],
        4: [{"id": 11, "tokens": ["a"], "concepts": []}],
        5: 7,
        6: [],
    }
    df = spark.createDataFrame([(k, json.dumps({"sentences": v})) for k, v in documents.items()], "passage_id long, document string")
    stored = spark.createDataFrame([(i, i // 10) for i in (11, 12, 13, 21, 31, 32)], "id long, passage_id long")
    sentences, errors = L.read_lexical(df, "document", stored)
    assert sorted(map(tuple, errors.collect())) == [(4, "foreign_sentence"), (5, "no_sentences")]
    assert {r.sentence_id for r in sentences.where("plain").collect()} == {11, 12, 13, 32}
    joined = L.map_token_indexes(L.concepts_of(sentences), L.tokens_of(sentences))
    want = sorted(map(tuple, joined.collect()), key=repr)
    assert sorted(map(tuple, L.map_sentences(sentences).select(*joined.columns).collect()), key=repr) == want and len(want) == 12
    tokens, concepts, _ = L.explode_lexical(df, "document", stored)
    for rows in (tokens, concepts):  # documents are not parsed anew for each table
        assert "from_json" not in rows._jdf.queryExecution().toString()


def loaded(spark):
    """Tables after a load: a passage with old occurrences, one without, one of repeated keys, one with a token that is not there, one without a list, one that is not loaded, one without an id."""
    c = lambda key, occurrence, *at: {"key": key, "occurrence": occurrence, "tokenIndexes": list(at)}
    documents = {
        1: [{"id": 11, "tokens": ["a", "b"], "concepts": [c("k", "o1", 0), c("l", "o2", 1)]}],
        2: [{"id": 21, "tokens": ["d"], "concepts": [c("k", "o1", 0), c("alias", "o2", 0)]}],
        3: [{"id": 31, "tokens": ["e", "f"], "concepts": [c("x", "o1"), c("y", "o1"), c("x", "o1")]}],
        4: [{"id": 41, "tokens": ["g"], "concepts": [c("k", "o1", 9)]}],
        5: 7,
        None: [{"id": 71, "tokens": ["n"], "concepts": [c("n", "o1", 0)]}],
    }
    df = spark.createDataFrame([(k, json.dumps({"sentences": v})) for k, v in documents.items()], "passage_id long, document string")
    stored = spark.createDataFrame([(i, i // 10) for i in (11, 21, 31, 41, 51, 61)], "id long, passage_id long")
    old = [(1, 11, "o1", "old1", "f"), (4, 41, "o1", "old4", "f"), (6, 61, "o1", "old6", "f"), (9, 21, "o1", "of another passage", "f")]
    known = {
        "occurrences": spark.createDataFrame(old, "passage_id long, sentence_id long, occurrence_key string, concept_id string, forms string"),
        "concepts": spark.createDataFrame([("known", "l")], "concept_id string, concept_key string"),
        "aliases": spark.createDataFrame([("alias", "by alias")], "concept_key string, concept_id string"),
        "saved": spark.createDataFrame([(i, i // 10, i, "o1") for i in (11, 21, 31, 41, 61)] + [(12, 1, 11, "gone")], "saved_id long, passage_id long, sentence_id long, occurrence_key string"),
        "tokens": spark.createDataFrame([(i // 10, i, 0, "old") for i in (11, 21, 31, 41, 51, 61)], "passage_id long, sentence_id long, token_index int, form string"),
    }
    return L.load_lexical(df, "document", stored, known)


def test_load_deals_few_rows(spark, monkeypatch):
    """Tokens stay where they are, and what is loaded is the same where ids are too many to be broadcast."""
    few = spark.newSession()
    few.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = loaded(few)
    assert "Exchange hashpartitioning" not in got["tokens"]._jdf.queryExecution().executedPlan().toString()
    rows = lambda name: sorted(map(tuple, got[name].collect()), key=repr)
    assert rows("tokens") == [(1, 11, 0, "a"), (1, 11, 1, "b"), (2, 21, 0, "d"), (3, 31, 0, "e"), (3, 31, 1, "f"), (4, 41, 0, "old"), (5, 51, 0, "old"), (6, 61, 0, "old")]
    made = {k: r[0] for k in "kxy" for r in [spark.sql(f"select sha2('{k}', 256)").first()]}
    new = [(1, 11, "o1", "old1", "a"), (1, 11, "o2", "known", "b"), (2, 21, "o1", made["k"], "d"), (2, 21, "o2", "by alias", "d")]
    kept = [(4, 41, "o1", "old4", "f"), (6, 61, "o1", "old6", "f"), (9, 21, "o1", "of another passage", "f")]
    occurrences = rows("occurrences")
    assert occurrences == sorted([*new, *kept, *((3, 31, "o1", made[k], "") for k in "xyx")], key=repr)
    assert rows("concepts") == sorted([("known", "l"), *((v, k) for k, v in made.items())])
    # What is saved of a repeated key comes once a concept.
    assert rows("saved") == [(11, 11, "o1"), (21, 21, "o1"), (31, 31, "o1"), (31, 31, "o1"), (41, 41, "o1"), (61, 61, "o1")]
    assert rows("errors") == [(4, "token_mapping"), (5, "no_sentences"), (None, "foreign_sentence")]
    tables = {name: rows(name) for name in got}
    monkeypatch.setattr(session, "FEW_IDS", 0)
    got = loaded(few)
    assert "Exchange hashpartitioning" in got["tokens"]._jdf.queryExecution().executedPlan().toString()
    assert {name: rows(name) for name in got} == tables


def test_documents_are_made_in_place(spark):
    """The texts of a passage are those of one document, and are not dealt to be one again."""
    assert "Exchange" not in lexical(Frames(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()


def test_ids_are_compared_once_a_document(spark, monkeypatch):
    """Whether a document's ids repeat is found before its rows are made, not for each of them."""
    plans, real = [], L.once
    monkeypatch.setattr(L, "once", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    f = Frames(spark, "/root/testdata/sf0.001")
    L.read_lexical(lexical(f), "document", f.sentences.select("id", "passage_id"))
    above, below = plans[0].split("Generate explode")
    assert "array_distinct(sentences" in below and "array_distinct(sentences" not in above


def test_sql_sends_later_texts_alone_to_python(spark):
    from lessonloom.functions.text import register_functions

    register_functions(spark)
    df = spark.createDataFrame([("é" * 3,), ("café",), ("plain",), (None,), ("\U0001d15e 한",)], "x string")
    got = df.selectExpr("x", "nfc(x) as y")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "nfc_in_python(" in plan and "CASE WHEN" in plan
    assert [r.y for r in got.collect()] == ["é" * 3, "café", "plain", None, "\U0001d157\U0001d165 한"]
