"""Listings, sets, item lookup, senses and failure windows: nulls, ties, empty tables and clashing names."""

import datetime as dt
import json
import random

from lessonloom.functions.text import register_functions
from lessonloom.operators import lexical as L
from lessonloom.operators import practice as P
from lessonloom.operators import tables as O
from lessonloom.sources import readers as S


def test_composed_form_in_sql(spark):
    register_functions(spark)
    got = spark.createDataFrame([("e\u0301",), ("plain",), (None,)], "x string").selectExpr("nfc(x) as y").collect()
    assert [r.y for r in got] == ["\u00e9", "plain", None]


def test_load_in_a_total_order(spark, tmp_path):
    spark.createDataFrame([(k * 7 % 50, k % 3, k) for k in range(50)], "id long, part long, more long").repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    got = [tuple(r) for r in S.load(spark, str(tmp_path), "t", ["part", "id"], ["part", "id"]).collect()]
    assert got == sorted((k % 3, k * 7 % 50) for k in range(50))
    assert S.load(spark, str(tmp_path), "t", ["more"], ["id"]).columns == ["more"]


def test_listing_is_total(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, "b")], "id long, grade string")
    assert [r.id for r in O.ordered_listing(df, ["grade"]).collect()] == [2, 1, 3, 4]


def test_ordered_ids_and_json(spark):
    df = spark.createDataFrame([(1, 2, 9), (1, 1, 8), (1, 1, 7), (2, 1, None), (None, 1, 5)], "exam_id long, position long, passage_id long")
    assert {r.exam_id: r.ids for r in O.ordered_ids(df, "exam_id", "position", "passage_id").collect()} == {1: [7, 8, 9], 2: [None], None: [5]}
    got = {r.exam_id: json.loads(r["items"]) for r in O.ordered_json(df, ["exam_id"], "position", ["passage_id"]).collect()}
    assert got == {1: [{"passage_id": 7}, {"passage_id": 8}, {"passage_id": 9}], 2: [{"passage_id": None}], None: [{"passage_id": 5}]}
    assert O.ordered_ids(df.where("false"), "exam_id", "position", "passage_id").count() == 0


def test_unions(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "student_id long, only_a string")
    b = spark.createDataFrame([("y", 1), ("z", None)], "only_b string, student_id long")
    assert sorted((r.student_id or 0) for r in O.activity_union(a, b, b).collect()) == [0, 0, 1, 1, 1, 1]
    assert sorted((r.student_id or 0) for r in O.members_union_distinct(a, b, ["student_id"]).collect()) == [0, 1]


def test_attach_item(spark):
    attempts = spark.createDataFrame([(1, 5, 50, "a"), (2, 6, 50, "b"), (3, None, 50, "c"), (4, 5, None, "d"), (1, 5, 50, "a")], "id long, passage_id long, sentence_id long, text string")
    items = spark.createDataFrame([(5, 50, "sentence:50", "the text")], "passage_id long, sentence_id long, item_key string, text string")
    got = sorted((r.id, r.orderable, r.item_key, r.text) for r in P.attach_item(attempts, items).collect())
    assert got == [(1, True, "sentence:50", "a"), (1, True, "sentence:50", "a"), (2, False, None, "b"), (3, False, None, "c"), (4, False, None, "d")]
    assert P.attach_item(attempts, items.where("false")).where("orderable").count() == 0


def test_saved_word_senses(spark):
    rows = [(1, "Run", "to go ", 2, "late"), (1, "Run", "to  go", 1, "first"), (1, "Run", "to go", None, "never"), (1, "Run", " ", 1, "blank"), (1, "Run", None, 1, "null"), (2, "Run", "to go", None, None)]
    saved = spark.createDataFrame(rows, "student_id long, word string, meaning string, id long, first string")
    got = sorted((r.student_id, r.id, r.first) for r in L.saved_word_senses(saved, ["student_id", "word"], ["id"]).select("student_id", "id", "first").collect())
    assert got == [(1, 1, "first"), (2, None, None)]
    assert L.saved_word_senses(saved.where("false"), ["student_id", "word"], ["id"]).count() == 0


def test_summary_of_one_workbook(spark):
    at = dt.datetime(2024, 1, 2)
    students = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    attempts = spark.createDataFrame([(1, 1, True, at, "w1"), (1, 2, False, at, "w2"), (1, 1, True, at, None)], "student_id long, stage int, correct boolean, created_at timestamp_ntz, workbook_key string")
    one = {r.student_id: (r.total_1, r.total_2, r.last_activity) for r in O.learning_progress(students, attempts, "2024-01-01", "w1").collect()}
    assert one == {1: (1, 0, at), 2: (0, 0, None)}
    assert {r.student_id: r.total_1 + r.total_2 for r in O.learning_progress(students, attempts, "2024-01-01").collect()} == {1: 3, 2: 0}


def test_failures_of_a_window_are_not_a_history(spark):
    """Equal to a plain count, at the edges of cells too; the groups of the window are cells, not identifiers."""
    rng, minute = random.Random(5), 60_000_000
    rows = [(k, rng.choice("aab"), rng.choice([0, 15, 30, 7, 14, 29, 61]) * minute + rng.choice([0, 0, 1, -1]) + 10**15 // (15 * minute) * 15 * minute, rng.random() < 0.3) for k in range(400)]
    log = spark.createDataFrame(rows, "id long, identifier string, us long, successful boolean").selectExpr("id", "identifier", "timestamp_micros(us) as created_at", "successful")
    want = {k: sum(1 for _, j, t, ok in rows if j == i and not ok and at - 15 * minute <= t < at) for k, i, at, _ in rows}
    got = O.failed_login_window(log, limit=3)
    assert {r.id: r.failures for r in got.collect()} == want
    assert all(r.locked == (want[r.id] >= 3) for r in got.collect())
    nulls = spark.createDataFrame([(1, "a", None, False), (2, "a", None, True), (3, None, None, False)], "id long, identifier string, created_at timestamp, successful boolean")
    assert sorted(r.id for r in O.failed_login_window(nulls, limit=3).collect()) == [1, 2, 3]
