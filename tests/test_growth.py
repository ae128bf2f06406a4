"""What keeps a task, or what is read and written, small on large tables."""

import random

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from lessonloom import constants as C
from lessonloom.functions import session as asked
from lessonloom.functions.session import NUMBER_KEY, SIZE_KEY
from lessonloom.operators import content as K
from lessonloom.operators import practice as P
from lessonloom.plans import QUERIES
from lessonloom.plans.frames import FRAMES, Frames
from tests.test_golden import plain_lockout, tries_of

FOLDER = "/root/testdata/sf0.001"


def test_lockout_replays_failures_alone(spark):
    """Many tries at one instant, a client under attack, and failures recorded before."""
    deal, minute = random.Random(6), 60_000_000
    tries = [{"id": i, "at_us": deal.randrange(90) * minute, "successful": deal.random() < 0.8, "admin": i % 9 == 0, "code": f"c{deal.randrange(30)}" if i % 7 else None, "client": f"ip{i % 3}"} for i in range(1500)]
    limits = {"code": 2, "student_client": 4, "admin_client": 2, "admin": 3}
    want = plain_lockout(tries, limits, 15)
    got = {r.id: r.blocked_by for r in P.login_lockout(tries_of(spark, tries), limits, 15).collect()}
    assert got == want and {t["successful"] for t in tries if t["id"] in got} == {True, False}
    assert P.lockout_pieces(tries_of(spark, tries), limits, 15).count() <= sum(not t["successful"] for t in tries)
    early = [t for t in tries if t["at_us"] < 40 * minute]
    failed = tries_of(spark, [t for t in early if not t["successful"] and t["id"] not in want]).drop("successful")
    late = P.login_lockout(tries_of(spark, [t for t in tries if t["at_us"] >= 40 * minute]), limits, 15, recorded=failed)
    assert {r.id: r.blocked_by for r in late.collect()} == {k: v for k, v in want.items() if tries[k]["at_us"] >= 40 * minute}


def test_tasks_take_few_shuffled_bytes(spark):
    """Frames bound what adaptive execution puts into a task, unless the session says it."""
    one, two = spark.newSession(), spark.newSession()
    two.conf.set(SIZE_KEY, "32m")
    for session in (one, two):
        Frames(session, FOLDER)
    assert (one.conf.get(SIZE_KEY), two.conf.get(SIZE_KEY)) == ("8m", "32m")


def test_questions_are_dealt_out(spark):
    """A small file of many questions is no single task's work."""
    plan = QUERIES["b13_withdraw"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan


def test_composed_without_pandas(spark):
    """The composed form is made of Arrow arrays, some texts at a time; workers load no pandas."""
    from lessonloom.functions import text as T

    assert T._nfc.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    df = spark.createDataFrame([("é" * 3,), ("ﬁ 한",), (None,), ("plain",), ("",)], "x string")
    assert [r[0] for r in df.select(T.nfc(F.col("x"))).collect()] == ["é" * 3, "ﬁ 한", None, "plain", ""]


def test_answers_are_split_once(spark):
    """Words are found once a text, and odd pairs of chips and answers have no places."""
    plan = QUERIES["i3_answer_indexes"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    rows = [(1, ["b", "a", "B"], ["B", "b", "a"]), (2, ["a"], ["a", "a"]), (3, ["a", "b"], ["a"]), (4, None, ["a"]), (5, ["a"], None), (6, [], []), (7, ["É", "x"], ["x", "é"])]
    df = spark.createDataFrame(rows, "id long, chips array<string>, answer array<string>")
    assert {r.id: r.indexes for r in P.answer_indexes(df, "id", "chips", "answer").collect()} == {1: [0, 2, 1], 2: [], 3: [], 4: [], 5: [], 6: [], 7: [1, 0]}


def test_words_are_judged_without_cleaning(spark):
    """Blank texts, two words and single spaces are told as the cleaned text tells them, also where it drops or trims characters."""
    from lessonloom.functions import text as T

    deal, odd = random.Random(16), list("ab.'%$ é한\t\n\u3000\xa0\ufeff\x00\u2028-") + ["\U0001f600", "\U0001d400", "\u0301", "  "]
    texts = [None, "", "x" * 150, "x" * 99 + "-y z", "x" * 99 + " y", " " * 6000 + "a b", "a" * 6000 + " b", *("".join(deal.choices(odd, k=deal.randrange(9))) for _ in range(3000)), *("a" * deal.randrange(94, 102) + "".join(deal.choices(odd, k=5)) for _ in range(500))]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(t, T.is_blank(t) == (T.clean_text(t) == ""), T.has_two_words(t) == (F.size(T.sentence_words(t)) >= 2), T.flatten_space(t) == F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), f"{C.WIDE_SPACE}+", " ")))
    assert [r[0] for r in rows.collect() if not (r[1] and r[2] and r[3])] == []


def test_refused_attempts_are_not_split(spark):
    """The words of attempts whose step or id is refused anyway are not found."""
    good = "00000000-0000-4000-8000-00000000000"
    rows = [(1, good + "1", 1, "A b"), (2, good + "2", 3, None), (3, "bad", 1, None), (4, good + "4", None, None), (5, good + "5", 2, "b A"), (6, good + "6", 1, "a\u3000B")]
    batch = spark.createDataFrame([(i, 1, 1, 1, key, step, words, 0, 0) for i, key, step, words in rows], "id long, student_id long, passage_id long, sentence_id long, client_attempt_id string, step int, given string, mistakes int, restarts int")
    batch = batch.withColumn("arranged", F.coalesce("given", F.raise_error(F.lit("split")).cast("string"))).drop("given")
    stored = spark.createDataFrame([], "student_id long, client_attempt_id string, stored_correct boolean")
    items = spark.createDataFrame([(1, 1, "A b")], "sentence_id long, passage_id long, text string")
    done = P.submit_attempts(batch, stored, batch.select("student_id", "passage_id"), items, spark.createDataFrame([(1, 3)], "passage_id long, revision long"))
    got = {r.id: (r.outcome, r.reason, r.correct, r.response and (r.response.arranged, r.response.word_count)) for r in done.collect()}
    assert got == {1: ("stored", None, True, ("A b", 2)), 2: ("rejected", "unknown_step", None, None), 3: ("rejected", "invalid_id", None, None), 4: ("rejected", "unknown_step", None, None), 5: ("rejected", "incomplete_sentence", None, None), 6: ("stored", None, True, ("a\u3000B", 2))}


def test_exchanges_begin_with_many_partitions(spark):
    """A layout's exchanges are cut finely enough for tasks of few bytes on large tables, unless the session says how many parts they have."""
    one, two = spark.newSession(), spark.newSession()
    two.conf.set(NUMBER_KEY, "7")
    for session, number in ((one, 1000), (two, 7)):
        for name in ("k4_layout", "k4_layout_errors"):
            plan = QUERIES[name](session, FOLDER)._jdf.queryExecution().executedPlan().toString()
            assert f", {number})" in plan and ", 4)" not in plan


def test_texts_to_order_stay_as_they_are(spark):
    """What can be ordered is told without its text being cleaned, and is what practice items are made of."""
    rows = [(1, " a　b ", "x", None, None), (2, "a", "x", "SENTENCE", True), (3, "a b", "﻿", "", True), (4, "a b", "x", "TITLE", True), (5, "a b\x00", "x", "sentence", True), (6, "a b", "x", "", False)]
    df = spark.createDataFrame([(i, 1, i, *r) for i, *r in rows], "id long, passage_id long, sentence_index int, text string, translation string, block_type string, active boolean")
    assert {r.id: r.text for r in P.orderable(df).collect()} == {1: " a　b ", 5: "a b\x00"}
    assert {r.id: r.text for r in P.practice_items(df).collect()} == {1: "a　b", 5: "a b"}


def test_saves_shuffle_texts_little(spark, monkeypatch):
    """Texts of rows that no save touches stay where they are; the others are dealt once. Rows are the same where passages are too many to be broadcast."""
    few = spark.newSession()
    few.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kinds = [("a", "TITLE", 0), ("b", "SENTENCE", 0), ("c", "SENTENCE", 1), ("d", "SUBTITLE", 2), ("e", "SENTENCE", 2), ("f", "SENTENCE", 3)]
    stored = [(1, i, at, f"text {i}", "x", kind, paragraph, i != "f") for at, (i, kind, paragraph) in enumerate(kinds)] + [(2, "g", 0, "text g", "x", "SENTENCE", 0, True)]
    edit = [(1, 0, "c", " C ", "x"), (1, 1, None, "N", "x"), (1, 2, "b", "B", "x"), (2, 0, "g", "G", "x")]
    ask = [(p, "title", "g", "TEXTBOOK", None, None, None, 3) for p in (1, 2)]

    def saved():
        tables = few.createDataFrame([(1, "t", "g", "", "", 3), (2, "t", "g", "", "", 4)], "id long, title string, grade string, source_label string, source_text string, revision int")
        requests = few.createDataFrame(ask, "passage_id long, title string, grade string, source_type string, source_year int, source_month int, source_label string, expected_revision int")
        rows = few.createDataFrame(edit, "passage_id long, position int, id string, text string, translation string")
        return K.save_passages(tables, few.createDataFrame(stored, ", ".join(f"{c} {t}" for c, t in zip(K.STORED_ROW, "long,string,int,string,string,string,int,boolean".split(",")))), requests, rows)

    made = spark.sql("select sha2('1:4:2', 256)").first()[0]
    want = [(1, "a", 0, "text a", "TITLE", 0, True), (1, "c", 1, "C", "SENTENCE", 1, True), (1, made, 2, "N", "SENTENCE", 1, True), (1, "b", 3, "B", "SENTENCE", 0, True), (1, "d", 4, "text d", "SUBTITLE", 2, True)]
    want += [(1, "e", 1_000_005, "text e", "SENTENCE", 2, False), (1, "f", 1_000_006, "text f", "SENTENCE", 3, False), (2, "g", 0, "text g", "SENTENCE", 0, True)]
    for most in (asked.FEW_IDS, 0):
        monkeypatch.setattr(asked, "FEW_IDS", most)
        passages, rows, outcomes = saved()
        assert sorted(map(tuple, rows.drop("translation").collect())) == sorted(want)
        assert {r.passage_id: r.outcome for r in outcomes.collect()} == {1: "saved", 2: "conflict"} and {r.id: r.source_text for r in passages.collect()} == {1: "C N B", 2: ""}
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("Exchange hashpartitioning") <= 3) == (most > 0)


def test_edited_rows_are_numbered_in_place(spark):
    """The rows of an edit are those of their SQL, without a shuffle for their places."""
    f = Frames(spark, FOLDER)
    want = f.sql(FRAMES["edited"])
    assert "Exchange" not in f.edited._jdf.queryExecution().executedPlan().toString()
    assert f.edited.dtypes == want.dtypes and want.count() > 1000
    assert f.edited.exceptAll(want).count() == want.exceptAll(f.edited).count() == 0


def test_shuffled_rows_go_once_written(spark, tmp_path):
    """What was shuffled for rows that are kept in files does not stay beside them; the session keeps its setting."""
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    for said in (None, "false"):
        conf = spark.newSession()
        if said:
            conf.conf.set(asked.CLEANUP_KEY, said)
        before = blocks()
        rows = asked.once(conf.range(1000).repartition(3, "id"))
        assert blocks() <= before and rows.count() == 1000
        assert conf.conf.getAll.get(asked.CLEANUP_KEY) == said
