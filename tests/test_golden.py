"""Golden values of the domain: tokens, grading, runs, cycles, editor rows, periods."""

import collections
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lessonloom.functions import text as T
from lessonloom.operators import content as K
from lessonloom.operators import practice as P
from lessonloom.sources import readers as S

SHORT, LONG = " ".join(f"w{i}" for i in range(1, 6)), " ".join(f"w{i}" for i in range(1, 13))


def test_tokens(spark):
    rows = spark.createDataFrame([("It's 10,000 won, isn't it?",), ("About 1.5% of CO₂ — not 15.",), (None,), ("😀 hi",)], "t string")
    got = [r.w for r in rows.select(T.sentence_words(F.col("t")).alias("w")).collect()]
    assert got == [["It's", "10,000", "won", "isn't", "it"], ["About", "1.5%", "of", "CO₂", "not", "15"], [], ["hi"]]


def test_nfc(spark):
    rows = spark.createDataFrame([("CAFÉ  x",), ("plain",), (None,)], "t string")
    assert [r.n for r in rows.select(T.normalize_token(F.col("t")).alias("n")).collect()] == ["café x", "plain", ""]


def test_grading(spark):
    cases = [
        (SHORT, 1, SHORT, 0, 0, None, True), (SHORT, 1, SHORT, 2, 0, None, False), (SHORT, 1, SHORT, 1, 1, "step1_never_restarts", None),
        (SHORT, 2, SHORT, 1, 0, "step2_counts_inconsistent", None), (SHORT, 2, SHORT, 2, 2, None, False), (LONG, 2, LONG, 1, 0, None, True),
        (LONG, 2, LONG, 3, 1, None, False), (LONG, 2, LONG, 4, 1, "step2_counts_inconsistent", None), (SHORT, 3, SHORT, 0, 0, "unknown_step", None),
        (SHORT, 1, SHORT, -1, 0, "invalid_counter", None), (SHORT, 1, "w2 w1 w3 w4 w5", 0, 0, "incomplete_sentence", None),
    ]
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "id int, text string, step int, arranged string, mistakes int, restarts int")
    got = {r.id: (r.reason, r.correct) for r in P.grade_attempts(rows).collect()}
    assert got == {k: c[5:] for k, c in enumerate(cases)}


def test_grading_composes(spark):
    """A composed and a decomposed answer are the same sentence."""
    rows = spark.createDataFrame([(0, "Café au lait", 1, "Cafe\u0301 au lait", 0, 0), (1, "Cafe\u0301 au lait", 1, "café  au\u00a0lait ", 0, 0), (2, "Café au lait", 1, "Cafe au lait", 0, 0)], "id int, text string, step int, arranged string, mistakes int, restarts int")
    assert {r.id: r.reason for r in P.grade_attempts(rows).collect()} == {0: None, 1: None, 2: "incomplete_sentence"}


def test_json_keeps_types(spark):
    doc = '{"n":1,"o":{"k":[1,2]},"b":true,"z":null}'
    rows = spark.createDataFrame([(doc,)], "d string")
    d = F.col("d")
    got = rows.select(T.json_merge(d, F.lit('{"s":"x"}')).alias("m"), T.json_put(d, ["o", "v"], F.lit("2.5")).alias("p"), T.json_put(d, ["n", "v"], F.lit("2")).alias("q"), T.json_set(d, "z", F.lit('a "b"')).alias("s")).first()
    assert json.loads(got.m) == {**json.loads(doc), "s": "x"} and json.loads(got.p)["o"] == {"k": [1, 2], "v": 2.5}
    assert got.q == doc and json.loads(got.s)["z"] == 'a "b"'


def test_fold_of_a_hot_key_in_many_batches(spark):
    """A key of more rows than an Arrow batch, beside small ones."""
    taps = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("session_id"), (F.col("id") * 60_000_000).alias("at_us"), F.lit(None).cast("long").alias("started_us"))
    got = collections.Counter(r.session_id for r in P.thin_touches(taps, minutes=5).collect())
    want = collections.Counter()
    last = {}
    for i in range(30_000):
        k = i % 7 if i % 10 == 0 else -1
        if k not in last or i > last[k] + 5:
            last[k] = i
            want[k] += 1
    assert got == want


def attempts(spark, items, sizes):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, 1, 1, 1, i, True, n, at + dt.timedelta(seconds=k)) for k, (i, n) in enumerate(zip(items, sizes))]
    return spark.createDataFrame(rows, "id long, student_id long, passage_id long, stage int, item_key string, correct boolean, stage_item_count int, created_at timestamp_ntz")


def test_cycles(spark):
    got = P.cycle_progress(attempts(spark, "aabab" + "b", [2] * 6)).first()
    assert (got.completed, got.clears, got.correct_clears) == (2, ["b"], 5)


def test_stuck_cycle_is_closed_by_active_items(spark):
    # Two of three are cleared, the third is removed, the next clear repeats one of them.
    log = attempts(spark, "aba", [3, 3, 2])
    keys = log.select(*P.STEP_KEY).distinct().withColumn("active_items", F.array(F.lit("a"), F.lit("b")))
    assert P.cycle_progress(log, P.STEP_KEY).first().completed == 0
    assert P.cycle_progress(log, P.STEP_KEY, active=keys).first().completed == 1


def test_taps(spark):
    taps = spark.createDataFrame([(1, k, c) for k, c in enumerate([3, 1, 2, 0, 4])], "run_id long, seq int, chip int")
    words = spark.createDataFrame([(1, "the cat saw the dog".split())], "run_id long, words array<string>")
    got = P.replay_taps(taps, words, step=2).first()
    assert (got.placed, got.mistakes, got.completed, got.clean) == (5, 0, True, True)


@pytest.mark.parametrize("n,restarts", [(11, 1), (12, 0), (13, 0), (20, 0)])
def test_first_slip(spark, n, restarts):
    taps = spark.createDataFrame([(1, 0, 5)], "run_id long, seq int, chip int")
    words = spark.createDataFrame([(1, [f"w{i}" for i in range(n)])], "run_id long, words array<string>")
    assert P.replay_taps(taps, words, step=2).first().restarts == restarts


def test_editor_rows(spark):
    texts = spark.createDataFrame([(1, "One two.\t하나 둘\n\nThree four.\t셋 넷"), (2, "no tab here"), (3, ""), (4, "a\tb\tc"), (5, None)], "k int, s string")
    rows, errors = S.parse_sentence_rows(texts, "k", "s")
    assert sorted((r.k, r.line, r.text, r.translation) for r in rows.collect()) == [(1, 1, "One two.", "하나 둘"), (1, 3, "Three four.", "셋 넷")]
    assert sorted((r.k, r.line) for r in errors.collect()) == [(2, 1), (3, 0), (4, 1), (5, 0)]


def test_editor_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("One two.\t하나\n\nbad line\n")
    (tmp_path / "b.tsv").write_text("Three four.\t둘\r\n")
    rows, errors = S.read_sentence_rows(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in rows.collect()) == [("a.tsv", 1, "One two."), ("b.tsv", 1, "Three four.")]
    assert [(r.file.rsplit("/", 1)[1], r.line) for r in errors.collect()] == [("a.tsv", 3)]


def test_matching_and_structure(spark):
    previous = spark.createDataFrame([(1, 0, "a", "Alpha one."), (1, 1, "b", "Beta\ntwo.")], "passage_id int, position int, id string, text string")
    following = spark.createDataFrame([(1, 0, "New row."), (1, 1, "Alpha one."), (1, 2, "Else.")], "passage_id int, position int, text string")
    assert [r.matched_id for r in K.match_editor_rows(previous, following).orderBy("position").collect()] == [None, "a", None]
    current = spark.createDataFrame([(1, 0, "T", "TITLE", 0), (1, 1, "s1", "SENTENCE", 0), (1, 2, "S", "SUBTITLE", 1), (1, 3, "s2", "SENTENCE", 1), (1, 4, "s3", "SENTENCE", 1)], "passage_id int, sentence_index int, id string, block_type string, paragraph_index int")
    edit = spark.createDataFrame([(1, 0, "s1"), (1, 1, None), (1, 2, "s2"), (1, 3, "s3")], "passage_id int, position int, id string")
    got = [(r.id, r.paragraph_index) for r in K.merge_structure(current, edit).orderBy("place").collect()]
    assert got == [("T", 0), ("s1", 0), (None, 0), ("S", 1), ("s2", 1), ("s3", 1)]


def test_periods(spark):
    def start(period, iso):
        now = int(dt.datetime.fromisoformat(iso).timestamp())
        s = spark.range(1).select(T.period_start(F.lit(period), F.lit(now)).alias("s")).first().s
        return dt.datetime.fromtimestamp(s, dt.timezone.utc).isoformat()

    assert start("today", "2026-10-31T01:30+09:00") == start("today", "2026-10-31T23:59+09:00") == "2026-10-30T15:00:00+00:00"
    assert start("7d", "2026-10-31T10:00+09:00") == start("odd", "2026-10-31T10:00+09:00") == "2026-10-23T15:00:00+00:00"


def test_chip_bank_is_never_the_sentence(spark):
    items = spark.createDataFrame([(k, ["x"] * n) for k, n in enumerate([1, 2, 2, 2, 3, 3, 9])], "id int, words array<string>")
    for r in P.chip_bank(items, 1).collect():
        assert sorted(r.bank) == list(range(len(r.words)))
        assert len(r.words) == 1 or r.bank != sorted(r.bank)


def test_validation_splits(spark):
    from lessonloom.operators import rules as R

    rows = spark.createDataFrame([(1, "Ann", "S", "G", "123456"), (2, " ", "S", "G", "12"), (3, None, None, None, None)], "id int, name string, school string, grade string, code string").withColumn("fingerprint", F.sha2("code", 256))
    good, bad = R.split_valid(rows, R.student_rules())
    assert [r.id for r in good.collect()] == [1]
    assert [r.violations for r in bad.collect()] == [["name", "code"], ["name", "school", "grade", "code", "fingerprint"]]


def test_admin_listings_are_in_order(spark):
    from lessonloom.operators import tables as O
    from lessonloom.plans.frames import Frames

    f = Frames(spark, "/root/testdata/sf0.001")
    keys = {"students": ("school", "grade", "name", "id"), "exams": ("school", "grade"), "passages": ("display_order", "id"), "links": ("position", "exam_id", "passage_id")}
    for name, df in O.admin_listings(f.students, f.current_exams, f.graded_passages, f.links).items():
        got = [tuple(r[k] for k in keys[name]) for r in df.collect()]
        assert got and got == sorted(got)


def test_global_rank(spark):
    from lessonloom.operators import tables as O

    df = spark.createDataFrame([(k * k % 1009,) for k in range(1, 500) if k * k % 1009], "id long").distinct().repartition(5)
    ids = sorted(r.id for r in df.collect())
    assert {r.id: r["rank"] for r in O.global_rank(df, "id", "rank", cells=7).collect()} == {i: k for k, i in enumerate(ids)}
    assert O.global_rank(df.where("false"), "id", "rank").count() == 0


def test_jdbc_is_read_in_parallel(spark):
    url, driver = "jdbc:derby:memory:lessons;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1, 1001).select("id", (F.col("id") * 2).alias("twice"))
    rows.write.format("jdbc").options(url=url, dbtable="tries", driver=driver).mode("overwrite").save()
    got = S.load_jdbc(spark, url, "tries", "id", 1, 1000, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted((r.ID if "ID" in got.columns else r.id) for r in got.collect()) == list(range(1, 1001))


def test_append_log(spark, tmp_path):
    log = attempts(spark, "ab", [2, 2])
    S.append_log(log.where("id = 0"), f"{tmp_path}/log")
    before = spark.read.parquet(f"{tmp_path}/log")
    kept = before.collect()
    S.append_log(log.where("id = 1"), f"{tmp_path}/log")
    after = spark.read.parquet(f"{tmp_path}/log")
    assert after.count() == 2 and S.audit_append_only(spark.createDataFrame(kept, log.schema), after, ["id"]).count() == 0
    assert [r.change for r in S.audit_append_only(after, after.where("id = 1"), ["id"]).collect()] == ["missing"]


def test_changes_of_one_new_key(spark):
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    changes = spark.createDataFrame([(2, "y", 2), (2, "x", 1), (1, "b", 1), (None, "n", 1), (None, "m", 2)], "id int, v string, n int")
    assert sorted(map(tuple, S.upsert(base, changes, ["id"], ["v"], order=["n"]).collect()), key=str) == [(1, "b"), (2, "x"), (None, "m"), (None, "n")]
    assert sorted(map(tuple, S.upsert(base, changes, ["id"], order=["n"]).where("id is not null").collect())) == [(1, "a"), (2, "x")]


def test_lookups_and_migrations_golden(spark):
    from lessonloom.operators import tables as O

    events = spark.createDataFrame([(1, "w", "m1", True, "initial", 1, 1), (1, "w", "m2", False, "retry", 2, 2)], "student_id int, word string, meaning string, resolved boolean, reason string, created_at int, id int")
    got = O.latest_resolved(events, ["student_id", "word"], ["meaning"]).first()
    assert (got.meaning, got.initial_lookups, got.retry_lookups) == ("m1", 1, 1)
    states = spark.createDataFrame([(1, 2, "w", False, 5, 1), (1, 3, "w", True, 4, 2)], "student_id int, passage_id int, word string, known boolean, updated_at int, created_at int")
    mapping = spark.createDataFrame([(3, 2)], "old int, keeper int")
    assert tuple(O.merge_word_states(states, mapping).first()) == (1, 2, "w", True, 5, 1)


def plain_lockout(tries, limits, minutes):
    """Every try in its order, with all recorded failures of its two identifiers."""
    failed, blocked = collections.defaultdict(list), {}
    for at, i, fine, admin, code, client in sorted((t["at_us"], t["id"], t["successful"], t["admin"], t["code"], t["client"]) for t in tries):
        checks = [("admin_client", client), ("admin", "")] if admin else [("student_client", client), ("code", code)]
        for kind, who in checks:
            if sum(x >= at - minutes * 60_000_000 for x in failed[kind, who]) >= limits[kind]:
                blocked[i] = kind
                break
        else:
            for c in [] if fine else checks:
                failed[c].append(at)
    return blocked


def tries_of(spark, tries):
    return spark.createDataFrame(tries, "id long, at_us long, successful boolean, admin boolean, code string, client string").repartition(4)


def test_lockout_without_realms(spark):
    """Identifiers meet across the whole table; a hot client has a third of all tries, day and night."""
    import random

    deal, minute, tries = random.Random(4), 60_000_000, []
    for i in range(6000):
        hot = i % 3 == 0
        at = deal.randrange(30 * 24 * 60) * minute + deal.choice([0, 1, minute // 2])
        if hot and deal.random() < 0.8:  # bursts of an hour on some days
            at = (deal.randrange(30) * 24 + 9) * 60 * minute + deal.randrange(60) * minute
        tries.append({"id": i, "at_us": at, "successful": deal.random() < 0.3, "admin": i % 17 == 0, "code": f"c{deal.randrange(400)}" if deal.random() < 0.7 else None, "client": "hot" if hot else f"ip{deal.randrange(200)}"})
    for limits in ({"code": 5, "student_client": 30, "admin_client": 5, "admin": 50}, {"code": 2, "student_client": 4, "admin_client": 2, "admin": 3}):
        want = plain_lockout(tries, limits, 15)
        assert {r.id: r.blocked_by for r in P.login_lockout(tries_of(spark, tries), limits, 15).collect()} == want and len(want) > 20
        sizes = sorted(r["count"] for r in P.lockout_pieces(tries_of(spark, tries), limits, 15).groupBy("piece").count().collect())
        assert sizes[-1] < len(tries) / 15


def test_lockout_goes_on_from_recorded_failures(spark):
    tries = [{"id": k, "at_us": k * 60_000_000, "successful": k % 11 == 10, "admin": False, "code": f"c{k % 3}", "client": f"ip{k % 2}"} for k in range(200)]
    limits = {"code": 3, "student_client": 4, "admin_client": 2, "admin": 3}
    want, early = plain_lockout(tries, limits, 15), [t for t in tries if t["id"] < 101]
    done = {r.id for r in P.login_lockout(tries_of(spark, early), limits, 15).collect()}
    failed = tries_of(spark, [t for t in early if not t["successful"] and t["id"] not in done]).drop("successful")
    late = P.login_lockout(tries_of(spark, tries[101:]), limits, 15, recorded=failed.withColumn("successful", F.lit(False)))
    assert done | {r.id for r in late.collect()} == set(want) and want
