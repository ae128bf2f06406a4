"""Line dedup, conversation repair and hard negatives against brute force."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from lessonloom.llm import conversation_repair as C
from lessonloom.llm import hard_negatives as H
from lessonloom.llm import line_dedup as L
from lessonloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1
BLANK = " \t\n\x0b\x0c\r"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# --- lines ------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(i, first.get(key(line), LAST))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


SHARED = "A line that many documents share\n"
LINES = [(i, SHARED * (i % 3) + f"own line number {i // 2} of it\n \t A LINE that many documents share \x0c\nÉtude ÀÉ number 1\nétude ÀÉ number 1\nshort") for i in range(30, 70)]
LINES += [(None, SHARED + "x"), (None, SHARED + "x"), (None, f"{SHARED}second text without an id"), (5, SHARED), (5, f"{SHARED}{SHARED}other text of id five"), (31, None), (32, ""), (33, "\n\n\n"), (34, "123456789\n1234567890"), (35, "123456789\n1234567890\n" * 3)]


@pytest.mark.parametrize("batches,fan", [(1, 3), (4, 2), (7, 3)])
def test_lines(spark, batches, fan):
    df = spark.createDataFrame(LINES, "doc_id long, text string").repartition(3)
    got = sorted((LAST if r.id is None else r.id, r.n_lines, r.n_dropped, r.kept) for r in L.without_repeated_lines(df, batches=batches, fan=fan).collect())
    assert got == brute_lines([(LAST if i is None else i, t) for i, t in LINES])


def test_lines_of_odd_documents(spark, docs, plain_docs, no_docs):
    got = sorted((LAST if r.id is None else r.id, r.n_lines, r.n_dropped, r.kept) for r in L.without_repeated_lines(docs).collect())
    assert got == brute_lines([(LAST if r[0] is None else r[0], r[1]) for r in plain_docs])
    assert L.without_repeated_lines(no_docs).count() == 0


def test_runs_are_levelled_and_shuffled_once(spark):
    lines = L.numbered_lines(spark.createDataFrame(LINES, "doc_id long, text string"))
    runs, seen = L.LineRuns(spark, fan=3), []
    for k in range(8):
        part = lines.where(f"pmod(id, 8) = {k}")
        runs.add(part)
        seen.append([len(x) for x in runs.levels])
    assert seen == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2], [2, 2]]
    held = functools.reduce(lambda a, b: a.unionByName(b), runs.runs())
    assert held.count() == held.select("h1", "h2").distinct().count() == lines.select("h1", "h2").distinct().count()
    plan = lines.groupBy("h1", "h2").min("id").join(runs.runs()[0].hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    runs.drop()
    assert not [t for t in spark.catalog.listTables(L.DATABASE)]


def test_runs_have_the_files_that_their_lines_ask_for(spark, monkeypatch):
    """Where the session has many partitions, few lines do not make as many files of each run, and the session keeps its numbers."""
    keys, tables, write = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"), [], L.LineRuns._write

    def counted(self, rows, level):
        write(self, rows, level)
        tables.append(len(spark.table(self.levels[level][-1]).inputFiles()))

    monkeypatch.setattr(L.LineRuns, "_write", counted)
    df = spark.createDataFrame([(k, "\n".join(f"line {k * j} of many lines" for j in range(50))) for k in range(200)], "doc_id long, text string").repartition(3)
    want = brute_lines([(r.doc_id, r.text) for r in df.collect()])
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for key, n in zip(keys, ("40", "60")):
            spark.conf.set(key, n)
        got = sorted((r.id, r.n_lines, r.n_dropped, r.kept) for r in L.without_repeated_lines(df).collect())
        assert [spark.conf.get(k) for k in keys] == ["40", "60"]
    finally:
        for key in keys:
            spark.conf.set(key, before[key]) if before[key] else spark.conf.unset(key)
    assert got == want
    assert len(tables) == 4 and max(tables) <= spark.sparkContext.defaultParallelism  # a run a batch: the third is written with the two before it
    assert L.buckets_for(spark, 10**12) == int(spark.conf.get(keys[0]))


def test_a_text_is_hashed_once_and_not_for_each_of_its_lines(spark):
    plan = L.numbered_lines(spark.createDataFrame(LINES, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and plan.index("sha2(") > plan.index("Generate ")


# --- conversations ----------------------------------------------------------------


def automaton(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def exhaustive(rows):
    """Least (cost, audit) over all edits of a few rows, with up to two inserts in each gap."""
    best = None
    for edits in itertools.product(*[["D"] if x == "-" else ["D", "K", "Ru", "Ra"] for x, _ in rows]):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k in range(len(rows) + 1):
                roles, audit, cost = roles + gaps[k], audit + "I" * len(gaps[k]), cost + 2 * len(gaps[k])
                if k < len(rows):
                    e, (x, t) = edits[k], rows[k]
                    audit += e[0]
                    cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (t and e != "D")
                    roles += {"D": "", "K": x or "x", "R": e[1:]}[e[0]]
            if automaton(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_strings(rows):
    """The same by tuples of cost and string, from the end; for longer conversations."""
    turn = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    now = {"E": (0, ""), "A": (0, "")}

    def closed(w):
        for _ in range(2):
            w = {q: min(x for x in [w.get(q), *[(w[t][0] + 2, "I" + w[t][1]) for (p, r), t in turn.items() if p == q and r != "s" and t in w]] if x) for q in "ESUA" if q in w or any(p == q and r != "s" and t in w for (p, r), t in turn.items())}
        return w

    now = closed(now)
    for x, t in reversed(rows):
        then = {}
        for q in "ESUA":
            found = [(now[q][0] + 3, "D" + now[q][1])] if q in now else []
            for (p, r), to in turn.items():
                if p == q and to in now and x != "-":
                    found += [(now[to][0] + t, "K" + now[to][1])] if r == x else []
                    found += [(now[to][0] + 2 + t, "R" + now[to][1])] if r != "s" else []
            if found:
                then[q] = min(found)
        now = closed(then)
    return now["E"]


def test_cheapest_edits():
    deal = random.Random(5)
    for _ in range(60):
        rows = [(deal.choice(["s", "u", "u", "a", "a", "", "-"]), deal.random() < 0.3) for _ in range(deal.randint(0, 3))]
        assert C.cheapest(rows) == exhaustive(rows), rows
    for n in [*range(12), 90, 700]:
        rows = [(x := deal.choice("suaua-"), x != "-" and deal.random() < 0.3) for _ in range(n)]
        assert C.cheapest(rows) == by_strings(rows)


def brute_conversations(rows):
    """Contract of op12 for rows (conv_id, turn, role, text)."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        shown = ["" if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(" " if x is None else y for x, y in zip((conv, turn), shown)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        tag = hashlib.sha256(f"{role}\0{text}".encode()).digest()[:16]
        by[conv] += [((turn is not None, turn or 0, role.encode(), tag), turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: r[0])
        turns = [t for _, t, _, _ in own if t is not None]
        count, seen, codes = collections.Counter(), set(), []
        for _, _, role, text in own:
            body = text.strip(BLANK)
            what = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            count[what] += 1
            codes.append(("-" if what in ("blank", "duplicate") else role[:1] if role[:1] in ("s", "u", "a") else "", what == "truncated"))
        initials = [r[:1] for _, _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = by_strings(codes)
        lines, at, roles = [], 0, ""
        for letter in audit:
            if letter != "I":
                _, _, role, text = own[at]
                at += 1
            turn = "assistant" if roles[-1:] == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}" if letter == "K" else f"{turn}:" if letter == "I" else f"{turn}:{text}")
                roles += lines[-1][0]
        assert automaton(roles)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(spark, folder):
    got = QUERIES["op12_conversation_repair"](spark, folder).collect()
    out = {r.conv_id: tuple(r[c] for c in FACTS) for r in got}
    assert len(out) == len(got)
    return out


def test_op12_on_the_tables(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    assert repaired(spark, FOLDER) == brute_conversations(rows)


def test_op12_on_odd_rows(spark, tmp_path):
    deal, rows = random.Random(9), []
    for conv in [None, *range(60)]:
        for _ in range(deal.randint(1, 14)):
            turn = deal.choice([None, *range(12)])
            rows.append((conv, turn, deal.choice(["system", "user", "assistant", "assistant", "user", None, "", "Übung", "uncle"]), deal.choice([None, "", " \t", "Yes.", "No!", "why", "é?\n", "so. ", "x" * 5000 + "."])))
    rows += [(77, 3, "user", "Same.")] * 4 + [(78, k, "user" if k % 2 else "system", f"Turn {k}.") for k in range(300)]
    rows += [(k, 0, "user", "All gone?") for k in range(200, 400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:2]
    extra = [r + ("x", 1) for r in rows]
    spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, dropped string, copy int").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repaired(spark, str(tmp_path))
    assert got == brute_conversations(rows)
    assert any(v[:7] == (0, 0, 0, 0, 0, 0, "") for v in got.values())


def test_repaired_rows_and_no_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 5, "assistant", "Late."), (3, 0, "system", "Be kind.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    facts = C.audits(df)
    got = sorted((r.conv_id, r.place, r.role, r.text) for r in C.repaired_rows(df, facts).collect())
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Again."), (2, 0, "user", ""), (2, 1, "assistant", "Late.")]
    assert {r.conv_id: (r.cost, r.audit) for r in facts.collect()} == {1: (2, "KR"), 2: (2, "IK"), 3: (3, "D")}
    assert C.audits(df.where("false")).count() == 0 and C.digests(C.repaired_rows(df.where("false"), facts.where("false"))).count() == 0


# --- vectors ----------------------------------------------------------------------


def test_scores_are_inner_products():
    deal = np.random.default_rng(3)
    for dims, size in ((1, 3), (8, 200), (13, 1 << 20), (64, 1 << 26), (0, 0)):
        a, b = (deal.integers(-size, size + 1, (n, dims)) for n in (7, 11))
        planes = H.planes_of(b)
        assert (H.scores(H.subset_sums(H.fit(a, len(planes))), planes) == a @ b.T).all()


def brute_negatives(rows):
    rows = list(dict.fromkeys((LAST if i is None else i, n, tuple(np.floor(256 * np.array(v, float)).astype(int).tolist())) for i, n, v in rows if n is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in rows:
        if a[0] % 100 or a[0] == LAST:
            continue
        scored = sorted((-dot(a[2], b[2]), b[0], b) for b in rows if b != a)
        for s, i, _ in [x for x in scored if x[2][1] == a[1]][:5]:
            band = [x for x in scored if x[2][1] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(band)]
    return sorted(out)


def mined(df):
    order = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(LAST if r[c] is None else r[c] for c in order) for r in H.hard_negatives(df).collect())


def test_hard_negatives(spark, monkeypatch):
    deal = random.Random(2)
    vector = lambda n=12: [deal.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(n)]
    rows = [(k, k % 3 if k % 5 else 0, vector()) for k in range(0, 900)]
    rows += [(None, 1, vector()), (None, 0, vector()), (901, None, vector()), (902, 1, None), (903, 1, [None, *vector(11)]), (904, 1, [float("nan")]), (905, 0, [float("inf"), 1.0]), (906, 0, []), (907, 1, vector(5)), (1000, 2, vector(20))]
    rows += [rows[100], rows[200], (300, 1, vector()), (400, 0, [9.0] * 12)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, key string, block int").repartition(3)
    want = brute_negatives(rows)
    assert mined(df) == want and len(want) > 100
    monkeypatch.setattr(H, "CANDIDATES", 100)  # many cells
    monkeypatch.setattr(H, "CHUNK", 32)
    assert mined(df) == want
    assert H.hard_negatives(df.where("false")).count() == 0 and H.hard_negatives(df.where("vec_id = 100")).count() == 0


def test_registered_queries_read_ties_and_repeats(spark, tmp_path):
    rows = [(k % 50 * 10, 1 + k % 2, [1.0, 0.5, 0.25, -0.5]) for k in range(120)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    label = lambda i, n: (n + 1) % 10 if i % 7 == 0 else n
    assert len(got) == len(brute_negatives([(i, label(i, n), v) for i, n, v in rows]))
