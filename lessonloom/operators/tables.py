"""Joins, aggregations, windows and set work on the domain's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.functions.session import with_plain_unions
from lessonloom.functions.text import progress_percent

# --- joins ------------------------------------------------------------------------


def mark_current(exams: DataFrame) -> DataFrame:
    """is_current: the latest exam of each school and grade."""
    latest = Window.partitionBy("school", "grade").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id"))
    return exams.withColumn("is_current", F.row_number().over(latest) == 1)


def current_scope(students: DataFrame, current_exams: DataFrame) -> DataFrame:
    """Students with the current exam of their school and grade, or null."""
    return students.join(current_exams.select(F.col("id").alias("exam_id"), "school", "grade"), ["school", "grade"], "left")


def student_home(students: DataFrame, current_exams: DataFrame, links: DataFrame, passages: DataFrame, items: DataFrame, progress: DataFrame) -> DataFrame:
    """Every student's passages in the order of the current scope, with the number of orderable sentences and the progress per step; missing passages drop out.

    items: passage_id, item_key. progress: student_id, exam_id, passage_id, stage, completed,
    current_cycle, clears, correct_clears. steps is a map from the step to (total,
    correct_clears, completed, current_cycle, clears, percent); clears of items that are no
    longer there are not reported.
    """
    scoped = current_scope(students, current_exams).where("exam_id is not null").select(F.col("id").alias("student_id"), "exam_id")
    rows = scoped.join(links, "exam_id").join(passages.select(F.col("id").alias("passage_id"), "title"), "passage_id")
    counts = items.groupBy("passage_id").agg(F.count("*").alias("sentence_count"))
    keys = ["student_id", "exam_id", "passage_id"]
    open_items = progress.select(*keys, "stage", F.explode("clears").alias("item_key")).join(items.select("passage_id", "item_key"), ["passage_id", "item_key"])
    left = open_items.groupBy(*keys, "stage").agg(F.array_sort(F.collect_set("item_key")).alias("left"))
    state = progress.join(left, [*keys, "stage"], "left").select(*keys, "stage", "correct_clears", "completed", "current_cycle", F.coalesce("left", F.array().cast("array<string>")).alias("clears"))
    by_step = [F.max(F.when(F.col("stage") == k, F.struct("correct_clears", "completed", "current_cycle", "clears"))).alias(f"step{k}") for k in (1, 2)]
    rows = rows.join(counts, "passage_id", "left").join(state.groupBy(*keys).agg(*by_step), keys, "left")
    total = F.coalesce("sentence_count", F.lit(0))
    one = lambda k: F.struct(total.alias("total"), F.coalesce(f"step{k}.correct_clears", F.lit(0)).alias("correct_clears"), F.coalesce(f"step{k}.completed", F.lit(0)).alias("completed"), F.coalesce(f"step{k}.current_cycle", F.lit(1)).alias("current_cycle"), F.coalesce(f"step{k}.clears", F.array().cast("array<string>")).alias("clears"), progress_percent(F.coalesce(f"step{k}.correct_clears", F.lit(0)), total).alias("percent"))
    return rows.select(*keys, "position", "title", total.alias("sentence_count"), F.create_map(F.lit(1), one(1), F.lit(2), one(2)).alias("steps"))


def authorize_attempts(attempts: DataFrame, students: DataFrame, current_exams: DataFrame, links: DataFrame) -> DataFrame:
    """Adds denied: inactive_student, not_current_scope, passage_not_in_scope, or null."""
    who = current_scope(students, current_exams).select(F.col("id").alias("student_id"), "active", F.col("exam_id").alias("scope_id"))
    inside = links.select(F.col("exam_id"), "passage_id").distinct().withColumn("inside", F.lit(True))
    rows = attempts.join(who, "student_id", "left").join(inside, ["exam_id", "passage_id"], "left")
    denied = F.when(~F.coalesce("active", F.lit(False)), "inactive_student").when(~F.col("scope_id").eqNullSafe(F.col("exam_id")), "not_current_scope").when(F.col("inside").isNull(), "passage_not_in_scope")
    return rows.withColumn("denied", denied).drop("active", "scope_id", "inside")


def replay_known(attempts: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds replayed_id: the stored attempt of the same student and client id, case-blind."""
    known = stored.where("client_attempt_id is not null").groupBy("student_id", F.lower("client_attempt_id").alias("client_key")).agg(F.min("id").alias("replayed_id"))
    return attempts.withColumn("client_key", F.lower("client_attempt_id")).join(known, ["student_id", "client_key"], "left").drop("client_key")


@with_plain_unions
def set_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side alone, with the side; empty when the sets are equal."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("right")))


def relink(children: DataFrame, mapping: DataFrame, fk: str) -> DataFrame:
    """Follows an (old, keeper) map."""
    return children.join(mapping.select(F.col("old").alias(fk), "keeper"), fk, "left").withColumn(fk, F.coalesce("keeper", fk)).drop("keeper").select(*children.columns)


def drop_redundant_on_relink(children: DataFrame, mapping: DataFrame, fk: str, key: list[str]) -> DataFrame:
    """Relinked children without those whose keeper has an equal child already; of several that meet, the first old one stays."""
    moved = children.join(mapping.select(F.col("old").alias(fk), "keeper"), fk, "left")
    target = F.coalesce("keeper", fk)
    first = Window.partitionBy("target", *key).orderBy(F.col("keeper").isNotNull(), fk)
    return moved.withColumn("target", target).withColumn("turn", F.row_number().over(first)).where("turn = 1").withColumn(fk, F.col("target")).select(*children.columns)


def valid_sessions_at(requests: DataFrame, sessions: DataFrame, students: DataFrame) -> DataFrame:
    """Requests with the session that their token opens: of the actor that is asked for (null: any), created, neither expired nor revoked, its student active.

    requests: token, ts, actor. sessions: id, token_hash, actor_type, student_id, created_at, expires_at, revoked_at. students: id, active.
    """
    s = sessions.select(F.col("id").alias("session_id"), "token_hash", "actor_type", "student_id", "created_at", F.least("expires_at", "revoked_at").alias("ends_at"))
    s = s.join(students.where("active").select(F.col("id").alias("student_id"), F.lit(True).alias("may")), "student_id", "left").where("may or actor_type <> 'student'")
    found = requests.withColumn("token_hash", F.sha2("token", 256)).join(s, "token_hash")
    open_then = (F.col("ts") >= F.col("created_at")) & (F.col("ts") < F.col("ends_at")) & (F.col("actor").isNull() | (F.col("actor") == F.col("actor_type")))
    return found.where(open_then).select(*requests.columns, "session_id")


def match_exactly_one(changes: DataFrame, base: DataFrame, keys: list[str], change_id: str, base_id: str) -> DataFrame:
    """Each change with its number of matches and, where that is one, the match."""
    both = changes.join(base.select(*keys, F.col(base_id).alias("match")), keys, "left").groupBy(change_id).agg(F.count("match").alias("matches"), F.min("match").alias("match"))
    return both.withColumn("match", F.when(F.col("matches") == 1, F.col("match")))


def ordered_text(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Texts of a key joined by a space, in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), " ").alias("source_text"))


def candidate_links(scopes: DataFrame, passages: DataFrame, links: DataFrame) -> DataFrame:
    """Passages of a scope's grade that it does not hold yet."""
    pairs = scopes.select(F.col("id").alias("exam_id"), "grade").join(passages.select(F.col("id").alias("passage_id"), "grade"), "grade")
    return pairs.join(links.select("exam_id", "passage_id"), ["exam_id", "passage_id"], "left_anti")


def admin_listings(students: DataFrame, current_exams: DataFrame, passages: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The four listings of the administration, each in its order."""
    return {
        "students": students.orderBy("school", "grade", "name", "id"),
        "exams": current_exams.orderBy("school", "grade"),
        "passages": passages.orderBy("display_order", "id"),
        "links": links.orderBy("position", "exam_id", "passage_id"),
    }


def admin_scopes(current_exams: DataFrame, passages: DataFrame, links: DataFrame) -> DataFrame:
    """Per scope its passages in order, and how many passages of its grade it lacks (``candidate_links`` lists them)."""
    listed = F.array_sort(F.collect_list(F.struct("position", "passage_id")))
    assigned = links.groupBy("exam_id").agg(listed["passage_id"].alias("assigned"))
    scopes = current_exams.select(F.col("id").alias("exam_id"), "grade")
    own = links.join(scopes, "exam_id").join(passages.select(F.col("id").alias("passage_id"), "grade"), ["passage_id", "grade"]).groupBy("exam_id").agg(F.count("*").alias("own"))
    sizes = passages.groupBy("grade").agg(F.count("*").alias("in_grade"))
    rows = scopes.join(assigned, "exam_id", "left").join(own, "exam_id", "left").join(sizes, "grade", "left")
    return rows.select("exam_id", F.coalesce("assigned", F.array().cast("array<long>")).alias("assigned"), (F.coalesce("in_grade", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("candidates"))


# --- summaries --------------------------------------------------------------------


def learning_progress(students: DataFrame, attempts: DataFrame, since: str, workbook_key: str | None = None) -> DataFrame:
    """Every student with last activity and, per step, attempts and clean attempts in the period; of one workbook, where its key is given."""
    recent = attempts.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if workbook_key is not None:
        recent = recent.where(F.col("workbook_key") == workbook_key)
    per_step = [c for k in (1, 2) for c in (F.count_if(F.col("stage") == k).alias(f"total_{k}"), F.count_if((F.col("stage") == k) & F.col("correct")).alias(f"clean_{k}"))]
    counted = recent.groupBy("student_id").agg(F.max("created_at").alias("last_activity"), *per_step)
    rows = students.select(F.col("id").alias("student_id"), "name").join(counted, "student_id", "left")
    return rows.select("student_id", "name", "last_activity", *[F.coalesce(f"{w}_{k}", F.lit(0)).alias(f"{w}_{k}") for k in (1, 2) for w in ("total", "clean")])


def day_cells(attempts: DataFrame) -> DataFrame:
    """Attempts summed by student, step and Korean day (from 15:00 UTC): total, clean, last_at. Cells of parts of a log add up to those of the whole."""
    day = F.floor((F.unix_seconds(F.col("created_at").cast("timestamp")) + 9 * 3600) / 86400)
    counted = attempts.groupBy("student_id", "stage", day.cast("long").alias("day"))
    return counted.agg(F.count("*").alias("total"), F.count_if("correct").alias("clean"), F.max("created_at").alias("last_at"))


@with_plain_unions
def add_cells(cells: DataFrame, more: DataFrame) -> DataFrame:
    both = cells.unionByName(more.select(*cells.columns))
    return both.groupBy("student_id", "stage", "day").agg(F.sum("total").alias("total"), F.sum("clean").alias("clean"), F.max("last_at").alias("last_at"))


def learning_progress_of_days(students: DataFrame, cells: DataFrame, since: str) -> DataFrame:
    """``learning_progress`` from day cells, for a period that starts at a Korean midnight (as ``period_start`` gives it); no attempt is read."""
    first = F.floor((F.unix_seconds(F.lit(since).cast("timestamp")) + 9 * 3600) / 86400)
    recent = cells.where(F.col("day") >= first)
    per_step = [F.sum(F.when(F.col("stage") == k, F.col(w)).otherwise(0)).alias(f"{w}_{k}") for k in (1, 2) for w in ("total", "clean")]
    counted = recent.groupBy("student_id").agg(F.max("last_at").alias("last_activity"), *per_step)
    rows = students.select(F.col("id").alias("student_id"), "name").join(counted, "student_id", "left")
    return rows.select("student_id", "name", "last_activity", *[F.coalesce(f"{w}_{k}", F.lit(0)).alias(f"{w}_{k}") for k in (1, 2) for w in ("total", "clean")])


@with_plain_unions
def learning_progress_all(students: DataFrame, question_attempts: DataFrame, attempts: DataFrame, since: str) -> DataFrame:
    """Active students with counts of both logs in the period and the last activity ever."""
    logs = question_attempts.select("student_id", "correct", "created_at", F.lit("q").alias("log")).unionByName(attempts.select("student_id", "correct", "created_at", F.lit("w").alias("log")))
    recent = F.col("created_at") >= F.lit(since).cast("timestamp_ntz")
    parts = [F.count_if(recent & (F.col("log") == g) & c).alias(f"{n}_{w}") for g, n in (("q", "question"), ("w", "workbook")) for w, c in (("attempts", F.lit(True)), ("correct", F.col("correct")), ("wrong", ~F.col("correct")))]
    counted = logs.groupBy("student_id").agg(F.max("created_at").alias("last_activity"), *parts)
    rows = students.where("active").select(F.col("id").alias("student_id"), "school", "grade", "name").join(counted, "student_id", "left")
    return rows.select("student_id", "last_activity", *[F.coalesce(f"{n}_{w}", F.lit(0)).alias(f"{n}_{w}") for n in ("question", "workbook") for w in ("attempts", "correct", "wrong")])


def least_recent_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.asc_nulls_first("last_activity"), "student_id")


def impact(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Numbers of dependent rows per parent, by name."""
    out = parents.select(F.col("id").alias(key))
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def delete_impact(kind: str, parents: DataFrame, ids: DataFrame, **children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label and dependent rows of each entity to delete, ids that are none): children by name, with student_id or passage_id."""
    label, key = {"student": ("name", "student_id"), "passage": ("title", "passage_id")}[kind]
    asked = ids.select("id").distinct()
    found = impact(parents.join(asked, "id", "left_semi"), key, **children)
    return found.join(parents.select(F.col("id").alias(key), F.col(label).alias("label")), key), asked.join(parents.select("id"), "id", "left_anti")


def cumulative_clears(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Correct attempts per key, the time and the stage of the latest."""
    return attempts.where("correct").groupBy(*keys).agg(F.count("*").alias("clears"), F.max("created_at").alias("updated_at"), F.max_by("stage", F.struct("created_at", "id")).alias("last_stage"))


def available_counts(passages: DataFrame, questions: DataFrame) -> DataFrame:
    counted = questions.groupBy(F.col("passage_id").alias("id")).agg(F.count_if(F.col("status") == "available").alias("available"))
    return passages.select("id").join(counted, "id", "left").withColumn("available", F.coalesce("available", F.lit(0)))


def inconsistent_groups(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(label).alias("labels")).where("labels <> 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null in part or as a whole, or occur more than once, with their number."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def non_contiguous_groups(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    spread = df.groupBy(*keys).agg((F.max(position) - F.min(position) + 1).alias("spread"), F.count("*").alias("n"))
    return spread.where("spread <> n")


def next_position(df: DataFrame, parents: DataFrame, key: str, position: str) -> DataFrame:
    top = df.groupBy(key).agg(F.max(position).alias("top"))
    return parents.select(key).distinct().join(top, key, "left").select(key, (F.coalesce("top", F.lit(-1)) + 1).alias("next_position"))


def latest_wrong(attempts: DataFrame, keys: list[str], bookmarks: DataFrame | None = None) -> DataFrame:
    """Keys whose latest attempt is wrong, without those bookmarked already."""
    latest = attempts.groupBy(*keys).agg(F.max_by(F.struct("id", "correct"), F.struct("created_at", "id")).alias("x")).where("not x.correct").select(*keys, F.col("x.id").alias("attempt_id"))
    return latest if bookmarks is None else latest.join(bookmarks.select(*keys), keys, "left_anti")


@with_plain_unions
def with_wrong_answers(bookmarks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Bookmarks and, for every question whose latest attempt is wrong and that has none, one of source wrong_answer, as of that attempt.

    bookmarks: student_id, exam_id, question_id, source, updated_at. attempts: the keys, id, correct, created_at.
    """
    keys = ["student_id", "exam_id", "question_id"]
    wrong = latest_wrong(attempts, keys, bookmarks).withColumnRenamed("attempt_id", "id")
    made = wrong.join(attempts.select("id", "created_at"), "id")
    return bookmarks.select(*keys, "source", "updated_at").unionByName(made.select(*keys, F.lit("wrong_answer").alias("source"), F.col("created_at").alias("updated_at")))


def review_queue(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks with their place in the queue of their student and exam, the newest change first; ties by question."""
    return renumber(bookmarks, ["student_id", "exam_id"], [F.desc("updated_at"), "question_id"], "place")


def distinct_ids(values: Column, most: int = 80) -> Column:
    """The ids of a list in the order of their first places, trimmed and cut, without blank ones."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.substring(F.trim(x), 1, most)), lambda x: x != ""))


def run_summary(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.count("*").alias("finished"), F.count_if("correct").alias("clean"))


def stale_clears(clears: DataFrame, items: DataFrame) -> DataFrame:
    """Stored clears whose item is not active any more, counted by passage."""
    return clears.join(items.select("passage_id", "item_key"), ["passage_id", "item_key"], "left_anti").groupBy("passage_id").agg(F.count("*").alias("stale"))


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The named columns of the latest row per key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])


def latest_resolved(events: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per key the latest lookup that was resolved, and how many lookups of each reason there were."""
    order = F.when(F.col("resolved"), F.struct("created_at", "id"))
    counts = [F.count_if(F.col("reason") == r).alias(f"{r}_lookups") for r in ("initial", "retry")]
    latest = events.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("x"), F.max(order).alias("at"), *counts)
    return latest.where("at is not null").select(*by, *[F.col(f"x.{c}").alias(c) for c in columns], "initial_lookups", "retry_lookups")


def merge_word_states(states: DataFrame, mapping: DataFrame) -> DataFrame:
    """States of words after their passages were merged: known if any was, with the latest change and the first creation. mapping: old, keeper."""
    moved = relink(states, mapping, "passage_id")
    return moved.groupBy("student_id", "passage_id", "word").agg(F.bool_or("known").alias("known"), F.max("updated_at").alias("updated_at"), F.min("created_at").alias("created_at"))


def lacking_matches(items: DataFrame, sources: DataFrame, saved: DataFrame, item_key: str, keys: list[str]) -> DataFrame:
    """Items with sources none of which is saved: what a migration has lost. sources: item_key and keys; saved: keys."""
    kept = sources.join(saved.select(*keys).distinct(), keys, "left_semi").select(item_key)
    return items.join(sources.select(item_key).distinct(), item_key, "left_semi").join(kept, item_key, "left_anti")


# --- windows ----------------------------------------------------------------------


def renumber(df: DataFrame, part: str, order: list, name: str = "position") -> DataFrame:
    """Dense positions from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1).cast("long"))


def global_rank(df: DataFrame, key: str, name: str, cells: int = 256) -> DataFrame:
    """Adds the place of each row among all, from 0, by a numeric key without repeats.

    Rows are cut at quantiles of the key; what meets in one place is one count a cell.
    """
    probs = [k / cells for k in range(1, cells)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, probs, 10_000).alias("q")).first()["q"] or []))

    def cell(low: int, high: int) -> Column:
        """Bounds under the key, by bisection."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) <= F.lit(bounds[middle]), cell(low, middle)).otherwise(cell(middle + 1, high))

    rows = df.withColumn("cell", cell(0, len(bounds)))
    starts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    starts = starts.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cell_start"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy(key)) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(starts), "cell").withColumn(name, (F.col("cell_start") + F.col("inside")).cast("long")).drop("cell", "inside", "cell_start")


def pick_keeper(passages: DataFrame, label: Column, order: list) -> DataFrame:
    """(old, keeper) for all rows of a label."""
    first = F.first("id").over(Window.partitionBy("label").orderBy(*order))
    return passages.withColumn("label", label).select(F.col("id").alias("old"), first.alias("keeper"), "label")


@with_plain_unions
def append_members(links: DataFrame, additions: DataFrame, replace: bool = False) -> DataFrame:
    """Members with new ones at the end, in input order (ordinal); with ``replace``, members that the input lacks go first."""
    kept = links.join(additions.select("exam_id", "passage_id"), ["exam_id", "passage_id"], "left_semi") if replace else links
    top = kept.groupBy("exam_id").agg(F.max("position").alias("top"))
    new = additions.join(kept.select("exam_id", "passage_id"), ["exam_id", "passage_id"], "left_anti").join(top, "exam_id", "left")
    turn = F.row_number().over(Window.partitionBy("exam_id").orderBy("ordinal", "passage_id"))
    placed = new.select("exam_id", "passage_id", (F.coalesce("top", F.lit(-1)) + turn).cast("long").alias("position"))
    return kept.select("exam_id", "passage_id", F.col("position").cast("long").alias("position")).unionByName(placed)


def seed_top_n(scopes: DataFrame, passages: DataFrame, links: DataFrame, n: int = 5) -> DataFrame:
    """First passages of the grade for scopes that have none; the first three are the mock group."""
    empty = scopes.select(F.col("id").alias("exam_id"), "grade").join(links.select("exam_id").distinct(), "exam_id", "left_anti")
    # A plain row_number() <= n lets Spark cut each grade to n rows before the exchange.
    ranked = passages.withColumn("turn", F.row_number().over(Window.partitionBy("grade").orderBy("display_order", "id"))).where(F.col("turn") <= n)
    rows = empty.join(ranked.select("grade", F.col("id").alias("passage_id"), (F.col("turn") - 1).alias("position")), "grade")
    return rows.select("exam_id", "passage_id", F.col("position").cast("long").alias("position"), F.when(F.col("position") < 3, "mock").otherwise("supplement").alias("group_key"))


def failed_login_window(log: DataFrame, limit: int, minutes: int = 15) -> DataFrame:
    """For each try the failures of its identifier in the window before it, and whether that locks.

    Time is cut into cells of one window and a failure is put into its own cell and the
    next, where all tries are that can see it: no group holds an identifier's history.
    Tries without a time see only each other.
    """
    width = minutes * 60_000_000
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    timed = log.withColumns({"__us": us, "__own": us - F.pmod(us, F.lit(width))})
    cells = F.when(F.col("successful") | F.col("__us").isNull(), F.array("__own")).otherwise(F.array("__own", F.col("__own") + width))
    dealt = timed.withColumn("__cell", F.explode(cells))
    before = Window.partitionBy("identifier", "__cell").orderBy("__us").rangeBetween(-width, -1)
    counted = dealt.withColumn("failures", F.count_if(~F.col("successful")).over(before)).where("__cell <=> __own")
    return counted.withColumn("locked", F.col("failures") >= limit).drop("__us", "__own", "__cell")


def sync_grade_scope(links: DataFrame, scopes: DataFrame, passages: DataFrame, grades: list[str]) -> tuple[DataFrame, DataFrame]:
    """(links of the scopes after every passage has found its grade's scopes, grades without a scope).

    scopes: id, grade, the test scopes of some grades; passages of other grades go nowhere.
    Passages of another grade leave a scope, the rest closes up, missing ones of its grade
    come at the end. A passage of a listed grade that has no scope is an error.
    """
    own = scopes.where(F.col("grade").isin(*grades))
    fits = links.join(own.select(F.col("id").alias("exam_id"), "grade"), "exam_id").join(passages.select(F.col("id").alias("passage_id"), "grade"), ["passage_id", "grade"])
    compact = renumber(fits.select("exam_id", "passage_id", F.col("position").alias("old")), "exam_id", ["old", "passage_id"]).drop("old")
    extra = candidate_links(own, passages, compact).withColumn("ordinal", F.col("passage_id"))
    missing = passages.where(F.col("grade").isin(*grades)).select("grade").distinct().join(own.select("grade"), "grade", "left_anti")
    return append_members(compact, extra), missing


def surviving_links(links: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of which each scope keeps one a lesson, set to the lesson's keeper: (links, changed ones, scopes and lessons that do not end on their keeper).

    aliases: passage_id, lesson, keeper. The survivor is the first link by position; a scope
    that holds the keeper under another lesson keeps that link as it is.
    """
    known = links.join(aliases, "passage_id", "left")
    turn = F.row_number().over(Window.partitionBy("exam_id", "lesson").orderBy("position", "passage_id"))
    judged = known.withColumn("turn", F.when(F.col("lesson").isNotNull(), turn))
    removed, moved = F.coalesce(F.col("turn") > 1, F.lit(False)), F.coalesce((F.col("turn") == 1) & (F.col("passage_id") != F.col("keeper")), F.lit(False))
    judged = judged.withColumns({"removed": removed, "moved": moved})
    left = judged.where("not removed").withColumn("passage_id", F.coalesce("keeper", "passage_id"))
    changed = judged.where("removed or moved").select("exam_id", "passage_id", F.when(F.col("removed"), "removed").otherwise("moved").alias("change"))
    ends = left.select("exam_id", F.col("passage_id").alias("keeper"))
    failed = judged.where("lesson is not null").select("exam_id", "lesson", "keeper").distinct().join(ends, ["exam_id", "keeper"], "left_anti")
    return left.select(*links.columns), changed, failed


# --- listings and sets ------------------------------------------------------------


def ordered_listing(rows: DataFrame, by: list[str | Column], key: str = "id") -> DataFrame:
    """Rows in the given order; the key decides among equals, so the order is total."""
    return rows.orderBy(*by, key)


def ordered_ids(rows: DataFrame, by: str | list[str], order: str, item: str, ids: str = "ids") -> DataFrame:
    """One array of ``item`` a group, by ``order`` and then by the item; groups must be of bounded size."""
    keys = [by] if isinstance(by, str) else by
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.col(item).alias("item"))))
    return rows.groupBy(*keys).agg(pairs["item"].alias(ids))


def ordered_json(rows: DataFrame, by: str | list[str], order: str, fields: list[str], text: str = "items") -> DataFrame:
    """One JSON array of objects with the given fields a group, by ``order`` and then by the fields; null fields are written."""
    keys = [by] if isinstance(by, str) else by
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.struct(*fields).alias("item"))))
    return rows.groupBy(*keys).agg(F.to_json(pairs["item"], {"ignoreNullFields": "false"}).alias(text))


@with_plain_unions
def activity_union(*logs: DataFrame) -> DataFrame:
    """All rows of several attempt logs, with the columns that every log has, in the order of the first; nothing is folded."""
    shared = [c for c in logs[0].columns if all(c in log.columns for log in logs)]
    out = logs[0].select(*shared)
    for log in logs[1:]:
        out = out.unionByName(log.select(*shared))
    return out


@with_plain_unions
def members_union_distinct(members: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Members of either side, each once."""
    return members.select(*keys).unionByName(more.select(*keys)).distinct()
