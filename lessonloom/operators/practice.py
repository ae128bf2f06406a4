"""Practice items, grading, submission, and progress as folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonloom import constants as C
from lessonloom.functions.session import shared_folder, with_plain_unions
from lessonloom.functions.text import clean_text, flatten_space, fold_case, has_two_words, is_blank, item_key, mistake_allowance, normalize_words, progress_percent, sentence_words
from lessonloom.operators.folds import fold_sorted
from lessonloom.operators.graph import connected
from lessonloom.operators.rules import is_attempt_id
from lessonloom.operators.tables import latest_by


def orderable(sentences: DataFrame) -> DataFrame:
    """Sentences that can be ordered, as they are: active SENTENCE rows of two words or more with a translation."""
    kind = F.upper(F.coalesce(F.nullif("block_type", F.lit("")), F.lit("SENTENCE")))
    return sentences.where((kind == "SENTENCE") & F.coalesce(F.col("active"), F.lit(True)) & ~is_blank(F.col("translation")) & has_two_words(F.col("text")))


def practice_items(sentences: DataFrame) -> DataFrame:
    """The ``orderable`` sentences with their cleaned texts, words and answer."""
    kept = orderable(sentences)
    items = kept.select(item_key(F.col("id")).alias("item_key"), F.col("id"), "passage_id", "sentence_index", clean_text(F.col("text")).alias("text"), clean_text(F.col("translation")).alias("translation"), sentence_words(F.col("text")).alias("words"))
    return items.withColumn("answer", F.array_join("words", " "))


def attach_item(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """Attempts with the item of their passage and sentence, and whether there is one (``orderable``); items are told apart by passage_id and sentence_id.

    An attempt without a passage or sentence has no item; columns of the items that attempts have too are left out.
    """
    more = [c for c in items.columns if c not in attempts.columns]
    found = items.select("passage_id", "sentence_id", *more, F.lit(True).alias("__found"))
    joined = attempts.join(found, ["passage_id", "sentence_id"], "left")
    return joined.select(*attempts.columns, *more, F.coalesce("__found", F.lit(False)).alias("orderable"))


def orderable_counts(sentences: DataFrame) -> DataFrame:
    """Per passage: items, and sentences skipped for having fewer than two words."""
    items = practice_items(sentences).groupBy("passage_id").agg(F.count("*").alias("items"))
    counted = sentences.where("active and block_type = 'SENTENCE'").groupBy("passage_id").agg(F.count_if(~has_two_words(F.col("text"))).alias("skipped"))
    return counted.join(items, "passage_id", "left").select("passage_id", F.coalesce("items", F.lit(0)).alias("items"), "skipped")


def grade_attempts(df: DataFrame) -> DataFrame:
    """Adds word_count, allowance, reason (null if valid) and correct; columns text, step, arranged, mistakes, restarts.

    Words are a row's chips; the first rule that fails names the reason.
    """
    n = F.size("chips")
    # Whole sentences are compared: normalising one costs one pass, as many as its words otherwise. Equal ones need none.
    differ = (n >= 2) & (F.col("joined") != F.col("flat"))
    expected, actual = (fold_case(F.when(differ, F.col(c))) for c in ("joined", "flat"))
    counter = lambda c: F.coalesce(F.col(c).between(0, C.MAX_COUNTER), F.lit(False))
    allowance = mistake_allowance(F.col("step"), n)
    final = F.col("mistakes") - F.col("restarts") * (allowance + 1)
    reason = (
        F.when(~F.coalesce(F.col("step").isin(1, 2), F.lit(False)), "unknown_step")
        .when(n < 2, "not_orderable")
        .when(~counter("mistakes") | ~counter("restarts"), "invalid_counter")
        .when(differ & (expected != actual), "incomplete_sentence")
        .when((F.col("step") == 1) & (F.col("restarts") != 0), "step1_never_restarts")
        .when((F.col("step") == 2) & ~final.between(0, allowance), "step2_counts_inconsistent")
    )
    split = df.withColumn("chips", sentence_words(F.col("text"))).withColumns({"joined": F.array_join("chips", " "), "flat": flatten_space(F.col("arranged"))})
    judged = split.withColumns({"word_count": n, "allowance": allowance, "reason": reason}).drop("chips", "joined", "flat")
    correct = F.when(F.col("reason").isNull(), run_is_clean(F.col("step"), F.col("mistakes"), F.col("restarts")))
    return judged.withColumn("correct", correct)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key; rows with a null in the key all stay."""
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("turn", turn).where((F.col("turn") == 1) | ~has_key).drop("turn")


def submit_attempts(batch: DataFrame, stored: DataFrame, allowed: DataFrame, items: DataFrame, passages: DataFrame) -> DataFrame:
    """Outcome of each attempt: stored, replayed or rejected with a reason, in the order id shape, replay, access, item, grade.

    batch: id, student_id, passage_id, sentence_id, client_attempt_id, step, arranged, mistakes, restarts.
    stored: student_id, client_attempt_id, stored_correct. allowed: student_id, passage_id, and exam_id where access goes by exam.
    items: sentence_id, passage_id, text (the sentences that can be ordered now). passages: passage_id, revision.
    Of equal client ids in one batch the first is judged; the others replay it. What is stored
    carries its response (arranged, mistakes, restarts, word_count), the passage's revision
    and its number of items.
    """
    good_id, two_steps = is_attempt_id(F.col("client_attempt_id")), F.coalesce(F.col("step").isin(1, 2), F.lit(False))
    # What is refused whatever its words are is not split, carried or graded: only what is stored tells them.
    named = batch.withColumns({"client_key": F.lower("client_attempt_id"), "good_id": good_id, "arranged": F.when(good_id & two_steps, F.col("arranged"))})
    known = stored.select("student_id", F.lower("client_attempt_id").alias("client_key"), F.col("stored_correct")).dropDuplicates(["student_id", "client_key"]).withColumn("known", F.lit(True))
    rows = named.join(known, ["student_id", "client_key"], "left")
    access = ["student_id", "passage_id", *(["exam_id"] if "exam_id" in allowed.columns else [])]
    rows = rows.join(allowed.select(*access).distinct().withColumn("allowed", F.lit(True)), access, "left")
    rows = rows.join(items.select("sentence_id", "passage_id", "text"), ["sentence_id", "passage_id"], "left")
    early = F.when(~F.col("good_id"), "invalid_id").when(F.col("known"), "known").when(F.col("allowed").isNull(), "not_in_scope").when(F.col("text").isNull(), "not_orderable_now")
    # What is decided already is not graded: its text is empty.
    rows = grade_attempts(rows.withColumn("early", early).withColumn("text", F.when(F.col("early").isNull() & two_steps, F.col("text"))))
    judged = rows.withColumn("refused", F.when(F.col("known") & F.col("good_id"), None).otherwise(F.coalesce("early", "reason")))
    again = F.min(F.when(F.col("refused").isNull(), F.col("id"))).over(Window.partitionBy("student_id", F.when(F.col("good_id"), F.col("client_key")).otherwise(F.col("id").cast("string"))))
    outcome = F.when(F.col("known"), "replayed").when(F.col("refused").isNotNull(), "rejected").when(F.col("id") == again, "stored").otherwise("replayed")
    done = judged.withColumn("outcome", F.when(~F.col("good_id"), "rejected").otherwise(outcome))
    counts = items.groupBy("passage_id").agg(F.count("*").alias("items"))
    done = done.join(counts, "passage_id", "left").join(passages.select("passage_id", "revision"), "passage_id", "left")
    kept = lambda c: F.when(F.col("outcome") == "stored", c)
    response = kept(F.struct("arranged", "mistakes", "restarts", "word_count"))
    return done.select("id", "outcome", F.when(F.col("outcome") == "rejected", F.col("refused")).alias("reason"), F.coalesce("stored_correct", "correct").alias("correct"), response.alias("response"), kept(F.col("revision")).alias("passage_revision"), kept(F.col("items")).alias("stage_item_count"))


# --- ordering chips ---------------------------------------------------------------


def answer_indexes(df: DataFrame, key: str, chips: str, answer: str) -> DataFrame:
    """For each answer word the chip that it takes: the k-th repeat of a word takes its k-th chip; empty if any word has none.

    Chips and answer are sorted by word and place: where their words agree, equal places belong together.
    """
    # Joined first and split after: what a column is made of is not made anew wherever it is named.
    joined = df.select(key, *[F.when(F.size(c) > 0, F.array_join(c, " ")).alias(name) for c, name in ((answer, "wanted"), (chips, "there"))])
    split = joined.select(key, *[F.split(fold_case(F.col(c)), " ").alias(c) for c in ("wanted", "there")])
    placed = lambda c: F.coalesce(F.sort_array(F.arrays_zip(F.col(c).alias("word"), F.sequence(F.lit(0), F.size(c) - 1).alias("at"))), F.array().cast("array<struct<word:string,at:int>>")).alias(c)
    rows = split.select(key, placed("wanted"), placed("there"))
    pairs = F.sort_array(F.arrays_zip(F.col("wanted.at").alias("place"), F.slice(F.col("there.at"), F.lit(1), F.size("wanted")).alias("at")))
    none = F.array().cast("array<int>")
    return rows.select(key, F.when(F.col("wanted.word") == F.col("there.word"), pairs["at"]).otherwise(none).alias("indexes"))


def run_is_clean(step, mistakes, restarts):
    """A run without any wrong chip in step 1, without a restart in step 2; for columns and plain values alike."""
    if isinstance(step, Column):
        return F.when(step == 1, mistakes == 0).otherwise(restarts == 0)
    return mistakes == 0 if step == 1 else restarts == 0


def attempt_payload(runs: DataFrame) -> DataFrame:
    """What a finished run sends: sentence_id, step, arranged, mistakes, restarts (runs: sentence_id, step, chosen, words, mistakes, restarts)."""
    return runs.select("sentence_id", "step", built_sentence(F.col("chosen"), F.col("words")).alias("arranged"), "mistakes", "restarts")


def built_sentence(chosen: Column, words: Column) -> Column:
    return F.array_join(F.transform(chosen, lambda i: F.get(words, i)), " ")


def chip_bank(items: DataFrame, seed: int, key: str = "id", words: str = "words") -> DataFrame:
    """One seeded order of each item's chips, never the sentence's own for two chips or more."""
    plain = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    mixed = F.array_sort(F.transform(plain, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))["i"]
    rotated = F.concat(F.slice(plain, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit(0)))
    return items.withColumn("bank", mixed).withColumn("bank", F.when((F.size(words) > 1) & (F.col("bank") == plain), rotated).otherwise(F.col("bank")))


def chip_batches(items: DataFrame, key: str, chips: str, size: int = 4) -> DataFrame:
    """Fixed slices of the expected chips."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(chips) - 1, F.lit(0)), F.lit(size))
    cut = items.select(key, chips, F.posexplode(starts).alias("batch", "start"))
    return cut.select(key, "batch", F.slice(chips, F.col("start") + 1, F.lit(size)).alias("chips"))


# --- folds ------------------------------------------------------------------------

#: What progress is kept by: contract and progress key as ``with_progress_key`` derives them.
PROGRESS_KEY = ["student_id", "exam_id", "passage_id", "workbook_key", "stage_contract_version", "progress_key"]
#: The key of a home that knows one exam and workbook.
STEP_KEY = ["student_id", "passage_id", "stage"]


def with_progress_key(attempts: DataFrame) -> DataFrame:
    """Attempts with the key's derived columns: an empty contract is the legacy one, an empty semantic type stands back for the stage; a missing workbook is the sentence practice."""
    empty = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in attempts.columns else F.lit(None).cast("string")
    workbook = F.coalesce(empty("workbook_key"), F.lit(C.WORKBOOK_KEY))
    named = attempts.withColumns({"workbook_key": workbook, "stage_contract_version": F.coalesce(empty("stage_contract_version"), F.lit(C.LEGACY_CONTRACT)), "semantic_type": empty("semantic_type")})
    named = named if "exam_id" in attempts.columns else named.withColumn("exam_id", F.lit(None).cast("long"))
    return named.withColumn("progress_key", F.coalesce("semantic_type", F.concat(F.lit("stage:"), F.col("stage").cast("string"))))


@with_plain_unions
def cycle_progress(attempts: DataFrame, keys: list[str] = PROGRESS_KEY, active: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """completed, current cycle, open clears and correct_clears per key, folded over correct attempts in (created_at, id) order, with stage, semantic_type and time of the attempt that counted last.

    An item counts once a cycle; a cycle closes when as many items are cleared as the
    attempt's item count says. With ``active`` (keys, active_items, perhaps created_at)
    the clears of other items are dropped at each step from then on (from the start, if
    there is no time) and completion is checked on repeats, too. ``before`` is an earlier
    result of this function, from which the fold goes on.
    """
    given = with_progress_key(attempts).where(F.col("correct") & (F.col("stage_item_count") > 0))
    time, number = attempts.schema["created_at"].dataType, attempts.schema["id"].dataType
    extra = {"created_at": time, "kind": "int", "id": number, "item_key": "string", "stage_item_count": "long", "last_stage": "int", "last_type": "string", "items": "array<string>", "completed": "long", "correct_clears": "long", "held_at": time}

    def shaped(rows: DataFrame, **own) -> DataFrame:
        return rows.select(*keys, *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in extra.items()])

    rows = shaped(given, kind=F.lit(2), last_stage=F.col("stage"), last_type=F.col("semantic_type"), **{c: F.col(c) for c in ("created_at", "id", "item_key", "stage_item_count")})
    if active is not None:
        at = {"created_at": F.col("created_at")} if "created_at" in active.columns else {}
        rows = rows.unionByName(shaped(active, kind=F.lit(1), items=F.col("active_items"), **at))
    if before is not None:
        last = {"last_stage": F.col("stage")} | ({"last_type": F.col("semantic_type")} if "semantic_type" in before.columns else {})
        rows = rows.unionByName(shaped(before, kind=F.lit(0), items=F.col("clears"), held_at=F.col("updated_at"), completed=F.col("completed"), correct_clears=F.col("correct_clears"), **last))

    def step(state: dict, row: tuple) -> None:
        at, kind, item, size, stage, semantic, items, completed, correct_clears, held_at = row
        clears = state["clears"]
        if kind == 1:
            state["active"] = set(items)
            clears &= state["active"]
            return
        state["seen"] = True
        if kind == 0:
            clears.update(items)
            state.update(completed=completed, correct_clears=correct_clears, last=(stage, semantic, held_at))
            return
        if state["active"] is not None:
            clears &= state["active"]
        repeated = item in clears
        clears.add(item)
        closed = len(clears) >= size
        if repeated and not (closed and state["active"] is not None):
            return
        state["last"] = (stage, semantic, at)
        if closed:
            state["completed"] += 1
            clears.clear()
        state["correct_clears"] = state["completed"] * size + len(clears)

    start = lambda: {"completed": 0, "clears": set(), "correct_clears": 0, "last": (None, None, None), "active": None, "seen": False}
    finish = lambda s: (s["completed"], s["completed"] + 1, sorted(s["clears"]), s["correct_clears"], *s["last"]) if s["seen"] else None
    schema = f"completed long, current_cycle long, clears array<string>, correct_clears long, last_stage int, last_type string, updated_at {time.simpleString()}"
    columns = ["created_at", "kind", "item_key", "stage_item_count", "last_stage", "last_type", "items", "completed", "correct_clears", "held_at"]
    found = fold_sorted(rows, keys, [F.asc_nulls_first("created_at"), "kind", F.asc_nulls_first("id")], [*columns, "id"], start, lambda s, r: step(s, r[:-1]), schema, finish)
    for told, name in (("last_stage", "stage"), ("last_type", "semantic_type")):
        found = found.drop(told) if name in keys else found.withColumnRenamed(told, name)
    return found


def latest_catalog(attempts: DataFrame, catalogs: DataFrame, key: str = "passage_id") -> DataFrame:
    """Attempts with the catalog that was updated last for their key, where that has items; attempts without one are left out.

    catalogs: key, catalog_id, items, updated_at. One catalog a key is chosen before the join.
    """
    latest = latest_by(catalogs, [key], ["updated_at", "catalog_id"], ["catalog_id", "items"])
    found = latest.where("items > 0").withColumnRenamed("items", "catalog_items")
    return attempts.join(found, key)


def rebuild_progress(attempts: DataFrame, catalogs: DataFrame, keys: list[str] = PROGRESS_KEY) -> DataFrame:
    """Progress from nothing but the log: correct history in order, item counts of the latest catalogs."""
    counted = latest_catalog(attempts.drop("stage_item_count"), catalogs).withColumnRenamed("catalog_items", "stage_item_count")
    return cycle_progress(counted, keys)


def practice_progress(grid: DataFrame, progress: DataFrame, items: DataFrame) -> DataFrame:
    """Progress over a whole grid (student, passage, step), zeros where there is none; clears of items that still exist; percent by the present number of items."""
    totals = items.groupBy("passage_id").agg(F.count("*").alias("total"), F.collect_set("item_key").alias("item_keys"))
    rows = grid.join(progress, STEP_KEY, "left").join(totals, "passage_id", "left")
    total = F.coalesce("total", F.lit(0)).cast("long")
    clears = F.size(F.array_intersect(F.coalesce("clears", F.array().cast("array<string>")), F.coalesce("item_keys", F.array().cast("array<string>"))))
    return rows.select(*STEP_KEY, total.alias("total"), F.coalesce("correct_clears", F.lit(0)).alias("correct_clears"), F.coalesce("completed", F.lit(0)).alias("completed"), clears.cast("long").alias("open_clears"), progress_percent(F.coalesce("correct_clears", F.lit(0)), total).alias("percent"))


def first_open_item(homes: DataFrame, items: DataFrame, progress: DataFrame, keys: list[str] = STEP_KEY) -> DataFrame:
    """(keys, item_key, place): the item at which each student goes on: the first that the current cycle has not cleared, or the passage's first; nothing for a passage without items.

    homes: keys (passage_id among them). items: passage_id, item_key, sentence_index. progress: keys, clears.
    """
    placed = items.select("passage_id", "item_key", (F.row_number().over(Window.partitionBy("passage_id").orderBy("sentence_index", "item_key")) - 1).alias("place"))
    rows = homes.select(*keys).join(placed, "passage_id").join(progress.select(*keys, "clears"), keys, "left")
    is_open = ~F.array_contains(F.coalesce("clears", F.array().cast("array<string>")), F.col("item_key"))
    at = F.struct((~is_open).alias("cleared"), "place", "item_key")
    return rows.groupBy(*keys).agg(F.min(at).alias("x")).select(*keys, "x.item_key", F.when(F.col("x.cleared"), F.lit(0)).otherwise(F.col("x.place")).cast("long").alias("place"))


@with_plain_unions
def replay_taps(taps: DataFrame, words: DataFrame, step: int, run: str = "run_id") -> DataFrame:
    """Runs folded over their taps: placed chips, mistakes, restarts, completed, clean.

    taps: run, seq, chip. words: run, words (a sentence's chips). Chips of equal words are
    interchangeable; a used or unknown chip, or a tap after the end, is ignored. Runs
    without words are left out.
    """
    norm = normalize_words(F.col("words"))
    first = words.select(run, F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("chip"), norm.alias("norm"))
    log = taps.select(run, F.col("seq").cast("long").alias("seq"), F.col("chip").cast("int").alias("chip"), F.lit(None).cast("array<string>").alias("norm"))

    def tap(s: dict, row: tuple) -> None:
        chip, norm, _ = row
        if norm is not None:
            s["norm"] = norm
            s["allowance"] = None if step == 1 else int(len(norm) >= C.LONG_SENTENCE_WORDS)
            return
        s["tapped"] = True
        if s["norm"] is None or len(s["used"]) >= len(s["norm"]) or chip is None or not 0 <= chip < len(s["norm"]) or chip in s["used"]:
            return
        if s["norm"][chip] == s["norm"][len(s["used"])]:
            s["used"].append(chip)
            return
        s["mistakes"] += 1
        s["slips"] += 1
        if s["allowance"] is not None and s["slips"] > s["allowance"]:
            s["used"], s["slips"], s["restarts"] = [], 0, s["restarts"] + 1

    def finish(s: dict) -> tuple | None:
        if s["norm"] is None or not s["tapped"]:
            return None
        completed = len(s["used"]) >= len(s["norm"])
        return len(s["used"]), s["mistakes"], s["restarts"], completed, completed and run_is_clean(step, s["mistakes"], s["restarts"])

    start = lambda: {"used": [], "slips": 0, "mistakes": 0, "restarts": 0, "norm": None, "allowance": None, "tapped": False}
    return fold_sorted(log.unionByName(first), [run], [F.asc_nulls_first("seq")], ["chip", "norm", "seq"], start, tap, "placed int, mistakes int, restarts int, completed boolean, clean boolean", finish)


@with_plain_unions
def thin_touches(touches: DataFrame, minutes: int = C.TOUCH_MINUTES, key: str = "session_id", at: str = "at_us") -> DataFrame:
    """Touches that are written: more than ``minutes`` after the last written one, or after ``started_us``, where a session starts."""
    started = touches.groupBy(key).agg(F.min("started_us").alias("started_us"))
    rows = touches.select(key, F.col(at).cast("long").alias(at), F.lit(None).cast("long").alias("begin")).unionByName(started.where("started_us is not null").select(key, F.lit(None).cast("long").alias(at), F.col("started_us").alias("begin")))

    def step(s: dict, row: tuple) -> tuple | None:
        when, begin = row
        if when is None:
            s["last"] = begin
            return None
        if s["last"] is None or when > s["last"] + minutes * 60_000_000:
            s["last"] = when
            return (when,)
        return None

    return fold_sorted(rows.withColumnRenamed(at, "touched"), [key], [F.asc_nulls_first("touched")], ["touched", "begin"], lambda: {"last": None}, step, f"{at} long")


#: What a try is checked against, an admin's and a student's, each in order; identifiers begin with the place here.
CHECKED = ("admin_client", "admin", "student_client", "code")


def with_identifiers(tries: DataFrame, key: str | None = None) -> DataFrame:
    """Adds the identifiers of each try in the order of its checks (``first``, ``second``; of its key, if there is one)."""
    realm = F.coalesce(F.col(key).cast("string"), F.lit("\0")) if key else F.lit("")
    name = lambda place, who: F.concat_ws("\0", F.lit(str(place)), realm, F.coalesce(who.cast("string"), F.lit("\0")))
    return tries.withColumns({"first": F.when(F.col("admin"), name(0, F.col("client"))).otherwise(name(2, F.col("client"))), "second": F.when(F.col("admin"), name(1, F.lit(""))).otherwise(name(3, F.col("code")))})


def lockout_pieces(tries: DataFrame, limits: dict[str, int], minutes: int, key: str | None = None, recorded: DataFrame | None = None) -> DataFrame:
    """The failures that have to be replayed, in pieces that know nothing of one another: piece, at_us, try_id, first, second, kept (and the key).

    Time is cut into cells of one window. Where the failures that an identifier could
    have in a cell and the two before it are fewer than its limit, it blocks nothing, and
    whatever failed was recorded: nothing needs replay there, and the next cell starts
    from a known state. The other cells of an identifier, each with the one before it,
    make stretches. Failures that count for two identifiers link the stretches of both;
    linked stretches are one piece. An identifier is null where it has no stretch; a
    recorded failure has a row for each of its identifiers.
    """
    window = minutes * 60_000_000
    own = [key] if key else []
    shaped = lambda rows, name, kept: rows.select(*own, F.col("at_us").cast("long").alias("at_us"), name.cast(tries.schema["id"].dataType).alias("try_id"), "first", "second", F.lit(kept).alias("kept"), F.floor(F.col("at_us") / window).alias("cell"))
    failed = shaped(with_identifiers(tries, key).where(~F.coalesce(F.col("successful"), F.lit(False))), F.col("id"), False)
    if recorded is not None:
        known = with_identifiers(recorded, key).select(*recorded.columns, F.explode(F.array("first", "second")).alias("first"), F.lit(None).cast("string").alias("second"))
        failed = failed.unionByName(shaped(known, F.col("id") if "id" in recorded.columns else F.lit(None), True))
    counted = failed.select("cell", F.explode(F.array("first", "second")).alias("who")).where("who is not null").groupBy("who", "cell").agg(F.count("*").alias("n"))
    most = F.create_map(*[F.lit(x) for place, kind in enumerate(CHECKED) if kind in limits for x in (str(place), limits[kind])])[F.substring("who", 1, 1)]
    around = counted.select("who", "n", F.explode(F.array(*[F.col("cell") + k for k in range(3)])).alias("cell")).groupBy("who", "cell").agg(F.sum("n").alias("n"))
    cells = around.where(F.col("n") >= most).select("who", F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("cell")).distinct()
    turn = F.row_number().over(Window.partitionBy("who").orderBy("cell"))
    shared_folder(tries.sparkSession)
    stretches = cells.select("who", "cell", F.xxhash64("who", F.col("cell") - turn).alias("stretch")).checkpoint()
    inside = failed
    for name, at in (("first", "u"), ("second", "v")):
        inside = inside.join(stretches.select(F.col("who").alias(name), "cell", F.col("stretch").alias(at)), [name, "cell"], "left")
    inside = inside.where("u is not null or v is not null").select(*own, "at_us", "try_id", F.when(F.col("u").isNotNull(), F.col("first")).alias("first"), F.when(F.col("v").isNotNull(), F.col("second")).alias("second"), "kept", "u", "v").checkpoint()
    linked = inside.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    stretch = inside.withColumn("stretch", F.coalesce("u", "v"))
    found = stretch.join(connected(linked).withColumnRenamed("node", "stretch"), "stretch", "left")
    return found.select(*own, F.coalesce("component", "stretch").alias("piece"), "at_us", "try_id", "first", "second", "kept")


@with_plain_unions
def login_lockout(tries: DataFrame, limits: dict[str, int] = C.LOGIN_LIMITS, minutes: int = C.FAILURE_WINDOW_MINUTES, key: str | None = None, recorded: DataFrame | None = None) -> DataFrame:
    """Tries that are blocked, with the identifier that blocks them: (id, blocked_by), and the key if there is one.

    tries: id, at_us, successful, admin, code, client. A student's try is checked against
    the failures of its client, then of its code; an admin's against those of its client,
    then of all admins. A blocked try is not recorded; a failure counts for both
    identifiers, a success for neither. Identifiers are global, or meet only within a
    ``key`` (such as a school). ``recorded`` are failures of an earlier part of the log
    (its columns but successful), which count as they are.

    Only the failures of ``lockout_pieces`` are replayed, in order of (at_us, id), each
    piece on its own. A piece under attack without a pause of three windows is one sequence
    by its nature; its replay keeps the failures of one window. It tells from when to when
    an identifier is blocked. Successes change nothing, so that they are only looked up there.
    """
    window = minutes * 60_000_000
    own = [key] if key else []
    rows = lockout_pieces(tries, limits, minutes, key, recorded)

    def step(state: dict, row: tuple) -> tuple | None:
        at, name, first, second, kept, realm = row
        recent, checks = state["failures"], [who for who in (first, second) if who is not None]
        if len(recent) > state["sweep"]:  # identifiers that were not tried again
            for who in [w for w, times in recent.items() if not times or times[-1] < at - window]:
                del recent[who]
            state["sweep"] = 1024 + 2 * len(recent)
        for who in checks if not kept else ():
            failures = recent.setdefault(who, [])
            while failures and failures[0] < at - window:
                failures.pop(0)
            if len(failures) >= limits[CHECKED[int(who[0])]]:
                return realm, name, at, kept, int(who[0]), None
        full = []
        for who in checks:
            failures, most = recent.setdefault(who, []), limits[CHECKED[int(who[0])]]
            failures.append(at)
            if len(failures) >= most:
                full.append({"who": who, "until": failures[-most] + window})
        return (realm, name, at, kept, None, full) if full else None

    rows = rows.withColumn("within", F.col(key) if key else F.lit(None).cast("string"))
    number = tries.schema["id"].dataType.simpleString()
    schema = f"within {rows.schema['within'].dataType.simpleString()}, id {number}, since long, known boolean, found int, full array<struct<who:string,until:bigint>>"
    told = fold_sorted(rows.drop(*own), ["piece"], ["at_us", F.desc("kept"), F.asc_nulls_first("try_id")], ["at_us", "try_id", "first", "second", "kept", "within"], lambda: {"failures": {}, "sweep": 1024}, step, schema)
    told = told.withColumnRenamed("within", key or "within").checkpoint()
    # A success is blocked where its identifier became so before it, in the same order, and still is; a block lasts one window at most, so it lies in two cells.
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / window), F.floor(b / window))).alias("cell")
    blocks = told.where("found is null").select("since", "known", F.col("id").alias("by"), F.explode("full").alias("x"))
    blocks = blocks.select("x.who", cells(F.col("since"), F.col("x.until")), F.struct("since", "known", "by", "x.until").alias("block")).groupBy("who", "cell").agg(F.collect_list("block").alias("blocks"))
    asked = with_identifiers(tries, key).where(F.coalesce(F.col("successful"), F.lit(False))).select(*own, "id", F.col("at_us").cast("long").alias("at_us"), F.explode(F.array("first", "second")).alias("who"))
    asked = asked.withColumn("cell", F.floor(F.col("at_us") / window)).join(blocks, ["who", "cell"])
    earlier = lambda x: F.when(x["since"] != F.col("at_us"), x["since"] < F.col("at_us")).when(x["known"], F.lit(True)).when(x["by"].isNull(), F.col("id").isNotNull()).otherwise(F.coalesce(x["by"] < F.col("id"), F.lit(False)))
    asked = asked.where(F.exists("blocks", lambda x: (x["until"] >= F.col("at_us")) & earlier(x))).select(*own, "id", F.substring("who", 1, 1).cast("int").alias("found"))
    found = told.where("found is not null").select(*own, "id", "found").unionByName(asked).groupBy(*own, "id").agg(F.min("found").alias("found"))
    return found.select(*own, "id", F.get(F.array(*[F.lit(kind) for kind in CHECKED]), F.col("found")).alias("blocked_by"))


def session_intervals(sessions: DataFrame, logouts: DataFrame, code_changes: DataFrame, deactivations: DataFrame) -> DataFrame:
    """Sessions with the instant at which they end and why: expiry, logout, change of the student's code, or deactivation of the student.

    sessions: id, student_id, created_at, expires_at. logouts: session_id, happened_at. The others: student_id, happened_at.
    Of the events of a student the first at or after a session's start closes it.
    """
    out = sessions
    for name, events, key, own in (("logout", logouts, "session_id", "id"), ("code_change", code_changes, "student_id", "student_id"), ("deactivated", deactivations, "student_id", "student_id")):
        rows = events.select(F.col(key).alias("ends"), F.col("happened_at").alias("ends_at"))
        first = sessions.select("id", own, "created_at").join(rows, F.col(own) == F.col("ends")).where(F.col("ends_at") >= F.col("created_at")).groupBy("id").agg(F.min("ends_at").alias(name))
        out = out.join(first, "id", "left")
    ended = F.least("expires_at", "logout", "code_change", "deactivated")
    why = F.when(F.col("logout") == ended, "logout").when(F.col("code_change") == ended, "code_change").when(F.col("deactivated") == ended, "deactivated").otherwise("expiry")
    return out.select("id", "student_id", "created_at", ended.alias("ended_at"), why.alias("reason"))
