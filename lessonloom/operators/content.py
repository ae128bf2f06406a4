"""Versioned content: editor matching, structure merges, saves, drafts, publication and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.functions.session import few, once, shared_folder, with_plain_unions
from lessonloom.functions.text import flatten_space, json_put
from lessonloom.operators.rules import passage_rules, row_rules, violations, with_group_size, with_owned
from lessonloom.operators.tables import global_rank, ordered_text
from lessonloom.sources.readers import upsert


def match_editor_rows(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Ids for edited rows: that of the first previous row of equal flattened text (once), else that of the row at the same place if it was not taken.

    previous: passage_id, position, id, text. following: passage_id, position, text.
    """
    by_text = Window.partitionBy("passage_id", "flat").orderBy("position")
    prev = previous.withColumn("flat", flatten_space(F.col("text")))
    sources = prev.where("id is not null").withColumn("turn", F.row_number().over(by_text)).where("turn = 1").select("passage_id", "flat", F.col("id").alias("text_id"), F.col("position").alias("text_at"), F.lit(1).alias("turn"))
    nexts = following.withColumn("flat", flatten_space(F.col("text"))).withColumn("turn", F.row_number().over(by_text))
    first = nexts.join(sources, ["passage_id", "flat", "turn"], "left")
    taken = first.where("text_at is not null").select("passage_id", F.col("text_at").alias("position"))
    places = previous.where("id is not null").select("passage_id", "position", F.col("id").alias("place_id")).join(taken, ["passage_id", "position"], "left_anti")
    return first.join(places, ["passage_id", "position"], "left").select("passage_id", "position", F.coalesce("text_id", "place_id").alias("matched_id"))


@with_plain_unions
def merge_structure(current: DataFrame, following: DataFrame) -> DataFrame:
    """Sentence rows of an edit with the TITLE and SUBTITLE rows of the stored version around them, in their new order.

    current: passage_id, sentence_index, id, block_type, paragraph_index. following: passage_id, position, id.
    Structural rows before the first sentence lead; others go before the next kept
    sentence of the stored order, or to the end. A kept sentence keeps its paragraph, a
    new one takes that of the row before it. position is that of the edit, null for structural rows.
    """
    held = current.select("passage_id", "id", F.lit(0).alias("own"), F.col("sentence_index").cast("long").alias("sentence_index"), "block_type", "paragraph_index", F.lit(None).cast("long").alias("position"))
    named = following.select("passage_id", "id", F.lit(1).alias("own"), F.lit(0).cast("long").alias("sentence_index"), F.lit("SENTENCE").alias("block_type"), F.lit(None).cast(current.schema["paragraph_index"].dataType).alias("paragraph_index"), F.col("position").cast("long").alias("position"))
    # Dealt once: what follows is of one passage, or of one id in it.
    rows = held.unionByName(named).repartition("passage_id").withColumn("is_sentence", F.col("block_type") == "SENTENCE")
    one = Window.partitionBy("passage_id", "id")
    there = F.col("id").isNotNull()
    # A sentence's id may be named twice in an edit; structural rows go before the first.
    rows = rows.withColumns({"kept": there & (F.max("own").over(one) == 1), "first": F.min("position").over(one), "stored_paragraph": F.when(there, F.max("paragraph_index").over(one))})
    stored = Window.partitionBy("passage_id", "own").orderBy("sentence_index")
    anchor = F.first(F.when(F.col("is_sentence") & F.col("kept"), F.struct("first")), ignorenulls=True).over(stored.rowsBetween(1, Window.unboundedFollowing))
    seen = F.max(F.col("is_sentence").cast("int")).over(stored.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"spot": anchor["first"], "seen": F.coalesce(seen, F.lit(0))}).where("own = 1 or not is_sentence")
    edit = F.col("own") == 1
    zone = F.when(edit, 1).when(F.col("seen") == 0, 0).when(F.col("spot").isNotNull(), 1).otherwise(2)
    spot = F.when(edit, F.col("position")).otherwise(F.coalesce("spot", F.lit(-1)))
    both = rows.select("passage_id", "id", "block_type", F.when(edit, F.col("stored_paragraph")).otherwise(F.col("paragraph_index")).alias("paragraph_index"), "position", zone.alias("zone"), spot.alias("spot"), "own", "sentence_index")
    order = Window.partitionBy("passage_id").orderBy("zone", "spot", "own", "sentence_index")
    carried = F.coalesce(F.last("paragraph_index", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return both.select("passage_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "id", "block_type", carried.alias("paragraph_index"), "position")


def revision_diff(previous: DataFrame, following: DataFrame) -> DataFrame:
    """added, kept, edited or deactivated, per sentence id."""
    a = previous.select("id", F.col("text").alias("was"), F.lit(True).alias("before"))
    b = following.select("id", F.col("text").alias("now"), F.lit(True).alias("after"))
    both = a.join(b, "id", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deactivated").when(F.col("was") == F.col("now"), "kept").otherwise("edited")
    return both.select("id", change.alias("change"))


STORED_ROW = ["passage_id", "id", "sentence_index", "text", "translation", "block_type", "paragraph_index", "active"]


@with_plain_unions
def save_passages(passages: DataFrame, stored: DataFrame, requests: DataFrame, rows: DataFrame, most: int = 160) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, rows, outcomes) after the saves of an editor.

    passages: id, title, grade, source_label, source_text, revision. stored: the columns of
    STORED_ROW, ids as text. requests, one a passage: passage_id, title, grade, source_type,
    source_year, source_month, source_label, expected_revision (null: no check).
    rows: passage_id, position, id, text, translation.

    A save is refused for the first of: invalid_passage, invalid_rows, unknown, conflict,
    too_many_rows, foreign_rows. An accepted one puts its rows into the stored structure;
    rows that it leaves out become inactive and move to 1,000,000 and their former rank; the
    passage gets the given fields, a new source text and the next revision.
    """
    # Ids and places only; what an edit names, once for its size and its rows.
    merged = once(merge_structure(stored.where("active"), rows))
    rules = row_rules(most)
    many, foreign = rules.pop("row_count"), rules.pop("owned")
    faulty = F.array_contains(F.array(*[F.coalesce(bad, F.lit(True)) for bad in rules.values()]), True)
    # Texts are judged where they lie.
    judged = with_owned(rows.withColumns({"block_type": F.lit("SENTENCE"), "paragraph_index": F.lit(0)}).select("passage_id", "id", faulty.alias("faulty")), stored)
    by_passage = judged.groupBy("passage_id").agg(F.count("*").alias("group_size"), F.bool_or("faulty").alias("faulty"), F.bool_or(foreign).alias("foreign"))
    by_passage = by_passage.select("passage_id", (F.col("faulty") | many).alias("bad"), "foreign")
    sizes = merged.groupBy("passage_id").agg(F.count("*").alias("merged"))
    asked = violations(requests, passage_rules()).join(by_passage, "passage_id", "left").join(sizes, "passage_id", "left").join(passages.select(F.col("id").alias("passage_id"), "revision"), "passage_id", "left")
    outcome = (
        F.when(F.size("violations") > 0, "invalid_passage")
        .when(F.coalesce("bad", F.lit(True)), "invalid_rows")
        .when(F.col("revision").isNull(), "unknown")
        .when(F.col("expected_revision") != F.col("revision"), "conflict")
        .when(F.col("merged") > most, "too_many_rows")
        .when(F.col("foreign"), "foreign_rows")
        .otherwise("saved")
    )
    asked = asked.withColumn("outcome", outcome).checkpoint()
    accepted = asked.where("outcome = 'saved'").select("passage_id", (F.col("revision") + 1).alias("next"), *[F.trim(c).alias(f"new_{c}") for c in ("title", "grade")], F.trim(F.coalesce("source_label", F.lit(""))).alias("new_label"))
    here = few(once(accepted.select("passage_id", "next")))
    new_id = F.coalesce("id", F.sha2(F.concat_ws(":", "passage_id", "next", "place"), 256))
    saved = merged.join(here, "passage_id").withColumns({"stays": F.col("position").isNull() & F.col("id").isNotNull(), "id": new_id, "paragraph_index": F.col("paragraph_index").cast("int")})
    texts = rows.join(here, "passage_id", "left_semi").select("passage_id", F.col("position").cast("long").alias("position"), F.trim("text").alias("text"), F.trim("translation").alias("translation"))
    edited = saved.where("not stays").join(texts, ["passage_id", "position"], "left")
    edited = edited.select("passage_id", "id", F.col("place").alias("sentence_index"), "text", "translation", "block_type", "paragraph_index", F.lit(True).alias("active"))
    # Stored rows of a save: structural ones keep their text at their new place, sentences that are named are replaced, the others are gone.
    mine = stored.join(here, "passage_id", "left_semi").select(*STORED_ROW, F.lit(0).alias("side"))
    places = saved.select("passage_id", "id", F.lit(1).alias("side"), F.when(F.col("stays"), F.struct("place", "paragraph_index")).alias("at"))
    both = mine.unionByName(places, allowMissingColumns=True).repartition("passage_id")
    one, ranks = Window.partitionBy("passage_id", "id"), Window.partitionBy("passage_id", "side").orderBy("sentence_index", "id")
    both = both.withColumns({"named": F.max("side").over(one), "at": F.max("at").over(one), "rank": F.row_number().over(ranks).cast("long")}).where("side = 0 and (named = 0 or at is not null)")
    stays = F.col("at").isNotNull()
    left = both.withColumns({"sentence_index": F.when(stays, F.col("at.place")).otherwise(1_000_000 + F.col("rank")), "paragraph_index": F.when(stays, F.col("at.paragraph_index")).otherwise(F.col("paragraph_index")), "active": stays})
    untouched = stored.join(here, "passage_id", "left_anti")
    after = edited.unionByName(left.select(*STORED_ROW)).unionByName(untouched.select(*STORED_ROW))
    sources = ordered_text(edited, "passage_id", "sentence_index", "text").withColumnRenamed("source_text", "new_source")
    changed = passages.join(accepted.withColumnRenamed("passage_id", "id"), "id", "left").join(sources.withColumnRenamed("passage_id", "id"), "id", "left")
    take = lambda new, old: F.when(F.col("next").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    fields = [take("new_title", "title"), take("new_grade", "grade"), take("new_label", "source_label"), take("new_source", "source_text"), F.coalesce("next", "revision").alias("revision")]
    return changed.select("id", *fields, F.when(F.col("next").isNotNull(), "pending").otherwise("current").alias("status")), after, asked.select("passage_id", "outcome", "revision")


def reject_stale(edits: DataFrame, passages: DataFrame) -> DataFrame:
    """accepted, conflict or unknown per edit; of several edits of one passage the first that fits is accepted, the rest conflict.

    edits: edit_id, passage_id, expected_revision (null: no check). passages: id, revision.
    """
    rows = edits.join(passages.select(F.col("id").alias("passage_id"), "revision"), "passage_id", "left")
    fits = F.col("revision").isNotNull() & (F.col("expected_revision").isNull() | (F.col("expected_revision") == F.col("revision")))
    turn = F.row_number().over(Window.partitionBy("passage_id", "fits").orderBy("edit_id"))
    judged = rows.withColumn("fits", fits).withColumn("turn", turn)
    # After an accepted edit the revision is one higher; only an unchecked edit still fits then.
    outcome = F.when(F.col("revision").isNull(), "unknown").when(F.col("fits") & ((F.col("turn") == 1) | F.col("expected_revision").isNull()), "accepted").otherwise("conflict")
    return judged.select("edit_id", "passage_id", "revision", outcome.alias("outcome"))


def create_passages(requests: DataFrame, rows: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new passages, their rows, refused requests with violations).

    requests: request_id (a number without repeats), title, grade, source_type, source_year,
    source_month, source_label. rows: request_id, ordinal (from 1), text, translation,
    block_type (null: SENTENCE), paragraph_index. Ids are made of the request; passages come
    after the last of those there are, in the order of requests.
    """
    whole = rows.withColumns({"block_type": F.coalesce("block_type", F.lit("SENTENCE")), "owned": F.lit(None).cast("boolean")})
    judged_rows = violations(with_group_size(whole, "request_id"), row_rules())
    bad = judged_rows.groupBy("request_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("violations", lambda v: F.concat(F.lit("row_"), v)))))).alias("row_violations"))
    judged = violations(requests, passage_rules()).join(bad, "request_id", "left")
    judged = judged.withColumn("violations", F.concat("violations", F.coalesce("row_violations", F.array(F.lit("row_count")))))
    good = judged.where(F.size("violations") == 0)
    id_of = F.sha2(F.concat(F.lit("passage:"), F.col("request_id").cast("string")), 256)
    top = passages.agg((F.coalesce(F.max("display_order"), F.lit(-1)) + 1).alias("top"))
    kept = judged_rows.join(good.select("request_id"), "request_id", "left_semi").withColumn("text", F.trim("text"))
    source = ordered_text(kept.where("block_type = 'SENTENCE'"), "request_id", "ordinal", "text")
    placed = global_rank(good.select("request_id"), "request_id", "rank").crossJoin(F.broadcast(top))
    made = good.join(placed, "request_id").join(source, "request_id", "left")
    new = made.select(id_of.alias("id"), "request_id", F.trim("title").alias("title"), F.trim("grade").alias("grade"), "source_type", F.trim(F.coalesce("source_label", F.lit(""))).alias("source_label"), "source_text", (F.col("top") + F.col("rank")).alias("display_order"))
    new_rows = kept.select(id_of.alias("passage_id"), (F.col("ordinal") - 1).alias("sentence_index"), "text", F.trim(F.coalesce("translation", F.lit(""))).alias("translation"), "block_type", F.coalesce("paragraph_index", F.lit(0)).alias("paragraph_index"))
    return new, new_rows, judged.where(F.size("violations") > 0).select("request_id", "violations")


def publish(drafts: DataFrame, passages: DataFrame, catalogs: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalogs, passages, refused drafts): a draft of the passage's current revision becomes its catalog, others are refused.

    drafts: passage_id, expected_revision, workbook_key, catalog. passages: id, revision, status,
    catalog_revision. catalogs: passage_id, workbook_key, catalog, revision. keys (passage_id, if
    none are given) are of drafts and catalogs; there is one catalog a key.
    """
    keys = keys or ["passage_id"]
    judged = drafts.join(passages.select(F.col("id").alias("passage_id"), "revision"), "passage_id", "left").withColumn("fits", F.coalesce(F.col("expected_revision") == F.col("revision"), F.lit(False)))
    fresh = judged.where("fits").select(*keys, "workbook_key", "catalog", "revision")
    after = upsert(catalogs, fresh, keys, ["workbook_key", "catalog", "revision"])
    told = passages.join(fresh.select(F.col("passage_id").alias("id"), F.col("revision").alias("published")), "id", "left")
    told = told.withColumns({"status": F.when(F.col("published").isNotNull(), "current").otherwise(F.col("status")), "catalog_revision": F.coalesce("published", "catalog_revision")}).drop("published")
    return after, told, judged.where("not fits").select("passage_id", F.when(F.col("revision").isNull(), "unknown").otherwise("conflict").alias("reason"))


def studio_save(saves: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, refused saves): a save of the current revision and version replaces the state, with the next version in it.

    saves: passage_id, expected_revision, expected_version, state (JSON). passages: id, revision, state (JSON or null: version 0).
    """
    version = F.coalesce(F.get_json_object("state", "$.version").cast("long"), F.lit(0))
    now = passages.select(F.col("id").alias("passage_id"), "revision", version.alias("version"))
    judged = saves.join(now, "passage_id", "left")
    reason = F.when(F.col("revision").isNull(), "unknown").when(~F.col("expected_revision").eqNullSafe(F.col("revision")), "revision").when(~F.col("expected_version").eqNullSafe(F.col("version")), "version")
    judged = judged.withColumn("reason", reason)
    # jsonb keeps what is saved and sets the version
    fresh = judged.where("reason is null").select(F.col("passage_id").alias("id"), json_put(F.coalesce("state", F.lit("{}")), ["version"], (F.col("version") + 1).cast("string")).alias("fresh"))
    after = passages.join(fresh, "id", "left").withColumn("state", F.coalesce("fresh", "state")).drop("fresh")
    return after, judged.where("reason is not null").select("passage_id", "reason")


def create_drafts(jobs: DataFrame, rows: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs with their passage, new passages, their rows, refused): a job that has a passage already keeps it.

    jobs: job_id, passage_id, and the fields of ``create_passages``; rows: request_id = job_id and the rest.
    """
    due = jobs.where("passage_id is null").withColumnRenamed("job_id", "request_id")
    new, new_rows, refused = create_passages(due.drop("passage_id"), rows.join(due.select("request_id"), "request_id", "left_semi"), passages)
    told = jobs.join(new.select(F.col("request_id").alias("job_id"), F.col("id").alias("made")), "job_id", "left")
    return told.withColumn("passage_id", F.coalesce("passage_id", "made")).drop("made"), new, new_rows, refused


def publisher_import(given: DataFrame, stored: DataFrame) -> DataFrame:
    """Per passage whether it is new and valid, or its active rows equal the input row by row (number, index, text, translation), or differ, or is invalid.

    both: passage_id, id, sentence_index, text, translation; given: block_type, paragraph_index.
    """
    value = F.struct("id", "text", "translation")
    a = given.select("passage_id", "sentence_index", value.alias("a"))
    b = stored.select("passage_id", "sentence_index", value.alias("b"))
    both = a.join(b, ["passage_id", "sentence_index"], "full")
    counts = both.groupBy("passage_id").agg(F.count("a").alias("given"), F.count("b").alias("stored"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))
    judged = violations(with_group_size(given.withColumn("owned", F.lit(None).cast("boolean")), "passage_id"), row_rules())
    bad = judged.groupBy("passage_id").agg(F.bool_or((F.size("violations") > 0) | F.col("id").isNull()).alias("bad"))
    state = F.when(F.col("stored") == 0, F.when(F.col("bad"), "invalid").otherwise("new")).when((F.col("given") == F.col("stored")) & (F.col("equal") == F.col("given")), "verified").otherwise("differs")
    return counts.where("given > 0").join(bad, "passage_id").select("passage_id", state.alias("state"))


@with_plain_unions
def apply_imports(jobs: DataFrame, rows: DataFrame, passages: DataFrame, sentences: DataFrame, catalogs: DataFrame, waiting: str = "review_required", done: str = "ready") -> dict[str, DataFrame]:
    """Tables after a publisher's imports, and refused (job_id, reason): each job in full or not at all.

    A job makes a new passage with its rows, or finds the passage's active rows equal to
    its own; then revision and version must be those that it expects. It sets the state
    with the next version, publishes its catalog, and is done; older done jobs of its
    source fail. Of several good jobs for one passage the least id goes in.

    jobs: id, status, passage_id, create_new, expected_revision, expected_version, title,
    grade, source_type, source_label, state and catalog (JSON), source, finished_at.
    rows: job_id, id, sentence_index, text, translation, block_type, paragraph_index.
    passages: id, title, grade, source_type, source_label, source_text, display_order,
    revision, state, status, catalog_revision. sentences: passage_id, id, sentence_index,
    text, translation, block_type, paragraph_index, active. catalogs: passage_id,
    workbook_key, catalog, revision, job_id.
    """
    mine = rows.withColumnRenamed("job_id", "passage_id").withColumn("block_type", F.coalesce("block_type", F.lit("SENTENCE")))
    held = sentences.where("active").join(jobs.select(F.col("id").alias("job"), "passage_id"), "passage_id")
    stored = held.select(F.col("job").alias("passage_id"), "id", "sentence_index", "text", "translation")
    states = publisher_import(mine, stored).select(F.col("passage_id").alias("id"), F.col("state").alias("import_state"))
    counts = rows.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n"))
    version = F.coalesce(F.get_json_object("state", "$.version").cast("long"), F.lit(0))
    there = passages.select(F.col("id").alias("passage_id"), "revision", version.alias("version"), F.lit(True).alias("there"))
    known = jobs.join(states, "id", "left").join(counts, "id", "left").join(there, "passage_id", "left")
    new, exists = F.col("create_new"), F.col("there").isNotNull()
    reason = (
        F.when(F.col("status") != waiting, "not_waiting")
        .when(~F.coalesce(F.col("n"), F.lit(0)).between(1, 160), "rows")
        .when(new & exists, "exists")
        .when(new & (F.col("import_state") == "invalid"), "invalid_rows")
        .when(~new & (~exists | (F.col("import_state") != "verified")), "differs")
        .when(F.when(new, 1).otherwise(F.col("revision")) != F.col("expected_revision"), "revision")
        .when(F.when(new, 0).otherwise(F.col("version")) != F.col("expected_version"), "version")
    )
    judged = known.withColumn("reason", reason)
    turn = F.row_number().over(Window.partitionBy("passage_id", F.col("reason").isNull()).orderBy("id"))
    late = F.col("reason").isNull() & (turn > 1)
    shared_folder(jobs.sparkSession)
    judged = judged.withColumn("reason", F.when(late, F.when(new, "exists").otherwise("version")).otherwise(F.col("reason"))).checkpoint()
    fine = judged.where("reason is null")
    made = fine.where("create_new")
    top = passages.agg((F.coalesce(F.max("display_order"), F.lit(-1)) + 1).alias("top"))
    ranked = global_rank(made.select("id"), "id", "rank").crossJoin(F.broadcast(top))
    own = mine.withColumnRenamed("passage_id", "job").join(made.select(F.col("id").alias("job"), "passage_id"), "job").withColumn("text", F.trim("text"))
    source = ordered_text(own.where("block_type = 'SENTENCE'"), "passage_id", "sentence_index", "text")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    put = json_put(F.coalesce("state", F.lit("{}")), ["version"], (F.col("expected_version") + 1).cast("string"))
    fresh = fine.select(F.col("passage_id").alias("id"), put.alias("put"), F.col("expected_revision").alias("published"))
    added = made.join(ranked, "id").join(source, "passage_id", "left").select(F.col("passage_id").alias("id"), F.trim("title").alias("title"), text("grade").alias("grade"), F.coalesce("source_type", F.lit("MOCK_EXAM")).alias("source_type"), text("source_label").alias("source_label"), "source_text", (F.col("top") + F.col("rank")).alias("display_order"), F.lit(1).alias("revision"), F.lit(None).cast("string").alias("state"), F.lit("pending").alias("status"), F.lit(None).cast("long").alias("catalog_revision"))
    after = passages.unionByName(added.select(*[F.col(c).cast(passages.schema[c].dataType).alias(c) for c in passages.columns])).join(fresh, "id", "left")
    told = after.withColumns({"state": F.coalesce("put", "state"), "status": F.when(F.col("put").isNotNull(), "current").otherwise(F.col("status")), "catalog_revision": F.coalesce("published", "catalog_revision")}).select(*passages.columns)
    new_rows = own.select("passage_id", "id", "sentence_index", "text", text("translation").alias("translation"), "block_type", F.coalesce("paragraph_index", F.lit(0)).alias("paragraph_index"), F.lit(True).alias("active"))
    published = fine.select("passage_id", F.get_json_object("catalog", "$.workbookKey").alias("workbook_key"), "catalog", F.col("expected_revision").alias("revision"), F.col("id").alias("job_id"))
    finished = jobs.join(fine.select("id", F.lit(True).alias("fine")), "id", "left").withColumn("status", F.when(F.col("fine"), done).otherwise(F.col("status"))).drop("fine")
    return {
        "jobs": supersede(finished, done),
        "passages": told,
        "sentences": sentences.unionByName(new_rows.select(*sentences.columns)),
        "catalogs": upsert(catalogs, published.select(*catalogs.columns), ["passage_id"], ["workbook_key", "catalog", "revision", "job_id"]),
        "refused": judged.where("reason is not null").select(F.col("id").alias("job_id"), "reason"),
    }


def finish_jobs(jobs: DataFrame, states: DataFrame, waiting: str, done: str, failed: str = "failed") -> DataFrame:
    """Jobs after an import: a waiting one whose passage is new or verified is done, one whose passage is not has failed; of several done jobs of one source the latest stays, the older fail.

    jobs: id, passage_id, source, status, finished_at. states: passage_id, state.
    """
    judged = jobs.join(states, "passage_id", "left")
    fine = F.col("state").isin("new", "verified")
    status = F.when((F.col("status") == waiting) & fine, done).when((F.col("status") == waiting) & F.col("state").isNotNull(), failed).otherwise(F.col("status"))
    return supersede(judged.withColumn("status", status).drop("state"), done, failed)


def supersede(jobs: DataFrame, done: str, failed: str = "failed") -> DataFrame:
    """Of several done jobs of one source the latest stays so; the older fail. A job without a source stays as it is."""
    turn = F.row_number().over(Window.partitionBy("source", "status").orderBy(F.desc("finished_at"), F.desc("id")))
    older = (F.col("status") == done) & F.col("source").isNotNull() & (turn > 1)
    return jobs.withColumn("status", F.when(older, failed).otherwise(F.col("status")))


def propagate_updated_at(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    latest = children.groupBy(key).agg(F.max("updated_at").alias("child_at"))
    return parents.join(latest, parents["id"] == latest[key], "left").select("id", F.greatest("updated_at", "child_at").alias("updated_at"))


def word_changelog(events: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known flags, saved words left): the last event of a word decides; a known word is no longer saved.

    events: student_id, word, known, seen_at. saved: student_id, word, saved_at.
    """
    keys = ["student_id", "word"]
    last = events.groupBy(*keys).agg(F.max_by("known", "seen_at").alias("known"), F.max(F.when(F.col("known"), F.col("seen_at"))).alias("known_at"))
    left = saved.join(last.select(*keys, "known_at"), keys, "left").where("known_at is null or saved_at > known_at").select(*saved.columns)
    return last.where("known").select(*keys, F.lit(True).alias("known")), left
