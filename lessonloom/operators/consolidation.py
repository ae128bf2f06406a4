"""Merging entities into keepers, and removing entities with all that depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.session import with_plain_unions
from lessonloom.functions.text import lesson_label, lesson_number, part_number, part_suffix
from lessonloom.operators.tables import drop_redundant_on_relink, merge_word_states, ordered_text, pick_keeper, relink, renumber, surviving_links

#: Children that follow their passage to its keeper as they are.
FOLLOWERS = ("questions", "lookups", "translation_views", "saved_sentences")


def textbook_parts(passages: DataFrame) -> DataFrame:
    """(old, keeper, label, part) of textbook passages whose label ends in a part's number."""
    parts = passages.where((F.col("source_type") == "TEXTBOOK") & F.col("source_label").rlike(part_suffix()))
    parts = parts.withColumn("part", part_number(F.col("source_label")))
    keepers = pick_keeper(parts, lesson_label(F.col("source_label")), ["part", "display_order", "id"])
    return keepers.join(parts.select(F.col("id").alias("old"), "part"), "old")


@with_plain_unions
def consolidate_parts(passages: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after the parts of each lesson were merged into its first part.

    passages: id, title, source_type, source_label, source_text, display_order. children:
    links (exam_id, passage_id, position), saved_words (student_id, passage_id, word,
    meaning_key), word_states (student_id, passage_id, word, known, updated_at, created_at),
    sentences (id, passage_id, sentence_index, text), and the FOLLOWERS, each with passage_id.

    A link or saved word goes where the keeper has its equal; states of words are folded;
    sentences keep their ids and are numbered by part, then index; the keeper's title and
    label become the lesson's and its text is rebuilt; the other parts go.
    """
    parts = textbook_parts(passages)
    moved = parts.where("old <> keeper").select("old", "keeper")
    out = {
        "links": drop_redundant_on_relink(children["links"], moved, "passage_id", ["exam_id"]),
        "saved_words": drop_redundant_on_relink(children["saved_words"], moved, "passage_id", ["student_id", "word", "meaning_key"]),
        "word_states": merge_word_states(children["word_states"], moved),
    }
    sentences = children["sentences"].join(parts.select(F.col("old").alias("passage_id"), "keeper", "part"), "passage_id", "left")
    merged = sentences.where("keeper is not null").withColumn("passage_id", F.col("keeper")).withColumnRenamed("sentence_index", "old_index")
    merged = renumber(merged, "passage_id", ["part", "old_index", "id"], "sentence_index")
    out["sentences"] = merged.select(*children["sentences"].columns).unionByName(sentences.where("keeper is null").select(*children["sentences"].columns))
    for name in FOLLOWERS:
        out[name] = relink(children[name], moved, "passage_id")
    texts = ordered_text(out["sentences"].join(parts.select(F.col("keeper").alias("passage_id")).distinct(), "passage_id", "left_semi"), "passage_id", "sentence_index", "text").select(F.col("passage_id").alias("id"), F.col("source_text").alias("whole"))
    labels = parts.where("old = keeper").select(F.col("old").alias("id"), "label")
    kept = passages.join(moved.select(F.col("old").alias("id")), "id", "left_anti").join(labels, "id", "left").join(texts, "id", "left")
    merged_into = F.col("label").isNotNull()
    title, label, text = (F.when(merged_into, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("label", "title"), ("label", "source_label"), ("whole", "source_text")))
    out["passages"] = kept.select("id", title, "source_type", label, text, "display_order")
    return out


def textbook_lessons(passages: DataFrame) -> DataFrame:
    """Adds lesson, read from source_type, title and source_label."""
    return passages.withColumn("lesson", lesson_number(F.col("source_type"), F.col("title"), F.col("source_label")))


@with_plain_unions
def relink_aliases(passages: DataFrame, questions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, changed links, errors) after every scope points to the passage of its lesson that has the questions.

    passages: id, created_at, and lesson (null: none) or what ``textbook_lessons`` reads it
    from. A lesson's keeper has most available
    questions, then the first creation, then the least id; one without any is an error, as
    is a scope that does not end on its keeper.
    """
    passages = passages if "lesson" in passages.columns else textbook_lessons(passages)
    available = questions.where("status = 'available'").groupBy(F.col("passage_id").alias("id")).agg(F.count("*").alias("available"))
    counted = passages.where("lesson is not null").join(available, "id", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    keepers = pick_keeper(counted, F.col("lesson"), [F.desc("available"), "created_at", "id"])
    aliases = keepers.select(F.col("old").alias("passage_id"), F.col("label").alias("lesson"), "keeper")
    empty = aliases.where("passage_id = keeper").join(counted.where("available = 0").select(F.col("id").alias("passage_id")), "passage_id", "left_semi")
    after, changed, failed = surviving_links(links, aliases)
    errors = empty.select(F.col("lesson").cast("string").alias("lesson"), F.lit(None).cast("long").alias("exam_id"), F.lit("keeper_without_questions").alias("error"))
    return after, changed, errors.unionByName(failed.select(F.col("lesson").cast("string").alias("lesson"), F.col("exam_id").cast("long").alias("exam_id"), F.lit("scope_without_keeper").alias("error")))


# --- cascades ---------------------------------------------------------------------

#: Tables that lose the rows of a deleted student, and of a deleted passage; of a passage also those of its questions.
OF_STUDENT = ("workbook_bookmarks", "attempts", "workbook_grading", "question_bookmarks", "grading", "question_attempts", "saved_words", "word_states", "saved_sentences", "lookups", "translation_views", "sessions", "progress", "clears")
OF_PASSAGE = ("workbook_bookmarks", "attempts", "workbook_grading", "saved_words", "word_states", "saved_sentences", "lookups", "translation_views", "links", "sentences", "progress", "clears")
OF_QUESTIONS = ("question_bookmarks", "grading", "question_attempts", "publication_questions")


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias("gone")).distinct(), F.col(column) == F.col("gone"), "left_anti")


def cascade_delete(kind: str, tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(every table without what depends on the deleted students or passages, ids that are none).

    tables: by name, those there are, with student_id and passage_id, or question_id; also
    students or passages, questions, logins (identifier student:<id>), and saved_word_senses
    (saved_word_id, a saved word's id).
    """
    out = dict(tables)
    parents = "students" if kind == "student" else "passages"
    gone = ids.select("id").distinct()
    unknown = gone.join(tables[parents].select("id"), "id", "left_anti")
    out[parents] = without(tables[parents], "id", gone)
    for name in OF_STUDENT if kind == "student" else OF_PASSAGE:
        if name in tables:
            out[name] = without(out[name], f"{kind}_id", gone)
    if "saved_word_senses" in tables and "saved_words" in tables:  # senses go with their word
        words = tables["saved_words"].join(gone.select(F.col("id").alias(f"{kind}_id")), f"{kind}_id", "left_semi").select("id")
        out["saved_word_senses"] = without(tables["saved_word_senses"], "saved_word_id", words)
    if kind == "student" and "logins" in tables:
        out["logins"] = without(tables["logins"], "identifier", gone.select(F.concat(F.lit("student:"), F.col("id").cast("string")).alias("id")))
    if kind == "passage" and "questions" in tables:
        questions = tables["questions"].join(gone.select(F.col("id").alias("passage_id")), "passage_id", "left_semi").select("id")
        out["questions"] = without(tables["questions"], "passage_id", gone)
        for name in OF_QUESTIONS:
            if name in tables:
                out[name] = without(out[name], "question_id", questions)
    return out, unknown
