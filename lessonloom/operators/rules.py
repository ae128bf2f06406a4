"""Validation: named rules per row, key and reference reports, and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom import constants as C
from lessonloom.functions.text import json_put

#: name -> condition under which a row violates the rule.
Rules = dict[str, Column]


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds the names of the rules that a row violates, in the rules' order; a rule that is null for a row is violated, so a required field is never null."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()])))


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    judged = violations(df, rules)
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def length_outside(column: str, low: int, high: int) -> Column:
    return ~F.char_length(F.trim(F.col(column).cast("string"))).between(low, high)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def unless_null(c: Column, bad: Column) -> Column:
    """A rule on an optional field."""
    return c.isNotNull() & bad


def json_size(c: Column) -> Column:
    """Elements of a JSON array; null for anything else."""
    return F.json_array_length(F.when(F.trim(c).startswith("["), c))


def pair_broken(pairs: dict[str, str]) -> Column:
    """Schools that go with one grade only."""
    bad = F.lit(False)
    for school, grade in pairs.items():
        bad = bad | ((F.trim("school") == school) & (F.trim("grade") != grade))
    return bad


def student_rules(name_most: int = 40, school_most: int = 80, grade_most: int = 40, pairs: dict[str, str] | None = None) -> Rules:
    rules = {"name": length_outside("name", 1, name_most), "school": length_outside("school", 1, school_most), "grade": length_outside("grade", 1, grade_most), "code": ~F.col("code").rlike(r"^\d{6}$")}
    return rules | {"fingerprint": ~F.col("fingerprint").rlike("^[0-9a-f]{64}$"), "pair": pair_broken(pairs or {})}


def passage_rules(title_most: int = 120) -> Rules:
    mock = (F.col("source_type") == "MOCK_EXAM") & (F.col("source_year").isNull() | F.col("source_month").isNull() | ~F.col("source_month").between(1, 12))
    return {"title": length_outside("title", 1, title_most), "grade": length_outside("grade", 1, 40), "source_type": ~F.col("source_type").isin("MOCK_EXAM", "TEXTBOOK"), "mock_exam": F.coalesce(mock, F.lit(False))}


def with_group_size(df: DataFrame, key: str) -> DataFrame:
    """Adds group_size, the rows of the key: a count and a join, so no key's rows meet in one task."""
    return df.join(df.groupBy(F.col(key).alias("size_key")).agg(F.count("*").alias("group_size")), F.col(key).eqNullSafe(F.col("size_key")), "left").drop("size_key")


def with_known(df: DataFrame, column: str, parent: DataFrame, key: str, name: str = "known") -> DataFrame:
    """Adds whether a reference points to a row of the parent (false where it is null)."""
    there = parent.select(F.col(key).alias("there")).distinct()
    return df.join(there, F.col(column) == F.col("there"), "left").withColumn(name, F.col("there").isNotNull()).drop("there")


def with_owned(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds owned: whether a row's id is a stored row of its passage; null for rows without an id."""
    there = stored.select("passage_id", "id").distinct().withColumn("there", F.lit(True))
    return rows.join(there, ["passage_id", "id"], "left").withColumn("owned", F.when(F.col("id").isNotNull(), F.col("there").isNotNull())).drop("there")


def row_rules(most: int = 160) -> Rules:
    """Rows of a passage; columns group_size and owned (null: a new row; else whether the id is a row of the passage)."""
    kind = F.col("block_type")
    return {
        "row_count": ~F.col("group_size").between(1, most),
        "text": length_outside("text", 1, 5000),
        "translation": (kind == "SENTENCE") & F.coalesce(length_outside("translation", 1, 5000), F.lit(True)),
        "block_type": ~F.upper(kind).isin("TITLE", "SUBTITLE", "SENTENCE"),
        "paragraph": unless_null(F.col("paragraph_index"), F.col("paragraph_index") < 0),
        "owned": unless_null(F.col("owned"), ~F.col("owned")),
    }


def question_rules(bundle_most: int = 500) -> Rules:
    """A bundle's rows: type, status, payload (JSON with source), known (its passage exists) and group_size (rows of the bundle)."""
    part = lambda key: F.get_json_object("payload", f"$.{key}")
    digits = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"^\d+$")
    choices, answers, accepted = (json_size(part(k)) for k in ("choices", "answer", "accepted_answers"))
    return {
        "row_count": ~F.col("group_size").between(1, bundle_most),
        "passage": ~F.col("known"),
        "type": ~F.col("type").isin("multiple_choice", "written_response"),
        "status": ~F.coalesce(F.nullif("status", F.lit("")), F.lit("draft")).isin("draft", "available"),
        "prompt": blank(part("prompt")),
        "exam": blank(part("source.exam")),
        "section": blank(part("source.section")),
        "passage_no": digits(part("source.passage_no")),
        "question_no": digits(part("source.source_question_no")),
        "choices": F.coalesce(F.col("type") == "multiple_choice", F.lit(False)) & F.coalesce(~choices.between(2, 8) | (answers < 1), F.lit(True)),
        "accepted": F.coalesce(F.col("type") == "written_response", F.lit(False)) & F.coalesce(accepted < 1, F.lit(True)),
    }


def explanation_rules(bundle_most: int = 500) -> Rules:
    return {"row_count": ~F.col("group_size").between(1, bundle_most), "exam": blank(F.col("exam")), "section": blank(F.col("section")), "text": blank(F.col("text")), "number": ~F.coalesce(F.col("number"), F.lit("")).rlike(r"^\d+$")}


def lookup_rules(kinds: tuple[str, ...] = ("word", "phrase")) -> Rules:
    start, end, kind, sure = (F.col(c) for c in ("start_offset", "end_offset", "kind", "confidence"))
    placed = (start.isNull() & end.isNull()) | F.coalesce((start >= 0) & (end > start), F.lit(False))
    return {
        "offsets": ~placed,
        "kind": unless_null(kind, ~kind.isin(*kinds)),
        "confidence": unless_null(sure, ~sure.between(0, 1)),
        "reason": ~F.col("reason").isin("initial", "retry"),
        "source_kind": ~F.col("source_kind").isin("reader", "question", "workbook"),
    }


def claim_rules(statement_most: int = 4000) -> Rules:
    """Columns fact_key, statement, language, difficulty, status, evidence (array of ids) and metadata (JSON)."""
    return {
        "key": length_outside("fact_key", 1, 80),
        "statement": length_outside("statement", 1, statement_most),
        "evidence": ~F.size("evidence").between(1, 20),
        "language": ~F.col("language").isin("en", "ko"),
        "difficulty": ~F.col("difficulty").between(1, 3),
        "status": ~F.col("status").isin("draft", "confirmed", "stale"),
        "metadata": ~F.trim("metadata").startswith("{"),
    }


def scope_rules(schools: list[str], grades: list[str], pairs: dict[str, str] | None = None) -> Rules:
    """For requests with ids (array) and matching (how many of them are passages of the request's grade)."""
    return {
        "school": ~F.trim("school").isin(*schools),
        "grade": ~F.trim("grade").isin(*grades),
        "pair": pair_broken(pairs or {}),
        "repeated_ids": F.size("ids") != F.size(F.array_distinct("ids")),
        "passages": F.col("matching") != F.size(F.array_distinct("ids")),
    }


def with_matching(requests: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Adds matching: the number of different ids of a request that are passages of its grade."""
    asked = requests.select(key, F.trim("grade").alias("grade"), F.explode(F.array_distinct("ids")).alias("passage_id"))
    found = asked.join(passages.select(F.col("id").alias("passage_id"), "grade"), ["passage_id", "grade"]).groupBy(key).agg(F.count("*").alias("matching"))
    return requests.join(found, key, "left").withColumn("matching", F.coalesce("matching", F.lit(0)))


def is_attempt_id(c: Column) -> Column:
    return F.coalesce(c.rlike(C.UUID4_PATTERN), F.lit(False))


def since(df: DataFrame, instant: str, column: str = "created_at") -> DataFrame:
    return df.where(F.col(column) >= F.lit(instant).cast("timestamp_ntz"))


def withdraw(questions: DataFrame, ids: DataFrame, flags: list[list[str]]) -> DataFrame:
    """Questions of the id list go back to draft, with "drop" at each of some paths of their payload."""
    marked = questions.join(ids.distinct().withColumn("hit", F.lit(True)), "id", "left")
    payload = F.coalesce("payload", F.lit("{}"))
    for path in flags:
        payload = json_put(payload, path, F.lit('"drop"'))
    return marked.withColumns({"status": F.when(F.col("hit"), "draft").otherwise(F.col("status")), "payload": F.when(F.col("hit"), payload).otherwise(F.col("payload"))}).drop("hit")


def check_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a null in the key do not collide."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_refs(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Child rows whose reference is set but points nowhere."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)), fk, "left_anti")


def grade_mismatch_links(links: DataFrame, exams: DataFrame, passages: DataFrame) -> DataFrame:
    """Links that lack a side or whose sides differ in grade."""
    e = exams.select(F.col("id").alias("exam_id"), F.col("grade").alias("exam_grade"), F.lit(True).alias("has_exam"))
    p = passages.select(F.col("id").alias("passage_id"), F.col("grade").alias("passage_grade"), F.lit(True).alias("has_passage"))
    both = links.join(e, "exam_id", "left").join(p, "passage_id", "left")
    return both.where("has_exam is null or has_passage is null or exam_grade <> passage_grade").select(*links.columns)


def filter_scope(df: DataFrame, school: str | None = None, grade: str | None = None) -> DataFrame:
    """Blank or missing parameters do not filter."""
    for column, value in (("school", school), ("grade", grade)):
        if value and value.strip():
            df = df.where(F.col(column) == value.strip())
    return df
