"""Scopes: which passages they hold, in which order and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.session import with_plain_unions
from lessonloom.operators.rules import scope_rules, violations, with_matching
from lessonloom.operators.tables import append_members


def scope_id(school: Column, grade: Column) -> Column:
    """Id of a new scope, made of its school and grade: 60 bits of a hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", school, grade), 256), 1, 15), 16, 10).cast("long")


@with_plain_unions
def set_scope(requests: DataFrame, current_exams: DataFrame, passages: DataFrame, links: DataFrame, schools: list[str], grades: list[str], pairs: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcome and scope of each request, links): requests that break no rule set the passages of their school's and grade's current scope, which is made where it is missing.

    requests, one a school and grade: request_id, school, grade, ids, replace. With ``replace``
    members that the request lacks go first; new ones come at the end in the request's order.
    """
    judged = violations(with_matching(requests, passages, "request_id"), scope_rules(schools, grades, pairs))
    judged = judged.withColumns({"school": F.trim("school"), "grade": F.trim("grade")})
    judged = judged.join(current_exams.select("school", "grade", F.col("id").alias("known_id")), ["school", "grade"], "left")
    fine = F.size("violations") == 0
    judged = judged.withColumn("exam_id", F.when(fine, F.coalesce("known_id", scope_id(F.col("school"), F.col("grade")))))
    good = judged.where("exam_id is not null").select("exam_id", "replace", "ids")
    wanted = good.select("exam_id", "replace", F.posexplode("ids").alias("ordinal", "passage_id"))
    touched = links.join(good.select("exam_id", "replace"), "exam_id")
    out = links.join(good.select("exam_id"), "exam_id", "left_anti").select("exam_id", "passage_id", F.col("position").cast("long").alias("position"))
    for replace in (True, False):
        side = lambda df: df.where(F.col("replace") if replace else ~F.col("replace")).drop("replace")  # noqa: B023, E731
        out = out.unionByName(append_members(side(touched), side(wanted), replace=replace))
    created = F.col("exam_id").isNotNull() & F.col("known_id").isNull()
    return judged.select("request_id", "exam_id", created.alias("created"), F.array_join("violations", ",").alias("violations")), out


LAYOUT_ERRORS = ("unknown_scope", "half_group", "repeated", "label_conflict", "split_group", "not_the_members")


def named_groups(layout: DataFrame) -> DataFrame:
    key, label = (F.nullif(F.trim(c), F.lit("")) for c in ("group_key", "group_label"))
    return layout.withColumns({"group_key": key, "group_label": label})


def first_of(names: tuple[str, ...], flags: dict[str, Column]) -> Column:
    """The first error, in the order of names, whose flag is set; a flag that is null is not."""
    return F.coalesce(*[F.when(F.coalesce(flags[n], F.lit(False)), F.lit(n)) for n in names if n in flags])


def group_faults(rows: DataFrame) -> DataFrame:
    """Per scope of a layout: half_group, repeated, label_conflict and split_group."""
    half = F.col("passage_id").isNull() | (F.col("group_key").isNull() != F.col("group_label").isNull())
    whole = rows.groupBy("exam_id").agg(F.bool_or(half).alias("half_group"), (F.count("passage_id") > F.countDistinct("passage_id")).alias("repeated"))
    grouped = rows.where("group_key is not null").groupBy("exam_id", "group_key")
    groups = grouped.agg((F.countDistinct("group_label") != 1).alias("label_conflict"), (F.max("ordinal") - F.min("ordinal") + 1 != F.count("*")).alias("split_group"))
    return whole.join(groups.groupBy("exam_id").agg(F.bool_or("label_conflict").alias("label_conflict"), F.bool_or("split_group").alias("split_group")), "exam_id", "left")


def layout_errors(layout: DataFrame, links: DataFrame, exams: DataFrame) -> DataFrame:
    """The first error of each layout, in the order of LAYOUT_ERRORS. layout: exam_id, ordinal, passage_id, group_key, group_label."""
    rows = named_groups(layout)
    given = rows.select("exam_id", "passage_id").distinct().withColumn("given", F.lit(True))
    held = links.select("exam_id", "passage_id").distinct().withColumn("held", F.lit(True))
    # A scope without a layout is nobody's error: its links only count where some row is given.
    members = given.join(held, ["exam_id", "passage_id"], "full").groupBy("exam_id").agg(F.bool_or(F.col("given").isNull() | F.col("held").isNull()).alias("not_the_members"), F.count("given").alias("n")).where("n > 0").drop("n")
    known = exams.select(F.col("id").alias("exam_id"), F.lit(True).alias("known"))
    faults = group_faults(rows).join(members, "exam_id", "left").join(known, "exam_id", "left")
    flags = {n: F.col(n) for n in LAYOUT_ERRORS[1:]} | {"unknown_scope": F.col("known").isNull()}
    return faults.select("exam_id", first_of(LAYOUT_ERRORS, flags).alias("error")).where("error is not null")


def set_scope_layout(layout: DataFrame, links: DataFrame, exams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with positions and groups, errors): a layout names every passage of its scope once; one with an error changes nothing.

    links: exam_id, passage_id, position, group_key, group_label.
    """
    errors = layout_errors(layout, links, exams)
    new = named_groups(layout).join(errors.select("exam_id"), "exam_id", "left_anti").select("exam_id", "passage_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("group_key").alias("new_key"), F.col("group_label").alias("new_label"))
    both = links.join(new, ["exam_id", "passage_id"], "left")
    take = lambda new, old: F.when(F.col("ordinal").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select("exam_id", "passage_id", F.coalesce("ordinal", F.col("position").cast("long")).alias("position"), take("new_key", "group_key"), take("new_label", "group_label")), errors


DEFINITION_ERRORS = ("unknown_scope", "repeated", "not_of_the_grade", "empty_group", "repeated_empty_group", "group_not_empty", "half_group", "label_conflict", "split_group")


@with_plain_unions
def set_scope_definition(items: DataFrame, empty_groups: DataFrame, links: DataFrame, exams: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, empty groups in order, errors): a definition says which passages its scope holds, in which order and groups, and which groups are empty.

    items as in ``set_scope_layout``. empty_groups: exam_id, key, label, index (text). exams: id,
    grade. Links of scopes without a definition, or with one that has an error, stay.
    """
    rows = named_groups(items)
    scope = exams.select(F.col("id").alias("exam_id"), F.col("grade").alias("scope_grade"))
    graded = rows.select("exam_id", "passage_id").join(scope, "exam_id").join(passages.select(F.col("id").alias("passage_id"), F.col("grade").alias("passage_grade")), "passage_id", "left")
    grades = graded.groupBy("exam_id").agg(F.bool_or(~F.col("passage_grade").eqNullSafe(F.col("scope_grade"))).alias("not_of_the_grade"))
    key, label = F.trim(F.coalesce("key", F.lit(""))), F.trim(F.coalesce("label", F.lit("")))
    named = empty_groups.withColumns({"key": key, "label": label})
    malformed = ~F.char_length("key").between(1, 80) | ~F.char_length("label").between(1, 120) | ~F.coalesce(F.col("index").rlike("^[0-9]+$"), F.lit(False))
    used = rows.select("exam_id", F.col("group_key").alias("key"), F.lit(True).alias("used")).distinct()
    empty = named.join(used, ["exam_id", "key"], "left").groupBy("exam_id").agg(F.bool_or(malformed).alias("empty_group"), (F.count("*") > F.countDistinct("key")).alias("repeated_empty_group"), F.bool_or(F.coalesce("used", F.lit(False))).alias("group_not_empty"))
    both = group_faults(rows).join(grades, "exam_id", "left").join(empty, "exam_id", "full").join(scope, "exam_id", "left")
    flags = {n: F.col(n) for n in DEFINITION_ERRORS[1:]} | {"unknown_scope": F.col("scope_grade").isNull()}
    judged = both.select("exam_id", first_of(DEFINITION_ERRORS, flags).alias("error"))
    fine = judged.where("error is null").select("exam_id")
    # Members go, stay and come so that the scope holds just the items, in their order.
    laid = rows.join(fine, "exam_id", "left_semi").select("exam_id", "passage_id", F.col("ordinal").cast("long").alias("position"), "group_key", "group_label")
    rest = links.join(fine, "exam_id", "left_anti").select("exam_id", "passage_id", F.col("position").cast("long").alias("position"), "group_key", "group_label")
    stored = named.join(fine, "exam_id", "left_semi").select("exam_id", "key", "label", F.col("index").cast("int").alias("index"))
    ordered = stored.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("index", "key", "label"))).alias("empty_groups"))
    return laid.unionByName(rest), ordered, judged.where("error is not null")
