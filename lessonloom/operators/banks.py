"""Banks of questions, explanations and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.functions.session import with_plain_unions
from lessonloom.functions.text import json_put, json_quote
from lessonloom.operators.rules import explanation_rules, question_rules, violations, with_group_size, with_known
from lessonloom.operators.tables import match_exactly_one

#: What names a question: its passage and its source.
IDENTITY = ["passage_id", "exam", "passage_no", "question_no", "section"]


def with_source(questions: DataFrame) -> DataFrame:
    """Adds the source columns of the identity, from the payload."""
    part = lambda key: F.get_json_object("payload", f"$.source.{key}")
    return questions.withColumns({"exam": part("exam"), "passage_no": part("passage_no"), "question_no": part("source_question_no"), "section": part("section")})


def import_questions(bundle: DataFrame, stored: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, refused bundles): a bundle with a violation is refused as a whole; else its questions update the stored ones of their identity or come in.

    bundle: bundle_id, line, passage_id, type, difficulty, payload, status, generation. stored:
    id, passage_id, type, difficulty, payload, status, generation. Of several rows of one
    identity the last counts, bundles in the order of their ids. On an update the generation
    stays where none is given; a new question has the given one or 1, and an id made of its identity.
    """
    judged = violations(with_group_size(with_known(bundle, "passage_id", passages, "id"), "bundle_id"), question_rules())
    bad = judged.where(F.size("violations") > 0).groupBy("bundle_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("violations")))).alias("violations"), F.min("line").alias("line"))
    rows = with_source(bundle.join(bad.select("bundle_id"), "bundle_id", "left_anti"))
    latest = Window.partitionBy(*IDENTITY).orderBy(F.desc("bundle_id"), F.desc("line"))
    last = rows.withColumn("turn", F.row_number().over(latest)).where("turn = 1")
    # A generation that an earlier row gave is kept by a later one without.
    given = rows.groupBy(*IDENTITY).agg(F.max_by("generation", F.when(F.col("generation").isNotNull(), F.struct("bundle_id", "line"))).alias("given"))
    fresh = last.join(given, IDENTITY).select(*IDENTITY, F.col("type").alias("new_type"), F.col("difficulty").alias("new_difficulty"), F.col("payload").alias("new_payload"), F.coalesce(F.nullif("status", F.lit("")), F.lit("draft")).alias("new_status"), "given", F.lit(True).alias("incoming"))
    both = with_source(stored).withColumn("is_stored", F.lit(True)).join(fresh, IDENTITY, "full")
    take = lambda c: F.when(F.col("incoming"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    new_id = F.sha2(F.concat_ws("|", *IDENTITY), 256)
    return both.select(F.coalesce(F.col("id").cast("string"), new_id).alias("id"), "passage_id", take("type"), take("difficulty"), take("payload"), take("status"), F.coalesce("given", "generation", F.lit(1)).cast("long").alias("generation")), bad


def import_explanations(bundle: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, refused bundles): each explanation must be complete and name exactly one question by exam, section and number; one that does not refuses its bundle.

    bundle: bundle_id, line, exam, section, number, text. Only the explanation in the payload
    changes; of several for one question the last line counts.
    """
    judged = violations(with_group_size(bundle, "bundle_id"), explanation_rules())
    named = with_source(questions).select("id", "exam", "section", F.col("question_no").alias("number"))
    keyed = judged.withColumn("change_id", F.struct("bundle_id", "line"))
    matched = match_exactly_one(keyed.select("change_id", "exam", "section", "number"), named, ["exam", "section", "number"], "change_id", "id")
    told = keyed.join(matched, "change_id")
    refusal = F.when(F.size("violations") > 0, F.concat_ws(",", "violations")).when(F.col("matches") != 1, F.concat(F.lit("matches_"), F.col("matches").cast("string")))
    told = told.withColumn("refusal", refusal)
    refused = told.where("refusal is not null").groupBy("bundle_id").agg(F.min_by("refusal", "line").alias("reason"), F.min("line").alias("line"))
    good = told.join(refused.select("bundle_id"), "bundle_id", "left_anti")
    texts = good.groupBy(F.col("match").alias("id")).agg(F.max_by("text", F.struct("bundle_id", "line")).alias("explanation"))
    after = questions.join(texts, "id", "left")
    return after.withColumn("payload", F.when(F.col("explanation").isNotNull(), json_put(F.col("payload"), ["explanation"], json_quote(F.col("explanation")))).otherwise(F.col("payload"))).drop("explanation"), refused


def question_pool(questions: DataFrame) -> DataFrame:
    """Available questions of the two supported types, per passage and type in the order of creation (place from 1)."""
    pool = questions.where(F.col("type").isin("multiple_choice", "written_response") & (F.col("status") == "available"))
    place = F.row_number().over(Window.partitionBy("passage_id", "type").orderBy("created_at", "id"))
    return pool.select("passage_id", "type", "id", place.cast("long").alias("place"))


# --- claims -----------------------------------------------------------------------


@with_plain_unions
def claim_pool(claims: DataFrame, variants: DataFrame, status: str = "confirmed") -> DataFrame:
    """Statements to draw from: those of confirmed claims, and of the confirmed variants of confirmed claims.

    claims: claim_id, passage_id, statement, difficulty, language, status. variants: claim_id, variant_key, statement, difficulty, language, status.
    """
    base = claims.where(F.col("status") == status)
    own = base.select("claim_id", "passage_id", F.lit("").alias("variant_key"), "statement", "difficulty", "language")
    others = variants.where(F.col("status") == status).join(base.select("claim_id", "passage_id"), "claim_id")
    return own.unionByName(others.select(*own.columns))


def publish_claims(facts: DataFrame, claims: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, claims, counts): all facts and claims of the given passages are confirmed; counts say how many of each, per passage."""
    asked = passages.select(F.col("id").alias("passage_id")).distinct().withColumn("hit", F.lit(True))

    def confirmed(df: DataFrame) -> DataFrame:
        return df.join(asked, "passage_id", "left").withColumn("status", F.when(F.col("hit"), "confirmed").otherwise(F.col("status"))).drop("hit").select(*df.columns)

    count = lambda df, name: df.groupBy("passage_id").agg(F.count("*").alias(name))
    told = asked.select("passage_id").join(count(facts, "facts"), "passage_id", "left").join(count(claims, "claims"), "passage_id", "left")
    return confirmed(facts), confirmed(claims), told.select("passage_id", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("claims", F.lit(0)).alias("claims"))


@with_plain_unions
def stale_claims(claims: DataFrame, facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Claims after facts have changed: a confirmed claim that rests on a changed or stale fact is stale; drafts stay drafts.

    claims: claim_id, passage_id, evidence (array of fact keys), status. facts: passage_id, fact_key, status. changed: passage_id, fact_key.
    """
    moved = facts.where("status = 'stale'").select("passage_id", "fact_key").union(changed.select("passage_id", "fact_key")).distinct()
    hit = claims.select("claim_id", "passage_id", F.explode("evidence").alias("fact_key")).join(moved, ["passage_id", "fact_key"]).select("claim_id").distinct().withColumn("hit", F.lit(True))
    return claims.join(hit, "claim_id", "left").withColumn("status", F.when(F.col("hit") & (F.col("status") == "confirmed"), "stale").otherwise(F.col("status"))).drop("hit")


@with_plain_unions
def grading_report(attempts: DataFrame, requests: DataFrame) -> DataFrame:
    """What is wrong between score-based attempts and grading requests: (kind, id).

    attempts: id, scored, request_id. requests: id, status, result. An attempt that is scored
    names one request that exists (unlinked, unknown_request), each request one attempt at
    most (shared_request); a completed request has a result (no_result), and one that is
    pending is reported (pending).
    """
    scored = attempts.where("scored")
    unlinked = scored.where("request_id is null").select(F.lit("unlinked").alias("kind"), "id")
    unknown = scored.where("request_id is not null").join(requests.select(F.col("id").alias("request_id")), "request_id", "left_anti").select(F.lit("unknown_request").alias("kind"), "id")
    shared = attempts.where("request_id is not null").groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("shared_request").alias("kind"), F.col("request_id").alias("id"))
    pending = requests.where("status = 'pending'").select(F.lit("pending").alias("kind"), "id")
    empty = requests.where("status = 'completed' and result is null").select(F.lit("no_result").alias("kind"), "id")
    return unlinked.unionByName(unknown).unionByName(shared).unionByName(pending).unionByName(empty)
