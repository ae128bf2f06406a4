"""The corpus pipeline: stages that each work on all that the stage before kept.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return the
columns of documents. No stage drops rows to get done: the first drops what the quality
rules reject, the second all but one of each group of near-duplicates, the third the
words of repeated passages (and documents of which nothing is left), the fourth repeats
or leaves out documents by the schedule of their source, and the last adds tokens.

Defined results: a null or empty text fails the first stage; rows without an id, or of
one id, are told apart by their text, so none stands for another; of equal rows the
second stage keeps one; a null id stays null; an empty table passes as an empty table;
further columns go through to the fourth stage, under their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.llm.byte_bpe import default_vocabulary, round_trip
from lessonloom.llm.common import LAST_ID, read_documents, text_key
from lessonloom.llm.jaccard_join import one_of_each
from lessonloom.llm.quality_rules import good_documents
from lessonloom.llm.source_mixing import mixed_documents
from lessonloom.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs).where("n_removed < n_words").select("id", "tag", F.col("kept").cast("string").alias("kept"), "n_removed").dropDuplicates(["id", "tag"])
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_key(body).alias("tag"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    cleaned = F.col("row").withField("text", text).withField("n_chars", F.char_length(text).cast("long"))
    return rows.join(cut, ["id", "tag"]).select(cleaned.alias("row")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = default_vocabulary()
    return round_trip(docs, ranks, pattern).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("body").cast("string").alias("decoded"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mixing", mixing),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: Hashed shingles, shuffled streams and tokenizers have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
