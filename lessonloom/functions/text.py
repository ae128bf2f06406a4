"""Scalar functions of the practice domain, as columns."""

from __future__ import annotations

import json
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lessonloom import constants as C


def trim_wide(c: Column) -> Column:
    return F.btrim(c, F.lit(C.WIDE_SPACE_CHARACTERS))


def clean_text(c: Column, most: int = C.MAX_TEXT) -> Column:
    """Null as ''; NUL and astral characters go, no-break spaces become spaces, ends are trimmed, then the text is cut."""
    bare = F.when(beyond_ascii(c), F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "")).otherwise(F.coalesce(c, F.lit("")))
    plain = F.replace(F.replace(bare, F.lit("\x00"), F.lit("")), F.lit("\xa0"), F.lit(" "))
    return F.substring(trim_wide(plain), 1, most)


def flatten_space(c: Column) -> Column:
    """Null as ''; only texts with more than single spaces between words are rewritten."""
    text = F.coalesce(c, F.lit(""))
    return F.trim(F.when(text.rlike(rf"(?! ){C.WIDE_SPACE}|  "), F.regexp_replace(text, f"{C.WIDE_SPACE}+", " ")).otherwise(text))


def sentence_words(c: Column) -> Column:
    return F.regexp_extract_all(clean_text(c), F.lit(C.TOKEN_PATTERN), F.lit(0))


def is_blank(c: Column) -> Column:
    """Whether ``clean_text`` leaves nothing: no character that it neither drops nor trims. It reads up to the first such character."""
    return ~F.coalesce(c.rlike(rf"(?!{C.WIDE_SPACE})[^\x00\x{{10000}}-\x{{10FFFF}}]"), F.lit(False))


def has_two_words(c: Column) -> Column:
    """Whether ``sentence_words`` finds two words or more: a whole first word, and what begins another after it; the rest is not read.

    Two words of the first characters are two of the whole text, unless ``clean_text`` drops some of these.
    """
    two = rf"(?>{C.TOKEN_PATTERN}).*?[\p{{L}}\p{{M}}\p{{N}}]"
    plain = F.substring(c, 1, 100).rlike(rf"(?s)\A(?=[^\x00\x{{10000}}-\x{{10FFFF}}]*+\z).*?{two}")
    return F.when(plain, True).otherwise(clean_text(c).rlike(f"(?s){two}"))


def has_word(c: Column) -> Column:
    """Whether ``sentence_words`` finds a word: any of the characters that each of them holds."""
    return clean_text(c).rlike(r"[\p{L}\p{M}\p{N}]")


@F.arrow_udf(StringType())
def _nfc(values: pa.Array) -> pa.Array:
    """A thousand texts at a time, without pandas; nulls alone stay. (Arrow's ``utf8_normalize`` does not compose.)"""
    if values.null_count == len(values):
        return values
    parts = (values.slice(k, 1000).to_pylist() for k in range(0, len(values), 1000))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if x is None else normalize("NFC", x) for x in part], pa.string()) for part in parts)])


def beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.char_length(c)


def nfc(c: Column) -> Column:
    """Composed form; texts without combining marks or later blocks are it already and stay in the JVM.

    The UDF sees null for those, as Spark evaluates it for all rows of a batch.
    """
    later = beyond_ascii(c) & c.rlike(r"[\x{0300}-\x{10FFFF}]")
    return F.coalesce(_nfc(F.when(later, c)), c)


def fold_case(c: Column) -> Column:
    """Composed, lower case, dashes alike."""
    text = F.lower(nfc(c))
    return F.when(beyond_ascii(c), F.translate(text, C.DASHES, "-" * len(C.DASHES))).otherwise(text)


def normalize_token(c: Column) -> Column:
    """``fold_case`` with single white space: for a token, or a whole sentence at once."""
    return fold_case(flatten_space(c))


def normalize_words(words: Column) -> Column:
    """``normalize_token`` of each word of an array; words hold no white space."""
    return F.split(fold_case(F.array_join(words, " ")), " ")


def mistake_allowance(step: Column, words: Column) -> Column:
    """Null (unlimited) for step 1; 1 or 0 for step 2 by length; null otherwise."""
    return F.when(step == 2, F.when(words >= C.LONG_SENTENCE_WORDS, 1).otherwise(0))


def item_key(c: Column) -> Column:
    return F.concat(F.lit("sentence:"), F.trim(c.cast("string")))


def progress_key(semantic_type: Column, stage: Column) -> Column:
    return F.coalesce(F.nullif(semantic_type, F.lit("")), F.concat(F.lit("stage:"), stage.cast("string")))


def contract(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(C.LEGACY_CONTRACT))


def progress_percent(clears: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(F.greatest(clears, F.lit(0)) * 100 / total)).otherwise(0).cast("long")


def period_start(period: Column, now_seconds: Column) -> Column:
    """Epoch seconds of the Korean midnight that a period starts at; unknown periods count as seven days."""
    offset, day = 9 * 3600, 86400
    midnight = F.floor((now_seconds + offset) / day) * day - offset
    back = F.when(period == "today", 0).when(period == "30d", 30).otherwise(7)
    return (midnight - back * day).cast("long")


def part_suffix() -> str:
    return r"(?i)\s*·\s*Part\s+(\d+)\s*$"


def lesson_label(c: Column) -> Column:
    return F.regexp_replace(c, part_suffix(), "")


def part_number(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, part_suffix(), 1), F.lit("")).cast("int"), F.lit(1))


def lesson_number(source_type: Column, title: Column, label: Column) -> Column:
    """The lesson that title and label name, for passages of the marked textbook; else null."""
    names = F.concat_ws(" ", title, label)
    ours = F.coalesce(source_type == "TEXTBOOK", F.lit(False))
    for mark in C.TEXTBOOK_MARKS:
        ours = ours & names.contains(mark)
    found = F.coalesce(*[F.when(names.rlike(name), F.lit(n)) for n, name in C.LESSON_NAMES.items()])
    return F.when(ours, found)


def register_functions(spark: SparkSession) -> None:
    """``nfc`` for SQL, the one function that Spark lacks; Python gets the texts that it gets of the column ``nfc``."""
    spark.udf.register("nfc_in_python", _nfc)
    later = r"octet_length(text) <> char_length(text) and text rlike r'[\x{0300}-\x{10FFFF}]'"
    spark.sql(f"create or replace temporary function nfc(text string) returns string return coalesce(nfc_in_python(case when {later} then text end), text)")


def meaning_key(c: Column) -> Column:
    return F.substring(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), 1, 500)


def pseudonym(forwarded: Column, other: Column, pepper: str, purpose: str = "login-client-v1") -> Column:
    """Client address as a peppered hash prefix; ``purpose`` keeps hashes made for different ends apart."""
    first = F.nullif(F.trim(F.split(F.coalesce(forwarded, F.lit("")), ",")[0]), F.lit(""))
    address = F.coalesce(first, F.nullif(other, F.lit("")), F.lit("unknown"))
    return F.substring(F.sha2(F.concat(F.lit(f"{pepper}:{purpose}:"), address), 256), 1, 24)


def session_expiry(actor: Column, remember: Column, created: Column) -> Column:
    hours = F.when(actor == "admin", 8).when(remember, 30 * 24).otherwise(12)
    return created + F.make_dt_interval(hours=hours)


# --- JSON texts -------------------------------------------------------------------


def json_text(c: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def json_merge(a: Column, b: Column) -> Column:
    """Shallow merge of JSON objects, values of any type kept; the right side wins. A null side, or one that is no object, counts as {}."""
    kind = "map<string,variant>"
    left, right = (F.coalesce(F.from_json(x, kind), F.create_map().cast(kind)) for x in (a, b))
    return F.to_json(F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right))


def json_put(c: Column, path: list[str], value: Column) -> Column:
    """Sets the value (JSON text) at a path of keys. The last key may be new; where an object on the way is missing, nothing changes."""
    if len(path) > 1:
        inner = F.get_json_object(c, f"$.{path[0]}")
        return F.when(F.coalesce(F.trim(inner).startswith("{"), F.lit(False)), json_put(c, path[:1], json_put(inner, path[1:], value))).otherwise(c)
    return json_merge(c, F.concat(F.lit("{"), F.lit(json.dumps(path[0])), F.lit(":"), F.coalesce(value, F.lit("null")), F.lit("}")))


def json_quote(c: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def json_set(c: Column, path: str | list[str], value: Column) -> Column:
    """Sets a string at a key or path where the value there is missing or blank."""
    keys = [path] if isinstance(path, str) else path
    kept = F.nullif(F.trim(F.get_json_object(c, "$." + ".".join(keys))), F.lit(""))
    return F.when(kept.isNotNull(), c).otherwise(json_put(F.coalesce(c, F.lit("{}")), keys, json_quote(value)))


def meaning_snapshot(core: Column, gloss: Column, meanings: Column) -> tuple[Column, Column]:
    """(meaning, meanings): the core meaning, else the gloss; without meanings the list is that one meaning."""
    meaning = F.coalesce(F.nullif(core, F.lit("")), gloss)
    return meaning, F.when(F.coalesce(F.size(meanings), F.lit(0)) > 0, meanings).otherwise(F.array(meaning))


def first_known(*values: Column) -> Column:
    """First of several instants, versions or states that is known."""
    return F.coalesce(*values)


def question_difficulty(kind: Column, payload: Column) -> Column:
    slots = F.coalesce(F.from_json(F.get_json_object(payload, "$.response_slots"), "array<struct<word_count:int>>"), F.array().cast("array<struct<word_count:int>>"))
    long = F.exists(slots, lambda s: F.coalesce(s["word_count"], F.lit(0)) >= C.LONG_SENTENCE_WORDS)
    taxonomy = F.coalesce(F.get_json_object(payload, "$.spec.taxonomy"), F.get_json_object(payload, "$.taxonomy"), F.lit(""))
    written = F.when((F.size(slots) >= 3) | long, 3).otherwise(2)
    return F.when(kind == "written_response", written).when(taxonomy.isin(*C.HARD_TAXONOMIES), 3).when(taxonomy.isin(*C.EASY_TAXONOMIES), 1).otherwise(2)
