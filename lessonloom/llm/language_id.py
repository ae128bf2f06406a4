"""Language of web pages by Bayesian evidence fusion.

Evidence for a page: its visible text (byte-trigram likelihoods), the language that its
markup declares, its address suffix, and a prior of its host. Languages are those that
any document names; the text model is fitted on at most ``TRAIN_ROWS`` texts of each
(those of least hash). The other parts come from grouped aggregations over all pages of
the text posteriors, which are computed once and written to the checkpoint folder:

* how often each declared language goes with each language,
* how often each suffix goes with each language,
* host priors, smoothed hierarchically: host towards domain, domain towards all pages.
  A page's own share is taken out of its host's and domain's counts.

Aggregations are partial before their exchange, so a host of a third of all pages costs
one row a task; pages meet the host table by a join that Spark may split on skew.

Defined results: a null or empty page has no text evidence and follows the priors; of a
page of any length the whole text counts; a script, style or comment that is not closed
goes on to the page's end, and an attribute such as data-lang declares no language; a
null or malformed address has the empty host; a null page_id stays null; repeated rows
are judged alike; an empty table gives an empty result; without any document of known
language there are no languages, and lang is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lessonloom.llm.common import bodies, in_small_batches, mix, small_side, with_checkpoint_dir

TRAIN_ROWS = 1500
#: Texts that pass the cut beyond four times ``rows``: so many that a language without any has a chance of e^-60.
FEW = 60
TABLE = 1 << 16
#: Trigrams of one text are not independent: the text's log-likelihood counts as of so many trigrams at most.
MOST_EVIDENCE = 60.0
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
SMOOTH = 1.0


def grams(body: bytes) -> np.ndarray:
    """Table places of the byte trigrams of a lower-cased text, with a space at both ends."""
    b = np.frombuffer(b" " + body + b" ", np.uint8).astype(np.uint64)
    return (mix((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) >> np.uint64(48)).astype(np.int64)


def train_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of trigrams (a row a language), from at most ``rows`` texts of each language."""
    with_checkpoint_dir(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col)).alias("text"))
    known = known.withColumn("h", F.xxhash64("text"))
    # Only hashes of distinct texts are counted and ranked; those far too great for a language's share are dropped where they lie.
    texts = known.select("lang", "h").distinct()
    sizes = texts.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * rows + FEW) / F.count("*")).alias("share"))
    ranked = texts.join(small_side(sizes, 64), "lang").where(F.pmod("h", F.lit(1 << 31)) < F.col("share") * float(1 << 31))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h"))
    chosen = ranked.withColumn("turn", turn).where(F.col("turn") <= rows).select("lang", "h").checkpoint()
    sample = known.join(small_side(chosen, 48), ["lang", "h"]).groupBy("h", "lang").agg(F.first("text").alias("text")).select("lang", "text")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, body in zip(part.column(0).to_pylist(), bodies(part.column(1))):
                totals[lang] = totals.get(lang, 0) + np.bincount(grams(body), minlength=TABLE)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "place", "n"])

    def fold(table: pa.Table) -> pa.Table:
        whole = np.zeros(TABLE, np.int64)
        whole[table.column("place").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([whole.tobytes()], pa.binary())})

    # Summed by Spark, then one table of fixed size a language comes to the driver, however many partitions there are.
    counted = sample.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    got = counted.groupBy("lang").applyInArrow(fold, "lang string, counts binary").collect()
    langs = sorted(r.lang for r in got)
    total = np.full((len(langs), TABLE), 0.5)
    for r in got:
        total[langs.index(r.lang)] += np.frombuffer(bytes(r.counts), np.int64)
    return langs, np.log(total / total.sum(1, keepdims=True)).astype(np.float32)


# --- evidence of a page -----------------------------------------------------------


def visible_text(html: Column) -> Column:
    """Text outside tags, comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>", " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute, lower case; '' if none."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,8})", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def text_evidence(pages: DataFrame, id_col: str, url_col: str, html_col: str, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, declared, host, domain, suffix and text (log-likelihoods by language, tempered, their greatest 0)."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    host = host_of(url)
    rows = in_small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), declared_language(html).alias("declared"), host.alias("host"), domain_of(host).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"), F.lower(visible_text(html)).alias("body"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for body in bodies(part.column(5)):
                places = grams(body)
                value = model[:, places].sum(1, dtype=np.float64) if body.strip() else np.zeros(len(langs))
                value = value * min(1.0, MOST_EVIDENCE / max(len(places), 1))
                out.append((value - value.max()).tolist())
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(out, pa.list_(pa.float64()))], ["page_id", "declared", "host", "domain", "suffix", "text"])

    return rows.mapInArrow(batches, "page_id long, declared string, host string, domain string, suffix string, text array<double>")


# --- fusion -----------------------------------------------------------------------


def normalised(values: list[Column]) -> list[Column]:
    """exp of log values, summing to 1."""
    top = F.greatest(*values) if len(values) > 1 else values[0]
    parts = [F.exp(v - top) for v in values]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def identify(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, lang, confidence, text_lang, declared and host of every page."""
    if not langs:
        return pages.select(F.col(id_col).cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))
    n = range(len(langs))
    with_checkpoint_dir(pages.sparkSession)
    evidence = text_evidence(pages, id_col, url_col, html_col, langs, model).checkpoint()
    post = normalised([F.element_at("text", k + 1) for k in n])
    soft = evidence.withColumns({f"p{k}": post[k] for k in n})
    sums = lambda prefix: [F.sum(f"p{k}").alias(f"{prefix}{k}") for k in n]
    seen = [F.coalesce(f"all{k}", F.lit(0.0)) for k in n]
    smoothed = lambda k: ((seen[k] + SMOOTH) / sum(seen, F.lit(SMOOTH * len(langs)))).alias(f"all{k}")
    # One aggregation over the pages; the others roll it up.
    base = soft.groupBy("host", "domain", "suffix", "declared").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in n])
    everywhere = base.agg(*sums("all")).select(*[smoothed(k) for k in n])
    declared, suffix, domain, host = (base.groupBy(c).agg(*sums(f"{c}_")) for c in ("declared", "suffix", "domain", "host"))

    def likelihoods(table: DataFrame, key: str) -> DataFrame:
        """Per value of the key, how likely it is in each language (kinds of values are few or share the smoothing)."""
        totals = table.agg(*[F.sum(f"{key}_{k}").alias(f"t{k}") for k in n], F.count("*").alias("kinds"))
        return table.crossJoin(F.broadcast(totals)).select(key, *[((F.col(f"{key}_{k}") + SMOOTH) / (F.col(f"t{k}") + SMOOTH * F.col("kinds"))).alias(f"{key}_{k}") for k in n])

    joined = soft.join(host, "host").join(domain, "domain").join(likelihoods(declared, "declared"), "declared").join(likelihoods(suffix, "suffix"), "suffix").crossJoin(F.broadcast(everywhere))
    others = lambda prefix, k: F.greatest(F.col(f"{prefix}_{k}") - F.col(f"p{k}"), F.lit(0.0))
    total = lambda prefix: sum((others(prefix, k) for k in n), F.lit(0.0))
    prior = []
    for k in n:
        by_domain = (others("domain", k) + DOMAIN_WEIGHT * F.col(f"all{k}")) / (total("domain") + DOMAIN_WEIGHT)
        prior.append((others("host", k) + HOST_WEIGHT * by_domain) / (total("host") + HOST_WEIGHT))
    logs = [F.element_at("text", k + 1) + F.log(F.col(f"declared_{k}")) + F.log(F.col(f"suffix_{k}")) + F.log(prior[k]) for k in n]
    fused = joined.withColumns({f"log{k}": logs[k] for k in n})
    fused = fused.withColumns({f"q{k}": v for k, v in enumerate(normalised([F.col(f"log{k}") for k in n]))})
    best = lambda prefix: F.array_max(F.array(*[F.struct(F.col(f"{prefix}{k}").alias("v"), F.lit(-k).alias("order"), F.lit(langs[k]).alias("lang")) for k in n]))
    return fused.select("page_id", best("q")["lang"].alias("lang"), best("q")["v"].alias("confidence"), best("p")["lang"].alias("text_lang"), "declared", "host")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, model = train_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), langs, model)
