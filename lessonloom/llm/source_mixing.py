"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sources are ranked and share a total of words by weight, none above a stated
   multiple of what it has; the excess goes to the others.
2. Each source's documents are put in a hashed order and laid end to end; every
   ``block`` words make one block, so a source is a stream of equal-token blocks.
3. Slot i of the schedule falls on frac(i / golden ratio), which the cumulative
   weights map to a source; its rank among the slots of that source names the block
   (and, past the last block, the next pass over the stream).
4. Joining slots with blocks gives how often each stretch of a document is taken.

Running sums never gather a source in one task: each is cut into cells of the hashed
order, the cells' totals are summed up first, and the rest is summed inside a cell.
The same holds for the ranks of slots, cut into runs of consecutive slots. Words are
counted once and written, with ids and places, to the checkpoint folder. One row per
source comes to the driver; it is broadcast where sources are few (``LISTED`` rows) and
joined by a shuffle where they are many, such as sites.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source
is a source of its own, ranked last; a null doc_id stays null; repeated rows count as
documents of their own; a table without words has targets 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lessonloom.llm.common import BROADCAST_BYTES, LAST_ID, SPACE, back_to_null, count_words, read_documents, shuffle_partitions, text_of, with_checkpoint_dir

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Sources (some 100 bytes each) whose rows are broadcast.
LISTED = BROADCAST_BYTES // 100
#: Words in a block. Smaller blocks follow the targets more closely and cost more rows.
BLOCK_WORDS = 64
#: Slots whose ranks are counted together.
SLOT_RUN = 1 << 14
#: Slots of a mix at most: where the total asks for more, blocks have as many words as make them so few.
MOST_SLOTS = 1 << 32
#: Conjugate of the golden ratio in 30 bits: frac(i / phi) is exact in integers, and products stay within a long.
FRACTION = 1 << 30
GOLDEN = round((math.sqrt(5) - 1) / 2 * FRACTION) | 1


def share_out(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_PASSES) -> list[float]:
    """Targets by weight (repeating) that sum to the sum of sizes; those above ``most`` sizes stop there and the rest is shared anew until none is above."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free = {i: weights[i % len(weights)] for i in range(len(sizes))}
    rest = total
    while free:
        unit = rest / sum(free.values())
        over = [i for i, w in free.items() if w * unit > most * sizes[i]]
        if not over:
            for i, w in free.items():
                target[i] = w * unit
            break
        for i in over:
            target[i] = most * float(sizes[i])
            rest -= target[i]
            del free[i]
    return target


def sized_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id")


def place_of(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit("place"), F.col(id_col), F.xxhash64(text_of(text_col))).alias("place")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, mark: Column | None = None) -> DataFrame:
    """id, source, size, place (the hashed order) and mark (0, or what tells rows of one id and text apart)."""
    return docs.select(
        sized_id(id_col),
        F.col(source_col).cast("string").alias("source"),
        count_words(text_of(text_col)).cast("long").alias("size"),
        place_of(id_col, text_col),
        (F.lit(0).cast("long") if mark is None else mark).alias("mark"),
    )


def plan_sources(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_PASSES) -> list[tuple]:
    """(source, size, target), by code point with null last. One row a source comes to the driver: the names in a mix, not its documents."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    return [(r.source, int(r["size"]), t) for r, t in zip(rows, share_out([int(r["size"]) for r in rows], weights, most))]


def running(rows: DataFrame, keys: list[str], cell: str, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys that come before, in cells that are ordered themselves."""
    totals = rows.groupBy(*keys, cell).agg(F.sum(value).alias("cell_sum"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, cell, F.coalesce(F.sum("cell_sum").over(before), F.lit(0)).alias("cell_start"))
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*keys, cell]).withColumn(name, F.col(name) + F.col("cell_start")).drop("cell_start")


def schedule(spark: SparkSession, targets: list[float], block: int) -> DataFrame:
    """(source number, rank): every slot of the schedule, ranked within its source. Slots are as many as blocks fill the sum of targets."""
    total = sum(targets)
    slots = round(total / block) if total else 0
    edges = np.minimum(np.round(np.cumsum(targets) / total * FRACTION), FRACTION).astype(np.int64)[:-1] if total else np.empty(0, np.int64)

    def with_source(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            slot = part.column(0).to_numpy()
            number = np.searchsorted(edges, slot % FRACTION * GOLDEN % FRACTION, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number), pa.array(slot // SLOT_RUN), pa.array(np.ones(len(slot), np.int32))], ["slot", "number", "run", "one"])

    drawn = spark.range(1, slots + 1).mapInArrow(with_source, "slot long, number int, run long, one int")
    return running(drawn, ["number"], "run", ["slot"], "one", "rank").select("number", "rank")


def stretches(sizes: DataFrame, weights: tuple[float, ...], most: int, block: int, cells: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``sized`` with number, source_size, target and start (of the first word in the source's stream), and their stretches: number, start, id, place, mark, block, words, takes."""
    spark = sizes.sparkSession
    cells = cells or 8 * shuffle_partitions(spark)
    plan = plan_sources(sizes, weights, most)
    block = max(block, math.ceil(sum(t for *_, t in plan) / MOST_SLOTS))
    listed = spark.createDataFrame([(i, s, n, float(t)) for i, (s, n, t) in enumerate(plan)], "number int, source string, source_size long, target double")
    few = F.broadcast if len(plan) <= LISTED else lambda rows: rows
    rows = sizes.join(few(listed), sizes["source"].eqNullSafe(listed["source"]), "left").drop(listed["source"])
    rows = rows.withColumn("cell", F.pmod(F.shiftrightunsigned("place", 20), F.lit(cells)).cast("int"))
    # Rows of equal (place, id, mark) are equal, but each has its own stretch: sizes are equal, so any order of them gives the same lengths.
    laid = running(rows, ["number"], "cell", ["place", "id", "mark"], "size", "start")
    hits = schedule(spark, [t for *_, t in plan], block)
    blocks = few(listed.select("number", F.ceil(F.col("source_size") / block).alias("blocks")))
    hits = hits.join(blocks, "number").where(F.col("blocks") > 0).where(F.col("rank") < F.col("blocks") * most)
    hits = hits.groupBy("number", F.pmod(F.col("rank"), F.col("blocks")).alias("block")).agg(F.count("*").alias("takes"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = laid.where("size > 0").select("number", "id", "place", "mark", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begin
    return laid, parts.withColumns({"words": words, "skipped": begin - F.col("start")}).join(hits, ["number", "block"], "left").withColumn("takes", F.coalesce("takes", F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, block: int = BLOCK_WORDS, cells: int | None = None) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, start (its first word's place in its source's stream) and turns (most takes of a stretch of it)."""
    with_checkpoint_dir(docs.sparkSession)
    laid, parts = stretches(sized(docs, id_col, text_col, source_col).checkpoint(), weights, most, block, cells)
    taken = parts.groupBy("number", "start", "id").agg(F.sum(F.col("words") * F.col("takes")).alias("taken"), F.max("takes").alias("turns"))
    keyed = laid.withColumn("alone", F.when(F.col("size") > 0, F.col("start")))
    joined = keyed.join(taken.withColumnRenamed("start", "alone"), ["number", "alone", "id"], "left")
    return joined.select(back_to_null("id").alias("doc_id"), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("turns", F.lit(0)).cast("int").alias("turns"), "number", "start", "place")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, block: int = BLOCK_WORDS, cells: int | None = None) -> DataFrame:
    """The mix: each document once for every pass that takes any of it, with its own columns; a pass has the words of those blocks that were hit so often, and the text as it is where these are all.

    Rows that are equal in all columns share one text and have their own stretches.
    """
    with_checkpoint_dir(docs.sparkSession)
    mark = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    _, parts = stretches(sized(docs, id_col, text_col, source_col, mark).checkpoint(), weights, most, block, cells)
    keys = ["id", "place", "mark"]
    told = parts.where("takes > 0").groupBy(*keys, "number", "start", "size").agg(F.array_sort(F.collect_list(F.struct("skipped", "words", "takes"))).alias("taken"))
    rows = docs.select(sized_id(id_col), place_of(id_col, text_col), mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).dropDuplicates(keys)
    passes = rows.join(told, keys).select("row", "size", "taken", F.explode(F.sequence(F.lit(1), F.array_max("taken.takes").cast("int"))).alias("turn"))
    passes = passes.withColumn("taken", F.filter("taken", lambda x: x["takes"] >= F.col("turn")))
    whole = F.aggregate("taken", F.lit(0).cast("long"), lambda n, x: n + x["words"]) == F.col("size")
    words = F.filter(F.split(F.col("row")[text_col], f"[{SPACE}]+"), lambda w: w != "")
    cut = passes.withColumns({"whole": whole, "split": F.when(~whole, words)})
    some = F.flatten(F.transform("taken", lambda x: F.slice("split", x["skipped"].cast("int") + 1, x["words"].cast("int"))))
    text = F.when(F.col("whole"), F.col("row")[text_col]).otherwise(F.array_join(some, " "))
    return cut.withColumn("row", F.col("row").withField(text_col, text)).select("row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "turns", "start")
