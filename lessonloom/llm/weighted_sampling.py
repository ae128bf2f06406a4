"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are the words of a text, weighted by their counts. For sample k, a term of
weight w draws r and c from Gamma(2, 1) and b from U(0, 1), all functions of (term, k):

    t = floor(ln w / r + b),  ln a = ln c - r (t - b) - r

and the term of least a gives the sample (term, t). Two texts agree in a sample with a
chance equal to the generalised Jaccard similarity of their weighted terms. Draws are
continuous: between table values in the middle, by formula at the ends. Per text, each sample is a plain min
of one long (a in the high bits, the sampled (term, t) in the low ones), so the whole
work is two hash aggregations of fixed-size rows, partial before any exchange.

The next document in the order of ids is found inside ranges of ids; only the first
document of each range also goes to the range before. Ranges are cut at quantiles of the
ids, whose number is bounded; rows of one frequent id, or of none, are cut by a hash of
their text.

Defined results: a null or empty text, or one without words, has the fingerprint of the
empty set; a null doc_id comes last in the order and stays null; rows of one id follow
each other by a hash of their text; a table of one document is its own next; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lessonloom.llm.common import LAST_ID, SPACE, back_to_null, read_documents, shuffle_partitions, text_of, with_checkpoint_dir

SAMPLES = 64
AT_ONCE = 8
#: Quantile ranges of the ids, and how many documents a part of a range should hold.
RANGES, PART_DOCUMENTS, MOST_PARTS = 256, 512, 256
HEX_DIGITS = 4
#: Stands for the words of a text that has none.
NO_TERM = 0


# --- order of documents -----------------------------------------------------------


def range_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds at or under the value, by bisection."""

    def between(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(value < F.lit(bounds[m]), between(a, m)).otherwise(between(m + 1, b))

    return between(0, len(bounds))


def in_ranges(rows: DataFrame) -> DataFrame:
    """Adds part: a number that rises with (id, tie), from quantiles of the ids and even cuts between them.

    An id that fills quantiles alone and has more rows than a part should hold (null ids
    are one id) is a range of its own, cut by tie, which is an even hash, into as many
    parts as its quantiles ask for. Of one id and one text all rows are in one part.
    """
    probs = [k / RANGES for k in range(RANGES + 1)]
    got = rows.agg(F.count("*").alias("n"), F.percentile_approx("id", probs, 10_000).alias("q")).first()
    quantiles = Counter(got.q or [])
    heavy = {i: times for i, times in quantiles.items() if times > 1 and got.n * times > RANGES * PART_DOCUMENTS}
    bounds = sorted({*quantiles, *(i + 1 for i in heavy if i < LAST_ID)})
    if not bounds:
        return rows.withColumn("part", F.lit(0).cast("long"))
    cuts = min(MOST_PARTS, -(-got.n // (RANGES * PART_DOCUMENTS)))
    ranged = rows.withColumn("range", range_of(F.col("id"), bounds))
    # By range: its least and greatest id, and the parts that its ties are cut into (0: it is cut by id).
    low, high, ties = (F.element_at(F.array(*[F.lit(v) for v in values]), F.col("range") + 1) for values in ([bounds[0], *bounds], [*bounds, bounds[-1]], [0, *(cuts * heavy.get(i, 0) for i in bounds)]))
    by_id = F.floor((F.col("id").cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0)) * cuts)
    by_tie = F.floor((F.col("tie") / F.lit(2.0**64) + F.lit(0.5)) * ties)
    most = F.when(ties > 0, ties).otherwise(F.lit(cuts)) - 1
    inside = F.least(F.greatest(F.when(ties > 0, by_tie).otherwise(by_id), F.lit(0)), most)
    return ranged.withColumn("part", F.col("range").cast("long") * (cuts * max(heavy.values(), default=1)) + inside).drop("range")


def with_next(rows: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """Adds the value of ``column`` in the next row by (part, order); after the last comes the first."""
    inside = Window.partitionBy("part").orderBy(*order)
    led = rows.withColumns({name: F.lead(column).over(inside), "is_last": F.lead(F.lit(1)).over(inside).isNull(), "turn": F.row_number().over(inside)})
    # One row a part, and their number is bounded: this window is small whatever the input.
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    heads = led.where("turn = 1").select(F.col("part").alias("head"), F.col(column).alias("head_value"))
    follow = parts.select(F.col("part").alias("head"), before.alias("tail")).join(heads, "head").select(F.col("tail").alias("part"), "head_value")
    joined = led.join(follow.withColumn("is_last", F.lit(True)), ["part", "is_last"], "left")
    return joined.withColumn(name, F.when(F.col("is_last"), F.col("head_value")).otherwise(F.col(name))).drop("head_value", "is_last")


# --- sampling ---------------------------------------------------------------------


def gamma_quantiles(cells: int) -> list[float]:
    """The bounds between equal cells of Gamma(2, 1): where 1 - (1 + x) exp(-x) is 1/cells, 2/cells, ..."""
    out, x = [], 0.01
    for k in range(1, cells):
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - k / cells) / (x * math.exp(-x))
            x = max(x / 2, x - step)
            if abs(step) < 1e-12 * x:
                break
        out.append(x)
    return out


def table(values: list[float]) -> Column:
    """A constant array of doubles; as one text it stays small until Spark folds it."""
    return F.split(F.lit(",".join(f"{v:.7g}" for v in values)), ",").cast("array<double>")


class Draws:
    """r, ln c and b of a term and sample, from the bits of one 64-bit hash.

    Gamma draws lie between neighbouring quantiles of a table, as logarithms per term and
    sample would be most of the work. The ends (high r, low c) decide the minimum in a
    long text; there draws follow the distribution itself, from further hash bits:
    above x, Gamma(2, 1) is x + E, or x + E + E' with a chance of 1 / (1 + x), of
    exponential E; below, the inverse of its distribution function is a series in sqrt(2 p).
    Tables are short as every use of them is spelled out in the plan, and so in event logs.
    """

    CELL_BITS, STEP_BITS, B_BITS = 8, 14, 20
    CELLS, END = 1 << CELL_BITS, 16

    def __init__(self):
        bounds = gamma_quantiles(self.CELLS)
        self.high = bounds[self.CELLS - self.END - 1]
        bounds = [bounds[0], *bounds, bounds[-1]]  # the outermost only fill their places: end cells are not read
        self.r, self.log_c = table(bounds), table([math.log(x) for x in bounds])

    def between(self, values: Column, cell: Column, step: Column) -> Column:
        low = values[cell]
        return low + (values[cell + 1] - low) * (step + F.lit(0.5)) * F.lit(1.0 / (1 << self.STEP_BITS))

    def above(self, g: Column) -> Column:
        """A draw above the bound ``high``."""
        u, v = ((part + F.lit(0.5)) * F.lit(1.0 / (1 << 32)) for part in (F.shiftrightunsigned(g, 32), g.bitwiseAND(F.lit(0xFFFFFFFF))))
        return F.lit(self.high) - F.log(u * F.least(F.lit(1.0), v * F.lit(1 + self.high)))

    def log_below(self, g: Column) -> Column:
        """The logarithm of a draw in the lowest ``END`` cells: of s + s^2 / 3 + 11 s^3 / 72 + 43 s^4 / 540 with s = sqrt(z), z = 2 p."""
        z = (F.shiftrightunsigned(g, 11) + F.lit(0.5)) * F.lit(2.0 * self.END / self.CELLS / (1 << 53))
        return F.log(z) * F.lit(0.5) + F.sqrt(z) * (F.lit(1 / 3) + z * F.lit(133 / 3240)) + z * F.lit(7 / 72)

    def sample(self, term: Column, log_weight: Column, k: Column) -> Column:
        """ln a of the term in the high half, the sampled (term, t) in the low half."""
        h = F.xxhash64(term, k)
        bits = lambda shift, n: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << n) - 1))
        more = lambda n: F.xxhash64(h, F.lit(n))
        r_cell, c_cell = bits(56, self.CELL_BITS).cast("int"), bits(48, self.CELL_BITS).cast("int")
        b = bits(28, self.B_BITS) * F.lit(1.0 / (1 << self.B_BITS))
        last = F.lit(self.CELLS - self.END)
        ends = F.when(r_cell < F.lit(self.END), F.exp(self.log_below(more(1)))).when(r_cell >= last, self.above(more(1)))
        r = ends.otherwise(self.between(self.r, r_cell, bits(14, self.STEP_BITS)))
        ends = F.when(c_cell < F.lit(self.END), self.log_below(more(2))).when(c_cell >= last, F.log(self.above(more(2))))
        log_c = ends.otherwise(self.between(self.log_c, c_cell, bits(0, self.STEP_BITS)))
        t = F.floor(log_weight / r + b)
        log_a = log_c - r * (t - b + F.lit(1.0))
        # ln a lies within (-192, 64): with 24 bits after the point its number fits 32 bits with a sign.
        rank = (log_a * F.lit(float(1 << 24)) + F.lit(float(1 << 30))).cast("long")
        return F.shiftleft(rank, 32).bitwiseOR(h.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", count: int = SAMPLES) -> DataFrame:
    """keys and fingerprint of every text; keys must tell the rows apart.

    A term's row meets ``AT_ONCE`` samples at a time: with all of them in one aggregation
    the generated method is too long for the JVM to compile.
    """
    words = F.split(F.btrim(text_of(text_col), F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+")  # one empty word if there is none
    spread = docs.select(*keys, F.explode(words).alias("__word")).select(*keys, F.when(F.col("__word") != "", F.xxhash64("__word")).otherwise(F.lit(NO_TERM)).alias("term"))
    weighted = spread.groupBy(*keys, "term").agg(F.count("*").alias("weight"))
    logs = weighted.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("log_weight"), F.explode(F.array(*[F.lit(k) for k in range(0, count, AT_ONCE)])).alias("at"))
    draws = Draws()
    drawn = [F.min(draws.sample(F.col("term"), F.col("log_weight"), F.col("at") + j)).alias(f"s{j}") for j in range(AT_ONCE)]
    low = F.lit((1 << (4 * HEX_DIGITS)) - 1)
    digits = F.concat(*[F.lpad(F.hex(F.coalesce(F.col(f"s{j}").bitwiseAND(low), F.lit(0))), HEX_DIGITS, "0") for j in range(AT_ONCE)])
    parts = logs.groupBy(*keys, "at").agg(*drawn).select(*keys, F.struct("at", digits.alias("digits")).alias("__piece"))
    return parts.groupBy(*keys).agg(F.lower(F.array_join(F.array_sort(F.collect_list("__piece"))["digits"], "")).alias("fingerprint"))


def likeness(a: str, b: str, count: int = SAMPLES) -> Column:
    """Share of the samples in which two fingerprints agree."""
    same = F.lit(0)
    for k in range(count):
        at = k * HEX_DIGITS + 1
        same = same + (F.substring(a, at, HEX_DIGITS) == F.substring(b, at, HEX_DIGITS)).cast("int")
    return same / F.lit(float(count))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text (second half taken from the next document), and likenesses."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text_of(text_col).alias("body"))
    ordered = in_ranges(rows.withColumn("tie", F.xxhash64("body"))).repartition(4 * shuffle_partitions(docs.sparkSession), "part")
    paired = with_next(ordered, ["id", "tie"], "body", "next_body")
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), n - half), F.substring("next_body", F.lit(1), half))
    paired = paired.select("part", "turn", "id", n.cast("long").alias("n_chars"), "body", edited.alias("edited"))
    sides = paired.select("part", "turn", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("body").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("x"))
    prints = fingerprints(sides.select("part", "turn", "x.side", "x.body"), ["part", "turn", "side"], "body")
    both = prints.groupBy("part", "turn").agg(F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    facts = paired.select("part", "turn", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # Sampling is the costly part and its result small: it is written once, for both of the reads that follow.
    with_checkpoint_dir(docs.sparkSession)
    told = facts.join(both, ["part", "turn"]).withColumnRenamed("turn", "place").checkpoint()
    told = with_next(told, ["place"], "fingerprint", "next_fingerprint")
    return told.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read_documents(spark, sf_dir)).withColumn("doc_id", back_to_null("id")).drop("id")
