"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of its five-word shingles (64-bit hashes). Texts of equal
   sets form a class and go on as one row with its number of documents.
2. A class has bands of MinHash rows; how many of each follows from the target recall.
   Classes that share a band's hash meet in a bucket. Buckets with the same members as
   one of a lower band are left out.
3. Buckets get the full sets of their members and verify each pair exactly: shared
   shingles are counted by a matrix product over the shingles that two members have.
   A pair counts only in the bucket of its first common band. A bucket of many members
   is cut into blocks, each pair of blocks a task of its own. What leaves a bucket is
   one row a member (its links, and the least member it is linked to), never the pairs.
4. Linked classes are joined to components.

Defined results: texts of one to four words have one shingle, all their words; texts
without words (or null) have none, are linked to nothing and are classes of their own;
a null doc_id counts as greater than all and stays null; repeated rows are documents
with equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lessonloom.llm.common import LAST_ID, WORDS, back_to_null, bodies, in_small_batches, mix, read_documents, shuffle_partitions, small_side, text_key, with_checkpoint_dir, word_hashes
from lessonloom.llm.components import components

WORDS_IN_SHINGLE = 5
THRESHOLD = 0.8
#: Chance that a pair of exactly the threshold's similarity meets in a band.
RECALL = 0.9999
MOST_ROWS = 128
#: Members that one task verifies at once.
BLOCK = 1024


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_ROWS) -> tuple[int, int]:
    """The longest bands (fewest false candidates) whose number for the recall stays within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = bands, rows
    return best


def shingles(body: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words."""
    words = word_hashes(np.frombuffer(body, np.uint8))[0]
    if not len(words):
        return words
    return np.unique(mix(WORDS.windows(words, min(size, len(words))) + np.uint64(min(size, len(words)))))


def set_key(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    if not len(values):
        return b""
    halves = [mix(np.add.reduce(mix(values ^ np.uint64(s)), keepdims=True) + np.uint64(len(values))) for s in (0x2545F4914F6CDD1D, 0x27D4EB2F165667C5)]
    return np.concatenate(halves).tobytes()


class Banding:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(5)
        self.bands, self.rows = bands, rows
        self.factor = (rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """One 64-bit hash a band; the band is part of it."""
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(values), 512):
            part = values[k : k + 512, None]
            least = np.minimum(least, ((part * self.factor + self.shift) ^ (part >> np.uint64(31)) * self.factor).min(0))
        out = self.salt.copy()
        for r in range(self.rows):
            out = mix(out ^ least[r :: self.rows])
        return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, banding: Banding) -> DataFrame:
    """(id, tag, class_key, bands) of every document; an empty class_key for one without shingles."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = (shingles(b, size) for b in bodies(part.column(2)))
            rows = [(set_key(s), banding(s).tobytes() if len(s) else b"") for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "tag", "class_key", "bands"])

    return identified(docs, id_col, text_col).mapInArrow(batches, "id long, tag binary, class_key binary, bands binary")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return in_small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text_key(body).alias("tag"), body.alias("body"))


# --- verification -----------------------------------------------------------------


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of shingles that two sets share."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    who, column, width = who[keep], place[column[keep]], int(shared.sum())
    out = np.zeros((n, n), np.float32)
    step = max(1, (1 << 22) // max(n, 1))
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    for a in range(0, width, step):
        s = slice(*np.searchsorted(column, (a, a + step)))
        m = np.zeros((n, min(step, width - a)), np.float32)
        m[who[s], column[s] - a] = 1
        out += m @ m.T
    return out


def linked(sets: list[np.ndarray], bands: np.ndarray, band: int, threshold: float, side: np.ndarray | None) -> np.ndarray:
    """Matrix of the verified links that this bucket owns: of members of different sides, where sides are given, that share no band before this one."""
    sizes = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets)
    links = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(links, False)
    if side is not None:
        links &= side[:, None] != side[None, :]
    for e in range(band):
        links &= bands[:, None, e] != bands[None, :, e]
    return links


def least_linked(links: np.ndarray) -> np.ndarray:
    """Least member of each member's component, members being in order."""
    label = np.arange(len(links))
    a, b = np.nonzero(links)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


LINKS = "class_key binary, links long, to binary"


def verifier(threshold: float):
    """Function that verifies the members of each spot; rows come sorted by spot, and one spot is in memory at a time."""

    def verify(spot: pa.Table, out: dict[str, list]) -> None:
        get = {c: spot.column(c).to_pylist() for c in ("class_key", "bands", "shingles")}
        # a class once, though two documents may stand for it
        rows = [r for _, r in sorted({k: r for r, k in enumerate(get["class_key"])}.items())]
        if len(rows) < 2:
            return
        keys = [get["class_key"][r] for r in rows]
        sets = [np.frombuffer(get["shingles"][r], np.uint64) for r in rows]
        own = np.array([np.frombuffer(get["bands"][r], np.int64) for r in rows])
        band, side, alone, weight = (spot.column(c).to_numpy()[rows] for c in ("band", "side", "alone", "weight"))
        links = linked(sets, own, int(band[0]), threshold, None if alone[0] else side)
        count = links @ weight.astype(np.float64)
        to = least_linked(links)
        for k in np.flatnonzero(count):
            out["class_key"].append(keys[k])
            out["links"].append(int(count[k]))
            out["to"].append(keys[to[k]])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        at = None
        out: dict[str, list] = {"class_key": [], "links": [], "to": []}
        for part in parts:
            spots = part.column(part.schema.get_field_index("spot")).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(spots)) + 1, [len(spots)])) if len(spots) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if waiting and spots[a] != at:
                    verify(pa.Table.from_batches(waiting), out)
                    waiting = []
                at = spots[a]
                waiting.append(part.slice(a, b - a))
            if len(out["links"]) >= 4096:
                yield told(out)
                out = {c: [] for c in out}
        if waiting:
            verify(pa.Table.from_batches(waiting), out)
        yield told(out)

    def told(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out["class_key"], pa.binary()), pa.array(out["links"], pa.int64()), pa.array(out["to"], pa.binary())], ["class_key", "links", "to"])

    return batches


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS_IN_SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, tag, class_id, n_links, head) of every document, a null id as the last; tag is 128 bits of the text.

    class_id is the least id of the documents linked to it, directly or by others; n_links
    is the number of other documents of similarity ``threshold`` or more, copies included.
    head marks the document that stands for its class: that of the least (id, tag).
    """
    spark = docs.sparkSession
    with_checkpoint_dir(spark)
    bands, rows = bands_and_rows(threshold, recall)
    banding = Banding(bands, rows)
    marked = signatures(docs, id_col, text_col, size, banding).checkpoint()
    classes = marked.where(F.length("class_key") > 0).groupBy("class_key").agg(F.count("*").alias("weight"), F.min(F.struct("id", "tag")).alias("stands"), F.first("bands").alias("bands"))
    band_hash = lambda k: F.xxhash64(F.substring("bands", 8 * k + 1, 8), F.lit(k))
    hashes = F.array(*[F.struct(F.lit(k).alias("band"), band_hash(k).alias("bucket")) for k in range(bands)])
    # Bands are many rows: they carry a short number of their class. Classes of one number only add candidates.
    spread = classes.select(F.xxhash64("class_key").alias("number"), F.explode(hashes).alias("x")).select("number", "x.band", "x.bucket")
    met = spread.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor("number").alias("who"), F.min("number").alias("least"), F.min("band").alias("band")).where("members > 1")
    kept = met.groupBy("members", "who", "least").agg(F.min(F.struct("band", "bucket")).alias("x")).select("members", "x.bucket")
    members = spread.join(kept, "bucket").join(classes.select(F.xxhash64("class_key").alias("number"), "class_key", "weight", "stands"), "number").drop("number").checkpoint()

    def set_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 256):  # sets are larger than texts
                some = part.slice(k, 256)
                sets = [shingles(b, size) for b in bodies(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([banding(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class_key", "bands", "shingles"])

    wanted = members.select("class_key", "stands.id", "stands.tag").distinct()
    texts = identified(docs, id_col, text_col).join(small_side(wanted, 96), ["id", "tag"]).select("class_key", "body")
    sets = texts.mapInArrow(set_batches, "class_key binary, bands binary, shingles binary")
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), "class_key"), blocks).cast("int")
    dealt = members.withColumns({"blocks": blocks, "mine": mine}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spot = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    # Two blocks meet once; a block meets itself alone.
    dealt = dealt.select("class_key", "band", "weight", F.col("mine").alias("side"), (F.col("mine") == F.col("other")).alias("alone"), spot.alias("spot"))
    dealt = dealt.join(sets, "class_key").repartition(4 * shuffle_partitions(spark), "spot").sortWithinPartitions("spot")
    links = dealt.mapInArrow(verifier(threshold), LINKS).checkpoint()
    degree = links.groupBy("class_key").agg(F.sum("links").alias("links"))
    component = components(links.select(F.col("class_key").alias("u"), F.col("to").alias("v")))
    known = classes.select("class_key", "weight", "stands").join(degree, "class_key", "left").join(component.withColumnRenamed("node", "class_key"), "class_key", "left")
    known = known.select("class_key", "weight", "stands", "links", F.coalesce("component", "class_key").alias("component")).checkpoint()
    heads = known.groupBy("component").agg(F.min("stands").alias("first"))
    told = known.join(heads, "component").select("class_key", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = marked.select("id", "tag", "class_key").join(told, "class_key", "left")
    return joined.select(
        "id",
        "tag",
        F.coalesce("first.id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ((F.coalesce("first.id", "id") == F.col("id")) & (F.coalesce("first.tag", "tag") == F.col("tag"))).alias("head"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that stand for their classes, one row each, with their own columns."""
    found = jaccard_classes(docs, id_col, text_col, **settings).select("id", "tag", "head").checkpoint()
    others = found.where("not head").select("id", "tag").distinct()
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text_key(body).alias("tag"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Equal rows of one id share their tag: of those all but one go.
    again = found.where("head").groupBy("id", "tag").count().where("count > 1").select("id", "tag")
    left = rows.join(small_side(others, 48), ["id", "tag"], "left_anti")
    once = left.join(small_side(again, 48), ["id", "tag"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.lit(0)))
    first = left.join(small_side(again, 48), ["id", "tag"]).withColumn("turn", turn).where("turn = 1").select("id", "tag", "row")
    return once.unionByName(first).select("row.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(read_documents(spark, sf_dir))
    return found.select(back_to_null("id").alias("doc_id"), back_to_null("class_id").alias("class_id"), "n_links")
