"""Conversation structure repair by one integer minimum.

The cheapest way to edit a conversation into ``(s?(ua)+)?`` is a shortest path through a
layered graph: a layer for each row, in it the state of the roles so far. A path's weight
is one integer: its cost in the high digits, and below them a digit for each edit letter,
in the order of the letters, from the first place down, zeros after the last. The integer
minimum is so the least cost and among its paths the least audit in ASCII order; weights
are taken from the last row backwards, so that two of one state are compared on all that
follows. The audit is read off the digits of the result.

Rows are dealt by conversation and sorted by turn; a task reads them batch by batch. For
the decision only facts travel (no texts): a code and 16 bytes stay in memory for each row
of the conversation at hand. The edits then meet the sorted rows, one at a time.

Defined results: a null conv_id is a conversation of its own; null turns come first; rows
of one turn go by role, then by 128 bits of their text, and repeated rows are rows; a null
role or text is one space, so a null text is blank and a null role fits nowhere; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lessonloom.functions.session import plain_unions
from lessonloom.llm.common import BLANKS, in_small_batches, with_checkpoint_dir

#: Edit letters by the value of their digit: in ASCII order, after the zero of the padding.
LETTERS = "\0DIKR"
DIGIT = {letter: k for k, letter in enumerate(LETTERS)}
WIDTH = 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Next state by state and role initial.
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: What may be put in at a state, and the state after it.
INSERT = [(state, after) for state, turns in enumerate(NEXT) for initial, after in turns.items() if initial != "s"]
ACCEPTED = (EMPTY, ASSISTANT)
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: Codes of a row: must go, or its initial, and whether it is truncated.
GOES = "-"


def cheapest(rows: list[tuple[str, bool]]) -> tuple[int, str]:
    """(cost, audit) of rows (initial or GOES, truncated)."""
    places = len(rows) + 2 * (len(rows) + 1)  # at most two inserts are of use between two rows
    shift = WIDTH * places
    low, top = (1 << shift) - 1, shift - WIDTH
    never = (3 * places + 4) << shift

    def before(letter: str, cost: int, weight: int) -> int:
        return (((weight >> shift) + cost) << shift) | (DIGIT[letter] << top) | ((weight & low) >> WIDTH)

    def inserted(weights: list[int]) -> list[int]:
        for _ in range(2):
            found = list(weights)
            for state, after in INSERT:
                if weights[after] < never:
                    found[state] = min(found[state], before("I", 2, weights[after]))
            weights = found
        return weights

    now = inserted([0 if state in ACCEPTED else never for state in range(4)])
    for initial, truncated in reversed(rows):
        then = []
        for state, turns in enumerate(NEXT):
            best = before("D", 3, now[state]) if now[state] < never else never
            if initial != GOES:
                if initial in turns and now[turns[initial]] < never:
                    best = min(best, before("K", truncated, now[turns[initial]]))
                for role in turns.keys() - {"s"}:
                    if now[turns[role]] < never:
                        best = min(best, before("R", 2 + truncated, now[turns[role]]))
            then.append(best)
        now = inserted(then)
    digits = now[EMPTY] & low
    audit = []
    while digits:
        audit.append(LETTERS[digits >> top])
        digits = (digits << WIDTH) & low
    return now[EMPTY] >> shift, "".join(audit)


def replay(audit: str) -> Iterator[tuple[str, str | None]]:
    """Each edit with the role that it gives a row (None: its own); the row's initial is sent in after a K."""
    state = EMPTY
    for letter in audit:
        if letter == "D":
            yield letter, None
            continue
        if letter == "K":
            initial = yield letter, None
            state = NEXT[state][initial]
            continue
        role = "assistant" if state == USER else "user"
        state = NEXT[state][role[0]]
        yield letter, role


class _Conversation:
    """Counts and codes of the rows of one conversation, as they come by turn."""

    def __init__(self) -> None:
        self.codes: list[tuple[str, bool]] = []
        self.seen: set[bytes] = set()
        self.least = self.most = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.role: str | None = None

    def add(self, turn: int | None, initial: str, blank: bool, open_end: bool, tag: bytes) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.least, self.most, self.last = turn if self.least is None else self.least, turn, turn
        again, goes = tag in self.seen, False
        self.seen.add(tag)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif open_end:
            self.truncated += 1
        goes = blank or again
        if self.role is not None:
            self.illegal += self.role + initial not in ("su", "ua", "au")
        self.role = initial
        self.codes.append((GOES if goes else initial if initial in ("s", "u", "a") else "", open_end and not goes))

    def facts(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.codes))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with conv, role, text and turn without their nulls' trouble, and tag: 128 bits of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    tag = F.substring(F.unhex(F.sha2(F.concat(role, F.lit("\0"), text).cast("binary"), 256)), F.lit(1), F.lit(16))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), tag.alias("tag"), *[F.col(c) for c in ("dropped",) if c in rows.columns])


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return in_small_batches(rows).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "tag")


def audits(conversations: DataFrame) -> DataFrame:
    """conv_id and the columns of FACTS. Rows marked ``dropped`` (a column that may be missing) only name their conversation."""
    rows = ordered(conversations)
    rows = rows if "dropped" in rows.columns else rows.withColumn("dropped", F.lit(False))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    facts = rows.select("conv_id", "turn", "role", "tag", "dropped", F.left("role", F.lit(1)).alias("initial"), (last == "").alias("blank"), (~last.rlike("[.!?]")).alias("open_end"))
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(FACTS).fields])
    arrow = to_arrow_schema(schema)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = (), None
        for part in parts:
            out = []
            for conv, turn, tag, dropped, initial, blank, open_end in zip(*(part.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6, 7))):
                if name != (conv,):
                    if at is not None:
                        out.append((*name, *at.facts()))
                    name, at = (conv,), _Conversation()
                if not dropped:
                    at.add(turn, initial, blank, open_end, tag)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*name, *at.facts())))], schema=arrow)

    return _in_order(facts).mapInArrow(fold, schema)


def repaired_rows(conversations: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations; decided: the result of ``audits``.

    The rows of a conversation come in order, in one partition.
    """
    plain_unions(conversations.sparkSession)
    rows = ordered(conversations)
    if "dropped" in rows.columns:
        rows = rows.where(~F.col("dropped")).drop("dropped")
    none = F.lit(None)
    heads = decided.where("audit <> ''").select("conv_id", none.cast("long").alias("turn"), F.lit("").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("tag"), "audit")
    both = rows.withColumn("audit", none.cast("string")).unionByName(heads).withColumn("is_row", F.col("audit").isNull())
    schema = StructType.fromDDL("conv_id long, place long, role string, text string")
    arrow = to_arrow_schema(schema)

    def edit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, edits, place, held = (), None, 0, None
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal place
            out.append((*name, place, role, text))
            place += 1

        def inserts() -> None:
            """Puts in what comes before the next row, and holds that row's edit."""
            nonlocal held
            for held in edits:
                if held[0] != "I":
                    return
                put(held[1], "")
            held = None

        for part in parts:
            for conv, role, text, audit in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text", "audit"))):
                if audit is not None:
                    name, edits, place = (conv,), replay(audit), 0
                    inserts()
                    continue
                if held[0] != "D":
                    put(held[1] or role, text)
                if held[0] == "K":  # the next edit comes with what the initial leads to
                    try:
                        held = edits.send(role[0])
                    except StopIteration:
                        held = None
                    while held and held[0] == "I":
                        put(held[1], "")
                        held = next(edits, None)
                else:
                    inserts()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)
            out.clear()

    return _in_order(both, "is_row").mapInArrow(edit, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations as ``repaired_rows`` leaves them: ``role:text``, joined by line feeds; read as they come."""
    schema = StructType.fromDDL("conv_id long, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = (), None
        for part in parts:
            out = []
            for conv, role, text in zip(*(part.column(c).to_pylist() for c in (0, 2, 3))):
                if name != (conv,):
                    if held:
                        out.append((*name, held.hexdigest()))
                    name, held = (conv,), hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*name, held.hexdigest())))], schema=arrow)

    return repaired.mapInArrow(fold, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults of the contract, by crc32 of ``conv_id:turn``; rows that fault 0 takes are marked ``dropped``."""
    shown: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown["text"], "[.!?]", "")).otherwise(shown["text"])
    role = F.when(fault == 4, "user").otherwise(shown["role"])
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("dropped"), copies).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoint_dir(spark)
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    decided = audits(rows).checkpoint()
    done = digests(repaired_rows(rows, decided)).withColumnRenamed("conv_id", "of")
    nothing = hashlib.sha256(b"").hexdigest()
    return decided.join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *[c.split()[0] for c in FACTS.split(", ")], F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
