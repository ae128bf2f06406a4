"""Keyed state with maps and event-time timers: cycle progress and session ends, each equal to its table form.

State lies in RocksDB: a step reads and writes the items it meets, not a whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from lessonloom.operators.practice import PROGRESS_KEY, with_progress_key

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_KEY = "spark.sql.streaming.stateStore.providerClass"


def with_map_state(spark: SparkSession) -> None:
    """Keyed maps and timers need the RocksDB state store; a session that names another keeps its own choice of settings but this."""
    spark.conf.set(STATE_KEY, ROCKS)


#: Keys travel as one text: a null among grouping columns would make every row a group of its own in Python.
KEY = "state_key"


def key_of(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys)).alias(KEY)


def with_keys(rows: DataFrame, schema: StructType) -> DataFrame:
    """The key's own columns in place of its text."""
    return rows.select(F.from_json(KEY, schema).alias("of"), *[c for c in rows.columns if c != KEY]).select("of.*", *[c for c in rows.columns if c != KEY])


#: Columns beside the keys of what the stream tells.
TOLD = "completed long, current_cycle long, open_clears long, correct_clears long, stage int, semantic_type string, updated_at timestamp"


def told(keys: list[str]) -> list[str]:
    return [c.split()[0] for c in TOLD.split(", ") if c.split()[0] not in keys]


class CycleProcessor(StatefulProcessor):
    """Summary of a progress key as one value, the open cycle's items as a map."""

    SUMMARY = "completed long, clears long, correct_clears long, stage int, semantic_type string, updated_at timestamp, seen boolean, stray string"

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle) -> None:
        self.summary = handle.getValueState("summary", self.SUMMARY)
        self.clears = handle.getMapState("clears", "item_key string", "cleared_at timestamp")
        self.active = handle.getValueState("active", "items array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["created_at", "kind", "id"], na_position="first")
        completed, n, correct_clears, stage, semantic, at, seen, stray = self.summary.get() if self.summary.exists() else (0, 0, 0, None, None, None, False, None)
        held = self.active.get()[0] if self.active.exists() else None
        active = None if held is None else set(held)
        changed = False
        for row in batch.itertuples(index=False):
            if row.kind == 0:  # the items that are there from now on
                active, stray = set(row.active_items), None
                self.active.update((list(row.active_items),))
                gone = [item for (item,) in self.clears.keys() if item not in active] if n else []
                self._forget(gone)
                n -= len(gone)
                changed = changed or bool(gone)
                continue
            if stray is not None:  # an item of no present set counted when it came, and goes with the next
                self._forget([stray])
                n, stray = n - 1, None
            item, size, when = row.item_key, int(row.stage_item_count), row.created_at
            repeated = n > 0 and self.clears.containsKey((item,))
            seen = changed = True
            if not repeated:
                self.clears.updateValue((item,), (when,))
                n += 1
                if active is not None and item not in active:
                    stray = item
            closed = n >= size
            if repeated and not (closed and active is not None):
                continue
            stage, semantic, at = (None if pd.isna(row.last_stage) else int(row.last_stage)), row.last_type or None, when
            if closed:
                completed, n, stray = completed + 1, 0, None
                self.clears.clear()
            correct_clears = completed * size + n
        self.summary.update((completed, n, correct_clears, stage, semantic, None if at is None or pd.isna(at) else at, seen, stray))
        if seen and changed:
            found = {"completed": completed, "current_cycle": completed + 1, "open_clears": n, "correct_clears": correct_clears, "stage": stage, "semantic_type": semantic, "updated_at": at}
            yield pd.DataFrame([{KEY: key[0]} | {c: found[c] for c in told(self.keys)}]).astype({"stage": "Int32"} if "stage" not in self.keys else {})

    def _forget(self, items: list[str]) -> None:
        for item in items:
            self.clears.removeKey((item,))

    def close(self) -> None:
        pass


def cycle_stream(attempts: DataFrame, active: DataFrame | None = None, keys: list[str] = PROGRESS_KEY) -> DataFrame:
    """Cycle progress of each key that a micro-batch changes: keys, completed, current_cycle, open_clears, correct_clears, stage, semantic_type, updated_at.

    attempts: a stream, as for ``cycle_progress``. active: a second stream (keys,
    active_items, created_at) of the items that are there from an instant on; a key
    without one counts all items. Rows count in the order of (created_at, id) inside a
    micro-batch, micro-batches as they come.
    """
    with_map_state(attempts.sparkSession)
    given = with_progress_key(attempts).where("correct and stage_item_count > 0")
    time = F.col("created_at").cast("timestamp").alias("created_at")
    extra = {"kind": "int", "id": "long", "item_key": "string", "stage_item_count": "long", "last_stage": "int", "last_type": "string", "active_items": "array<string>"}

    def shaped(rows: DataFrame, **own) -> DataFrame:
        return rows.select(key_of(keys), time, *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in extra.items()])

    rows = shaped(given, kind=F.lit(1), last_stage=F.col("stage"), last_type=F.col("semantic_type"), **{c: F.col(c) for c in ("id", "item_key", "stage_item_count")})
    if active is not None:
        rows = rows.unionByName(shaped(active, kind=F.lit(0), active_items=F.col("active_items")))
    out = StructType([*StructType.fromDDL(f"{KEY} string"), *[f for f in StructType.fromDDL(TOLD) if f.name not in keys]])
    found = rows.groupBy(KEY).transformWithStateInPandas(CycleProcessor(keys), out, "Update", "None")
    return with_keys(found, StructType([given.schema[k] for k in keys]))


LOGOUT, CODE_CHANGE, DEACTIVATED, EXPIRY = range(4)
REASONS = ["logout", "code_change", "deactivated", "expiry"]
START = -1


class SessionProcessor(StatefulProcessor):
    """Open sessions of a student with the end that is known so far; a timer fires when no earlier end can come."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "id long", "created_us long, end_us long, reason int")
        self.endings = handle.getMapState("endings", "kind int, session_id long, at_us long", "seen boolean")

    @staticmethod
    def _due(end_us: int) -> int:
        """The millisecond at which the watermark has passed an instant."""
        return end_us // 1000 + 1

    def _close(self, key, name: int, end_us: int, reason: int) -> None:
        created, now_us, now_reason = self.open.getValue((name,))
        if (end_us, reason) < (now_us, now_reason) and end_us >= created:
            self.open.updateValue((name,), (created, end_us, reason))
            self.handle.registerTimer(self._due(end_us))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        names = [name for (name,) in self.open.keys()] if self.open.exists() else []
        for row in batch[batch["kind"] == START].itertuples(index=False):
            name, expires = int(row.session_id), int(row.expires_us)
            self.open.updateValue((name,), (int(row.at_us), expires, EXPIRY))
            self.handle.registerTimer(self._due(expires))
            names.append(name)
            for kind, session, at in list(self.endings.keys()) if self.endings.exists() else []:  # those that came before the session's own row
                if kind != LOGOUT or session == name:
                    self._close(key, name, at, kind)
        for row in batch[batch["kind"] != START].itertuples(index=False):
            kind, at = int(row.kind), int(row.at_us)
            session = int(row.session_id) if kind == LOGOUT else 0
            self.endings.updateValue((kind, session, at), (True,))
            self.handle.registerTimer(self._due(at))
            for name in [session] if kind == LOGOUT else names:
                if self.open.containsKey((name,)):
                    self._close(key, name, at, kind)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for (name,), (created, end_us, reason) in list(self.open.iterator()) if self.open.exists() else []:
            if self._due(end_us) <= passed:
                out.append((key[0], name, created, end_us, REASONS[reason]))
                self.open.removeKey((name,))
        for ending in list(self.endings.keys()) if self.endings.exists() else []:
            if self._due(ending[2]) <= passed:  # what starts later it cannot end
                self.endings.removeKey(ending)
        yield pd.DataFrame(out, columns=[KEY, "id", "created_us", "ended_us", "reason"])

    def close(self) -> None:
        pass


def session_stream(sessions: DataFrame, logouts: DataFrame, code_changes: DataFrame, deactivations: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(id, student_id, created_at, ended_at, reason) of each session once its end is past: what nobody sends, the watermark brings.

    sessions: id, student_id, created_at, expires_at; logouts: session_id, student_id,
    happened_at; the others: student_id, happened_at. All four are streams; rows may come
    in any order within ``delay``. Of ends at one instant logout comes before change of
    code, deactivation and expiry, as in ``session_intervals``.
    """
    with_map_state(sessions.sparkSession)
    none = F.lit(None).cast("long")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    who = key_of(["student_id"])
    rows = sessions.select(who, F.col("created_at").cast("timestamp").alias("at"), F.lit(START).alias("kind"), F.col("id").cast("long").alias("session_id"), micros("created_at").alias("at_us"), micros("expires_at").alias("expires_us"))
    for kind, events in ((LOGOUT, logouts), (CODE_CHANGE, code_changes), (DEACTIVATED, deactivations)):
        session = F.col("session_id").cast("long") if kind == LOGOUT else none
        rows = rows.unionByName(events.select(who, F.col("happened_at").cast("timestamp").alias("at"), F.lit(kind).alias("kind"), session.alias("session_id"), micros("happened_at").alias("at_us"), none.alias("expires_us")))
    out = StructType.fromDDL(f"{KEY} string, id long, created_us long, ended_us long, reason string")
    ended = rows.withWatermark("at", delay).groupBy(KEY).transformWithStateInPandas(SessionProcessor(), out, "Append", "EventTime")
    ended = with_keys(ended, StructType([sessions.schema["student_id"]]))
    time = lambda c: F.timestamp_micros(F.col(c))
    return ended.select("id", "student_id", time("created_us").alias("created_at"), time("ended_us").alias("ended_at"), "reason")
