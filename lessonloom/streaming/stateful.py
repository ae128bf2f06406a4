"""Keyed state on streams: login lockout, thinned touches and tap replay, each equal to its batch fold.

Rows of a key are sorted inside a micro-batch; what a key keeps is bounded (failures of
one window, one instant, one run).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom import constants as C


def lockout_stream(tries: DataFrame, limits: dict[str, int] = C.LOGIN_LIMITS, minutes: int = C.FAILURE_WINDOW_MINUTES, watermark: str = "1 hour", key: str = "realm") -> DataFrame:
    """(realm, id, blocked_by) of blocked tries, as ``login_lockout`` has them; tries: realm, id, created_at, successful, admin, code, client.

    A realm's state holds the failures of one window; it goes when the watermark passes
    the last of them by the window.
    """
    window = minutes * 60_000_000

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kinds, whos, times = state.get if state.exists else ([], [], [])
        failed, out = list(zip(kinds, whos, times)), []
        rows = pd.concat(list(batches)).sort_values(["at_us", "id"])
        for at, i, fine, admin, code, client in rows[["at_us", "id", "successful", "admin", "code", "client"]].itertuples(index=False):
            failed = [x for x in failed if x[2] >= at - window]
            checks = (("admin_client", client), ("admin", "")) if admin else (("student_client", client), ("code", code))
            blocked = next((kind for kind, who in checks if sum(x[:2] == (kind, who) for x in failed) >= limits[kind]), None)
            if blocked:
                out.append((*name, i, blocked))
            elif not fine:
                failed += [(kind, who, int(at)) for kind, who in checks]
        state.update(tuple(map(list, zip(*failed))) if failed else ([], [], []))
        last = max((x[2] for x in failed), default=int(rows["at_us"].max()))
        state.setTimeoutTimestamp(max((last + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "id", "blocked_by"])

    timed = tries.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    rows = timed.select(key, "id", "created_at", F.unix_micros("created_at").alias("at_us"), "successful", "admin", "code", "client")
    kind = lambda c: tries.schema[c].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind(key)}, id {kind('id')}, blocked_by string", "kinds array<string>, whos array<string>, times array<long>", "append", "EventTimeTimeout")


def thin_stream(touches: DataFrame, minutes: int = C.TOUCH_MINUTES) -> DataFrame:
    """(session_id, at_us) of written touches; touches: session_id, at_us, started_us (null counts as due)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("at_us")
        started = rows["started_us"].dropna()
        last = state.get[0] if state.exists else (int(started.min()) if len(started) else None)
        kept = []
        for at in rows["at_us"]:
            if last is None or at > last + minutes * 60_000_000:
                last = int(at)
                kept.append(last)
        state.update((last,))
        yield pd.DataFrame({"session_id": [key[0]] * len(kept), "at_us": kept})

    rows = touches.select("session_id", "at_us", "started_us")
    return rows.groupBy("session_id").applyInPandasWithState(fold, f"session_id {touches.schema['session_id'].dataType.simpleString()}, at_us long", "last long", "append", "NoTimeout")


def tap_stream(taps: DataFrame, step: int) -> DataFrame:
    """Run states after each micro-batch; taps: run_id, seq, chip, norm (the run's normalised words)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, slips, mistakes, restarts = state.get if state.exists else ([], 0, 0, 0)
        used = list(used)
        rows = pd.concat(list(batches)).sort_values("seq")
        words = list(rows["norm"].iloc[0])
        allowance = None if step == 1 else int(len(words) >= C.LONG_SENTENCE_WORDS)
        for chip in map(int, rows["chip"]):
            if len(used) >= len(words) or not 0 <= chip < len(words) or chip in used:
                continue
            if words[chip] == words[len(used)]:
                used.append(chip)
                continue
            mistakes += 1
            slips += 1
            if allowance is not None and slips > allowance:
                used, slips, restarts = [], 0, restarts + 1
        state.update((used, slips, mistakes, restarts))
        yield pd.DataFrame({"run_id": [key[0]], "placed": [len(used)], "mistakes": [mistakes], "restarts": [restarts], "completed": [len(used) >= len(words)]})

    rows = taps.select("run_id", "seq", "chip", "norm")
    return rows.groupBy("run_id").applyInPandasWithState(fold, "run_id long, placed int, mistakes int, restarts int, completed boolean", "used array<int>, slips int, mistakes int, restarts int", "update", "NoTimeout")
