"""Streaks and sessions of a live step log, held in state that the watermark and timers clear.

Steps may land in any order within the delay. A run's steps wait in a list until the watermark has passed them and are then
folded in the order of time, so the result is the same however they are split into files and batches. When a run has been
idle for long enough in event time, a timer ends its spell: the totals are emitted and the state is cleared; a later step begins
another spell. Steps later than the delay are dropped, as are steps without a time; steps without a number go by their time. All steps of a run that land in one batch meet in one task; for logs in which
one run holds a large share of all rows, ``streams.run_parts`` spreads a run over its windows.

A finite log ends without a watermark that passes its last steps. ``run_closed`` therefore runs the query over what is there, lands
one row without a run behind all others, and restarts the query from its checkpoint, which closes what is open. That row must
reach the watermark, so the operators keep rows without a run (as one run); ``run_closed`` leaves them out when it reads.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.shared import shared_folder
from .streams import rocks_state

IDLE = "10 minutes"
STEPS = "run_id bigint, event_id bigint, us bigint, success boolean"
STREAKS = "run_id bigint, spell bigint, event_id bigint, steps bigint, failures bigint, in_a_row bigint, ended boolean"


def seconds_of(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def streak_processor(idle_us: int) -> StatefulProcessor:
    """Made here, so that executors get its code along with the query and need not import this package."""

    class Streaks(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.run = handle.getValueState("run", "spell long, steps long, failures long, in_a_row long, last long, event long")
            self.waiting = handle.getListState("waiting", "us long, event long, ok boolean")

        def row(self, key, state, ended):
            spell, steps, failures, in_a_row, _, event = state
            return key, spell, event, steps, failures, in_a_row, ended

        def advance(self, key, fresh, watermark_us):
            """Fold the steps that the watermark has passed; the rest waits, with a timer for the next of them."""
            steps = sorted([*[tuple(r) for r in self.waiting.get()], *fresh])
            due = [s for s in steps if s[0] < watermark_us]
            later = steps[len(due):]
            state, out = self.run.get() if self.run.exists() else None, []
            for us, event, ok in due:
                if state and us - state[4] >= idle_us:
                    out.append(self.row(key, state, True))
                    state = None
                spell, n, failures, in_a_row = state[:4] if state else (us, 0, 0, 0)
                state = (spell, n + 1, failures + (not ok), 0 if ok else in_a_row + 1, us, event)
                out.append(self.row(key, state, False))
            if state and not later and state[4] + idle_us <= watermark_us:
                out.append(self.row(key, state, True))
                state = None
            # Replaced as a whole; an empty list has no entry.
            self.waiting.put(later) if later else self.waiting.clear()
            self.run.update(tuple(state)) if state else self.run.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            wake = later[0][0] if later else state[4] + idle_us if state else None
            if wake is not None:
                self.handle.registerTimer(max(wake, watermark_us) // 1000 + 1)
            names = ["run_id", "spell", "event_id", "steps", "failures", "in_a_row", "ended"]
            return pd.DataFrame(out, columns=names)

        def handleInputRows(self, key, rows, timerValues):
            fresh = [(int(u), int(e), bool(ok)) for part in rows
                     for u, e, ok in zip(part["us"], part["event_id"], part["success"], strict=True)]
            yield self.advance(key[0], fresh, timerValues.getCurrentWatermarkInMs() * 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self.advance(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

        def close(self):
            pass

    return Streaks()


def failure_streaks(actions: DataFrame, idle: str = IDLE) -> DataFrame:
    """Per step, once final: its run, the spell (its first step's time in microseconds), steps, failures and failures in a row
    so far; and one row more when the spell ends. ``actions`` holds (run_id, event_id, ts, success) with a watermark on ts."""
    steps = actions.where(F.col("ts").isNotNull()).select(
        F.col("run_id").cast("long").alias("run_id"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), "ts",
        F.unix_micros("ts").alias("us"), F.coalesce("success", F.lit(False)).alias("success"))
    return steps.groupBy("run_id").transformWithStateInPandas(
        streak_processor(seconds_of(idle) * 1_000_000), STREAKS, "Append", "EventTime")


def sessions(actions: DataFrame, gap: str = IDLE) -> DataFrame:
    """(run_id, start, end, steps) of a run's steps without a pause of the gap or longer; its state are merged session windows."""
    window = F.session_window("ts", gap)
    return actions.groupBy(window.alias("session"), "run_id").agg(F.count("*").alias("steps")).select(
        "run_id", "session.start", "session.end", "steps")


def start_appended(stream: DataFrame, folder: str):
    """A query that appends to a table below ``folder`` and can be started again from there."""
    with rocks_state(stream.sparkSession):
        return (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table")
                .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())


def run_closed(actions: DataFrame, operator: Callable[[DataFrame], DataFrame], delay: str, end: DataFrame) -> DataFrame:
    """Run ``operator`` over a finite log (run_id, event_id, ts, success) without a watermark yet, and close it.

    ``end`` is one row whose ts is later than any row by the delay and more than the idle time."""
    spark, folder = actions.sparkSession, shared_folder(actions.sparkSession)
    columns = ["run_id", "event_id", "ts", "success"]
    last = end.select(*columns)
    last.limit(0).write.parquet(f"{folder}/end")
    closing = spark.readStream.schema(last.schema).parquet(f"{folder}/end")
    stream = operator(actions.select(*columns).unionByName(closing).withWatermark("ts", delay))
    start_appended(stream, folder).awaitTermination()
    last.write.mode("append").parquet(f"{folder}/end")
    start_appended(stream, folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table").where("run_id IS NOT NULL")
