"""Live streaks and sessions: any order of files and batches, timers, late rows, restarts, and closed logs."""

import datetime

import pytest
from pyspark.sql import functions as F

from sitegauge.streaming import live as L

SCHEMA = "run_id BIGINT, event_id BIGINT, ts TIMESTAMP, success BOOLEAN"
START = datetime.datetime(2024, 1, 1, 8)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def log(spark, folder, files=None):
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/log")


def micros(t):
    return round(t.timestamp() * 1_000_000)


def plain(rows, idle):
    """(run, spell, event, steps, failures, in a row, ended) of all spells, closed."""
    out = set()
    for run in {r[0] for r in rows}:
        state = None
        for _, event, ts, ok in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            if state and (ts - state[5]).total_seconds() >= idle * 60:
                out.add((run, *state[:5], True))
                state = None
            spell, _, n, failures, streak, _ = state or (micros(ts), 0, 0, 0, 0, ts)
            state = (spell, event, n + 1, failures + (not ok), 0 if ok else streak + 1, ts)
            out.add((run, *state[:5], False))
        out.add((run, *state[:5], True))
    return out


ROWS = [(run, i, at(i * 3 + (i // 9) * 12 + run), (i * 7 + run) % 4 == 0) for run in range(3) for i in range(40)]


@pytest.mark.parametrize("parts, files", [(1, None), (4, None), (4, 1)])
def test_same_streaks_for_any_files(spark, tmp_path, parts, files):
    for n in range(parts):
        land(spark, tmp_path, ROWS[::-1][n::parts])
    end = spark.createDataFrame([(None, None, at(5000), None)], SCHEMA)
    got = L.run_closed(log(spark, tmp_path, files), lambda a: L.failure_streaks(a, "10 minutes"), "1000 minutes", end)
    rows = got.collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == plain(ROWS, 10)


def start(spark, folder, operator, delay="5 minutes"):
    query = L.start_appended(operator(log(spark, folder, 1).withWatermark("ts", delay)), f"{folder}/out")
    query.awaitTermination()
    return query


def table(spark, folder):
    return spark.read.parquet(f"{folder}/out/table")


def test_timers_end_idle_runs_and_clear_their_state(spark, tmp_path):
    """Also over a restart of the query: the second file lands when the first query has ended."""
    streaks = lambda a: L.failure_streaks(a, "10 minutes")
    land(spark, tmp_path, [(1, 2, at(2), False), (1, 1, at(1), False), (2, 1, at(3), True)])
    start(spark, tmp_path, streaks)
    assert table(spark, tmp_path).count() == 0  # the watermark has passed nothing
    land(spark, tmp_path, [(3, 1, at(60), False), (1, 9, at(4), True)])
    query = start(spark, tmp_path, streaks)
    rows = {(r.run_id, r.event_id, r.steps, r.failures, r.in_a_row, r.ended) for r in table(spark, tmp_path).collect()}
    assert rows == {(1, 1, 1, 1, 1, False), (1, 2, 2, 2, 2, False), (1, 9, 3, 2, 0, False), (1, 9, 3, 2, 0, True),
                    (2, 1, 1, 0, 0, False), (2, 1, 1, 0, 0, True)}
    # What is left is the step that waits: nothing of the runs that ended.
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert held[-1] < held[0] and held[-1] <= 1
    land(spark, tmp_path, [(1, 10, at(61), False), (1, 11, at(5), False), (9, 1, at(200), True)])
    start(spark, tmp_path, streaks)
    fresh = table(spark, tmp_path).where("run_id = 1 AND event_id >= 10").collect()
    assert {(r.event_id, r.steps, r.failures, r.in_a_row) for r in fresh} == {(10, 1, 1, 1)}  # event 11 was too late
    assert {r.spell for r in fresh} == {micros(at(61))}


def test_sessions_merge_across_batches(spark, tmp_path):
    sessions = lambda a: L.sessions(a, "10 minutes")
    land(spark, tmp_path, [(1, 1, at(0), True), (1, 2, at(16), True), (2, 1, at(1), True)])
    start(spark, tmp_path, sessions, "20 minutes")
    land(spark, tmp_path, [(1, 3, at(8), True)])  # joins the two
    start(spark, tmp_path, sessions, "20 minutes")
    land(spark, tmp_path, [(3, 1, at(100), True)])
    start(spark, tmp_path, sessions, "20 minutes")
    land(spark, tmp_path, [(1, 4, at(20), True), (3, 2, at(101), True)])  # run 1's is behind the watermark
    start(spark, tmp_path, sessions, "20 minutes")
    got = {(r.run_id, r.steps, r.start, r.end) for r in table(spark, tmp_path).collect()}
    assert got == {(1, 3, at(0), at(26)), (2, 1, at(1), at(11))}


def test_steps_without_a_number_or_a_time(spark, tmp_path):
    land(spark, tmp_path, [(1, None, at(1), None), (1, 5, None, True), (None, 1, at(2), True)])
    end = spark.createDataFrame([(None, None, at(5000), None)], SCHEMA)
    rows = L.run_closed(log(spark, tmp_path), L.failure_streaks, "100 minutes", end).where(~F.col("ended")).collect()
    assert [(r.run_id, r.event_id, r.steps, r.failures, r.in_a_row) for r in rows] == [(1, -1, 1, 1, 1)]
