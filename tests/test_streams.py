"""Streams against their batch twins, for one file, a folder of parts, and one file per batch in no order of time."""

import datetime

import oracle
import pytest
from pyspark.sql import functions as F

from sitegauge.plans.catalog import ORACLES, QUERIES
from sitegauge.plans import everything  # noqa: F401
from sitegauge.sources.tables import Tables
from sitegauge.streaming import streams as S

NAMES = sorted(n for n in QUERIES if n.startswith("stream_"))
SCHEMA = "run_id BIGINT, event_id BIGINT, at TIMESTAMP_NTZ, success BOOLEAN, progress_score DOUBLE, url STRING"


@pytest.fixture(scope="module")
def parts(spark, data, tmp_path_factory):
    """The tables that streams read, as folders of three files each whose rows are dealt by hash, so not by time."""
    folder = tmp_path_factory.mktemp("parts")
    for name in ("pages", "events", "lineitem"):
        table = spark.read.parquet(f"{data}/{name}.parquet")
        table.repartition(3, F.xxhash64(*table.columns)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("layout", ["one file", "folder", "file per batch"])
def test_any_layout(spark, data, parts, monkeypatch, name, layout):
    monkeypatch.setattr(Tables, "files_per_trigger", 1 if layout == "file per batch" else None)
    rows = QUERIES[name](spark, data if layout == "one file" else parts)
    assert oracle.compare(rows, oracle.connect(data), ORACLES[name]) == ""


@pytest.fixture
def landed(spark, tmp_path):
    """Three files of one run that land one after another, and the rows in them."""
    start = datetime.datetime(2024, 1, 1, 23, 50)
    rows = [(1, i, start + datetime.timedelta(seconds=60 * i), i % 4 != 0 and i < 10, (i % 10) / 10, f"https://x/{i % 2}") for i in range(15)]
    for n in (2, 0, 1):  # the last steps land first
        part = spark.createDataFrame(rows[n * 5:(n + 1) * 5], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "log.parquet"))
    return str(tmp_path), rows


def stream(spark, folder):
    table = spark.read.parquet(f"{folder}/log.parquet")
    return S.with_time(S.read_stream(spark, folder, "log", 1), "at", S.replay_delay(table, "at"))


def test_run_state_crosses_batches_and_windows(spark, landed):
    folder, rows = landed
    got = S.run_state(S.run_updates(S.run_parts(stream(spark, folder)), ["window", "run_id", "stretch"])).first()
    in_a_row = 0
    for r in rows:
        in_a_row = 0 if r[3] else in_a_row + 1
    lost = sum(25 if r[4] > 0.6 else 100 if r[4] < 0.3 else 50 for r in rows)
    assert (got.steps, got.failures, got.in_a_row) == (15, sum(not r[3] for r in rows), in_a_row)
    assert got.confidence_left == max(0, 1000 - lost) and got.elapsed_us == 14 * 60_000_000


@pytest.mark.parametrize("outcomes", ["", "f", "t", "tf", "ft", "f" * 200, "t" + "f" * 130, "f" * 62 + "t", "f" * 63 + "tff", "tf" * 100])
def test_streaks_over_stretches(spark, outcomes):
    start = datetime.datetime(2024, 1, 1)
    rows = [(1, i + 5, start + datetime.timedelta(hours=i), c == "t", 0.5, "u") for i, c in enumerate(outcomes)]
    log = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("at").cast("timestamp"))
    got = S.run_state(S.run_parts(log)).collect()
    assert [r.in_a_row for r in got] == ([len(outcomes) - len(outcomes.rstrip("f"))] if outcomes else [])


def test_state_of_updates_is_kept_in_files(spark, landed, tmp_path, monkeypatch):
    """State is in files of a bounded cache and not in the heap; no batch reads all of it at the end; the session keeps its settings."""
    folder, _ = landed
    monkeypatch.setattr(S, "shared_folder", lambda spark: f"{tmp_path}/shared")
    names = [*S.STATE, *S.ONE_PASS]
    before = [spark.conf.get(n, None) for n in names]
    windows = S.run_updates(S.visit_loops(stream(spark, folder)), ["window", "run_id", "page"])
    assert windows.count() == 4 and [spark.conf.get(n, None) for n in names] == before
    state = {f.suffix for f in (tmp_path / "shared" / "state" / "state").rglob("*") if f.is_file()}
    assert ".zip" in state and not state & {".delta", ".snapshot"}
    assert len([f for f in (tmp_path / "shared" / "state" / "commits").iterdir() if f.name.isdigit()]) == 3  # one for each file that landed


def test_visits_add_up(spark, landed):
    folder, _ = landed
    windows = S.run_updates(S.visit_loops(stream(spark, folder)), ["window", "run_id", "page"])
    assert windows.count() == 4  # two pages on two days
    assert {r.page: r.visits for r in S.visits_so_far(windows).collect()} == {"https://x/0": 8, "https://x/1": 7}


def test_state_is_dropped_behind_the_watermark(spark, landed):
    """With a short delay a live stream keeps only the windows that can still change."""
    folder, _ = landed
    table = S.with_time(S.read_stream(spark, folder, "log", 1), "at", "1 minute")
    counts = []
    query = (S.visit_loops(table).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.format("noop").mode("overwrite").save())
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    for progress in query.recentProgress:
        counts += [op["numRowsTotal"] for op in progress["stateOperators"]]
    assert counts and counts[-1] <= 2
