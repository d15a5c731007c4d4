"""Streaming forms of the batch operators. On a finite input they agree with their batch twins, however many files
or micro-batches it comes in.

Keyed state is made of sums, least and greatest values and bit sets per key and event-time window. These do not depend on
the order in which rows come, are folded before the shuffle, so a hot run is spread over its windows, and are dropped once the
watermark has passed their window. Streaks are folded afterwards from those small rows; ``live`` holds those that are live.

Results go to a table below ``spark.checkpoint.dir``, the folder all executors share. Updates carry the batch
they come from, so the latest value of a key is the one of its last batch.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import html as H
from ..sources.shared import shared_folder

# How late a row of a live stream may come, and the width of the windows that hold a key's state.
DELAY = "10 minutes"
STATE_WINDOW = "1 day"
# State is kept in files of each executor and in the checkpoint, not in its heap. All stores of an executor share one cache and
# one bound on what is not yet in files, whatever the number of keys and partitions.
ROCKS = "spark.sql.streaming.stateStore.rocksdb"
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         f"{ROCKS}.boundedMemoryUsage": "true", f"{ROCKS}.maxMemoryUsageMB": "200"}
# Where a trigger takes all that is there and updates are the result, a batch without rows would read all state and emit nothing, so it
# is left out; a task's store is closed when it is committed, so an executor has as many open as it has tasks.
ONE_PASS = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
# Steps whose outcomes fit the bits of one long.
BITS = 63


def read_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table, one file or a folder of part files, as it lands. By default a trigger takes all that is there."""
    path = f"{directory}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern that only this name matches: a source takes files or folders that match one, but no plain path to a file.
    return reader.parquet(f"{directory}/{name}.parque[t]")


def with_time(df: DataFrame, column: str, delay: str = DELAY, out: str = "ts") -> DataFrame:
    """Event time as the timestamp type that watermarks take. Rows later than the delay are dropped by keyed operators."""
    return df.withColumn(out, F.col(column).cast("timestamp")).withWatermark(out, delay)


def replay_delay(table: DataFrame, column: str) -> str:
    """The delay with which no row of a finite table is late, in whatever order its files are: its span of time."""
    moment = F.unix_seconds(F.col(column).cast("timestamp"))
    seconds = table.agg(F.max(moment) - F.min(moment)).first()[0] or 0
    return f"{seconds + 1} seconds"


@contextmanager
def rocks_state(spark: SparkSession, more: dict[str, str] | None = None):
    """The settings of ``STATE`` and ``more`` for queries that start in here; they are fixed when a query starts."""
    settings = {**STATE, **(more or {})}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_appended(stream: DataFrame) -> DataFrame:
    """Run an append stream over what is there and read its table."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table")
     .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update stream and keep the latest row per key. A batch that is retried writes its own folder again."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def save(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    with rocks_state(spark, ONE_PASS):
        query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/table").drop("batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


# ---------------------------------------------------------------- sources as streams

def page_facts(pages: DataFrame) -> DataFrame:
    """What an arriving page shows at once: site, title and content hash."""
    return pages.select("page_id", U.domain_of(F.col("url")).alias("domain"), H.page_title(F.col("html")).alias("title"),
                        H.dom_hash(F.col("html")).alias("dom_hash"))


# ---------------------------------------------------------------- keyed aggregates

def visit_loops(actions: DataFrame) -> DataFrame:
    """Visits per run and URL within each state window."""
    return actions.groupBy(F.window("ts", STATE_WINDOW), "run_id", U.normalize_url(F.col("url")).alias("page")).agg(
        F.count("*").alias("visits"))


def visits_so_far(windows: DataFrame) -> DataFrame:
    return windows.groupBy("run_id", "page").agg(F.sum("visits").alias("visits"))


def first_sightings(nodes: DataFrame) -> DataFrame:
    """First sighting of a path on a page within the watermark."""
    return nodes.dropDuplicatesWithinWatermark(["page_id", "xpath"])


def quality_windows(signals: DataFrame, window: str) -> DataFrame:
    """Loading signs of each page per window."""
    return signals.groupBy(F.window("ts", window), "page_id").agg(
        F.count("*").alias("viewports"), F.sum("blank_images").alias("blank"), F.sum("loaded_images").alias("loaded"),
        F.sum("total_images").alias("images"), F.max(F.col("overlay").cast("int")).alias("overlay"))


# ---------------------------------------------------------------- state of a run

def run_parts(actions: DataFrame) -> DataFrame:
    """Steps, failures, lost confidence and bounds in time per run, state window and stretch of 63 events; the last success, and
    a bit for each failure."""
    ok = F.coalesce("success", F.lit(False))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("event_id", F.lit(BITS)).cast("int"))
    failed = F.when(~ok, bit).otherwise(0)
    lost = F.when(F.col("progress_score") > 0.6, 25).when(F.col("progress_score") < 0.3, 100).otherwise(50)
    return actions.groupBy(F.window("ts", STATE_WINDOW), "run_id", F.floor(F.col("event_id") / BITS).alias("stretch")).agg(
        F.count("*").alias("steps"), F.count_if(~ok).alias("failures"), F.sum(lost).alias("lost"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max(F.when(ok, F.col("event_id"))).alias("last_ok"),
        F.bit_or(failed).alias("failed"))


def run_state(parts: DataFrame) -> DataFrame:
    """Steps, failures, failures in a row at the end, confidence left and elapsed time of each run."""
    total = parts.groupBy("run_id").agg(
        F.sum("steps").alias("steps"), F.sum("failures").alias("failures"), F.max("last_ok").alias("last_ok"),
        F.greatest(F.lit(0), 1000 - F.sum("lost")).alias("confidence_left"),
        (F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))).alias("elapsed_us"))
    start = F.col("stretch") * BITS
    after = F.least(F.greatest(F.coalesce(F.col("last_ok") - start + 1, F.lit(0)), F.lit(0)), F.lit(BITS)).cast("int")
    ends = parts.select("run_id", "stretch", "failed").join(total.select("run_id", "last_ok"), "run_id").groupBy("run_id").agg(
        F.sum(F.bit_count(F.call_function("shiftrightunsigned", "failed", after))).alias("in_a_row"))
    return total.join(ends, "run_id").drop("last_ok")


def recheck_list(signals: DataFrame, save: Callable[[DataFrame, int], None], folder: str):
    """Start a stream that hands each batch's failed viewports to ``save(batch, batch_id)``."""
    from ..operators.quality import viewport_validation

    def failed(batch, batch_id):
        save(viewport_validation(batch).filter("severity = 'fail'").select("page_id", "seq", "issues"), batch_id)

    return signals.writeStream.foreachBatch(failed).option("checkpointLocation", folder).trigger(availableNow=True).start()


def run_recheck(signals: DataFrame) -> DataFrame:
    """The failed viewports of all batches. A batch that is retried writes its own folder again."""
    spark, folder = signals.sparkSession, shared_folder(signals.sparkSession)
    recheck_list(signals, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/table/batch={n}"),
                 f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/table").drop("batch")
