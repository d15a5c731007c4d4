"""Visits of sites: cached results, and which visits would have found one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans import chunks
from ..rules import steps as R
from ..sources.shared import written
from ..sources.tables import EVENT_CHUNK


def visit_log(actions: DataFrame) -> DataFrame:
    """Steps on a site: domain, path, time, whether the step stores a result, and the result."""
    url = F.col("url")
    return actions.filter(url.startswith("http")).select(
        U.domain_of(url).alias("domain"), U.path_pattern(url).alias("path"), "ts", "event_id",
        (F.col("tool_name") == "go_to_url").alias("stores"), (F.col("k") % 7).alias("result"))


def cache_lookup(visits: DataFrame, seconds: int = R.CACHE_SECONDS) -> DataFrame:
    """Latest stored result of the same domain, if it is no older than ``seconds``."""
    c = chunks.Chunked(visits, ["domain"], ["event_id"], [chunks.by_width(F.col("event_id"), EVENT_CHUNK)])
    stored = F.when(F.col("stores"), F.struct("ts", "result"))
    rows = c.attach({"_last": F.max_by(stored, F.when(F.col("stores"), F.col("event_id")))},
                    {"_carried": lambda b, w: F.last("_last", ignorenulls=True).over(b)})
    here = F.last(stored, ignorenulls=True).over(c.local.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_found", F.coalesce(here, F.col("_carried")))
    age = F.expr("timestampdiff(MICROSECOND, _found.ts, ts)")
    return c.drop_cuts(rows.withColumn("cached", F.when(age <= seconds * 1_000_000, F.col("_found.result"))), "_carried", "_found")


def next_moments(moments: DataFrame, seconds: int) -> DataFrame:
    """(domain, second, next): the first later moment of the domain at which a result stored at ``second`` is too old."""
    probes = moments.select("domain", (-F.col("second") - seconds).alias("at"), F.lit(0).alias("kind"))
    both = probes.unionByName(moments.select("domain", (-F.col("second")).alias("at"), F.lit(1).alias("kind")))
    # In descending time, a probe before the moment of the same second: the last moment so far is the next one.
    found = chunks.running_max(both, ["domain"], ["at", "kind"], [chunks.by_width(F.col("at"), 10_000_000)],
                               F.when(F.col("kind") == 1, F.col("at")), "seen", inclusive=False)
    return found.filter("kind = 0 AND seen IS NOT NULL").select(
        "domain", (-F.col("at") - seconds).alias("second"), (-F.col("seen")).alias("next"))


def cache_replay(visits: DataFrame, visit_id: str, seconds: int = R.CACHE_SECONDS) -> DataFrame:
    """Which visits are hits when a miss stores a result and a hit does not refresh it.

    Only the distinct seconds of a domain matter. Each of them knows the moment of the next miss if it were a miss itself,
    and the misses are what the first moment reaches by these links. Round k joins the moments reached so far with links
    over 2**k misses and then joins the links with themselves, so a chain of n misses takes log2(n) rounds, whatever
    domain it is of; links that leave the log drop out. The first visit of a moment on the chain is the miss.
    """
    moments = written(visits.select("domain", "second").distinct())
    links = written(next_moments(moments, seconds))
    missed = written(moments.groupBy("domain").agg(F.min("second").alias("second")))
    while not links.isEmpty():
        missed = written(missed.unionByName(missed.join(links, ["domain", "second"]).select("domain", F.col("next").alias("second"))))
        onward = links.select("domain", F.col("second").alias("next"), F.col("next").alias("_onward"))
        links = written(links.join(onward, ["domain", "next"]).select("domain", "second", F.col("_onward").alias("next")))
    first = visits.groupBy("domain", "second").agg(F.min(visit_id).alias(visit_id))
    stored = first.join(missed, ["domain", "second"], "left_semi").select(visit_id, F.lit(False).alias("hit"))
    return visits.join(stored, visit_id, "left").withColumn("hit", F.coalesce("hit", F.lit(True)))


def domain_stats(visits: DataFrame, keep: int = R.CACHE_PATTERNS) -> DataFrame:
    """Entries, first and last visit per domain, and its last ``keep`` distinct paths in order of first sight."""
    paths = visits.groupBy("domain", "path").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    late = Window.partitionBy("domain").orderBy(F.col("first").desc())
    kept = paths.withColumn("_n", F.row_number().over(late)).filter(F.col("_n") <= keep).groupBy("domain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "path"))), lambda x: x["path"]), " ").alias("patterns"))
    sums = paths.groupBy("domain").agg(F.sum("n").alias("size"), F.min("first").alias("oldest"), F.max("last").alias("newest"))
    return sums.join(kept, "domain")
