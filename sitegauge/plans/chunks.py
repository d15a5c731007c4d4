"""Ordered work within a key when one key may hold a third of all rows.

A plain window over the key would put that key in one task. Here the rows of a key are cut into
chunks that follow the order (a fixed width of the ordering column, so the cut is the same on every
retry). Each chunk is scanned by its own task; one small row per chunk carries running values to the
next chunk; rows pick the carried value up by joining on (key, chunk), which is as even as the chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written


def by_width(column: Column, width: int) -> Column:
    return F.floor(column / width)


def buckets_for(df: DataFrame) -> int:
    """Buckets that a key without an order is split into: several times the tasks of a shuffle, so that a hot key spreads
    over all of them at any size of cluster. A key of few rows occupies at most as many buckets as rows."""
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_hash(df: DataFrame, *columns: str) -> Column:
    """Chunk for totals without an order."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets_for(df)))


@dataclass
class Chunked:
    """Rows of ``df`` grouped by ``keys``, ordered by the ``order`` columns (ascending) and cut by ``chunk``.

    The chunk columns, ascending, must agree with the order.
    """

    df: DataFrame
    keys: list[str]
    order: list[str]
    chunk: list[Column]

    def __post_init__(self):
        self.cuts = [f"_cut{i}" for i in range(len(self.chunk))]
        self.df = self.df.withColumns(dict(zip(self.cuts, self.chunk, strict=True)))

    @property
    def local(self) -> WindowSpec:
        """Window over one chunk, in order."""
        return Window.partitionBy(*self.keys, *self.cuts).orderBy(*self.order)

    def so_far(self) -> WindowSpec:
        return self.local.rowsBetween(Window.unboundedPreceding, 0)

    def chunk_rows(self, partials: dict[str, Column]) -> DataFrame:
        """One row per chunk. The partial aggregates combine on the map side."""
        return self.df.groupBy(*self.keys, *self.cuts).agg(*[e.alias(n) for n, e in partials.items()])

    def attach(self, partials: dict[str, Column],
               carried: dict[str, Callable[[WindowSpec, WindowSpec], Column]]) -> DataFrame:
        """Rows with values carried from the other chunks of the key.

        ``carried`` maps an output name to a function of (window over the chunks before this one,
        window over all chunks of the key), both in chunk order. A later one may use an earlier one's output.
        Rows are read twice, so all values of one order are carried in one call.
        """
        ordered = Window.partitionBy(*self.keys).orderBy(*self.cuts)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carry = self.chunk_rows(partials)
        for name, f in carried.items():
            carry = carry.withColumn(name, f(before, whole))
        return self.df.join(carry.select(*self.keys, *self.cuts, *carried), [*self.keys, *self.cuts])

    def drop_cuts(self, df: DataFrame, *more: str) -> DataFrame:
        return df.drop(*self.cuts, *more)


def row_index(df, keys, order, chunk, out: str) -> DataFrame:
    """1-based position of each row within its key."""
    c = Chunked(df, keys, order, chunk)
    rows = c.attach({"_n": F.count("*")}, {"_before": lambda b, w: F.coalesce(F.sum("_n").over(b), F.lit(0))})
    return c.drop_cuts(rows.withColumn(out, F.col("_before") + F.row_number().over(c.local)), "_before")


def range_index(df, keys, order, out: str) -> DataFrame:
    """0-based position of each row within its key, for an order that has no chunks of its own, such as one by arrays.

    Spark deals the rows by ranges of (key, order), so a hot key spreads over many ranges; each range numbers its own rows
    and adds the rows that its key has in the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return rows.join(counts, [*keys, "_range"]).withColumn(out, F.col("_before") + here - 1).drop("_before", "_range")


def running_sum(df, keys, order, chunk, value: Column, out: str, total: str | None = None) -> DataFrame:
    """Sum of ``value`` up to and including each row; ``total`` names the sum over the whole key."""
    c = Chunked(df.withColumn("_value", value), keys, order, chunk)
    carried = {"_before": lambda b, w: F.coalesce(F.sum("_part").over(b), F.lit(0))}
    if total:
        carried[total] = lambda b, w: F.sum("_part").over(w)
    rows = c.attach({"_part": F.sum("_value")}, carried)
    rows = rows.withColumn(out, F.col("_before") + F.sum("_value").over(c.so_far()))
    return c.drop_cuts(rows, "_before", "_value")


def running_max(df, keys, order, chunk, value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Greatest ``value`` of the rows so far, NULL while there is none."""
    c = Chunked(df.withColumn("_value", value), keys, order, chunk)
    rows = c.attach({"_part": F.max("_value")}, {"_before": lambda b, w: F.max("_part").over(b)})
    frame = c.local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn(out, F.greatest("_before", F.max("_value").over(frame)))
    return c.drop_cuts(rows, "_before", "_value")


def previous(df, keys, order, chunk, columns: dict[str, str]) -> DataFrame:
    """{output: input} values of the row before, NULL on the first row of a key."""
    c = Chunked(df, keys, order, chunk)
    rows = c.attach({"_last": F.max_by(F.struct(*dict.fromkeys(columns.values())), F.struct(*order))},
                    {"_prev": lambda b, w: F.last("_last", ignorenulls=True).over(b)})
    first = F.row_number().over(c.local) == 1
    rows = rows.withColumns({out: F.when(first, F.col(f"_prev.{src}")).otherwise(F.lag(src).over(c.local))
                             for out, src in columns.items()})
    return c.drop_cuts(rows, "_prev")


def key_totals(df, keys, totals: dict[str, Column], partials: dict[str, Column],
               salt: Column | None = None) -> DataFrame:
    """Totals of a key on each of its rows; ``totals`` are aggregates of ``partials``."""
    salt = salt if salt is not None else by_hash(df, *df.columns)
    c = Chunked(df, keys, [], [salt])
    rows = c.attach(partials, {n: (lambda b, w, e=e: e.over(w)) for n, e in totals.items()})
    return c.drop_cuts(rows)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join many ``left`` rows per key with few ``right`` rows per key, when one key may hold a third of ``left``.

    The buckets that a key occupies (a small distinct list) meet ``right`` on the key; the rows then meet that on
    (key, bucket), which splits a hot key over ``buckets`` tasks. ``right`` is never copied for absent buckets.
    """
    rows = left.withColumn("_bucket", by_hash(left, *left.columns))
    spread = rows.select(*keys, "_bucket").distinct().join(right, keys)
    return rows.join(spread, [*keys, "_bucket"], how).drop("_bucket")
