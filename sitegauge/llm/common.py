"""Column helpers and small distributed steps that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
# Rows between two steps for which a file of its own is made.
FILE_ROWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column | str) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space, in order."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def word_count(text: Column) -> Column:
    bare = F.btrim(whole(text), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys only, so retries and reruns draw it alike."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(2 ** 53))


_shipped: set[str] = set()


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks can import this package: its files go to the executors once per application.

    Modules, and with them what a worker remembers (token ids), so live as long as the worker, not just one task."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp(prefix='sitegauge-code-')}/sitegauge.zip"  # the driver serves it to the executors
        with zipfile.ZipFile(archive, "w") as files:
            for module in sorted(package.rglob("*.py")):
                files.write(module, module.relative_to(package.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most so many rows, in no more partitions than ``FILE_ROWS`` a partition asks for, and in one for each core at
    least. A small table so becomes a few files rather than one for each shuffle task; each file costs a writer, and on a
    local file system processes that set its permissions. Nothing is shuffled again."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def ranged(df: DataFrame, by: list[Column], part: str = "_part") -> DataFrame:
    """A written table dealt by ranges of ``by``, with the number of each row's range."""
    n = shuffle_partitions(df)
    return written(df.repartitionByRange(n, *by).withColumn(part, F.spark_partition_id()))


def number_rows(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``by``: numbers within ranges, plus the sizes of the ranges before.
    Only one count per range (at most the number of shuffle partitions) comes to the driver."""
    table = ranged(df, by)
    base, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in table.groupBy("_part").count().collect()):
        base += [F.lit(part), F.lit(total).cast("long")]
        total += n
    if not base:
        return table.drop("_part").withColumn(name, F.lit(0).cast("long"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1
    return table.withColumn(name, within + F.create_map(*base)[F.col("_part")]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's connected component: (node, root) for the nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps, which keep the components and shrink every tree to a star, until all are
    stars, of which the last step is not repeated to see that nothing changes. Each step
    is an aggregate and a join on a node; a node with very many neighbours is folded before the shuffle, and its rows
    in the join are split by adaptive execution. Each round is written to the shared folder; only three numbers a round
    reach the driver. Pairs with a null are left out; no edges give no rows.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = written(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, before = _state(now), None
    while state[0] and state != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        now, before = written(gathered(small, state[1])), state
        state = _state(now)
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaf.union(now.select(F.col("v"), F.col("v")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of nodes that keep edges (u, v) from being stars, the number of edges, and a hash of all."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"), F.xxhash64("u", "v").alias("mixed")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"), F.lit(0).cast("long").alias("mixed")))).alias("x"))
    nodes = ends.select("x.*").groupBy("node").agg(
        F.sum("below").alias("below"), F.max("above").alias("above"), F.bit_xor("mixed").alias("mixed"))
    return tuple(nodes.agg(F.count_if(F.col("below") + F.col("above") > 1), F.coalesce(F.sum("below"), F.lit(0)), F.bit_xor("mixed")).first())
