"""Mixing sources to target weights by pivotal dependent rounding.

A source's target of words over its size is the mean number of copies of each of its documents. The whole part is
taken for sure; the fraction is rounded so that the source's words come out near the target: two documents with open
fractions exchange words at random, keeping their sum and each one's mean, until one of them is settled at all or
nothing. A block of about ``BLOCK`` documents of a source is settled so in one fold, which leaves one open document;
the open ones of ``BLOCK`` blocks meet in a block of the next level, and so on up to one per source, which goes to the
nearer end. Blocks run from long documents to short ones, so that the last one open tends to be short. So a source of
any size is a tree of small tasks, and its words miss the target by at most half a document.

The draws are hashes of the rows, so reruns agree. Nulls: a null text has size 0; a null source is a source, last in
order; a null id is an id like any other. Repeated rows (same id, source and size) are rounded as one document of their
joint size and get the same copies. Documents of size 0 are drawn one by one. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import written

BLOCK = 64
SEED = 20_240_817


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size): words of every whole text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       common.word_count(F.col(text_col)).alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) of each source.

    Sources in code-point order, null last, have the ``weights`` in turn, and share ``share`` times all words by weight;
    none gets more than ``cap`` times its own size, and what it cannot take is shared again by weight.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = common.number_rows(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    table = written(ranked.withColumn("weight", weight))
    most = F.col("source_size") * cap
    total, free = table.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (total or 0)
    level, full = (wanted / free if free else 0.0), 0
    while True:  # the words per weight of those below their cap; each round fills more sources
        is_full = F.col("weight") * level > most
        n, taken, free = table.agg(F.count_if(is_full), F.sum(F.when(is_full, most)),
                                   F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (wanted - taken) / free
    return table.select("source", "n", "source_size", F.least(F.col("weight") * level, most).alias("target"))


def _settle(state: Column, item: Column, chance: Column) -> Column:
    """Let the open document and the next one exchange words until one of them has all or none."""
    mine, own_cap = state["open"]["mass"], state["open"]["cap"]
    other, other_cap = item["mass"], item["cap"]
    to_open = F.least(own_cap - mine, other)        # words that can move to the open document
    to_item = F.least(other_cap - other, mine)      # or to the next one
    give = chance * (to_open + to_item) < to_item   # the mean of both documents stays
    keep_item = F.when(give, own_cap - mine <= other).otherwise(other_cap - other > mine)
    settled_full = F.when(give, keep_item).otherwise(~keep_item)
    mass = F.when(give, F.when(keep_item, other - to_open).otherwise(mine + to_open)).otherwise(
        F.when(keep_item, other + to_item).otherwise(mine - to_item))
    still = F.when(keep_item, item).otherwise(state["open"])
    gone = F.when(keep_item, state["open"]).otherwise(item)
    # Moving to the open one settles it in full or the item with none; moving to the item, the other way round.
    return F.struct(
        F.concat(state["done"], F.array(F.struct(gone["key"].alias("key"), F.when(settled_full, 1).otherwise(0)
                                                 .alias("extra")))).alias("done"),
        still.withField("mass", mass).alias("open"))


def _settler(level: int) -> Callable[[Column, Column], Column]:
    return lambda state, item: _settle(state, item, common.uniform(item["draw"], item["key"], F.lit(SEED + 2 + level)))


def copies(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): how often the mix takes each document; one row for repeated rows."""
    kind = sizes.schema["doc_id"].dataType.simpleString()
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("repeats"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = shares.select(F.col("source").alias("_source"), "n", rate.alias("rate"))
    part = F.col("rate") - F.floor("rate")
    cap = (F.col("size") * F.col("repeats")).cast("double")
    draw = common.uniform(F.col("doc_id"), F.col("source"), F.col("size"), F.lit(SEED))
    rows = written(units.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "n", F.struct("doc_id", "size").alias("key"), F.floor("rate").cast("int").alias("base"),
        (cap * part).alias("mass"), cap.alias("cap"), part.alias("part"), draw.alias("draw")))
    alone = rows.where("cap = 0").select("source", "key", "base", (F.col("draw") < F.col("part")).cast("int").alias("extra"))

    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    start = rows.where("cap > 0").select(
        "source", "base", F.pmod(F.xxhash64("key", F.lit(SEED + 1)), F.greatest(blocks, F.lit(1))).alias("block"),
        F.struct("cap", "draw", "key", "mass").alias("item"))
    most = shares.agg(F.max("n")).first()[0] or 1
    none = F.array().cast(f"array<struct<key:struct<doc_id:{kind},size:bigint>,extra:int>>")
    decided, open_ones = [alone], start
    for level in range(max(1, math.ceil(math.log(most, BLOCK) - 1e-9))):
        blocks_now = open_ones.groupBy("source", "base", "block").agg(F.sort_array(F.collect_list("item"), False).alias("items"))

        folded = blocks_now.select("source", "base", "block", F.aggregate(
            F.slice("items", 2, F.size("items")), F.struct(none.alias("done"), F.col("items")[0].alias("open")),
            _settler(level)).alias("state"))
        folded = written(folded.select("source", "base", "block", "state.done", "state.open"))
        decided.append(folded.select("source", "base", F.inline("done")).select("source", "key", "base", "extra"))
        open_ones = folded.select("source", "base", F.floor(F.col("block") / BLOCK).alias("block"),
                                  F.col("open").alias("item"))
    item = F.col("item")
    decided.append(open_ones.select("source", item["key"].alias("key"), "base",
                                    (2 * item["mass"] >= item["cap"]).cast("int").alias("extra")))
    table = reduce(DataFrame.union, decided)
    return table.select("key.doc_id", "source", "key.size", (F.col("base") + F.col("extra")).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
          id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row."""
    sizes = written(sized(docs, id_col, source_col, text_col))
    shares = written(targets(sizes, weights, share, cap))
    taken = written(copies(sizes, shares))
    rows = _match(sizes, taken, ["doc_id", "source", "size"])
    return _match(rows, shares.drop("n"), ["source"])


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which nulls match nulls."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_{k}"]) for k in keys])
    return left.join(named, same).drop(*[f"_{k}" for k in keys])


def resampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    names = {k: options.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))}
    sizes = written(sized(docs, **names))
    weights = {k: v for k, v in options.items() if k not in names}
    taken = written(copies(sizes, written(targets(sizes, **weights))).where("copies > 0"))
    own = common.fresh(docs, "key", "origin", "size", "copies", "copy")
    key, origin, size, number, copy = own
    same = (F.col(names["id_col"]).eqNullSafe(F.col(key)) & F.col(names["source_col"]).eqNullSafe(F.col(origin))
            & (common.word_count(F.col(names["text_col"])) == F.col(size)))
    return (docs.join(taken.toDF(*own[:4]), same)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number)))).drop(*own))
