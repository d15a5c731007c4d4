"""One-permutation MinHash fingerprints, in DataFrame functions only.

Each shingle (``WIDTH`` words in lower case; a shorter text is one shingle) is hashed once. The upper bits of the
hash name one of ``BINS`` bins, and a bin keeps its least hash. An empty bin is filled by optimal densification: bins
are tried in an order that a hash of (empty bin, tried bin) gives, the same for every text, and the first filled one lends
its hash. Of each bin the low ``BITS`` bits are stored, packed as hexadecimal digits. Two different hashes share these
bits with probability 2**-BITS, which ``likeness`` takes off the share of equal bins to estimate the Jaccard similarity.

Nulls: a null text is empty. A text without words has the empty fingerprint, of likeness 1 to another such and 0 to any
other. Repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import let, written

BINS, BITS, WIDTH = 128, 8, 5
NO_ID = -2 ** 63


def _bin(value: Column) -> Column:
    """The bin of a hash, from 0, ascending with the signed hash."""
    return (F.shiftright(value, 64 - (BINS.bit_length() - 1)) + BINS // 2).cast("int")


def _dense(least: Column) -> Column:
    """A hash for each bin, from the filled bins' least hashes in ascending order."""
    def filled(bins: Column) -> Column:
        def of(b: Column) -> Column:
            lender = F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(b, _bin(h)).alias("turn"), h.alias("h"))))
            at = F.array_position(bins, b).cast("int")
            return F.when(at > 0, F.get(least, at - 1)).otherwise(lender["h"])
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), of)

    return F.when(F.size(least) == BINS, least).otherwise(let(F.transform(least, _bin), filled))


def fingerprint(text: Column) -> Column:
    """Packed low bits of a whole text's bins: ``BINS * BITS / 4`` hexadecimal digits, none for a text without words."""
    def hashes(found: Column) -> Column:
        n = F.size(found)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < WIDTH, F.array(F.xxhash64(found))).otherwise(
            F.transform(F.sequence(F.lit(1), n - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(found, i, WIDTH))))

    def least(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: ~_bin(h).eqNullSafe(_bin(F.get(ordered, i - 1))))

    digits = BITS // 4
    low = lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(2 ** BITS - 1))), digits, "0"))
    found = let(F.sort_array(let(common.words(F.lower(common.whole(text))), hashes)), least)
    return let(found, lambda m: F.when(F.size(m) == 0, "").otherwise(F.array_join(F.transform(_dense(m), low), "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' texts."""
    digits, chance = BITS // 4, 2.0 ** -BITS
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    here = lambda x, i: F.substr(x, i * digits + 1, F.lit(digits))
    same = let(F.struct(a.alias("a"), b.alias("b")),
               lambda p: F.size(F.filter(bins, lambda i: here(p["a"], i) == here(p["b"], i))))
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


def with_next(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): each document beside the next in descending id order
    (null ids last; rows of one id by their texts' hashes); after the last comes the first.

    The ids are cut into ranges of about equal size at approximate quantiles, so the order is made within ranges and
    texts move once. Only the range bounds and the largest id of each range (a few numbers per shuffle partition) come to
    the driver; the row with that id joins the range above as a guest. Rows that share one id stay in one range.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key")
    parts = parts or 4 * common.shuffle_partitions(docs)
    keys = docs.select(key)
    shares = [(i + 1) / parts for i in range(parts - 1)]
    bounds = sorted(set(keys.agg(F.percentile_approx("key", shares, 100 * parts)).first()[0] or [])) if shares else []
    part = _range_of(F.col("key"), bounds).alias("part")
    heads = dict(keys.groupBy(part).agg(F.max("key")).collect())
    order = sorted(heads)
    above = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}  # where a range's first document is a guest

    rows = docs.select(key, F.col(id_col).alias("doc_id"), common.whole(text_col).alias("text"))
    rows = rows.select("*", part, F.xxhash64("text").alias("tie"))
    first = rows.where(F.col("key").isin(list(heads.values()))).groupBy("part").agg(
        F.max_by(F.struct("key", "doc_id", "text", "tie"), F.struct("key", "tie")).alias("x"))
    target = F.create_map(*[F.lit(x) for p in order for x in (p, above[p])]) if order else F.create_map(F.lit(0), F.lit(0))
    guests = written(first.select("x.key", "x.doc_id", "x.text", target[F.col("part")].alias("part"), "x.tie"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    both = both.withColumn("fingerprint", fingerprint(F.col("text")))
    down = W.partitionBy("part").orderBy("guest", F.desc("key"), F.desc("tie"))
    return both.select("guest", "doc_id", "text", "fingerprint", F.lead("text").over(down).alias("next_text"),
                       F.lead("fingerprint").over(down).alias("next_fingerprint")).where("not guest").drop("guest")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the key, by halving steps."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(array, at + step - 1) < key, F.lit(False)), at + step).otherwise(at))


def half_replaced(text: Column, other: Column) -> Column:
    """The last half of the code points (rounded down) gives way to the first as many (or all) of another text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(other, F.lit(1), half))
