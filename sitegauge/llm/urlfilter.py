"""URL rules by Bloom filter cascades, in DataFrame functions only.

A rule is a host and a path; its key is both written together. A URL's candidate keys are each suffix of its host at a
dot with each beginning of its path that is as long as some rule's path; the corpus's complete key universe is all
distinct candidates of all URLs. For each list (allowed, blocked) a cascade tells exactly which keys of the universe are listed:
level 1 encodes the listed keys in a Bloom filter, level 2 the universe's other keys that pass level 1, level 3 the
listed keys that pass level 2, and so on until no key passes wrongly. A key is listed if the first level that it does not
pass is an even one, or if it passes all and the last is odd. URLs are then judged row by row, without a join.

Filters are literals of the plan. A list is dealt to blocks by key hash so that the filters of a block take at most
about ``BLOCK_BYTES``; each block is a pass of its own, so a list may be of any size.

Nulls: a null URL, or one without ``://``, has an empty host and path and fits no rule. Rules with a null host or path
are left out. Of equally long rules that fit, blocking wins. Repeated rows stay; empty tables give no rows, an empty list
allows all. Columns of the pages named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import written

BITS_PER_KEY, HASHES = 8, 4
LEAST_BITS = 64
BLOCK_BYTES = 4_000_000
# Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32_768


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return common.lower_ascii(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a rule fitting this URL could have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
                         lambda n: F.substr(path, F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    first, step = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(first.bitwiseXOR(F.shiftrightunsigned(step, 2 * i + 1)), F.lit(bits)) for i in range(HASHES)]


class Filter:
    """A Bloom filter over the keys of a table (column ``key``)."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.level = level
        self.bits = max(LEAST_BITS, 1 << (BITS_PER_KEY * n - 1).bit_length())
        # The bitmap functions count from 1.
        place = F.explode(F.array(*[p + 1 for p in _places(F.col("key"), level, self.bits)]))
        maps = (keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("map"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
        found = {r["map"]: bytes(r["bits"]) for r in maps.collect()}  # the size is bounded by BLOCK_BYTES
        whole = b"".join(found.get(i + 1, bytes(BITMAP // 8)) for i in range(-(-self.bits // BITMAP)))
        self.bytes = whole[:self.bits // 8]

    def passes(self, key: Column) -> Column:
        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substr(F.lit(self.bytes), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
            return F.bit_get(byte.cast("long"), place.bitwiseAND(F.lit(7)).cast("int")) == 1
        return reduce(lambda a, b: a & b, [is_set(p) for p in _places(key, self.level, self.bits)])


def cascade(listed: DataFrame, universe: DataFrame) -> list[Filter]:
    """Filters that together are exact on the universe and the listed keys (both of distinct ``key``)."""
    inside, outside, levels = listed, None, []
    while True:
        mine = inside if len(levels) % 2 == 0 else outside
        n = mine.count()
        if not n:
            return levels
        levels.append(Filter(mine, n, len(levels)))
        passing = levels[-1].passes(F.col("key"))
        if len(levels) == 1:
            outside = written(universe.where(passing).join(listed, "key", "left_anti"))
        elif len(levels) % 2 == 0:
            inside = written(inside.where(passing))
        else:
            outside = written(outside.where(passing))


def is_listed(levels: list[Filter], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.passes(key), out).otherwise(level.level % 2 == 1)
    return out


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the key of the longest rule that fits, or null) and verdict.

    ``rules``: host, path, verdict ('allow' or 'block'). A URL that fits no rule has the verdict ``default``.
    """
    table = written(rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat(common.lower_ascii(F.col("host")), "path").alias("key"), F.length("path").alias("n"), "verdict").distinct())
    lengths = sorted(r[0] for r in table.select("n").distinct().collect())  # no more than the longest path has characters
    host, path = url_parts(F.col(url_col))
    own_keys, own_hits = common.fresh(pages, "keys", "hits")
    rows = pages.withColumns({"host": host, "path": path}).withColumn("rule", F.lit(None).cast("string"))
    rows = rows.withColumn("verdict", F.lit(default))
    n = table.count()
    if not n:
        return rows
    no_hits = F.array().cast("array<struct<length:int,block:boolean,key:string>>")
    keys = candidates(F.col("host"), F.col("path"), lengths)
    rows = rows.withColumn(own_keys, keys).withColumn(own_hits, no_hits)
    universe = written(rows.select(F.explode(own_keys).alias("key")).distinct())
    blocks = -(-n * BITS_PER_KEY // 4 // BLOCK_BYTES) or 1  # twice the first level's bytes leave room for all levels
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(blocks)) == block
        hits = F.col(own_hits)
        for verdict in ("allow", "block"):
            listed = written(table.where(mine & (F.col("verdict") == verdict)).select("key").distinct())
            levels = cascade(listed, universe.where(mine))
            if levels:
                hits = F.concat(hits, _hits(own_keys, levels, block, blocks, verdict == "block"))
        rows = rows.withColumn(own_hits, hits)
        if blocks > 1:
            rows = written(rows)
    best = F.array_max(own_hits)
    return (rows.withColumn("rule", best["key"]).withColumn("verdict", F.when(best.isNull(), default)
            .when(best["block"], "block").otherwise("allow")).drop(own_keys, own_hits))


def _hits(keys: str, levels: list[Filter], block: int, blocks: int, blocking: bool) -> Column:
    found = F.filter(keys, lambda k: (F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(blocks)) == block) & is_listed(levels, k))
    return F.transform(found, lambda k: F.struct(F.length(k).alias("length"), F.lit(blocking).alias("block"), k.alias("key")))
