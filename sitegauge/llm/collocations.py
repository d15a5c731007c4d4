"""Phrases of words that stand together more often than their parts would, per language, by SON partitioning.

A shard is a run of rows of one partition of the input. Every shard is mined completely, level by level, at the share of the
support that its words are of all words of the language: a phrase with ``support`` places must have that many in some
shard. A shard reports the hash of each phrase that reaches its share and by how much it does; the union adds these up and
keeps what can still reach the support when every silent shard holds just less than its share. That slack is at most the sum
over the partitions of ceil(support * share) - 1, however a partition is cut. With a fixed support the share of a shard falls
below one place as soon as the language is ``support`` times as large as its words in any shard. Then a shard passes all
that it has, silent shards hold nothing, and the sums of the union are exact, so nothing that is rare passes on. Phrases of
k + 1 words are mined only where both phrases of k words in them passed before. One last pass counts all candidates of all
levels, by their words rather than hashes, and keeps those that reach the support.

Candidates go to the tasks as Bloom filters of at most ``FILTER_BITS`` bits a level. Beyond that size, and for colliding
hashes, more rare phrases pass and are counted; the result stays the same. What a task holds is bounded by a shard, or by the
hashes of one bucket.

Nulls: a null text is empty; a null language counts as ``und`` (with rows that say so). Empty texts, and pieces without two
words, add nothing but their words. Very long texts form a shard of their own. Repeated rows count each. Ties in the
score go by frequency and then by the bytes of the phrase; cuts with equal scores to the shorter first part. Empty tables give
no rows. Columns besides the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .common import map_batches, shuffle_partitions, whole

SHARD_BYTES = 8_000_000
# Ranges of hashes for each shuffle partition; one is united at a time.
BUCKETS = 8
FILTER_BITS = 2 ** 27
# Languages, the largest first, whose local support may be above one place; it is one for all others.
WEIGHED = 10_000
OUT_ROWS = 200_000

# Bytes by kind: 0 in a word, 1 blank, 2 break between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


class Shard:
    """Words of some texts: ``words`` (different ones), and for each place its word, its piece and its language."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        inside = KIND[data] == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a text ends here
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(at, start, "right") - 1
        breaks = np.flatnonzero(KIND[data] == 2)
        self.piece = np.searchsorted(breaks, start) + row
        letters = data[inside]
        letters = np.where((letters >= 65) & (letters <= 90), letters | 32, letters)
        bounds = np.concatenate([[0], np.cumsum(end - start)]).astype("<i8")
        found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        found = found.dictionary_encode()
        self.words, self.word = found.dictionary, found.indices.to_numpy().astype(np.int64)
        kinds = langs.dictionary_encode()
        self.langs = kinds.dictionary.to_pylist()
        self.lang = kinds.indices.to_numpy().astype(np.int64)[row]

    def hashes(self, filters: list[Filter]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level that the filters lead to: the places (of the first word) and their phrases' hashes. A level holds
        phrases whose parts passed the filter of the level before."""
        spelled = np.array([xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()], np.uint64)
        named = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)
        here = spelled[self.word] if len(self.word) else np.zeros(0, np.uint64)
        place, value = np.arange(len(here)), _mixed(named[self.lang] if len(here) else here, here)
        yield place, value
        for size, passing in enumerate(filters, 1):
            good = passing.holds(value)
            place, value = place[good], value[good]
            both = np.flatnonzero((place[1:] == place[:-1] + 1) & (self.piece[place[:-1]] == self.piece[place[:-1] + size])
                                  ) if len(place) else np.zeros(0, np.int64)
            place, value = place[both], value[both]
            value = _mixed(value, here[place + size])
            yield place, value

    def phrases(self, place: np.ndarray, size: int) -> tuple[list[str], pa.Array, np.ndarray]:
        """Languages, texts and numbers of places of the different phrases of ``size`` words at these places."""
        kinds, seen = np.unique(self.lang[place], return_inverse=True)
        for i in range(size):
            joint, index, seen, times = np.unique(seen * np.int64(len(self.words) + 1) + self.word[place + i],
                                                  return_index=True, return_inverse=True, return_counts=True)
        at = place[index]
        parts = [self.words.take(pa.array(self.word[at + i])).cast(pa.large_string()) for i in range(size)]
        text = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return [self.langs[i] for i in self.lang[at].tolist()], text.cast(pa.string()), times


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    value = before * np.uint64(0x9E3779B97F4A7C15) + word
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


class Filter:
    """Two bits a hash; holds all that it was made of, and some others."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def holds(self, value: np.ndarray) -> np.ndarray:
        out = np.ones(len(value), bool)
        for shift in (0, 32):
            bit = (value >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def of(hashes: DataFrame) -> Filter:
        """Made by Spark; what reaches the driver are its words that hold a bit."""
        bits = min(FILTER_BITS, 1 << max(10, (10 * hashes.count()).bit_length()))
        bit = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)])).alias("bit")
        words = hashes.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
        out = Filter(bits)
        out.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Runs of rows of about ``SHARD_BYTES`` of text."""
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // SHARD_BYTES)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)], strict=True):
            if b > a:
                yield Shard(texts.slice(a, b - a), langs.slice(a, b - a))


def _batches(names: list[str], *columns) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + OUT_ROWS]) if not isinstance(c, pa.Array) else
                                          c.slice(at, OUT_ROWS) for c in columns], names)


def _totals(rows: DataFrame) -> DataFrame:
    """(lang, part, n): words of each language in each partition of the input."""
    def run(batches):
        total: dict[str, int] = {}
        for shard in _shards(batches):
            for lang, n in zip(shard.langs, np.bincount(shard.lang, minlength=len(shard.langs)).tolist(), strict=True):
                total[lang] = total.get(lang, 0) + n
        part = TaskContext.get().partitionId()
        yield from _batches(["lang", "part", "n"], list(total), [part] * len(total), list(total.values()))
    return map_batches(rows, run, "lang string, part long, n long")


def _mined(rows: DataFrame, filters: list[Filter], support: int, weighed: dict[str, tuple[int, int]],
           buckets: int) -> DataFrame:
    """(bucket, hashes, excess, needs): the phrases of one level that reach their shard's share of the support, packed by
    ranges of their hashes; the needs are left out where all are the support."""
    small = np.min_scalar_type(support)

    def run(batches):
        for shard in _shards(batches):
            *_, (place, value) = shard.hashes(filters)
            needs = np.zeros(0, small)
            if any(x in weighed for x in shard.langs):
                hashes, index, times = np.unique(value, return_index=True, return_counts=True)
                own = np.bincount(shard.lang, minlength=len(shard.langs)).tolist()
                share = np.array([-(-support * n // weighed[x][0]) if x in weighed else 1
                                  for x, n in zip(shard.langs, own, strict=True)], np.int64)
                need = np.array([weighed[x][1] if x in weighed else support for x in shard.langs], small)
                lang = shard.lang[place[index]]
                good = times >= share[lang]
                hashes, times, needs = hashes[good], (times - share[lang] + 1)[good], need[lang[good]]
            else:
                hashes, times = np.unique(value, return_counts=True)
            excess = np.minimum(times, support).astype(small)
            ends = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            held = np.flatnonzero(np.diff(ends))
            cut = np.append(ends[held], len(hashes)).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *[
                pa.Array.from_buffers(pa.binary(), len(held), [
                    None, pa.py_buffer(cut * np.int32(c.itemsize if len(c) else 0)), pa.py_buffer(c.tobytes())])
                for c in (hashes, excess, needs)]], ["bucket", "hashes", "excess", "needs"])

    return map_batches(rows, run, "bucket int, hashes binary, excess binary, needs binary")


def _united(mined: DataFrame, support: int) -> DataFrame:
    """(hash): what reaches its need when the excesses of all shards are added, one bucket at a time."""
    small = np.min_scalar_type(support)

    def candidates(held: list[tuple]) -> pa.RecordBatch:
        hashes = np.concatenate([np.frombuffer(h, np.uint64) for h, _, _ in held])
        excess = np.concatenate([np.frombuffer(e, small) for _, e, _ in held])
        needs = np.concatenate([np.frombuffer(n, small) if n else np.full(len(e) // small.itemsize, support, small)
                                for _, e, n in held])
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        good = np.add.reduceat(excess[order], first, dtype=np.int64) >= np.minimum.reduceat(needs[order], first)
        return pa.RecordBatch.from_arrays([pa.array(hashes[first[good]].view(np.int64))], ["hash"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for bucket, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now and held:
                    yield candidates(held)
                    held = []
                now = bucket
                held.append(packed)
        if held:
            yield candidates(held)

    return map_batches(mined.repartition("bucket").sortWithinPartitions("bucket"), run, "hash long")


def _counted(rows: DataFrame, filters: list[Filter]) -> DataFrame:
    """(lang, phrase, size, f): places of the candidates in each shard."""
    def run(batches):
        for shard in _shards(batches):
            for size, (place, value) in enumerate(shard.hashes(filters[:-1]), 1):
                place = place[filters[size - 1].holds(value)]
                if len(place):
                    langs, text, times = shard.phrases(place, size)
                    yield from _batches(["lang", "phrase", "size", "f"], langs, text, [size] * len(langs), times)
    return map_batches(rows, run, "lang string, phrase string, size long, f long")


def frequent(rows: DataFrame, support: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of up to ``longest`` words with f >= support, (lang, n)) of (lang, text)."""
    parts = written(_totals(rows))
    totals = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    # Null languages are named, so a plain join keeps all rows.
    share = F.ceil(F.lit(support) * F.col("n") / F.col("total")) - 1
    slack = (parts.join(totals.withColumnRenamed("n", "total"), "lang").where("n > 0")
             .groupBy("lang", "total").agg(F.sum(share).alias("slack")).where("slack > 0"))
    weighed = {r.lang: (r.total, max(1, support - r.slack))
               for r in slack.orderBy(F.desc("total"), "lang").limit(WEIGHED).collect()}
    filters: list[Filter] = []
    for _ in range(longest):
        mined = _mined(rows, list(filters), support, weighed, BUCKETS * shuffle_partitions(rows))
        filters.append(Filter.of(written(_united(mined, support))))
    counts = _counted(rows, filters).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return written(counts.where(F.col("f") >= support)), totals


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, size), " ")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, cut, l, r, score) of every phrase of two words or more, by its lowest-scoring cut.

    The score is floor(1000000 a a / (l r)); l and r, of phrases that hold the whole, are at least a, so it fits a long.
    Products are decimals of 38 digits, exact for frequencies below 10 ** 16.
    """
    words = F.split("phrase", " ")
    cuts = found.where("size > 1").withColumn("cut", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "cut",
                       _part(words, 1, F.col("cut").cast("int")).alias("first"),
                       _part(words, (F.col("cut") + 1).cast("int"), (F.col("size") - F.col("cut")).cast("int")).alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("(cast(1000000 AS decimal(7,0)) * (cast(a AS decimal(16,0)) * cast(a AS decimal(16,0))))"
                   " div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select(
        "lang", "phrase", "size", "a", "best.cut", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Without the phrases whose words stand in a longer one that has ``percent`` of their places or more."""
    words = F.split("phrase", " ")
    inner = found.where("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2).cast("long"), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - F.col("length") + 1)))
    inner = inner.select("lang", _part(words, F.col("start").cast("int"), F.col("length").cast("int")).alias("phrase"), "f")
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return phrases.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * percent).drop("longer")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, percent: int = 50, top: int | None = 2000,
                 text_col: str = "text", lang_col: str = "lang", unnamed: str = "und") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), each language's first ``top`` (all if None)."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(unnamed)).alias("lang"), whole(text_col).alias("text"))
    found, totals = frequent(rows, support, longest)
    best = uncovered(scored(found), found, percent)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
