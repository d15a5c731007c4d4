"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and, past their reach, MinHash bands find
pairs, whole shingle sets judge them.

Two texts are linked if their sets of ``WIDTH``-word shingles (lower case; a shorter text is one shingle) have a Jaccard
similarity of at least ``LIKE``. A text's SimHash has a bit set that over half of its shingles' hashes have; texts whose
fingerprints differ in at most ``BUDGET`` bits, found by the trie join of ``simhash``, are pairs: all of one fingerprint meet its
least text, and these of near fingerprints each other. Most texts at 0.8 differ in more bits, so bands find those: texts that agree on all ``ROWS`` minima of one of ``BANDS`` bands share a bucket. A pair of
similarity s shares none with probability (1 - s**ROWS)**BANDS, 0.00005 at 0.8. Pairs are made in steps that are linear in
a bucket, and only of texts that no link connects yet:

* ``LEADERS`` times, each bucket's texts meet its leader, the text that shares buckets with most others, so the origin of a
  large group of near copies rather than one of them; then the leader leaves the bucket.
* Texts of buckets that still hold several components mostly share a passage, or are far copies of one origin. They meet by
  their rarest shingles, exactly: see ``_rare_meetings``.

Of each pair the low bytes of the minima are compared first; a pair at 0.8 has less than ``SURE`` of them alike with
probability below 0.0002. Only texts of the pairs that remain are cut into shingles again, and shuffled as sets, once.

Equal texts are one node. Tasks hold a bitmap of the nodes whose sets are wanted, of at most ``MARKS`` bits, that lets those
pass, and few others, which the join then drops.

Nulls: a null text is empty; texts without words are copies of each other. Rows with a null id take part. Empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .common import gathered, map_batches, written
from .simhash import SEED, one_of_each

WIDTH, LIKE = 5, 0.8
BUDGET = 3
BANDS, ROWS = 25, 5
LEADERS = 2
SURE = 0.66
MARKS = 1 << 27
# Shingles whose minima are taken at a time, and bytes of sets that a task holds.
COUNTED, HELD = 2048, 4_000_000
# A set of shingles counts as so many rows where tables are gathered in files.
SET_ROWS = 10


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    found = raw.lower().split()
    if len(found) < width:
        each = [b" ".join(found)]
    else:
        each = map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in each), np.uint64))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Constants of BANDS * ROWS hash functions."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 2 ** 64, (2, BANDS * ROWS), np.uint64)


def minima(found: np.ndarray, mixed: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The least value of each hash function."""
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    for a in range(0, len(found), COUNTED):
        least = np.minimum(least, ((found[a:a + COUNTED, None] ^ mixed) * (factor | np.uint64(1))).min(axis=0))
    return least


def fingerprint(found: np.ndarray) -> int:
    """SimHash of the different shingles' hashes, as a signed number."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(found), 8 * COUNTED):
        votes += np.unpackbits(found[a:a + 8 * COUNTED].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found)).view(np.int64)[0])


def bands(least: np.ndarray) -> np.ndarray:
    """One number for each band's minima."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(common.whole(text)).alias("text_hash"),
                       text.alias("text"))


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n different shingles, fingerprint, buckets, low bytes of the minima) of every row, over its whole text."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed, factor = _functions()
        for batch in batches:
            sizes, prints, found, low = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                own = shingles(text.as_py() or b"")
                least = minima(own, mixed, factor)
                sizes.append(len(own))
                prints.append(fingerprint(own))
                found.append(bands(least).view(np.int64))
                low.append(least.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                                              pa.array(found, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                                             ["doc_id", "text_hash", "n", "fingerprint", "buckets", "low"])

    return map_batches(rows, signed, "doc_id long, text_hash long, n long, fingerprint long, buckets array<long>, low binary")


def _marked(nodes: DataFrame) -> np.ndarray:
    """A bitmap of the nodes' low bits, 16 a node while that is less than ``MARKS``."""
    bits = min(MARKS, 1 << max(10, (16 * nodes.count()).bit_length()))
    low = F.col("node").bitwiseAND(F.lit(bits - 1))
    words = nodes.groupBy(F.shiftright(low, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(node & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def shingle_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the texts in ``nodes``, and of few others."""
    marks = _marked(nodes)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(1).to_numpy().view(np.uint64)
            low = node & np.uint64(64 * len(marks) - 1)
            inside = np.flatnonzero(marks[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
            seen, names, found, held = set(), [], [], 0
            for i in inside.tolist():
                if node[i] in seen:
                    continue
                seen.add(node[i])
                names.append(node[i:i + 1].view(np.int64)[0])
                found.append(shingles(batch.column(2)[i].cast(pa.binary()).as_py() or b"").view(np.int64))
                held += found[-1].nbytes
                if held >= HELD:
                    yield _sets(names, found)
                    names, found, held = [], [], 0
            if names:
                yield _sets(names, found)

    each = map_batches(rows, sets, "node long, shingles array<long>")
    return each.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _sets(names: list, found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                      ["node", "shingles"])


def _fits(n, m):
    """Sets of these sizes can be alike."""
    return F.least(n, m) >= F.lit(LIKE) * F.greatest(n, m) - 1e-9


def _close(pairs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Those of the pairs (a, b) whose minima mostly agree; there are n nodes."""
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in (2, 3))
            alike = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            good = pa.array(alike >= SURE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    own = nodes.select(F.col("node").alias("a"), F.col("low").alias("x"))
    other = nodes.select(F.col("node").alias("b"), F.col("low").alias("y"))
    both = pairs.join(own, "a").join(other, "b").select("a", "b", "x", "y")
    return map_batches(gathered(both, BANDS * n), agree, "a long, b long")


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""
    pairs = written(_close(pairs, nodes, n))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(gathered(shingle_sets(rows, written(gathered(ends, n))), SET_ROWS * n))
    own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return written(gathered(pairs.join(own, "a").join(other, "b").where(
        both >= F.lit(LIKE) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"), BANDS * n))


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _named(held: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Rows (bucket, node, ...) with each node's component."""
    named = held.drop("root").join(common.components(found), "node", "left")
    return written(gathered(named.withColumn("root", F.coalesce("root", "node")), BANDS * n))


def near_prints(nodes: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints differ in at most ``BUDGET`` bits, as many as nodes and links."""
    kinds = written(gathered(nodes.groupBy("fingerprint").agg(F.min("node").alias("least")), n))
    same = nodes.select("fingerprint", "node").join(kinds, "fingerprint").where("node <> least").select("node", "least")
    near = simhash.links(kinds, BUDGET)
    for end in ("a", "b"):
        near = near.join(kinds.select(F.col("fingerprint").alias(end), F.col("least").alias(f"least_{end}")), end)
    return same.select(*_pair(F.col("node"), F.col("least"))).union(near.select(*_pair(F.col("least_a"), F.col("least_b")))).distinct()


def links(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of text hashes that connect all similar texts whose fingerprints are near or that share a bucket."""
    nodes = written(gathered(signed.groupBy(F.col("text_hash").alias("node")).agg(
        F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"), F.first("buckets").alias("buckets"), F.first("low").alias("low")),
        signed.count()))
    n = nodes.count()
    each = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(gathered(each.join(sizes, "bucket"), BANDS * n))
    score = shared.groupBy("node").agg(F.sum("size").alias("score"))
    held = written(gathered(shared.drop("size").join(score, "node").withColumn("root", F.col("node")), BANDS * n))
    near = near_prints(nodes, n)  # judged with the first leaders' pairs, so texts are cut once for both
    lowest, highest = F.min("root").alias("low"), F.max("root").alias("high")
    for turn in range(LEADERS):
        # Only buckets that still hold several components go on.
        leader = held.groupBy("bucket").agg(
            F.max_by(F.struct("node", "n", "root"), F.struct("score", "node")).alias("lead"), lowest, highest).where("low < high")
        met = held.join(leader.drop("low", "high"), "bucket").where(F.col("node") != F.col("lead.node"))
        pairs = met.where((F.col("root") != F.col("lead.root")) & _fits(F.col("n"), F.col("lead.n")))
        pairs = pairs.select(*_pair(F.col("node"), F.col("lead.node")))
        pairs = pairs if turn else pairs.union(near)
        alike = _alike(pairs.distinct(), nodes, rows, n)
        found = found.union(alike) if turn else alike
        held = _named(met.drop("lead"), found, n)
    several = held.groupBy("bucket").agg(lowest, highest).where("low < high").select("bucket")
    rest = written(gathered(held.join(several, "bucket", "left_semi").select("node", "root").distinct(), n))
    sets = written(gathered(shingle_sets(rows, rest.select("node")), SET_ROWS * n))
    return found.union(_alike(_rare_meetings(sets, rest, n), nodes, rows, n))


def _rare_meetings(sets: DataFrame, rest: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of different components that can be alike, by the rarest shingles of the sets (node, shingles).

    In one order for all, by frequency and then by value, two alike sets share one of the first (1 - LIKE) n + 1 shingles of each,
    and their first common one leaves both enough shingles for the overlap that they need. What many texts share, such as
    the origin of their group or a passage, stands behind what is their own, so texts that are not alike rarely meet."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    times = each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    # A shingle of one text only comes first; the join need not carry it.
    known = each.join(times, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("known"))
    size = sets.select("node", F.size("shingles").alias("n")).join(rest, "node").join(known, "node")
    own = F.col("n") - F.size("known")
    length = (F.col("n") - F.ceil(F.lit(LIKE) * F.col("n") - 1e-9) + 1 - own).cast("int")
    first = size.where(length > 0).select("node", "root", "n", own.alias("own"), F.posexplode(F.slice("known", 1, length)).alias("at", "s"))
    first = written(gathered(
        first.select("node", "root", "n", (F.col("n") - F.col("own") - F.col("at")).alias("left"), "s.shingle"), BANDS * n))
    several = first.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    first = first.join(several.select("shingle"), "shingle", "left_semi")
    need = F.lit(LIKE / (1 + LIKE)) * (F.col("p.n") + F.col("q.n")) - 1e-9
    met = first.alias("p").join(first.alias("q"), "shingle").where(
        (F.col("p.node") < F.col("q.node")) & (F.col("p.root") != F.col("q.root")) & _fits(F.col("p.n"), F.col("q.n"))
        & (F.least("p.left", "q.left") >= need))
    return met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, class) of every row: a class is a component of linked texts."""
    rows = _rows(docs, id_col, text_col)
    signed = written(signatures(rows))
    roots = common.components(links(rows, signed)).select(F.col("node").alias("text_hash"), "root")
    return signed.select("doc_id", "text_hash").join(roots, "text_hash", "left").select(
        "doc_id", "text_hash", F.coalesce("root", "text_hash").alias("class"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class: the one with the smallest id, null last (of such, the least text hash)."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
