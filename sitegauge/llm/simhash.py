"""SimHash near-duplicates: fingerprints, and a binary trie joined with itself.

Two fingerprints of 64 bits that differ in at most 3 bits agree on at least one of 4 blocks of 16 bits. So there are 4
tries, each with another block on top. In each, the upper 16 levels are walked with no differing bit, i.e. a node is
only paired with itself, and below that node pairs are walked together with the whole budget: a pair of nodes goes down
to its four pairs of children, (0,1) and (1,0) cost one bit, and a pair beyond the budget is dropped. Subtrees under one
16-bit node are dealt to tasks; one with more than ``SUBTREE`` fingerprints is first taken 8 levels down as node pairs,
as often as needed, so no task gets an unbounded subtree. Tasks return a star for each set of linked fingerprints they
find, never all pairs.

Nulls: a null text is empty, its fingerprint is zero; rows with a null id take part, but are never a class id (a class of
only such rows has the id null). Repeated rows and ids stay as they are. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import map_batches, written

SEED = 42
BLOCK, BLOCKS = 16, 4
SUBTREE = 20_000
# Shingles whose bits are counted at a time, node pairs that are walked at a time, and pairs that are compared at a time.
COUNTED, WALKED, COMPARED = 65_536, 200_000, 2_000_000
LEAF = 64


def fingerprint(raw: bytes, width: int) -> int:
    """The 64 majority bits over the hashes of a text's shingles."""
    found = raw.lower().split()
    if not found:
        return 0
    if len(found) < width:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), COUNTED):
        part = hashes[a:a + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint as a signed long) of every row, over its whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or b"", width) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))],
                ["doc_id", "text_hash", "fingerprint"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(common.whole(text)).alias("text_hash"),
                       text.alias("text"))
    return map_batches(rows, hashed, "doc_id long, text_hash long, fingerprint long")


def _compress(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    leaf = np.flatnonzero(label != np.arange(n))
    return leaf, label[leaf]


def _expand(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, each member's group and its number in it."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def trie_links(values: np.ndarray, pairs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over positions of ``values`` whose bits differ in at most ``budget`` places.

    ``values`` are sorted within every node. ``pairs`` has a row for each pair of nodes to walk: begin and end of both
    in ``values``, levels already walked, differing bits so far. A node paired with itself has equal bounds.
    """
    n = len(values)
    stars_u, stars_v = np.empty(0, np.int64), np.empty(0, np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [pairs[a:a + WALKED] for a in range(0, len(pairs), WALKED)]
    found: list[np.ndarray] = []
    held = 0

    def fold() -> None:
        nonlocal stars_u, stars_v, held
        links = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        stars_u, stars_v = _compress(np.concatenate([links[0], stars_u]), np.concatenate([links[1], stars_v]), n)
        found.clear()
        held = 0

    while stack:
        now = stack.pop()
        a0, a1, b0, b1, depth, _ = now.T
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth >= 64)
        leaves = now[small]
        cuts = np.cumsum((leaves[:, 1] - leaves[:, 0]) * (leaves[:, 3] - leaves[:, 2])) // COMPARED
        for part in np.split(leaves, np.flatnonzero(np.diff(cuts)) + 1):
            found.append(_compared(values, part, budget))
            held += found[-1].shape[1]
            if held > COMPARED:
                fold()
        rest = now[~small]
        if not len(rest):
            continue
        for level in np.unique(rest[:, 4]):
            here = rest[rest[:, 4] == level]
            if level not in ones:
                bit = (values >> np.uint64(63 - level)) & np.uint64(1)
                ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
            total = ones[level]
            a0, a1, b0, b1, _, err = here.T
            am, bm = a1 - (total[a1] - total[a0]), b1 - (total[b1] - total[b0])
            same = (a0 == b0) & (a1 == b1)
            down = [np.stack(x, axis=1) for x in (
                (a0, am, b0, bm, here[:, 4] + 1, err), (am, a1, bm, b1, here[:, 4] + 1, err),
                (a0, am, bm, b1, here[:, 4] + 1, err + 1))]
            down.append(np.stack((am, a1, b0, bm, here[:, 4] + 1, err + 1), axis=1)[~same])
            children = np.concatenate(down)
            alive = ((children[:, 5] <= budget) & (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
                     & ~((children[:, 0] == children[:, 2]) & (children[:, 1] - children[:, 0] < 2)
                         & (children[:, 1] == children[:, 3])))
            children = children[alive]
            stack += [children[i:i + WALKED] for i in range(0, len(children), WALKED)]
    if found:
        fold()
    return stars_u, stars_v


def _compared(values: np.ndarray, leaves: np.ndarray, budget: int) -> np.ndarray:
    """Linked positions under pairs of small nodes."""
    a0, a1, b0, b1 = leaves.T[:4]
    pair, k = _expand((a1 - a0) * (b1 - b0))
    wide = (b1 - b0)[pair]
    i, j = a0[pair] + k // wide, b0[pair] + k % wide
    near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
    return np.stack((i[near], j[near]))


def links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints (signed longs) that connect all within ``budget`` differing bits."""
    if budget >= BLOCKS:
        raise ValueError(f"at most {BLOCKS - 1} differing bits")
    fp = F.col("fingerprint")
    turned = F.explode(F.array(*[F.struct(
        F.lit(b).alias("block"), (fp if not b else F.shiftleft(fp, BLOCK * b).bitwiseOR(
            F.shiftrightunsigned(fp, 64 - BLOCK * b))).alias("bits")) for b in range(BLOCKS)])).alias("x")
    top = prints.select("fingerprint", turned).select("x.block", "x.bits")
    node = F.shiftrightunsigned("bits", 64 - BLOCK)
    ready, rows, depth = [], top.select("block", F.lit(BLOCK).alias("depth"), node.alias("a"), node.alias("b"),
                                        F.lit(0).alias("side"), "bits"), BLOCK
    while True:
        key = ["block", "depth", "a", "b"]
        counts = rows.groupBy(*key).agg(F.sum((F.col("side") == 0).cast("long")).alias("na"),
                                        F.sum(F.col("side").cast("long")).alias("nb"))
        heavy = written(counts.where(F.greatest("na", "nb") > SUBTREE).select(*key))
        if depth + 8 > 64 or heavy.isEmpty():
            return _walked([*ready, rows], budget)
        ready.append(rows.join(heavy, key, "left_anti"))
        rows = written(_lowered(rows.join(heavy, key, "left_semi"), depth, budget))
        depth += 8


def _lowered(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """Node pairs eight levels below: a fingerprint goes to every pair of its own child and one within the budget."""
    child = F.shiftrightunsigned("bits", 56 - depth)
    errors = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    flip = F.explode(F.array(*[F.lit(x) for x in range(256) if x.bit_count() <= budget])).alias("flip")
    both = rows.select("*", child.alias("own"), flip).where(errors + F.bit_count("flip") <= budget)
    self_pair = F.col("a") == F.col("b")
    # The partner's child has the other node's prefix; bits of its last 8 levels differ from the own child's by flip.
    other = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    partner = F.shiftleft(other, 8).bitwiseOR(F.col("own").bitwiseAND(F.lit(255)).bitwiseXOR(F.col("flip")))
    first = F.when(self_pair, F.col("own") <= F.col("partner")).otherwise(F.col("side") == 0)
    return both.withColumn("partner", partner.cast("long")).select(
        "block", F.lit(depth + 8).alias("depth"),
        F.when(first, F.col("own")).otherwise(F.col("partner")).alias("a"),
        F.when(first, F.col("partner")).otherwise(F.col("own")).alias("b"),
        F.when(first, 0).otherwise(1).alias("side"), "bits")


def _walked(tables: list[DataFrame], budget: int) -> DataFrame:
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.union(table)
    key = ["block", "depth", "a", "b"]
    dealt = rows.repartition(common.shuffle_partitions(rows), *key).sortWithinPartitions(*key)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(6)])
            kept = now if kept is None else np.concatenate([kept, now], axis=1)
            edge = np.flatnonzero((kept[:4, 1:] != kept[:4, :-1]).any(axis=0))
            if len(edge) and kept.shape[1] >= WALKED:  # all nodes but the last are complete
                yield from _chunk(kept[:, :edge[-1] + 1], budget)
                kept = kept[:, edge[-1] + 1:]
        if kept is not None:
            yield from _chunk(kept, budget)

    return map_batches(dealt.select(*key, "side", "bits"), walk, "a long, b long")


def _chunk(rows: np.ndarray, budget: int) -> Iterator[pa.RecordBatch]:
    """Links of complete node pairs."""
    block, depth, a, b, side, bits = rows
    values = bits.view(np.uint64)
    change = np.flatnonzero(np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)]))
    end = np.append(change[1:], rows.shape[1])
    group = np.repeat(np.arange(len(change)), end - change)
    order = np.lexsort((values, side, group))
    values = values[order]
    middle = change + np.bincount(group, weights=side == 0, minlength=len(change)).astype(np.int64)
    own = a[change] == b[change]
    lo, hi = np.where(own, change, middle), np.where(own, middle, end)
    errors = np.bitwise_count((a[change] ^ b[change]).astype(np.uint64)).astype(np.int64)
    pairs = np.stack([change, middle, lo, hi, depth[change], errors], axis=1)
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & ~(own & (middle - change < 2))]
    if not len(pairs):
        return
    u, v = trie_links(values, pairs, budget)
    if len(u):
        by = np.uint64(BLOCK) * block[order].astype(np.uint64)
        back = (values >> by) | (values << (np.uint64(64) - by) % np.uint64(64))  # the bits as they were
        plain = back.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(plain[u]), pa.array(plain[v])], ["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint as a signed long, class, component_id) of every row: documents whose fingerprints
    differ in at most ``budget`` bits are linked. A component's class is its least fingerprint, its id the smallest
    document id in it."""
    prints = written(fingerprints(docs, width, id_col, text_col))
    kinds = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = written(common.components(links(kinds, budget)).select(F.col("node").alias("fingerprint"), "root"))
    least = kinds.join(roots, "fingerprint").groupBy("root").agg(F.min("least").alias("low"))
    linked = roots.join(least, "root").select("fingerprint", "root", "low")
    named = written(kinds.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("class"), F.coalesce("low", "least").alias("component_id")))
    return prints.join(named, "fingerprint").select("doc_id", "text_hash", "fingerprint", "class", "component_id")


def deduplicated(docs: DataFrame, width: int = 3, budget: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component: the one with the smallest id, null last (of such, the least text hash)."""
    return one_of_each(docs, near_duplicates(docs, width, budget, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of ``docs`` of each class of ``rows`` (doc_id, text_hash, class)."""
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x"))
    key, kind = common.fresh(docs, "key", "kind")

    def keys(doc_id, text_hash) -> dict:
        """Without nulls, so that the join and the removal of repeated rows share one shuffle of the texts."""
        return {key: F.coalesce(doc_id, F.lit(0)), kind: F.xxhash64(text_hash, doc_id.isNull())}

    kept = first.select("x.*").withColumns(keys(F.col("doc_id"), F.col("text_hash"))).select(key, kind)
    rows = docs.withColumns(keys(F.col(id_col).cast("long"), F.xxhash64(common.whole(text_col))))
    return rows.dropDuplicates([key, kind]).join(written(kept), [key, kind], "left_semi").drop(key, kind)
