"""Packing documents into sequences by a grouping genetic algorithm on islands.

Documents are dealt at random to cells of about ``CELL`` items, so a hot source or many copies do not meet in one task.
Each cell is evolved on ``ISLANDS`` islands. An individual is a set of bins (sequences). A child takes some of the best
filled bins of one parent whole, keeps the bins of the other parent that share no document with them, and places
the documents of the bins in between by best fit. After each epoch every island sends its elite to the next one (a join).
The best individual of a cell stays; the documents of its few worst filled bins go on to the cells of the next level,
until one cell is left. So bins that are badly filled because a cell ended meet again, and each level has at most an
eighth of the items of the one before.

Nulls: a null text is empty, that is only the end id. Rows are items of their own, so repeated rows are packed each.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import map_batches, written
from .tokens import BATCH_BYTES, REMEMBERED, coder

CAPACITY = 2048
CELL, RELEASED = 4096, 512
ISLANDS, EPOCHS = 2, 2
POPULATION, GENERATIONS, CHILDREN = 4, 6, 3
WELL_FILLED = 0.98
PIECE_BYTES = 8_000_000
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids", pa.binary())])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", remembered: int = REMEMBERED, at_a_time: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids): every whole text as ids with ``end_id`` behind, little-endian unsigned
    32 bit. A longer document is cut so that only its first piece may be short. What a worker remembers (pieces) and cuts at a
    time (bytes) bounds its memory, not the result."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = coder(tokenizer, remembered), np.array([end_id], "<u4")
        rows, held = [], 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1), at_a_time), strict=True):
                ids = np.append(ids, end)
                stops = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                start = 0
                for piece, stop in enumerate(stops):
                    rows.append((doc, piece, start, stop - start, ids[start:stop].tobytes()))
                    start = stop
                held += 4 * len(ids)
                if held >= PIECE_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole(text_col).alias("text"))
    return map_batches(rows, cut, "doc_id long, piece int, start long, length long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE)


class Bins:
    """Items of each bin, and the room that is left in it."""

    def __init__(self, items: list[list[int]], room: list[int]):
        self.items, self.room = items, room

    def place(self, order: list[int], lengths: list[int], capacity: int) -> Bins:
        """Put each item where it leaves least room, or in a new bin."""
        items, room = self.items, self.room
        by_room: dict[int, list[int]] = {}
        rooms = 0  # bit r: some bin has room r
        for b, r in enumerate(room):
            if r:
                by_room.setdefault(r, []).append(b)
                rooms |= 1 << r
        for i in order:
            need = lengths[i]
            fits = rooms >> need
            if fits:
                r = need + (fits & -fits).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    rooms ^= 1 << r
            else:
                b, r = len(items), capacity
                items.append([])
                room.append(0)
            items[b].append(i)
            room[b] = r - need
            if r > need:
                by_room.setdefault(r - need, []).append(b)
                rooms |= 1 << (r - need)
        return self

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones, which leave room together."""
        filled = capacity - np.array(self.room, np.float64)
        return -len(self.room), float(np.square(filled / capacity).sum())

    @classmethod
    def of(cls, bin_of: np.ndarray, lengths: list[int], capacity: int) -> Bins:
        items: list[list[int]] = [[] for _ in range(int(bin_of.max(initial=-1)) + 1)]
        room = [capacity] * len(items)
        for i, b in enumerate(bin_of.tolist()):
            items[b].append(i)
            room[b] -= lengths[i]
        return cls(items, room)

    def numbers(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for b, own in enumerate(self.items):
            out[own] = b
        return out


def crossover(mother: Bins, father: Bins, lengths: list[int], capacity: int, draw: np.random.Generator) -> Bins:
    """Well-filled bins of the father, the mother's bins that share no document with them, the rest by best fit."""
    room = np.array(father.room)
    full = np.flatnonzero(room <= capacity * (1 - WELL_FILLED))
    if not len(full):
        full = np.flatnonzero(room <= np.median(room))
    chosen = draw.choice(full, max(1, len(full) // 8), replace=False).tolist()
    taken = np.zeros(len(lengths), bool)
    for b in chosen:
        taken[father.items[b]] = True
    worst = set(np.argsort(mother.room)[-max(1, len(mother.room) // 20):].tolist())
    items, left, loose = [father.items[b][:] for b in chosen], [father.room[b] for b in chosen], []
    for b, own in enumerate(mother.items):
        if b in worst or taken[own].any():
            loose += [i for i in own if not taken[i]]
        else:
            items.append(own[:])
            left.append(mother.room[b])
    loose.sort(key=lambda i: -lengths[i])
    return Bins(items, left).place(loose, lengths, capacity)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int) -> tuple[np.ndarray, int, float]:
    """Bin numbers of the best individual found, its number of bins and its fitness. ``elites``: bins to start from."""
    draw = np.random.default_rng(seed)
    sizes, n = lengths.tolist(), len(lengths)
    least = -(-int(lengths.sum()) // capacity)
    decreasing = np.argsort(-lengths, kind="stable")
    crowd = [Bins.of(e, sizes, capacity) for e in elites]
    if not crowd:
        crowd.append(Bins([], []).place(decreasing.tolist(), sizes, capacity))
    if min(len(x.room) for x in crowd) > least:
        while len(crowd) < POPULATION:  # nearly decreasing orders
            order = np.argsort(-lengths * draw.uniform(0.9, 1.1, n), kind="stable")
            crowd.append(Bins([], []).place(order.tolist(), sizes, capacity))
        scored = sorted(((x.fitness(capacity), k, x) for k, x in enumerate(crowd)), reverse=True)
        born = len(crowd)
        for _ in range(GENERATIONS):
            if -scored[0][0][0] <= least:
                break
            for _ in range(CHILDREN):
                a, b = draw.choice(len(scored), 2, replace=False)
                child = crossover(scored[a][2], scored[b][2], sizes, capacity, draw)
                scored.append((child.fitness(capacity), born, child))
                born += 1
            scored = sorted(scored, reverse=True)[:POPULATION]
        best = scored[0][2]
    else:
        best = min(crowd, key=lambda x: len(x.room))
    used, square = best.fitness(capacity)
    return best.numbers(n), -used, square


def _evolved(rows: DataFrame, capacity: int, level: int, epoch: int) -> DataFrame:
    """One epoch on every island; rows: cell, island, lengths, elites."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell, island = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                lengths = batch.column(2)[row].values.to_numpy().astype(np.int64)
                elites = [np.array(e, np.int32) for e in batch.column(3)[row].as_py()]
                bins, used, fitness = evolve(lengths, elites, capacity, cell * 1000 + level * 100 + epoch * 10 + island)
                yield pa.RecordBatch.from_pylist(
                    [{"cell": cell, "island": island, "bins": bins, "used": used, "fitness": fitness}],
                    schema=pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("bins", pa.list_(pa.int32())),
                                      ("used", pa.int32()), ("fitness", pa.float64())]))

    return written(map_batches(
        rows.select("cell", "island", "lengths", "elites"), run, "cell long, island int, bins array<int>, used int, fitness double"))


def _best(items: DataFrame, n_cells: int, capacity: int, level: int) -> DataFrame:
    """(_id, length, cell, bin) of one level."""
    tasks = max(common.shuffle_partitions(items), n_cells * ISLANDS // 64)
    cell = F.pmod(F.xxhash64("_id", F.lit(level)), F.lit(n_cells))
    cells = written(items.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list(F.struct("length", "_id")), False)
                                                         .alias("items"))
                    .select("cell", F.col("items.length").alias("lengths"), F.col("items._id").alias("ids")))
    islands = cells.select("cell", "lengths", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    found = None
    for epoch in range(EPOCHS):
        if found is None:
            rows = islands.withColumn("elites", F.array().cast("array<array<int>>"))
        else:
            own = found.select("cell", "island", F.col("bins").alias("own"))
            sent = found.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("sent"))
            rows = (islands.join(own, ["cell", "island"]).join(sent, ["cell", "island"])
                    .withColumn("elites", F.array("own", "sent")))
        found = _evolved(rows.repartition(tasks, "cell", "island"), capacity, level, epoch)
    rank = F.struct(-F.col("used"), "fitness", -F.col("island"))
    best = found.groupBy("cell").agg(F.max_by("bins", rank).alias("bins"))
    return written(cells.join(best, "cell").select("cell", F.explode(F.arrays_zip("ids", "lengths", "bins")).alias("x"))
                   .select("cell", F.col("x.ids").alias("_id"), F.col("x.lengths").alias("length"),
                           F.col("x.bins").alias("bin")))


def pack(items: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """The rows of ``items`` with ``sequence_id`` and ``offset`` (in place of columns of that name): sequences of at most
    ``capacity``, without gaps. Lengths are from 1 to ``capacity``."""
    items = items.drop("sequence_id", "offset")
    key = common.fresh(items, "item")[0]
    table = written(items.withColumn(key, F.monotonically_increasing_id()))  # numbers are fixed once written
    rest = table.select(F.col(key).alias("_id"), F.col(length_col).cast("long").alias("length"))
    done, level = [], 0
    while True:
        n_cells = -(-rest.count() // CELL) or 1
        placed = _best(rest, n_cells, capacity, level)
        final = placed
        if n_cells > 1:
            bins = placed.groupBy("cell", "bin").agg(F.sum("length").alias("filled"), F.count("*").alias("n"))
            worst = W.partitionBy("cell").orderBy("filled", "bin")
            loose = written(bins.where(F.col("filled") < WELL_FILLED * capacity)
                            .withColumn("together", F.sum("n").over(worst.rowsBetween(W.unboundedPreceding, 0)))
                            .where(F.col("together") <= RELEASED).select("cell", "bin"))
            final = placed.join(loose, ["cell", "bin"], "left_anti")
            rest = written(placed.join(loose, ["cell", "bin"], "left_semi").select("_id", "length"))
        number = F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft(F.col("cell"), 20) + F.col("bin")
        done.append(final.select("_id", "length", number.alias("sequence_id")))
        if n_cells == 1:
            break
        level += 1
    all_done = done[0]
    for more in done[1:]:
        all_done = all_done.union(more)
    before = F.sum("length").over(W.partitionBy("sequence_id").orderBy("_id")) - F.col("length")
    spots = all_done.select(F.col("_id").alias(key), "sequence_id", before.alias("offset"))
    return table.join(spots, key).drop(key)
