"""Scores of whole texts by a recurrent language model trained on the corpus.

Tokens are the words of a text (A-Z lower-cased) and one end. Steps:

1. All words of the training documents are counted (a shuffle of words that grows with the corpus).
2. The model's slots are the most frequent words, ``BUCKETS`` buckets of all other words (by a hash of their last three
   bytes) and the end. A word of a bucket has the bucket's probability times its smoothed share of the bucket's words, so
   the model gives every text, also one with unseen words, a proper probability.
3. The model is trained in ``ROUNDS`` rounds. In a round each task trains a copy on its share of the documents by truncated
   backpropagation, and the copies' mean, weighted by tokens, starts the next round. Means are built in a tree, so
   no task adds more than ``FAN_IN`` copies. Every training document is used in exactly one round.
4. Each whole text is scored with the state carried from its first to its last token. The counts of the ``KNOWN`` most
   frequent words at most are held by each task; all other words are sent as (row, word, number) to a join with the
   counts, which gives the rest of the unigram base and of the model's score.

Nulls: a null text is empty (one end). The fold is crc32 of the id as text, modulo ``FOLDS``; a null id counts as
the text '' there. Repeated rows are scored, and trained on, each. Without any training token the counts are 0 and
the base is the smoothed one of an empty corpus. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, gru
from .common import map_batches, written

FOLDS, HELD_OUT = 7, 2
BUCKETS = 256
END = BUCKETS
FIRST_WORD = BUCKETS + 1
KNOWN, KNOWN_BYTES = 200_000, 48
ROUNDS, FAN_IN = 4, 32
COUNT_BYTES, SCORE_BYTES, TRAIN_BYTES = 16_000_000, 6_000_000, 6_000_000


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about so many bytes, with the number of the first."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cuts = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // most
    starts = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist()] if len(texts) else []
    for a, b in zip(starts, [*starts[1:], len(texts)]):
        yield a, texts.slice(a, b - a)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    found = pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(found), 0)
    return found.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def buckets(found: pa.Array) -> np.ndarray:
    """The bucket of each word."""
    found = pa.concat_arrays([found.cast(pa.large_string())])
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1]
    data = np.frombuffer(found.buffers()[2] or b"\0", np.uint8)
    key = np.zeros(len(found), np.uint32)
    for back in (1, 2, 3):
        at = offsets[1:] - back
        key = key * np.uint32(257) + np.where(at >= offsets[:-1], data[np.maximum(at, 0)] + 1, 0).astype(np.uint32)
    return ((key * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) % BUCKETS


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, bucket) of all whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch.column(0), COUNT_BYTES):
                found = pc.value_counts(_words(texts)[0])
                names = found.field(0)
                yield pa.RecordBatch.from_arrays(
                    [names.cast(pa.string()), found.field(1), pa.array(buckets(names), pa.int32())], ["word", "n", "bucket"])

    rows = map_batches(docs.select(F.col(text_col).alias("text")), count, "word string, n long, bucket int")
    return written(rows.groupBy("word", "bucket").agg(F.sum("n").alias("n")))


class Vocabulary:
    """Counts of the most frequent words, totals, and the slots of the model."""

    def __init__(self, counts: DataFrame, n_docs: int):
        total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.kinds = (total or 0) + n_docs, kinds + (1 if n_docs else 0)
        self.ends = n_docs
        # The least count such that at most KNOWN words have it: from counts per sixteenth of a power of two.
        short = counts.where(F.octet_length("word") <= KNOWN_BYTES)
        step = F.floor(F.log2("n") * 16).alias("step")
        sizes = sorted(((r[0], r[1], r[2]) for r in short.groupBy(step).agg(F.count("*"), F.min("n")).collect()), reverse=True)
        least, held = None, 0
        for _, n, low in sizes:
            if held + n > KNOWN:
                break
            held, least = held + n, low
        rows = [] if least is None else short.where(F.col("n") >= least).select("word", "n").collect()
        rows.sort(key=lambda r: (-r["n"], r["word"]))
        self.words = pa.array([r["word"] for r in rows], pa.large_string())
        self.counts = np.array([r["n"] for r in rows], np.int64)
        self.n_slots = min(len(rows), gru.SLOTS - FIRST_WORD)
        own = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
        mass, kinds_in = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for r in own:
            mass[r["bucket"]], kinds_in[r["bucket"]] = r["n"], r["kinds"]
        if self.n_slots:
            top = buckets(self.words.slice(0, self.n_slots))
            np.subtract.at(mass, top, self.counts[:self.n_slots])
            np.subtract.at(kinds_in, top, 1)
        self.bucket_log = np.log10(mass + kinds_in + 1.0)
        self.slot_counts = np.zeros(gru.SLOTS, np.int64)
        self.slot_counts[:BUCKETS], self.slot_counts[END] = mass, n_docs
        self.slot_counts[FIRST_WORD:FIRST_WORD + self.n_slots] = self.counts[:self.n_slots]

    def look_up(self, found: pa.Array, only_slots: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place among the known words (-1: not among them) and its slot."""
        known = self.words.slice(0, self.n_slots) if only_slots else self.words
        at = pc.fill_null(pc.index_in(found.cast(pa.large_string()), value_set=known), -1).to_numpy(
            zero_copy_only=False).astype(np.int64)
        inside = (at >= 0) & (at < self.n_slots)
        slot = at + FIRST_WORD
        slot[~inside] = buckets(found.filter(pa.array(~inside)))
        return at, slot


def _with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of documents with an end after each, and the documents' bounds."""
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    return np.insert(values, np.cumsum(sizes), end), bounds


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after all rounds; ``docs`` (doc_id, text) are the training documents."""
    flat = gru.Model.start(vocabulary.slot_counts).flat
    small = _Slots(vocabulary)
    for turn in range(rounds):
        share = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn)
        models = written(map_batches(share.select("text"), _trainer(flat, small), "weight double, flat binary"))
        flat = mean(models, flat)
    return flat


class _Slots:
    """What training tasks need of a vocabulary."""

    look_up = Vocabulary.look_up

    def __init__(self, vocabulary: Vocabulary):
        self.n_slots, self.words = vocabulary.n_slots, pa.concat_arrays([vocabulary.words.slice(0, vocabulary.n_slots)])


def _trainer(flat: np.ndarray, slots: _Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = gru.Learner(flat)
        for batch in batches:
            for _, texts in _slices(batch.column(0), TRAIN_BYTES):
                found, sizes = _words(texts)
                learner.learn(*_with_ends(slots.look_up(found, True)[1], sizes, END), END)
        if learner.tokens:
            yield _model_row(float(learner.tokens), learner.model.flat)
    return run


def _model_row(weight: float, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([flat.astype("<f8").tobytes()], pa.binary())],
                                      ["weight", "flat"])


def mean(models: DataFrame, otherwise: np.ndarray) -> np.ndarray:
    """The weighted mean of rows (weight, flat), in a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(otherwise)), 0.0
        for batch in batches:
            for w, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += w * np.frombuffer(flat.as_buffer(), "<f8")
                weight += w
        if weight:
            yield _model_row(weight, total / weight)

    n = models.count()
    while n > 1:
        n = -(-n // FAN_IN)
        models = written(map_batches(models.repartition(n), add, "weight double, flat binary"))
    rows = models.select("flat").collect()
    return np.frombuffer(bytes(rows[0][0]), "<f8").astype(np.float32) if rows else otherwise


PARTS = ("row long, doc_id long, n_tokens long, n_known long, base double, score double, "
         "rest array<struct<word:string,n:long>>")
REST = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))


def _scorer(flat: np.ndarray, vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = gru.Model(flat), TaskContext.get().partitionId() << 33
        all_log = np.log10(vocabulary.tokens + vocabulary.kinds + 1.0)
        word_log = np.log10(vocabulary.counts + 1.0)
        for batch in batches:
            for a, texts in _slices(batch.column(1), SCORE_BYTES):
                found, sizes = _words(texts)
                at, slot = vocabulary.look_up(found)
                slots, bounds = _with_ends(slot, sizes, END)
                n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
                score = np.add.reduceat(gru.score(model, slots, bounds, END), bounds[:-1]) / np.log(10)
                known, base = at >= 0, np.zeros(n)
                logs = np.zeros(len(at))
                logs[known] = word_log[at[known]]
                base += np.bincount(doc, logs, n) + np.log10(vocabulary.ends + 1.0) - (sizes + 1) * all_log
                in_bucket = slot < BUCKETS
                inside = np.where(in_bucket, logs - vocabulary.bucket_log[np.where(in_bucket, slot, 0)], 0.0)
                score += np.bincount(doc, inside, n)
                n_known = np.bincount(doc, known, n).astype(np.int64) + (vocabulary.ends > 0)
                rest = _rest(found.filter(pa.array(~known)), doc[~known], n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), batch.column(0).slice(a, n), pa.array(sizes + 1), pa.array(n_known),
                    pa.array(base), pa.array(score), rest],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rest"])
                row += n
    return run


def _rest(found: pa.Array, doc: np.ndarray, n: int) -> pa.Array:
    """The other words of each of n documents, and how often each stands there."""
    table = pa.table({"doc": doc, "word": found.cast(pa.string())}).group_by(["doc", "word"]).aggregate([([], "count_all")])
    table = table.sort_by("doc").combine_chunks()
    offsets = np.searchsorted(table["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    pick = lambda name: table[name].chunk(0) if table.num_rows else pa.array([], table[name].type)
    pairs = pa.StructArray.from_arrays([pick("word"), pick("count_all").cast(pa.int64())], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def scores(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole(text_col).alias("text"))
    training = rows.where(fold(F.col("doc_id")) != HELD_OUT)
    counts = word_counts(training)
    vocabulary = Vocabulary(counts, training.count())
    flat = train(training, vocabulary, rounds)
    parts = written(map_batches(rows, _scorer(flat, vocabulary), PARTS))
    rest = parts.select("row", F.explode("rest").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    more = rest.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    more_log = F.coalesce("more", F.lit(0.0))
    return parts.drop("rest").join(more, "row", "left").select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more_log).alias("base_score"), (F.col("score") + more_log).alias("score"))
