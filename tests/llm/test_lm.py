import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, odd, odd_rows, plain_words, prose
from sitegauge.llm import gru, lm


def plain(rows):
    """Counts and unigram scores by a plain loop over (doc_id, text)."""
    docs = [(i, [w.lower() for w in plain_words(t)] + [None]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    counts = Counter(w for (_, d), h in zip(docs, held, strict=True) if not h for w in d)
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(d), sum(counts[w] > 0 for w in d), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in d))
            for (i, d), h in zip(docs, held, strict=True)]


def same(rows, want):
    def key(x):
        return (x[0] is None, x[0] or 0, x[2], x[3], round(x[5], 4))
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows], key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = lm.scores(docs).collect()
    same(rows, plain([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_outside_the_known_ones(spark, data, monkeypatch):
    """The join gives what the tasks' own counts would give."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    few = lm.scores(docs, rounds=1).collect()
    monkeypatch.setattr(lm, "KNOWN", 900)
    monkeypatch.setattr(gru, "SLOTS", gru.SLOTS)
    more = {r.doc_id: r for r in lm.scores(docs, rounds=1).collect()}
    for r in few:
        assert more[r.doc_id].base_score == pytest.approx(r.base_score) and more[r.doc_id].n_known == r.n_known
        assert more[r.doc_id].score == pytest.approx(r.score, rel=0.02)


def test_odd_rows(spark):
    rows = lm.scores(odd(spark), rounds=2).collect()
    same(rows, plain([(i, t) for i, t, _ in odd_rows()]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 9 and r.n_tokens == 3}) == 1


def test_empty_and_untrained(spark):
    assert lm.scores(empty(spark)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm.scores(documents(spark, [(held, "a b", "s")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.held_out and math.isfinite(row.score)


def some_slots(seed=3, n=400):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 60, 9)
    return draw.integers(0, gru.SLOTS, sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])


def test_probabilities_sum_to_one():
    model = gru.Model.start(np.arange(gru.SLOTS), seed=1)
    state = np.random.default_rng(0).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    found, _ = gru._predict(model, np.repeat(state, gru.SLOTS, 0), np.arange(gru.SLOTS), None)
    assert np.exp(found).sum() == pytest.approx(1, abs=1e-4)


def test_bucket_shares_sum_below_one():
    """The words of a bucket and one unseen word share the bucket's probability."""
    counts = np.array([5, 3, 1])
    assert ((counts + 1) / (counts.sum() + len(counts) + 1)).sum() + 1 / (counts.sum() + len(counts) + 1) == pytest.approx(1)


def test_score_does_not_depend_on_the_company(monkeypatch):
    slots, bounds = some_slots()
    model = gru.Model.start(np.ones(gru.SLOTS), seed=2)
    together = np.add.reduceat(gru.score(model, slots, bounds, lm.END), bounds[:-1])
    monkeypatch.setattr(gru, "SCORE_STREAMS", 2)
    monkeypatch.setattr(gru, "SCORE_STEPS", 5)
    other = np.add.reduceat(gru.score(model, slots, bounds, lm.END), bounds[:-1])
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        alone = gru.score(model, slots[a:b], np.array([0, b - a]), lm.END).sum()
        assert alone == pytest.approx(together[i], rel=1e-5) and alone == pytest.approx(other[i], rel=1e-5)


def test_slope_against_differences(monkeypatch):
    """Backpropagation through one window equals finite differences."""
    monkeypatch.setattr(gru, "TRAIN_STEPS", 64)
    slots, bounds = some_slots()
    kept = {}
    learner = gru.Learner(gru.Model.start(np.ones(gru.SLOTS), seed=4).flat * 3)
    monkeypatch.setattr(learner, "_step", lambda slope: kept.setdefault("slope", slope.copy()))
    learner.learn(slots, bounds, lm.END)
    flat, n = learner.model.flat.astype(np.float64), len(slots)

    def loss(at, step):
        moved = flat.copy()
        moved[at] += step
        return -gru.score(gru.Model(moved), slots, bounds, lm.END).sum() / n

    draw = np.random.default_rng(1)
    strong = np.argsort(-np.abs(kept["slope"]))[:2000]
    for at in [*draw.choice(strong, 25, replace=False), *range(gru.SLOTS * 3 * gru.HIDDEN, gru.SLOTS * 3 * gru.HIDDEN + 5)]:
        slope = (loss(at, 1e-2) - loss(at, -1e-2)) / 2e-2
        assert slope == pytest.approx(kept["slope"][at], rel=0.05, abs=2e-4)


def test_training_finds_order(spark):
    """A text that alternates two words is learnt; the unigram base cannot tell it from a shuffled one."""
    draw = np.random.default_rng(0)
    docs = [(i, " ".join(["ping", "pong"] * 40), "a") for i in range(400)]
    docs += [(1000 + i, " ".join(draw.permutation(["ping", "pong"] * 40)), "a") for i in range(0)]
    rows = lm.scores(documents(spark, docs).repartition(1), rounds=4).collect()
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_buckets_match_however_sliced():
    found = pa.array(["a", "bcd", "", "ünü", "x" * 100, "yz.", prose(1, 1)], pa.large_string())
    whole = lm.buckets(found)
    assert [lm.buckets(found.slice(i, 1))[0] for i in range(len(found))] == whole.tolist()
    assert ((0 <= whole) & (whole < lm.BUCKETS)).all()


def test_mean_is_weighted(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    flats = [(float(w), np.full(4, v).astype("<f8").tobytes()) for w, v in ((1, 1), (3, 2), (4, 5), (2, 0), (2, 7))]
    models = spark.createDataFrame([(w, bytearray(f)) for w, f in flats], "weight double, flat binary").repartition(3)
    assert lm.mean(models, np.zeros(4, np.float32)).tolist() == pytest.approx([41 / 12] * 4)
