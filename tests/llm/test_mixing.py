from collections import Counter, defaultdict

import pytest
from cases import documents, empty, odd, plain_words, prose
from sitegauge.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Share by weight, cap, and share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ones, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while left > 1e-9 and open_ones:
        total = sum(weight[s] for s in open_ones)
        for s in open_ones:
            target[s] += left * weight[s] / total
        over = {s for s in open_ones if target[s] > cap * sizes[s]}
        left = sum(target[s] - cap * sizes[s] for s in over)
        for s in over:
            target[s] = cap * sizes[s]
        open_ones -= over
    return target


def check(docs, **options):
    rows = mixing.mixed(docs, **options).collect()
    assert len(rows) == docs.count()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by_source.items()}
    want = plain_targets(sizes)
    for s, v in by_source.items():
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in v)
        units = Counter((r.doc_id, r.size) for r in v)
        largest = max(n * k[1] for k, n in units.items())
        assert abs(sum(r.copies * r.size for r in v) - want[s]) <= largest / 2 + 1e-6
        assert all(0 <= r.copies <= 2 for r in v)
    return rows


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = check(docs)
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(plain_words(r.text)) for r in docs.collect()}
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_hot_source_and_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    docs = documents(spark, [(i, "w " * (1 + i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(700)])
    check(docs)


def test_means_are_kept(spark, monkeypatch):
    """Over many seeds a document's copies have the source's rate as their mean."""
    docs = documents(spark, [(i, "w " * (1 + i), "a" if i < 8 else "b") for i in range(12)])
    sizes = mixing.written(mixing.sized(docs))
    shares = mixing.written(mixing.targets(sizes))
    rate = {r.source: r.target / r.source_size for r in shares.collect()}
    total, runs = Counter(), 25
    for seed in range(runs):
        monkeypatch.setattr(mixing, "SEED", 1000 * seed)
        for r in mixing.copies(sizes, shares).collect():
            total[r.doc_id] += r.copies
    for i in range(12):
        assert abs(total[i] / runs - rate["a" if i < 8 else "b"]) < 0.35


def test_odd_rows(spark):
    docs = odd(spark)
    rows = check(docs)
    assert len({r.copies for r in rows if r.doc_id == 9 and r.size == 2}) == 1
    taken = mixing.resampled(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in rows)


def test_empty(spark):
    assert mixing.mixed(empty(spark)).collect() == []
    assert mixing.resampled(empty(spark)).collect() == []


def test_one_document(spark):
    (row,) = mixing.mixed(documents(spark, [(1, prose(1, 10), "a")])).collect()
    assert row.copies in (1, 2) and row.target == 15
