from collections import defaultdict

import numpy as np
import pytest
import xxhash
from cases import documents, empty, odd, plain_words, prose
from pyspark.sql import functions as F
from sitegauge.llm import common, simhash


def plain_print(text, width=3):
    found = [w.lower() for w in plain_words(text)]
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + width]) for i in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget=3):
    """Class numbers of fingerprints by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def check(docs, budget=3):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in texts]
    classes, least = plain_components(prints, budget), {}
    for (i, _), c in zip(texts, classes, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    def key(x):
        return tuple((v is None, v) for v in x)

    want = sorted(((i, p, least.get(c)) for (i, _), p, c in zip(texts, prints, classes, strict=True)), key=key)
    rows = simhash.near_duplicates(docs, budget=budget).collect()
    assert sorted(((r.doc_id, r.fingerprint % 2 ** 64, r.component_id) for r in rows), key=key) == want
    return rows


def test_whole_table(spark, data):
    check(spark.read.parquet(f"{data}/documents.parquet"))


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_small_subtrees(spark, data, monkeypatch, budget):
    """Node pairs are taken down several levels before tasks walk them."""
    monkeypatch.setattr(simhash, "SUBTREE", 2)
    monkeypatch.setattr(simhash, "WALKED", 3)
    monkeypatch.setattr(simhash, "COMPARED", 10)
    monkeypatch.setattr(simhash, "LEAF", 1)
    check(spark.read.parquet(f"{data}/documents.parquet"), budget)


def random_prints(n, seed=0):
    """Families within a few bits of each other, and others on their own."""
    draw = np.random.default_rng(seed)
    out = set()
    for _ in range(n // 10):
        base = int(draw.integers(0, 2 ** 63)) * 2 + int(draw.integers(0, 2))
        for _ in range(10):
            flips = draw.choice(64, int(draw.integers(0, 6)), replace=False)
            out.add(base ^ sum(1 << int(b) for b in flips))
    return sorted(out)


@pytest.mark.parametrize("subtree", [20_000, 4])
def test_links_of_random_prints(spark, monkeypatch, subtree):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    prints = random_prints(600)
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    found = common.components(simhash.links(table)).collect()
    root = {r.node % 2 ** 64: r.root for r in found}
    groups, want = defaultdict(set), defaultdict(set)
    for p, c in zip(prints, plain_components(prints), strict=True):
        want[c].add(p)
        groups[root.get(p, ("alone", p))].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_hot_groups_give_no_pairs(spark):
    """Thousands of copies and near copies: links stay below a few per text."""
    base = prose(5, 300)
    rows = [(i, base, "a") for i in range(3000)] + [(10_000 + i, f"{base} tail{i}", "a") for i in range(1500)]
    docs = documents(spark, rows)
    prints = simhash.fingerprints(docs).select("fingerprint").distinct()
    assert simhash.links(prints).count() <= 4 * prints.count()
    classes = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert classes == {0}


def test_odd_rows(spark):
    docs = odd(spark)
    check(docs)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    classes = {r["class"] for r in simhash.near_duplicates(docs).collect()}
    assert kept.count() == len(classes)
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(9) <= 2


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.deduplicated(empty(spark)).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1000 + i) for i in range(1, 500)]
    other = [(5000, 4000), (None, 3), (7, None), (8000, 8000)]
    edges = spark.createDataFrame(chain + hub + other, "a long, b long").select(
        F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("b"))
    root = {r.node: r.root for r in common.components(edges).collect()}
    assert {root[i] for i in range(301)} == {0} and {root[1000 + i] for i in range(500)} == {1000}
    assert root[5000] == root[4000] == 4000 and 8000 not in root


def test_components_of_stars_take_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(common, "written", lambda df, real=common.written: tables.append(1) or real(df))
    stars = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(100 + i, 100) for i in range(1, 9)], "a long, b long")
    assert {(r.node, r.root) for r in common.components(stars).collect()} == {
        (i, 1) for i in range(1, 40)} | {(100 + i, 100) for i in range(9)}
    assert len(tables) == 1
    # A path, and a node below two others, are none.
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        assert {(r.node, r.root) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {
            (1, 1), (2, 1), (3, 1)}
