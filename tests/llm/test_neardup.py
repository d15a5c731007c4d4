import random

import corpus_pipeline
import pytest
from cases import documents, empty, odd, plain_words, prose
from sitegauge.llm import neardup

STAGE = dict(corpus_pipeline.STAGES)["simhash_dedup"]


def plain_set(text):
    found = [w.lower() for w in plain_words(text)]
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_kept(rows):
    """Least ids of components by comparing all pairs."""
    sets, root = [plain_set(t) for _, t, _ in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and jaccard(a, sets[j]) >= 0.8 - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def edited(text, share, draw):
    return " ".join(f"new{draw.randrange(10 ** 6)}" if draw.random() < share else w for w in text.split())


def copies():
    draw, rows = random.Random(4), []
    for n in range(60):
        base = prose(100 + n, 150 + 5 * n)
        rows += [(4 * n, base, "a"), (4 * n + 1, edited(base, 0.004 + 0.02 * n / 60, draw), "a"),
                 (4 * n + 2, edited(base, 0.03, draw), "b"), (4 * n + 3, edited(base, 0.2, draw), "b")]
    return rows


def test_copies_of_similarity_from_the_limit_up_are_linked(spark):
    rows = copies()
    sets = [plain_set(t) for _, t, _ in rows]
    near = [jaccard(sets[4 * n], sets[4 * n + 1]) for n in range(60)]
    assert sum(0.8 <= s < 0.95 for s in near) > 25 and any(s < 0.8 for s in near)
    kept = STAGE(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_pairs_that_the_least_text_does_not_link(spark, monkeypatch):
    """The same buckets for all: links among texts far from the leaders are found too, and each pair is judged."""
    monkeypatch.setattr(neardup, "bands", lambda least: neardup.np.arange(neardup.BANDS, dtype=neardup.np.uint64))
    rows = copies()[:120]
    kept = neardup.deduplicated(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


@pytest.mark.parametrize("marks", [64, 1 << 24])
def test_few_marks_lose_nothing(spark, monkeypatch, marks):
    monkeypatch.setattr(neardup, "MARKS", marks)
    rows = copies()[:80]
    assert sorted(r.doc_id for r in neardup.deduplicated(documents(spark, rows)).collect()) == plain_kept(rows)


def test_odd_rows(spark):
    docs = odd(spark)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 not in ids and 12 not in ids
    assert ids.count(9) == 2 and ids.count(None) == 1


def test_empty(spark):
    assert neardup.near_duplicates(empty(spark)).collect() == []
    assert neardup.deduplicated(empty(spark)).collect() == []


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert sorted(r.doc_id for r in STAGE(spark, docs, data).collect()) == plain_kept(rows)


def test_fingerprints_find_pairs(spark, monkeypatch):
    """With no bucket in common, what fingerprints link is still found, judged by whole sets."""
    texts = [prose(7, 400), prose(8, 300)]
    rows = [(n, t + tail, "a") for n, (t, tail) in enumerate((t, tail) for t in texts for tail in ("", " x"))]
    monkeypatch.setattr(neardup, "signatures", lambda rows, real=neardup.signatures: real(rows).withColumn(
        "buckets", neardup.F.array(neardup.F.col("text_hash"))))
    assert sorted(r.doc_id for r in STAGE(spark, documents(spark, rows), "").collect()) == [0, 2]


def test_fingerprint_is_the_majority_of_bits():
    found = neardup.shingles(b"a b c d e f g h i j k l m n")
    bits = [sum(int(h) >> b & 1 for h in found) * 2 > len(found) for b in range(64)]
    assert neardup.fingerprint(found) & (2 ** 64 - 1) == sum(1 << b for b in range(64) if bits[b])


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many shuffle tasks there are, a small table between two steps has no more files than cores."""
    files = []

    def counted(df, real=neardup.written):
        out = real(df)
        files.append(len(out.inputFiles()))
        return out

    for module in (neardup, neardup.common, neardup.simhash):
        monkeypatch.setattr(module, "written", counted)
    rows = copies()
    with_many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_many}
    try:
        for k, v in with_many.items():
            spark.conf.set(k, v)
        kept = [r.doc_id for r in neardup.near_duplicates(documents(spark, rows)).groupBy("class").agg(
            neardup.F.min("doc_id").alias("doc_id")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(kept) == plain_kept(rows)
    cores = spark.sparkContext.defaultParallelism
    first_of_components = 3  # edges of unknown number
    assert len(files) > 20 and sum(n > cores for n in files) <= first_of_components
