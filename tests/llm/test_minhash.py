import hashlib
import re

import numpy as np
import pytest
from cases import documents, empty, odd, prose
from pyspark.sql import functions as F
from sitegauge.llm import minhash
from sitegauge.llm.queries import QUERIES


def shingles(text):
    found = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_whole_table(spark, data):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in QUERIES["op6_document_fingerprints"](spark, data).collect()}
    assert len(rows) == len(docs)
    errors, prints = [], {}
    for at, (i, text) in enumerate(docs):
        other, r = docs[(at + 1) % len(docs)][1], rows[i]
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and re.fullmatch("[0-9a-f]{256}", r.fingerprint)
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, other)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and np.abs(errors).max() < 0.25


@pytest.mark.parametrize("parts", [1, 2, 7, 400])
def test_next_document(spark, data, parts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: (r.text, r.next_text) for r in minhash.with_next(docs, parts).select("doc_id", "text", "next_text").collect()}
    assert got == {i: (t, want[(k + 1) % len(want)][1]) for k, (i, t) in enumerate(want)}


def test_short_texts_and_densified_bins(spark):
    """Few shingles leave most bins empty; the estimate stays unbiased."""
    pairs = []
    for seed in range(150):
        a = prose(seed, 30).split()
        pairs.append((seed, " ".join(a), " ".join(a[:15] + prose(seed + 999, 15).split()), "s"))
    table = spark.createDataFrame(pairs, "i long, a string, b string, s string")
    near = minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("near")
    errors = [r.near - jaccard(r.a, r.b) for r in table.select("a", "b", near).collect()]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.2


def test_likeness_of_unrelated_texts_has_no_bias(spark):
    table = spark.createDataFrame([(" ".join(f"a{i}w{k}" for k in range(200)), " ".join(f"b{i}w{k}" for k in range(200)))
                                   for i in range(60)], "a string, b string")
    a, b = minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))
    found = [r[0] for r in table.select(minhash.likeness(a, b)).collect()]
    assert np.mean(found) < 0.006


def test_odd_rows(spark):
    docs = odd(spark)
    rows = minhash.with_next(docs).collect()
    assert len(rows) == docs.count()
    texts = sorted(r.text for r in rows)
    assert sorted(r.next_text for r in rows) == texts
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == ""
    assert by_id[14].next_text == by_id[13].text and by_id[11].fingerprint == by_id[12].fingerprint
    near = rows[0]
    assert near is not None
    table = documents(spark, [(1, "", "s"), (2, "a", "s"), (3, "a", "s")])
    found = {(r.doc_id): r[1] for r in minhash.with_next(table).select(
        "doc_id", minhash.likeness(F.col("fingerprint"), F.col("next_fingerprint"))).collect()}
    assert found == {3: 1.0, 2: 0.0, 1: 0.0}


def test_empty_and_single(spark):
    assert minhash.with_next(empty(spark)).collect() == []
    (row,) = minhash.with_next(documents(spark, [(5, "abc", "s")])).collect()
    assert row.next_text == "abc"
    edited = documents(spark, [(5, "abcde", "s")]).select(minhash.half_replaced(F.col("text"), F.lit("é"))).first()[0]
    assert edited == "abcé"
