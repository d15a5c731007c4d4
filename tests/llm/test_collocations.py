import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import empty, odd, prose
from pyspark.sql import functions as F
from sitegauge.llm import collocations as C

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII))]


def plain(rows, support, longest, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in pieces(text):
            n[lang or "und"] += len(piece)
            for k in range(1, longest + 1):
                f.update((lang or "und", *piece[i:i + k]) for i in range(len(piece) - k + 1))
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < support:
            continue
        if any(100 * f[q] >= percent * a and q[0] == lang and any(list(q[1 + i:1 + i + len(w)]) == w for i in range(len(q) - len(w)))
               for q in f if len(q) > len(w) + 1 and f[q] >= support):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]])
                for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
            for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def check(df, support=3, longest=3, percent=50, top=2000):
    got = C.collocations(df, support, longest, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain([(r.lang, r.text) for r in df.select("lang", "text").collect()], support, longest, percent, top)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def corpus(spark, n=120, parts=5):
    texts = [(["en", "de", None, "und"][i % 4], ("New York, " if i % 5 else "") + prose(i % 30, 40, "new york is a big City of the".split())
              + [". ", "; San Jose\t", "\n", " "][i % 4] + prose(i, 30)) for i in range(n)]
    return spark.createDataFrame(texts, "lang string, text string").repartition(parts, "text")


@pytest.mark.parametrize("shard, bits", [(400, 2 ** 27), (3000, 2 ** 10), (10 ** 7, 64)])
def test_any_shards_and_filters(spark, monkeypatch, shard, bits):
    """Also where local supports are above one place, and where filters pass nearly all."""
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    monkeypatch.setattr(C, "FILTER_BITS", bits)
    assert len(check(corpus(spark))) > 40


@pytest.mark.parametrize("support, longest, percent, top", [(1, 2, 50, 7), (5, 4, 80, 2000), (10, 5, 20, 3)])
def test_parameters(spark, support, longest, percent, top):
    check(corpus(spark, 30), support, longest, percent, top)


def test_local_support_is_used(spark):
    """A shard with much of a language reports only phrases that are frequent in it, and no frequent one is lost."""
    df = corpus(spark, 80, 2).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    total = {lang: n for lang, n in C.frequent(df, 10, 1)[1].collect()}

    def mined(weighed):
        rows = C._mined(df, [], 10, weighed, 3).collect()
        out = Counter()
        for r in rows:
            out.update(dict(zip(np.frombuffer(r.hashes, np.uint64).tolist(), np.frombuffer(r.excess, np.uint8).tolist(),
                                strict=True)))
        return out
    whole, cut = mined({}), mined({lang: (n, 1) for lang, n in total.items()})
    assert 0 < len(cut) < len(whole)
    assert all(h in cut for h, s in whole.items() if s >= 10)


def test_colliding_hashes(spark, monkeypatch):
    spelled = C.xxhash.xxh64_intdigest
    monkeypatch.setattr(C.xxhash, "xxh64_intdigest", lambda w, seed=0: spelled(w, seed) % 5)
    shard = C.Shard(pa.array(["a b a b c", "b a b"]), pa.array(["x", "y"]))
    place, value = list(shard.hashes([C.Filter(64)]))[0]
    langs, text, times = shard.phrases(place, 1)
    assert sorted(zip(langs, text.to_pylist(), times.tolist(), strict=True)) == [
        ("x", "a", 2), ("x", "b", 2), ("x", "c", 1), ("y", "a", 1), ("y", "b", 2)]


def test_products_past_64_bits(spark):
    big = 9_999_999_999_999_937
    found = spark.createDataFrame([("x", "a b", 2, big - 12), ("x", "a", 1, big), ("x", "b", 1, big - 1)],
                                  "lang string, phrase string, size long, f long")
    row = C.scored(found).first()
    assert row.score == 1000000 * (big - 12) ** 2 // (big * (big - 1))


def test_odd_rows(spark):
    check(odd(spark).withColumn("rank", F.lit(1)).withColumn("score", F.lit(2)))
    check(odd(spark).withColumn("lang", F.lit(None).cast("string")))


def test_empty(spark):
    assert C.collocations(empty(spark)).collect() == []
    assert C.collocations(spark.createDataFrame([("x", None), ("x", ". , ;"), (None, "")], "lang string, text string")).collect() == []


def test_words_and_pieces():
    texts = ["Ab\tcd  e.F", "", None, "é\x0bÀ g", "x" * 100, " . "]
    shard = C.Shard(pa.array([t or "" for t in texts]), pa.array(["l"] * len(texts)))
    words = [shard.words[i].as_py().decode() for i in shard.word.tolist()]
    assert words == [w for t in texts for p in pieces(t) for w in p]
    assert [list(shard.piece).count(p) for p in dict.fromkeys(shard.piece.tolist())] == [len(p) for t in texts for p in pieces(t) if p]
