"""Registered queries against their SQL, the entry's guard, and the pipeline against its stages' plain forms."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import pytest
from oracle import compare, connect
from sitegauge.llm import mixing, queries
from test_mixing import plain_targets
from test_neardup import plain_kept
from test_quality import plain as plain_measures
from test_tokens import ids_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, data, name):
    assert compare(queries.QUERIES[name](spark, data), connect(data), queries.ORACLES[name]) == ""


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    root = Path(queries.__file__).parents[1]
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert not [p for p in others if re.search(r"\bllm\b", p.read_text())]


def test_pipeline(spark, data):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}

    kept = stages["quality_rules"](spark, docs, data).cache()
    assert kept.columns == docs.columns
    good = {r.doc_id for r in kept.collect()}
    for i, r in texts.items():
        n, chars, symbols, _, _, failed = plain_measures(r.text)
        if failed:
            assert i not in good
        elif symbols <= 0.1 * n and chars <= 12 * n and "\n" not in r.text:
            assert i in good

    single = stages["simhash_dedup"](spark, kept, data).cache()
    want = plain_kept([(i, texts[i].text, texts[i].source) for i in sorted(good)])
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == want

    mix = stages["mix_sources"](spark, single, data).cache()
    assert mix.columns == docs.columns
    times = Counter(r.doc_id for r in mix.collect())
    size = {i: len(texts[i].text.encode().split()) for i in want}
    by_source = defaultdict(list)
    for i in size:
        by_source[texts[i].source].append(i)
    target = plain_targets({s: sum(size[i] for i in v) for s, v in by_source.items()})
    for s, v in by_source.items():
        assert abs(sum(times[i] * size[i] for i in v) - target[s]) <= max(size[i] for i in v) / 2 + 1e-6
    assert set(times.values()) <= {1, 2} and all(r == texts[r.doc_id] for r in mix.collect())

    rows = stages["best_fit_packing"](spark, mix, data).collect()
    packed = Counter()
    for r in rows:
        packed[r.doc_id] += r.length
    assert packed == {i: n * len(ids_of(texts[i].text)) for i, n in times.items()}
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert mixing.BLOCK == 64
