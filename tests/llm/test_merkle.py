import hashlib

import pytest
from cases import documents, empty, odd
from pyspark.sql import functions as F
from sitegauge.llm import merkle, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def plain_tree(nodes):
    """(root, siblings of each first node as (left, right) per level)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for i, at in enumerate(place):
            run = runs[at // 3]
            paths[i].append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
            place[i] = at // 3
        nodes = [H(*run) for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    """The root, and (id, leaf, subroot, path) of all rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([leaf for _, _, leaf in sorted(groups[s])]) for s in order]
    root, above = plain_tree([t[0] for t in trees])
    return root, [(i if known else None, leaf, sub, tuple(path + up))
                  for s, (sub, paths), up in zip(order, trees, above, strict=True)
                  for (known, i, leaf), path in zip(sorted(groups[s]), paths, strict=True)]


def check(df):
    rows = df.select(*COLUMNS).collect()
    got = merkle.manifest(df, COLUMNS).collect()
    root, want = plain_manifest(rows)
    have = [(r.doc_id, r.leaf, r.subroot, tuple((x.left, x.right) for x in r.path)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert {r.root for r in got} == {root} and all(r.claimed == r.leaf for r in got)


def test_documents(spark, data):
    check(spark.read.parquet(f"{data}/documents.parquet"))


@pytest.mark.parametrize("step", [1, 2, 6])
def test_odd_rows(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    check(odd(spark))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82])
def test_sizes_over_several_steps(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "STEP", 2)
    check(documents(spark, [(i, f"t{i}", "a") for i in range(n)] + [(0, "x", None), (7, "y", "b"), (5, "z", "b")]))


def test_a_hot_group_over_blocks(spark):
    check(documents(spark, [(i, f"t{i}", "hot" if i % 3 else f"s{i % 50}") for i in range(2500)]))


def test_empty(spark):
    assert merkle.manifest(empty(spark), COLUMNS).collect() == []


def test_changed_rows_do_not_verify(spark):
    df = documents(spark, [(i, f"line\n{i}" if i % 2 else "same", "ab"[i % 2]) for i in range(40)])
    claimed = merkle.leaf_of(*[F.translate(c, "\n", "") if c == "text" else F.col(c) for c in COLUMNS])
    rows = merkle.manifest(df, COLUMNS, claimed=claimed).select(
        "doc_id", (merkle.folded(F.col("path"), F.col("claimed")) == F.col("root")).alias("ok"),
        (merkle.folded(F.col("path"), F.col("leaf")) == F.col("root")).alias("sound")).collect()
    assert all(r.sound and r.ok == (r.doc_id % 2 == 0) for r in rows)


def test_lengths_keep_values_apart(spark):
    a, b = spark.createDataFrame([("1", "23"), ("12", "3")], "x string, y string").select(
        merkle.leaf_of(F.col("x"), F.col("y"))).collect()
    assert a != b


def test_query_of_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(rows) == odd(spark).count() and all(r.verified == (r.folded_root == r.root) for r in rows)
    assert any(not r.verified for r in rows) and all(r.verified for r in rows if r.doc_id is None)
