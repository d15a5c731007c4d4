"""Merged snapshots against a tree that is built node by node, and order by paths."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.operators import quality as O
from sitegauge.plans import chunks

SCHEMA = ("page_id BIGINT, snapshot BIGINT, doc_pos BIGINT, xpath STRING, parent STRING, tag STRING, y DOUBLE, "
          "is_visible BOOLEAN, keeps_index BOOLEAN")


def snapshot(rng, page, number, size, deep):
    """Rows of one random tree in document order; a path has its parent's as beginning."""
    rows, paths, kids = [], ["/r"], {}
    parents = {"/r": None}
    for _ in range(size):
        up = paths[-1] if deep else rng.choice(paths)
        path = f"{up}/{rng.randint(0, 3) if not deep else 0}"
        if path not in parents:
            parents[path] = up
            kids.setdefault(up, []).append(path)
            paths.append(path)
    for c in kids.values():
        rng.shuffle(c)

    def walk(path):
        rows.append((page, number, len(rows), path, parents[path], "a", rng.choice([None, *map(float, range(5))]),
                     rng.random() < 0.8, rng.random() < 0.7))
        for c in kids.get(path, []):
            walk(c)
    walk("/r")
    return rows


def plain(rows):
    """{path: number} of one page, inserting one node at a time."""
    nodes, children, seen = {}, {None: []}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        _, number, _, path, parent, _, y, *_ = r
        if path in nodes:
            continue
        nodes[path], seen[path] = r, number
        among = children.setdefault(parent, [])
        height = float("inf") if y is None else y
        at = len(among)
        if number > seen.get(parent, min(x[1] for x in rows)):
            for i, other in enumerate(among):
                if height < (float("inf") if nodes[other][6] is None else nodes[other][6]):
                    at = i
                    break
        among.insert(at, path)
    out, n = {}, 0

    def walk(path):
        nonlocal n
        shown = nodes[path][7] and nodes[path][8]
        out[path] = n if shown else None
        n += shown
        for c in children.get(path, []):
            walk(c)
    for root in children[None]:
        walk(root)
    return out


def test_merged_trees(spark):
    rng = random.Random(3)
    rows = [r for page, (size, deep) in enumerate([(25, False)] * 6 + [(60, True), (400, False), (0, False)])
            for number in range(4) for r in snapshot(rng, page, number, size, deep)]
    got = {(r.page_id, r.xpath): r.idx for r in O.merge_snapshots(spark.createDataFrame(rows, SCHEMA), 7).collect()}
    want = {(page, path): idx for page in range(9) for path, idx in plain([r for r in rows if r[0] == page]).items()}
    assert got == want


def test_merge_of_no_nodes(spark):
    assert O.merge_snapshots(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rounds_grow_with_the_digits_of_the_depth(spark, monkeypatch):
    tables = []
    real = O.written
    monkeypatch.setattr(O, "written", lambda df: tables.append(1) or real(df))
    chain = spark.range(200).select(F.lit(1).alias("page_id"), F.col("id").cast("string").alias("xpath"),
                                    F.when(F.col("id") > 0, F.col("id") - 1).cast("string").alias("parent"), F.col("id").alias("step"))
    paths = {int(r.xpath): r.path for r in O.root_paths(chain).collect()}
    assert all(paths[i] == list(range(i + 1)) for i in range(200)) and len(tables) <= 9


def test_only_inner_nodes_take_rounds(spark, monkeypatch):
    """A chain with many leaves: paths are built of the nodes with children, and finished paths are not written again."""
    paths, real = [], O.written

    def counted(df):
        out = real(df)
        paths.append(out.count() if "path" in out.columns else 0)
        return out

    monkeypatch.setattr(O, "written", counted)
    nodes = [(1, 0, i, f"c{i}", f"c{i - 1}" if i else None, "a", None, True, True) for i in range(9)]
    nodes += [(1, 0, 10 + i, f"l{i}", f"c{i % 9}", "a", None, True, True) for i in range(300)]
    got = {r.xpath: r.idx for r in O.merge_snapshots(spark.createDataFrame(nodes, SCHEMA)).collect()}
    assert got == plain(nodes) and sum(paths) <= 9 * 5


def test_parents_in_a_cycle(spark):
    import pytest
    loop = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "a", 2)], "page_id INT, xpath STRING, parent STRING, step INT")
    with pytest.raises(ValueError, match="cycle"):
        O.root_paths(loop)


def test_range_index_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"),
                                    F.array(F.col("id") % 7, F.hash("id").cast("long")).alias("path"), "id")
    got = chunks.range_index(rows, ["k"], ["path"], "n")
    assert isinstance(got.schema["n"].dataType, T.LongType)
    by_key = {}
    for r in got.collect():
        by_key.setdefault(r.k, []).append((r.n, r.path))
    for found in by_key.values():
        assert [n for n, _ in sorted(found)] == list(range(len(found)))
        assert [p for _, p in sorted(found)] == sorted(p for _, p in found)
