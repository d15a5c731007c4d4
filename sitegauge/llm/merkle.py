"""A Merkle tree over a table, with the path from each row's leaf to the root.

Rows with one group value form a tree: its leaves stand in the order of the ids, and every ``ARITY`` neighbours of a level
(the last run may be shorter, even one) become one node of the next until one node is left, the group's subroot. The
subroots, in the order of the group values, likewise give the root.

A node is labelled by the interval [lo, hi) of leaf ranks that it covers, so the ancestor of a leaf on a level is the one
whose interval contains the leaf's; intervals of a level are aligned, so this containment join is an equality of
(tree, bucket), the bucket being the rank over the width of the level. The siblings of a node are what its parent's
interval holds outside its own. A table of labelled nodes for each single level would cost a shuffle per level and a row
per leaf and level. So ``STEP`` levels go into one block: ARITY**STEP neighbours, one bounded array, whose inner levels
are folded inside the row. Going up, each step shuffles the digests of one node per block; going down, a block takes the
path of its node by one containment join and hands it to its members.

Nulls: a null value enters a leaf as ``-``; null groups form a tree of their own, the first; null ids come first. Ties and
repeated rows: every row is a leaf; equal ids stand in the order of their leaves, and equal rows in that of the scan (they
are interchangeable). Empty and very long texts are hashed whole; only digests are shuffled. A single row in its group is
its own subroot, and a single group's subroot is the root. An empty table gives no rows. Columns besides those named are
neither read nor returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .common import number_rows

ARITY, STEP = 3, 6
NO_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def siblings(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def _levels(n: Column) -> Column:
    """Levels that a tree of ``n`` nodes still has above it, up to ``STEP``."""
    return sum([(n > ARITY ** k).cast("int") for k in range(1, STEP)], (n > 1).cast("int"))


def _parents(nodes: Column) -> Column:
    """The next level of labelled nodes: an interval and a digest for each run of neighbours."""
    def parent(i):
        run = F.slice(nodes, i * ARITY + 1, ARITY)
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
                        digest(F.array_join(F.transform(run, lambda x: x["digest"]), "")).alias("digest"))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), parent)


def _block_levels(members: Column, levels: Column) -> Column:
    """Labelled nodes of a block, level by level; the last level is the block's own node."""
    first = F.transform(members, lambda m, i: F.struct(i.alias("lo"), (i + 1).alias("hi"), m["digest"].alias("digest")))
    return F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(STEP)), 1, levels), F.array(first),
                       lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def _inner_path(levels: Column, at: Column) -> Column:
    """What each parent's interval holds left and right of the node above leaf ``at``, on the levels of a block."""
    def step(nodes, level):
        place = F.floor(at / F.pow(F.lit(float(ARITY)), level)).cast("int")
        run, own = F.slice(nodes, F.floor(place / ARITY).cast("int") * ARITY + 1, ARITY), nodes[place]
        text = lambda xs: F.array_join(F.transform(xs, lambda x: x["digest"]), "")
        return F.struct(text(F.filter(run, lambda x: x["hi"] <= own["lo"])).alias("left"),
                        text(F.filter(run, lambda x: x["lo"] >= own["hi"])).alias("right"))
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each step, from the leaves up, and the last node of each tree.

    ``nodes`` holds (tree, pos, n, digest, ...); n is the number of nodes of the tree, pos counts from 0. The blocks hold
    their members in order and their labelled levels.
    """
    extra = [c for c in nodes.columns if c not in ("tree", "pos", "n", "digest")]
    blocks, width = [], ARITY ** STEP
    while True:
        held = F.array_sort(F.collect_list(F.struct("pos", "digest", *extra)))
        grouped = (nodes.groupBy("tree", F.floor(F.col("pos") / width).alias("block"))
                   .agg(F.first("n").alias("n"), held.alias("members")))
        step = written(grouped.withColumn("levels", _block_levels(F.col("members"), _levels(F.col("n")))))
        blocks.append(step)
        nodes = step.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"),
                            F.element_at("levels", -1)[0]["digest"].alias("digest"))
        extra = []
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return blocks, nodes


def _descend(blocks: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Members of the lowest blocks with their whole paths; ``paths`` holds (tree, path, ...) of the last nodes."""
    kept = [c for c in paths.columns if c not in ("tree", "path")]
    above = paths.withColumn("pos", F.lit(0).cast("long"))
    for step in reversed(blocks):
        inside = step.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
        member = inside.select("tree", "path", "levels", *kept, F.posexplode("members").alias("at", "member"))
        path = F.concat(_inner_path(F.col("levels"), F.col("at")), "path")
        above = member.select("tree", F.col("member.pos").alias("pos"), path.alias("path"), *kept, "member")
    return above


def manifest(docs: DataFrame, columns: tuple[str, ...], group_col: str = "source", id_col: str = "doc_id",
             claimed: Column | None = None) -> DataFrame:
    """One row per document: (id, leaf, claimed, subroot, root, path).

    ``columns`` enter the leaf in this order. ``claimed`` is another leaf to carry along, for ``folded(path, claimed)``
    to test (the leaf itself by default). ``path`` has, per level from the leaf to the root, the joined digests left and
    right of the node among its parent's children.
    """
    leaf = leaf_of(*[F.col(c) for c in columns])
    rows = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf.alias("digest"),
                       (leaf if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    ranked = written(number_rows(written(rows), [F.col(c) for c in ("grp", "id", "digest", "row")], "rank"))
    groups = ranked.groupBy("grp").agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    groups = written(number_rows(groups, [F.col("grp")], "tree"))
    same = F.col("r.grp").eqNullSafe(F.col("g.grp"))
    leaves = ranked.alias("r").join(groups.alias("g"), same).select(
        "tree", (F.col("rank") - F.col("start")).alias("pos"), "n", "digest", "id", "claimed")
    blocks, subroots = _climb(leaves)
    n = subroots.count()
    tops, root = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
                                        F.lit(n).cast("long").alias("n"), "digest"))
    found = _descend(tops, root.select("tree", F.col("digest").alias("root"), F.array().cast(NO_PATH).alias("path")))
    above = found.select(F.col("pos").alias("tree"), "path", "root", F.col("member.digest").alias("subroot"))
    out = _descend(blocks, written(above))
    return out.select(F.col("member.id").alias(id_col), F.col("member.digest").alias("leaf"),
                      F.col("member.claimed").alias("claimed"), "subroot", "root", "path")
