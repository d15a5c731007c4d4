"""Quality of collected viewports, coverage of pages, and agreement of prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.lookup import count_true
from ..plans import chunks
from ..rules import steps as R
from ..sources.shared import written
from ..sources.tables import DERIVED_NODE_CHUNK

# ---------------------------------------------------------------- viewport signals


def viewport_validation(signals: DataFrame) -> DataFrame:
    """Failures, warnings and severity of each viewport's loading signals."""
    limits = {"blank_images": R.MAX_BLANK, "placeholder_images": R.MAX_PLACEHOLDER, "lazy_pending": R.MAX_LAZY,
              "text_placeholders": R.MAX_TEXT_PLACEHOLDER}
    low = (F.col("total_images") > 0) & (F.col("loaded_images") < F.col("total_images") * R.MIN_LOAD_RATIO)
    fails = {**{n: F.col(n) > m for n, m in limits.items()}, "spinner": F.col("spinner"), "skeleton": F.col("skeleton"),
             "overlay": F.col("overlay"), "load_ratio": low}
    warns = {**{n: (F.col(n) > 0) & (F.col(n) <= m) for n, m in limits.items()},
             "media": F.col("media_timed_out"), "scroll": ~F.col("scroll_verified")}
    rows = signals.withColumns({
        "fails": count_true(fails.values()), "warns": count_true(warns.values()),
        "issues": F.concat_ws(",", *[F.when(c, n) for n, c in fails.items()], *[F.when(c, f"{n}?") for n, c in warns.items()])})
    return rows.withColumn("severity", F.when(F.col("fails") > 0, "fail").when(F.col("warns") > 0, "warning").otherwise("ok"))


def collection_quality(signals: DataFrame) -> DataFrame:
    """Score, flags and verdict of a page's collection. Viewports of a page are few, so the list to take again is short."""
    failed, warned = F.col("severity") == "fail", F.col("severity") == "warning"
    sums = viewport_validation(signals).groupBy("page_id").agg(
        F.count("*").alias("viewports"), F.count_if(failed).alias("failed"), F.count_if(warned).alias("warned"),
        F.sum("total_images").alias("images"), F.sum("loaded_images").alias("loaded"), F.sum("blank_images").alias("blank"),
        F.sum("placeholder_images").alias("placeholders"), F.bool_or("spinner").alias("spinner"), F.bool_or("skeleton").alias("skeleton"),
        F.bool_or("overlay").alias("overlay"), F.bool_or(~F.col("scroll_verified")).alias("scroll_off"),
        F.array_sort(F.collect_set(F.when(failed, F.col("viewport_index")))).alias("recheck"))
    c = F.col
    total = ((c("viewports") - c("failed")) / c("viewports") * 40 + F.when(c("images") > 0, c("loaded") / c("images") * 30).otherwise(30.0)
             + (20 - F.when(c("spinner"), 7).otherwise(0) - F.when(c("skeleton"), 7).otherwise(0) - F.when(c("overlay"), 6).otherwise(0))
             + (10 - F.least(F.lit(10), c("warned") * 2)))
    flags = {"failed": c("failed") > 0, "warned": c("warned") > 0, "blank": c("blank") > R.MAX_BLANK * 2,
             "placeholders": c("placeholders") > R.MAX_PLACEHOLDER * 2, "overlay": c("overlay"), "scroll": c("scroll_off")}
    return sums.withColumns({
        "score": F.greatest(F.lit(0), F.least(F.lit(100), N.half_up(total))).cast("bigint"),
        "flags": F.concat_ws(",", *[F.when(v, n) for n, v in flags.items()]),
        "passed": (c("failed") == 0) & (count_true(flags.values()) <= 1)})


def needs_review() -> Column:
    return ~F.col("passed") | (F.col("score") < 70) | (F.col("failed") > 0)


def skip_review() -> Column:
    """Nothing to ask when all is well, or when more than half is to be taken again anyway."""
    return ((F.col("score") >= 85) & (F.col("failed") == 0)) | (F.col("failed") > F.col("viewports") * 0.5)


def quality_text() -> Column:
    again = F.array_join(F.col("recheck").cast("array<string>"), ", ")
    return F.concat_ws("\n", F.format_string("Collection: %s (score: %d/100)", F.when(F.col("passed"), "PASSED").otherwise("FAILED"), "score"),
                       F.when(F.col("flags") != "", F.concat(F.lit("Flags: "), "flags")),
                       F.when(again != "", F.concat(F.lit("Recheck viewports: "), again)))


# ---------------------------------------------------------------- plans from page heights

def _segments() -> tuple[Column, Column]:
    """(height of a step, number of segments)."""
    step = F.greatest(F.col("viewport_h") - R.SEGMENT_OVERLAP, F.col("viewport_h") / 2)
    return step, F.ceil(F.col("page_height") / step).cast("int")


def plan_segments(pages: DataFrame) -> DataFrame:
    """``pages(page_id, page_height, viewport_h)`` cut into overlapping segments."""
    step, n = _segments()
    rows = pages.filter((F.col("page_height") > 0) & (F.col("viewport_h") > 0)).select(
        "page_id", "page_height", "viewport_h", step.alias("step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("segment"))
    start = F.col("segment") * F.col("step")
    return rows.select("page_id", "segment", start.alias("start"),
                       F.least(start + F.col("viewport_h"), F.col("page_height")).alias("stop"))


def segments_scanned(pages: DataFrame, positions: DataFrame) -> DataFrame:
    """Segments some scroll position shows. The segments a position overlaps follow from its y, so no range
    join is needed: each position names its few segments and duplicates combine on the map side."""
    step, n = _segments()
    facts = pages.select("page_id", "page_height", "viewport_h", step.alias("step"), n.alias("n"))
    seen = positions.select("page_id", "scroll_y").distinct().join(facts, "page_id").filter(F.col("scroll_y") < F.col("page_height"))
    first = F.greatest(F.lit(0), F.floor((F.col("scroll_y") - F.col("viewport_h")) / F.col("step")) + 1)
    last = F.least(F.col("n") - 1, F.ceil((F.col("scroll_y") + F.col("viewport_h")) / F.col("step")) - 1)
    rows = seen.withColumns({"_a": first.cast("int"), "_b": last.cast("int")}).filter(F.col("_a") <= F.col("_b"))
    return rows.select("page_id", F.explode(F.sequence("_a", "_b")).alias("segment")).distinct()


def coverage(pages: DataFrame, positions: DataFrame) -> DataFrame:
    """Segments, how many are scanned, the percentage, and the steps a full audit needs."""
    _, n = _segments()
    covered = segments_scanned(pages, positions).groupBy("page_id").agg(F.count("*").alias("scanned"))
    rows = pages.select("page_id", n.cast("bigint").alias("segments")).join(covered, "page_id", "left").fillna(0, ["scanned"])
    return rows.withColumns({"percent": N.half_up(F.col("scanned") * 100 / F.col("segments")).cast("bigint"),
                             "required_steps": F.col("segments") + R.ANALYSIS_STEPS})


def unscanned_segments(pages: DataFrame, positions: DataFrame) -> DataFrame:
    """Segments left per page, the first three as text. A page has as many segments as its height allows."""
    left = plan_segments(pages).join(segments_scanned(pages, positions), ["page_id", "segment"], "left_anti")
    text = F.concat(F.col("start").cast("bigint").cast("string"), F.lit("-"), F.col("stop").cast("bigint").cast("string"), F.lit("px"))
    near = Window.partitionBy("page_id").orderBy("segment")  # cut to three before the shuffle
    three = left.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= 3).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", text.alias("t")))).alias("s"))
    firsts = left.groupBy("page_id").agg(F.count("*").alias("left")).join(three, "page_id")
    more = F.when(F.col("left") > 3, F.format_string(" (+%d more)", F.col("left") - 3)).otherwise("")
    return firsts.select("page_id", "left", F.concat(F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["t"]), ", "), more).alias("regions"))


def plan_viewports(pages: DataFrame) -> DataFrame:
    step = F.col("viewport_h") - R.VIEWPORT_OVERLAP
    last = F.greatest(F.lit(0), F.col("page_height") - F.col("viewport_h"))
    n = F.ceil(last / step).cast("int")
    return pages.select("page_id", "viewport_h", F.explode(F.sequence(F.lit(0), n)).alias("viewport_index")).select(
        "page_id", "viewport_index", (F.col("viewport_index") * step).alias("scroll_y"))


def plan_tiles(pages: DataFrame) -> DataFrame:
    """Overlapping screenshot tiles, at most five, ending with the one that reaches the bottom."""
    step = R.TILE_HEIGHT - R.TILE_OVERLAP
    rows = pages.filter(F.col("page_height") > 0).select("page_id", "page_height", F.explode(
        F.sequence(F.lit(0), F.lit(R.MAX_TILES - 1))).alias("tile")).withColumn("start", F.col("tile") * step)
    reached = (F.col("tile") > 0) & (F.col("start") - step + R.TILE_HEIGHT >= F.col("page_height"))
    return rows.filter(~reached).select("page_id", "tile", "start", F.least(F.col("start") + R.TILE_HEIGHT, F.col("page_height")).alias("stop"))


def plan_steps(height: Column, viewport: Column) -> Column:
    """Steps to collect a page: two per viewport and one more, a fifth on top, at least five."""
    views = F.ceil(height / F.greatest(viewport - R.VIEWPORT_OVERLAP, viewport / 2))
    steps = views * 2 + 1
    planned = F.greatest(F.lit(5), steps + F.floor((steps + 4) / 5))
    return F.when((height <= 0) | (viewport <= 0), 5).otherwise(planned).cast("bigint")


def scroll_progress(scroll: Column, height: Column) -> Column:
    most = height - 800
    return F.when(most <= 0, 100.0).otherwise(F.least(F.lit(100.0), scroll / most * 100))


# ---------------------------------------------------------------- snapshots

def root_paths(nodes: DataFrame, step: str = "step") -> DataFrame:
    """Each node's steps from the root down, as an array ``path``, from (page_id, xpath, parent, ``step``, ...).

    The path above a node doubles in length in each round: it is joined to the path of the ancestor that it ends at, so
    a tree takes as many rounds as its depth has binary digits. ``parent`` is null for nodes without one."""
    done, rounds = [], 0
    rows = nodes.withColumn("path", F.array(step)).withColumn("_up", F.col("parent")).drop(step)
    while True:
        rows = written(rows)
        done.append(rows.filter(F.col("_up").isNull()))  # a finished path is not written again
        open_rows = rows.filter(F.col("_up").isNotNull())
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("_up")
        if rounds == 24:
            raise ValueError("parents form a cycle")
        above = reduce(DataFrame.unionByName, [*done, open_rows]).select(
            "page_id", F.col("xpath").alias("_up"), F.col("path").alias("_above"), F.col("_up").alias("_next"))
        rows, rounds = open_rows.join(above, ["page_id", "_up"]).withColumns(
            {"path": F.concat("_above", "path"), "_up": F.col("_next")}).select(*rows.columns), rounds + 1


def merge_snapshots(nodes: DataFrame, chunk_nodes: int = DERIVED_NODE_CHUNK) -> DataFrame:
    """Union of the snapshots of a page as one tree: a path counts as first seen, and nodes are numbered again in pre-order.

    ``nodes`` holds (page_id, snapshot, doc_pos, xpath, parent, tag, y, is_visible, keeps_index); a parent that no
    snapshot has counts as none. Children that came with their parent stand in document order. One of a later snapshot is put
    before the first child that is further down, after all others when it has no box. Those before it are then no further
    down than it is, so the place of a child that came with its parent is the greatest y up to it, that of a later one its own
    y, and equal places go in the order of coming. The rank of a node in its tree is then the order of the places on its
    path from the root. ``idx`` counts the visible nodes that keep an index."""
    first = written(nodes.groupBy("page_id", "xpath").agg(F.min(
        F.struct("snapshot", "doc_pos", "parent", "tag", "y", "is_visible", "keeps_index")).alias("n"))
        .select("page_id", "xpath", "n.*"))
    up = first.select("page_id", F.col("xpath").alias("parent"), F.col("snapshot").alias("_with"))
    cut = ["snapshot", "_cut"]

    def placed_within(some: DataFrame, known: Column) -> DataFrame:
        so_far = Window.partitionBy("page_id", "parent", *cut).orderBy("doc_pos").rowsBetween(Window.unboundedPreceding, 0)
        y = F.coalesce("y", F.lit(float("inf"))).cast("double")
        some = some.withColumns({"_came": F.col("snapshot") <= known, "_cut": chunks.by_width(F.col("doc_pos"), chunk_nodes)})
        return some.filter(F.col("_came").isNotNull()).withColumn(
            "_place", F.when(F.col("_came"), F.max(F.when(F.col("_came"), y)).over(so_far)).otherwise(y))

    # The join deals the rows by (page, parent), so the greatest y up to a node within its chunk needs no other shuffle. Only nodes
    # without a parent need the page's first snapshot, and are dealt again as the children of none.
    rows = written(placed_within(first.join(up, ["page_id", "parent"], "left"), F.coalesce("_with", "snapshot")))
    page = first.groupBy("page_id").agg(F.min("snapshot").alias("_start"))
    roots = rows.filter(F.col("_with").isNull()).withColumn("parent", F.lit(None).cast(rows.schema["parent"].dataType))
    roots = placed_within(roots.join(page, "page_id"), F.col("_start")).drop("_start")
    local = rows.filter(F.col("_with").isNotNull()).unionByName(written(roots)).drop("_with")
    before = Window.partitionBy("page_id", "parent").orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    carry = local.filter("_came").groupBy("page_id", "parent", *cut).agg(F.max("_place").alias("_most"))
    carry = written(carry.withColumn("_before", F.max("_most").over(before)).filter(F.col("_before").isNotNull()).select(
        F.col("page_id").alias("_page"), F.col("parent").alias("_parent"), *[F.col(c).alias(f"_at{i}") for i, c in enumerate(cut)], "_before"))
    same = ((F.col("page_id") == F.col("_page")) & F.col("parent").eqNullSafe(F.col("_parent"))
            & F.col("_cut").eqNullSafe(F.col("_at1")) & (F.col("snapshot") == F.col("_at0")) & F.col("_came"))
    # Places are needed of nodes that are numbered and of those that have children. Paths are built of the latter, and the
    # others take their parent's.
    shown = F.col("is_visible") & F.col("keeps_index")
    parents = local.filter(F.col("parent").isNotNull()).select("page_id", F.col("parent").alias("xpath")).distinct()
    needed = local.join(parents.withColumn("_inner", F.lit(True)), ["page_id", "xpath"], "left").filter(shown | F.col("_inner"))
    step = F.struct(F.greatest("_before", "_place").alias("place"), "snapshot", "doc_pos")
    placed = written(needed.join(carry, same, "left").withColumn("step", step).drop(*carry.columns, "_place", "_came", "_cut"))
    inner = placed.filter("_inner").select("page_id", "xpath", "parent", "step")
    above = root_paths(inner).select("page_id", F.col("xpath").alias("parent"), F.col("path").alias("_above"))
    path = F.concat(F.coalesce("_above", F.array().cast(above.schema["_above"].dataType)), F.array("step"))
    tree = placed.filter(shown).join(above, ["page_id", "parent"], "left").withColumn("path", path).drop("_above", "_inner", "step")
    numbered = chunks.range_index(tree, ["page_id"], ["path"], "idx")
    hidden = local.filter(~shown).drop("_place", "_came", "_cut").withColumn("idx", F.lit(None).cast("bigint"))
    return numbered.drop("path").unionByName(hidden)


def mark_new_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose path is in no earlier snapshot of the page."""
    first = nodes.groupBy("page_id", "xpath").agg(F.min("snapshot").alias("_first"))
    return nodes.join(first, ["page_id", "xpath"]).withColumn("is_new", F.col("snapshot") == F.col("_first")).drop("_first")


# ---------------------------------------------------------------- structured against visible

def normalize_stock(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return (F.when(low.contains("in stock") | low.contains("instock") | (low == "available"), "InStock")
            .when(low.contains("out of stock") | low.contains("outofstock") | (low == "sold out"), "OutOfStock")
            .when(low.rlike("pre-?order"), "PreOrder").when(low.rlike("back-?order"), "BackOrder")
            .when(low.contains("limited"), "LimitedAvailability").otherwise(value))


def reconcile_prices(structured: DataFrame, visible: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """``structured(page_id, jsonld_price)`` against ``visible(page_id, seq, price)``: which sources have a
    price, whether a visible one matches within the tolerance, and the price to use.

    Each side is reduced to one row per page; the match needs the structured price on every visible row, which
    chunks of a hot page get through the chunk totals rather than through a skewed join."""
    both = visible.select("page_id", "seq", "price", F.lit(None).cast("double").alias("jsonld_price")).unionByName(
        structured.select("page_id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("price"), "jsonld_price"))
    rows = chunks.key_totals(both, ["page_id"], {"known": F.max("_known")}, {"_known": F.max("jsonld_price")},
                             chunks.by_hash(both, "page_id", "seq"))
    matched = F.bool_or(N.prices_match(F.col("known"), F.col("price"), tolerance))
    sums = rows.groupBy("page_id").agg(F.max("jsonld_price").alias("jsonld_price"), F.min_by("price", F.when(F.col("price").isNotNull(), F.col("seq"))).alias("dom_price"),
                                       F.coalesce(matched, F.lit(False)).alias("same"))
    j, d = F.col("jsonld_price").isNotNull(), F.col("dom_price").isNotNull()
    return sums.withColumns({
        "sources": F.when(j & d, "both").when(j, "structured").when(d, "visible").otherwise("none"),
        "severity": F.when(j & d & ~F.col("same"), "critical").when(j & d, "ok").when(j | d, "warning").otherwise("info"),
        "matched": (j | d) & ~(j & d & ~F.col("same")), "selected": F.coalesce("jsonld_price", "dom_price")}).drop("same")


def reconcile_availability(a: Column, b: Column) -> dict[str, Column]:
    x, y = normalize_stock(a), normalize_stock(b)
    return {"structured": x, "visible": y, "severity": F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, "ok").otherwise("warning"))
            .when(x.isNotNull() | y.isNotNull(), "info").otherwise("none")}
