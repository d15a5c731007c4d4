"""Evidence about a page: boxes with details, coverage metrics, warnings and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.selectors import attr
from ..plans import chunks
from ..rules import steps as R
from ..rules.elements import ELEMENT_TYPES


def box_details(boxes: DataFrame, indexed_nodes: DataFrame) -> DataFrame:
    """Typed boxes with tag and text of their node, 'unknown' when it is not there."""
    node = indexed_nodes.groupBy("page_id", "element_index").agg(F.min_by(F.struct("tag", "text"), "doc_pos").alias("node"))
    rows = boxes.filter(F.col("element_type").isNotNull()).join(node, ["page_id", "element_index"], "left")
    return rows.withColumns({"tag": F.coalesce("node.tag", F.lit("unknown")),
                             "text": F.coalesce(F.substring("node.text", 1, 100), F.lit(""))}).drop("node")


def element_selectors(nodes: DataFrame) -> DataFrame:
    """Shortest selector that finds an element: id, unique aria-label, unique test id, else its path."""
    def quoted(name):
        return F.when(attr(name) != "", F.concat(F.lit(f'[{name}="'), attr(name), F.lit('"]')))

    rows = nodes.withColumns({"_label": quoted("aria-label"), "_test": quoted("data-testid")})
    for name in ("_label", "_test"):
        # Values that occur once on their page; counting combines on the map side.
        once = rows.filter(F.col(name).isNotNull()).groupBy("page_id", name).agg(F.count("*").alias(f"{name}_n"))
        rows = rows.join(once, ["page_id", name], "left")
    by_id = F.when(attr("id") != "", F.concat(F.lit("#"), attr("id")))
    return rows.withColumn("selector", F.coalesce(
        by_id, F.when(F.col("_label_n") == 1, F.col("_label")), F.when(F.col("_test_n") == 1, F.col("_test")),
        F.replace(F.regexp_replace("xpath", "^/html/body/?", "body/"), F.lit("/"), F.lit(" > "))))


# ---------------------------------------------------------------- metrics

def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def type_counts() -> list[Column]:
    return [F.count_if(F.col("element_type") == t).alias(f"n_{t}") for t in ELEMENT_TYPES]


def element_metrics(elements: DataFrame) -> DataFrame:
    """Per page: counts by type, share with a real box, share of important elements in the first viewport."""
    important = F.col("element_type").isin(R.IMPORTANT_TYPES)
    first = F.array_contains("viewports", 0)
    sums = elements.groupBy("page_id").agg(
        *type_counts(), F.count("*").alias("elements"),
        F.count_if((F.col("w") > 0) & (F.col("h") > 0)).alias("boxed"), F.count_if(important).alias("important"),
        F.count_if(important & first).alias("important_first"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence"))
    return sums.withColumns({"box_coverage": _share(F.col("boxed"), F.col("elements")),
                             "fold_coverage": _share(F.col("important_first"), F.col("important"))})


def interval_union(ranges: DataFrame, width: int = 10_000) -> DataFrame:
    """Length covered by the ranges ``[start, stop)`` of a page.

    Of ranges that start alike only the longest counts, so a page has no more rows than pixels, whatever its boxes. A row
    adds what lies beyond the furthest stop of the rows before it; ``width`` cuts long pages.
    """
    cut = chunks.by_width(F.col("start"), width)
    # What the join on chunks drops goes before, so both sides of it read one shuffle.
    longest = ranges.filter(F.col("page_id").isNotNull() & cut.isNotNull()).groupBy("page_id", "start").agg(F.max("stop").alias("stop"))
    rows = chunks.running_max(longest, ["page_id"], ["start", "stop"], [cut],
                              F.col("stop"), "_reach", inclusive=False)
    added = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("_reach", F.col("start"))))
    return rows.groupBy("page_id").agg(F.sum(added).alias("covered"))


def summed_lengths(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("page_id").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))


def page_metrics(element_sums: DataFrame, covered: DataFrame, pages: DataFrame, capped: bool) -> DataFrame:
    """Metrics of every page of ``pages(page_id, page_height, has_structured)``; one row a page on each side."""
    ratio = F.coalesce("covered", F.lit(0)) / F.col("page_height")
    counts = [c for c in element_sums.columns if c.startswith("n_")] + ["elements", "low_confidence"]
    out = pages.join(element_sums, "page_id", "left").join(covered, "page_id", "left")
    return out.select(
        "page_id", "has_structured", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("box_coverage", F.lit(0.0)).alias("box_coverage"),
        F.coalesce("fold_coverage", F.lit(0.0)).alias("fold_coverage"),
        F.when(F.col("page_height") > 0, F.least(F.lit(1.0), ratio) if capped else ratio).otherwise(0.0).alias("page_coverage"))


def warnings(metrics: DataFrame) -> DataFrame:
    """What a product page is expected to show and does not."""
    price = F.col("n_price") > 0
    structured = F.coalesce(F.col("price") != 0, F.lit(False))
    found = F.array_compact(F.array(
        *[F.when(F.col(f"n_{t}") == 0, f"missing {t}") for t in R.EXPECTED_TYPES],
        F.when(~structured & price, "price only visible"), F.when(structured & ~price, "price only structured"),
        F.when(F.col("elements") == 0, "no elements"),
        F.when(F.col("low_confidence") * 2 > F.col("elements"), F.concat(
            F.col("low_confidence").cast("string"), F.lit(" elements of low confidence")))))
    return metrics.withColumn("warnings", found)


def extraction_quality(metrics: DataFrame) -> DataFrame:
    """Score of the extraction, whether it meets the thresholds, and the issues."""
    lost = ((1 - F.col("box_coverage")) * 30 + (1 - F.col("page_coverage")) * 20 + (1 - F.col("fold_coverage")) * 20
            + F.when(F.col("has_structured"), 0).otherwise(10) + F.least(F.col("warning_count") * 2, F.lit(20)))
    low = {"boxes": F.col("box_coverage") < 0.8, "coverage": F.col("page_coverage") < 0.9,
           "fold": F.col("fold_coverage") < 0.5}
    issues = {**low, "no cta": F.col("n_cta") == 0, "no price": F.col("n_price") == 0, "no structured data": ~F.col("has_structured")}
    return metrics.withColumns({
        "quality": F.greatest(F.lit(0), F.least(F.lit(100), N.half_up(100 - lost))).cast("bigint"),
        "meets": ~(low["boxes"] | low["coverage"] | low["fold"]),
        "issues": F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in issues.items()])), ",")})


def metrics_text() -> Column:
    """Metrics of a page in words: the element types it has, coverage in whole percent, structured data, warnings."""
    def percent(name):
        return F.concat(F.floor(F.col(name) * 100 + 0.5).cast("string"), F.lit("%"))

    kinds = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(f"{k} "), F.col(f"n_{k}").cast("string"))) for k in ELEMENT_TYPES])), ", ")
    return F.concat_ws(
        "\n", F.concat(F.lit("Elements: "), F.when(kinds == "", "none").otherwise(kinds)),
        F.concat(F.lit("Coverage: boxes "), percent("box_coverage"), F.lit(", screenshots "), percent("page_coverage"),
                 F.lit(", above fold "), percent("fold_coverage")),
        F.concat(F.lit("Structured data: "), F.when(F.col("has_structured"), "yes").otherwise("no")),
        F.concat(F.lit("Warnings: "), F.size("warnings").cast("string")))
