"""Texts and documents made from results.

A report has a row for its head and one for each of its entries, in the order of (section, position), so its totals are those
of the page and no task holds all rows of one page, whatever their number; evidence packages are such lines too. Prompts are made
of at most six viewports, so each is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relabel_refs, title_case, viewport_ref
from ..plans import chunks
from ..rules import insights as R

SOURCES = ("tool", "heuristic", "vision")
NULLS = {"ignoreNullFields": "false"}


def _ordered(value: Column, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"])


def viewport_sections(boxes: DataFrame) -> DataFrame:
    """One text section per viewport of a page: its elements, one line per element index."""
    line = F.concat_ws(" ", viewport_ref(F.col("viewport_index"), F.col("element_index")), "element_type",
                       F.format_string("at %d,%d", "x", "y"))
    rows = boxes.filter(F.col("element_type").isNotNull()).groupBy("page_id", "viewport_index", "element_index").agg(
        F.min_by(line, "seq").alias("line"))
    body = F.array_join(_ordered(F.col("line"), "element_index"), "\n")
    head = F.format_string("--- Viewport-%d (scroll: %dpx) ---\n", F.col("viewport_index"), F.col("viewport_index") * 680)
    return rows.groupBy("page_id", "viewport_index").agg(body.alias("body")).select(
        "page_id", "viewport_index", F.concat(head, "body").alias("section"))


def filter_sections(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    return sections.join(wanted, ["page_id", "viewport_index"], "left_semi")


def report_json(pages: DataFrame, insights: DataFrame, scores: DataFrame, tests: DataFrame) -> DataFrame:
    """Report of each page, also of one without insights, as lines of JSON: its head (section 0) with ``pages``' facts, scores and
    totals by severity, category and source, its insights (1) in their order and its hypotheses (2) by place."""
    counts = {"total": F.count("*"), **{f"severity_{s}": F.count_if(F.col("severity") == s) for s in R.SEVERITIES},
              **{f"category_{c}": F.count_if(F.col("category") == c) for c in R.CATEGORIES},
              **{f"source_{s}": F.count_if(F.col("source") == s) for s in SOURCES}}
    sums = insights.groupBy("page_id").agg(*[v.alias(n) for n, v in counts.items()])
    planned = tests.groupBy("page_id").agg(F.count("*").alias("hypotheses"))
    rows = pages.join(scores, "page_id").join(sums, "page_id", "left").join(planned, "page_id", "left").fillna(
        0, [*counts, "hypotheses"])

    def by(kind, names):
        return F.struct(*[F.col(f"{kind}_{n}").alias(n) for n in names])

    meta = F.struct(*pages.columns, F.lit("1.0.0").alias("version"))
    score = F.struct(*[c for c in scores.columns if c != "page_id"])
    totals = F.struct("total", by("severity", R.SEVERITIES).alias("bySeverity"), by("category", R.CATEGORIES).alias("byCategory"),
                      by("source", SOURCES).alias("bySource"))
    head = F.struct(meta.alias("meta"), score.alias("scores"), totals.alias("insights"),
                    F.struct(F.col("hypotheses").alias("total")).alias("hypotheses"))
    entry = F.struct("severity", "category", "source", "type", "element", "issue", "recommendation", "heuristic_id", "confidence")
    test = F.struct("id", "title", "hypothesis", "control", "treatment", "primary_metric", "impact", "priority")
    return (rows.select("page_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"), F.to_json(head, NULLS).alias("json"))
            .unionByName(insights.select("page_id", F.lit(1).alias("section"), F.col("seq").alias("position"), F.to_json(entry, NULLS).alias("json")))
            .unionByName(tests.select("page_id", F.lit(2).alias("section"), F.col("place").cast("bigint").alias("position"),
                                      F.to_json(test, NULLS).alias("json"))))


def insight_text() -> Column:
    """Markdown of one insight."""
    return F.concat_ws("\n", F.concat(F.lit("### "), title_case(F.col("type"))),
                       F.concat(F.lit("- Category: "), "category"), F.concat(F.lit("- Element: `"), F.coalesce("element", F.lit("N/A")), F.lit("`")),
                       F.concat(F.lit("- Issue: "), "issue"), F.concat(F.lit("- Recommendation: "), "recommendation"),
                       F.concat(F.lit("- Heuristic: "), "heuristic_id"))


def report_markdown(insights: DataFrame, scores: DataFrame, tests: DataFrame) -> DataFrame:
    """Markdown of each page as ordered rows: summary (section 0), one section per severity that has issues, recommended tests.
    Position -1 is a section's heading."""
    table = [("Overall score", F.concat(F.col("overall").cast("string"), F.lit("/100")))] + [
        (f"{s.title()} issues", F.col(f"{s}_count").cast("string")) for s in R.SEVERITIES]
    top = F.lit(-1).cast("bigint").alias("position")
    summary = scores.select("page_id", F.lit(0).alias("section"), top, F.concat_ws(
        "\n", F.lit("# Page audit"), F.lit("| Metric | Value |"), F.lit("| --- | --- |"),
        *[F.concat(F.lit(f"| {n} | "), v, F.lit(" |")) for n, v in table]).alias("text"))
    titles = F.explode(F.array(*[F.when(F.col(f"{s}_count") > 0, F.struct(
        F.lit(i).alias("section"), F.lit(f"## {s.title()} issues").alias("text"))) for i, s in enumerate(R.SEVERITIES, 1)]))
    heads = scores.select("page_id", titles.alias("x")).filter("x IS NOT NULL").select("page_id", "x.section", top, "x.text")
    turn = F.array_position(F.array(*[F.lit(s) for s in R.SEVERITIES]), F.col("severity")).cast("int")
    issues = insights.select("page_id", turn.alias("section"), F.col("seq").alias("position"), insight_text().alias("text"))
    test = F.concat_ws("\n", F.concat(F.lit("### "), "id", F.lit(" "), "title"), F.concat(F.lit("- Control: "), "control"),
                       F.concat(F.lit("- Treatment: "), "treatment"), F.concat(F.lit("- Metric: "), "primary_metric"),
                       F.concat(F.lit("- Impact: "), "impact"), F.format_string("- Priority: %d/10", "priority"))
    last = F.lit(len(R.SEVERITIES) + 1).alias("section")
    plans = tests.select("page_id", last, F.col("place").cast("bigint").alias("position"), test.alias("text"))
    plan_heads = scores.filter((F.col("critical_count") > 0) | (F.col("high_count") > 0)).select(
        "page_id", last, top, F.lit("## Recommended tests").alias("text"))
    return summary.unionByName(heads).unionByName(issues).unionByName(plan_heads).unionByName(plans)


def evidence_package(pages: DataFrame, deduped: DataFrame, viewports: DataFrame, metrics: DataFrame, band: int = 1000,
                     most: int = 500) -> DataFrame:
    """Evidence of each page as lines of JSON in the order of (section, place, part), so a page of any size is in no one task.

    Section 0 is the head: ``pages``' facts (null where there are none), metrics (to four places) and warnings. Section 1 holds the elements in the order of
    (element_index, x, y), in arrays of at most ``most``; its place is the band of ``band`` indices they are from. Section 2 holds the
    viewports (place) with the indices that show in them, a line for each band that has some, one line for a viewport without.

    Values are dealt once, by ranges of (page_id, section, place), and lines are made of what then lies together: no text is shuffled,
    and the rows stay dealt in the order of the document.
    """
    fractions = {n: F.round(n, 4) for n, kind in metrics.dtypes if kind == "double"}
    facts = metrics.withColumns(fractions).select("page_id", F.struct(
        *[c for c in metrics.columns if c not in ("page_id", "warnings")]).alias("metrics"), "warnings")
    known = [c for c in pages.columns if c != "page_id"]
    meta = F.struct(*[F.col(f"meta_{c}").alias(c) for c in known])
    heads = facts.join(pages.select("page_id", *[F.col(c).alias(f"meta_{c}") for c in known]), "page_id", "left").select(
        "page_id", *_spot(0, F.lit(0)), F.struct(meta.alias("meta"), "metrics", "warnings").alias("head"))
    own_only = F.col("viewports").eqNullSafe(F.array("viewport_index"))  # as most boxes: its list is not dealt
    elements = deduped.select("page_id", *_spot(1, chunks.by_width(F.col("element_index"), band)), "element_index", F.struct(
        "x", "y", "w", "h", "viewport_index", "element_type", "confidence", F.when(~own_only, F.col("viewports")).alias("others")).alias("element"))
    shots = viewports.select("page_id", "viewport_index", "scroll_y").distinct().select(
        "page_id", *_spot(2, F.col("viewport_index")), F.struct("viewport_index", "scroll_y").alias("shot"))
    seen = deduped.filter(F.col("page_id").isNotNull()).select("page_id", F.explode("viewports").alias("viewport_index"), "element_index").select(
        "page_id", *_spot(2, F.col("viewport_index")), "element_index")
    spot = ["page_id", "section", "place"]
    rows = heads
    for more in (elements, shots, seen):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.repartitionByRange(*spot)

    # The rows of a viewport give way to the indices that show in it, which hold them.
    in_order = Window.partitionBy(*spot).orderBy("element_index", "element.x", "element.y")
    here = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shows = (F.col("section") == 2) & F.col("shot").isNull()
    rows = rows.withColumns({"turn": F.row_number().over(in_order), "shots": F.collect_set("shot").over(here), "shown": F.max(shows).over(here)})
    rows = rows.filter((F.col("section") < 2) | shows | ~F.col("shown"))
    part = F.when(F.col("section") == 1, F.floor((F.col("turn") - 1) / most)).when(
        F.col("section") == 2, chunks.by_width(F.col("element_index"), band))
    element = F.struct(
        "element_index", *[F.col(f"element.{c}").alias(c) for c in ("x", "y", "w", "h")],
        viewport_ref(F.col("element.viewport_index"), F.col("element_index")).alias("ref"),
        "element.element_type", "element.confidence", F.coalesce("element.others", F.array("element.viewport_index")).alias("viewports"))
    lines = rows.groupBy(*spot, part.alias("part")).agg(
        F.collect_list("head").alias("head"), F.array_sort(F.collect_list(F.when(F.col("section") == 1, element))).alias("elements"),
        F.first("shots").alias("shot"), F.array_sort(F.collect_set(F.when(F.col("section") == 2, F.col("element_index")))).alias("seen"))
    # A head or a viewport has a line for each; a place that has neither is one of elements, or of a viewport that is not there.
    lines = lines.select(*spot, F.coalesce("part", F.lit(0)).alias("part"), "elements", "seen", F.explode_outer(F.arrays_zip("head", "shot")).alias("of"))
    head = F.struct(F.lit("1.0.0").alias("schemaVersion"), "page_id", "of.head.meta", "of.head.metrics", "of.head.warnings")
    viewport = F.struct(F.format_string("viewport-%d", "of.shot.viewport_index").alias("id"), "of.shot.viewport_index", "of.shot.scroll_y",
                        F.col("seen").alias("elements"))
    json = F.when(F.col("section") == 0, F.to_json(head, NULLS)).when(F.col("section") == 1, F.to_json("elements", NULLS)).otherwise(
        F.to_json(viewport, NULLS))
    return lines.filter((F.col("section") == 1) | F.col("of").isNotNull()).select(*spot, "part", json.alias("json"))


def _spot(section: int, place: Column) -> list[Column]:
    return [F.lit(section).alias("section"), place.cast("bigint").alias("place")]


def prompts(sections: DataFrame, wanted: DataFrame, heuristics: DataFrame) -> DataFrame:
    """Text for judging a category on a page: the rules of the category and the viewport sections it needs.

    ``wanted(page_id, category, viewport_index)`` holds at most six viewports per category, so a text is short."""
    rule = F.format_string("[%s] (%s) %s", "heuristic_id", "severity", "principle")
    rules = heuristics.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(rule)), "\n").alias("rules"))
    body = relabel_refs(F.col("section"), F.col("viewport_index"))
    # A section is shuffled once, with the categories that need it, and meets them in the row of its page. Spark cannot know how
    # many categories need a viewport, so it must not broadcast these.
    needed = wanted.groupBy("page_id", "viewport_index").agg(F.collect_list("category").alias("needing"))
    pages = needed.hint("merge").join(sections, ["page_id", "viewport_index"]).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("viewport_index", body.alias("v"), "needing"))).alias("parts"))
    texts = pages.select("page_id", "parts", F.explode(F.array_distinct(F.flatten("parts.needing"))).alias("category"))
    texts = texts.join(F.broadcast(rules), "category")
    own = F.flatten(F.transform("parts", lambda p: F.transform(F.filter(p["needing"], lambda c: c == F.col("category")), lambda c: p["v"])))
    return texts.select("page_id", "category", F.concat_ws(
        "\n", F.concat(F.lit("Category: "), "category"), F.lit("Page:"), F.array_join(own, "\n\n"), F.lit("Rules:"), "rules",
        F.lit("Judge every rule and answer in JSON.")).alias("prompt"))
