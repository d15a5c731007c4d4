"""Typing elements, placing them in viewports and choosing among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.lookup import any_of, contains_any, map_value
from ..functions.selectors import attr, class_strength, has_attr, lowered, prepared, text_word, unprepared
from ..functions.text import bounded_pattern, intent_words
from ..rules import elements as R


def _holds(kind: str, pattern: str) -> Column:
    """One signal of the pattern table against a prepared node."""
    if kind == "tag":
        return F.col("tag") == pattern
    if kind == "class":
        return F.col("_class").contains(pattern)
    if kind == "role":
        return F.col("_role") == pattern
    if kind == "text":
        return contains_any(F.col("_text"), pattern.split("|"))
    name, _, value = pattern.partition("=")
    return lowered(name).contains(value) if value else has_attr(name)


def _typed(prepared_nodes: DataFrame, scores: dict[str, Column], floor: float = R.MIN_TYPE_CONFIDENCE) -> DataFrame:
    """Type of the highest score, the earlier type of equals, none below ``floor``."""
    rows = prepared_nodes.withColumns({f"_s{i}": F.coalesce(c, F.lit(0.0)) for i, c in enumerate(scores.values())})
    best = F.greatest(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(-i).alias("turn"), F.lit(n).alias("type"))
                        for i, n in enumerate(scores)])
    rows = rows.withColumn("_best", best).drop(*[f"_s{i}" for i in range(len(scores))])
    kept = F.col("_best.score") >= floor
    return unprepared(rows.withColumns({
        "element_type": F.when(kept, F.col("_best.type")),
        "type_confidence": F.when(kept, F.col("_best.score"))}).drop("_best"))


def classify_max(nodes: DataFrame) -> DataFrame:
    """Type with the largest single weight: each type tests its signals from the strongest down."""
    scores = {}
    for name, signals in R.ELEMENT_PATTERNS.items():
        arms = F
        for kind, pattern, weight in sorted(signals, key=lambda x: -x[2]):
            arms = arms.when(_holds(kind, pattern), float(weight))
        scores[name] = arms
    return _typed(prepared(nodes), scores)


with_type = classify_max


def classify_noisy_or(nodes: DataFrame) -> DataFrame:
    """Type whose signals together are strongest, 1 - prod(1 - w), multiplied from the weakest signal up."""
    scores = {}
    for name, signals in R.ELEMENT_PATTERNS.items():
        rest = [F.when(_holds(kind, pattern), 1 - float(weight)).otherwise(1.0)
                for kind, pattern, weight in sorted(signals, key=lambda x: x[2])]
        scores[name] = 1 - reduce(lambda a, b: a * b, rest)
    return _typed(prepared(nodes), scores)


def _boosted(signals: list[Column]) -> Column:
    """Strongest signal plus 0.05 for each further one, at most 0.1 more and 0.99 in all."""
    n = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), 1).otherwise(0) for s in signals])
    top = F.greatest(*signals) if len(signals) > 1 else signals[0]
    return F.when(n > 0, F.least(top + F.least(0.05 * (n - 1), F.lit(0.1)), F.lit(0.99)))


def meaning_signal(meaning: str) -> Column:
    """Strength of the tag or role that carries the meaning."""
    tags, roles = R.SEMANTIC_TAGS.get(meaning, ([], []))
    return F.when(F.col("tag").isin(tags), 0.9).when(F.col("_role").isin(roles), 0.95) if tags else F.lit(None).cast("double")


def _says(phrase: str) -> Column:
    return any_of(F.col("_text_words").contains(text_word(w)) for w in intent_words(phrase))


def _given(name: str) -> Column:
    key, _, value = name.partition("=")
    return attr(key).contains(value) if value else attr(key) != ""


def classify_semantic(nodes: DataFrame) -> DataFrame:
    """Type by meaning, tag, class words, text words and attributes."""
    rows, scores = prepared(nodes), {}
    for turn, (name, (meanings, classes, words, tags, attributes)) in enumerate(R.SEMANTIC_PATTERNS.items()):
        signals = [meaning_signal(m) for m in meanings] + [class_strength(c) for c in classes]
        signals += [F.when(F.col("tag").isin(tags), 0.7)] if tags else []
        signals += [F.when(_says(w), 0.8) for w in words] + [F.when(_given(a), 0.9) for a in attributes]
        names = [f"_g{turn}_{i}" for i in range(len(signals))]
        rows = rows.withColumns(dict(zip(names, signals, strict=True)))
        scores[name] = _boosted([F.col(n) for n in names])
    typed = _typed(rows, scores)
    return typed.drop(*[c for c in typed.columns if c.startswith("_g")])


def _strengths(intent: str) -> dict[str, Column]:
    """Signals of an intent in a prepared node."""
    title = F.col("_title")
    labelled = any_of(F.col("_label").contains(w) | title.contains(w) for w in intent_words(intent))
    id_word = F.col("_id").rlike(bounded_pattern(intent))
    return {"meaning": meaning_signal(intent), "class": class_strength(intent), "id": F.when(F.col("_id").contains(intent) & id_word, 0.8),
            "label": F.when(labelled, 0.85), "text": F.when(_says(intent), 0.8), "behaviour": _behaviour(intent)}


def _strongest(signals: dict[str, Column]) -> dict[str, Column]:
    """Match type of the strongest signal, number of signals and their confidence."""
    meaning, cls = signals["meaning"], signals["class"]
    kinds = {"meaning": F.when(meaning == 0.95, "aria").otherwise("semantic"),
             "class": F.when(cls == 0.95, "exact").otherwise("word_boundary"),
             "id": F.lit("word_boundary"), "label": F.lit("aria"), "text": F.lit("text"), "behaviour": F.lit("behavioral")}
    top = F.greatest(*signals.values())
    match = F
    for n, kind in kinds.items():
        match = match.when(signals[n] == top, kind)
    found = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), 1).otherwise(0) for s in signals.values()])
    return {"match_type": match.otherwise("none"), "signals": found, "confidence": F.coalesce(_boosted(list(signals.values())), F.lit(0.0))}


def match_intents(nodes: DataFrame, intents: list[str]) -> DataFrame:
    """A row for each node and intent: how the element expresses it, as match type of the strongest signal, number of signals and
    confidence. A node is read and prepared once for all intents."""
    rows = prepared(nodes).withColumn("_title", F.lower(attr("title")))
    each = {intent: _strengths(intent) for intent in intents}
    rows = rows.withColumns({f"_i{i}_{n}": c for i, s in enumerate(each.values()) for n, c in s.items()})
    found = [F.struct(F.lit(intent).alias("intent"), *[c.alias(n) for n, c in _strongest({n: F.col(f"_i{i}_{n}") for n in s}).items()])
             for i, (intent, s) in enumerate(each.items())]
    return rows.select(*nodes.columns, F.explode(F.array(*found)).alias("_found")).select(*nodes.columns, "_found.*")


def match_intent(nodes: DataFrame, intent: str) -> DataFrame:
    """How an element expresses an intent: match type of the strongest signal and its confidence."""
    return match_intents(nodes, [intent]).drop("intent")


def _behaviour(intent: str) -> Column:
    if intent in ("button", "cta"):
        return F.when(has_attr("onclick"), 0.7).when(attr("type").isin("submit", "button"), 0.85)
    if intent in ("cart", "add_to_cart"):
        return F.when(attr("href").contains("cart") | attr("data-action").contains("cart"), 0.8)
    return F.lit(None).cast("double")


# ---------------------------------------------------------------- viewports

def to_viewport(boxes: DataFrame, viewport_height: int) -> DataFrame:
    """Box in viewport coordinates, whether it shows, and how much of its height does."""
    top = F.col("y") - F.col("scroll_y")
    bottom = top + F.col("h")
    shown = F.least(F.lit(viewport_height), bottom) - F.greatest(F.lit(0), top)
    visible = ~((bottom < 0) | (top > viewport_height))
    return boxes.withColumns({
        "screen_y": top, "is_shown": visible,
        "shown_ratio": F.when(visible & (F.col("h") > 0), N.clamp01(shown / F.col("h"))).otherwise(0.0)})


def visible_elements(boxes: DataFrame, viewport_height: int, least: float = 0.1) -> DataFrame:
    return to_viewport(boxes, viewport_height).filter(F.col("is_shown") & (F.col("shown_ratio") >= least))


def box_visible(boxes: DataFrame, viewport_height: int) -> DataFrame:
    """Stricter form: some pixel row lies inside the viewport."""
    top = F.col("y") - F.col("scroll_y")
    return boxes.filter((top + F.col("h") > 0) & (top < viewport_height))


def above_fold(viewport_height: int) -> Column:
    """False when there is no box."""
    return F.coalesce(F.col("y") < viewport_height, F.lit(False))


def top_per_type(elements: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """First ``limit`` elements per page and type. Spark cuts to the limit before the shuffle."""
    w = Window.partitionBy("page_id", "element_type").orderBy(*order)
    return elements.filter(F.col("element_type").isNotNull()).withColumn("place", F.row_number().over(w)).filter(
        F.col("place") <= limit)


def element_listing(elements: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """First elements per type for display, with the total of the type.

    The total comes from a separate aggregate: a window count would hold back the early cut.
    """
    totals = elements.groupBy("page_id", "element_type").agg(F.count("*").alias("total"))
    return top_per_type(elements, limit, order).join(totals, ["page_id", "element_type"])


def crop_region(boxes: DataFrame, category: str, width: int, height: int, padding: int = 50,
                most: float = 0.8, least: int = 100) -> DataFrame:
    """Region of a viewport that shows the elements of a category; none when it would be most of it."""
    relevant = boxes.filter(F.col("element_type").isin(R.CROP_TYPES[category]))
    box = relevant.groupBy("page_id", "viewport_index").agg(
        F.min("x").alias("x0"), F.min("screen_y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"),
        F.max(F.col("screen_y") + F.col("h")).alias("y1"))
    out = box.select(
        "page_id", "viewport_index", F.greatest(F.lit(0), F.col("x0") - padding).alias("x0"),
        F.greatest(F.lit(0), F.col("y0") - padding).alias("y0"), F.least(F.lit(width), F.col("x1") + padding).alias("x1"),
        F.least(F.lit(height), F.col("y1") + padding).alias("y1"))
    for start, end, size, limit in (("x0", "x1", "width", width), ("y0", "y1", "height", height)):
        span = F.col(end) - F.col(start)
        narrow = span < least
        begin = F.when(narrow, F.greatest(F.lit(0.0), F.col(start) + span / 2 - least / 2)).otherwise(F.col(start))
        out = out.withColumn("_span", span).withColumn("_begin", begin).withColumn(
            size, F.when(narrow, F.least(F.lit(least), limit - F.col("_begin"))).otherwise(F.col("_span"))).withColumn(
            start, F.col("_begin")).drop("_span", "_begin")
    kept = out.filter(F.col("width") * F.col("height") / (width * height) <= most)
    return kept.select("page_id", "viewport_index", *[
        N.half_up(F.col(c)).cast("bigint").alias(n) for c, n in (("x0", "x"), ("y0", "y"), ("width", "width"), ("height", "height"))])


def dedupe_boxes(boxes: DataFrame) -> DataFrame:
    """One row per element and rounded position: the most confident box, with the viewports it shows in.

    Viewports of a page are few, so the set stays small whatever the number of boxes.
    """
    typed = boxes.filter(F.col("element_type").isNotNull())
    best = typed.groupBy("page_id", "element_index", N.half_up(F.col("x")).alias("x"), N.half_up(F.col("y")).alias("y")).agg(
        F.min(F.struct((-F.col("confidence")).alias("down"), "seq", "element_type", "viewport_index", "w", "h")).alias("b"),
        F.array_sort(F.collect_set("viewport_index")).alias("viewports"))
    return best.select("page_id", "element_index", "x", "y", "b.element_type", (-F.col("b.down")).alias("confidence"),
                       "b.viewport_index", "b.w", "b.h", "viewports")


def together(boxes: DataFrame) -> DataFrame:
    """Typed boxes dealt by ranges of page, element and rounded position, for ``dedupe_boxes``: it needs no shuffle of its own then, and
    what is summed by page after it has a row for a page and task. A page of any size goes over several tasks."""
    return boxes.filter(F.col("element_type").isNotNull()).repartitionByRange(
        "page_id", "element_index", N.half_up(F.col("x")), N.half_up(F.col("y")))


def viewport_elements(deduped: DataFrame) -> DataFrame:
    """One row per viewport and element shown in it."""
    return deduped.select("page_id", F.explode("viewports").alias("viewport_index"), "element_index")


# ---------------------------------------------------------------- choosing

def score_interactive(elements: DataFrame, viewport_height: int) -> DataFrame:
    """How useful an element is to act on."""
    tag, role, kind = F.col("tag"), attr("role"), attr("type")
    href = attr("href")

    def plus(condition, points):
        return F.when(condition, points).otherwise(0)

    search = (role == "searchbox") | ((tag == "input") & kind.isin("text", "search") & (attr("placeholder") != ""))
    return elements.withColumn("score", (
        plus(F.coalesce(F.col("y").between(0, viewport_height), F.lit(False)), 10) + plus(F.col("in_main"), 8)
        + plus(F.length("text") > 3, 5) + plus((tag == "a") & (href != "") & ~href.startswith("javascript:"), 3)
        + plus(attr("aria-label") != "", 2) + plus(tag.isin("input", "textarea", "select"), 6) + plus(search, 15)
        - plus(F.col("region") == "header", 5)))


def cap_interactive(scored: DataFrame, most: int = 50, most_header: int = 10) -> DataFrame:
    """Best elements of a page: at most ``most_header`` from the header, ``most`` in all, numbered by score."""
    rows = scored.withColumn("is_header", F.col("region") == "header").withColumn("_down", -F.col("score"))
    per_side = Window.partitionBy("page_id", "is_header").orderBy("_down", "doc_pos")
    short = rows.withColumn("_rank", F.row_number().over(per_side)).filter(F.col("_rank") <= most)
    headers = Window.partitionBy("page_id")
    kept_headers = F.least(F.sum(F.col("is_header").cast("int")).over(headers), F.lit(most_header))
    room = F.when(F.col("is_header"), most_header).otherwise(F.greatest(F.lit(0), most - kept_headers))
    kept = short.withColumn("_room", room).filter(F.col("_rank") <= F.col("_room"))
    # Equal scores keep content before header, as they were put together.
    final = Window.partitionBy("page_id").orderBy("_down", "is_header", "doc_pos")
    return kept.withColumn("idx", F.row_number().over(final) - 1).drop("_rank", "_room", "_down", "is_header")


# ---------------------------------------------------------------- text forms

def node_line() -> Column:
    """[index] [type:confidence] <tag attributes>text</tag>, indented by depth."""
    shown = [F.when(attr(n) != "", F.concat(F.lit(f' {n}="'), attr(n), F.lit('"'))).otherwise("")
             for n in ("class", "id", "href", "type", "role")]
    opening = F.concat(F.lit("<"), F.col("tag"), *shown, F.lit(">"))
    body = F.when(F.col("text") != "", F.concat(opening, F.col("text"), F.lit("</"), F.col("tag"), F.lit(">"))).otherwise(opening)
    label = F.when(F.col("element_type").isNotNull(), F.format_string("[%s:%.2f]", "element_type", "type_confidence"))
    return F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), F.concat_ws(" ", F.format_string("[%d]", "idx"), label, body))


# Role that a tag carries by itself.
TAG_ROLES = {"a": "link", "button": "button", "nav": "navigation", "main": "main", "header": "banner",
             "footer": "contentinfo", "form": "form", "img": "img", "ul": "list", "ol": "list", "li": "listitem",
             "select": "combobox", "textarea": "textbox", "input": "textbox", "article": "article",
             "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}


def outline(nodes: DataFrame, states=("disabled", "checked", "required", "selected")) -> DataFrame:
    """Role-bearing nodes as indented lines; nodes without name and children are left out."""
    role = F.coalesce(F.nullif(F.lower(attr("role")), F.lit("")), map_value(F.col("tag"), TAG_ROLES))
    name = F.coalesce(F.nullif(attr("aria-label"), F.lit("")), F.col("text"))
    short = F.when(F.length(name) > 50, F.concat(F.substring(name, 1, 47), F.lit("..."))).otherwise(name)
    rows = nodes.withColumn("_role", role).filter(
        F.col("_role").isNotNull() & ~F.col("_role").isin("none", "presentation")
        & ((F.trim(name) != "") | (F.col("last_pos") > F.col("doc_pos"))))
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.concat(F.lit(" [level="), F.substring("tag", 2, 1), F.lit("]"))).otherwise("")
    marks = [F.when(has_attr(s), f" [{s}]").otherwise("") for s in states]
    quoted = F.when(F.trim(name) != "", F.concat(F.lit(' "'), short, F.lit('"'))).otherwise("")
    return rows.withColumn("line", F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), F.lit("- "), F.col("_role"),
                                            quoted, level, *marks)).drop("_role")
