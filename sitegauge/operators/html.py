"""Facts read from raw HTML and from parsed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.selectors import attr
from ..functions.text import squeeze
from ..plans import chunks
from ..rules.elements import KEPT_ATTRIBUTES, MAX_TEXT, SKIP_TAGS

PENDING = "navigation-pending"


def unescape(text: Column) -> Column:
    """The five entities that markup itself needs."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def inner_text(html: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def page_title(html: Column) -> Column:
    return F.nullif(inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def first_heading(html: Column) -> Column:
    """First h1 text, else the og:title."""
    h1 = F.nullif(inner_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))
    return F.coalesce(h1, meta_content(html, "og:title"))


def meta_content(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(
        html, rf'(?is)<meta[^>]*property="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))


def without_skipped(html: Column) -> Column:
    """Markup without comments and the subtrees that are never read."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "noscript", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return F.regexp_replace(out, rf"(?i)</?({'|'.join(SKIP_TAGS)})\b[^>]*>", " ")


def body_text(html: Column) -> Column:
    """Visible text of main, or of the whole body."""
    bare = without_skipped(F.regexp_replace(html, r"(?is)<head\b.*?</head>", ""))
    main = F.nullif(F.regexp_extract(bare, r"(?is)<main\b[^>]*>(.*?)</main>", 1), F.lit(""))
    return inner_text(F.coalesce(main, bare))


def text_excerpt(text: Column, limit: int) -> Column:
    """First ``limit`` characters, with a note when that is not all."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(
        F.substring(text, 1, limit), F.format_string(f"\n[...truncated, showing first {limit} of %d chars]", F.length(text))))


def dom_hash(html: Column) -> Column:
    return F.when(F.coalesce(html, F.lit("")) == "", PENDING).otherwise(F.substring(F.sha2(html, 256), 1, 16))


def html_links(pages: DataFrame) -> DataFrame:
    """Anchors in page order."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b([^>]*>.*?)</a>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(anchors).alias("pos", "anchor"))
    return rows.select(
        "page_id", "pos", F.regexp_extract("anchor", r'(?is)^[^>]*href="([^"]*)"', 1).alias("href"),
        inner_text(F.regexp_replace("anchor", r"(?s)^[^>]*>", "")).alias("text"))


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("page_id").agg(
        F.count("*").alias("nodes"), F.count_if("is_interactive").alias("interactive"))


def kept_attributes() -> Column:
    """The attributes a report shows, each cut to 100 characters."""
    return F.transform_values(
        F.map_filter("attrs", lambda k, v: k.isin(KEPT_ATTRIBUTES) & (v != "")),
        lambda k, v: F.when(F.length(v) > MAX_TEXT, F.concat(F.substring(v, 1, MAX_TEXT), F.lit("..."))).otherwise(v))


def element_index(elements: DataFrame, chunk: Column) -> DataFrame:
    """0-based document-order index over visible nodes that are typed or take input."""
    shown = elements.filter(F.col("is_visible") & (F.col("element_type").isNotNull() | F.col("is_interactive")))
    return chunks.row_index(shown, ["page_id"], ["doc_pos"], [chunk], "_n").withColumn(
        "idx", F.col("_n") - 1).drop("_n")


def main_interval(nodes: DataFrame) -> DataFrame:
    """Per page: the main landmark, else the div with most descendants (the first of equals)."""
    landmark = (F.col("tag") == "main") | (attr("role") == "main")
    size = F.col("last_pos") - F.col("doc_pos")
    area = F.struct("doc_pos", "last_pos")
    return nodes.groupBy("page_id").agg(
        F.min_by(area, F.when(landmark, F.col("doc_pos"))).alias("landmark"),
        F.max_by(area, F.when((F.col("tag") == "div") & (size > 0), F.struct(size, -F.col("doc_pos")))).alias("div"),
    ).select("page_id", F.col("landmark").isNotNull().alias("has_main"), F.coalesce("landmark", "div").alias("main"))


def content_regions(nodes: DataFrame) -> DataFrame:
    """header / footer by ancestor, else main when inside the main part, else unknown.

    A page is parsed from one cell, so its nodes are bounded by that cell and the join on page is even.
    """
    rows = nodes.join(main_interval(nodes), "page_id", "left")
    inside = F.coalesce(F.col("doc_pos").between(F.col("main.doc_pos"), F.col("main.last_pos")), F.lit(False))
    return rows.withColumn("in_main", inside).withColumn(
        "region", F.when((F.col("region") == "unknown") & inside, "main").otherwise(F.col("region"))).drop("main")


def is_collected() -> Column:
    """Elements an agent may act on."""
    return (F.col("tag").isin("a", "button", "input", "select", "textarea")
            | attr("role").isin("button", "link") | F.map_contains_key("attrs", "contenteditable"))


def region_summary(nodes: DataFrame) -> DataFrame:
    """Links, buttons and header elements per page; one row per page that has nodes."""
    hit = is_collected()
    main = hit & (F.col("region") == "main")
    return nodes.groupBy("page_id").agg(
        F.bool_or((F.col("tag") == "main") | (attr("role") == "main")).alias("has_main"),
        F.count_if(main & (F.col("tag") == "a")).alias("main_links"),
        F.count_if(main & ((F.col("tag") == "button") | (attr("role") == "button"))).alias("main_buttons"),
        F.count_if(hit & (F.col("region") == "header")).alias("header_elements"),
        F.count_if(hit).alias("total"))


def meta_price(html: Column) -> Column:
    return N.first_price(F.coalesce(meta_content(html, "product:price:amount"), meta_content(html, "og:price:amount")))


def meta_currency(html: Column) -> Column:
    return F.coalesce(meta_content(html, "product:price:currency"), meta_content(html, "og:price:currency"))
