"""Consent banners and other noise, by selector rules over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import any_of, contains_any
from ..functions.selectors import any_selector, attr, prepared, unprepared
from ..rules import consent as R
from ..rules.pages import BLOCKERS


def detect_blocker(text: Column) -> Column:
    """Kind of the first blocker pattern that the text shows."""
    out = None
    for pattern, kind in BLOCKERS:
        arm = F.lower(text).rlike(pattern)
        out = F.when(arm, kind) if out is None else out.when(arm, kind)
    return out


def consent_platforms(nodes: DataFrame) -> DataFrame:
    """Most prevalent consent platform that a page shows."""
    rank = F
    for i, (_, selectors) in enumerate(R.CONSENT_PLATFORMS):
        rank = rank.when(any_selector(selectors), i)
    first = prepared(nodes).select("page_id", rank.alias("rank")).groupBy("page_id").agg(F.min("rank").alias("rank"))
    names = F.array(*[F.lit(n) for n, _ in R.CONSENT_PLATFORMS])
    return first.filter(F.col("rank").isNotNull()).select("page_id", F.get(names, F.col("rank")).alias("platform"))


def cookie_containers(nodes: DataFrame) -> DataFrame:
    return unprepared(prepared(nodes).filter(any_selector(R.COOKIE_CONTAINERS + R.COOKIE_BANNERS)))


def is_accept_button(text: Column) -> Column:
    low = F.lower(text)
    return contains_any(low, R.ACCEPT_WORDS) & ~contains_any(low, R.NOT_ACCEPT_WORDS)


def _noise_rules(extra: dict | None) -> dict:
    return {**R.NOISE_SELECTORS, **(extra or {})}


def ui_noise(nodes: DataFrame, extra: dict | None = None) -> DataFrame:
    """Nodes per page and noise family; ``extra`` adds families of one's own."""
    flags = [F.when(any_selector(s), n) for n, s in _noise_rules(extra).items()]
    rows = prepared(nodes).select("page_id", F.explode(F.array(*flags)).alias("family"))
    return rows.filter(F.col("family").isNotNull()).groupBy("page_id", "family").agg(F.count("*").alias("nodes"))


def without_noise(nodes: DataFrame, extra: dict | None = None) -> DataFrame:
    return unprepared(prepared(nodes).filter(~any_of(any_selector(s) for s in _noise_rules(extra).values())))


def image_signals(nodes: DataFrame) -> DataFrame:
    """Loading signs per page from markup: images without or with stand-in sources, spinners, skeletons,
    overlays and placeholder texts (the first five of which are kept)."""
    img = F.col("tag") == "img"
    src, later = attr("src"), F.coalesce(F.nullif(attr("data-src"), F.lit("")), attr("data-lazy-src"))
    blank = img & src.isin("", "about:blank")
    stand_in = img & ~blank & src.rlike(R.PLACEHOLDER_SOURCE)
    lazy = img & ~blank & ~stand_in & (later != "") & (later != src)
    waiting = any_selector(R.PLACEHOLDER_TEXT_HOLDERS) & F.trim("text").rlike(R.PLACEHOLDER_TEXT)

    def shown(selectors):
        return F.bool_or(F.col("is_visible") & any_selector(selectors))

    return prepared(nodes).groupBy("page_id").agg(
        F.count_if(img).alias("total_images"), F.count_if(blank).alias("blank_images"),
        F.count_if(stand_in).alias("placeholder_images"), F.count_if(lazy).alias("lazy_pending"),
        shown(R.SPINNERS).alias("spinner"), shown(R.SKELETONS).alias("skeleton"), shown(R.OVERLAYS).alias("overlay"),
        F.least(F.count_if(waiting), F.lit(5)).alias("text_placeholders"))


def blocking_overlay(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """A dialog or overlay covers more than half of the viewport each way."""
    covers = any_selector(R.BLOCKING_OVERLAYS) & ~F.lower(attr("style")).contains("display: none")
    return prepared(boxes.withColumn("text", F.lit(""))).groupBy("page_id").agg(F.bool_or(
        covers & (F.col("w") > width * 0.5) & (F.col("h") > height * 0.5)).alias("blocked"))
