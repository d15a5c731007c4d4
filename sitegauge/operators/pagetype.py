"""Typing pages and businesses from URL, elements and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.lookup import count_true, map_value
from ..functions.numbers import clamp01
from ..functions.replies import braced_part
from ..functions.selectors import any_selector, attr, has_attr, matches, prepared
from ..rules import pages as R


def _selector_flags(nodes: DataFrame, signals: dict) -> DataFrame:
    """Per page and type: how many distinct selectors some node matches."""
    flags = {f"{name}|{i}": matches(s) for name, (_, selectors, _) in signals.items()
             for i, s in enumerate(selectors) if s not in R.UNMATCHED_SELECTORS}
    seen = prepared(nodes).groupBy("page_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    counts = {name: [F.col(f"`{n}`") for n in flags if n.split("|")[0] == name] for name in signals}
    return seen.select("page_id", *[count_true([F.coalesce(c, F.lit(False)) for c in cols]).alias(f"sel_{n}")
                                    for n, cols in counts.items()])


def scored_signals(pages: DataFrame, nodes: DataFrame, signals: dict) -> DataFrame:
    """Pages with url_, sel_ and word_ hit counts per type. Each side of the join has one row per page."""
    rows = pages.join(_selector_flags(nodes, signals), "page_id", "left").withColumns({
        "_url": F.lower("url"), "_words": F.lower(F.concat_ws(" ", "url", "page_text"))})
    hits = {}
    for name, (urls, _, words) in signals.items():
        hits[f"url_{name}"] = count_true([F.col("_url").contains(u.lower()) for u in urls])
        hits[f"sel_{name}"] = F.coalesce(F.col(f"sel_{name}"), F.lit(0))
        hits[f"word_{name}"] = count_true([F.col("_words").contains(w) for w in words])
    return rows.withColumns(hits)


def _scored(pages: DataFrame, nodes: DataFrame, signals: dict, score) -> DataFrame:
    """Best (score, type) per page; the earlier type of equals."""
    scores = {n: score(F.col(f"url_{n}"), F.col(f"sel_{n}"), F.col(f"word_{n}"), len(u), len(s), len(w))
              for n, (u, s, w) in signals.items()}
    return scored_signals(pages, nodes, signals).withColumn("_best", F.greatest(*[
        F.struct(c.alias("score"), F.lit(-turn).alias("turn"), F.lit(n).alias("type")) for turn, (n, c) in enumerate(scores.items())]))


def page_type(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pages(page_id, url, page_text)`` to type and confidence: a root path is the home page, else the
    strongest of url, elements and keywords, 'other' when that is weak."""
    def score(url, selectors, words, *_):
        return (F.when(url > 0, R.PAGE_URL_POINTS).otherwise(0)
                + F.when(selectors >= 2, R.PAGE_ELEMENT_POINTS).when(selectors == 1, R.PAGE_ELEMENT_POINTS // 2).otherwise(0)
                + F.when(words >= 3, R.PAGE_KEYWORD_POINTS).when(words == 2, R.PAGE_KEYWORD_POINTS * 7 // 10)
                .when(words == 1, R.PAGE_KEYWORD_POINTS * 4 // 10).otherwise(0))

    rows = _scored(pages, nodes, R.PAGE_TYPE_SIGNALS, score)
    home, points = U.is_homepage(F.col("url")), F.col("_best.score")
    return rows.select(
        "page_id", F.when(home, "homepage").when(points >= R.PAGE_MIN_POINTS, F.col("_best.type")).otherwise("other").alias("page_type"),
        F.when(home, 0.9).otherwise(points / 10000).alias("confidence"))


def business_type(pages: DataFrame, nodes: DataFrame, least: float = R.BUSINESS_MIN_CONFIDENCE) -> DataFrame:
    """Business whose signals are matched by the largest weighted share, 'other' below ``least``."""
    def score(url, selectors, words, n_url, n_selectors, n_words):
        return (R.BUSINESS_URL_WEIGHT * url / n_url + R.BUSINESS_ELEMENT_WEIGHT * selectors / n_selectors
                + R.BUSINESS_KEYWORD_WEIGHT * words / n_words)

    rows = _scored(pages, nodes, R.BUSINESS_SIGNALS, score)
    return rows.select(
        "page_id", F.when((F.col("_best.score") >= least) & (F.col("_best.score") > 0), F.col("_best.type")).otherwise("other").alias("business_type"),
        F.round(F.col("_best.score"), 6).alias("confidence"))


# ---------------------------------------------------------------- purpose

PRICE = r"(?i)[$£€¥]\s*\d+([.,]\d{2})?|\d+([.,]\d{2})?\s*[$£€¥]|\d+([.,]\d{2})?\s*(USD|EUR|GBP|INR|JPY)"
PRICE_RANGE = r"[$£€]\s*\d+\s*[-–]\s*[$£€]?\s*\d+"


def page_signals(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flags and counts of a page's content, with its URL tags."""
    tag, text = F.col("tag"), F.lower("text")
    names = F.concat(F.col("_class"), F.lit(" "), F.col("_id"))

    def has(*selectors):
        return any_selector(selectors)

    button = (tag == "button") | ((tag == "a") & (F.col("_role") == "button")) | (
        (tag == "input") & (attr("type") == "submit")) | has('[class*="btn"]', '[class*="button"]')
    choice = (tag == "select") | (F.col("_role") == "listbox") | has('[class*="variant"]', '[class*="option"]', '[class*="swatch"]')
    picture = tag.isin("img", "picture")
    form = tag == "form"
    card = has('[class*="product-card"]', '[class*="product-item"]', '[class*="product-tile"]')
    flags = {
        "add_to_cart": button & (text.rlike(r"add\s*(to)?\s*(cart|bag|basket)") | names.contains("add-to-cart") | names.contains("addtocart")),
        "variants": choice & (text.rlike("size|color|colour|variant|option") | names.rlike("size|color|colour|variant|option|swatch")),
        "images": picture & (names.rlike("product|gallery|main-image|hero-image") | F.lower(attr("alt")).contains("product")
                             | F.lower(attr("src")).contains("product")),
        "title": (tag == "h1") & names.rlike("product|title|name"),
        "lead_form": form & (text.rlike(r"contact|get\s*(in)?\s*touch|request|demo|quote|inquiry|enquiry") | names.rlike("contact|lead|inquiry|demo")),
        "signup_form": form & (text.rlike(r"sign\s*up|register|create\s*account|join") | names.rlike("signup|register|join")
                               | F.lower(attr("action")).rlike("signup|register")),
        "checkout_form": form & (names.rlike("checkout|payment|billing|shipping")
                                 | text.rlike(r"credit\s*card|payment\s*method|billing\s*address")),
        "hero": has('[class*="hero"]', '[class*="banner"]', '[class*="jumbotron"]'),
        "pricing": has('[class*="pricing"]', '[class*="plans"]', '[class*="packages"]'),
        "cart_items": has('[class*="cart-item"]', '[class*="basket-item"]', '[class*="line-item"]'),
    }
    cta = button & text.rlike(r"buy|order|subscribe|sign\s*up|get\s*started|try|add\s*to|checkout|submit|register")
    sums = prepared(nodes).groupBy("page_id").agg(
        *[F.bool_or(c).alias(f"has_{n}") for n, c in flags.items()],
        F.count_if(card).alias("products"), F.count_if(form).alias("forms"), F.count_if(cta).alias("ctas"))
    rows = pages.join(sums, "page_id", "left")
    return rows.select(
        "page_id", F.concat_ws(",", U.url_signals(F.col("url"))).alias("url_signals"),
        F.coalesce(F.col("page_text").rlike(PRICE), F.lit(False)).alias("has_price"),
        F.coalesce(F.col("page_text").rlike(PRICE_RANGE), F.lit(False)).alias("has_price_range"),
        *[F.coalesce(f"has_{n}", F.lit(False)).alias(f"has_{n}") for n in flags],
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("products", "forms", "ctas")])


def _points(*pairs) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in pairs])


def page_purpose(signals: DataFrame) -> DataFrame:
    """Purpose with most points (the first of equals) and the goal it serves."""
    c = F.col

    def url(name):
        return F.array_contains(F.split("url_signals", ","), name)

    purposes = {
        "pdp": _points((c("has_add_to_cart"), 35), (c("has_price") & ~c("has_price_range"), 20), (c("has_title"), 15),
                       (c("has_images"), 15), (c("has_variants"), 15), (url("url_product_path"), 10), (c("products") <= 1, 5)),
        "plp": _points((c("products") > 2, 40), (c("products") > 3, 25), (c("has_price_range"), 15),
                       (url("url_category_path") | url("url_listing_params"), 15)),
        "homepage": _points((url("url_homepage"), 40), (c("has_hero") & ~c("has_lead_form") & ~c("has_add_to_cart"), 20)),
        "lead_gen": _points((c("has_lead_form"), 40), (c("has_hero") & (c("forms") == 1), 20), (url("url_landing_path"), 15)),
        "saas_landing": _points((c("has_pricing"), 35), (c("has_signup_form"), 25), (c("has_hero"), 15), (url("url_pricing_path"), 20)),
        "checkout": _points((c("has_checkout_form"), 50), (url("url_checkout_path"), 30)),
        "cart": _points((c("has_cart_items"), 50), (url("url_cart_path"), 30)),
    }
    best = F.greatest(*[F.struct(p.alias("points"), F.lit(-i).alias("turn"), F.lit(n).alias("purpose"))
                        for i, (n, p) in enumerate(purposes.items())])
    rows = signals.withColumn("_best", best)
    purpose = F.when(F.col("_best.points") > 0, F.col("_best.purpose")).otherwise("unknown")
    return rows.select("page_id", purpose.alias("purpose"),
                       F.least(F.col("_best.points") / 100, F.lit(1.0)).alias("confidence"),
                       map_value(purpose, R.PURPOSE_GOALS).alias("goal"))


# ---------------------------------------------------------------- product pages

Parts = tuple[dict[str, Column], dict[str, Column]]  # sums over a page's nodes, and what follows from them


def _summed(nodes: DataFrame, *parts: Parts) -> DataFrame:
    """One row per page, from one pass over the nodes."""
    sums = {n: c for p in parts for n, c in p[0].items()}
    rows = nodes.groupBy("page_id").agg(*[c.alias(n) for n, c in sums.items()])
    for _, derived in parts:
        rows = rows.withColumns(derived)
    return rows


def best_ctas(nodes: DataFrame) -> DataFrame:
    """The best purchase button of the pages that have one. Only buttons are grouped: what a page's best one holds is text, so
    Spark sorts the rows of this aggregate, and with all nodes and flags in it would sort these."""
    tag, name, id_ = F.col("tag"), F.lower(attr("name")), F.lower(attr("id"))
    test = F.lower(F.concat(attr("data-testid"), attr("data-test")))
    candidate = ((tag == "button") & (id_.contains("add") | id_.contains("cart") | test.contains("add") | name.contains("add")
                                      | (attr("type") == "submit"))) | ((tag == "input") & (attr("type") == "submit"))
    shown = F.trim(F.when(tag == "input", F.coalesce(F.nullif(attr("value"), F.lit("")), F.col("text"))).otherwise(F.col("text")))
    low = F.lower(shown)
    points = _points(*[(low.contains(w), 20 if len(w) >= 6 else 10)
                       for w in ("add to cart", "add to bag", "add to basket", "buy now", "add")])
    score = points + F.when(F.col("form_id").isNotNull(), 5).otherwise(0)
    buttons = nodes.filter(candidate & F.col("is_visible") & (shown != "")).select(
        "page_id", "doc_pos", shown.alias("cta_text"), score.alias("cta_score"), has_attr("disabled").alias("cta_disabled"))
    best = F.max_by(F.struct("cta_text", "cta_score", "cta_disabled"), F.struct("cta_score", -F.col("doc_pos")))
    plain = F.lower(F.regexp_replace("cta_text", r"\s+", " "))
    return buttons.groupBy("page_id").agg(best.alias("_cta")).select("page_id", "_cta.*").withColumns({
        "adds_to_cart": plain.rlike("add to (cart|bag|basket)") | (plain == "add"), "buys_now": plain.contains("buy now")})


def _variant_parts() -> Parts:
    name, id_, test = F.lower(attr("name")), F.lower(attr("id")), F.lower(attr("data-testid"))
    chooser = name.rlike("option|variant")
    select = (F.col("tag") == "select") & (chooser | id_.rlike("option|variant"))
    radio = (F.col("tag") == "input") & (attr("type") == "radio") & chooser
    swatch = F.lower(attr("class")).contains("swatch") | test.contains("swatch")
    return ({"selects": F.count_if(select), "radios": F.count_if(radio), "swatches": F.count_if(swatch)},
            {"has_variants": (F.col("selects") > 0) | (F.col("radios") > 3) | (F.col("swatches") > 0),
             "variant_count": F.col("selects") + F.col("radios")})


def _grid_parts() -> Parts:
    href, cls, test = F.lower(attr("href")), F.lower(attr("class")), F.lower(attr("data-testid"))
    link = (F.col("tag") == "a") & href.rlike("/product|/p/")
    filters = ((F.col("tag") == "select") & F.lower(attr("name")).contains("sort")) | cls.contains("filter") | test.contains(
        "filter") | F.lower(attr("aria-label")).contains("filter")
    card = has_attr("data-product-id") | test.contains("product") | cls.rlike("product-card|product-tile")
    return ({"product_links": F.count_if(link), "cards": F.count_if(card), "has_filters": F.bool_or(filters)},
            {"is_grid": ((F.col("product_links") >= 8) | (F.col("cards") >= 8)) & F.col("has_filters")})


def _cart_parts() -> Parts:
    text, cls, name = F.lower("text"), F.lower(attr("class")), F.lower(attr("name"))
    quantity = ((F.col("tag") == "input") & ((attr("type") == "number") | name.contains("quantity"))) | (
        (F.col("tag") == "select") & name.contains("quantity"))
    item = cls.contains("cart-item") | F.lower(attr("data-testid")).contains("cart-item")
    return ({"subtotal": F.bool_or(text.contains("subtotal")), "checkout": F.bool_or(text.contains("checkout")),
             "line_items": F.count_if(item), "quantities": F.count_if(quantity)},
            {"is_cart": (F.col("subtotal") & F.col("checkout")) | ((F.col("line_items") >= 2) & (F.col("quantities") >= 1))})


def _checkout_parts() -> Parts:
    text = F.lower("text")
    address = (F.col("tag") == "input") & (F.lower(attr("name")).contains("address") | F.lower(attr("id")).contains("address"))
    return ({"address": F.bool_or(address), "payment": F.bool_or(text.contains("payment")), "shipping": F.bool_or(text.contains("shipping"))},
            {"is_checkout": F.col("address") & (F.col("payment") | F.col("shipping"))})


def primary_cta(nodes: DataFrame) -> DataFrame:
    """Best purchase button per page: text points, plus 5 inside a form; the first in the page of equals."""
    return best_ctas(nodes)


def variant_signals(nodes: DataFrame) -> DataFrame:
    return _summed(nodes, _variant_parts())


def media_signals(nodes: DataFrame) -> DataFrame:
    """Distinct sources of images larger than 40x40 (all images where no box is known), at most 30."""
    large = F.coalesce((F.col("w") > 40) & (F.col("h") > 40), F.lit(True))
    sources = nodes.filter((F.col("tag") == "img") & large & (attr("src") != "")).select("page_id", attr("src").alias("src")).distinct()
    return sources.groupBy("page_id").agg(F.least(F.count("*"), F.lit(30)).alias("media")).withColumn("gallery", F.col("media") >= 3)


def grid_signals(nodes: DataFrame) -> DataFrame:
    return _summed(nodes, _grid_parts())


def cart_signals(nodes: DataFrame) -> DataFrame:
    return _summed(nodes, _cart_parts())


def checkout_signals(nodes: DataFrame) -> DataFrame:
    return _summed(nodes, _checkout_parts())


def product_signals(nodes: DataFrame) -> DataFrame:
    """All of the above per page: one pass over the nodes for counts and flags, one over their buttons and one over their images."""
    rows = _summed(nodes, _variant_parts(), _grid_parts(), _cart_parts(), _checkout_parts())
    for some in (best_ctas(nodes), media_signals(nodes)):
        rows = rows.join(some.hint("merge"), "page_id", "left")
    return rows


def product_score(facts: DataFrame) -> DataFrame:
    """Signed points for a product page, the confidence they give, and the type.

    ``facts`` has one row per page: adds_to_cart, buys_now, schema_product, price, has_variants, gallery,
    title, cta_disabled, is_grid, is_cart, is_checkout."""
    def yes(name):
        return F.coalesce(F.col(name), F.lit(False))

    points = _points((yes("adds_to_cart"), 30), (yes("buys_now"), 20), (yes("schema_product"), 25),
                     (F.col("price").isNotNull(), 15), (yes("has_variants"), 15), (yes("gallery"), 10),
                     (F.coalesce("title", F.lit("")) != "", 5), (yes("cta_disabled"), -5), (yes("is_grid"), -25),
                     (yes("is_cart"), -20), (yes("is_checkout"), -20))
    rows = facts.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), points)))
    confidence = F
    for floor, value in R.PRODUCT_SCORE_STEPS:
        confidence = confidence.when(F.col("score") >= floor, value)
    kind = (F.when(yes("is_cart"), "cart").when(yes("is_checkout"), "checkout")
            .when(yes("is_grid") & (F.col("score") < 40), "plp").when(F.col("score") >= 55, "pdp").otherwise("other"))
    return rows.withColumns({"confidence": confidence.otherwise(R.PRODUCT_SCORE_ELSE), "page_type": kind})


def homepage_override(scored: DataFrame) -> DataFrame:
    """A root path with few product points is the home page."""
    home = U.is_homepage(F.col("url")) & (F.col("score") < 30)
    return scored.withColumns({"page_type": F.when(home, "homepage").otherwise(F.col("page_type")),
                               "confidence": F.when(home, 0.85).otherwise(F.col("confidence"))})


def combine_page_type(a: tuple[Column, Column], b: tuple[Column, Column]) -> dict[str, Column]:
    """Verdict of the product detector ``a`` (type, confidence) and the rules ``b``.

    A sure first verdict stands; agreement blends with a bonus, else the stronger one stands at a loss.
    Below 0.6 the page is marked for review."""
    (ta, ca), (tb, cb) = a, b
    agreed = F.least(F.lit(1.0), ca * 0.7 + cb * 0.3 + 0.1)
    first = ca * 0.7 >= cb * 0.3
    blended_type = F.when((ta == tb) | first, ta).otherwise(tb)
    blended = F.when(ta == tb, agreed).when(first, F.greatest(F.lit(0.3), ca - 0.15)).otherwise(F.greatest(F.lit(0.3), cb - 0.15))
    sure = ca >= 0.7
    return {"page_type": F.when(sure, ta).otherwise(blended_type), "confidence": F.when(sure, ca).otherwise(blended),
            "tier": F.when(sure, "product").otherwise("combined"),
            "review": ~sure & (blended < 0.6)}


def type_from_reply(reply: Column) -> dict[str, Column]:
    """Type and confidence from a model's reply: its JSON, else the words it uses at 0.4."""
    json = braced_part(reply)
    given = F.try_parse_json(json)
    kind = F.lower(F.try_variant_get(given, "$.pageType", "string"))
    number = F.when(F.schema_of_variant(F.try_variant_get(given, "$.confidence", "variant")) != "STRING",
                    F.try_variant_get(given, "$.confidence", "double"))
    low = F.lower(reply)
    words = F
    for name, spoken in (("pdp", ["pdp", "product detail"]), ("plp", ["plp", "product listing"]), ("cart", ["cart", "basket"]),
                         ("checkout", ["checkout"]), ("homepage", ["homepage", "home page"]), ("account", ["account", "login"])):
        words = words.when(reduce(lambda a, b: a | b, [low.contains(w) for w in spoken]), name)
    return {"page_type": F.when(given.isNotNull(), F.when(kind.isin(R.PAGE_TYPES), kind).otherwise("other")).otherwise(words.otherwise("other")),
            "confidence": F.when(given.isNotNull(), F.when(number.isNull(), 0.5).otherwise(clamp01(number))).otherwise(0.4)}
