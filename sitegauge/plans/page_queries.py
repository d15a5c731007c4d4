"""Queries that type pages and businesses, and the cache of those types."""

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import pagetype as P
from ..operators import sites as T
from ..rules import pages as R
from . import sqltext as Q
from .catalog import query
from .text_queries import DOMAIN_SQL, PATH_SQL, URL_SIGNAL_SQL

WORDS = "lower(concat_ws(' ', url, page_text))"


def hits(expr, words):
    return "(" + " + ".join(f"CASE WHEN contains({expr}, {Q.literal(w.lower())}) THEN 1 ELSE 0 END" for w in words) + ")"


def typed_sql(signals, score):
    """Score rows of every type, best first; selectors are counted per page over the nodes."""
    flags = ", ".join(
        "(" + " + ".join(f"CAST(bool_or({Q.selector(s)}) AS INT)" for s in sel if s not in R.UNMATCHED_SELECTORS) + f") AS sel_{n}"
        for n, (_, sel, _) in signals.items())
    arms = " UNION ALL ".join(
        f"SELECT page_id, url, {i} AS turn, '{n}' AS type, {score(hits('lower(url)', u), f'coalesce(sel_{n}, 0)', hits(WORDS, w), len(u), len(s), len(w))} AS score FROM j"
        for i, (n, (u, s, w)) in enumerate(signals.items()))
    return f"""
WITH f AS (SELECT page_id, {flags} FROM nodes GROUP BY page_id), j AS (SELECT * FROM urls LEFT JOIN f USING (page_id)),
s AS ({arms}),
b AS (SELECT page_id, any_value(url) AS url, arg_max(type, (score, -turn)) AS type, max(score) AS score FROM s GROUP BY page_id)"""


def page_score(u, s, w, *_):
    return (f"(CASE WHEN {u} > 0 THEN 4500 ELSE 0 END + CASE WHEN {s} >= 2 THEN 3500 WHEN {s} = 1 THEN 1750 ELSE 0 END + "
            f"CASE {w} WHEN 0 THEN 0 WHEN 1 THEN 800 WHEN 2 THEN 1400 ELSE 2000 END)")


HOME_SQL = f"({PATH_SQL.format('url')} IN {Q.in_list(R.HOME_PATHS)})"
PAGE_TYPE_SQL = typed_sql(R.PAGE_TYPE_SIGNALS, page_score) + f"""
SELECT page_id, CASE WHEN {HOME_SQL} THEN 'homepage' WHEN score >= 5000 THEN type ELSE 'other' END AS page_type,
 CASE WHEN {HOME_SQL} THEN 0.9 ELSE score / 10000 END AS confidence FROM b"""


@query("page_type", PAGE_TYPE_SQL, uses="urls nodes")
def page_type(t):
    return P.page_type(t.urls, t.nodes)


@query("page_type_rules", f"""
SELECT page_id, {hits('lower(url)', R.PAGE_TYPE_SIGNALS['pdp'][0])} AS url_hits, {hits(WORDS, R.PAGE_TYPE_SIGNALS['pdp'][2])} AS keyword_hits,
 coalesce(sel, 0) AS selector_hits FROM urls LEFT JOIN (SELECT page_id, {" + ".join(f"CAST(bool_or({Q.selector(s)}) AS INT)" for s in R.PAGE_TYPE_SIGNALS['pdp'][1])} AS sel
 FROM nodes GROUP BY page_id) f USING (page_id)""", uses="urls nodes")
def page_type_rules(t):
    """Signals of one type: which url parts, selectors and keywords of a product page hold."""
    signals = {"pdp": R.PAGE_TYPE_SIGNALS["pdp"]}
    rows = P.scored_signals(t.urls, t.nodes, signals)
    return rows.select("page_id", F.col("url_pdp").alias("url_hits"), F.col("word_pdp").alias("keyword_hits"),
                       F.col("sel_pdp").alias("selector_hits"))


def business_score(u, s, w, nu, ns, nw):
    return f"(0.4::DOUBLE * {u} / {nu} + 0.35::DOUBLE * {s} / {ns} + 0.25::DOUBLE * {w} / {nw})"


@query("business_type", typed_sql(R.BUSINESS_SIGNALS, business_score) + """
SELECT page_id, CASE WHEN score >= 0.2 AND score > 0 THEN type ELSE 'other' END AS business_type, round(score, 6) AS confidence FROM b""", uses="urls nodes")
def business_type(t):
    """With 0.2 in place of 0.6, which the shares of the derived pages do not reach."""
    return P.business_type(t.urls, t.nodes, 0.2)


NAMES = "lower(class_attr || ' ' || id_attr)"
BUTTON = "(tag = 'button' OR (tag = 'a' AND role_attr = 'button') OR (tag = 'input' AND type_attr = 'submit') OR contains(lower(class_attr), 'btn') OR contains(lower(class_attr), 'button'))"
CHOICE = "(tag = 'select' OR role_attr = 'listbox' OR regexp_matches(lower(class_attr), 'variant|option|swatch'))"
CONTENT = {
    "add_to_cart": f"{BUTTON} AND (regexp_matches(lower(text), 'add\\s*(to)?\\s*(cart|bag|basket)') OR regexp_matches({NAMES}, 'add-to-cart|addtocart'))",
    "variants": f"{CHOICE} AND (regexp_matches(lower(text), 'size|color|colour|variant|option') OR regexp_matches({NAMES}, 'size|color|colour|variant|option|swatch'))",
    "images": f"tag = 'img' AND (regexp_matches({NAMES}, 'product|gallery|main-image|hero-image') OR contains(lower(src_attr), 'product'))",
    "title": f"tag = 'h1' AND regexp_matches({NAMES}, 'product|title|name')",
    "lead_form": f"tag = 'form' AND (regexp_matches(lower(text), 'contact|get\\s*(in)?\\s*touch|request|demo|quote|inquiry|enquiry') OR regexp_matches({NAMES}, 'contact|lead|inquiry|demo'))",
    "signup_form": f"tag = 'form' AND (regexp_matches(lower(text), 'sign\\s*up|register|create\\s*account|join') OR regexp_matches({NAMES}, 'signup|register|join'))",
    "checkout_form": f"tag = 'form' AND (regexp_matches({NAMES}, 'checkout|payment|billing|shipping') OR regexp_matches(lower(text), 'credit\\s*card|payment\\s*method|billing\\s*address'))",
    "hero": "regexp_matches(lower(class_attr), 'hero|banner|jumbotron')",
    "pricing": "regexp_matches(lower(class_attr), 'pricing|plans|packages')",
    "cart_items": "regexp_matches(lower(class_attr), 'cart-item|basket-item|line-item')",
}
PRICE_RE = "(?i)[$£€¥]\\s*\\d+([.,]\\d{2})?|\\d+([.,]\\d{2})?\\s*[$£€¥]|\\d+([.,]\\d{2})?\\s*(USD|EUR|GBP|INR|JPY)"
SIGNALS_SQL = f"""
WITH c AS (SELECT page_id, {", ".join(f"bool_or({v}) AS has_{k}" for k, v in CONTENT.items())},
 count_if(regexp_matches(lower(class_attr), 'product-card|product-item|product-tile')) AS products, count_if(tag = 'form') AS forms,
 count_if({BUTTON} AND regexp_matches(lower(text), 'buy|order|subscribe|sign\\s*up|get\\s*started|try|add\\s*to|checkout|submit|register')) AS ctas
 FROM nodes GROUP BY page_id),
sig AS (SELECT page_id, {URL_SIGNAL_SQL} AS url_signals, regexp_matches(page_text, '{PRICE_RE}') AS has_price, regexp_matches(page_text, '[$£€]\\s*\\d+\\s*[-–]\\s*[$£€]?\\s*\\d+') AS has_price_range,
 {", ".join(f"coalesce(has_{k}, FALSE) AS has_{k}" for k in CONTENT)}, {", ".join(f"coalesce({k}, 0) AS {k}" for k in ("products", "forms", "ctas"))}
 FROM urls LEFT JOIN c USING (page_id))
"""


@query("page_signals", SIGNALS_SQL + "SELECT * FROM sig", uses="urls nodes")
def page_signals(t):
    return P.page_signals(t.urls, t.nodes)


def url_tag(n):
    return f"list_contains(string_split(url_signals, ','), '{n}')"


def points(*pairs):
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in pairs)


PURPOSES = {
    "pdp": points(("has_add_to_cart", 35), ("has_price AND NOT has_price_range", 20), ("has_title", 15), ("has_images", 15), ("has_variants", 15), (url_tag("url_product_path"), 10), ("products <= 1", 5)),
    "plp": points(("products > 2", 40), ("products > 3", 25), ("has_price_range", 15), (f"{url_tag('url_category_path')} OR {url_tag('url_listing_params')}", 15)),
    "homepage": points((url_tag("url_homepage"), 40), ("has_hero AND NOT has_lead_form AND NOT has_add_to_cart", 20)),
    "lead_gen": points(("has_lead_form", 40), ("has_hero AND forms = 1", 20), (url_tag("url_landing_path"), 15)),
    "saas_landing": points(("has_pricing", 35), ("has_signup_form", 25), ("has_hero", 15), (url_tag("url_pricing_path"), 20)),
    "checkout": points(("has_checkout_form", 50), (url_tag("url_checkout_path"), 30)),
    "cart": points(("has_cart_items", 50), (url_tag("url_cart_path"), 30)),
}
PURPOSE_SQL = SIGNALS_SQL + ", pp AS (" + " UNION ALL ".join(
    f"SELECT page_id, {i} AS turn, '{n}' AS purpose, {e} AS points FROM sig" for i, (n, e) in enumerate(PURPOSES.items())) + """),
pb AS (SELECT page_id, arg_max(purpose, (points, -turn)) AS purpose, max(points) AS points FROM pp GROUP BY page_id)
"""


@query("page_purpose", PURPOSE_SQL + "SELECT page_id, CASE WHEN points > 0 THEN purpose ELSE 'unknown' END AS purpose, least(points / 100, 1.0) AS confidence FROM pb", uses="urls nodes")
def page_purpose(t):
    return P.page_purpose(P.page_signals(t.urls, t.nodes)).drop("goal")


@query("business_goal", PURPOSE_SQL + f"SELECT {Q.case('(CASE WHEN points > 0 THEN purpose END)', R.PURPOSE_GOALS, 'unknown')} AS goal, count(*) AS pages FROM pb GROUP BY 1", uses="urls nodes")
def business_goal(t):
    return P.page_purpose(P.page_signals(t.urls, t.nodes)).groupBy("goal").agg(F.count("*").alias("pages"))


# ---------------------------------------------------------------- product pages

CTA_SQL = """SELECT page_id, doc_pos, trim(text) AS cta_text, 5 + CASE WHEN contains(lower(text), 'add to cart') THEN 20 ELSE 0 END + CASE WHEN contains(lower(text), 'add to bag') THEN 20 ELSE 0 END
 + CASE WHEN contains(lower(text), 'add to basket') THEN 20 ELSE 0 END + CASE WHEN contains(lower(text), 'buy now') THEN 20 ELSE 0 END + CASE WHEN contains(lower(text), 'add') THEN 10 ELSE 0 END AS cta_score
FROM nodes WHERE is_visible AND trim(text) <> '' AND ((tag = 'button' AND (regexp_matches(id_attr, 'add|cart') OR contains(name_attr, 'add') OR type_attr = 'submit')) OR (tag = 'input' AND type_attr = 'submit'))"""
PLAIN = "lower(regexp_replace(cta_text, '\\s+', ' ', 'g'))"
BEST_CTA_SQL = f"""SELECT page_id, cta_text, cta_score, regexp_matches({PLAIN}, 'add to (cart|bag|basket)') OR {PLAIN} = 'add' AS adds_to_cart, contains({PLAIN}, 'buy now') AS buys_now
FROM (SELECT page_id, arg_max(cta_text, (cta_score, -doc_pos)) AS cta_text, max(cta_score) AS cta_score FROM ({CTA_SQL}) c GROUP BY page_id) b"""


@query("primary_cta", BEST_CTA_SQL, uses="nodes")
def primary_cta(t):
    return P.primary_cta(t.nodes).drop("cta_disabled")


VARIANT_SQL = """SELECT *, selects > 0 OR radios > 3 OR swatches > 0 AS has_variants, selects + radios AS variant_count FROM (SELECT page_id, count_if(tag = 'select' AND (regexp_matches(name_attr, 'option|variant') OR regexp_matches(id_attr, 'option|variant'))) AS selects,
 count_if(tag = 'input' AND type_attr = 'radio' AND regexp_matches(name_attr, 'option|variant')) AS radios, count_if(contains(lower(class_attr), 'swatch')) AS swatches FROM nodes GROUP BY page_id) v"""


@query("variant_signals", VARIANT_SQL, uses="nodes")
def variant_signals(t):
    return P.variant_signals(t.nodes)


MEDIA_SQL = "SELECT page_id, least(count(DISTINCT src_attr), 30) AS media, least(count(DISTINCT src_attr), 30) >= 3 AS gallery FROM nodes WHERE tag = 'img' AND w > 40 AND h > 40 AND src_attr <> '' GROUP BY page_id"


@query("media_signals", MEDIA_SQL, uses="nodes")
def media_signals(t):
    return P.media_signals(t.nodes)


GRID_SQL = """SELECT *, (product_links >= 8 OR cards >= 8) AND has_filters AS is_grid FROM (SELECT page_id, count_if(tag = 'a' AND contains(href_attr, '/product')) AS product_links,
 count_if(contains(class_attr, 'product-card')) AS cards, bool_or(contains(class_attr, 'filter') OR contains(lower(label_attr), 'filter')) AS has_filters FROM nodes GROUP BY page_id) g"""


@query("grid_signals", GRID_SQL, uses="nodes")
def grid_signals(t):
    return P.grid_signals(t.nodes)


CART_SQL = """SELECT *, (subtotal AND checkout) OR (line_items >= 2 AND quantities >= 1) AS is_cart FROM (SELECT page_id, bool_or(contains(lower(text), 'subtotal')) AS subtotal, bool_or(contains(lower(text), 'checkout')) AS checkout,
 count_if(contains(class_attr, 'cart-item')) AS line_items, count_if(tag IN ('input', 'select') AND name_attr = 'quantity') AS quantities FROM nodes GROUP BY page_id) c"""


@query("cart_signals", CART_SQL, uses="nodes")
def cart_signals(t):
    return P.cart_signals(t.nodes)


CHECKOUT_SQL = """SELECT *, address AND (payment OR shipping) AS is_checkout FROM (SELECT page_id, bool_or(tag = 'input' AND name_attr = 'address') AS address,
 bool_or(contains(lower(text), 'payment')) AS payment, bool_or(contains(lower(text), 'shipping')) AS shipping FROM nodes GROUP BY page_id) c"""


@query("checkout_signals", CHECKOUT_SQL, uses="nodes")
def checkout_signals(t):
    return P.checkout_signals(t.nodes)


FACTS_SQL = f"""WITH pc AS ({BEST_CTA_SQL}), pv AS ({VARIANT_SQL}), pm AS ({MEDIA_SQL}), pg AS ({GRID_SQL}), pk AS ({CART_SQL}), po AS ({CHECKOUT_SQL}),
facts AS (SELECT u.page_id, u.url, u.page_text AS title, CASE WHEN u.page_id % 3 = 0 THEN 10 END AS price, u.page_id % 4 = 0 AS schema_product, coalesce(adds_to_cart, FALSE) AS adds_to_cart, coalesce(buys_now, FALSE) AS buys_now,
 coalesce(has_variants, FALSE) AS has_variants, coalesce(gallery, FALSE) AS gallery, coalesce(is_grid, FALSE) AS is_grid, coalesce(is_cart, FALSE) AS is_cart, coalesce(is_checkout, FALSE) AS is_checkout
 FROM urls u LEFT JOIN pc USING (page_id) LEFT JOIN pv USING (page_id) LEFT JOIN pm USING (page_id) LEFT JOIN pg USING (page_id) LEFT JOIN pk USING (page_id) LEFT JOIN po USING (page_id)),
sc AS (SELECT *, greatest(0, least(100, {points(("adds_to_cart", 30), ("buys_now", 20), ("schema_product", 25), ("price IS NOT NULL", 15), ("has_variants", 15), ("gallery", 10), ("title <> ''", 5), ("is_grid", -25), ("is_cart", -20), ("is_checkout", -20))})) AS score FROM facts),
pdp AS (SELECT page_id, url, score, CASE WHEN score >= 80 THEN 0.95 WHEN score >= 70 THEN 0.9 WHEN score >= 55 THEN 0.8 WHEN score >= 40 THEN 0.65 WHEN score >= 30 THEN 0.55 ELSE 0.4 END AS confidence,
 CASE WHEN is_cart THEN 'cart' WHEN is_checkout THEN 'checkout' WHEN is_grid AND score < 40 THEN 'plp' WHEN score >= 55 THEN 'pdp' ELSE 'other' END AS page_type FROM sc),
ovr AS (SELECT page_id, CASE WHEN {HOME_SQL} AND score < 30 THEN 'homepage' ELSE page_type END AS page_type, CASE WHEN {HOME_SQL} AND score < 30 THEN 0.85 ELSE confidence END AS confidence FROM pdp)
"""


def product_facts(t):
    """One row per page. The signals are already aggregated to pages, so the join cannot skew."""
    rows = t.urls.select("page_id", "url", F.col("page_text").alias("title"),
                         F.when(F.col("page_id") % 3 == 0, 10).alias("price"), (F.col("page_id") % 4 == 0).alias("schema_product"))
    return rows.join(P.product_signals(t.nodes), "page_id", "left")


@query("pdp_score", FACTS_SQL + "SELECT page_id, score, page_type, confidence FROM pdp", uses="urls nodes")
def pdp_score(t):
    return P.product_score(product_facts(t)).select("page_id", "score", "page_type", "confidence")


@query("homepage_override", FACTS_SQL + "SELECT * FROM ovr", uses="urls nodes")
def homepage_override(t):
    return P.homepage_override(P.product_score(product_facts(t))).select("page_id", "page_type", "confidence")


@query("combine_page_type", f"""
WITH a AS ({FACTS_SQL} SELECT page_id, page_type AS ta, CAST(confidence AS DOUBLE) AS ca FROM pdp),
b AS (SELECT page_id, page_type AS tb, CAST(confidence AS DOUBLE) AS cb FROM ({PAGE_TYPE_SQL}) x),
m AS (SELECT *, ca * 0.7::DOUBLE >= cb * 0.3::DOUBLE AS f FROM a JOIN b USING (page_id)),
c AS (SELECT *, CASE WHEN ta = tb THEN least(1.0::DOUBLE, ca * 0.7::DOUBLE + cb * 0.3::DOUBLE + 0.1::DOUBLE) WHEN f THEN greatest(0.3::DOUBLE, ca - 0.15::DOUBLE) ELSE greatest(0.3::DOUBLE, cb - 0.15::DOUBLE) END AS bl FROM m)
SELECT page_id, CASE WHEN ca >= 0.7::DOUBLE OR ta = tb OR f THEN ta ELSE tb END AS page_type, CASE WHEN ca >= 0.7::DOUBLE THEN ca ELSE bl END AS confidence,
 CASE WHEN ca >= 0.7::DOUBLE THEN 'product' ELSE 'combined' END AS tier, ca < 0.7::DOUBLE AND bl < 0.6::DOUBLE AS review FROM c""", uses="urls nodes")
def combine_page_type(t):
    """The product detector's verdict on each page together with that of the rules."""
    product = P.product_score(product_facts(t)).select("page_id", F.col("page_type").alias("ta"), F.col("confidence").alias("ca"))
    rules = P.page_type(t.urls, t.nodes).select("page_id", F.col("page_type").alias("tb"), F.col("confidence").alias("cb"))
    out = P.combine_page_type((F.col("ta"), F.col("ca")), (F.col("tb"), F.col("cb")))
    return product.join(rules, "page_id").select("page_id", *[c.alias(n) for n, c in out.items()])


JSON_SQL = "nullif(regexp_extract(response, '(?s)(\\{.*\\})', 1), '')"


@query("page_type_from_text", f"""
SELECT event_id, CASE WHEN json_valid(j) THEN CASE WHEN lower(json_extract_string(j, '$.pageType')) IN {Q.in_list(R.PAGE_TYPES)} THEN lower(json_extract_string(j, '$.pageType')) ELSE 'other' END
 WHEN contains(l, 'pdp') OR contains(l, 'product detail') THEN 'pdp' WHEN contains(l, 'plp') OR contains(l, 'product listing') THEN 'plp' WHEN contains(l, 'cart') OR contains(l, 'basket') THEN 'cart'
 WHEN contains(l, 'checkout') THEN 'checkout' WHEN contains(l, 'homepage') OR contains(l, 'home page') THEN 'homepage' WHEN contains(l, 'account') OR contains(l, 'login') THEN 'account' ELSE 'other' END AS page_type,
 CASE WHEN json_valid(j) THEN coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN json_extract(j, '$.confidence') IS NOT NULL THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) ELSE 0.5 END)), 0.5) ELSE 0.4 END AS confidence
FROM (SELECT event_id, {JSON_SQL} AS j, lower(response) AS l FROM step_replies) r""", uses="step_replies")
def page_type_from_text(t):
    out = P.type_from_reply(F.col("response"))
    return t.step_replies.select("event_id", *[c.alias(n) for n, c in out.items()])


@query("type_accuracy", PAGE_TYPE_SQL.replace("\nSELECT page_id,", ",\nfound AS (SELECT page_id,", 1) + """),
e AS (SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'homepage' WHEN 1 THEN 'pdp' WHEN 2 THEN 'plp' WHEN 3 THEN 'cart' WHEN 4 THEN 'checkout' WHEN 5 THEN 'account' WHEN 11 THEN 'homepage' ELSE 'other' END AS expected FROM urls)
SELECT expected, count(*) AS pages, count_if(page_type = expected) AS correct, count_if(page_type = expected) * 10 >= count(*) * 9 AS meets FROM found JOIN e USING (page_id) GROUP BY 1""", uses="urls nodes")
def type_accuracy(t):
    """Typed pages against the type their URL was made for, and whether 90% are right."""
    k = F.col("page_id") % 12
    expected = F
    for i, name in ((0, "homepage"), (1, "pdp"), (2, "plp"), (3, "cart"), (4, "checkout"), (5, "account"), (11, "homepage")):
        expected = expected.when(k == i, name)
    rows = P.page_type(t.urls, t.nodes).withColumn("expected", expected.otherwise("other"))
    right = F.count_if(F.col("page_type") == F.col("expected"))
    return rows.groupBy("expected").agg(F.count("*").alias("pages"), right.alias("correct"),
                                        (right * 10 >= F.count("*") * 9).alias("meets"))


# ---------------------------------------------------------------- site cache

@query("cache_lookup", f"""
WITH v AS (SELECT {DOMAIN_SQL.format('url')} AS domain, ts, event_id, tool_name = 'go_to_url' AS stores, k % 7 AS result FROM actions WHERE url LIKE 'http%'),
a AS (SELECT *, last_value(CASE WHEN stores THEN {{'ts': ts, 'r': result}} END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM v)
SELECT event_id, domain, CASE WHEN c IS NOT NULL AND epoch_us(ts) - epoch_us(c.ts) <= 1800000000 THEN c.r END AS cached FROM a""", uses="actions")
def cache_lookup(t):
    return T.cache_lookup(T.visit_log(t.actions)).select("event_id", "domain", "cached")


@query("cache_replay", f"""
WITH RECURSIVE d AS (SELECT DISTINCT {DOMAIN_SQL.format('url')} AS domain, epoch(date_trunc('day', seen_at)) AS s FROM urls),
m(domain, s) AS (SELECT domain, min(s) FROM d GROUP BY domain UNION ALL SELECT m.domain, (SELECT min(d.s) FROM d WHERE d.domain = m.domain AND d.s > m.s + 259200) FROM m WHERE m.s IS NOT NULL)
SELECT u.page_id, (m.s IS NULL) AS hit FROM (SELECT page_id, {DOMAIN_SQL.format('url')} AS domain, epoch(date_trunc('day', seen_at)) AS s, row_number() OVER (PARTITION BY {DOMAIN_SQL.format('url')}, epoch(date_trunc('day', seen_at)) ORDER BY page_id) AS n FROM urls) u
LEFT JOIN m ON m.domain = u.domain AND m.s = u.s AND u.n = 1""", uses="urls")
def cache_replay(t):
    """Three days to live, because the derived visits are dated by day."""
    visits = t.urls.select("page_id", U.domain_of(F.col("url")).alias("domain"),
                           F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', seen_at)").alias("second"))
    return T.cache_replay(visits, "page_id", 259200).select("page_id", "hit")


@query("domain_stats", f"""
WITH v AS (SELECT {DOMAIN_SQL.format('url')} AS domain, CASE WHEN {PATH_SQL.format('url')} = '' THEN '/' ELSE {PATH_SQL.format('url')} END AS path, event_id FROM actions WHERE url LIKE 'http%'),
p AS (SELECT domain, path, min(event_id) AS first FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY first DESC) AS n FROM p)
SELECT s.domain, s.size, s.oldest, s.newest, string_agg(r.path, ' ' ORDER BY r.first) AS patterns
FROM (SELECT domain, count(*) AS size, min(event_id) AS oldest, max(event_id) AS newest FROM v GROUP BY domain) s JOIN r ON r.domain = s.domain AND r.n <= 10 GROUP BY ALL""", uses="actions")
def domain_stats(t):
    return T.domain_stats(T.visit_log(t.actions))
