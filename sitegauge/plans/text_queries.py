"""Queries for string, URL and number functions."""

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as S
from ..functions import urls as U
from ..functions.lookup import map_value
from ..functions.selectors import attr, has_class_word, prepared
from ..rules import insights as I
from ..rules import pages as P
from ..rules.elements import INTENT_WORDS, SEMANTIC_PATTERNS
from ..rules.heuristics import heuristic_rows
from . import sqltext as Q
from .catalog import query

# ---------------------------------------------------------------- strings

SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("normalize_text", f"SELECT conv_id, turn, lower({SQUEEZED.format('text')}) AS clean FROM conversations")
def normalize_text(t):
    return t.conversations.select("conv_id", "turn", S.normalize_text(F.col("text")).alias("clean"))


@query("truncate_text", f"""
SELECT conv_id, turn, CASE WHEN length(c) <= 40 THEN c ELSE substr(c, 1, 37) || '...' END AS short
FROM (SELECT conv_id, turn, {SQUEEZED.format('text')} AS c FROM conversations) x""")
def truncate_text(t):
    return t.conversations.select("conv_id", "turn", S.truncate_text(F.col("text"), 40).alias("short"))


@query("count_words", f"""
SELECT doc_id, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS words
FROM (SELECT doc_id, {SQUEEZED.format('text')} AS c FROM documents) x""")
def count_words(t):
    return t.documents.select("doc_id", S.count_words(F.col("text")).alias("words"))


TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all(replace({0}, '_', ' '), '\\w+|\\W+'), "
             "lambda w: CASE WHEN regexp_matches(w, '^\\w') THEN concat(upper(w[1]), w[2:]) ELSE w END), '')")


@query("title_case", f"SELECT seq, {TITLE_SQL.format('type')} AS title FROM insights", uses="insights")
def title_case(t):
    return t.insights.select("seq", S.title_case(F.col("type")).alias("title"))


@query("id_to_type", "SELECT seq, replace(lower(heuristic_id), '-', '_') AS type FROM evaluations", uses="evaluations")
def id_to_type(t):
    return t.evaluations.select("seq", S.id_to_type(F.col("heuristic_id")).alias("type"))


PREFIX_SQL = "array_to_string(string_split(heuristic_id, '-')[1:2], '-')"


@query("heuristic_prefix", f"""
SELECT {PREFIX_SQL} AS prefix, count(*) AS evaluations FROM evaluations GROUP BY 1""", uses="evaluations")
def heuristic_prefix(t):
    return t.evaluations.groupBy(S.heuristic_prefix(F.col("heuristic_id")).alias("prefix")).agg(
        F.count("*").alias("evaluations"))


CATEGORY_SQL = Q.case(PREFIX_SQL, I.HEURISTIC_CATEGORY, "heuristic")


@query("insight_category", f"""
SELECT page_id, {CATEGORY_SQL} AS category, count(*) AS n FROM evaluations GROUP BY ALL""", uses="evaluations")
def insight_category(t):
    return t.evaluations.groupBy("page_id", S.insight_category(F.col("heuristic_id")).alias("category")).agg(
        F.count("*").alias("n"))


PRINCIPLES = {h: p for _, _, h, _, p in heuristic_rows()}


@query("default_recommendation", f"""
SELECT seq, page_id, CASE WHEN recommendation <> '' THEN recommendation ELSE
  (CASE WHEN status = 'partial' THEN 'Review and improve: ' ELSE 'Address issue: ' END)
  || {Q.case('heuristic_id', PRINCIPLES, '')} END AS recommendation
FROM evaluations WHERE status IN ('fail', 'partial')""", uses="evaluations")
def default_recommendation(t):
    e = t.evaluations.filter(F.col("status").isin("fail", "partial"))
    principle = map_value(F.col("heuristic_id"), PRINCIPLES)
    return e.select("seq", "page_id", S.default_recommendation(
        F.col("recommendation"), F.col("status"), principle).alias("recommendation"))


@query("default_insight_element", """
SELECT page_id, doc_pos, CASE WHEN doc_pos % 7 = 0 THEN 'N/A' ELSE
  tag || '[' || CAST(form_id AS VARCHAR) || ']' || CASE WHEN text <> '' THEN ' "' || substr(text, 1, 30) || '"' ELSE '' END
  END AS element FROM nodes""", uses="nodes")
def default_insight_element(t):
    tag = F.when(F.col("doc_pos") % 7 != 0, F.col("tag"))
    return t.nodes.select("page_id", "doc_pos", S.default_element(tag, F.col("form_id"), F.col("text")).alias("element"))


STATUS_SQL = "regexp_extract(response, '\"status\":\"([^\"]*)\"', 1)"


@query("normalize_status", f"""
SELECT page_id, seq, {Q.case('lower(trim(s))', {**I.STATUS_WORDS, **I.STRICT_EXTRA_STATUS})} AS strict,
 {Q.case('lower(trim(s))', I.STATUS_WORDS, 'not_applicable')} AS lenient
FROM (SELECT *, {STATUS_SQL} AS s FROM replies) r WHERE s <> ''""", uses="replies")
def normalize_status(t):
    raw = F.regexp_extract("response", r'"status":"([^"]*)"', 1)
    return t.replies.filter(raw != "").select(
        "page_id", "seq", S.normalize_status(raw, True).alias("strict"), S.normalize_status(raw, False).alias("lenient"))


@query("extract_refs", """
SELECT seq, page_id,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(concat_ws(' ', observation, issue, recommendation), '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)))), ',') AS plain,
 array_to_string(regexp_extract_all(concat_ws(' ', observation, issue, recommendation), '(?i)\\[v\\d+-\\d+\\]'), ' ') AS placed
FROM evaluations""", uses="evaluations")
def extract_refs(t):
    text = F.concat_ws(" ", "observation", "issue", "recommendation")
    return t.evaluations.select(
        "seq", "page_id", F.array_join(S.plain_refs(text).cast("array<string>"), ",").alias("plain"),
        F.array_join(F.transform(S.viewport_refs(text), lambda r: r["ref"]), " ").alias("placed"))


@query("relabel_refs", """
SELECT seq, page_id, regexp_replace(observation, '\\[(\\d+)\\]', '[v' || CAST(viewport_index AS VARCHAR) || '-\\1]', 'g') AS text
FROM evaluations""", uses="evaluations")
def relabel_refs(t):
    return t.evaluations.select("seq", "page_id", S.relabel_refs(F.col("observation"), F.col("viewport_index")).alias("text"))


@query("evidence_ids", """
SELECT seq, page_id, '[v' || CAST(viewport_index AS VARCHAR) || '-' || CAST(element_index AS VARCHAR) || ']' AS ref,
 'V' || CAST(viewport_index AS VARCHAR) || '-0' AS viewport_id,
 'viewport-' || CAST(viewport_index AS VARCHAR) AS viewport_key, 'tile-' || CAST(viewport_index AS VARCHAR) AS tile_key
FROM boxes""", uses="boxes")
def evidence_ids(t):
    v = F.col("viewport_index")
    return t.boxes.select(
        "seq", "page_id", S.viewport_ref(v, F.col("element_index")).alias("ref"),
        F.format_string("V%d-0", v).alias("viewport_id"), F.format_string("viewport-%d", v).alias("viewport_key"),
        F.format_string("tile-%d", v).alias("tile_key"))


@query("focus_area", """
SELECT conv_id, turn, CASE WHEN contains(a, 'above') OR contains(a, 'fold') THEN 'above_fold' ELSE 'full_page' END AS area
FROM (SELECT conv_id, turn, regexp_replace(lower(text), '[-\\s]', '_', 'g') AS a FROM conversations) c""")
def focus_area(t):
    return t.conversations.select("conv_id", "turn", S.focus_area(F.col("text")).alias("area"))


BOUNDED = {w.replace("-", "_"): w for _, words, *_ in SEMANTIC_PATTERNS.values() for w in words} | {"cookie": "cookie"}


@query("word_boundary_match", "SELECT page_id, doc_pos, " + ", ".join(
    f"len(list_filter(string_split(lower(class_attr), ' '), lambda c: regexp_matches(c, '{S.bounded_pattern(w)}'))) > 0 AS has_{n}"
    for n, w in BOUNDED.items()) + " FROM nodes", uses="nodes")
def word_boundary_match(t):
    """Every class word of the semantic patterns, and one that none of them has."""
    return prepared(t.nodes).select("page_id", "doc_pos", *[has_class_word(w).alias(f"has_{n}") for n, w in BOUNDED.items()])


INTENTS = [*INTENT_WORDS, "free"]


@query("text_intent", "SELECT page_id, doc_pos, " + ", ".join(
    "(" + " OR ".join(f"regexp_matches(lower(trim(text)), '\\b{w}\\b')" for w in S.intent_words(i)) + f") AS {i}"
    for i in INTENTS) + " FROM nodes", uses="nodes")
def text_intent(t):
    """Every intent with words of its own, and one that stands for itself."""
    return t.nodes.select("page_id", "doc_pos", *[S.text_intent(F.col("text"), i).alias(i) for i in INTENTS])


# ---------------------------------------------------------------- URLs

HOST_SQL = "lower(regexp_extract(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
PATH_SQL = "regexp_extract(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
DOMAIN_SQL = f"regexp_replace({HOST_SQL}, '^www\\.', '')"


@query("validate_url", f"""
SELECT event_id, CASE WHEN trim(url) = '' THEN 'empty' WHEN NOT regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'invalid format'
  WHEN lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'bad protocol'
  WHEN {HOST_SQL.format('url')} = '' THEN 'no host' END AS error
FROM (SELECT event_id, CASE k % 12 WHEN 0 THEN '  ' WHEN 1 THEN concat('shop', k, '.example.com') WHEN 2 THEN replace(url, 'https', 'ftp') ELSE url END AS url FROM actions) a
""", uses="actions")
def validate_url(t):
    url = (F.when(F.col("k") % 12 == 0, "  ").when(F.col("k") % 12 == 1, F.format_string("shop%d.example.com", "k"))
           .when(F.col("k") % 12 == 2, F.replace("url", F.lit("https"), F.lit("ftp"))).otherwise(F.col("url")))
    return t.actions.select("event_id", U.url_error(url).alias("error"))


@query("domain_of", f"SELECT page_id, {DOMAIN_SQL.format('url')} AS domain FROM pages")
def domain_of(t):
    return t.pages.select("page_id", U.domain_of(F.col("url")).alias("domain"))


@query("normalize_url", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '')) AS url FROM pages")
def normalize_url(t):
    return t.pages.select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query("path_pattern", f"SELECT page_id, CASE WHEN {PATH_SQL.format('url')} = '' THEN '/' ELSE {PATH_SQL.format('url')} END AS path FROM pages")
def path_pattern(t):
    return t.pages.select("page_id", U.path_pattern(F.col("url")).alias("path"))


@query("is_homepage", f"""
SELECT page_id, p IN {Q.in_list(P.HOME_PATHS)} AS home, p IN {Q.in_list(P.NAVIGATION_HOME_PATHS)} AS navigation_home
FROM (SELECT page_id, {PATH_SQL.format('url')} AS p FROM urls) u""", uses="urls")
def is_homepage(t):
    return t.urls.select("page_id", U.is_homepage(F.col("url")).alias("home"),
                         U.is_homepage(F.col("url"), P.NAVIGATION_HOME_PATHS).alias("navigation_home"))


URL_SIGNAL_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(lower(url), {Q.literal(p)}) THEN '{n}' END" for n, p in P.URL_SIGNALS.items()) + ")"


@query("url_signals", f"SELECT page_id, {URL_SIGNAL_SQL} AS signals FROM urls", uses="urls")
def url_signals(t):
    return t.urls.select("page_id", F.array_join(U.url_signals(F.col("url")), ",").alias("signals"))


# ---------------------------------------------------------------- numbers

PRICE_SQL = "TRY_CAST(nullif(regexp_extract(regexp_replace({0}, '[£$€¥₹,\\s]', '', 'g'), '^([+-]?(?:\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE)"
CURRENCY_SQL = "nullif(regexp_extract({0}, '(?i)([£$€¥₹]|USD|GBP|EUR|INR|JPY)', 1), '')"


@query("parse_price", f"SELECT page_id, {PRICE_SQL.format('dom_price_text')} AS price FROM prices", uses="prices")
def parse_price(t):
    return t.prices.select("page_id", N.parse_price(F.col("dom_price_text")).alias("price"))


@query("price_currency", f"SELECT page_id, {CURRENCY_SQL.format('dom_price_text')} AS currency FROM prices", uses="prices")
def price_currency(t):
    return t.prices.select("page_id", N.price_currency(F.col("dom_price_text")).alias("currency"))


MATCH_SQL = ("CASE WHEN {0} = 0 AND {1} = 0 THEN TRUE WHEN {0} = 0 OR {1} = 0 THEN FALSE "
             "ELSE abs({0} - {1}) / (({0} + {1}) / 2) * 100 <= 5.0 END")


@query("prices_match", f"""
SELECT page_id, {MATCH_SQL.format('a', 'b')} AS same
FROM (SELECT page_id, jsonld_price AS a, {PRICE_SQL.format('dom_price_text')} AS b FROM prices) p
WHERE a IS NOT NULL AND b IS NOT NULL""", uses="prices")
def prices_match(t):
    a, b = F.col("jsonld_price"), N.parse_price(F.col("dom_price_text"))
    return t.prices.filter(a.isNotNull() & b.isNotNull()).select("page_id", N.prices_match(a, b).alias("same"))


@query("normalize_confidence", """
SELECT seq, page_id, CASE WHEN c IS NULL THEN 0.5 WHEN c > 1 AND c <= 100 THEN c / 100 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) END AS strict,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) AS clamped
FROM (SELECT seq, page_id, CASE WHEN seq % 9 = 0 THEN NULL WHEN seq % 5 = 0 THEN confidence * 100 WHEN seq % 7 = 0 THEN -confidence ELSE confidence END AS c FROM evaluations) e
""", uses="evaluations")
def normalize_confidence(t):
    c = (F.when(F.col("seq") % 9 == 0, None).when(F.col("seq") % 5 == 0, F.col("confidence") * 100)
         .when(F.col("seq") % 7 == 0, -F.col("confidence")).otherwise(F.col("confidence")))
    return t.evaluations.select("seq", "page_id", N.normalize_confidence(c).alias("strict"), N.clamp01(c).alias("clamped"))


@query("image_tokens", """
SELECT seq, page_id, CAST(CASE WHEN w <= 0 OR h <= 0 THEN 85 ELSE ceil(w / 512) * ceil(h / 512) * 85 + 85 END AS BIGINT) AS tokens FROM boxes
""", uses="boxes")
def image_tokens(t):
    return t.boxes.select("seq", "page_id", N.image_tokens(F.col("w"), F.col("h")).alias("tokens"))


RANK_SQL = Q.case("{0}", I.SEVERITY_RANK, 0)


@query("compare_severity", f"""
SELECT e.seq, e.page_id, {RANK_SQL.format('e.severity')} - {RANK_SQL.format('e.given')} AS higher_by,
 CASE WHEN {RANK_SQL.format('e.severity')} >= {RANK_SQL.format('e.given')} THEN e.severity ELSE e.given END AS higher
FROM (SELECT *, CASE WHEN l > 60 THEN 'critical' WHEN l > 20 THEN 'medium' ELSE 'low' END AS given
      FROM (SELECT *, CAST(round(confidence * 100) AS INT) AS l FROM evaluations) x) e""", uses="evaluations")
def compare_severity(t):
    level = F.round(F.col("confidence") * 100).cast("int")
    given = F.when(level > 60, "critical").when(level > 20, "medium").otherwise("low")
    a, b = N.severity_rank(F.col("severity")), N.severity_rank(given)
    return t.evaluations.select("seq", "page_id", (a - b).alias("higher_by"),
                                F.when(a >= b, F.col("severity")).otherwise(given).alias("higher"))


@query("aggregate_confidence", """
SELECT page_id, doc_pos, CASE len(w) WHEN 0 THEN 0.0 ELSE list_reduce(list_prepend(0.0::DOUBLE, list_sort(w)), lambda a, b: a + b - a * b) END AS confidence
FROM (SELECT page_id, doc_pos, list_filter([CASE WHEN is_visible THEN 0.9 END, CASE WHEN tag = 'button' THEN 0.6 END, CASE WHEN w > 100 THEN 0.3 END]::DOUBLE[], lambda x: x IS NOT NULL) AS w FROM nodes) n
""", uses="nodes")
def aggregate_confidence(t):
    weights = F.array_compact(F.array(F.when(F.col("is_visible"), 0.9), F.when(F.col("tag") == "button", 0.6),
                                      F.when(F.col("w") > 100, 0.3)))
    return t.nodes.select("page_id", "doc_pos", N.noisy_or(weights).alias("confidence"))


@query("noisy_or", """
SELECT page_id, floor((1 - product(1 - w)) * 1000000 + 0.123457) / 1000000 AS confidence
FROM (SELECT DISTINCT page_id, confidence * 0.5 AS w FROM boxes) b GROUP BY page_id""", uses="boxes")
def noisy_or(t):
    """All distinct weights of a page together, to six places; the product is folded on the map side.
    Products of hundredths often end in a half of the sixth place, so the cut is laid beside it."""
    return t.boxes.select("page_id", (F.col("confidence") * 0.5).alias("w")).distinct().groupBy("page_id").agg(
        (F.floor((1 - F.product(1 - F.col("w"))) * 1000000 + 0.123457) / 1000000).alias("confidence"))


@query("dom_prices", f"""
SELECT page_id, doc_pos, {PRICE_SQL.format('text')} AS price, {CURRENCY_SQL.format('text')} AS currency
FROM nodes WHERE contains(lower(class_attr), 'price') AND text <> ''""", uses="nodes")
def dom_prices(t):
    rows = t.nodes.filter(F.lower(attr("class")).contains("price") & (F.col("text") != ""))
    return rows.select("page_id", "doc_pos", N.parse_price(F.col("text")).alias("price"),
                       N.price_currency(F.col("text")).alias("currency"))
