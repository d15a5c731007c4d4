"""Queries over raw pages, parsed nodes and structured data."""

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import elements as E
from ..operators import html as H
from ..operators import structured as J
from ..rules.elements import INTERACTIVE_ROLES, INTERACTIVE_TAGS, KEPT_ATTRIBUTES, SKIP_TAGS
from ..sources.html import CLOSED_BY, SCOPES, VOID
from ..sources.html import html_nodes as parse_nodes
from ..sources.html import node_interactive
from ..sources.shared import written
from ..sources.tables import DERIVED_NODE_CHUNK, NODE_CHUNK
from . import sqltext as Q
from .catalog import query
from .chunks import by_width
from .text_queries import DOMAIN_SQL, URL_SIGNAL_SQL


def unescaped(expr):
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


def inner_text(expr):
    bare = unescaped(f"regexp_replace({expr}, '<[^>]*>', ' ', 'gs')")
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


TITLE_SQL = f"nullif({inner_text('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, '')"
H1_SQL = f"nullif({inner_text('''regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)''')}, '')"
HASH_SQL = "CASE WHEN coalesce(html, '') = '' THEN 'navigation-pending' ELSE substr(sha256(html), 1, 16) END"
LINKS_SQL = "regexp_extract_all(html, '(?is)<a\\b([^>]*>.*?)</a>', 1)"


@query("scan_pages", "SELECT page_id, url, length(html) AS chars FROM pages WHERE html IS NOT NULL AND url LIKE 'http%'")
def scan_pages(t):
    return t.pages.filter(F.col("html").isNotNull() & F.col("url").startswith("http")).select(
        "page_id", "url", F.length("html").alias("chars"))


@query("page_title", f"SELECT page_id, {TITLE_SQL} AS title, {H1_SQL} AS heading FROM pages")
def page_title(t):
    return t.pages.select("page_id", H.page_title(F.col("html")).alias("title"), H.first_heading(F.col("html")).alias("heading"))


@query("dom_hash", f"SELECT page_id, {HASH_SQL} AS dom_hash FROM pages")
def dom_hash(t):
    return t.pages.select("page_id", H.dom_hash(F.col("html")).alias("dom_hash"))


@query("html_links", f"""
SELECT page_id, pos, regexp_extract(a, '(?is)^[^>]*href="([^"]*)"', 1) AS href, {inner_text('''regexp_replace(a, '^[^>]*>', '', 's')''')} AS text
FROM (SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS a FROM (SELECT page_id, {LINKS_SQL} AS l FROM pages) p) x""")
def html_links(t):
    return H.html_links(t.pages)


@query("site_overview", f"""
SELECT {DOMAIN_SQL.format('url')} AS domain, count(*) AS pages, sum(len({LINKS_SQL})) AS links,
 count(DISTINCT {HASH_SQL}) AS versions, count({TITLE_SQL}) AS titled,
 count_if(regexp_matches(lower(url), '[?&](page|sort|filter)=')) AS listings
FROM pages GROUP BY 1""")
def site_overview(t):
    """Pages, links, distinct contents and listing URLs per domain."""
    html = F.col("html")
    per_page = t.pages.select(
        U.domain_of(F.col("url")).alias("domain"), H.dom_hash(html).alias("hash"), H.page_title(html).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?is)<a\b([^>]*>.*?)</a>"), F.lit(1))).alias("links"),
        U.url_signal_conditions(F.col("url"))["url_listing_params"].alias("listing"))
    # Distinct contents first, so that a large site shuffles once per content and not once per page.
    content = per_page.groupBy("domain", "hash").agg(
        F.count("*").alias("pages"), F.sum("links").alias("links"), F.count("title").alias("titled"),
        F.count_if("listing").alias("listings"))
    return content.groupBy("domain").agg(
        F.sum("pages").alias("pages"), F.sum("links").alias("links"), F.count("*").alias("versions"),
        F.sum("titled").alias("titled"), F.sum("listings").alias("listings"))


TAGS_SQL = "regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)"


@query("html_tag_counts", f"""
SELECT page_id, count(*) AS nodes, count_if(tag IN {Q.in_list(INTERACTIVE_TAGS)}) AS interactive
FROM (SELECT page_id, unnest({TAGS_SQL}) AS tag FROM pages) t
WHERE tag NOT IN {Q.in_list(SKIP_TAGS + ['html', 'head', 'title'])} GROUP BY page_id""")
def html_tag_counts(t):
    return H.tag_counts(parse_nodes(t.pages))


@query("skip_tags", f"""
SELECT page_id, count(*) AS tags FROM (SELECT page_id, unnest({TAGS_SQL}) AS tag FROM pages) t
WHERE tag NOT IN {Q.in_list(SKIP_TAGS)} GROUP BY page_id""")
def skip_tags(t):
    left = F.regexp_count(H.without_skipped(F.col("html")), F.lit("<[a-zA-Z]"))
    return t.pages.select("page_id", left.cast("bigint").alias("tags"))


BARE_SQL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<head\\b.*?</head>', '', 'gis'), "
            "'<!--.*?-->', '', 'gs'), '<script\\b.*?</script>', '', 'gis'), '<style\\b.*?</style>', '', 'gis'), '</?br\\b[^>]*>', ' ', 'gi')")


@query("page_text", f"""
SELECT page_id, substr(t, 1, 2000) AS text, CASE WHEN length(t) <= 500 THEN t ELSE substr(t, 1, 500) || chr(10) ||
 '[...truncated, showing first 500 of ' || CAST(length(t) AS VARCHAR) || ' chars]' END AS excerpt, length(t) AS chars
FROM (SELECT page_id, {inner_text(BARE_SQL)} AS t FROM pages) x""")
def page_text(t):
    rows = t.pages.select("page_id", H.body_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.substring("t", 1, 2000).alias("text"), H.text_excerpt(F.col("t"), 500).alias("excerpt"),
                       F.length("t").alias("chars"))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# The tree of a page by replaying its tags on a stack: which elements are open, and at which position each started.
CLOSERS = {}
for _name, _tags in CLOSED_BY.items():
    for _tag in sorted(_tags):
        CLOSERS.setdefault(_tag, []).append(_name)
CLOSERS_SQL = "MAP {" + ", ".join(f"'{k}': {sql_list(v)}" for k, v in sorted(CLOSERS.items())) + "}"
PLAIN_SQL = "html"
for _gone in ("<!--.*?-->", "<script\\b.*?</script>", "<style\\b.*?</style>", "<title\\b.*?</title>"):
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, '{_gone}', '', 'gis')"
TREE_SQL = f"""RECURSIVE tg AS (SELECT page_id, unnest(l) AS tag_text, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all({PLAIN_SQL}, '</?[a-zA-Z][^>]*>') AS l FROM pages) x),
nm AS (SELECT *, lower(regexp_extract(tag_text, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, tag_text LIKE '</%' AS closes FROM tg),
ev AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k, count_if(NOT closes) OVER (PARTITION BY page_id ORDER BY i) AS pos FROM nm WHERE tag NOT IN {Q.in_list(SKIP_TAGS + ['html', 'head', 'title', 'body', 'base'])}),
st(page_id, k, tags, starts, pos, parent, tag, tag_text) AS (
 SELECT page_id, 0::BIGINT, ['body'], [0::HUGEINT], 0::HUGEINT, NULL::HUGEINT, 'body', '<body>' FROM pages
 UNION ALL SELECT page_id, k, CASE WHEN closes OR tag IN {Q.in_list(sorted(VOID))} THEN tags[1:keep] ELSE list_append(tags[1:keep], tag) END,
  CASE WHEN closes OR tag IN {Q.in_list(sorted(VOID))} THEN starts[1:keep] ELSE list_append(starts[1:keep], pos) END, CASE WHEN NOT closes THEN pos END, starts[keep], tag, tag_text
 FROM (SELECT e.*, s.tags, s.starts, CASE WHEN least_open > greatest(scope, 1) THEN least_open - 1 ELSE len(s.tags) END AS keep
  FROM (SELECT s.*, e.tag AS t, e.closes AS c, coalesce(list_max(list_filter(range(2, len(s.tags) + 1), lambda j: CASE WHEN e.closes THEN s.tags[j] = e.tag ELSE list_contains(coalesce({CLOSERS_SQL}[e.tag], []), s.tags[j]) END)), 0) AS least_open,
    CASE WHEN e.closes THEN 0 ELSE coalesce(list_max(list_filter(range(2, len(s.tags) + 1), lambda j: list_contains({sql_list(sorted(SCOPES))}, s.tags[j]))), 0) END AS scope
   FROM st s JOIN ev e ON e.page_id = s.page_id AND e.k = s.k + 1) s JOIN ev e ON e.page_id = s.page_id AND e.k = s.k + 1) y),
el AS (SELECT page_id, pos AS doc_pos, parent, tag, tag_text, row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY pos) AS n FROM st WHERE pos IS NOT NULL),
xp(page_id, doc_pos, xpath) AS (SELECT page_id, doc_pos, '/html/body' FROM el WHERE doc_pos = 0
 UNION ALL SELECT el.page_id, el.doc_pos, xp.xpath || '/' || el.tag || CASE WHEN el.n > 1 THEN '[' || CAST(el.n AS VARCHAR) || ']' ELSE '' END FROM xp JOIN el ON el.page_id = xp.page_id AND el.parent = xp.doc_pos)"""


@query("html_nodes")
def html_nodes(t):
    """Every element of every page with its type."""
    typed = E.with_type(parse_nodes(t.pages))
    return typed.select("page_id", "doc_pos", "parent_pos", "depth", "tag", "xpath", "text", "is_visible",
                        "is_interactive", "element_type", "type_confidence")


@query("node_xpath", f"WITH {TREE_SQL} SELECT page_id, CAST(doc_pos AS BIGINT) AS doc_pos, xpath FROM xp")
def node_xpath(t):
    return parse_nodes(t.pages).select("page_id", "doc_pos", "xpath")


@query("node_text", f"""
SELECT page_id, doc_pos, CASE WHEN length(c) > 100 THEN substr(c, 1, 97) || '...' ELSE c END AS text
FROM (SELECT page_id, doc_pos, trim(regexp_replace(CASE WHEN tag = 'input' THEN placeholder_attr WHEN tag = 'img' THEN '' ELSE repeat(text || ' ', 1 + form_id) END, '\\s+', ' ', 'g')) AS c FROM nodes) n
""", uses="nodes")
def node_text(t):
    from ..sources.html import node_text as text_of
    long = F.repeat(F.concat("text", F.lit(" ")), F.col("form_id") + 1)
    return t.nodes.withColumn("raw_text", long).select("page_id", "doc_pos", text_of().alias("text"))


ATTRS_SQL = "regexp_extract_all(tag_text, '\\s([a-zA-Z-]+)=\"([^\"]*)\"', {0})".format


@query("node_attrs", f"""
WITH {TREE_SQL}, kept AS (SELECT page_id, doc_pos, unnest({ATTRS_SQL(1)}) AS name, unnest({ATTRS_SQL(2)}) AS value FROM el)
SELECT page_id, CAST(doc_pos AS BIGINT) AS doc_pos, name, CASE WHEN length(value) > 100 THEN substr(value, 1, 100) || '...' ELSE value END AS value FROM kept WHERE value <> '' AND name IN {Q.in_list(KEPT_ATTRIBUTES)}""")
def node_attrs(t):
    """Kept attributes of each element of the parsed pages."""
    return parse_nodes(t.pages).select("page_id", "doc_pos", F.explode(H.kept_attributes()).alias("name", "value"))


@query("node_visible", f"""WITH {TREE_SQL} SELECT page_id, CAST(doc_pos AS BIGINT) AS doc_pos, tag, NOT regexp_matches(tag_text, '(?i)\\shidden|aria-hidden="true"|display\\s*:\\s*none') AS is_visible FROM el""")
def node_visible(t):
    return parse_nodes(t.pages).select("page_id", "doc_pos", "tag", "is_visible")


INTERACTIVE_SQL = f"(tag IN {Q.in_list(INTERACTIVE_TAGS)} OR role_attr IN {Q.in_list(INTERACTIVE_ROLES)} OR onclick_attr)"


@query("node_interactive", f"SELECT page_id, doc_pos, {INTERACTIVE_SQL} AS interactive FROM nodes", uses="nodes")
def node_interactive_query(t):
    return t.nodes.select("page_id", "doc_pos", node_interactive().alias("interactive"))


@query("jsonld_blocks", """
SELECT page_id, CAST(0 AS INT) AS block, json FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1)) AS json FROM jsonld) j
WHERE json_valid(json)""", uses="jsonld")
def jsonld_blocks(t):
    return J.jsonld_blocks(t.jsonld)


@query("jsonld_flatten", """
WITH j AS (SELECT page_id, trim(regexp_extract(html, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1)) AS json FROM jsonld),
v AS (SELECT page_id, json FROM j WHERE json_valid(json)), o AS (SELECT page_id, CASE WHEN json_extract(json, '$."@graph"') IS NULL THEN [CAST(json AS JSON)] ELSE CAST(json_extract(json, '$."@graph"') AS JSON[]) END AS os FROM v)
SELECT page_id, 0 AS block, CASE WHEN json_type(x, '$."@type"') = 'ARRAY' THEN CAST(json_extract(x, '$."@type"') AS VARCHAR) ELSE json_extract_string(x, '$."@type"') END AS type, json_extract_string(x, '$.name') AS name
FROM (SELECT page_id, unnest(os) AS x FROM o) u""", uses="jsonld")
def jsonld_flatten(t):
    rows = J.jsonld_objects(J.jsonld_blocks(t.jsonld))
    return rows.select("page_id", "block", F.get_json_object("json", "$['@type']").alias("type"),
                       F.get_json_object("json", "$.name").alias("name"))


PRODUCT_CTE = """WITH j AS (SELECT page_id, trim(regexp_extract(html, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1)) AS json FROM jsonld),
p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN json ELSE CAST(json_extract(json, '$."@graph"[1]') AS VARCHAR) END AS json FROM j WHERE page_id % 4 IN (0, 1))
"""


def pick(path):
    return f"json_extract_string(json, '{path}')"


AVAILABILITY_SQL = "(CASE WHEN contains(lower({0}), 'instock') THEN 'InStock' WHEN contains(lower({0}), 'soldout') THEN 'SoldOut' ELSE string_split({0}, '/')[-1] END)"


@query("jsonld_product", PRODUCT_CTE + f"SELECT page_id, {pick('$.name')} AS name, {pick('$.sku')} AS sku FROM p", uses="jsonld")
def jsonld_product(t):
    return J.product_fields(J.products(t.jsonld)).select("page_id", "name", "sku")


OFFER_PRICE_SQL = f"CAST(coalesce({pick('$.offers[0].price')}, {pick('$.offers.price')}) AS DOUBLE)"


@query("product_fields", PRODUCT_CTE + f"""SELECT page_id, {pick('$.name')} AS name, {OFFER_PRICE_SQL} AS price,
 {pick('$.offers.priceCurrency')} AS currency, {AVAILABILITY_SQL.format(pick('$.offers.availability'))} AS availability,
 CAST({pick('$.aggregateRating.ratingValue')} AS DOUBLE) AS rating, CAST({pick('$.aggregateRating.ratingCount')} AS BIGINT) AS review_count,
 coalesce({pick('$.brand.name')}, {pick('$.brand')}) AS brand, {pick('$.sku')} AS sku, {pick('$.image[0]')} AS image FROM p""", uses="jsonld")
def product_fields(t):
    return J.product_fields(J.products(t.jsonld))


@query("product_schema_price", PRODUCT_CTE + f"SELECT page_id, {OFFER_PRICE_SQL} AS price, {pick('$.offers.priceCurrency')} AS currency FROM p", uses="jsonld")
def product_schema_price(t):
    return J.schema_price(t.jsonld)


META_SQL = "TRY_CAST(regexp_extract(html, 'product:price:amount\" content=\"([^\"]*)\"', 1) AS DOUBLE)"


@query("meta_price", f"SELECT page_id, {META_SQL} AS price FROM jsonld", uses="jsonld")
def meta_price(t):
    return t.jsonld.select("page_id", H.meta_price(F.col("html")).alias("price"))


@query("normalize_availability", f"""
SELECT page_id, {AVAILABILITY_SQL.format('jsonld_availability')} AS availability FROM prices""", uses="prices")
def normalize_availability(t):
    return t.prices.select("page_id", J.normalize_availability(F.col("jsonld_availability")).alias("availability"))


@query("content_regions", f"""
WITH {TREE_SQL}, up AS (SELECT xp.*, el.tag, list_filter(string_split(regexp_replace(p.xpath, '\\[\\d+\\]', '', 'g'), '/'), lambda x: x IN ('nav', 'header', 'footer')) AS l
 FROM xp JOIN el USING (page_id, doc_pos) LEFT JOIN xp p ON p.page_id = el.page_id AND p.doc_pos = el.parent),
dv AS (SELECT d.page_id, d.doc_pos, d.xpath, count(*) AS size FROM up d JOIN xp e ON e.page_id = d.page_id AND starts_with(e.xpath, d.xpath || '/') WHERE d.tag = 'div' GROUP BY ALL),
mn AS (SELECT page_id, coalesce(arg_min(xpath, doc_pos) FILTER (WHERE tag = 'main'), any_value(big)) AS main FROM up
 LEFT JOIN (SELECT page_id, arg_max(xpath, size * 1000000 - doc_pos) AS big FROM dv GROUP BY page_id) b USING (page_id) GROUP BY page_id),
ins AS (SELECT up.*, coalesce(xpath = main OR starts_with(xpath, main || '/'), FALSE) AS in_main FROM up JOIN mn USING (page_id))
SELECT page_id, CAST(doc_pos AS BIGINT) AS doc_pos, in_main, CASE WHEN len(l) > 0 THEN CASE WHEN l[-1] = 'footer' THEN 'footer' ELSE 'header' END WHEN in_main THEN 'main' ELSE 'unknown' END AS region FROM ins""")
def content_regions(t):
    """Region of each element. Nodes are joined with their page's main part, so the parsed pages are written once."""
    nodes = written(parse_nodes(t.pages).select("page_id", "doc_pos", "last_pos", "tag", "attrs", "region"))
    return H.content_regions(nodes).select("page_id", "doc_pos", "region", "in_main")


COLLECTED_SQL = "(tag IN ('a', 'button', 'input', 'select', 'textarea') OR role_attr IN ('button', 'link'))"


@query("region_summary", f"""
SELECT page_id, bool_or(tag = 'main' OR role_attr = 'main') AS has_main, count_if({COLLECTED_SQL} AND region = 'main' AND tag = 'a') AS main_links,
 count_if({COLLECTED_SQL} AND region = 'main' AND (tag = 'button' OR role_attr = 'button')) AS main_buttons,
 count_if({COLLECTED_SQL} AND region = 'header') AS header_elements, count_if({COLLECTED_SQL}) AS total
FROM nodes GROUP BY page_id""", uses="nodes")
def region_summary(t):
    return H.region_summary(t.nodes)


@query("element_index", """
SELECT page_id, doc_pos, row_number() OVER (PARTITION BY page_id ORDER BY doc_pos) - 1 AS idx
FROM nodes WHERE is_visible AND (tag IN ('button', 'nav') OR """ + INTERACTIVE_SQL + ")", uses="nodes")
def element_index(t):
    nodes = t.nodes.withColumn("element_type", F.when(F.col("tag").isin("button", "nav"), F.col("tag")))
    rows = nodes.select("page_id", "doc_pos", "is_visible", "element_type", node_interactive().alias("is_interactive"))
    return H.element_index(rows, by_width(F.col("doc_pos"), DERIVED_NODE_CHUNK)).select("page_id", "doc_pos", "idx")


@query("ax_outline")
def ax_outline(t):
    """Role outline of every page, one line per kept node in document order."""
    return E.outline(parse_nodes(t.pages)).select("page_id", "doc_pos", "line")


@query("serialize_nodes")
def serialize_nodes(t):
    """One line per indexed element of every page, in document order. Numbering reads twice, so the parsed pages are written."""
    rows = H.element_index(written(E.with_type(parse_nodes(t.pages))), by_width(F.col("doc_pos"), NODE_CHUNK))
    return rows.select("page_id", "idx", E.node_line().alias("line"))
