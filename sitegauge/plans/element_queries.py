"""Queries over typed elements, boxes and consent rules."""

from pyspark.sql import functions as F

from ..functions.selectors import attr
from ..operators import consent as C
from ..operators import elements as E
from ..rules import consent as RC
from ..rules import elements as R
from ..rules import pages as RP
from ..sources.html import node_interactive
from ..sources.shared import written
from . import sqltext as Q
from .catalog import query
from .html_queries import COLLECTED_SQL, INTERACTIVE_SQL, TREE_SQL
from .text_queries import S

VIEWPORT = 800

# ---------------------------------------------------------------- typing

PATTERN_ROWS = [(i, name, kind, pattern, weight) for i, (name, signals) in enumerate(R.ELEMENT_PATTERNS.items())
                for kind, pattern, weight in signals]
PATTERN_HITS = f"""
SELECT page_id, doc_pos, turn, type, weight FROM (SELECT * FROM nodes) n, {Q.rows('r', 'turn, type, kind, pattern, weight', PATTERN_ROWS)}
WHERE CASE kind WHEN 'tag' THEN tag = pattern WHEN 'class' THEN contains(lower(class_attr), pattern)
 WHEN 'role' THEN lower(role_attr) = pattern WHEN 'attr' THEN FALSE
 ELSE len(list_filter(string_split(pattern, '|'), lambda p: contains(lower(text), p))) > 0 END"""


def best_sql(score):
    return f"""
WITH hits AS ({PATTERN_HITS}), s AS (SELECT page_id, doc_pos, turn, type, {score} AS score FROM hits GROUP BY ALL),
b AS (SELECT page_id, doc_pos, arg_max(type, (score, -turn)) AS t, max(score) AS c FROM s GROUP BY ALL)
SELECT n.page_id, n.doc_pos, CASE WHEN c >= 0.5 THEN t END AS element_type, CASE WHEN c >= 0.5 THEN c END AS type_confidence
FROM nodes n LEFT JOIN b USING (page_id, doc_pos)"""


TYPED = ["page_id", "doc_pos", "element_type", "type_confidence"]


@query("classify_max", best_sql("max(CAST(weight AS DOUBLE))"), uses="nodes")
def classify_max(t):
    return E.classify_max(t.nodes).select(*TYPED)


NOISY_SQL = "1 - list_reduce(list_reverse_sort(list(1 - CAST(weight AS DOUBLE))), lambda a, b: a * b)"


@query("classify_noisy_or", best_sql(NOISY_SQL), uses="nodes")
def classify_noisy_or(t):
    return E.classify_noisy_or(t.nodes).select(*TYPED)


SEMANTIC_ROWS = []
for turn, (name, (meanings, classes, words, tags, attributes)) in enumerate(R.SEMANTIC_PATTERNS.items()):
    SEMANTIC_ROWS += [(turn, name, "meaning", m) for m in meanings] + [(turn, name, "tag", x) for x in tags]
    SEMANTIC_ROWS += [(turn, name, "class", c) for c in classes]
    SEMANTIC_ROWS += [(turn, name, "text", "|".join(S.intent_words(w))) for w in words]


def meaning_sql(column):
    tags = " OR ".join(f"({column} = '{m}' AND tag IN {Q.in_list(t)})" for m, (t, _) in R.SEMANTIC_TAGS.items())
    roles = " OR ".join(f"({column} = '{m}' AND lower(role_attr) IN {Q.in_list(r)})" for m, (_, r) in R.SEMANTIC_TAGS.items())
    return f"CASE WHEN {tags} THEN 0.9 WHEN {roles} THEN 0.95 END"


def class_sql(column):
    found = (f"list_filter(string_split(lower(class_attr), ' '), lambda c: regexp_matches(c, '(^|[-_])' || {column} || '([-_]|$)'))[1]")
    return f"CASE WHEN {found} = {column} THEN 0.95 WHEN {found} IS NOT NULL THEN 0.85 END"


@query("classify_semantic", f"""
WITH s AS (SELECT page_id, doc_pos, turn, type, CAST(CASE kind WHEN 'meaning' THEN {meaning_sql('pattern')} WHEN 'tag' THEN CASE WHEN tag = pattern THEN 0.7 END
  WHEN 'class' THEN {class_sql('pattern')} ELSE CASE WHEN regexp_matches(lower(trim(text)), '\\b(' || pattern || ')\\b') THEN 0.8 END END AS DOUBLE) AS w
  FROM nodes, {Q.rows('r', 'turn, type, kind, pattern', SEMANTIC_ROWS)}),
g AS (SELECT page_id, doc_pos, turn, type, least(max(w) + least(0.05::DOUBLE * (count(w) - 1), 0.1::DOUBLE), 0.99::DOUBLE) AS score FROM s WHERE w IS NOT NULL GROUP BY ALL),
b AS (SELECT page_id, doc_pos, arg_max(type, (score, -turn)) AS t, max(score) AS c FROM g GROUP BY ALL)
SELECT n.page_id, n.doc_pos, CASE WHEN c >= 0.5 THEN t END AS element_type, CASE WHEN c >= 0.5 THEN c END AS type_confidence
FROM nodes n LEFT JOIN b USING (page_id, doc_pos)""", uses="nodes")
def classify_semantic(t):
    return E.classify_semantic(t.nodes).select(*TYPED)


def intent_sql(intent):
    words = S.intent_words(intent)
    label = " OR ".join(f"contains(lower(label_attr), '{w}')" for w in words)
    text = "\\b(" + "|".join(words) + ")\\b"
    pressed = "CASE WHEN onclick_attr THEN 0.7 WHEN type_attr IN ('submit', 'button') THEN 0.85 END"
    behaviour = {"button": pressed, "cta": pressed,
                 "cart": "CASE WHEN contains(href_attr, 'cart') THEN 0.8 END"}.get(intent, "NULL")
    meaning = meaning_sql(f"'{intent}'") if intent in R.SEMANTIC_TAGS else "NULL"
    cls = class_sql(f"'{intent}'")
    return f"""
SELECT page_id, doc_pos, '{intent}' AS intent, coalesce(f[1].k, 'none') AS match_type, len(f) AS signals,
 CASE WHEN len(f) = 0 THEN 0.0 ELSE least(f[1].s + least(0.05::DOUBLE * (len(f) - 1), 0.1::DOUBLE), 0.99::DOUBLE) END AS confidence
FROM (SELECT page_id, doc_pos, list_reverse_sort(list_filter([
 {{'s': CAST({meaning} AS DOUBLE), 't': 0, 'k': CASE WHEN {meaning} = 0.95 THEN 'aria' ELSE 'semantic' END}},
 {{'s': CAST({cls} AS DOUBLE), 't': -1, 'k': CASE WHEN {cls} = 0.95 THEN 'exact' ELSE 'word_boundary' END}},
 {{'s': CAST(CASE WHEN id_attr <> '' AND regexp_matches(lower(id_attr), '(^|[-_]){intent}([-_]|$)') THEN 0.8 END AS DOUBLE), 't': -2, 'k': 'word_boundary'}},
 {{'s': CAST(CASE WHEN {label} THEN 0.85 END AS DOUBLE), 't': -3, 'k': 'aria'}},
 {{'s': CAST(CASE WHEN regexp_matches(lower(trim(text)), '{text}') THEN 0.8 END AS DOUBLE), 't': -4, 'k': 'text'}},
 {{'s': CAST({behaviour} AS DOUBLE), 't': -5, 'k': 'behavioral'}}], lambda x: x.s IS NOT NULL)) AS f FROM nodes) x"""


INTENTS = list(dict.fromkeys([*R.INTENT_WORDS, *R.SEMANTIC_TAGS]))


@query("match_intent", "\nUNION ALL ".join(map(intent_sql, INTENTS)), uses="nodes")
def match_intent(t):
    """Every intent that has words or tags of its own."""
    return E.match_intents(t.nodes, INTENTS).select("page_id", "doc_pos", "intent", "match_type", "signals", "confidence")


@query("selector_match", "SELECT page_id, " + ", ".join(
    f"count_if({Q.selector(s)}) AS s{i}" for i, s in enumerate(RC.COOKIE_CONTAINERS + [".price", "article", '[class*="product-card"]']))
    + " FROM nodes GROUP BY page_id", uses="nodes")
def selector_match(t):
    from ..functions.selectors import matches, prepared
    wanted = RC.COOKIE_CONTAINERS + [".price", "article", '[class*="product-card"]']
    return prepared(t.nodes).groupBy("page_id").agg(*[F.count_if(matches(s)).alias(f"s{i}") for i, s in enumerate(wanted)])


# ---------------------------------------------------------------- viewports

PLACED_SQL = """SELECT *, y - viewport_index * 600 AS top, y - viewport_index * 600 + h AS bottom FROM boxes"""
SHOWN = "NOT (bottom < 0 OR top > 800)"
RATIO_SQL = f"CASE WHEN {SHOWN} AND h > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (least(800, bottom) - greatest(0, top)) / h)) ELSE 0.0 END"


def placed(t):
    """Boxes with the scroll position of their viewport."""
    return t.boxes.withColumn("scroll_y", F.col("viewport_index") * 600)


@query("to_viewport_coords", f"SELECT page_id, seq, top AS screen_y, {SHOWN} AS is_shown, {RATIO_SQL} AS shown_ratio FROM ({PLACED_SQL}) p", uses="boxes")
def to_viewport_coords(t):
    return E.to_viewport(placed(t), VIEWPORT).select("page_id", "seq", "screen_y", "is_shown", "shown_ratio")


@query("visible_elements", f"SELECT page_id, seq FROM ({PLACED_SQL}) p WHERE {SHOWN} AND {RATIO_SQL} >= 0.1", uses="boxes")
def visible_elements(t):
    return E.visible_elements(placed(t), VIEWPORT).select("page_id", "seq")


@query("box_visible", f"SELECT page_id, seq FROM ({PLACED_SQL}) p WHERE bottom > 0 AND top < 800", uses="boxes")
def box_visible(t):
    return E.box_visible(placed(t), VIEWPORT).select("page_id", "seq")


@query("elements_by_index", """
SELECT page_id, seq, element_index FROM boxes b WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT page_id, viewport_index,
 CAST(unnest(regexp_extract_all(observation, '\\[v\\d+-(\\d+)\\]', 1)) AS BIGINT) AS i FROM evaluations WHERE status = 'fail') w
 WHERE w.page_id = b.page_id AND w.viewport_index = b.viewport_index AND w.i = b.element_index)""", uses="boxes evaluations")
def elements_by_index(t):
    refs = t.evaluations.filter("status = 'fail'").select("page_id", F.explode(S.viewport_refs(F.col("observation"))).alias("r"))
    # Wanted indices are made distinct first; (page, viewport, index) is even even on a hot page.
    wanted = refs.select("page_id", "r.viewport_index", "r.element_index").distinct()
    return t.boxes.join(wanted, ["page_id", "viewport_index", "element_index"], "left_semi").select("page_id", "seq", "element_index")


@query("above_fold", "SELECT page_id, doc_pos FROM nodes WHERE y < 800", uses="nodes")
def above_fold(t):
    return t.nodes.filter(E.above_fold(VIEWPORT)).select("page_id", "doc_pos")


@query("visibility_filter_hidden", "SELECT page_id, doc_pos, tag FROM nodes WHERE is_visible", uses="nodes")
def visibility_filter_hidden(t):
    return t.nodes.filter("is_visible").select("page_id", "doc_pos", "tag")


@query("top_elements_per_type", """
SELECT page_id, element_type, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id, element_type ORDER BY element_index, seq) AS place
 FROM boxes WHERE element_type IS NOT NULL) b WHERE place <= 20""", uses="boxes")
def top_elements_per_type(t):
    return E.top_per_type(t.boxes, 20, ["element_index", "seq"]).select("page_id", "element_type", "seq", "place")


@query("element_listing", """
SELECT page_id, element_type, seq, place, total FROM (SELECT *, row_number() OVER (PARTITION BY page_id, element_type ORDER BY seq) AS place,
 count(*) OVER (PARTITION BY page_id, element_type) AS total FROM boxes WHERE element_type IS NOT NULL) b WHERE place <= 10""", uses="boxes")
def element_listing(t):
    return E.element_listing(t.boxes, 10, ["seq"]).select("page_id", "element_type", "seq", "place", "total")


@query("crop_region", f"""
WITH v AS (SELECT page_id, viewport_index, x, w, top, bottom FROM ({PLACED_SQL}) p WHERE element_type IN ('cta', 'value_prop') AND {SHOWN} AND {RATIO_SQL} >= 0.1),
a AS (SELECT page_id, viewport_index, greatest(0, min(x) - 50) AS x0, greatest(0, min(top) - 50) AS y0, least(1280, max(x + w) + 50) AS x1, least(800, max(bottom) + 50) AS y1 FROM v GROUP BY ALL),
c AS (SELECT *, CASE WHEN x1 - x0 < 100 THEN greatest(0.0::DOUBLE, x0 + (x1 - x0) / 2 - 50) ELSE x0 END AS xs, CASE WHEN y1 - y0 < 100 THEN greatest(0.0::DOUBLE, y0 + (y1 - y0) / 2 - 50) ELSE y0 END AS ys FROM a),
d AS (SELECT *, CASE WHEN x1 - x0 < 100 THEN least(100, 1280 - xs) ELSE x1 - x0 END AS wd, CASE WHEN y1 - y0 < 100 THEN least(100, 800 - ys) ELSE y1 - y0 END AS ht FROM c)
SELECT page_id, viewport_index, CAST(floor(xs + 0.5) AS BIGINT) AS x, CAST(floor(ys + 0.5) AS BIGINT) AS y, CAST(floor(wd + 0.5) AS BIGINT) AS width, CAST(floor(ht + 0.5) AS BIGINT) AS height
FROM d WHERE wd * ht / (1280 * 800) <= 0.8""", uses="boxes")
def crop_region(t):
    return E.crop_region(E.visible_elements(placed(t), VIEWPORT), "imagery", 1280, VIEWPORT)


DEDUPED_SQL = """
SELECT page_id, element_index, x, y, arg_min(element_type, (-confidence, seq)) AS element_type, max(confidence) AS confidence,
 arg_min(viewport_index, (-confidence, seq)) AS viewport_index, arg_min(w, (-confidence, seq)) AS w, arg_min(h, (-confidence, seq)) AS h,
 list_sort(list_distinct(list(viewport_index))) AS viewports
FROM boxes WHERE element_type IS NOT NULL GROUP BY page_id, element_index, x, y"""


@query("dedupe_boxes", f"SELECT * EXCLUDE (viewports), array_to_string(viewports, ',') AS viewports FROM ({DEDUPED_SQL}) d", uses="boxes")
def dedupe_boxes(t):
    return E.dedupe_boxes(t.boxes).withColumn("viewports", F.array_join(F.col("viewports").cast("array<string>"), ","))


@query("viewport_element_lists", f"""
SELECT page_id, viewport_index, count(*) AS n, string_agg(CAST(element_index AS VARCHAR), ',' ORDER BY element_index) AS elements
FROM (SELECT DISTINCT page_id, unnest(viewports) AS viewport_index, element_index FROM ({DEDUPED_SQL}) d) x GROUP BY ALL""", uses="boxes")
def viewport_element_lists(t):
    """Indices seen per viewport. They are made distinct first, so a list is as short as the index range."""
    rows = E.viewport_elements(E.dedupe_boxes(t.boxes)).distinct()
    return rows.groupBy("page_id", "viewport_index").agg(F.count("*").alias("n"), F.array_join(
        F.array_sort(F.collect_list("element_index")).cast("array<string>"), ",").alias("elements"))


@query("box_details", """
WITH i AS (SELECT page_id, form_id AS element_index, arg_min(tag, doc_pos) AS tag, substr(arg_min(text, doc_pos), 1, 100) AS text FROM nodes GROUP BY ALL)
SELECT b.page_id, b.seq, coalesce(i.tag, 'unknown') AS tag, coalesce(i.text, '') AS text
FROM boxes b LEFT JOIN i USING (page_id, element_index) WHERE element_type IS NOT NULL""", uses="boxes nodes")
def box_details(t):
    from ..operators.evidence import box_details as details
    indexed = t.nodes.withColumnRenamed("form_id", "element_index")
    return details(t.boxes, indexed).select("page_id", "seq", "tag", "text")


# ---------------------------------------------------------------- choosing what to act on

SCORE_SQL = """(CASE WHEN y BETWEEN 0 AND 800 THEN 10 ELSE 0 END + CASE WHEN region = 'main' THEN 8 ELSE 0 END + CASE WHEN length(text) > 3 THEN 5 ELSE 0 END
 + CASE WHEN tag = 'a' AND href_attr <> '' THEN 3 ELSE 0 END + CASE WHEN label_attr <> '' THEN 2 ELSE 0 END + CASE WHEN tag IN ('input', 'textarea', 'select') THEN 6 ELSE 0 END
 - CASE WHEN region = 'header' THEN 5 ELSE 0 END)"""


def collected(t):
    from ..operators.html import is_collected
    rows = t.nodes.withColumn("in_main", F.col("region") == "main").filter(is_collected())
    return E.score_interactive(rows, VIEWPORT)


@query("score_interactive", f"SELECT page_id, doc_pos, {SCORE_SQL} AS score FROM nodes WHERE {COLLECTED_SQL}", uses="nodes")
def score_interactive(t):
    return collected(t).select("page_id", "doc_pos", "score")


@query("cap_interactive", f"""
WITH s AS (SELECT page_id, doc_pos, region = 'header' AS is_header, {SCORE_SQL} AS score FROM nodes WHERE {COLLECTED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, is_header ORDER BY score DESC, doc_pos) AS rk, least(3, count_if(is_header) OVER (PARTITION BY page_id)) AS hd FROM s),
k AS (SELECT * FROM r WHERE rk <= CASE WHEN is_header THEN 3 ELSE greatest(0, 6 - hd) END)
SELECT page_id, doc_pos, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, is_header, doc_pos) - 1 AS idx FROM k""", uses="nodes")
def cap_interactive(t):
    """Caps of 6 and 3 instead of 50 and 10, so that they bite on the small pages of the derived table."""
    return E.cap_interactive(collected(t), 6, 3).select("page_id", "doc_pos", "score", "idx")


# ---------------------------------------------------------------- consent and noise

BLOCKER_SQL = "(CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for p, k in RP.BLOCKERS) + " END)"


@query("detect_blocker", f"SELECT page_id, doc_pos, {BLOCKER_SQL} AS blocker FROM nodes WHERE {BLOCKER_SQL} IS NOT NULL", uses="nodes")
def detect_blocker(t):
    return t.nodes.withColumn("blocker", C.detect_blocker(F.col("text"))).filter("blocker IS NOT NULL").select("page_id", "doc_pos", "blocker")


@query("detect_cmp", "SELECT page_id, arg_min(platform, rank) AS platform FROM (" + " UNION ALL ".join(
    f"SELECT DISTINCT page_id, {i} AS rank, '{n}' AS platform FROM nodes WHERE {Q.any_selector(s)}"
    for i, (n, s) in enumerate(RC.CONSENT_PLATFORMS)) + ") h GROUP BY page_id", uses="nodes")
def detect_cmp(t):
    return C.consent_platforms(t.nodes)


@query("cookie_container", f"SELECT page_id, doc_pos FROM nodes WHERE {Q.any_selector(RC.COOKIE_CONTAINERS + RC.COOKIE_BANNERS)}", uses="nodes")
def cookie_container(t):
    return C.cookie_containers(t.nodes).select("page_id", "doc_pos")


@query("accept_button", f"""
SELECT page_id, doc_pos FROM nodes WHERE {Q.any_contains('lower(text)', RC.ACCEPT_WORDS)} AND NOT {Q.any_contains('lower(text)', RC.NOT_ACCEPT_WORDS)}""", uses="nodes")
def accept_button(t):
    return t.nodes.filter(C.is_accept_button(F.col("text"))).select("page_id", "doc_pos")


@query("ui_noise", " UNION ALL ".join(
    f"SELECT page_id, '{n}' AS family, count(*) AS nodes FROM nodes WHERE {Q.any_selector(s)} GROUP BY page_id"
    for n, s in RC.NOISE_SELECTORS.items()), uses="nodes")
def ui_noise(t):
    return C.ui_noise(t.nodes)


@query("without_noise", "SELECT page_id, doc_pos FROM nodes WHERE NOT (" + " OR ".join(
    Q.any_selector(s) for s in RC.NOISE_SELECTORS.values()) + ")", uses="nodes")
def without_noise(t):
    return C.without_noise(t.nodes).select("page_id", "doc_pos")


BLANK, STAND_IN = "(tag = 'img' AND src_attr IN ('', 'about:blank'))", f"regexp_matches(src_attr, '{RC.PLACEHOLDER_SOURCE}')"


@query("image_signals", f"""
SELECT page_id, count_if(tag = 'img') AS total_images, count_if({BLANK}) AS blank_images, count_if(tag = 'img' AND src_attr <> '' AND {STAND_IN}) AS placeholder_images, 0 AS lazy_pending,
 bool_or(is_visible AND {Q.any_selector(RC.SPINNERS)}) AS spinner, bool_or(is_visible AND {Q.any_selector(RC.SKELETONS)}) AS skeleton, bool_or(is_visible AND {Q.any_selector(RC.OVERLAYS)}) AS overlay,
 least(count_if({Q.any_selector(RC.PLACEHOLDER_TEXT_HOLDERS)} AND regexp_matches(trim(text), '{RC.PLACEHOLDER_TEXT}')), 5) AS text_placeholders FROM nodes GROUP BY page_id""", uses="nodes")
def image_signals(t):
    return C.image_signals(t.nodes)


@query("blocking_overlay", """
SELECT page_id, bool_or(class_attr IN ('modal', 'overlay') AND w > 120 AND h > 60) AS blocked FROM boxes GROUP BY page_id""", uses="boxes")
def blocking_overlay(t):
    """Half of a 240x120 viewport, which the small boxes of the derived table can cover."""
    boxes = t.boxes.withColumn("attrs", F.create_map(F.lit("class"), F.col("class_attr")))
    return C.blocking_overlay(boxes, 240, 120)


@query("element_selector")
def element_selector(t):
    from ..operators.evidence import element_selectors
    from ..sources.html import html_nodes
    nodes = written(html_nodes(t.pages).select("page_id", "doc_pos", "tag", "xpath", "attrs"))  # read three times below
    return element_selectors(nodes).select("page_id", "doc_pos", "selector")


@query("element_group", f"WITH {TREE_SQL} SELECT page_id, CAST(doc_pos AS BIGINT) AS doc_pos, CASE WHEN contains(xpath, '/form') THEN 'form' ELSE '' END AS group_name FROM xp")
def element_group(t):
    from ..sources.html import html_nodes
    return html_nodes(t.pages).select("page_id", "doc_pos", "group_name")
