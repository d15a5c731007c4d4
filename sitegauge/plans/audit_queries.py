"""One query per audit rule, and their extracts."""

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import elements as E
from ..rules import audit as R
from ..rules import pages as RP
from . import sqltext as Q
from .catalog import query
from .element_queries import PATTERN_HITS
from .text_queries import PATH_SQL, SQUEEZED

TYPED_SQL = f"""ht AS ({PATTERN_HITS}), bt AS (SELECT page_id, doc_pos, arg_max(type, (weight, -turn)) AS t, max(weight) AS c FROM ht GROUP BY ALL),
typed AS (SELECT n.*, CASE WHEN c >= 0.5 THEN t END AS element_type FROM nodes n LEFT JOIN bt USING (page_id, doc_pos))"""


def typed(t):
    return E.with_type(t.nodes)


def says(words):
    return f"({Q.any_contains('lower(text)', words)} OR {Q.any_contains('lower(xpath)', words)})"


FIELD = "(tag IN ('input', 'select', 'textarea') AND is_visible AND NOT (tag = 'input' AND type_attr = 'hidden'))"
CTA, TRUST, NAV = (f"(element_type = '{k}' AND is_visible)" for k in ("cta", "trust", "navigation"))
H1, H2 = (f"(element_type = 'value_prop' AND is_visible AND tag = '{k}')" for k in ("h1", "h2"))
FORM = "(element_type = 'form' AND is_visible AND tag = 'form')"
FORMS_SQL = f"""fs AS (SELECT page_id, form_id, count_if({FIELD}) AS fields, bool_or(tag = 'label' AND is_visible) AS has_label, bool_or({says(R.ERROR_WORDS)}) AS has_error,
 bool_or((tag IN ('button', 'input') AND (type_attr = 'submit' OR contains(lower(text), 'submit'))) OR (tag = 'button' AND is_visible)) AS has_submit FROM typed GROUP BY ALL),
forms AS (SELECT h.page_id, h.doc_pos, h.xpath, fs.* EXCLUDE (page_id) FROM typed h JOIN fs ON fs.page_id = h.page_id AND fs.form_id = h.form_id WHERE h.element_type = 'form' AND h.is_visible AND h.tag = 'form'),
fields AS (SELECT f.*, fs.has_label FROM typed f SEMI JOIN (SELECT page_id, form_id FROM typed WHERE element_type = 'form' AND is_visible AND tag = 'form') h ON h.page_id = f.page_id AND h.form_id = f.form_id
 JOIN fs ON fs.page_id = f.page_id AND fs.form_id = f.form_id WHERE f.tag IN ('input', 'select', 'textarea') AND f.is_visible AND NOT (f.tag = 'input' AND f.type_attr = 'hidden'))"""
PAGES_SQL = f"""ps AS (SELECT page_id, count_if({CTA}) AS ctas, count_if({CTA} AND y < 800) AS fold_ctas, count_if({TRUST}) AS trusts, count_if({TRUST} AND y < 800) AS fold_trusts,
 {", ".join(f"bool_or({TRUST} AND {says(w)}) AS has_{r[3:]}" for r, w in R.TRUST_WORDS.items())}, count_if({H1}) AS h1s, count_if({H2}) AS h2s,
 arg_min(trim(text), doc_pos) FILTER (WHERE {H1}) AS h1_text, arg_min(xpath, doc_pos) FILTER (WHERE {H1}) AS h1_path, count_if({NAV}) AS navs,
 bool_or({NAV} AND NOT contains(lower(xpath), 'footer') AND (tag = 'nav' OR role_attr = 'navigation' OR {says(R.MAIN_NAV_WORDS)})) AS has_nav,
 bool_or({says(R.BREADCRUMB_WORDS)} OR contains(lower(label_attr), 'breadcrumb')) AS has_breadcrumbs, bool_or(type_attr = 'search' OR role_attr = 'search') AS has_search_sign,
 bool_or(type_attr = 'search' OR role_attr = 'search' OR {says(R.SEARCH_WORDS)}) AS has_search,
 bool_or((tag = 'a' AND (href_attr IN ('/', 'home') OR {Q.any_contains('lower(text)', R.HOME_WORDS)})) OR contains(lower(xpath), 'logo') OR contains(lower(xpath), 'brand')) AS has_home,
 max(list_depth) FILTER (WHERE {NAV}) AS nav_depth, count_if({FORM}) AS forms, count_if({FIELD}) AS all_fields FROM typed GROUP BY page_id),
pg AS (SELECT u.page_id, u.url, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("ctas", "fold_ctas", "trusts", "fold_trusts", "h1s", "h2s", "navs", "nav_depth", "forms", "all_fields"))},
 {", ".join(f"coalesce({c}, FALSE) AS {c}" for c in ["has_nav", "has_breadcrumbs", "has_search_sign", "has_search", "has_home"] + [f"has_{r[3:]}" for r in R.TRUST_WORDS])}, h1_text, h1_path FROM urls u LEFT JOIN ps USING (page_id))"""

HOME = f"({PATH_SQL.format('url')} IN {Q.in_list(RP.NAVIGATION_HOME_PATHS)})"
WORDS = f"(CASE WHEN {SQUEEZED.format('text')} = '' THEN 0 ELSE len(string_split({SQUEEZED.format('text')}, ' ')) END)"
# Rule -> (rows it looks at, condition, element, the number or text that its issue quotes).
CONDITIONS = {
    "weak_cta_text": ("typed", f"{CTA} AND regexp_matches(trim(text), '{R.WEAK_CTA}')", "xpath", "trim(text)"),
    "short_cta_text": ("typed", f"{CTA} AND length(trim(text)) BETWEEN 1 AND 2", "xpath", "trim(text)"),
    "no_cta_text": ("typed", f"{CTA} AND trim(text) = ''", "xpath", None),
    "small_click_target": ("typed", f"{CTA} AND w * h < 1600 AND y IS NOT NULL", "xpath", "CAST(w AS VARCHAR) || 'x' || CAST(h AS VARCHAR)"),
    "generic_headline": ("typed", f"{H1} AND regexp_matches(trim(text), '{R.GENERIC_HEADLINE}')", "xpath", "trim(text)"),
    "headline_too_long": ("typed", f"{H1} AND {WORDS} > 10", "xpath", WORDS),
    "form_field_overload": ("forms", "fields > 5", "xpath", "fields"),
    "no_error_container": ("forms", "NOT has_error", "xpath", None),
    "no_submit_button": ("forms", "NOT has_submit", "xpath", None),
    "missing_field_label": ("fields", "placeholder_attr = '' AND label_attr = '' AND NOT has_label", "xpath", None),
    "missing_input_type": ("fields", f"tag = 'input' AND type_attr NOT IN {Q.in_list(R.SPECIFIC_INPUT_TYPES)}", "xpath", None),
    "no_required_indicator": ("fields", "required_attr AND NOT contains(text, '*') AND NOT contains(lower(text), '(required)')", "xpath", None),
    "missing_cta": ("pg", "fold_ctas = 0", "''", None),
    "cta_overload": ("pg", "ctas > 5", "''", "ctas"),
    "no_trust_above_fold": ("pg", "fold_trusts = 0", "''", None),
    **{r: ("pg", f"NOT has_{r[3:]}", "''", None) for r in R.TRUST_WORDS},
    "missing_h1": ("pg", "h1s = 0", "''", None),
    "multiple_h1": ("(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY doc_pos) AS r, count(*) OVER (PARTITION BY page_id) AS c FROM typed WHERE " + H1 + ")", "r = 2", "xpath", "c"),
    "no_subheadline": ("pg", "h1s > 0 AND h2s = 0", "''", None),
    "no_main_nav": ("pg", "NOT has_nav", "''", None),
    "no_breadcrumbs": ("pg", f"NOT has_breadcrumbs AND NOT {HOME}", "''", None),
    "no_search": ("pg", "NOT has_search", "''", None),
    "deep_nav_nesting": ("pg", "nav_depth > 3", "''", "nav_depth"),
    "no_home_link": ("pg", "NOT has_home", "''", None),
    "friction_cta": ("pg", "fold_ctas = 0", "''", None),
    "friction_form": ("(SELECT page_id, arg_min(xpath, doc_pos) AS xpath, arg_min(fields, doc_pos) AS fields FROM forms WHERE fields > 5 GROUP BY page_id)", "TRUE", "xpath", "fields"),
    "friction_trust": ("pg", "fold_trusts = 0", "''", None),
    "friction_nav": ("pg", "NOT has_search_sign", "''", None),
}
ALL_CTES = f"WITH {TYPED_SQL}, {FORMS_SQL}, {PAGES_SQL}"


def rule_sql(rule):
    if rule == "friction_value":
        weak = f"(h1s > 0 AND regexp_matches(h1_text, '{R.FRICTION_HEADLINE}'))"
        return (f"SELECT page_id, 'friction_value' AS type, CASE WHEN {weak} THEN 'medium' ELSE 'high' END AS severity, 'value_prop' AS category, CASE WHEN {weak} THEN h1_path ELSE '' END AS element, "
                f"CASE WHEN {weak} THEN 'Generic main heading: \"' || h1_text || '\"' ELSE {Q.literal(R.RULES[rule][2])} END AS issue, {Q.literal(R.RULES[rule][3])} AS recommendation FROM pg WHERE h1s = 0 OR {weak}")
    rows, condition, element, quoted = CONDITIONS[rule]
    category, severity, issue, advice = R.RULES[rule]
    text = Q.literal(issue)
    if quoted:
        text = f"replace(replace({text}, '{{n}}', CAST({quoted} AS VARCHAR)), '{{text}}', CAST({quoted} AS VARCHAR))"
    return (f"SELECT page_id, '{rule}' AS type, '{severity}' AS severity, '{category}' AS category, {element} AS element, {text} AS issue, "
            f"{Q.literal(advice)} AS recommendation FROM {rows} z WHERE {condition}")


def register_rule(rule):
    @query(rule, f"{ALL_CTES} {rule_sql(rule)}", uses="nodes urls")
    def run(t):
        return A.audit(t.urls, typed(t), [rule])


for name in R.RULES:
    register_rule(name)


@query("rule_extracts", f"{ALL_CTES} SELECT * EXCLUDE (url, h1_text, h1_path) FROM pg", uses="nodes urls")
def rule_extracts(t):
    return A.rule_extracts(t.urls, typed(t))


FRICTION = ["friction_cta", "friction_form", "friction_trust", "friction_value", "friction_nav"]


@query("friction_score", f"{ALL_CTES}, fr AS ({' UNION ALL '.join(rule_sql(r) for r in FRICTION)}) "
       "SELECT u.page_id, count(DISTINCT type) AS friction, 5 AS checked FROM urls u LEFT JOIN fr USING (page_id) GROUP BY u.page_id", uses="nodes urls")
def friction_score(t):
    return A.friction_score(A.audit(t.urls, typed(t), FRICTION), t.urls)


@query("audit_all", f"{ALL_CTES}, al AS ({' UNION ALL '.join(rule_sql(r) for r in R.RULES)}) SELECT type, severity, category, count(*) AS insights, count(DISTINCT page_id) AS pages FROM al GROUP BY ALL", uses="nodes urls")
def audit_all(t):
    """All rules in one go, counted by rule."""
    per_page = A.audit(t.urls, typed(t)).groupBy("type", "severity", "category", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("type", "severity", "category").agg(F.sum("n").alias("insights"), F.count("*").alias("pages"))


@query("register_rule", """
SELECT page_id, 'tiny_image' AS type, 'low' AS severity, 'friction' AS category, xpath AS element, 'Image is very small' AS issue, 'Show it larger' AS recommendation FROM nodes WHERE tag = 'img' AND w < 20 AND is_visible""", uses="nodes")
def register_rule_query(t):
    """A rule of one's own, given as a condition."""
    book = A.RuleBook()
    book.register("tiny_image", "tag = 'img' AND w < 20 AND is_visible", "low", issue="Image is very small", recommendation="Show it larger")
    return book.run(["tiny_image"], t.urls, t.nodes)


@query("run_rules", f"{ALL_CTES} {rule_sql('no_search')} UNION ALL {rule_sql('weak_cta_text')} UNION ALL SELECT NULL, 'error', 'low', 'error', '', 'unknown rule: no_such_rule', ''", uses="nodes urls")
def run_rules(t):
    return A.RuleBook().run(["no_search", "weak_cta_text", "no_such_rule"], t.urls, typed(t))


# Parameters per group of pages: (group or all, rule, name, value). The last four are invalid, so their rules do not run there.
GIVEN = [(None, "small_image", "side", "30"), ("g1", "small_image", "side", "60"), ("g1", "long_text", "chars", "12"),
         (None, "wordy_tag", "tag", "a"), ("g2", "small_image", "side", "-5"), ("g2", "long_text", "chars", "many"),
         (None, "long_text", "lines", "3"), ("g0", "no_such_rule", "x", "1")]
ERRORS = ["small_image.side of group g2: below 1.0", "long_text.chars of group g2: not of type int", "long_text.lines: no such parameter",
          "no_such_rule.x of group g0: no such rule"]


def own_rule_sql(name, issue, condition):
    return (f"SELECT page_id, '{name}' AS type, 'low' AS severity, 'friction' AS category, xpath AS element, '{issue}' AS issue, 'Check it' AS recommendation "
            f"FROM (SELECT *, 'g' || CAST(page_id % 4 AS VARCHAR) AS g FROM nodes) n WHERE is_visible AND {condition}")


@query("run_rules_with_parameters", " UNION ALL ".join([
    own_rule_sql("small_image", "Small image", "g <> 'g2' AND tag = 'img' AND w < CASE WHEN g = 'g1' THEN 60 ELSE 30 END"),
    own_rule_sql("wordy_tag", "Words", "tag = 'a' AND length(text) > 8"),
    *[f"SELECT NULL, 'error', 'low', 'error', '', 'invalid parameter {e}', ''" for e in ERRORS]]), uses="nodes")
def run_rules_with_parameters(t):
    """Thresholds by group of pages; a rule does not run where one of its parameters is invalid."""
    book = A.RuleBook()
    for name, rule, issue, parameters in (
            ("small_image", "is_visible AND tag = 'img' AND w < p.side", "Small image", {"side": A.Parameter("double", 20.0, 1, 1000)}),
            ("long_text", "is_visible AND length(text) > p.chars", "Long text", {"chars": A.Parameter("int", 100, 1)}),
            ("wordy_tag", "is_visible AND tag = p.tag AND length(text) > 8", "Words", {"tag": A.Parameter("string", "p", choices=("p", "a"))})):
        book.register(name, rule, "low", issue=issue, recommendation="Check it", parameters=parameters)
    pages = t.urls.withColumn("page_group", F.concat(F.lit("g"), (F.col("page_id") % 4).cast("string")))
    given = t.spark.createDataFrame(GIVEN, "page_group STRING, rule STRING, name STRING, value STRING")
    return book.run(["small_image", "long_text", "wordy_tag"], pages, t.nodes, given)
