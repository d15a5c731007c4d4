"""The audit rules: what each page lacks or overdoes, as insights.

Element rules filter typed nodes, form rules aggregate the nodes of a form, page rules aggregate a page and
join the aggregate (one row a page) to the pages, so that a page without elements still gets its insights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.lookup import contains_any
from ..functions.selectors import attr, has_attr
from ..functions.urls import is_homepage
from ..plans import chunks
from ..rules import audit as R
from ..rules.pages import NAVIGATION_HOME_PATHS
from ..sources.shared import written

OUT = ["page_id", "type", "severity", "category", "element", "issue", "recommendation"]


def insight(rule: str, element: Column, n: Column | None = None, text: Column | None = None, severity: Column | None = None,
            issue: Column | None = None) -> Column:
    """One insight of a rule; {n} and {text} of its issue are filled from the row."""
    category, level, template, advice = R.RULES[rule]
    filled = F.lit(template)
    if n is not None:
        filled = F.replace(filled, F.lit("{n}"), n.cast("string"))
    if text is not None:
        filled = F.replace(filled, F.lit("{text}"), text)
    return F.struct(F.lit(rule).alias("type"), (severity if severity is not None else F.lit(level)).alias("severity"),
                    F.lit(category).alias("category"), element.alias("element"),
                    (issue if issue is not None else filled).alias("issue"), F.lit(advice).alias("recommendation"))


def fired(rows: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Insights of the rules whose condition holds on a row."""
    hits = F.array(*[F.when(condition, made) for condition, made in rules.values()])
    return rows.select("page_id", F.explode(hits).alias("i")).filter(F.col("i").isNotNull()).select("page_id", "i.*").select(*OUT)


def shown(kind: str) -> Column:
    return (F.col("element_type") == kind) & F.col("is_visible")


def clean_text() -> Column:
    return F.trim(F.coalesce("text", F.lit("")))


# ---------------------------------------------------------------- element rules

def cta_rules() -> dict:
    text, at = clean_text(), F.col("xpath")
    size = F.format_string("%dx%d", F.col("w"), F.col("h"))
    small = F.coalesce(F.col("w") * F.col("h") < R.MIN_TARGET_AREA, F.lit(False)) & F.col("y").isNotNull()
    return {
        "weak_cta_text": (shown("cta") & text.rlike(R.WEAK_CTA), insight("weak_cta_text", at, text=text)),
        "short_cta_text": (shown("cta") & F.length(text).between(1, 2), insight("short_cta_text", at, text=text)),
        "no_cta_text": (shown("cta") & (text == ""), insight("no_cta_text", at)),
        "small_click_target": (shown("cta") & small, insight("small_click_target", at, text=size)),
    }


def headline_rules() -> dict:
    text, at = clean_text(), F.col("xpath")
    h1, words = shown("value_prop") & (F.col("tag") == "h1"), S.count_words(F.col("text"))
    return {
        "generic_headline": (h1 & text.rlike(R.GENERIC_HEADLINE), insight("generic_headline", at, text=text)),
        "headline_too_long": (h1 & (words > R.MAX_HEADLINE_WORDS), insight("headline_too_long", at, n=words)),
    }


# ---------------------------------------------------------------- form rules

def is_field() -> Column:
    """Visible field that is not hidden by its type."""
    return F.col("tag").isin(R.FIELD_TAGS) & F.col("is_visible") & ~((F.col("tag") == "input") & (attr("type") == "hidden"))


def _form_sums() -> dict[str, Column]:
    low, path = F.lower("text"), F.lower("xpath")
    submit = F.col("tag").isin("button", "input") & ((attr("type") == "submit") | low.contains("submit"))
    return {
        "fields": F.count_if(is_field()), "has_label": F.bool_or((F.col("tag") == "label") & F.col("is_visible")),
        "has_error": F.bool_or(contains_any(low, R.ERROR_WORDS) | contains_any(path, R.ERROR_WORDS)),
        "has_submit": F.bool_or(submit | ((F.col("tag") == "button") & F.col("is_visible"))),
    }


def forms(typed: DataFrame) -> DataFrame:
    """Visible forms with what their descendants hold. Sums have one row per form."""
    heads = typed.filter(shown("form") & (F.col("tag") == "form")).select("page_id", "form_id", "doc_pos", "xpath")
    sums = typed.filter(F.col("form_id").isNotNull()).groupBy("page_id", "form_id").agg(
        *[c.alias(n) for n, c in _form_sums().items()])
    return heads.join(sums, ["page_id", "form_id"])


def form_rules() -> dict:
    at = F.col("xpath")
    return {
        "form_field_overload": (F.col("fields") > R.MAX_FIELDS, insight("form_field_overload", at, n=F.col("fields"))),
        "no_error_container": (~F.col("has_error"), insight("no_error_container", at)),
        "no_submit_button": (~F.col("has_submit"), insight("no_submit_button", at)),
    }


def form_fields(typed: DataFrame) -> DataFrame:
    """Fields of visible forms, with whether their form has a label.

    One form may hold very many fields, so its totals reach them through chunks of positions."""
    is_head = shown("form") & (F.col("tag") == "form")
    rows = typed.filter(F.col("form_id").isNotNull())
    whole = chunks.key_totals(
        rows, ["page_id", "form_id"], {"form_shown": F.max("_shown"), "form_label": F.max("_label")},
        {"_shown": F.bool_or(is_head), "_label": F.bool_or((F.col("tag") == "label") & F.col("is_visible"))},
        chunks.by_hash(rows, "page_id", "doc_pos"))
    return whole.filter(is_field() & F.col("form_shown"))


def field_rules() -> dict:
    at = F.col("xpath")
    labelled = (attr("placeholder") != "") | (attr("aria-label") != "") | F.col("form_label")
    required = has_attr("required") | (F.lower(attr("aria-required")) == "true")
    marked = F.col("text").contains("*") | F.lower("text").contains("(required)")
    typed = F.lower(attr("type")).isin(R.SPECIFIC_INPUT_TYPES)
    return {
        "missing_field_label": (~labelled, insight("missing_field_label", at)),
        "missing_input_type": ((F.col("tag") == "input") & ~typed, insight("missing_input_type", at)),
        "no_required_indicator": (required & ~marked, insight("no_required_indicator", at)),
    }


# ---------------------------------------------------------------- page rules

def _page_sums(viewport_height: int) -> dict[str, Column]:
    low, path = F.lower("text"), F.lower("xpath")
    fold = F.coalesce(F.col("y") < viewport_height, F.lit(False))
    h1 = shown("value_prop") & (F.col("tag") == "h1")

    def says(words):
        return contains_any(low, words) | contains_any(path, words)

    search = (F.lower(attr("type")) == "search") | (F.lower(attr("role")) == "search")
    nav = shown("navigation") & ~path.contains("footer")
    home = (F.col("tag") == "a") & (attr("href").isin("/", "home") | contains_any(low, R.HOME_WORDS))
    return {
        "ctas": F.count_if(shown("cta")), "fold_ctas": F.count_if(shown("cta") & fold),
        "trusts": F.count_if(shown("trust")), "fold_trusts": F.count_if(shown("trust") & fold),
        **{f"has_{rule[3:]}": F.bool_or(shown("trust") & says(words)) for rule, words in R.TRUST_WORDS.items()},
        "h1s": F.count_if(h1), "h2s": F.count_if(shown("value_prop") & (F.col("tag") == "h2")),
        "navs": F.count_if(shown("navigation")),
        "has_nav": F.bool_or(nav & ((F.col("tag") == "nav") | (F.lower(attr("role")) == "navigation") | says(R.MAIN_NAV_WORDS))),
        "has_breadcrumbs": F.bool_or(says(R.BREADCRUMB_WORDS) | F.lower(attr("aria-label")).contains("breadcrumb")),
        "has_search_sign": F.bool_or(search), "has_search": F.bool_or(search | says(R.SEARCH_WORDS)),
        "has_home": F.bool_or(home | path.contains("logo") | path.contains("brand")),
        "nav_depth": F.max(F.when(shown("navigation"), F.col("list_depth"))),
        "forms": F.count_if(shown("form") & (F.col("tag") == "form")),
        "all_fields": F.count_if(is_field() & F.col("form_id").isNotNull()),
    }


def page_sums(pages: DataFrame, typed: DataFrame, viewport_height: int) -> DataFrame:
    """One row per page of ``pages(page_id, url)``."""
    sums = _page_sums(viewport_height)
    # The first heading is text, so Spark sorts the rows of its aggregate: it has headings only, and the sums are hashed.
    heads = typed.filter(shown("value_prop") & (F.col("tag") == "h1")).select("page_id", "doc_pos", clean_text().alias("text"), "xpath")
    first = heads.groupBy("page_id").agg(F.min_by(F.struct("text", "xpath"), "doc_pos").alias("first_h1"))
    rows = pages.select("page_id", "url").join(
        typed.groupBy("page_id").agg(*[c.alias(n) for n, c in sums.items()]), "page_id", "left").join(first.hint("merge"), "page_id", "left")
    counts = [n for n in sums if n in ("nav_depth", "forms", "all_fields") or n.endswith("s") and not n.startswith("has_")]
    flags = [n for n in sums if n.startswith("has_")]
    return rows.withColumns({**{n: F.coalesce(n, F.lit(0)) for n in counts}, **{n: F.coalesce(n, F.lit(False)) for n in flags}})


def page_rules() -> dict:
    none = F.lit("")
    home = is_homepage(F.col("url"), NAVIGATION_HOME_PATHS)
    headline = F.coalesce("first_h1.text", F.lit(""))
    weak_headline = (F.col("h1s") > 0) & headline.rlike(R.FRICTION_HEADLINE)
    plain = {
        "missing_cta": F.col("fold_ctas") == 0, "no_trust_above_fold": F.col("fold_trusts") == 0,
        **{rule: ~F.col(f"has_{rule[3:]}") for rule in R.TRUST_WORDS},
        "missing_h1": F.col("h1s") == 0, "no_subheadline": (F.col("h1s") > 0) & (F.col("h2s") == 0),
        "no_main_nav": ~F.col("has_nav"), "no_breadcrumbs": ~F.col("has_breadcrumbs") & ~home,
        "no_search": ~F.col("has_search"), "no_home_link": ~F.col("has_home"),
        "friction_cta": F.col("fold_ctas") == 0, "friction_trust": F.col("fold_trusts") == 0,
        "friction_nav": ~F.col("has_search_sign"),
    }
    rules = {r: (c, insight(r, none)) for r, c in plain.items()}
    rules["cta_overload"] = (F.col("ctas") > R.MAX_CTAS, insight("cta_overload", none, n=F.col("ctas")))
    rules["deep_nav_nesting"] = (F.col("nav_depth") > R.MAX_NAV_DEPTH, insight("deep_nav_nesting", none, n=F.col("nav_depth")))
    rules["friction_value"] = ((F.col("h1s") == 0) | weak_headline, insight(
        "friction_value", F.when(weak_headline, F.col("first_h1.xpath")).otherwise(""),
        severity=F.when(weak_headline, "medium").otherwise("high"),
        issue=F.when(weak_headline, F.concat(F.lit('Generic main heading: "'), headline, F.lit('"'))).otherwise(R.RULES["friction_value"][2])))
    return rules


def multiple_h1(typed: DataFrame) -> DataFrame:
    """Pages with several main headings; the second is named. Spark keeps two per page before the shuffle."""
    heads = typed.filter(shown("value_prop") & (F.col("tag") == "h1"))
    counts = heads.groupBy("page_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("page_id").orderBy("doc_pos")
    second = heads.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2).filter(F.col("_r") == 2)
    return fired(second.select("page_id", "xpath").join(counts, "page_id"), {
        "multiple_h1": (F.lit(True), insight("multiple_h1", F.col("xpath"), n=F.col("n")))})


def friction_form(typed: DataFrame) -> DataFrame:
    """First form of a page with too many fields."""
    big = forms(typed).filter(F.col("fields") > R.MAX_FIELDS)
    first = big.groupBy("page_id").agg(F.min_by(F.struct("xpath", "fields"), "doc_pos").alias("f")).select("page_id", "f.*")
    return fired(first, {"friction_form": (F.lit(True), insight("friction_form", F.col("xpath"), n=F.col("fields")))})


# ---------------------------------------------------------------- all of them

def _pick(rules: dict, names) -> dict:
    return {r: rules[r] for r in names if r in rules}


def audit(pages: DataFrame, typed: DataFrame, names=None, viewport_height: int = 800) -> DataFrame:
    """Insights of the named rules (all by default). Only the sums that they need are computed."""
    names = list(R.RULES) if names is None else list(names)
    unknown = [n for n in names if n not in R.RULES]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    frames: list[tuple[dict, Callable[[], DataFrame]]] = [
        ({**cta_rules(), **headline_rules()}, lambda: typed), (form_rules(), lambda: forms(typed)),
        (field_rules(), lambda: form_fields(typed)), (page_rules(), lambda: page_sums(pages, typed, viewport_height))]
    single = [(n, f) for n, f in (("multiple_h1", multiple_h1), ("friction_form", friction_form)) if n in names]
    if sum(1 for rules, _ in frames if _pick(rules, names)) + len(single) > 1:
        # Several passes follow. Typing the nodes is the dear part, so it is done once and written.
        typed = written(typed)
    parts = [fired(rows(), _pick(rules, names)) for rules, rows in frames if _pick(rules, names)]
    parts += [f(typed) for _, f in single]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_extracts(pages: DataFrame, typed: DataFrame, viewport_height: int = 800) -> DataFrame:
    """Counts and flags that go with the rules."""
    return page_sums(pages, typed, viewport_height).drop("url", "first_h1")


def friction_score(insights: DataFrame, pages: DataFrame) -> DataFrame:
    """Friction points of a page over the five categories checked."""
    hits = insights.filter(F.col("type").startswith("friction_")).groupBy("page_id").agg(F.count_distinct("type").alias("n"))
    return pages.select("page_id").join(hits, "page_id", "left").select(
        "page_id", F.coalesce("n", F.lit(0)).alias("friction"), F.lit(5).alias("checked"))


# ---------------------------------------------------------------- rules of one's own

@dataclass(frozen=True)
class Parameter:
    """A value that a rule's condition reads as ``p.<name>``: its SQL type, default, bounds and allowed values."""

    type: str
    default: object
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()


SCHEMA = "rule STRING, name STRING, type STRING, least DOUBLE, most DOUBLE, choices ARRAY<STRING>"


class RuleBook:
    """Rules by name: an SQL condition over typed nodes, or a function of (pages, typed nodes) to insights.

    A condition may have parameters. They come as rows (page_group, rule, name, value) of texts, a null group standing for all pages;
    a page's own group wins over those, and those over the defaults.
    """

    def __init__(self):
        self.rules: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
            n: (lambda pages, typed, n=n: audit(pages, typed, [n])) for n in R.RULES}
        self.conditions: dict[str, tuple[str, dict[str, Parameter], Column]] = {}

    def register(self, name: str, rule, severity: str = "medium", category: str = "friction", issue: str = "", recommendation: str = "",
                 parameters: dict[str, Parameter] | None = None):
        """``rule`` is an SQL condition or a function; a name can be used once, and only a condition has parameters."""
        if name in self.rules or name in self.conditions:
            raise ValueError(f"rule '{name}' is already registered")
        if callable(rule):
            if parameters:
                raise ValueError(f"rule '{name}' is a function and takes no parameters")
            self.rules[name] = rule
            return
        made = F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), F.lit(category).alias("category"),
                        F.col("xpath").alias("element"), F.lit(issue).alias("issue"), F.lit(recommendation).alias("recommendation"))
        self.conditions[name] = rule, dict(parameters or {}), made

    def checked(self, given: DataFrame) -> DataFrame:
        """``given`` parameter rows with ``problem``: what is wrong with each, null for a valid one. Of rows for one group, rule and
        parameter that differ none is valid; equal ones count once."""
        def bound(v):
            return None if v is None else float(v)

        known = [(n, k, q.type, bound(q.least), bound(q.most), list(map(str, q.choices))) for n, (_, ps, _) in self.conditions.items() for k, q in ps.items()]
        schema = given.sparkSession.createDataFrame(known, SCHEMA)
        rules = given.sparkSession.createDataFrame([(n,) for n in (*self.rules, *self.conditions)], "rule STRING")
        rows = given.groupBy("page_group", "rule", "name").agg(
            F.min("value").alias("value"), (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("_values"))
        rows = rows.join(rules.withColumn("_rule", F.lit(True)), "rule", "left").join(schema, ["rule", "name"], "left")
        value = F.col("value")
        as_type = reduce(lambda held, kind: F.when(F.col("type") == kind, value.try_cast(kind).isNotNull()).otherwise(held),
                         sorted({k[2] for k in known}), F.lit(True))
        number = value.try_cast("double")
        problem = (F.when(F.col("_rule").isNull(), "no such rule").when(F.col("type").isNull(), "no such parameter")
                   .when(F.col("_values") > 1, "given more than once").when(value.isNull(), "no value")
                   .when(~as_type, F.concat(F.lit("not of type "), "type"))
                   .when(F.col("least").isNotNull() & ~F.coalesce(number >= F.col("least"), F.lit(False)), F.concat(F.lit("below "), F.col("least").cast("string")))
                   .when(F.col("most").isNotNull() & ~F.coalesce(number <= F.col("most"), F.lit(False)), F.concat(F.lit("above "), F.col("most").cast("string")))
                   .when((F.size("choices") > 0) & ~F.array_contains("choices", value), F.concat(F.lit("not one of "), F.array_join("choices", ", "))))
        return rows.select("page_group", "rule", "name", "value", problem.alias("problem"))

    def _conditions(self, names: list[str], pages: DataFrame, typed: DataFrame, given: DataFrame | None) -> list[DataFrame]:
        """Insights of the conditions, all tested in one pass over the nodes, and an error row per invalid parameter."""
        held, frames = typed, []
        everywhere, out = {}, set()
        if given is not None:
            rows = written(self.checked(given).filter(
                F.col("rule").isin(names) | ~F.coalesce(F.col("rule").isin([*self.conditions]), F.lit(False))))
            bad = F.concat(F.lit("invalid parameter "), F.coalesce("rule", F.lit("")), F.lit("."), F.coalesce("name", F.lit("")),
                           F.concat(F.lit(" of group "), "page_group"), F.lit(": "), "problem")
            plain = F.concat(F.lit("invalid parameter "), F.coalesce("rule", F.lit("")), F.lit("."), F.coalesce("name", F.lit("")), F.lit(": "), "problem")
            frames.append(rows.filter("problem IS NOT NULL").select(*_error(F.coalesce(bad, plain))))
            usable = rows.filter(F.col("rule").isin(names))
            # At most one valid row for each parameter that the rules declare, and one invalid row for each rule.
            for r in usable.filter("page_group IS NULL AND problem IS NULL").collect():
                everywhere[r["rule"], r["name"]] = r["value"]
            out = {r["rule"] for r in usable.filter("page_group IS NULL AND problem IS NOT NULL").select("rule").distinct().collect()}
            if "page_group" in pages.columns:
                key = F.concat_ws(".", "rule", "name")
                settings = usable.filter("page_group IS NOT NULL").groupBy("page_group").agg(
                    F.map_from_entries(F.collect_list(F.when(F.col("problem").isNull(), F.struct(key.alias("k"), "value")))).alias("_given"),
                    F.collect_set(F.when(F.col("problem").isNotNull(), F.col("rule"))).alias("_out"))
                held = typed.join(pages.select("page_id", "page_group").join(settings, "page_group").select("page_id", "_given", "_out"), "page_id", "left")
        tests = {}
        for name in names:
            rule, parameters, made = self.conditions[name]
            if name in out:
                continue
            test = F.expr(rule)
            if parameters:
                def value(k, q, name=name):
                    fixed = F.lit(str(everywhere.get((name, k), q.default)))
                    own = F.get(F.array(F.col("_given")[f"{name}.{k}"]), F.lit(0)) if "_given" in held.columns else F.lit(None).cast("string")
                    return F.coalesce(own, fixed).cast(q.type).alias(k)
                held = held.withColumn(f"_p_{name}", F.struct(*[value(k, q) for k, q in parameters.items()]))
                test = F.expr(f"exists(array(`_p_{name}`), p -> {rule})")
            if "_out" in held.columns:
                test = test & ~F.coalesce(F.array_contains("_out", name), F.lit(False))
            tests[name] = test, made
        return ([fired(held, tests)] if tests else []) + frames

    def run(self, names, pages: DataFrame, typed: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
        """Insights of the named rules; a name that is not registered gives one error row, as does each invalid row of ``parameters``.

        A rule with an invalid parameter does not run on the pages of that row's group. Pages tell their group in ``page_group``;
        without that column only parameters for all pages count. The built-in rules share one audit, so the nodes are typed
        once for all of them, and all conditions are tested in one pass over the nodes."""
        names = list(dict.fromkeys(names))
        builtin = [n for n in names if n in R.RULES]
        frames = [audit(pages, typed, builtin).select(*OUT)] if builtin else []
        frames += [self.rules[n](pages, typed).select(*OUT) for n in names if n in self.rules and n not in R.RULES]
        conditions = [n for n in names if n in self.conditions]
        if conditions or parameters is not None:
            frames += self._conditions(conditions, pages, typed, parameters)
        for n in names:
            if n not in self.rules and n not in self.conditions:
                frames.append(pages.sparkSession.range(1).select(*_error(F.lit(f"unknown rule: {n}"))))
        return reduce(DataFrame.unionByName, frames)


def _error(issue: Column) -> list[Column]:
    return [F.lit(None).cast("bigint").alias("page_id"), F.lit("error").alias("type"), F.lit("low").alias("severity"),
            F.lit("error").alias("category"), F.lit("").alias("element"), issue.alias("issue"), F.lit("").alias("recommendation")]
