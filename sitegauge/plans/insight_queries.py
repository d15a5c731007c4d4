"""Queries over insights."""

from pyspark.sql import functions as F

from ..operators import evaluations as E
from ..operators import insights as O
from ..rules import insights as I
from ..sources.knowledge import builtin_heuristics
from . import sqltext as Q
from .catalog import query
from .text_queries import RANK_SQL, TITLE_SQL

BUSINESS = list(I.SEVERITY_BOOSTS)
BUSINESS_SQL = "(CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BUSINESS)) + " END)"


def with_business(df):
    return df.withColumn("business_type", F.get(F.array(*[F.lit(b) for b in BUSINESS]), (F.col("page_id") % 7).cast("int")))


KEY_SQL = "coalesce(nullif(heuristic_id, ''), lower(trim(type)) || '|' || lower(trim(coalesce(element, ''))))"


KEYED_SQL = f"(SELECT *, {KEY_SQL} AS dedupe_key FROM insights)"


@query("dedupe_insights", f"""
SELECT page_id, dedupe_key, count(*) AS merged, min(seq) AS seq, arg_min(severity, seq) AS severity, arg_min(category, seq) AS category, arg_min(type, seq) AS type, arg_min(issue, seq) AS issue,
 arg_min(evidence_selector, seq) FILTER (WHERE evidence_selector <> '') AS evidence_selector, arg_min(evidence_screenshot, seq) FILTER (WHERE evidence_screenshot <> '') AS evidence_screenshot
FROM {KEYED_SQL} i GROUP BY ALL""", uses="insights")
def dedupe_insights(t):
    return O.dedupe_insights(t.insights).select("page_id", "dedupe_key", "merged", "seq", "severity", "category", "type",
                                                "issue", "evidence_selector", "evidence_screenshot")


@query("insight_evidence", f"""
WITH f AS (SELECT page_id, dedupe_key, list_reduce(list({{'j': evidence_text, 'k': [{{'seq': seq, 'text': evidence_text}}]}} ORDER BY seq),
  lambda a, b: CASE WHEN a.j = b.j THEN a ELSE {{'j': a.j || ' | ' || b.j, 'k': list_concat(a.k, b.k)}} END) AS r FROM {KEYED_SQL} i WHERE evidence_text <> '' GROUP BY ALL),
k AS (SELECT page_id, dedupe_key, unnest(r.k) AS x FROM f) SELECT page_id, dedupe_key, x.seq AS seq, x.text AS text FROM k""", uses="insights")
def insight_evidence(t):
    return O.evidence_texts(t.insights)


@query("evidence_styles", f"""
SELECT page_id, dedupe_key, style_name AS style, arg_max(style_value, seq) AS value FROM {KEYED_SQL} i WHERE style_name IS NOT NULL GROUP BY ALL""", uses="insights")
def evidence_styles(t):
    """Styles of merged evidence: a later insight's value replaces an earlier one's."""
    styles = F.when(F.col("style_name").isNotNull(), F.create_map(F.coalesce("style_name", F.lit("")), "style_value"))
    rows = t.insights.withColumns({"dedupe_key": O.dedupe_key(), "styles": styles})
    return O.merge_styles(rows, ["page_id", "dedupe_key"])


def boost_sql():
    arms = []
    for b, words in I.SEVERITY_BOOSTS.items():
        for steps in (2, 1):
            some = [w for w, s in words.items() if s == steps]
            if some:
                both = " OR ".join(Q.any_contains(f"lower({c})", some) for c in ("type", "category", "issue"))
                arms.append(f"WHEN {BUSINESS_SQL} = '{b}' AND ({both}) THEN {steps}")
    return "(CASE " + " ".join(arms) + " ELSE 0 END)"


ADJUSTED_SQL = f"""adj AS (SELECT * EXCLUDE (severity), ['low', 'medium', 'high', 'critical'][least(4, {RANK_SQL.format('severity')} + {boost_sql()})] AS severity FROM insights)"""


def adjusted(t):
    return O.adjust_severity(with_business(t.insights))


@query("adjust_severity", f"WITH {ADJUSTED_SQL} SELECT page_id, seq, severity FROM adj", uses="insights")
def adjust_severity(t):
    return adjusted(t).select("page_id", "seq", "severity")


CRITICAL_SQL = "(" + " OR ".join(f"({BUSINESS_SQL} = '{b}' AND type IN {Q.in_list(x)})" for b, x in I.CRITICAL_TYPES.items() if x) + ")"
SCORED_SQL = f"(CAST({RANK_SQL.format('severity')} * 100 + CASE WHEN {CRITICAL_SQL} THEN 50 ELSE 0 END AS DOUBLE) + coalesce(confidence * 10, 0.0::DOUBLE))"


@query("prioritize_insights", f"""
WITH {ADJUSTED_SQL} SELECT page_id, seq, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS place FROM (SELECT *, {SCORED_SQL} AS score FROM adj) s""", uses="insights")
def prioritize_insights(t):
    return O.prioritize(adjusted(t)).select("page_id", "seq", "score", "place")


METRIC_SQL = Q.case("category", I.CATEGORY_METRIC, I.CATEGORY_METRIC["custom"])
HYPOTHESES_SQL = f"""hyp AS (SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, seq) AS place, 'H-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id,
 'Fix ' || {TITLE_SQL.format('type')} AS title, 'If we ' || lower(recommendation) || ', then ' || lower({METRIC_SQL}) || ' will improve because ' || lower(issue) AS hypothesis,
 'Current state: ' || issue AS control, recommendation AS treatment, {METRIC_SQL} AS primary_metric, {Q.case('severity', I.SEVERITY_IMPACT)} AS impact, priority
 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS n, {Q.case('severity', I.SEVERITY_PRIORITY)} AS priority FROM insights WHERE severity IN ('critical', 'high')) x)"""


@query("hypotheses", f"WITH {HYPOTHESES_SQL} SELECT * FROM hyp", uses="insights")
def hypotheses(t):
    return O.hypotheses(t.insights)


DEDUCT_SQL = Q.case("severity", I.SEVERITY_DEDUCTION, 0)
WEIGHT_SQL = Q.case("category", I.CATEGORY_WEIGHT_TENTHS, 8)
COUNTS_SQL = ", ".join(f"count_if(severity = '{s}') AS {s}_count" for s in I.SEVERITIES)


SCORE_SQL = f"""WITH s AS (SELECT page_id, sum({DEDUCT_SQL}) AS d, sum({DEDUCT_SQL} * {WEIGHT_SQL}) AS t, {COUNTS_SQL} FROM insights GROUP BY page_id)
SELECT c_custkey AS page_id, coalesce(critical_count, 0) AS critical_count, coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count, coalesce(low_count, 0) AS low_count,
 CASE WHEN d IS NULL THEN 100 ELSE greatest(0, least(100, 100 - CASE WHEN t = d * 10 THEN d ELSE floor((t * 7 + d * 30 + 50) / 100) END)) END AS overall FROM customer LEFT JOIN s ON s.page_id = c_custkey"""


@query("score_overall", SCORE_SQL, uses="insights")
def score_overall(t):
    return O.score_overall(t.customer.select(F.col("c_custkey").alias("page_id")), t.insights)


@query("score_by_category", f"SELECT page_id, category, greatest(0, 100 - sum({DEDUCT_SQL})) AS score FROM insights GROUP BY ALL", uses="insights")
def score_by_category(t):
    return O.score_by_category(t.insights)


@query("score_default", f"SELECT page_id, greatest(0, 100 - sum({DEDUCT_SQL})) AS overall, " + ", ".join(
    f"count_if(category = '{c}') AS {c}_insights" for c in I.CATEGORIES) + " FROM insights GROUP BY page_id", uses="insights")
def score_default(t):
    return O.score_default(t.insights)


@query("severity_counts", f"SELECT page_id, {COUNTS_SQL} FROM insights GROUP BY page_id", uses="insights")
def severity_counts(t):
    return t.insights.groupBy("page_id").agg(*O.severity_counts())


@query("union_insights", """
SELECT page_id, source, type, severity, issue FROM insights UNION ALL
SELECT page_id, 'vision', CASE WHEN status = 'fail' THEN 'heuristic_fail' ELSE 'heuristic_partial' END, severity, coalesce(nullif(issue, ''), observation) FROM evaluations WHERE status IN ('fail', 'partial')""", uses="insights evaluations")
def union_insights(t):
    seen = E.evaluations_to_insights(t.evaluations, builtin_heuristics(t.spark)).select(
        "page_id", F.lit("vision").alias("source"), F.col("plain_type").alias("type"), "severity", "issue")
    return t.insights.select("page_id", "source", "type", "severity", "issue").unionByName(seen)


@query("validate_insights", f"""
SELECT page_id, count(*) AS total, count_if(length(issue) < 10) AS bad_issue, count_if(length(recommendation) < 10) AS bad_recommendation, count_if(severity NOT IN {Q.in_list(I.SEVERITIES)}) AS bad_severity,
 count_if(category NOT IN {Q.in_list(I.CATEGORIES)}) AS bad_category, count_if(element IS NULL) AS bad_element, count_if(coalesce(confidence < 0 OR confidence > 1, FALSE)) AS bad_confidence FROM insights GROUP BY page_id""", uses="insights")
def validate_insights(t):
    return O.violations(t.insights, ["page_id"], O.insight_violations())


@query("validate_hypotheses", f"""
WITH {HYPOTHESES_SQL} SELECT page_id, count(*) AS total, count_if(NOT regexp_matches(id, '^H-\\d{{3}}$')) AS bad_id, count_if(length(title) NOT BETWEEN 5 AND 100) AS bad_title, count_if(length(hypothesis) NOT BETWEEN 20 AND 500) AS bad_hypothesis,
 count_if(length(control) NOT BETWEEN 10 AND 300) AS bad_control, count_if(length(treatment) NOT BETWEEN 10 AND 300) AS bad_treatment, count_if(length(primary_metric) NOT BETWEEN 3 AND 50) AS bad_primary_metric,
 count_if(impact NOT IN ('low', 'medium', 'high')) AS bad_impact, count_if(priority NOT BETWEEN 1 AND 10) AS bad_priority FROM hyp GROUP BY page_id""", uses="insights")
def validate_hypotheses(t):
    return O.violations(O.hypotheses(t.insights), ["page_id"], O.hypothesis_violations())


@query("record_insight_check", """
SELECT CASE WHEN category = 'heuristic' THEN 'friction' ELSE category END AS category, count(*) AS total, count_if(length(type) NOT BETWEEN 1 AND 50) AS bad_type, 0 AS bad_severity,
 count_if(length(issue) NOT BETWEEN 10 AND 500) AS bad_issue, count_if(length(recommendation) NOT BETWEEN 10 AND 500) AS bad_recommendation FROM insights GROUP BY 1""", uses="insights")
def record_insight_check(t):
    """Insights as if recorded by hand: 'custom' (here the heuristic ones) is filed under friction."""
    category = F.when(F.col("category") == "heuristic", "custom").otherwise(F.col("category"))
    rows = t.insights.withColumn("category", F.when(category == "custom", "friction").otherwise(category))
    return O.violations(rows, ["category"], O.recorded_violations())
