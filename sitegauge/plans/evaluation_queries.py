"""Queries over model replies and evaluations."""

from pyspark.sql import functions as F

from ..functions import replies as RP
from ..operators import evaluations as E
from ..operators.insights import value_cut
from ..rules import heuristics as H
from ..rules import insights as I
from ..functions.text import word_similarity
from ..sources.knowledge import builtin_heuristics
from . import chunks
from . import sqltext as Q
from .catalog import query
from .text_queries import CATEGORY_SQL, PREFIX_SQL

KNOWN = list(H.heuristic_rows())
IDS = [r[2] for r in KNOWN]
DIM = Q.rows("h", "page_type, category, heuristic_id, h_severity, principle", KNOWN)


@query("dim_heuristics", f"""
SELECT h.page_type, h.category, h.heuristic_id, h.h_severity AS severity, count(e.seq) AS evaluations
FROM {DIM} LEFT JOIN evaluations e ON e.heuristic_id = h.heuristic_id GROUP BY ALL""", uses="evaluations")
def dim_heuristics(t):
    """The knowledge with how often each item was judged. Evaluations are counted before the join."""
    counts = t.evaluations.groupBy("heuristic_id").agg(F.count("*").alias("n"))
    dim = builtin_heuristics(t.spark).drop("principle")
    return dim.join(counts, "heuristic_id", "left").withColumn("evaluations", F.coalesce("n", F.lit(0))).drop("n")


@query("knowledge_counts", f"""
SELECT h.page_type, h.category, h.h_severity AS severity, count(DISTINCT h.heuristic_id) AS rules, count(e.seq) AS evaluations, min(h.heuristic_id) AS first_id
FROM {DIM} LEFT JOIN evaluations e ON e.heuristic_id = h.heuristic_id GROUP BY ALL""", uses="evaluations")
def knowledge_counts(t):
    """Rules by page type, category and severity, with the evaluations they got."""
    return dim_heuristics(t).groupBy("page_type", "category", "severity").agg(
        F.count("*").alias("rules"), F.sum("evaluations").alias("evaluations"), F.min("heuristic_id").alias("first_id"))


@query("filter_categories", f"""
SELECT category, severity, count(*) AS n FROM (SELECT h.category, h_severity AS severity FROM evaluations e JOIN {DIM} ON h.heuristic_id = e.heuristic_id) x
WHERE (contains(lower(category), 'pric') OR contains(lower(category), 'purchase')) AND NOT contains(lower(category), 'mobile') AND severity IN ('critical', 'high') GROUP BY ALL""", uses="evaluations")
def filter_categories(t):
    dim = builtin_heuristics(t.spark).select("heuristic_id", "category", "severity")
    rows = t.evaluations.drop("severity").join(dim, "heuristic_id")
    return E.filter_categories(rows, ["Pric", "Purchase"], ["Mobile"], "high").groupBy("category", "severity").agg(F.count("*").alias("n"))


@query("filter_min_confidence", "SELECT page_id, seq, status FROM evaluations WHERE status IN ('fail', 'partial') AND confidence >= 0.7", uses="evaluations")
def filter_min_confidence(t):
    return t.evaluations.filter(F.col("status").isin("fail", "partial") & (F.col("confidence") >= 0.7)).select("page_id", "seq", "status")


# ---------------------------------------------------------------- replies

FENCED_SQL = "nullif(trim(regexp_extract(response, '(?s)```(?:json)?\\s*(.*?)```', 1)), '')"
BRACED_SQL = "nullif(regexp_extract({0}, '(?s)(\\{{.*\\}})', 1), '')"
JSON_SQL = f"coalesce(trim({FENCED_SQL}, ' ' || chr(10)), {BRACED_SQL.format('response')}, trim(response))"


@query("extract_json", f"""
SELECT page_id, seq, md5(replace({JSON_SQL}, chr(10), '')) AS any_form, md5(replace(coalesce({FENCED_SQL}, trim(response)), chr(10), '')) AS fenced_form,
 md5({BRACED_SQL.format("regexp_replace(response, '```(json)?' || chr(10) || '?', '', 'g')")}) AS object_form FROM replies""", uses="replies")
def extract_json(t):
    r = F.col("response")

    def digest(c):
        return F.md5(F.replace(c, F.lit("\n"), F.lit("")))

    return t.replies.select("page_id", "seq", digest(RP.extract_json(r)).alias("any_form"),
                            digest(RP.extract_json_fenced(r)).alias("fenced_form"), F.md5(RP.extract_json_object(r)).alias("object_form"))


PARSED_SQL = f"""
WITH j AS (SELECT page_id, seq, CASE WHEN json_valid(js) THEN js END AS js FROM (SELECT page_id, seq, {JSON_SQL} AS js FROM replies) x),
p AS (SELECT page_id, seq, json_extract_string(js, '$.evaluations[0].heuristicId') AS heuristic_id, lower(json_extract_string(js, '$.evaluations[0].status')) AS st,
 CAST(json_extract_string(js, '$.evaluations[0].confidence') AS DOUBLE) AS c, json_extract_string(js, '$.evaluations[0].observation') AS observation FROM j WHERE js IS NOT NULL)
"""
STRICT_SQL = Q.case("st", {**I.STATUS_WORDS, **I.STRICT_EXTRA_STATUS})


@query("parse_evaluations", PARSED_SQL + f"""
SELECT page_id, seq, heuristic_id, {STRICT_SQL} AS status, CASE WHEN c > 1 AND c <= 100 THEN c / 100 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) END AS confidence, observation
FROM p WHERE {STRICT_SQL} IS NOT NULL
UNION ALL SELECT page_id, seq, NULL, 'unreadable', NULL, NULL FROM j WHERE js IS NULL""", uses="replies")
def parse_evaluations(t):
    """Evaluations of readable replies, and the unreadable replies marked as such."""
    rows = E.parsed_replies(t.replies, ["page_id", "seq"], RP.extract_json(F.col("response")))
    return E.reply_evaluations(rows, ["page_id", "seq"]).select(
        "page_id", "seq", "heuristic_id", F.when(F.col("unreadable"), "unreadable").otherwise(F.col("status")).alias("status"),
        "confidence", "observation")


CATEGORIES = ["CTA & Purchase Confidence", "Pricing & Cost Transparency", "Mobile Usability"]


@query("parse_batched_reply", f"""
WITH b AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'fail' WHEN event_type = 'view' THEN 'N/A' ELSE 'Passed' END AS st, event_id % 3 AS m FROM events)
SELECT event_id, category, CASE WHEN m = n THEN 'PDP-CTA-001' END AS heuristic_id, CASE WHEN m = n THEN {Q.case('lower(st)', I.STATUS_WORDS, 'not_applicable')} END AS status, m <> n AS missing
FROM b, (VALUES (0, '{CATEGORIES[0]}'), (1, '{CATEGORIES[1]}'), (2, '{CATEGORIES[2]}')) c(n, category)""")
def parse_batched_reply(t):
    status = F.when(F.col("event_type") == "click", "fail").when(F.col("event_type") == "view", "N/A").otherwise("Passed")
    name = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("event_id") % 3).cast("int"))
    reply = F.format_string('Sure: {"%s":{"evaluations":[{"heuristicId":"PDP-CTA-001","status":"%s","confidence":0.5}]}} done', name, status)
    return E.batched_evaluations(t.events.select("event_id", reply.alias("response")), ["event_id"], CATEGORIES)




@query("parse_step_reply", f"""
SELECT event_id, json_extract_string(j, '$.thinking') IS NOT NULL AND json_extract_string(j, '$.action.name') IS NOT NULL AS ok,
 json_extract_string(j, '$.action.name') AS action, json_extract_string(j, '$.next_goal') AS next_goal
FROM (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT event_id, coalesce(trim({FENCED_SQL}, ' ' || chr(10)), trim(response)) AS j FROM step_replies) s) v""", uses="step_replies")
def parse_step_reply(t):
    from ..operators import replies
    return replies.step_replies(t.step_replies).select("event_id", "ok", F.col("step.action.name").alias("action"), F.col("step.next_goal").alias("next_goal"))


@query("parse_qa_reply", f"""
WITH q AS (SELECT event_id, CASE WHEN json_valid({BRACED_SQL.format('response')}) THEN {BRACED_SQL.format('response')} END AS j FROM step_replies)
SELECT event_id, coalesce(TRY_CAST(json_extract_string(j, '$.valid') AS BOOLEAN), TRUE) AS valid, CAST(json_extract_string(j, '$.recheck[0].index') AS BIGINT) AS viewport,
 json_extract_string(j, '$.recheck[0].reason') AS reason, CASE WHEN json_extract_string(j, '$.recheck[0].index') IS NOT NULL THEN 'wait_longer' END AS hint FROM q""", uses="step_replies")
def parse_qa_reply(t):
    from ..operators import replies
    return replies.qa_replies(t.step_replies)


@query("parse_candidates", """
WITH c AS (SELECT event_id, user_id % 5 AS a, least(CAST(event_id % 15 AS DOUBLE) / 10, 1.0) AS sa, event_id % 5 AS b FROM events WHERE event_type = 'view')
SELECT event_id, 'hover' AS tool, 1 AS element_index, 0.5 AS score FROM c UNION ALL
SELECT event_id, 'click', a, CASE WHEN a = b THEN greatest(sa, 0.4) ELSE sa END FROM c UNION ALL SELECT event_id, 'click', b, 0.4 FROM c WHERE a <> b""")
def parse_candidates(t):
    """Candidates of a reply, the best self-score per tool and element."""
    from ..operators import replies
    return replies.dedupe_candidates(replies.candidates(t.step_replies), ["event_id"])


@query("dedupe_candidates", """
SELECT run_id, tool, element_index, max(score) AS score FROM (
 SELECT user_id AS run_id, 'hover' AS tool, 1 AS element_index, 0.5 AS score FROM events WHERE event_type = 'view' UNION ALL
 SELECT user_id, 'click', user_id % 5, least(CAST(event_id % 15 AS DOUBLE) / 10, 1.0) FROM events WHERE event_type = 'view' UNION ALL
 SELECT user_id, 'click', event_id % 5, 0.4 FROM events WHERE event_type = 'view') x GROUP BY ALL""")
def dedupe_candidates(t):
    from ..operators import replies
    return replies.dedupe_candidates(replies.candidates(t.step_replies), ["run_id"])


@query("parse_verification", """
SELECT event_id, event_type = 'purchase' AND event_id % 2 = 0 AS satisfied, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.25 END ELSE 0.0 END AS confidence FROM events""")
def parse_verification(t):
    from ..operators import replies
    return replies.verdicts(t.step_replies)


# ---------------------------------------------------------------- joins with the knowledge

@query("enrich_evaluations", f"SELECT seq, e.page_id, heuristic_id, h_severity AS severity, principle FROM evaluations e JOIN {DIM} USING (heuristic_id)", uses="evaluations")
def enrich_evaluations(t):
    return E.enrich(t.evaluations, builtin_heuristics(t.spark)).select("seq", "page_id", "heuristic_id", "severity", "principle")


@query("enrich_evaluations_lenient", f"""
SELECT seq, e.page_id, heuristic_id, coalesce(h_severity, 'medium') AS severity, coalesce(principle, '') AS principle FROM evaluations e LEFT JOIN {DIM} USING (heuristic_id)""", uses="evaluations")
def enrich_evaluations_lenient(t):
    return E.enrich(t.evaluations, builtin_heuristics(t.spark), True).select("seq", "page_id", "heuristic_id", "severity", "principle")


PDP_IDS = [i for i in IDS if i.startswith("PDP")]


@query("fill_missing_evaluations", f"""
SELECT page_id, heuristic_id, status, confidence FROM evaluations UNION ALL
SELECT p.page_id, i.id, 'not_applicable', 0.0 FROM (SELECT DISTINCT page_id FROM evaluations) p, {Q.rows('i', 'id', [(i,) for i in PDP_IDS])}
WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.page_id = p.page_id AND e.heuristic_id = i.id)""", uses="evaluations")
def fill_missing_evaluations(t):
    return E.fill_missing(t.evaluations, ["page_id"], PDP_IDS)


@query("completeness", f"""
SELECT page_id, {len(PDP_IDS)} - n AS missing, n = {len(PDP_IDS)} AS complete FROM
 (SELECT page_id, count(DISTINCT CASE WHEN heuristic_id IN {Q.in_list(PDP_IDS)} THEN heuristic_id END) AS n FROM evaluations GROUP BY page_id) x""", uses="evaluations")
def completeness(t):
    rows = E.missing_heuristics(t.evaluations, ["page_id"], PDP_IDS)
    return rows.select("page_id", F.size("missing").alias("missing"), (F.size("missing") == 0).alias("complete"))


# ---------------------------------------------------------------- merging and comparing

CLAIM = I.ABSENCE_CLAIM


@query("cross_validate", f"""
WITH c AS (SELECT *, {Q.case(PREFIX_SQL, I.HEURISTIC_ELEMENT)} AS element_type FROM evaluations WHERE status IN ('fail', 'not_applicable')),
n AS (SELECT page_id, element_type, count(*) AS found FROM boxes WHERE element_type IS NOT NULL GROUP BY ALL)
SELECT c.page_id, seq, element_type, found, (CAST(round(confidence * 100) AS BIGINT) + CAST(round(confidence * 100) AS BIGINT) % 2) / 2 / 100 AS new_confidence
FROM c JOIN n USING (page_id, element_type) WHERE regexp_matches(concat_ws(' ', observation, issue), '{CLAIM}')""", uses="evaluations boxes")
def cross_validate(t):
    return E.cross_validate(t.evaluations, t.boxes).select("page_id", "seq", "element_type", "found", "new_confidence")


REFS_SQL = """
r AS (SELECT page_id, seq, heuristic_id, status, unnest(regexp_extract_all(concat_ws(' ', observation, issue, recommendation), '(?i)\\[v\\d+-\\d+\\]')) AS ref FROM evaluations),
x AS (SELECT *, CAST(regexp_extract(ref, '(\\d+)-', 1) AS INT) AS rv, CAST(regexp_extract(ref, '-(\\d+)', 1) AS BIGINT) AS re FROM r)"""


@query("resolve_element_refs", f"""
WITH {REFS_SQL}, k AS (SELECT page_id, viewport_index AS rv, element_index AS re, arg_max(element_type, seq) FILTER (WHERE element_type IS NOT NULL) AS t FROM boxes GROUP BY ALL),
kk AS (SELECT page_id, viewport_index AS rv, element_index AS re, max(seq) AS ms FROM boxes GROUP BY ALL)
SELECT x.page_id, x.seq, ref, coalesce(b.element_type, 'unknown') AS element_type FROM x LEFT JOIN kk USING (page_id, rv, re)
LEFT JOIN boxes b ON b.page_id = x.page_id AND b.viewport_index = x.rv AND b.element_index = x.re AND b.seq = kk.ms""", uses="evaluations boxes")
def resolve_element_refs(t):
    return E.resolve_refs(t.evaluations, t.boxes).select("page_id", "seq", "ref", "element_type")


@query("element_status", f"""
WITH {REFS_SQL} SELECT page_id, rv AS ref_viewport, re AS ref_element, arg_min(status, seq) AS status, array_to_string(list_sort(list_distinct(list(heuristic_id))), ',') AS heuristics
FROM x GROUP BY ALL""", uses="evaluations")
def element_status(t):
    return E.element_status(t.evaluations).withColumn("heuristics", F.array_join("heuristics", ","))


MERGED_SQL = """m AS (SELECT page_id, heuristic_id, count(*) AS merged, arg_max(viewport_index, (confidence, -seq)) AS viewport_index, arg_max(status, (confidence, -seq)) AS status,
 arg_max(severity, (confidence, -seq)) AS severity, max(confidence) AS confidence, arg_max(seq, (confidence, -seq)) AS seq FROM evaluations GROUP BY ALL)"""
STATUS_COUNTS_SQL = ("count_if(status = 'pass') AS passed, count_if(status = 'fail') AS failed, count_if(status = 'partial') AS partial, count_if(status = 'not_applicable') AS not_applicable, "
                     + ", ".join(f"count_if(status IN ('fail', 'partial') AND severity = '{s}') AS {s}_issues" for s in I.SEVERITIES))


@query("merge_viewports", f"WITH {MERGED_SQL} SELECT * FROM m", uses="evaluations")
def merge_viewports(t):
    return E.merge_viewports(t.evaluations)


@query("evaluation_summary", f"SELECT page_id, count(*) AS total, {STATUS_COUNTS_SQL} FROM evaluations GROUP BY page_id", uses="evaluations")
def evaluation_summary(t):
    return E.evaluation_summary(t.evaluations)


@query("merge_summary", f"WITH {MERGED_SQL} SELECT page_id, count(*) AS total, {STATUS_COUNTS_SQL}, (sum(merged) - count(*)) / sum(merged) AS dedup_rate FROM m GROUP BY page_id", uses="evaluations")
def merge_summary(t):
    return E.merge_summary(t.evaluations)


@query("group_by_viewport", "SELECT page_id, viewport_index, count(*) AS evaluations, count(DISTINCT heuristic_id) AS heuristics FROM evaluations GROUP BY ALL", uses="evaluations")
def group_by_viewport(t):
    per_id = t.evaluations.groupBy("page_id", "viewport_index", "heuristic_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("page_id", "viewport_index").agg(F.sum("n").alias("evaluations"), F.count("*").alias("heuristics"))


@query("issue_evaluations", f"""
SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY {Q.case('severity', I.SEVERITY_RANK, 0)} DESC, confidence DESC, seq) AS place
FROM evaluations WHERE status IN ('fail', 'partial')""", uses="evaluations")
def issue_evaluations(t):
    """Order of the issues of a page. Severity makes the first cut, steps of confidence and then positions the others."""
    cut = [F.col("severity_turn"), *value_cut(F.col("confidence_turn"), 1000, 10**14)]
    order = ["severity_turn", "confidence_turn", "seq"]
    return chunks.row_index(E.issue_order(t.evaluations), ["page_id"], order, cut, "place").select("page_id", "seq", "place")


def last_of(run):
    return (f"arg_max({{0}}, seq) FILTER (WHERE run = '{run}')").format


COMPARED_SQL = f"""cmp AS (SELECT *, CASE WHEN bs IS NULL THEN 'missing_in_baseline' WHEN os IS NULL THEN 'missing_in_optimized' WHEN bs = os THEN 'match' ELSE 'differs' END AS verdict FROM
 (SELECT page_id, heuristic_id, {last_of('baseline')('status')} AS bs, {last_of('optimized')('status')} AS os, {last_of('baseline')('confidence')} AS bc, {last_of('optimized')('confidence')} AS oc FROM evaluations GROUP BY ALL) x)"""
C = I.DISCREPANCY_CAUSES
BETWEEN = "((bs = '{0}' AND os = '{1}') OR (bs = '{1}' AND os = '{0}'))".format
GRADED_SQL = f"""g AS (SELECT *, CASE WHEN {BETWEEN('pass', 'fail')} THEN 'critical' WHEN {BETWEEN('fail', 'partial')} THEN 'major' ELSE 'minor' END AS discrepancy,
 CASE WHEN {BETWEEN('pass', 'fail')} THEN CASE WHEN os = 'pass' THEN '{C["missed"]}' ELSE '{C["invented"]}' END WHEN {BETWEEN('fail', 'partial')} THEN '{C["fail_partial"]}'
 WHEN {BETWEEN('pass', 'partial')} THEN '{C["pass_partial"]}' WHEN abs(bc - oc) > 0.2 THEN '{C["confidence"]}' ELSE '{C["other"]}' END AS cause FROM cmp WHERE verdict = 'differs')"""


@query("compare_runs", f"WITH {COMPARED_SQL} SELECT page_id, heuristic_id, bs AS baseline_status, os AS optimized_status, bc AS baseline_confidence, oc AS optimized_confidence, verdict FROM cmp", uses="evaluations")
def compare_runs(t):
    return E.compare_runs(t.evaluations)


@query("classify_discrepancy", f"WITH {COMPARED_SQL}, {GRADED_SQL} SELECT page_id, heuristic_id, discrepancy, cause FROM g", uses="evaluations")
def classify_discrepancy(t):
    return E.classify_discrepancies(E.compare_runs(t.evaluations)).select("page_id", "heuristic_id", "discrepancy", "cause")


MATCH_SQL = f"""
WITH {COMPARED_SQL}, {GRADED_SQL}, s AS (SELECT page_id, count_if(verdict IN ('match', 'differs')) AS total, count_if(verdict = 'match') AS matching, count_if(verdict = 'missing_in_optimized') AS missing_in_optimized FROM cmp GROUP BY page_id),
d AS (SELECT page_id, count_if(discrepancy = 'critical') AS critical, count_if(discrepancy = 'major') AS major FROM g GROUP BY page_id),
q AS (SELECT s.*, coalesce(critical, 0) AS critical, coalesce(major, 0) AS major FROM s LEFT JOIN d USING (page_id)),
z AS (SELECT *, CASE WHEN total > 0 THEN matching / total ELSE 1.0 END AS match_rate, CASE WHEN total > 0 THEN (total - critical - major) / total ELSE 1.0 END AS effective_rate,
 concat_ws(',', CASE WHEN total > 0 AND (total - critical - major) * 100 < 80 * total THEN 'match rate' END, CASE WHEN critical > 0 THEN 'critical' END, CASE WHEN missing_in_optimized > 0 THEN 'missing' END) AS reasons FROM q)
"""


@query("quality_match", MATCH_SQL + "SELECT *, reasons = '' AS passed FROM z", uses="evaluations")
def quality_match(t):
    return E.quality_match(E.compare_runs(t.evaluations))


@query("match_recommendations", MATCH_SQL + """
SELECT page_id, coalesce(nullif(concat_ws('; ', CASE WHEN critical > 0 THEN 'review ' || CAST(critical AS VARCHAR) || ' flipped verdict(s)' END, CASE WHEN major > 0 THEN 'review ' || CAST(major AS VARCHAR) || ' change(s) of degree' END,
 CASE WHEN missing_in_optimized > 0 THEN CAST(missing_in_optimized AS VARCHAR) || ' heuristic(s) not evaluated, check the batches' END), ''), 'safe to use') AS advice FROM z""", uses="evaluations")
def match_recommendations(t):
    return E.match_recommendations(E.quality_match(E.compare_runs(t.evaluations))).select("page_id", "advice")


# ---------------------------------------------------------------- planning

NEED_ROWS = [(c, ",".join(map(str, w)) if w else "", m) for c, (w, m) in H.VIEWPORT_NEEDS.items()]
SELECTED_SQL = f"""sv AS (SELECT page_id, category, viewport_index, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY fits DESC, viewport_index) AS place FROM
 (SELECT page_id, viewport_index, category, most, wanted = '' OR list_contains(string_split(wanted, ','), CAST(viewport_index AS VARCHAR)) AS fits FROM viewports, {Q.rows('n', 'category, wanted, most', NEED_ROWS)}) a) b
 WHERE (fits AND place <= most) OR place = 1)"""


@query("select_viewports", f"WITH {SELECTED_SQL} SELECT * FROM sv", uses="viewports")
def select_viewports(t):
    return E.select_viewports(t.viewports)


BATCH_SQL = Q.case("category", {c: " + ".join(b) for b in H.CATEGORY_BATCHES for c in b})


@query("batch_categories", f"""
SELECT page_id, coalesce({BATCH_SQL}, category) AS batch, count(DISTINCT category) AS categories, count(*) AS evaluations
FROM (SELECT e.page_id, h.category FROM evaluations e JOIN {DIM} USING (heuristic_id)) x GROUP BY ALL""", uses="evaluations")
def batch_categories(t):
    """Batches a page's judged categories fall into: related ones together, others alone."""
    dim = builtin_heuristics(t.spark).select("heuristic_id", "category")
    per = t.evaluations.join(dim, "heuristic_id").groupBy("page_id", "category").agg(F.count("*").alias("n"))
    return per.groupBy("page_id", E.batch_of(F.col("category")).alias("batch")).agg(
        F.count("*").alias("categories"), F.sum("n").alias("evaluations"))


@query("batch_viewports", f"WITH {SELECTED_SQL} SELECT DISTINCT page_id, {BATCH_SQL} AS batch, viewport_index FROM sv", uses="viewports")
def batch_viewports(t):
    return E.select_viewports(t.viewports).select("page_id", E.batch_of(F.col("category")).alias("batch"), "viewport_index").distinct()


@query("evaluations_to_insights", f"""
SELECT page_id, seq, heuristic_id, {CATEGORY_SQL} AS category, severity, confidence, coalesce(nullif(issue, ''), observation) AS issue,
 CASE WHEN status = 'fail' THEN 'heuristic_fail' ELSE 'heuristic_partial' END AS plain_type, replace(lower(heuristic_id), '-', '_') AS type,
 'viewport_' || CAST(viewport_index AS VARCHAR) AS element, 'viewport_' || CAST(viewport_index AS VARCHAR) || '_scroll_' || CAST(viewport_index * 680 AS VARCHAR) AS scrolled_element,
 coalesce(nullif(recommendation, ''), CASE WHEN status = 'partial' THEN 'Review and improve: ' ELSE 'Address issue: ' END || coalesce(principle, '')) AS recommendation,
 coalesce(nullif(recommendation, ''), 'Review and address the issue') AS plain_recommendation
FROM evaluations LEFT JOIN (SELECT heuristic_id, principle FROM {DIM}) h USING (heuristic_id) WHERE status IN ('fail', 'partial')""", uses="evaluations")
def evaluations_to_insights(t):
    return E.evaluations_to_insights(t.evaluations, builtin_heuristics(t.spark))


WORDS_SQL = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\w\\s]', '', 'g'), '\\s+'), lambda w: w <> ''))".format


@query("jaccard", f"""
WITH c AS (SELECT page_id, heuristic_id, arg_max(observation, seq) FILTER (WHERE run = 'baseline') AS a, arg_max(observation, seq) FILTER (WHERE run = 'optimized') AS b FROM evaluations GROUP BY ALL),
w AS (SELECT *, {WORDS_SQL('a')} AS wa, {WORDS_SQL('b')} AS wb FROM c WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT page_id, heuristic_id, CASE WHEN a = b THEN 1.0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS similarity FROM w""", uses="evaluations")
def jaccard(t):
    """Shared words of what two runs observed for the same heuristic of a page."""
    def last(run):
        return F.max_by(F.when(F.col("run") == run, F.col("observation")), F.when(F.col("run") == run, F.col("seq")))

    rows = t.evaluations.groupBy("page_id", "heuristic_id").agg(last("baseline").alias("a"), last("optimized").alias("b"))
    return rows.filter("a IS NOT NULL AND b IS NOT NULL").select(
        "page_id", "heuristic_id", word_similarity(F.col("a"), F.col("b")).alias("similarity"))
