"""Queries over step logs and message histories."""

from pyspark.sql import functions as F

from ..operators import steps as O
from ..rules import pages as RP
from ..rules import steps as R
from . import sqltext as Q
from .catalog import query

W = "(PARTITION BY run_id ORDER BY step)"
# What detecting failures reads of a step.
STATE = ("dom_hash", "url", "ax_text", "success", "tool_name", "error")
ERROR_PAGE, FORM_ERROR = RP.ERROR_PAGE, RP.FORM_ERROR
STATES_SQL = f"""st AS (SELECT *, lag(dom_hash) OVER {W} AS p_hash, lag(url) OVER {W} AS p_url, lag(ax_text) OVER {W} AS p_ax, lag(title) OVER {W} AS p_title,
 row_number() OVER (PARTITION BY run_id, dom_hash ORDER BY step) AS hash_count FROM actions)"""
FAILURES_SQL = f"""{STATES_SQL}, fl AS (SELECT *, CASE WHEN NOT success AND regexp_matches(error, '(?i)not found') THEN 'ELEMENT_NOT_FOUND'
 WHEN success AND tool_name NOT IN {Q.in_list(R.READ_ONLY_TOOLS)} AND p_hash = dom_hash THEN 'ACTION_HAD_NO_EFFECT' WHEN regexp_matches(url, '{ERROR_PAGE}') AND NOT regexp_matches(p_url, '{ERROR_PAGE}') THEN 'WRONG_PAGE'
 WHEN p_url IS NOT NULL AND regexp_matches(ax_text, '{FORM_ERROR}') AND NOT coalesce(regexp_matches(p_ax, '{FORM_ERROR}'), FALSE) THEN 'FORM_ERROR' WHEN step >= 2 AND hash_count >= 3 THEN 'REDIRECT_LOOP'
 WHEN url = 'about:blank' AND p_url <> 'about:blank' THEN 'PAGE_CRASHED' END AS failure FROM st)"""


def streak_sql(source, failed):
    return f"(SELECT *, step - coalesce(max(CASE WHEN NOT ({failed}) THEN step END) OVER {W}, 0) AS in_a_row FROM {source})"


@query("redirect_loop", f"WITH {STATES_SQL} SELECT run_id, step, hash_count FROM st WHERE hash_count >= 3", uses="actions")
def redirect_loop(t):
    return O.redirect_loop(t.steps("dom_hash")).select("run_id", "step", "hash_count")


@query("detect_failures", f"WITH {FAILURES_SQL} SELECT run_id, step, failure FROM fl", uses="actions")
def detect_failures(t):
    return O.detect_failures(t.steps(*STATE)).select("run_id", "step", "failure")


@query("route_failures", f"""
WITH {FAILURES_SQL} SELECT run_id, step, failure, in_a_row, CASE WHEN failure = 'ELEMENT_NOT_FOUND' AND in_a_row >= 3 THEN 'TERMINATE' ELSE {Q.case('failure', R.FAILURE_STRATEGY)} END AS strategy
FROM {streak_sql('fl', 'failure IS NOT NULL')} x WHERE failure IS NOT NULL""", uses="actions")
def route_failures(t):
    return O.route_failures(t.steps(*STATE)).select("run_id", "step", "failure", "in_a_row", "strategy")


@query("failure_streaks", f"""
SELECT run_id, step, in_a_row, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER {W} AS total_failures FROM {streak_sql('actions', 'NOT success')} x""", uses="actions")
def failure_streaks(t):
    return O.streaks(t.steps("success"), ~F.col("success"), "in_a_row", "total_failures").select("run_id", "step", "in_a_row", "total_failures")


@query("termination_reason", f"""
WITH e AS (SELECT *, max(CASE WHEN k % 19 = 0 THEN step END) OVER {W} AS d, least(100, step * 4) AS cov FROM {streak_sql('actions', 'NOT success')} x),
r AS (SELECT run_id, step, CASE WHEN d IS NOT NULL THEN CASE WHEN cov >= 100 THEN 'done' ELSE 'coverage incomplete (' || CAST(cov AS VARCHAR) || '%)' END WHEN step >= 30 THEN 'max steps' ELSE 'failures in a row' END AS reason
 FROM e WHERE step >= 30 OR in_a_row >= 3 OR (d IS NOT NULL AND cov >= 100))
SELECT run_id, steps, ended_at, reason FROM (SELECT run_id, max(step) AS steps FROM actions GROUP BY run_id) a LEFT JOIN (SELECT run_id, min(step) AS ended_at, arg_min(reason, step) AS reason FROM r GROUP BY run_id) b USING (run_id)""", uses="actions")
def termination_reason(t):
    rows = t.steps("success", "k").withColumns({"done": F.col("k") % 19 == 0, "coverage": F.least(F.lit(100), F.col("step") * 4)})
    return O.termination(rows, 30, 3)


ELAPSED = "epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run_id))"
TWENTY_DAYS_MS = 20 * 86_400_000


@query("elapsed_ms", f"SELECT run_id, step, {ELAPSED} AS elapsed_us FROM actions", uses="actions")
def elapsed_ms(t):
    return O.elapsed(t.steps("ts")).select("run_id", "step", "elapsed_us")


@query("budget_status", f"""
SELECT run_id, step, step >= 40 OR e >= {TWENTY_DAYS_MS}000 AS exceeded, CASE WHEN step >= 40 THEN 'steps' WHEN e >= {TWENTY_DAYS_MS}000 THEN 'time' END AS kind, greatest(0, 40 - step) AS steps_left,
 greatest(0, {TWENTY_DAYS_MS}000 - e) AS time_left_us, step * 10 >= 320 AS near_limit FROM (SELECT *, {ELAPSED} AS e FROM actions) x""", uses="actions")
def budget_status(t):
    return O.budget_status(t.steps("ts"), 40, TWENTY_DAYS_MS)


DECREMENT = "CASE WHEN progress_score > 0.6 THEN 25 WHEN progress_score < 0.3 THEN 100 ELSE 50 END"


@query("confidence_decay", f"""
SELECT run_id, step, greatest(0, 1000 - l) / 1000 AS confidence, greatest(0, 1000 - l) < 300 AS escalates FROM (SELECT *, sum({DECREMENT}) OVER {W} AS l FROM actions) x""", uses="actions")
def confidence_decay(t):
    return O.confidence_decay(t.steps("progress_score")).select("run_id", "step", "confidence", "escalates")


@query("should_verify", f"""
WITH {FAILURES_SQL}, v AS (SELECT *, step % 3 = 0 OR coalesce(url <> p_url, FALSE) AS verify FROM fl) SELECT run_id, step, verify, NOT verify AND failure IS NULL AS critique FROM v""", uses="actions")
def should_verify(t):
    return O.verification_plan(t.steps(*STATE)).select("run_id", "step", "verify", "critique")


ELEMENTS_SQL = "list_transform(range(n_elements + 1), lambda i: 'a:' || CAST(i * (k % 3 + 1) AS VARCHAR))"


@query("state_diff", f"""
WITH e AS (SELECT *, {ELEMENTS_SQL} AS el FROM actions), p AS (SELECT *, lag(el) OVER {W} AS pe, lag(url) OVER {W} AS p_url, lag(title) OVER {W} AS p_title, lag(dom_hash) OVER {W} AS p_hash FROM e)
SELECT run_id, step, url <> p_url AS url_changed, title <> p_title AS title_changed, dom_hash <> p_hash AS dom_changed, len(el) - len(pe) AS more_elements,
 array_to_string(list_filter(el, lambda x: NOT list_contains(pe, x))[1:5], ',') AS new_elements, array_to_string(list_filter(pe, lambda x: NOT list_contains(el, x))[1:5], ',') AS removed_elements FROM p WHERE p_url IS NOT NULL""", uses="actions")
def state_diff(t):
    seen = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n_elements")), lambda i: F.concat(
        F.lit("a:"), (i * (F.col("k") % 3 + 1)).cast("string")))
    return O.state_diff(t.steps("url", "title", "dom_hash", "n_elements", "k").withColumn("elements", seen))


@query("navigation_flag", f"SELECT run_id, step, coalesce(url <> lag(url) OVER {W}, FALSE) AS navigated FROM actions", uses="actions")
def navigation_flag(t):
    rows = O.with_previous(t.steps("url"), "url")
    return rows.select("run_id", "step", F.coalesce(F.col("url") != F.col("prev_url"), F.lit(False)).alias("navigated"))


GOALS = ['url contains "cart"', "title contains 'page 2'", 'shows "welcome"', "url contains login"]


@query("subgoal_progress", f"""
WITH RECURSIVE g AS (SELECT run_id, step, [contains(lower(url), 'cart'), contains(lower(title), 'page 2'), contains(lower(ax_text), 'welcome'), contains(lower(url), 'login')] AS met FROM actions),
w(run_id, step, goal, spent) AS (SELECT DISTINCT run_id, 0::BIGINT, 0, 0 FROM actions UNION ALL
 SELECT w.run_id, g.step, CASE WHEN goal < 4 AND (coalesce(met[goal + 1], FALSE) OR spent + 1 >= 5) THEN goal + 1 ELSE goal END,
  CASE WHEN goal = 4 OR coalesce(met[goal + 1], FALSE) OR spent + 1 >= 5 THEN 0 ELSE spent + 1 END FROM w JOIN g ON g.run_id = w.run_id AND g.step = w.step + 1)
SELECT * FROM w WHERE step > 0""", uses="actions")
def subgoal_progress(t):
    return O.subgoal_progress(t.steps("url", "title", "ax_text"), GOALS)


@query("prevalidate_actions", f"""
SELECT run_id, step, element_index FROM actions WHERE tool_name IN {Q.in_list(R.TARGETING_TOOLS)} AND element_index IS NOT NULL AND element_index >= n_elements""", uses="actions")
def prevalidate_actions(t):
    steps = t.steps("tool_name", "element_index", "n_elements")
    seen = steps.filter("n_elements > 0").select("run_id", "step", F.explode(
        F.sequence(F.lit(0), (F.col("n_elements") - 1).cast("int"))).alias("element_index"))
    return O.prevalidate(steps, seen).select("run_id", "step", "element_index")


@query("failed_combos", "SELECT run_id, tool_name, element_index, count(*) AS failed FROM actions WHERE NOT success GROUP BY ALL", uses="actions")
def failed_combos(t):
    return O.failed_combos(t.actions)


VISITS_SQL = "SELECT run_id, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '')) AS page, count(*) AS visits, count(*) >= 3 AS loops FROM actions GROUP BY ALL"


@query("visit_counts", VISITS_SQL, uses="actions")
def visit_counts(t):
    return O.visit_counts(t.actions)


@query("pages_seen", "SELECT run_id, url, min(step) AS first_step FROM actions GROUP BY ALL", uses="actions")
def pages_seen(t):
    return O.pages_seen(t.steps("url"))


@query("exclude_error_pages", f"SELECT run_id, step FROM actions WHERE NOT regexp_matches(url, '{ERROR_PAGE}')", uses="actions")
def exclude_error_pages(t):
    return t.steps("url").filter(~F.col("url").rlike(ERROR_PAGE)).select("run_id", "step")


@query("recent_memory", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM actions), f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM actions WHERE error IS NOT NULL)
SELECT a.run_id, steps, recent, errors FROM (SELECT run_id, count(*) AS steps FROM actions GROUP BY 1) a
JOIN (SELECT run_id, string_agg('Step ' || CAST(step AS VARCHAR) || ': ' || tool_name || CASE WHEN success THEN ' (ok)' ELSE ' (failed)' END, '; ' ORDER BY step) AS recent FROM r WHERE r <= 3 GROUP BY 1) b USING (run_id)
LEFT JOIN (SELECT run_id, string_agg(error, ', ' ORDER BY step) AS errors FROM f WHERE r <= 2 GROUP BY 1) c USING (run_id)""", uses="actions")
def recent_memory(t):
    return O.recent_memory(t.steps("tool_name", "success", "error"))


# ---------------------------------------------------------------- messages

@query("token_estimate", "SELECT conv_id, CAST(ceil(sum(length(text)) / 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimate(t):
    return O.message_summary(t.conversations).select("conv_id", "tokens")


@query("message_summary", """
SELECT conv_id, count_if(role = 'user') AS human, count_if(role = 'assistant') AS ai, count_if(role = 'system') AS system, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id""")
def message_summary(t):
    return O.message_summary(t.conversations).drop("tokens")


@query("trim_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) x WHERE r <= 2")
def trim_history(t):
    return O.trim_history(t.conversations, 1).select("conv_id", "turn", "role")


LINES_SQL = "ln AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS s, sum(length(text) + 1) OVER (PARTITION BY conv_id) AS t FROM conversations)"


def lines(t):
    return t.conversations.select("conv_id", "turn", F.col("text").alias("line"))


@query("token_budget_cut", f"""
WITH {LINES_SQL}, k AS (SELECT *, t - 1 <= 1200 OR s <= 1200 AS kept FROM ln) SELECT conv_id, count_if(kept) AS kept, count_if(NOT kept) AS omitted FROM k GROUP BY conv_id""")
def token_budget_cut(t):
    rows = O.token_budget_cut(lines(t), "conv_id", "turn", 300)
    return rows.groupBy("conv_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("omitted"))


@query("serialize_budget", f"""
WITH {LINES_SQL}, k AS (SELECT *, s - length(text) - 2 AS b, CAST(ceil((s - 1) / 4) AS BIGINT) AS tokens FROM ln)
SELECT conv_id, turn, tokens, tokens * 10 >= 1800 AS warned, tokens >= 300 AS stops FROM k WHERE b < 0 OR ceil(b / 4) < 300""")
def serialize_budget(t):
    return O.serialize_budget(lines(t), "conv_id", "turn", 300).select("conv_id", "turn", "tokens", "warned", "stops")
