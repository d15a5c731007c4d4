"""Queries that make documents, and the streams."""

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import kept_sections
from ..operators import elements as E
from ..operators import evaluations as EV
from ..operators import evidence as V
from ..operators import insights as I
from ..operators import reports as O
from ..sources import sinks
from ..sources.knowledge import builtin_heuristics
from ..sources.shared import shared_folder, written
from ..streaming import live as L
from ..streaming import streams as S
from .catalog import query
from ..rules import elements as RE
from ..rules import insights as RI
from .evaluation_queries import DIM, SELECTED_SQL
from .html_queries import HASH_SQL, TITLE_SQL
from .insight_queries import HYPOTHESES_SQL, SCORE_SQL
from .quality_queries import CHECKED_SQL, METRICS_SQL, WARNINGS_SQL, metrics
from .step_queries import DECREMENT, VISITS_SQL, W, streak_sql
from .text_queries import DOMAIN_SQL
from .text_queries import TITLE_SQL as TITLE_CASE_SQL


def scores(t):
    return I.score_overall(t.page_facts, t.insights)


SCORE_FIELDS = ["critical_count", "high_count", "medium_count", "low_count", "overall"]
SCORES_SQL = f"sco AS ({SCORE_SQL})"


def json_of(fields) -> str:
    """DuckDB text of a JSON object."""
    return "json_object(" + ", ".join(f"'{name}', {value}" for name, value in fields) + ")"


def counts_of(kind, names):
    return json_of((n, f"coalesce(n.{kind}_{n}, 0)") for n in names)


COUNTED_SQL = "n AS (SELECT page_id, count(*) AS total, " + ", ".join(
    f"count_if({k} = '{x}') AS {k}_{x}" for k, names in (("severity", RI.SEVERITIES), ("category", RI.CATEGORIES), ("source", O.SOURCES))
    for x in names) + " FROM insights GROUP BY page_id)"
META_FIELDS = ["page_id", "url", "title", "page_type", "business_type"]
HEAD_SQL = json_of([
    ("meta", json_of([*((f, f"p.{f}") for f in META_FIELDS), ("version", "'1.0.0'")])),
    ("scores", json_of((f, f"CAST(sco.{f} AS BIGINT)") for f in SCORE_FIELDS)),
    ("insights", json_of([("total", "coalesce(n.total, 0)"), ("bySeverity", counts_of("severity", RI.SEVERITIES)),
                          ("byCategory", counts_of("category", RI.CATEGORIES)), ("bySource", counts_of("source", O.SOURCES))])),
    ("hypotheses", json_of([("total", "coalesce(h.total, 0)")]))])
ENTRY_FIELDS = ["severity", "category", "source", "type", "element", "issue", "recommendation", "heuristic_id", "confidence"]
TEST_FIELDS = ["id", "title", "hypothesis", "control", "treatment", "primary_metric", "impact", "priority"]


@query("export_report_json", f"""
WITH {HYPOTHESES_SQL}, {SCORES_SQL}, {COUNTED_SQL}, h AS (SELECT page_id, count(*) AS total FROM hyp GROUP BY page_id)
SELECT p.page_id, 0 AS section, 0 AS position, CAST({HEAD_SQL} AS VARCHAR) AS json FROM page_facts p JOIN sco USING (page_id) LEFT JOIN n USING (page_id) LEFT JOIN h USING (page_id)
UNION ALL SELECT page_id, 1, seq, CAST({json_of((f, f) for f in ENTRY_FIELDS)} AS VARCHAR) FROM insights
UNION ALL SELECT page_id, 2, place, CAST({json_of((f, f) for f in TEST_FIELDS)} AS VARCHAR) FROM hyp""", uses="insights page_facts")
def export_report_json(t):
    """Reports written as lines of JSON, and read back."""
    rows = O.report_json(t.page_facts, t.insights, scores(t), I.hypotheses(t.insights))
    path = f"{shared_folder(t.spark)}/reports"
    sinks.write_documents(rows, "json", path)
    return sinks.read_documents(t.spark, path, rows.schema)


MARK = "chr(10)"
INSIGHT_MD = ("concat_ws(chr(10), '### ' || " + TITLE_CASE_SQL.format("type") + ", '- Category: ' || category, '- Element: `' || coalesce(element, 'N/A') || '`', "
              "'- Issue: ' || issue, '- Recommendation: ' || recommendation, '- Heuristic: ' || heuristic_id)")
SUMMARY_MD = "concat_ws(chr(10), '# Page audit', '| Metric | Value |', '| --- | --- |', '| Overall score | ' || CAST(CAST(overall AS BIGINT) AS VARCHAR) || '/100 |', " + ", ".join(
    f"'| {s.title()} issues | ' || CAST({s}_count AS VARCHAR) || ' |'" for s in RI.SEVERITIES) + ")"
TEST_MD = ("concat_ws(chr(10), '### ' || id || ' ' || title, '- Control: ' || control, '- Treatment: ' || treatment, '- Metric: ' || primary_metric, "
           "'- Impact: ' || impact, '- Priority: ' || CAST(priority AS VARCHAR) || '/10')")


@query("export_report_md", f"""
WITH {HYPOTHESES_SQL}, {SCORES_SQL}
SELECT page_id, 0 AS section, -1 AS position, {SUMMARY_MD} AS text FROM sco
""" + "".join(f"UNION ALL SELECT page_id, {i}, -1, '## {s.title()} issues' FROM sco WHERE {s}_count > 0\n" for i, s in enumerate(RI.SEVERITIES, 1)) + f"""
UNION ALL SELECT page_id, list_position({RI.SEVERITIES}, severity), seq, {INSIGHT_MD} FROM insights
UNION ALL SELECT page_id, {len(RI.SEVERITIES) + 1}, -1, '## Recommended tests' FROM sco WHERE critical_count > 0 OR high_count > 0
UNION ALL SELECT page_id, {len(RI.SEVERITIES) + 1}, place, {TEST_MD} FROM hyp""", uses="insights page_facts")
def export_report_md(t):
    return O.report_markdown(t.insights, scores(t), I.hypotheses(t.insights))


ELEMENT_SQL = json_of([*((f, f"CAST({f} AS BIGINT)") for f in ("element_index", "x", "y", "w", "h")),
                       ("ref", "'[v' || CAST(viewport_index AS VARCHAR) || '-' || CAST(element_index AS VARCHAR) || ']'"),
                       ("element_type", "element_type"), ("confidence", "confidence"), ("viewports", "viewports")])
PACKAGE_HEAD_SQL = json_of([
    ("schemaVersion", "'1.0.0'"), ("page_id", "pw.page_id"), ("meta", json_of((f, f"p.{f}") for f in META_FIELDS[1:])),
    ("metrics", json_of([("has_structured", "has_structured"), *((f"n_{k}", f"n_{k}") for k in RE.ELEMENT_TYPES), ("elements", "elements"),
                         ("low_confidence", "low_confidence"), *((c, f"round(CAST({c} AS DOUBLE), 4)") for c in (
                             "box_coverage", "fold_coverage", "page_coverage", "price"))])), ("warnings", "warnings")])


@query("evidence_package", f"""
WITH {METRICS_SQL}, {WARNINGS_SQL},
el AS (SELECT *, element_index // 8 AS place, (row_number() OVER (PARTITION BY page_id, element_index // 8 ORDER BY element_index, x, y) - 1) // 2 AS part FROM de),
se AS (SELECT page_id, viewport_index, element_index // 8 AS part, list_sort(list(DISTINCT element_index)) AS elements FROM (SELECT page_id, unnest(viewports) AS viewport_index, element_index FROM de) u GROUP BY ALL)
SELECT pw.page_id, 0 AS section, 0 AS place, 0 AS part, CAST({PACKAGE_HEAD_SQL} AS VARCHAR) AS json FROM pw LEFT JOIN page_facts p USING (page_id)
UNION ALL SELECT page_id, 1, place, part, '[' || string_agg(CAST({ELEMENT_SQL} AS VARCHAR), ',' ORDER BY element_index, x, y) || ']' FROM el GROUP BY ALL
UNION ALL SELECT page_id, 2, viewport_index, coalesce(part, 0), CAST({json_of([("id", "'viewport-' || CAST(viewport_index AS VARCHAR)"), ("viewport_index", "viewport_index"), ("scroll_y", "scroll_y"), ("elements", "coalesce(elements, [])")])} AS VARCHAR)
 FROM viewports LEFT JOIN se USING (page_id, viewport_index)""", uses="viewports boxes page_facts")
def evidence_package(t):
    """Packages written as files in order, and read back; parts are small so that the pages at hand have several."""
    deduped = written(E.dedupe_boxes(E.together(t.boxes)))  # read by elements, viewports and metrics
    rows = O.evidence_package(t.page_facts, deduped, t.viewports, V.warnings(metrics(t, deduped=deduped)), band=8, most=2)
    path = f"{shared_folder(t.spark)}/packages"
    sinks.write_in_order(rows, ["page_id", "section", "place", "part"], "json", path, "gzip", dealt=True)
    return sinks.read_documents(t.spark, path, rows.schema)


SECTIONS_SQL = """ln AS (SELECT page_id, viewport_index, element_index, arg_min('[v' || CAST(viewport_index AS VARCHAR) || '-' || CAST(element_index AS VARCHAR) || '] ' || element_type || ' at ' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR), seq) AS line
  FROM boxes WHERE element_type IS NOT NULL GROUP BY ALL),
sec AS (SELECT page_id, viewport_index, '--- Viewport-' || CAST(viewport_index AS VARCHAR) || ' (scroll: ' || CAST(viewport_index * 680 AS VARCHAR) || 'px) ---' || chr(10) || string_agg(line, chr(10) ORDER BY element_index) AS section FROM ln GROUP BY page_id, viewport_index)"""
PROMPTS_SQL = f"""{SECTIONS_SQL}, {SELECTED_SQL},
ru AS (SELECT category, string_agg(r, chr(10) ORDER BY r) AS rules FROM (SELECT category, '[' || heuristic_id || '] (' || h_severity || ') ' || principle AS r FROM {DIM} WHERE page_type = 'pdp') d GROUP BY category),
px AS (SELECT page_id, category, string_agg(section, chr(10) || chr(10) ORDER BY viewport_index) AS sections FROM sv JOIN sec USING (page_id, viewport_index) GROUP BY ALL),
pr AS (SELECT page_id, category, concat_ws(chr(10), 'Category: ' || category, 'Page:', sections, 'Rules:', rules, 'Judge every rule and answer in JSON.') AS prompt FROM px JOIN ru USING (category))"""


@query("viewport_sections", f"WITH {SECTIONS_SQL} SELECT * FROM sec", uses="boxes")
def viewport_sections(t):
    return O.viewport_sections(t.boxes)


@query("filter_dom_sections", f"""
WITH {SECTIONS_SQL}, {SELECTED_SQL}, k AS (SELECT page_id, category, string_agg(section, chr(10) || chr(10) ORDER BY viewport_index) AS text FROM sv JOIN sec USING (page_id, viewport_index) GROUP BY ALL)
SELECT w.page_id, w.category, coalesce(k.text, '') AS text FROM (SELECT DISTINCT page_id, category FROM sv SEMI JOIN sec USING (page_id)) w LEFT JOIN k USING (page_id, category)""", uses="boxes viewports")
def filter_dom_sections(t):
    """A page's text, cut down to the viewports that each category needs."""
    sections = O.viewport_sections(t.boxes)
    ordered = F.array_sort(F.collect_list(F.struct("viewport_index", "section")))
    texts = sections.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["section"]), "\n").alias("text"))
    wanted = EV.select_viewports(t.viewports).groupBy("page_id", "category").agg(F.collect_set("viewport_index").alias("wanted"))
    # A text meets its page's categories in one row. Spark cannot know how many a page has, so it must not broadcast them.
    needs = wanted.groupBy("page_id").agg(F.collect_list(F.struct("category", "wanted")).alias("needs"))
    rows = needs.hint("merge").join(texts, "page_id").select("page_id", "text", F.explode("needs").alias("n"))
    return rows.select("page_id", "n.category", kept_sections(F.col("text"), F.col("n.wanted")).alias("text"))


def page_prompts(t):
    """Prompts of all categories of product pages."""
    dim = builtin_heuristics(t.spark).filter("page_type = 'pdp'")
    return O.prompts(O.viewport_sections(t.boxes), EV.select_viewports(t.viewports).drop("place"), dim)


@query("build_prompt", f"WITH {PROMPTS_SQL} SELECT * FROM pr", uses="boxes viewports")
def build_prompt(t):
    return page_prompts(t)


@query("audit_log_sink", f"WITH {PROMPTS_SQL} SELECT category, count(*) AS prompts, sum(length(prompt)) AS chars FROM pr GROUP BY ALL", uses="boxes viewports")
def audit_log_sink(t):
    """Prompts written by category and counted from what was written."""
    path = f"{shared_folder(t.spark)}/prompts"
    sinks.write_prompts(page_prompts(t), path)
    return t.spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("prompts"), F.sum(F.length("prompt")).alias("chars"))


@query("run_id", """
SELECT page_id, strftime(seen_at, '%Y-%m-%dT%H-%M-%S') || '-' || substr(md5(url), 1, 6) AS run_id FROM urls""", uses="urls")
def run_id(t):
    """Opaque id of an audit from its time and URL."""
    return t.urls.select("page_id", F.concat(F.date_format("seen_at", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), F.substring(
        F.md5("url"), 1, 6)).alias("run_id"))


# ---------------------------------------------------------------- streams

@query("stream_pages", f"SELECT page_id, {DOMAIN_SQL.format('url')} AS domain, {TITLE_SQL} AS title, {HASH_SQL} AS dom_hash FROM pages")
def stream_pages(t):
    return S.run_appended(S.page_facts(S.read_stream(t.spark, t.directory, "pages", t.files_per_trigger)))


def action_stream(t):
    """The events of the driver table as they land, in the shape of the step log without its step numbers."""
    from ..sources.fixtures import ACTIONS
    events = S.read_stream(t.spark, t.directory, "events", t.files_per_trigger)
    return S.with_time(t.spark.sql(ACTIONS, events=events), "ts", S.replay_delay(t.events, "ts"))


def line_stream(t, sql):
    """Lines as they land, in the shape of a derived table, with their shipping date as event time."""
    lines = t.spark.sql(sql.replace("FROM {lineitem}", ", l_shipdate FROM {lineitem}"), lineitem=S.read_stream(
        t.spark, t.directory, "lineitem", t.files_per_trigger))
    return S.with_time(lines, "l_shipdate", S.replay_delay(t.lineitem, "l_shipdate"))


@query("stream_actions", "SELECT event_id, run_id, tool_name, success FROM actions", uses="actions")
def stream_actions(t):
    return S.run_appended(action_stream(t).select("event_id", "run_id", "tool_name", "success"))


@query("stream_visit_loops", VISITS_SQL, uses="actions")
def stream_visit_loops(t):
    windows = S.run_updates(S.visit_loops(action_stream(t)), ["window", "run_id", "page"])
    return S.visits_so_far(windows).withColumn("loops", F.col("visits") >= 3)


def run_state(t):
    return S.run_state(S.run_updates(S.run_parts(action_stream(t)), ["window", "run_id", "stretch"]))


@query("stream_failure_streaks", f"""
WITH s AS (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER {W} AS f FROM {streak_sql('actions', 'NOT success')} x)
SELECT run_id, max(step) AS steps, max(f) AS failures, arg_max(in_a_row, step) AS in_a_row FROM s GROUP BY run_id""", uses="actions")
def stream_failure_streaks(t):
    return run_state(t).select("run_id", "steps", "failures", "in_a_row")


@query("stream_budget", f"""
SELECT run_id, count(*) AS steps, greatest(0, 1000 - sum({DECREMENT})) AS confidence_left, epoch_us(max(ts)) - epoch_us(min(ts)) AS elapsed_us FROM actions GROUP BY run_id""", uses="actions")
def stream_budget(t):
    return run_state(t).select("run_id", "steps", "confidence_left", "elapsed_us")


NODE_STREAM = "SELECT l_orderkey AS page_id, concat('/el[', CAST(l_linenumber AS VARCHAR(20)), ']') AS xpath FROM {lineitem}"


@query("stream_dedupe_nodes", "SELECT DISTINCT l_orderkey AS page_id, concat('/el[', CAST(l_linenumber AS VARCHAR), ']') AS xpath FROM lineitem")
def stream_dedupe_nodes(t):
    return S.run_appended(S.first_sightings(line_stream(t, NODE_STREAM)).select("page_id", "xpath"))


@query("stream_quality", """
SELECT page_id, strftime(date_trunc('day', l_shipdate), '%Y-%m-%d') AS day, count(*) AS viewports, sum(blank_images) AS blank, sum(loaded_images) AS loaded, sum(total_images) AS images, max(CAST(overlay AS INT)) AS overlay
FROM (SELECT l_orderkey AS page_id, l_shipdate, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 5 ELSE 0 END AS blank_images, CAST(l_quantity AS INT) AS total_images, CAST(l_quantity AS INT) - CAST(l_quantity AS INT) % 4 AS loaded_images, l_suppkey % 31 = 0 AS overlay FROM lineitem) s
GROUP BY ALL""")
def stream_quality(t):
    from ..sources.fixtures import SIGNALS
    rows = S.run_updates(S.quality_windows(line_stream(t, SIGNALS), "1 day"), ["window", "page_id"])
    return rows.select("page_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "viewports", "blank", "loaded", "images", "overlay")


@query("stream_recheck", f"WITH {CHECKED_SQL} SELECT page_id, seq, issues FROM cv WHERE severity = 'fail'", uses="signals")
def stream_recheck(t):
    """The viewports that a quality stream sends back for another look."""
    from ..sources.fixtures import SIGNALS
    return S.run_recheck(line_stream(t, SIGNALS))


def closed_log(t, operator):
    """The step log as a stream through a live operator, closed at its end."""
    from ..sources.fixtures import ACTIONS
    steps = t.spark.sql(ACTIONS, events=S.read_stream(t.spark, t.directory, "events", t.files_per_trigger))
    delay = S.replay_delay(t.events, "ts")
    last = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    end = last.select(F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("long").alias("event_id"),
                      (F.col("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(None).cast("boolean").alias("success"))
    return L.run_closed(steps.select("run_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "success"), operator, delay, end)


@query("stream_live_streaks", """
WITH o AS (SELECT run_id, event_id, success, ts, row_number() OVER w AS k, coalesce(ts >= lag(ts) OVER w + INTERVAL 1 DAY, TRUE) AS fresh FROM actions WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY run_id ORDER BY k) AS spell FROM o),
f AS (SELECT *, row_number() OVER w AS steps, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER w AS failures, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER w AS streak FROM s WINDOW w AS (PARTITION BY run_id, spell ORDER BY k)),
g AS (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, spell, streak ORDER BY k) AS in_a_row FROM f)
SELECT run_id, event_id, steps, failures, in_a_row, ended FROM g, (VALUES (FALSE), (TRUE)) AS e(ended)
WHERE NOT ended OR steps = (SELECT max(x.steps) FROM g x WHERE x.run_id = g.run_id AND x.spell = g.spell)""", uses="actions")
def stream_live_streaks(t):
    """A day of pause ends a spell, because the events of a user are hours apart."""
    rows = closed_log(t, lambda actions: L.failure_streaks(actions, "1 day"))
    return rows.select("run_id", "event_id", "steps", "failures", "in_a_row", "ended")


@query("stream_sessions", """
WITH g AS (SELECT run_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS n FROM actions),
s AS (SELECT run_id, ts, sum(n) OVER (PARTITION BY run_id ORDER BY ts) AS i FROM g)
SELECT run_id, epoch_us(max(ts)) - epoch_us(min(ts)) + 600000000 AS length_us, count(*) AS steps FROM s GROUP BY run_id, i""", uses="actions")
def stream_sessions(t):
    rows = closed_log(t, L.sessions)
    return rows.select("run_id", (F.unix_micros("end") - F.unix_micros("start")).alias("length_us"), "steps")
