"""Step logs of goal-driven runs: ``actions(run_id, step, event_id, ts, tool_name, element_index, success,
error, dom_hash, url, title, ax_text, progress_score, ...)``, the state being that after the step.

A run may hold a third of all steps, so every ordered value goes through chunks of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.lookup import map_value
from ..plans import chunks
from ..rules import pages as P
from ..rules import steps as R
from ..sources.shared import written

STEP_CHUNK = 100_000
RUN, ORDER = ["run_id"], ["step"]


def cut(width: int = STEP_CHUNK) -> list[Column]:
    return [chunks.by_width(F.col("step"), width)]


def with_previous(actions: DataFrame, *columns: str) -> DataFrame:
    return chunks.previous(actions, RUN, ORDER, cut(), {f"prev_{c}": c for c in columns})


def hash_counts(actions: DataFrame) -> DataFrame:
    """How often the state of a step has been reached in its run so far."""
    return chunks.row_index(actions, ["run_id", "dom_hash"], ORDER, cut(), "hash_count")


def redirect_loop(actions: DataFrame) -> DataFrame:
    return hash_counts(actions).filter(F.col("hash_count") >= R.LOOP_VISITS)


def detect_failures(actions: DataFrame) -> DataFrame:
    """Kind of failure of each step, NULL when there is none; the order of the tests decides."""
    rows = with_previous(hash_counts(actions), "dom_hash", "url", "ax_text")
    first = F.col("prev_url").isNull()
    acted = F.col("success") & ~F.col("tool_name").isin(R.READ_ONLY_TOOLS)
    now_error, was_error = (F.coalesce(F.col(c).rlike(P.FORM_ERROR), F.lit(False)) for c in ("ax_text", "prev_ax_text"))
    kind = (F.when(~F.col("success") & F.coalesce(F.col("error").rlike("(?i)not found"), F.lit(False)), "ELEMENT_NOT_FOUND")
            .when(acted & F.coalesce(F.col("prev_dom_hash") == F.col("dom_hash"), F.lit(False)), "ACTION_HAD_NO_EFFECT")
            .when(~first & F.col("url").rlike(P.ERROR_PAGE) & ~F.col("prev_url").rlike(P.ERROR_PAGE), "WRONG_PAGE")
            .when(~first & now_error & ~was_error, "FORM_ERROR")
            .when((F.col("step") >= 2) & (F.col("hash_count") >= R.LOOP_VISITS), "REDIRECT_LOOP")
            .when(~first & (F.col("url") == "about:blank") & (F.col("prev_url") != "about:blank"), "PAGE_CRASHED"))
    return rows.withColumn("failure", kind)


def streaks(actions: DataFrame, failed: Column, out: str, total: str | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """Failures in a row up to each step (0 on a good step), failures so far as ``total``, and for each entry of ``last`` the
    latest step so far at which its condition held. All in one pass over the chunks."""
    marks = {"_good": ~failed, **(last or {})}
    c = chunks.Chunked(actions.withColumns({f"_at{n}": F.when(m, F.col("step")) for n, m in marks.items()}).withColumn(
        "_failed", failed.cast("int")), RUN, ORDER, cut())
    rows = c.attach({**{f"_part{n}": F.max(f"_at{n}") for n in marks}, "_n": F.sum("_failed")},
                    {**{f"_before{n}": (lambda b, w, n=n: F.max(f"_part{n}").over(b)) for n in marks},
                     "_total": lambda b, w: F.coalesce(F.sum("_n").over(b), F.lit(0))})
    so_far = c.so_far()
    rows = rows.withColumns({n: F.greatest(f"_before{n}", F.max(f"_at{n}").over(so_far)) for n in marks})
    if total:
        rows = rows.withColumn(total, F.col("_total") + F.sum("_failed").over(so_far))
    rows = rows.withColumn(out, F.col("step") - F.coalesce("_good", F.lit(0)))
    return c.drop_cuts(rows, *[f"{p}{n}" for n in marks for p in ("_at", "_before")], "_good", "_failed", "_total")


def route_failures(actions: DataFrame) -> DataFrame:
    """What to do about each failure; a missing element ends the run at the third failure in a row.

    A streak needs the failures first: they are written once, so that its two passes do not find them twice."""
    found = written(detect_failures(actions).select("run_id", "step", "failure"))
    rows = streaks(found, F.col("failure").isNotNull(), "in_a_row")
    worn = (F.col("failure") == "ELEMENT_NOT_FOUND") & (F.col("in_a_row") >= R.MAX_ELEMENT_RETRIES)
    return rows.filter(F.col("failure").isNotNull()).withColumn(
        "strategy", F.when(worn, "TERMINATE").otherwise(map_value(F.col("failure"), R.FAILURE_STRATEGY)))


def termination(actions: DataFrame, max_steps: int, failure_limit: int) -> DataFrame:
    """First step at which a run ends and why. ``done`` marks the step that reports it is done, ``coverage``
    the percent scanned by then; being done only counts once all is covered."""
    rows = streaks(actions, ~F.col("success"), "in_a_row", last={"_done": F.col("done")})
    done, covered = F.col("_done").isNotNull(), F.col("coverage") >= 100
    over, worn = F.col("step") >= max_steps, F.col("in_a_row") >= failure_limit
    reason = (F.when(done, F.when(covered, "done").otherwise(F.format_string("coverage incomplete (%d%%)", "coverage")))
              .when(over, "max steps").otherwise("failures in a row"))
    ends = rows.filter(over | worn | (done & covered)).withColumn("reason", reason)
    first = ends.groupBy("run_id").agg(F.min_by(F.struct("step", "reason"), "step").alias("e"))
    runs = actions.groupBy("run_id").agg(F.max("step").alias("steps"))
    return runs.join(first, "run_id", "left").select("run_id", "steps", F.col("e.step").alias("ended_at"), F.col("e.reason").alias("reason"))


def _milliseconds(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})")


def elapsed(actions: DataFrame) -> DataFrame:
    """Microseconds since the first step of the run."""
    c = chunks.Chunked(actions, RUN, ORDER, cut())
    rows = c.attach({"_t": F.min("ts")}, {"started": lambda b, w: F.min("_t").over(w)})
    return c.drop_cuts(rows.withColumn("elapsed_us", _milliseconds("started", "ts")))


def budget_status(actions: DataFrame, max_steps: int, max_ms: int) -> DataFrame:
    used, limit = F.col("elapsed_us"), max_ms * 1000
    steps_out, time_out = F.col("step") >= max_steps, used >= limit
    return elapsed(actions).select(
        "run_id", "step", (steps_out | time_out).alias("exceeded"), F.when(steps_out, "steps").when(time_out, "time").alias("kind"),
        F.greatest(F.lit(0), max_steps - F.col("step")).alias("steps_left"), F.greatest(F.lit(0), limit - used).alias("time_left_us"),
        (F.col("step") * 10 >= max_steps * 8).alias("near_limit"))


def decrement() -> Column:
    """Confidence lost in a step, in thousandths: half when it went well, double when badly."""
    return F.when(F.col("progress_score") > 0.6, 25).when(F.col("progress_score") < 0.3, 100).otherwise(50)


def confidence_decay(actions: DataFrame) -> DataFrame:
    rows = chunks.running_sum(actions, RUN, ORDER, cut(), decrement(), "_lost")
    left = F.greatest(F.lit(0), 1000 - F.col("_lost"))
    return rows.withColumns({"confidence": left / 1000, "escalates": left < 300}).drop("_lost")


def verification_plan(actions: DataFrame, every: int = 3) -> DataFrame:
    """Steps to verify (each third, and those that change the URL) and, of the others, those to critique."""
    rows = detect_failures(actions)
    verify = (F.col("step") % every == 0) | F.coalesce(F.col("url") != F.col("prev_url"), F.lit(False))
    return rows.withColumns({"verify": verify, "critique": ~verify & F.col("failure").isNull()})


def state_diff(actions: DataFrame, most: int = 5) -> DataFrame:
    """What changed since the step before; ``elements ARRAY<STRING>`` are the elements seen."""
    rows = with_previous(actions, "url", "title", "dom_hash", "elements").filter(F.col("prev_url").isNotNull())
    return rows.select(
        "run_id", "step", (F.col("url") != F.col("prev_url")).alias("url_changed"), (F.col("title") != F.col("prev_title")).alias("title_changed"),
        (F.col("dom_hash") != F.col("prev_dom_hash")).alias("dom_changed"), (F.size("elements") - F.size("prev_elements")).alias("more_elements"),
        F.array_join(F.slice(F.array_except("elements", "prev_elements"), 1, most), ",").alias("new_elements"),
        F.array_join(F.slice(F.array_except("prev_elements", "elements"), 1, most), ",").alias("removed_elements"))


def prevalidate(actions: DataFrame, perceived: DataFrame) -> DataFrame:
    """Targeting steps whose element is not among ``perceived(run_id, step, element_index)``."""
    targeting = actions.filter(F.col("tool_name").isin(R.TARGETING_TOOLS) & F.col("element_index").isNotNull())
    return targeting.join(perceived, ["run_id", "step", "element_index"], "left_anti")


def failed_combos(actions: DataFrame) -> DataFrame:
    return actions.filter(~F.col("success")).groupBy("run_id", "tool_name", "element_index").agg(F.count("*").alias("failed"))


def visit_counts(actions: DataFrame) -> DataFrame:
    """Visits per normalized URL, and whether that is a loop."""
    return actions.groupBy("run_id", U.normalize_url(F.col("url")).alias("page")).agg(
        F.count("*").alias("visits")).withColumn("loops", F.col("visits") >= R.LOOP_VISITS)


def pages_seen(actions: DataFrame) -> DataFrame:
    """Distinct URLs of a run with the step of their first sight."""
    return actions.groupBy("run_id", "url").agg(F.min("step").alias("first_step"))


def _latest(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Last ``limit`` rows per key; Spark cuts to them before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def recent_memory(actions: DataFrame, steps: int = 3, errors: int = 2) -> DataFrame:
    """Steps taken, the last three of them and the last two errors per run, as text."""
    def joined(rows, text, sep):
        pieces = F.array_sort(F.collect_list(F.struct("step", text.alias("t"))))
        return rows.groupBy("run_id").agg(F.array_join(F.transform(pieces, lambda x: x["t"]), sep).alias("_text"))

    step_text = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(": "), "tool_name", F.when(F.col("success"), " (ok)").otherwise(" (failed)"))
    last = joined(_latest(actions, "run_id", "step", steps), step_text, "; ").withColumnRenamed("_text", "recent")
    failed = _latest(actions.filter(F.col("error").isNotNull()), "run_id", "step", errors)
    errs = joined(failed, F.col("error"), ", ").withColumnRenamed("_text", "errors")
    total = actions.groupBy("run_id").agg(F.count("*").alias("steps"))
    return total.join(last, "run_id").join(errs, "run_id", "left")


# ---------------------------------------------------------------- sub-goals

def goal_met(criterion: str) -> Column:
    """'url contains x', 'title contains x', or a quoted phrase in the page text."""
    import re
    low = criterion.lower()
    for name in ("url", "title"):
        m = re.search(name + r"\s+contains?\s+[\"']?([^\"']+)", low)
        if m:
            return F.lower(name).contains(m.group(1).strip())
    phrases = re.findall(r'"([^"]+)"', low) or re.findall(r"'([^']+)'", low)
    met = F.lit(False)
    for p in phrases:
        met = met | F.lower("ax_text").contains(p.strip())
    return F.coalesce(met, F.lit(False))


def subgoal_progress(actions: DataFrame, criteria: list[str], patience: int = 5) -> DataFrame:
    """Sub-goal a run works on after each step: the next one once the criterion is met, or after ``patience`` steps.

    ``step`` numbers the steps of a run from 1 without gaps, as ``Tables.steps`` does. Each goal takes at most ``patience``
    steps, so a run of any length is past its last goal after goals x patience of them. Only so many rows of a run are
    shuffled and walked, as one short array; all later steps have the final state and stay where they lie.
    """
    goals = len(criteria)
    horizon = goals * patience
    met = F.array(*[goal_met(criterion) for criterion in criteria]) if criteria else F.array().cast("array<boolean>")

    def after(walk, x):
        """``walk`` with the state after step ``x`` at its end."""
        last = F.element_at(walk, -1)
        over, moves_on = last["goal"] >= goals, F.get(x["met"], last["goal"]) | (last["spent"] + 1 >= patience)
        return F.concat(walk, F.array(F.struct(
            x["step"].alias("step"), F.when(~over & moves_on, last["goal"] + 1).otherwise(last["goal"]).alias("goal"),
            F.when(over | moves_on, 0).otherwise(last["spent"] + 1).alias("spent"))))

    begun = F.array(F.struct(F.lit(0).cast("bigint").alias("step"), F.lit(0).alias("goal"), F.lit(0).alias("spent")))
    early = actions.filter(F.col("step") <= horizon).select("run_id", F.struct("step", met.alias("met")).alias("x"))
    walked = early.groupBy("run_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(
        "run_id", F.inline(F.slice(F.aggregate("xs", begun, after), 2, horizon)))
    late = actions.filter(F.col("step") > horizon).select("run_id", "step", F.lit(goals).alias("goal"), F.lit(0).alias("spent"))
    return walked.unionByName(late)


# ---------------------------------------------------------------- message histories and budgets

def message_summary(messages: DataFrame) -> DataFrame:
    """Messages by role, the last of them, and the token estimate (four characters a token)."""
    return messages.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("human"), F.count_if(F.col("role") == "assistant").alias("ai"),
        F.count_if(F.col("role") == "system").alias("system"), F.max_by("text", "turn").alias("last"),
        F.floor((F.sum(F.length("text")) + 3) / 4).cast("bigint").alias("tokens"))


def trim_history(messages: DataFrame, most: int) -> DataFrame:
    return _latest(messages, "conv_id", "turn", max(2, most))


def _lengths(lines: DataFrame, key: str, order: str, width: int) -> DataFrame:
    return chunks.running_sum(lines, [key], [order], [chunks.by_width(F.col(order), width)], F.length("line") + 1, "_sum", total="_total")


def token_budget_cut(lines: DataFrame, key: str, order: str, max_tokens: int, width: int = 10_000) -> DataFrame:
    """Lines that fit the budget, counting a newline each; all of them when the text as a whole fits."""
    most = max_tokens * 4
    rows = _lengths(lines, key, order, width)
    return rows.withColumn("kept", (F.col("_total") - 1 <= most) | (F.col("_sum") <= most)).drop("_sum", "_total")


def serialize_budget(lines: DataFrame, key: str, order: str, max_tokens: int, width: int = 10_000) -> DataFrame:
    """Lines up to and including the one that reaches the budget; from 60% of it on a warning is due."""
    rows = _lengths(lines, key, order, width)
    before = F.col("_sum") - F.length("line") - 2
    tokens = F.floor((F.col("_sum") - 1 + 3) / 4)
    kept = rows.filter((before < 0) | (F.floor((before + 3) / 4) < max_tokens))
    return kept.withColumns({"tokens": tokens.cast("bigint"), "warned": tokens * 10 >= max_tokens * 6, "stops": tokens >= max_tokens}).drop("_sum", "_total")
