"""Replies of a goal-driven run: steps, candidates, verdicts and collection checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import replies as RP


def _read(json, schema):
    return F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, schema))


def step_replies(replies: DataFrame) -> DataFrame:
    """Parsed step with ``ok``: every field is there and the action is named."""
    rows = replies.withColumn("step", _read(RP.extract_json_fenced(F.col("response")), RP.STEP_SCHEMA))
    fields = ["thinking", "evaluation_previous_goal", "memory", "next_goal", "action.name"]
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.col(f"step.{f}").isNotNull()
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def qa_replies(replies: DataFrame) -> DataFrame:
    """Verdict on a collection with one row per viewport to take again; unreadable replies count as valid."""
    rows = replies.select("event_id", _read(RP.braced_part(F.col("response")), RP.QA_SCHEMA).alias("qa"))
    numbered = F.filter("qa.recheck", lambda r: r["index"].isNotNull())
    out = rows.select("event_id", F.coalesce("qa.valid", F.lit(True)).alias("valid"), F.explode_outer(numbered).alias("r"))
    return out.select(
        "event_id", "valid", F.col("r.index").alias("viewport"),
        F.when(F.col("r").isNotNull(), F.coalesce("r.reason", F.lit("Needs verification"))).alias("reason"),
        F.when(F.col("r").isNotNull(), F.coalesce("r.hint", F.lit("wait_longer"))).alias("hint"))


def candidates(replies: DataFrame) -> DataFrame:
    """Scored actions a reply proposes."""
    rows = replies.select("event_id", "run_id", _read(RP.extract_json_object(F.col("response")), RP.CANDIDATES_SCHEMA).alias("c"))
    rows = rows.select("event_id", "run_id", F.explode("c.candidates").alias("c")).filter(
        F.col("c.toolName").isNotNull() & F.col("c.toolParams").isNotNull())
    return rows.select("event_id", "run_id", F.col("c.toolName").alias("tool"),
                       F.coalesce("c.toolParams.elementIndex", "c.toolParams.index").alias("element_index"),
                       F.when(F.col("c.selfScore").isNull(), 0.5).otherwise(N.clamp01(F.col("c.selfScore"))).alias("score"))


def dedupe_candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "tool", "element_index").agg(F.max("score").alias("score"))


def verdicts(replies: DataFrame) -> DataFrame:
    """Whether the goal is met; an unreadable verdict is no."""
    rows = replies.select("event_id", _read(RP.extract_json_object(F.col("response")), RP.VERDICT_SCHEMA).alias("v"))
    said = F.col("v.goalSatisfied").isNotNull()
    return rows.select("event_id", F.coalesce("v.goalSatisfied", F.lit(False)).alias("satisfied"),
                       F.when(said & F.col("v.confidence").isNotNull(), N.clamp01(F.col("v.confidence"))).otherwise(0.0).alias("confidence"))
