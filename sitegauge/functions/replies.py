"""Reading JSON out of model replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"(?s)```(?:json)?\s*(.*?)```"

EVALUATIONS_SCHEMA = (
    "evaluations ARRAY<STRUCT<heuristicId:STRING,status:STRING,observation:STRING,issue:STRING,"
    "recommendation:STRING,reasoning:STRING,confidence:DOUBLE,elementRefs:ARRAY<STRING>>>,summary STRING")
STEP_SCHEMA = ("thinking STRING,evaluation_previous_goal STRING,memory STRING,next_goal STRING,"
               "action STRUCT<name:STRING,params:STRING>")
QA_SCHEMA = "valid BOOLEAN,notes STRING,recheck ARRAY<STRUCT<index:BIGINT,reason:STRING,hint:STRING>>"
CANDIDATES_SCHEMA = ("candidates ARRAY<STRUCT<toolName:STRING,toolParams:STRUCT<elementIndex:BIGINT,index:BIGINT>,"
                     "reasoning:STRING,expectedOutcome:STRING,selfScore:DOUBLE,risk:STRING>>")
VERDICT_SCHEMA = "goalSatisfied BOOLEAN,confidence DOUBLE,reasoning STRING"


def fenced_block(reply: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(reply, FENCED, 1)), F.lit(""))


def braced_part(reply: Column) -> Column:
    """First '{' to last '}'."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def extract_json(reply: Column) -> Column:
    """Fenced block, else the braced part, else the reply as it is."""
    return F.coalesce(fenced_block(reply), braced_part(reply), F.trim(reply))


def extract_json_fenced(reply: Column) -> Column:
    """Fenced block, else the whole reply."""
    return F.coalesce(fenced_block(reply), F.trim(reply))


def extract_json_object(reply: Column) -> Column:
    """Fence marks dropped, then the braced part; NULL when there is none."""
    return braced_part(F.regexp_replace(reply, r"```(json)?\n?", ""))
