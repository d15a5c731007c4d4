"""The heuristic knowledge: the built-in table, or JSON files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.heuristics import heuristic_rows

SCHEMA = "page_type STRING, category STRING, heuristic_id STRING, severity STRING, principle STRING"
FILE_SCHEMA = ("name STRING, description STRING, heuristics ARRAY<STRUCT<id:STRING,principle:STRING,"
               "checkpoints:ARRAY<STRING>,severity:STRING,category:STRING>>")


def builtin_heuristics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(heuristic_rows()), SCHEMA)


def read_heuristics(spark: SparkSession, path: str, page_type: str) -> DataFrame:
    """Category files ``{name, description, heuristics: [{id, principle, checkpoints, severity}]}``."""
    files = spark.read.schema(FILE_SCHEMA).option("multiLine", True).json(path)
    rows = files.select(F.lit(page_type).alias("page_type"), F.col("name").alias("category"), F.inline("heuristics"))
    return rows.select("page_type", "category", F.col("id").alias("heuristic_id"), "severity", "principle", "checkpoints")
