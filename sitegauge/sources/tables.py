"""Reading the input tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import chunks
from .fixtures import DERIVED
from .shared import written

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations"]

# Event ids follow time, so a fixed width of ids cuts a long run into even pieces.
EVENT_CHUNK = 1_000_000
INSIGHT_CHUNK = 1_000_000
# Positions of the derived node table are spread; real document positions are dense.
DERIVED_NODE_CHUNK = 800_000 * 100_000 * 64
NODE_CHUNK = 50_000


class Tables:
    """Given and derived tables by name, e.g. ``Tables(spark, directory).nodes``."""

    #: Files that a stream takes at a time; none: all that are there. Results do not depend on it.
    files_per_trigger: int | None = None

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        if name in DERIVED:
            sql, needs = DERIVED[name]
            raw = self.spark.sql(sql, **{n: getattr(self, n) for n in needs})
            return SHAPES.get(name, lambda df: df)(raw)
        raise AttributeError(name)

    def steps(self, *columns: str) -> DataFrame:
        """``actions`` with the number of each step in its run, and of the other columns the named ones.

        Numbers are wanted by operators that pass over the log more than once, so the rows are written to the shared
        folder (a job that runs now)."""
        log = self.actions.select("run_id", "event_id", *columns)
        cut = [chunks.by_width(F.col("event_id"), EVENT_CHUNK)]
        return written(chunks.row_index(log, ["run_id"], ["event_id"], cut, "step"))


def _with_attributes(df: DataFrame) -> DataFrame:
    """Flat attribute columns become the ``attrs`` map that parsed HTML also has; empty ones are absent."""
    flat = {"class": "class_attr", "id": "id_attr", "role": "role_attr", "type": "type_attr",
            "name": "name_attr", "href": "href_attr", "aria-label": "label_attr", "src": "src_attr",
            "placeholder": "placeholder_attr"}
    pairs = [x for k, c in flat.items() for x in (F.lit(k), F.col(c))]
    pairs += [F.lit("required"), F.when(F.col("required_attr"), "required").otherwise(""),
              F.lit("onclick"), F.when(F.col("onclick_attr"), "go()").otherwise("")]
    return df.withColumn("attrs", F.map_filter(F.create_map(*pairs), lambda k, v: v != "")).drop(
        *flat.values(), "required_attr", "onclick_attr")


SHAPES = {"nodes": _with_attributes}
