"""Session settings the engine relies on."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Rule expressions are long. Above 8000 bytes HotSpot does not compile a method, so let Spark
    # fall back to split methods instead of one that stays interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key of a join is split also where an aggregate on the same key follows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A task that writes folders keeps this many files open before it sorts its rows by folder.
    "spark.sql.maxConcurrentOutputFileWriters": "24",
}

# Functions that SQL texts can call, e.g. noisy_or(array_agg(weight)).
FUNCTIONS = {
    "noisy_or(weights ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(array_sort(weights), 0D, (held, w) -> "
    "held + least(greatest(w, 0D), 1D) - held * least(greatest(w, 0D), 1D))",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Settings, and the functions for SQL, in the session's own catalog."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return spark
