"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Model inputs by category, one folder each. The session lets a task keep a file open for each category, so the texts
    need no sort by category; row groups are small because all of these files have one in memory."""
    prompts.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).partitionBy("category").parquet(path)


def write_documents(documents: DataFrame, column: str, path: str, compression: str = "none") -> None:
    """Files of lines: each the row's other columns as tab-separated text before the document, which holds no line break. Files in
    gzip stay what ``write_in_order`` makes of them: one after the other they are one file in gzip."""
    keys = [F.col(c).cast("string") for c in documents.columns if c != column]
    documents.select(F.concat_ws("\t", *keys, column).alias("value")).write.mode("overwrite").option(
        "compression", compression).text(path)


def write_in_order(documents: DataFrame, order: list[str], column: str, path: str, compression: str = "none", dealt: bool = False) -> None:
    """As ``write_documents``, but the files one after the other hold the lines in ``order``: documents of many parts are whole when
    the files are concatenated. Rows are dealt by ranges, so one document may go over several tasks; ``dealt`` rows are so already,
    by the first columns of ``order``."""
    rows = documents if dealt else documents.repartitionByRange(*order)
    write_documents(rows.sortWithinPartitions(*order), column, path, compression)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``write_documents`` wrote; the document is the last column."""
    parts = F.split("value", "\t", len(schema))
    return spark.read.text(path).select(*[parts[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])
