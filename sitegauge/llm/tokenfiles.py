"""Token ids of documents as flat files, and their way back.

A part holds a contiguous run of documents in ascending id order, in three headerless little-endian files:
``part-N.ids`` (unsigned 16 bit where the vocabulary allows it, else 32), ``part-N.offsets`` (64 bit, where each document
starts in the part, and one more for the end) and ``part-N.docs`` (64-bit document ids). The manifest, a Parquet table,
has for each part its number of documents and tokens and its base: the prefix sum of the tokens of all parts before.
A document's start in the whole corpus is its part's base plus its offset.

A task writes under a name of its own and renames at the end, so a retried task replaces a part by the same bytes.
Ids go through memory a few megabytes at a time both ways; reading maps the files.

Nulls: a null text is empty (only the end id); a null document id sorts first and is kept as -2**63. Repeated rows stay,
in the order of their texts' hashes. An empty table gives a manifest without parts. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import coder

NO_ID = -2 ** 63
READ_TOKENS = 2_000_000


def _place(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    files, path = arrow_fs.FileSystem.from_uri(folder)
    return (arrow_fs.LocalFileSystem(use_mmap=True) if isinstance(files, arrow_fs.LocalFileSystem) else files), path


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` to each, and write the files and the manifest below ``folder``."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), common.whole(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(common.shuffle_partitions(docs), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _place(folder)
        files.create_dir(path, recursive=True)
        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        kinds = ("ids", "offsets", "docs")
        names = {k: f"{path}/part-{part:06d}.{k}" for k in kinds}
        encoder = coder(tokenizer)
        small = encoder.tokenizer.get_vocab_size() <= 2 ** 16 and end_id < 2 ** 16
        end, at, n_docs = np.array([end_id], "<u4"), 0, 0
        out = {k: files.open_output_stream(f"{names[k]}.{mark}") for k in kinds}
        for batch in batches:
            out["docs"].write(batch.column(0).to_numpy().astype("<i8").tobytes())
            offsets = np.empty(batch.num_rows, "<i8")
            for i, ids in enumerate(encoder.encode(batch.column(1))):
                out["ids"].write(np.append(ids, end).astype("<u2" if small else "<u4").tobytes())
                offsets[i] = at
                at += len(ids) + 1
            out["offsets"].write(offsets.tobytes())
            n_docs += batch.num_rows
        out["offsets"].write(np.array([at], "<i8").tobytes())
        for k in kinds:
            out[k].close()
            files.move(f"{names[k]}.{mark}", names[k])
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "n_docs": n_docs, "n_tokens": at, "width": 2 if small else 4}], schema=PART)

    parts = common.written(common.map_batches(dealt, write, "part long, n_docs long, n_tokens long, width int"))
    base = F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")  # one row per part
    parts.where("n_docs > 0").withColumn("base", base).write.mode("overwrite").parquet(f"{folder}/manifest")


PART = pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): each document's start in the corpus and its ids as little-endian unsigned 32 bit."""
    manifest = spark.read.schema("part long, n_docs long, n_tokens long, width int, base long").parquet(
        f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _place(folder)
        for batch in batches:
            for part in batch.to_pylist():
                name, n = f"{path}/part-{part['part']:06d}", part["n_docs"]
                with (files.open_input_file(f"{name}.ids") as ids, files.open_input_file(f"{name}.offsets") as starts,
                      files.open_input_file(f"{name}.docs") as docs):
                    offsets = np.frombuffer(starts.read_buffer(8 * (n + 1)), "<i8")
                    numbers = np.frombuffer(docs.read_buffer(8 * n), "<i8")
                    cuts = np.flatnonzero(np.diff(offsets[:-1] // READ_TOKENS)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                        first, last = int(offsets[a]), int(offsets[b])
                        raw = np.frombuffer(ids.read_buffer(part["width"] * (last - first)), f"<u{part['width']}")
                        bounds = pa.array((offsets[a:b + 1] - first) * 4, pa.int64())
                        flat = pa.py_buffer(raw.astype("<u4"))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(numbers[a:b], mask=numbers[a:b] == NO_ID),
                            pa.array(part["base"] + offsets[a:b]),
                            pa.Array.from_buffers(pa.large_binary(), b - a, [None, bounds.buffers()[1], flat])
                            .cast(pa.binary())], ["doc_id", "start", "ids"])

    dealt = manifest.repartition(common.shuffle_partitions(manifest), "part")
    return common.map_batches(dealt, read, "doc_id long, start long, ids binary")
