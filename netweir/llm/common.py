"""Pieces shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts the same runs.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a row group of the tables that cut lineage.
ROW_GROUP = 16 << 20
#: Whether the shuffle files of an action go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, *by: str) -> DataFrame:
    """Cut the lineage with a table of Parquet files in the cluster's shared folder, which takes far less room than a
    checkpoint of rows.  What was shuffled for the table is no longer needed when it is written, so those files go at once.

    The folder is the session's ``spark.checkpoint.dir``, or the one set on its context; only where neither is set, as
    in tests on one machine, a folder in the warehouse is used.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    # small row groups, so that tasks that write or read wide rows hold little of them
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", str(ROW_GROUP)).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) decided by the columns' values alone, so reruns and retries agree."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def text_key(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying its rows; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few whole texts as Python objects; memory that
    Arrow keeps for reuse goes back at the end of a task, as workers outlive their tasks."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
