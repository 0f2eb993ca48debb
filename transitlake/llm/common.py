"""Shared helpers: scratch tables in the cluster's shared folder, Arrow text access, private column names."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words of the contracts: runs of anything but ASCII white space.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch, unless the session says otherwise: rows alone don't bound what a worker holds.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
#: Lets Spark delete a query's shuffle files when the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHIPPED: set[str] = set()
#: What operators keep in a worker from task to task.
KEPT: list[dict] = []


def importable(spark: SparkSession) -> None:
    """Send this package to the Python workers (once an application), and bound the batches they get: a setting of the session, put only where it has none."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"transitlake-{uuid.uuid4().hex}.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which all executors share. Where that is unset, a temporary folder in local mode, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("transitlake.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("transitlake.scratch", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to scratch and read back: cuts lineage, survives lost executors, gives the planner true sizes, and lets Spark delete the shuffle files that made it."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, with what it takes before them to differ from all columns of df, whatever their case."""
    have, mark = {c.lower() for c in df.columns}, "_"
    while any((mark + n).lower() in have for n in names):
        mark += "_"
    return [mark + n for n in names]


def alone(own: dict | None = None) -> None:
    """Let go of what operators other than the owner of `own` keep in this worker: workers outlive their tasks and stages."""
    others = [x for x in KEPT if x and x is not own]
    for x in others:
        x.clear()
    if others:
        gc.collect()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty. The offsets may start above zero."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(batches: Iterator[pa.RecordBatch], text: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of text or one row."""
    for batch in batches:
        at, _ = utf8(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
