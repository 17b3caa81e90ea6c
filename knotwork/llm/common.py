"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch.
BATCH_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage.

    The folder is the one the session names in spark.checkpoint.dir. Only where that is unset
    and the master is local a temporary one is taken; a cluster could not share it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="knotwork-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left: shuffle files, checkpoints, broadcasts and, in the driver's heap, their plans.

    Spark drops these when the driver happens to collect its garbage, so that many small steps fill
    any heap before that, however little of it is in use.
    """
    gc.collect()  # Python's handles keep the driver's objects
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't have, whatever their case."""
    taken, mark = {c.lower() for c in df.columns}, "__kw_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows and 64 MB and a row, so that a batch of long texts stays
    small and below the 2 GB that 32-bit offsets reach.

    Also names the folder of this package to Python workers, which inherit no path from a driver
    that was started elsewhere. Clusters get the package by --py-files as usual.
    """
    own = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if own not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [own, *paths]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column):
    """(memoryview of all bytes, int64 offsets) of an Arrow string array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return memoryview(data if data is not None else b""), at


def share_broadcast(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``limit``, else unchanged.

    Callers count first; beyond the limit the join shuffles.
    """
    return F.broadcast(df) if rows <= limit else df
