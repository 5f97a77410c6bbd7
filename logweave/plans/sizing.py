"""Materialising shared intermediates and size checks before broadcasting.

``materialize`` writes a frame once as Parquet into the shared folder the
session names in ``spark.checkpoint.dir`` and reads it back: the lineage is cut,
it survives executor loss, and later reads prune columns.  What was written stays
until ``remove_intermediates``, since frames built on it read it at any time.
``broadcast_if_small`` broadcasts a side only when its measured size in bytes is
under a bound; otherwise the plain (shuffle) join stays and AQE may still pick a
broadcast from measured shuffle sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

BROADCAST_BYTES = 64 << 20
_VALUE_BYTES = 16  # what a value takes in a row besides its text

_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For an intermediate that several branches of a plan read: without it every
    branch re-runs the whole lineage (scans, shuffles, windows).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/logweave-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


def remove_intermediates(spark: SparkSession) -> int:
    """Deletes what ``materialize`` wrote in this process; says how many tables.  Frames
    built on them can no longer be read."""
    removed = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def size_in_bytes(df: DataFrame) -> int:
    """Rough size of a small frame in memory, from its row count and the lengths of its texts."""
    texts = [F.sum(F.octet_length(F.col(f"`{f.name}`"))) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    n, *lengths = df.agg(F.count(F.lit(1)), *texts).first()
    return n * _VALUE_BYTES * len(df.columns) + sum(x or 0 for x in lengths)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, materialized: bool = True) -> DataFrame:
    """``broadcast(df)`` when it takes at most ``max_bytes``, else ``df``.

    With ``materialized`` the frame is written once first, so the measuring and the
    join read the same rows without computing them twice.
    """
    if materialized:
        df = materialize(df)
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df
