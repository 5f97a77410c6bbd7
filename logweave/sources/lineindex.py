"""Line ranges of large files without reading the rest: a sparse table of lines per byte range.

``build_index`` counts the lines of every file's byte ranges once, in tasks of their own,
and keeps one small row per range: where it lies and how many lines come before it.
``read_lines_at`` then picks, by a filter on that table, the ranges that hold the wanted
lines and reads only those.  The table is an ordinary DataFrame: write it beside the
files and read it back as long as they only grow at the end; a file that is shorter than
when it was indexed is an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, TEXT
from ..session import ship_package
from . import fsio
from .encoding import _CHARSET, ANSI, _range_lines, _utf16_lines, decode_ansi

INDEX_BYTES = 8 << 20  # bytes of a file per row of the table; even, for UTF-16


def _owned(path: str, encoding: str | None, start: int, stop: int, length: int) -> list:
    """A range's lines: decoded of a UTF-16 file, else as bytes."""
    if encoding in _CHARSET:
        return _utf16_lines(path, _CHARSET[encoding], start, stop, length)
    return _range_lines(path, start, stop, length)


def build_index(files: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(path, encoding, length, start, stop, before, n) of files ``(path, length, encoding)``; a file
    without bytes has no row."""
    ship_package(files.sparkSession)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(index_bytes).cast("bigint"))
    ranges = files.where("length > 0").select(PATH, "encoding", F.col("length").cast("bigint").alias("length"), F.explode(starts).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + index_bytes, "length")).repartition(PATH, "start")

    def count(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(n=[len(_owned(r.path, r.encoding, int(r.start), int(r.stop), int(r.length))) for r in frame.itertuples(index=False)])

    counted = ranges.mapInPandas(count, f"{PATH} string, encoding string, length bigint, start bigint, stop bigint, n bigint")
    earlier = Window.partitionBy(PATH).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(PATH, "encoding", "length", "start", "stop", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "n")


def ranges_of(index: DataFrame, start: int, count: int) -> DataFrame:
    """The index rows whose ranges hold any of ``count`` lines from line ``start`` (< 1: from 1)."""
    low = max(int(start), 1)
    return index.where((F.col("before") < F.lit(low + max(int(count), 0) - 1)) & (F.col("before") + F.col("n") >= F.lit(low)))


def read_lines_at(index: DataFrame, start: int, count: int) -> DataFrame:
    """``(path, line_no, text)`` of ``count`` lines from line ``start`` of every indexed file; past the
    end there are none."""
    ship_package(index.sparkSession)
    low = max(int(start), 1)
    high = low + max(int(count), 0) - 1

    def read(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                if (fsio.size(r.path) or 0) < r.length:
                    raise OSError(f"shorter than when it was indexed: {r.path}")
                lines = _owned(r.path, r.encoding, int(r.start), int(r.stop), int(r.length))
                if len(lines) != r.n:
                    raise OSError(f"not as it was when it was indexed: {r.path}")
                at, to = max(0, low - 1 - int(r.before)), min(len(lines), high - int(r.before))
                if to <= at:
                    continue
                wide = r.encoding in _CHARSET
                yield pd.DataFrame({PATH: r.path, LINE: range(int(r.before) + at + 1, int(r.before) + to + 1), "encoding": r.encoding,
                                    "raw": [None] * (to - at) if wide else lines[at:to], "wide": lines[at:to] if wide else [None] * (to - at)})

    found = ranges_of(index, start, count).repartition(PATH, "start").mapInPandas(
        read, f"{PATH} string, {LINE} bigint, encoding string, raw binary, wide string")
    narrow = F.when(F.col("encoding") == ANSI, decode_ansi(F.col("raw"))).otherwise(F.col("raw").cast("string"))
    return found.select(PATH, LINE, F.coalesce("wide", narrow).alias(TEXT))
