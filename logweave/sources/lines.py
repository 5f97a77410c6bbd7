"""Numbered lines from log files, line ranges, counts and the load cap.

``read_lines`` gives exact 1-based physical line numbers for whole folders of
files, split across many tasks, without a per-file window:

1. the text scan yields each line with its file, the byte offset of the split it
   came from (``_metadata.file_block_start``) and ``monotonically_increasing_id``
   taken straight on the scan -- consecutive within a split;
2. a tiny table ``(path, split) -> (min id, line count)`` gets a running sum of
   counts per file (one row per split, so the window is cheap);
3. line number = lines in earlier splits + (id - min id of the split) + 1.

No shuffle of line text happens: only the split table moves.  Both scans belong to
one plan, so they are cut into splits together whatever the settings were when the
frame was built; should the cuts differ all the same (cores that come or go between
two stages of a query, files that change meanwhile), the first line that does not
fit the split table ends the query with an error: no line is ever lost or
misnumbered silently.  ``numbered_once`` writes the scan and numbers what was
written, for lines that are read more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, TEXT
from ..plans.sizing import materialize

# Line terminators: \n, \r\n and \r all end a line (the text source's default).
# Broadcast the split table when it can take at most this many bytes (one row per
# file split, ~8 per GB of logs); else it is joined with a shuffle.
SPLIT_TABLE_BROADCAST_BYTES = 64 << 20
SPLIT_ROW_BYTES = 250


class LogFileNotFoundError(FileNotFoundError):
    pass


def plain_path(path: Column) -> Column:
    """A file path as the file listing gives it: ``_metadata.file_path`` is URI-encoded
    (``my%20app.log``), the listing is not (``my app.log``)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def text_reader(spark: SparkSession, recursive: bool = False, glob: str | None = None):
    reader = spark.read.format("text")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader


def _scan(spark: SparkSession, paths, encoding: str | None = None, line_sep: str | None = None,
          recursive: bool = False, glob: str | None = None) -> DataFrame:
    reader = text_reader(spark, recursive, glob)
    if encoding:
        reader = reader.option("encoding", encoding)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    df = reader.load(paths if isinstance(paths, list) else [paths])
    return df.select(
        plain_path(F.col("_metadata.file_path")).alias(PATH),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias(TEXT),
    )


def scan_raw(spark: SparkSession, paths, *, encoding: str | None = None, line_sep: str | None = None,
             recursive: bool = False, glob: str | None = None) -> DataFrame:
    """The text scan with each line's file, split offset and scan id (not yet numbered)."""
    try:
        return _scan(spark, paths, encoding, line_sep, recursive, glob)
    except Exception as exc:  # AnalysisException: PATH_NOT_FOUND
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            raise LogFileNotFoundError(str(exc).splitlines()[0]) from None
        raise


def split_stats(raw: DataFrame, *extra_aggs) -> DataFrame:
    """One row per ``(path, split)``: smallest scan id and line count (plus any
    extra per-split aggregates), aggregated map-side."""
    return raw.groupBy(PATH, "_split").agg(F.min("_id").alias("_min_id"), F.count(F.lit(1)).alias("_n"), *extra_aggs)


def _split_table_bytes(raw: DataFrame) -> int | None:
    """Upper bound of the split table's size from the scan's size; None when unknown."""
    try:
        spark = raw.sparkSession
        total = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        smallest = min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("openCostInBytes", "maxPartitionBytes"))
        return (total // max(1, smallest) + len(raw.inputFiles())) * SPLIT_ROW_BYTES
    except Exception:  # no access to the plan (a Connect session)
        return None


def _bytes(text: str) -> int:
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text.rstrip("kmgt")) << unit


def number_from_splits(raw: DataFrame, splits: DataFrame, broadcast_bytes: int = SPLIT_TABLE_BROADCAST_BYTES,
                       keep: tuple[str, ...] = (), known_bytes: int | None = None) -> DataFrame:
    """Join the split table (with running counts) back to the scan: exact line numbers.

    ``splits`` is a lazy aggregate of the same scan, or both come from a written scan.
    """
    w = Window.partitionBy(PATH).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    side = splits.select(PATH, "_split", "_min_id", "_n", *keep,
                         F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    size = _split_table_bytes(raw) if known_bytes is None else known_bytes
    if size is not None and size <= broadcast_bytes:
        side = F.broadcast(side)
    at = F.col("_id") - F.col("_min_id")
    fits = F.coalesce((at >= 0) & (at < F.col("_n")), F.lit(False))
    number = F.when(fits, F.col("_before") + at + 1).otherwise(
        F.raise_error(F.concat(F.lit("lines were counted over other splits than read: "), F.col(PATH))).cast("long"))
    return raw.join(side, [PATH, "_split"], "left").select(PATH, number.cast("long").alias(LINE), TEXT, *keep)


def read_lines(spark: SparkSession, paths, *, encoding: str | None = None, line_sep: str | None = None,
               recursive: bool = False, glob: str | None = None,
               broadcast_bytes: int = SPLIT_TABLE_BROADCAST_BYTES) -> DataFrame:
    """``(path, line_no, text)`` of every line of the given files, folders or globs.

    ``recursive``/``glob`` walk folders like the workspace scan.  ``path`` is the
    file's path as the workspace scan lists it.  Give the files wanted in ``paths``:
    a later filter on ``path`` drops rows but reads all files.  A missing file raises
    ``LogFileNotFoundError`` when the plan is built.
    """
    raw = scan_raw(spark, paths, encoding=encoding, line_sep=line_sep, recursive=recursive, glob=glob)
    return number_from_splits(raw, split_stats(raw), broadcast_bytes)


def scan_once(raw: DataFrame) -> tuple[DataFrame, int]:
    """The scan written to the shared folder, and the size of its split table."""
    written = materialize(raw)
    n = written.select(PATH, "_split").distinct().count()
    return written, n * SPLIT_ROW_BYTES


def numbered_once(spark: SparkSession, paths, **options) -> DataFrame:
    """``read_lines`` with a single scan: it is written and numbered from there."""
    written, size = scan_once(scan_raw(spark, paths, **options))
    return number_from_splits(written, split_stats(written), known_bytes=size)


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines per file (map-side partial count)."""
    return lines.groupBy(PATH).agg(F.count(F.lit(1)).cast("long").alias("line_count"))


def read_range(lines: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` lines from line ``start`` of every file (start < 1 -> 1; past the end -> empty)."""
    lo = max(int(start), 1)
    hi = lo + max(int(count), 0) - 1
    return lines.where((F.col(LINE) >= F.lit(lo)) & (F.col(LINE) <= F.lit(hi)))


def cap_lines(lines: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` lines of every file."""
    return lines.where(F.col(LINE) <= F.lit(cap))


def load_stats(lines: DataFrame, cap: int) -> DataFrame:
    """Per file: lines kept under the cap, total lines, and whether it was truncated."""
    g = lines.groupBy(PATH).agg(
        F.count_if(F.col(LINE) <= F.lit(cap)).cast("long").alias("loaded"),
        F.count(F.lit(1)).cast("long").alias("total_lines"))
    return g.withColumn("truncated", F.col("total_lines") > F.lit(cap))


def write_numbered(lines: DataFrame, out_dir: str, mode: str = "error") -> None:
    """Write numbered lines once as Parquet for repeated querying.

    Sorted within each task by ``(path, line_no)`` -- no shuffle: a task's lines
    are already runs of consecutive lines of its files -- so row-group statistics
    let later ``path`` / ``line_no`` filters (ranges, caps, detection samples)
    skip data.
    """
    lines.sortWithinPartitions(PATH, LINE).write.mode(mode).parquet(out_dir)
