"""Sorting rows: by level severity, by a field as text, by time, back to file order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, FieldSpace, fields_of
from ..functions.levels import STANDARD_LEVEL_ORDER, level_rank
from ..functions.timestamps import parse_timestamp
from ..plans.sizing import broadcast_if_small, materialize
from ..plans.carry import BLOCK_LINES, block_of, number_rows


@dataclass(frozen=True)
class SortState:
    """A saved sort: column name (``Line`` = line number) and direction."""

    column: str | None = None
    descending: bool = False


def with_level_rank(rows: DataFrame, level_field: str, order: Sequence[str] = STANDARD_LEVEL_ORDER,
                    fs: FieldSpace | None = None, out: str = "level_rank") -> DataFrame:
    fs = fs or fields_of(rows)
    return rows.withColumn(out, level_rank(fs.get(level_field), tuple(order)))


def sort_by_level(rows: DataFrame, level_field: str, order: Sequence[str] = STANDARD_LEVEL_ORDER,
                  descending: bool = False, fs: FieldSpace | None = None) -> DataFrame:
    """Severity order (unknown levels after all known; descending puts them first)."""
    r = with_level_rank(rows, level_field, order, fs)
    key = F.col("level_rank").desc() if descending else F.col("level_rank").asc()
    return r.orderBy(key, F.col(PATH), F.col(LINE))


def sort_by_field(rows: DataFrame, field: str, descending: bool = False, fs: FieldSpace | None = None) -> DataFrame:
    """Sort by a field's text (missing = ``''``), or by ``Line`` numerically."""
    fs = fs or fields_of(rows)
    if field == "Line":
        key = F.col(LINE)
        return rows.orderBy(key.desc() if descending else key.asc(), F.col(PATH))
    key = F.coalesce(fs.get(field), F.lit(""))
    return rows.orderBy(key.desc() if descending else key.asc(), F.col(PATH), F.col(LINE))


def sort_by_time(rows: DataFrame, timestamp_field: str, descending: bool = False,
                 fs: FieldSpace | None = None) -> DataFrame:
    """Chronological order of a Timestamp field (unparseable last)."""
    fs = fs or fields_of(rows)
    ts = parse_timestamp(fs.get(timestamp_field))
    key = ts.desc_nulls_last() if descending else ts.asc_nulls_last()
    return rows.orderBy(key, F.col(PATH), F.col(LINE))


def restore_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(PATH, LINE)


def sort_view(rows: DataFrame, state: SortState, level_field: str | None = None,
              level_order: Sequence[str] = STANDARD_LEVEL_ORDER, fs: FieldSpace | None = None) -> DataFrame:
    """Apply a saved sort; the level field sorts by severity, others as text."""
    if not state.column:
        return restore_order(rows)
    if level_field is not None and state.column == level_field:
        return sort_by_level(rows, level_field, level_order, state.descending, fs)
    return sort_by_field(rows, state.column, state.descending, fs)


def positions(ordered: DataFrame, out: str = "position") -> DataFrame:
    """1-based position of each row of an ordered frame, over all files.

    The sorted rows are written once; a task's rows are consecutive, so a table of
    one row per task (rows before it) turns the task's own numbering into positions.
    """
    numbered = materialize(ordered.select("*", F.spark_partition_id().alias("_lw_part"), F.monotonically_increasing_id().alias("_lw_id")))
    tasks = numbered.groupBy("_lw_part").agg(F.count(F.lit(1)).alias("_lw_n"), F.min("_lw_id").alias("_lw_first"))
    before = F.coalesce(F.sum("_lw_n").over(Window.orderBy("_lw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("_lw_part", "_lw_first", before.alias("_lw_before"))
    at = (F.col("_lw_before") + F.col("_lw_id") - F.col("_lw_first") + 1).cast("long")
    return numbered.join(broadcast_if_small(tasks), "_lw_part").withColumn(out, at).drop(
        "_lw_part", "_lw_id", "_lw_first", "_lw_before")


def level_positions(rows: DataFrame, level_field: str, order: Sequence[str] = STANDARD_LEVEL_ORDER,
                    fs: FieldSpace | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Position of each row within its file under severity order (ties by line).

    Numbered blockwise on ``(rank, line block)``: rank has few values, so the
    count table stays tiny while no file is numbered in one task.
    """
    r = with_level_rank(rows, level_field, order, fs)
    blk = F.col("level_rank").cast("long") * F.lit(1 << 40) + block_of(LINE, block_lines)
    return number_rows(r, [PATH], [F.col("level_rank"), F.col(LINE)], blk, out="sort_pos")


def first_lines(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every file (sample / preview); pushes down as a range filter."""
    return rows.where(F.col(LINE) <= F.lit(n))
