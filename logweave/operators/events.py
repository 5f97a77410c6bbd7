"""Multiline events: fold continuation lines (stack traces) into the event above.

A row whose **raw** text matches the new-event pattern (case-sensitive) starts an
event; the first row of a file always does.  The fold is gaps-and-islands: the
event of a row is the last start at or before it, found with the block-carried
forward fill (``plans.carry``) -- never a one-task window over a whole file.

Two levels are kept apart on purpose: per-line rows (flags and filters see every
physical line) and events (one row per primary line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, quoted
from ..functions.regex import java_regex
from ..plans.carry import neighbors


def assign_events(rows: DataFrame, new_event_pattern: str | None, text_col: str = "raw", spark=None,
                  block_lines: int | None = None) -> DataFrame:
    """Add ``event_line`` (primary line of the row's event) and ``is_primary``.

    No pattern: every row is its own event.
    """
    if not new_event_pattern:
        return rows.withColumn("event_line", F.col(LINE)).withColumn("is_primary", F.lit(True))
    p = java_regex(new_event_pattern, spark=spark)
    return assign_events_marked(rows, F.col(text_col).rlike(p), block_lines)


def assign_events_marked(rows: DataFrame, is_new: Column, block_lines: int | None = None) -> DataFrame:
    """``assign_events`` with the new-event test given as a column (e.g. a
    different pattern per file's profile; ``True`` makes every row an event)."""
    kw = {"block_lines": block_lines} if block_lines else {}
    d = neighbors(rows, {"start": F.when(F.coalesce(is_new, F.lit(False)), F.col(LINE))}, inclusive=True, head=True,
                  **kw)
    # rows before a file's first start belong to the event its first line opens
    d = d.withColumn("event_line", F.coalesce(F.col("prev_start"), F.col("part_head")))
    return d.drop("next_start", "prev_start", "part_head").withColumn(
        "is_primary", F.col("event_line") == F.col(LINE))


def events(assigned: DataFrame) -> DataFrame:
    """One row per event: the primary row's columns plus continuation count and last line.

    Only line numbers are aggregated (map-side, so one huge event costs one partial
    row per task); the primary rows take their event's numbers by a join.
    """
    numbers = assigned.groupBy(PATH, "event_line").agg(
        (F.count(F.lit(1)) - 1).cast("long").alias("n_continuations"), F.max(LINE).alias("last_line"))
    cols = [c for c in assigned.columns if c not in (PATH, "event_line", "is_primary")]
    g = assigned.where(F.col("is_primary")).join(numbers, [PATH, "event_line"])
    return g.select(PATH, "event_line", *[quoted(c) for c in cols],
                    "n_continuations", (F.col("n_continuations") > 0).alias("has_continuation"), "last_line")


def continuation_text(assigned: DataFrame, text_col: str = "raw", chunk_lines: int | None = None) -> DataFrame:
    """Continuation lines of each event joined by ``\\n``: ``(path, line_no, continuation_text)``.

    With ``chunk_lines`` an event of more lines gives several rows, numbered
    ``chunk`` from its first continuation on, for events too long for one string.
    """
    cont = assigned.where(~F.col("is_primary"))
    by = [PATH, "event_line"]
    if chunk_lines:
        cont = cont.withColumn("chunk", F.floor((F.col(LINE) - F.col("event_line") - 1) / F.lit(chunk_lines)).cast("long"))
        by.append("chunk")
    g = cont.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(LINE), F.col(text_col).alias("t")))).alias("_lw_parts"))
    return g.select(PATH, F.col("event_line").alias(LINE), *by[2:],
                    F.array_join(F.transform("_lw_parts", lambda x: x["t"]), "\n").alias("continuation_text"))


def attach_continuations(shown: DataFrame, assigned: DataFrame) -> DataFrame:
    """Displayed rows with the continuation count of the event they head (by primary line)."""
    ev = events(assigned).select(PATH, F.col("event_line").alias(LINE), "n_continuations", "has_continuation")
    return shown.join(ev, [PATH, LINE], "left")
