"""Order-dependent work along a file without a one-task-per-file window.

A log file is a sequence; several operators need "the last X before this line"
or "the n-th line": event folding, find-next/previous, nearest visible line,
line numbering, positions in a sort.  A window partitioned by ``path`` alone
would put a whole file -- possibly a third of the data -- into one task.

Instead every sequence is cut into **blocks** of a bounded number of lines.  The
row-level window runs per ``(path, block)``; what crosses a block edge is a tiny
per-block summary (one row per block), whose own window over ``path`` is cheap,
and which is joined back on ``(path, block)``.  The join reuses the row side's
hash partitioning on ``(path, block)``; AQE broadcasts the summary when its
measured size is under the broadcast threshold and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines per block.  Bounds the rows any single window task sees.
BLOCK_LINES = 1 << 20

_UNB_PRE = Window.unboundedPreceding
_UNB_FOL = Window.unboundedFollowing


def block_of(order: Column | str, block_lines: int = BLOCK_LINES) -> Column:
    """Block id of a 1-based position (monotone in the position)."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor((order - F.lit(1)) / F.lit(block_lines)).cast("long")


def neighbors(
    df: DataFrame,
    markers: dict[str, Column],
    part: Sequence[str] = ("path",),
    order: str = "line_no",
    *,
    inclusive: bool = True,
    wrap: bool = False,
    head: bool = False,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """For each marker ``m`` (a column, non-NULL on marked rows) add

    * ``prev_m`` -- the marker value of the nearest marked row at or before the
      row (strictly before when ``inclusive=False``);
    * ``next_m`` -- the same looking forward;
    * with ``wrap=True`` also ``first_m`` / ``last_m`` over the whole partition;
    * with ``head=True`` also ``part_head``, the partition's smallest ``order``.
    """
    part = list(part)
    blk = "_lw_blk"
    d = df.withColumn(blk, block_of(order, block_lines))
    for m, c in markers.items():
        d = d.withColumn(f"_lw_v_{m}", c)
    # both ways by frames that only grow: Spark keeps a running value for them, while a
    # frame from the current row to the end is computed anew for every row
    hi = 0 if inclusive else -1
    forth = Window.partitionBy(*part, blk).orderBy(order).rowsBetween(_UNB_PRE, hi)
    back = Window.partitionBy(*part, blk).orderBy(F.desc(order)).rowsBetween(_UNB_PRE, hi)
    for m in markers:
        d = d.withColumn(f"_lw_ip_{m}", F.last(f"_lw_v_{m}", ignorenulls=True).over(forth))
    for m in markers:
        d = d.withColumn(f"_lw_in_{m}", F.last(f"_lw_v_{m}", ignorenulls=True).over(back))

    # one summary row per (part, block): the block's first and last marked value
    aggs = []
    for m in markers:
        v = F.col(f"_lw_v_{m}")
        key = F.when(v.isNotNull(), F.col(order))
        aggs += [F.max_by(v, key).alias(f"_lw_bl_{m}"), F.min_by(v, key).alias(f"_lw_bf_{m}")]
    if head:
        aggs.append(F.min(order).alias("_lw_bmin"))
    summary = d.groupBy(*part, blk).agg(*aggs)
    wb = Window.partitionBy(*part).orderBy(blk)
    wb_back = Window.partitionBy(*part).orderBy(F.desc(blk)).rowsBetween(_UNB_PRE, -1)
    carry_cols = []
    if head:
        summary = summary.withColumn("part_head", F.min("_lw_bmin").over(Window.partitionBy(*part)))
        carry_cols.append("part_head")
    for m in markers:
        summary = summary.withColumn(
            f"_lw_cp_{m}", F.last(f"_lw_bl_{m}", ignorenulls=True).over(wb.rowsBetween(_UNB_PRE, -1)))
        summary = summary.withColumn(
            f"_lw_cn_{m}", F.last(f"_lw_bf_{m}", ignorenulls=True).over(wb_back))
        carry_cols += [f"_lw_cp_{m}", f"_lw_cn_{m}"]
        if wrap:
            summary = summary.withColumn(
                f"_lw_wf_{m}", F.first(f"_lw_bf_{m}", ignorenulls=True).over(wb.rowsBetween(_UNB_PRE, _UNB_FOL)))
            summary = summary.withColumn(
                f"_lw_wl_{m}", F.last(f"_lw_bl_{m}", ignorenulls=True).over(wb.rowsBetween(_UNB_PRE, _UNB_FOL)))
            carry_cols += [f"_lw_wf_{m}", f"_lw_wl_{m}"]
    summary = summary.select(*part, blk, *carry_cols)

    out = d.join(summary, [*part, blk], "left")
    for m in markers:
        out = out.withColumn(f"prev_{m}", F.coalesce(F.col(f"_lw_ip_{m}"), F.col(f"_lw_cp_{m}")))
        out = out.withColumn(f"next_{m}", F.coalesce(F.col(f"_lw_in_{m}"), F.col(f"_lw_cn_{m}")))
        if wrap:
            out = out.withColumn(f"first_{m}", F.col(f"_lw_wf_{m}")).withColumn(f"last_{m}", F.col(f"_lw_wl_{m}"))
    return out.drop(*[c for c in out.columns if c.startswith("_lw_")])


def number_rows(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    out: str = "line_no",
) -> DataFrame:
    """1-based position of each row within ``part`` under ``order``.

    ``block`` must be monotone in ``order`` (a coarser key of the same order) and
    bound the rows per ``(part, block)``.  Positions = rows in earlier blocks
    (prefix sum over a per-block count table) + ``row_number`` inside the block.
    """
    part = list(part)
    blk = "_lw_nblk"
    d = df.withColumn(blk, block)
    w = Window.partitionBy(*part, blk).orderBy(*order)
    d = d.withColumn("_lw_rn", F.row_number().over(w))
    counts = d.groupBy(*part, blk).agg(F.count(F.lit(1)).alias("_lw_n"))
    wb = Window.partitionBy(*part).orderBy(blk).rowsBetween(_UNB_PRE, -1)
    offsets = counts.select(*part, blk, F.coalesce(F.sum("_lw_n").over(wb), F.lit(0)).alias("_lw_off"))
    res = d.join(offsets, [*part, blk], "left")
    return res.withColumn(out, (F.col("_lw_off") + F.col("_lw_rn")).cast("long")).drop(blk, "_lw_rn", "_lw_off")
