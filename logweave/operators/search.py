"""Search: matches per row and field, next/previous match, nearest visible line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.fields import LINE, PATH, FieldSpace, fields_of
from ..plans import rules as R
from ..plans.carry import neighbors


def search(rows: DataFrame, q: R.SearchQuery, fs: FieldSpace | None = None, spark=None) -> DataFrame:
    """``(path, line_no, field, match_index)``: the first match in each field of each row.

    ``match_index`` is 0-based in UTF-16 units (``regexp_instr``).  Empty text
    matches nothing.
    """
    fs = fs or fields_of(rows)
    p = P.search_pattern(q, spark)
    if p is None:
        return rows.select(PATH, LINE, F.lit(None).cast("string").alias("field"),
                           F.lit(None).cast("int").alias("match_index")).where(F.lit(False))
    ents = fs.entries()
    if q.field is not None:
        ents = F.filter(ents, lambda e: e["key"] == F.lit(q.field))
    hits = F.filter(
        F.transform(ents, lambda e: F.struct(
            e["key"].alias("field"),
            (F.regexp_instr(e["value"], F.lit(p)) - 1).alias("match_index"))),
        lambda h: h["match_index"] >= 0)
    pre = rows.where(P.search_hit(q, fs, spark)) if not fs.is_map else rows
    return pre.select(PATH, LINE, F.inline(hits)).select(
        PATH, LINE, "field", F.col("match_index").cast("int").alias("match_index"))


def find_next_prev(rows: DataFrame, hit: Column, block_lines: int | None = None) -> DataFrame:
    """For every row, the next and previous hit line of its file, wrapping around.

    next = first hit after the row, else the first hit of the file (the row
    itself when it is the only one); previous mirrored.  NULL when the file has
    no hit.  Block-carried, so no file is one task.
    """
    kw = {"block_lines": block_lines} if block_lines else {}
    d = neighbors(rows, {"hit": F.when(hit, F.col(LINE))}, inclusive=False, wrap=True, **kw)
    return d.withColumn("next_match", F.coalesce("next_hit", "first_hit")).withColumn(
        "prev_match", F.coalesce("prev_hit", "last_hit")).drop("next_hit", "prev_hit", "first_hit", "last_hit")


def nearest_visible(rows: DataFrame, visible: Column, block_lines: int | None = None) -> DataFrame:
    """For every row, itself when visible, else the nearest visible line (tie -> smaller)."""
    kw = {"block_lines": block_lines} if block_lines else {}
    d = neighbors(rows, {"vis": F.when(visible, F.col(LINE))}, inclusive=True, **kw)
    line = F.col(LINE)
    before, after = F.col("prev_vis"), F.col("next_vis")
    pick = (F.when(before.isNull(), after)
            .when(after.isNull(), before)
            .when((line - before) <= (after - line), before)
            .otherwise(after))
    return d.withColumn("nearest_line", pick).drop("prev_vis", "next_vis")


def search_hidden(rows: DataFrame, q: R.SearchQuery, visible: Column, fs: FieldSpace | None = None,
                  spark=None) -> DataFrame:
    """All search hits over unfiltered rows, telling which the view filter hides."""
    fs = fs or fields_of(rows)
    return rows.where(P.search_hit(q, fs, spark)).select(PATH, LINE, (~F.coalesce(visible, F.lit(False))).alias("hidden"))
