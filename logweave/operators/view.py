"""View helpers: column visibility, line lookups, appending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.fields import LINE, PATH, fields_of, quoted


def show_columns(rows: DataFrame, visible: Sequence[str]) -> DataFrame:
    """Keep the row columns plus the visible field columns, in the given order."""
    fs = fields_of(rows)
    if fs.is_map:
        return rows
    fields = {fs.column_of(n) for n in fs.columns}
    keep = [quoted(c) for c in rows.columns if c not in fields]
    return rows.select(*keep, *[fs.get(n) for n in visible if n in fs.columns])


def hide_columns(rows: DataFrame, hidden: Sequence[str]) -> DataFrame:
    fs = fields_of(rows)
    return rows if fs.is_map else rows.drop(*[fs.column_of(n) for n in hidden if n in fs.columns])


def lookup_lines(rows: DataFrame, refs: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows at the given ``(path, line_no)`` references (semi join), or attach
    columns of ``refs`` to rows with ``how="left"``."""
    return rows.join(refs, [PATH, LINE], how)


def append_rows(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Bag union by column name (a page of newly loaded or streamed rows)."""
    return rows.unionByName(more, allowMissingColumns=True)
