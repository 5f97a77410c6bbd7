"""Row tagging: flags (OR of rules) and colours (priority-ordered, last match wins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.fields import LINE, PATH, FieldSpace, fields_of
from ..plans import rules as R


def flag_rows(rows: DataFrame, rules: Sequence[R.Match] = R.DEFAULT_FLAGS,
              fs: FieldSpace | None = None, spark=None, out: str = "is_flagged") -> DataFrame:
    """Add ``is_flagged``: true when any rule matches the row (each line counted once)."""
    fs = fs or fields_of(rows)
    return rows.withColumn(out, P.flags_predicate(rules, fs, spark))


def flagged_lines(flagged: DataFrame) -> DataFrame:
    """Flagged ``(path, line_no)`` in file order (rows are unique per line, so each
    line appears once however many rules hit it)."""
    return flagged.where(F.col("is_flagged")).select(PATH, LINE).orderBy(PATH, LINE)


def flag_counts(flagged: DataFrame) -> DataFrame:
    """Flagged lines per file plus a grand-total row (``path`` NULL), via ``rollup``."""
    return flagged.rollup(PATH).agg(F.count_if(F.col("is_flagged")).cast("long").alias("flagged"))


def color_rows(rows: DataFrame, rules: Sequence[R.Paint] = R.DEFAULT_PAINTS,
               fs: FieldSpace | None = None, spark=None) -> DataFrame:
    """Add ``row_background`` and ``field_overrides`` (map field -> styling)."""
    fs = fs or fields_of(rows)
    return rows.withColumn("row_background", P.row_background(rules, fs, spark)).withColumn(
        "field_overrides", P.field_overrides(rules, fs, spark))


def highlight_table(colored: DataFrame) -> DataFrame:
    """One row per highlighted field: ``(path, line_no, field, foreground)``."""
    return colored.select(PATH, LINE, F.explode("field_overrides").alias("field", "style")).select(
        PATH, LINE, "field", F.col("style.foreground").alias("foreground"))

