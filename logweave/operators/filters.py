"""Filtering rows: rule sets, time range, the view filter and saved presets.

Every filter is a single ``where`` on a Column, so Catalyst fuses it with the
parse projection and pushes what it can (e.g. ``path`` filters) to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.fields import PATH, FieldSpace, fields_of
from ..functions.timestamps import parse_bound, parse_timestamp
from ..plans import rules as R


def apply_filters(rows: DataFrame, rules: Sequence[R.Match], fs: FieldSpace | None = None,
                  spark=None) -> DataFrame:
    """Rows passing every rule (no rules: all rows)."""
    fs = fs or fields_of(rows)
    if not rules:
        return rows
    return rows.where(P.filters_predicate(rules, fs, spark))


def time_range(rows: DataFrame, timestamp_field: str | None, start: str | None, end: str | None,
               fs: FieldSpace | None = None) -> DataFrame:
    """Rows whose parsed timestamp lies in ``[start, end]``; no field or no bound -> all rows.

    A bound that does not parse counts as no bound.
    """
    fs = fs or fields_of(rows)
    lo, hi = parse_bound(start), parse_bound(end)
    if timestamp_field is None or (lo is None and hi is None):
        return rows
    return rows.where(P.time_range_predicate(parse_timestamp(fs.get(timestamp_field)), lo, hi))


def only_flagged(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("is_flagged"), F.lit(False)))


def view(rows: DataFrame, vf: R.ViewFilter, timestamp_field: str | None = None,
         fs: FieldSpace | None = None, spark=None) -> DataFrame:
    """The rows a log view shows under a view filter."""
    fs = fs or fields_of(rows)
    return rows.where(P.view_predicate(vf, fs, timestamp_field, spark=spark))


def visible_presets(presets: DataFrame, profile_name: str) -> DataFrame:
    """Presets for a profile: global ones plus those scoped to it (ignoring case)."""
    return presets.where(F.col("profile_scope").isNull() | (F.lower("profile_scope") == profile_name.lower()))


def preset_counts(rows: DataFrame, presets: Sequence[R.SavedView], timestamp_field: str | None = None,
                  fs: FieldSpace | None = None, spark=None, by: Sequence[str] = (PATH,)) -> DataFrame:
    """Rows each preset would show, per file, for all presets in one pass."""
    fs = fs or fields_of(rows)
    aggs = [F.count_if(P.view_predicate(p.view, fs, timestamp_field, spark=spark))
            .cast("long").alias(p.name) for p in presets]
    return rows.groupBy(*by).agg(*aggs)
