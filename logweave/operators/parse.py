"""Parsing lines into rows: raw, delimited, regex, several profiles at once.

Input: a **lines** frame ``(path, line_no, text)``.  Output: a **rows** frame
``(path, line_no, raw, is_parsed, <fields>)`` -- flat columns for one profile,
or a ``fields`` map when files use different profiles.  A line that does not
parse is never dropped: it keeps only ``RawText``.  All of it is Column algebra
inside one projection (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import FIELDS, LINE, PARSED, PATH, RAW, RAW_KEY, TEXT, FieldSpace, field_columns, marked
from ..functions.regex import translate, validate
from ..plans.profile import DELIMITED_KIND, RAW_KIND, REGEX_KIND, InvalidProfileError, LogProfile

# separator used to carry all groups of one regex match through one replace;
# rows that already contain it take the exact per-group path instead
_SEP = "\u0001"
_REGEX_META = set(".$|()[]{}^?*+\\")


def split_pattern(delimiter: str) -> str:
    """Java ``split`` pattern matching the delimiter literally.

    A single character is backslash-escaped (Java's split fast path); longer
    delimiters are quoted.
    """
    if len(delimiter) == 1:
        return "\\" + delimiter if delimiter in _REGEX_META else delimiter
    return "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# ---- single profile, flat columns ------------------------------------------------
def _pre_split(lines: DataFrame, profile: LogProfile, spark=None) -> tuple[DataFrame, Column, list[tuple[str, Column]]]:
    """Project the per-row work that every field reads (the split, or the one regex
    rewrite) into its own column first.  Catalyst keeps a non-trivial column that
    is read several times as a separate projection, so it runs once per row
    instead of once per field."""
    text = F.col(TEXT)
    if profile.kind == DELIMITED_KIND:
        d = lines.select("*", text.contains(profile.delimiter).alias("_lw_ok"),
                         F.split(text, split_pattern(profile.delimiter), -1).alias("_lw_parts"))
        ok, parts = F.col("_lw_ok"), F.col("_lw_parts")
        fields = [(name, F.when(ok, F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))))
                  for i, name in enumerate(profile.field_names)]
        return d, ok, fields
    jp = translate(profile.pattern, explicit_capture=True)
    if spark is not None:
        validate(spark, jp)
    ngroups = len(jp.group_names)
    wrapped = "^(?s:.*?)(?:" + jp.pattern + ")(?s:.*)$"
    repl = "".join(_SEP + f"${i}" for i in range(1, ngroups + 1))
    has_sep = text.contains(_SEP)
    d = lines.select("*", F.when(~has_sep, F.regexp_replace(text, wrapped, repl)).alias("_lw_packed"))
    packed = F.col("_lw_packed")
    d = d.select("*", F.coalesce(packed.startswith(_SEP), text.rlike(jp.pattern)).alias("_lw_ok"),
                 F.split(F.expr("substring(_lw_packed, 2)"), _SEP, -1).alias("_lw_groups"))
    ok, groups = F.col("_lw_ok"), F.col("_lw_groups")

    def pick(idx: list[int], get) -> Column:
        vals = [get(i) for i in idx]
        if len(vals) == 1:
            return F.coalesce(vals[0], F.lit(""))
        return F.coalesce(*[F.when(v != "", v) for v in reversed(vals)], F.lit(""))

    fields = []
    for name, idx in jp.named_groups():
        fast = pick(idx, lambda i: F.try_element_at(groups, F.lit(i)))
        exact = pick(idx, lambda i: F.regexp_extract(text, jp.pattern, i))
        fields.append((name, F.when(ok, F.when(packed.isNull(), exact).otherwise(fast))))
    return d, ok, fields


def parse_lines(lines: DataFrame, profile: LogProfile, spark=None) -> DataFrame:
    """Parse every line with one profile; flat field columns + ``RawText``."""
    profile.validate(spark)
    text = F.col(TEXT)
    keep = [c for c in lines.columns if c not in (TEXT,)]
    if profile.kind == RAW_KIND:
        return lines.select(*keep, text.alias(RAW), F.lit(True).alias(PARSED), marked(text, RAW_KEY, RAW_KEY))
    if profile.kind not in (DELIMITED_KIND, REGEX_KIND):
        raise InvalidProfileError(f"unknown kind {profile.kind}")
    d, ok, fields = _pre_split(lines, profile, spark)
    values = dict(fields)
    if RAW_KEY not in values:
        values[RAW_KEY] = F.when(~ok, text)
    column = field_columns(list(values), keep)
    return d.select(*keep, text.alias(RAW), ok.alias(PARSED), *[marked(c, n, column[n]) for n, c in values.items()])


def parse_raw(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, LogProfile.raw())


def parse_delimited(lines: DataFrame, delimiter: str, field_names: Sequence[str]) -> DataFrame:
    return parse_lines(lines, LogProfile.delimited(delimiter, field_names))


def parse_regex(lines: DataFrame, pattern: str, spark=None) -> DataFrame:
    return parse_lines(lines, LogProfile.regex(pattern), spark)


# ---- several profiles, map column -------------------------------------------------
def parse_with_profiles(rows_in: DataFrame, profiles: Mapping[str, LogProfile], profile_col: str = "profile",
                        spark=None) -> DataFrame:
    """Parse each line with the profile named in ``profile_col`` (NULL/unknown -> raw).

    One CASE per profile inside a projection; the profile table is config-sized,
    so the plan grows with the number of profiles, not the data.  The split (for
    delimited profiles) and the one-pass regex rewrite (for regex profiles) are
    projected once per row, chosen by the row's profile, and every field reads
    them from there.
    """
    text = F.col(TEXT)
    prof = F.col(profile_col)
    parts_expr = F.lit(None).cast("array<string>")
    packed_expr = F.lit(None).cast("string")
    compiled = {}
    for name, p in profiles.items():
        p.validate(spark)
        hit = prof == F.lit(name)
        if p.kind == DELIMITED_KIND:
            parts_expr = F.when(hit, F.split(text, split_pattern(p.delimiter), -1)).otherwise(parts_expr)
        elif p.kind == REGEX_KIND:
            jp = translate(p.pattern, explicit_capture=True)
            if spark is not None:
                validate(spark, jp)
            compiled[name] = jp
            wrapped = "^(?s:.*?)(?:" + jp.pattern + ")(?s:.*)$"
            repl = "".join(_SEP + f"${i}" for i in range(1, len(jp.group_names) + 1))
            packed_expr = F.when(hit & ~text.contains(_SEP), F.regexp_replace(text, wrapped, repl)).otherwise(packed_expr)
    d = rows_in.select("*", parts_expr.alias("_lw_parts"), packed_expr.alias("_lw_packed"))
    d = d.select("*", F.split(F.expr("substring(_lw_packed, 2)"), _SEP, -1).alias("_lw_groups"))
    parts, packed, groups = F.col("_lw_parts"), F.col("_lw_packed"), F.col("_lw_groups")

    raw_map = F.create_map(F.lit(RAW_KEY), text)
    ok_expr, map_expr = F.lit(True), raw_map
    for name, p in profiles.items():
        hit = prof == F.lit(name)
        if p.kind == DELIMITED_KIND:
            ok = text.contains(p.delimiter)
            kv = [x for i, n in enumerate(p.field_names)
                  for x in (F.lit(n), F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")))]
        elif p.kind == REGEX_KIND:
            jp = compiled[name]
            ok = F.coalesce(packed.startswith(_SEP), text.rlike(jp.pattern))
            kv = []
            for n, idx in jp.named_groups():
                fast = [F.try_element_at(groups, F.lit(i)) for i in idx]
                exact = [F.regexp_extract(text, jp.pattern, i) for i in idx]
                pick_fast = fast[0] if len(fast) == 1 else F.coalesce(*[F.when(v != "", v) for v in reversed(fast)])
                pick_exact = exact[0] if len(exact) == 1 else F.coalesce(
                    *[F.when(v != "", v) for v in reversed(exact)])
                kv += [F.lit(n), F.coalesce(F.when(packed.isNull(), pick_exact).otherwise(pick_fast), F.lit(""))]
        else:
            ok, kv = F.lit(True), None
        m = F.when(ok, F.create_map(*kv)).otherwise(raw_map) if kv else raw_map
        ok_expr = F.when(hit, ok).otherwise(ok_expr)
        map_expr = F.when(hit, m).otherwise(map_expr)
    keep = [c for c in rows_in.columns if c != TEXT]
    return d.select(*keep, text.alias(RAW), ok_expr.alias(PARSED), map_expr.alias(FIELDS))


# ---- statistics and column discovery ----------------------------------------------
def parse_stats(rows: DataFrame) -> DataFrame:
    """Parsed / fallback counts per file (map-side partial aggregation)."""
    return rows.groupBy(PATH).agg(
        F.count_if(F.col(PARSED)).cast("long").alias("parsed"),
        F.count_if(~F.col(PARSED)).cast("long").alias("fallback"),
    )


def discover_columns(rows: DataFrame, fs: FieldSpace | None = None) -> DataFrame:
    """Union of field keys per file in first-appearance order: ``(path, position, column_name)``.

    First appearance = smallest ``(line_no, position in the row)``; positions are
    numbered with a window over the (few) distinct keys of a file.
    """
    fs = fs or (FieldSpace(None) if FIELDS in rows.columns else None)
    if fs is None:
        raise ValueError("discover_columns needs a fields map or an explicit FieldSpace")
    ent = rows.select(PATH, LINE, F.posexplode(fs.entries()).alias("pos", "e"))
    first = ent.groupBy(PATH, F.col("e.key").alias("column_name")).agg(
        F.min(F.struct(F.col(LINE), F.col("pos"))).alias("_first"))
    w = Window.partitionBy(PATH).orderBy("_first")
    return first.select(PATH, F.row_number().over(w).cast("long").alias("position"), "column_name")
