"""Rules -> Column predicates (filters, flags, colours, time range, search).

Every predicate is NULL-safe: a missing key (NULL) never matches an include and
always passes an exclude, because each test is wrapped in ``coalesce(.., false)``
before it is negated.  Patterns stay literals in the plan so the JVM compiles
them once per task; cheap ``contains`` tests are ordered before ``rlike``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules as R
from .fields import FieldSpace
from .regex import java_regex, literal
from .timestamps import parse_bound, parse_timestamp


def _true() -> Column:
    return F.lit(True)


def _false() -> Column:
    return F.lit(False)


def _and(preds: Iterable[Column]) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a & b, preds) if preds else _true()


def _or(preds: Iterable[Column]) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a | b, preds) if preds else _false()


def _safe(c: Column) -> Column:
    return F.coalesce(c, _false())


def ntz(value: _dt.datetime) -> Column:
    """A naive timestamp literal, independent of any time zone setting."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def contains_ci(v: Column, text: str) -> Column:
    """Substring test ignoring case, character by character (a sigma is a sigma at a word's end too)."""
    return v.rlike("(?iu)" + literal(text))


def _contains(v: Column, text: str, case_sensitive: bool) -> Column:
    return v.contains(text) if case_sensitive else contains_ci(v, text)


def _scoped(fs: FieldSpace, field: str | None, test) -> Column:
    """Test one named field (missing -> false) or any present field."""
    if field is not None:
        return _safe(test(fs.get(field)))
    return fs.any(test)


# ---- matches ---------------------------------------------------------------
def match_predicate(m: R.Match, fs: FieldSpace, spark=None) -> Column:
    """The rows a match holds for; what a row lacks does not match, so its negation holds."""
    if m.how == R.EQUALS:
        hit = _safe(fs.get(m.field) == F.lit(m.what))
    elif m.how == R.CONTAINS:
        hit = _scoped(fs, m.field, lambda v: _contains(v, m.what, not m.any_case))
    elif m.how == R.REGEX:
        p = java_regex(m.what, ignore_case=m.any_case, spark=spark)
        hit = _scoped(fs, m.field, lambda v: v.rlike(p))
    elif m.how == R.BETWEEN:
        ts = parse_timestamp(fs.get(m.field))
        hit = _safe(ts.isNotNull() & time_range_predicate(ts, *map(parse_bound, m.what)))
    else:
        raise ValueError(f"unknown way to match {m.how!r}")
    return ~hit if m.negated else hit


def filters_predicate(rules: Sequence[R.Match], fs: FieldSpace, spark=None) -> Column:
    """All rules ANDed; no rules -> every row passes."""
    return _and(match_predicate(r, fs, spark) for r in rules)


def time_range_predicate(ts: Column, start: _dt.datetime | None, end: _dt.datetime | None) -> Column:
    """Inclusive range on a parsed timestamp; NULL (missing/unparseable) is out once a bound is set."""
    if start is None and end is None:
        return _true()
    conds = []
    if start is not None:
        conds.append(ts >= ntz(start))
    if end is not None:
        conds.append(ts <= ntz(end))
    return _safe(_and(conds))


def view_predicate(vf: R.ViewFilter, fs: FieldSpace, timestamp_field: str | None,
                   flagged: Column | None = None, spark=None) -> Column:
    """The view filter: include (field-scoped) -> exclude -> flagged-only -> time range."""
    preds = [filters_predicate(vf.matches(), fs, spark)]
    if vf.only_flagged:
        preds.append(_safe(flagged if flagged is not None else F.col("is_flagged")))
    if timestamp_field is not None:
        start, end = parse_bound(vf.time_from), parse_bound(vf.time_to)
        if start is not None or end is not None:
            preds.append(time_range_predicate(parse_timestamp(fs.get(timestamp_field)), start, end))
    return _and(preds)


# ---- flags -----------------------------------------------------------------
def flags_predicate(rules: Sequence[R.Match], fs: FieldSpace, spark=None) -> Column:
    """OR of the rules; cheap tests first so codegen short-circuits before regexes."""
    cost = {R.EQUALS: 0, R.CONTAINS: 1, R.REGEX: 2}
    return _or(match_predicate(r, fs, spark) for r in sorted(rules, key=lambda r: cost.get(r.how, 3)))


# ---- paints ----------------------------------------------------------------
def _top_paint(paints: Sequence[R.Paint], colour: str, fs: FieldSpace, spark=None) -> Column:
    """Colour of the paint that wins: highest priority, of equals the last; NULL when none matches."""
    ranked = sorted(enumerate(paints), key=lambda x: (x[1].priority, x[0]), reverse=True)
    tests = [F.when(match_predicate(p.match, fs, spark), F.lit(getattr(p, colour)))
             for _, p in ranked if getattr(p, colour) is not None]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def row_background(paints: Sequence[R.Paint], fs: FieldSpace, spark=None) -> Column:
    return _top_paint(paints, "background", fs, spark)


def highlight_targets(paints: Sequence[R.Paint]) -> list[str]:
    """Fields that some paint highlights, in order of priority."""
    return list(dict.fromkeys(p.target for p in sorted(paints, key=lambda p: p.priority) if p.highlight is not None))


def field_highlight(paints: Sequence[R.Paint], fs: FieldSpace, target: str, spark=None) -> Column:
    """Foreground of one field."""
    return _top_paint([p for p in paints if p.target == target], "highlight", fs, spark)


def field_overrides(paints: Sequence[R.Paint], fs: FieldSpace, spark=None) -> Column:
    """``map<field, struct<foreground, background>>`` of highlighted fields (empty map when none)."""
    styling = "struct<foreground:string,background:string>"
    cells = []
    for target in highlight_targets(paints):
        colour = field_highlight(paints, fs, target, spark)
        style = F.struct(colour.alias("foreground"), F.lit(None).cast("string").alias("background"))
        cells += [F.lit(target), F.when(colour.isNotNull(), style)]
    if not cells:
        return F.create_map().cast(f"map<string,{styling}>")
    return F.map_filter(F.create_map(*cells), lambda _, style: style.isNotNull())


# ---- search ----------------------------------------------------------------
def search_pattern(q: R.SearchQuery, spark=None) -> str | None:
    """Java pattern for a search query; None for empty text (no matches)."""
    if not q.text:
        return None
    body = q.text if q.is_regex else None
    if q.is_regex:
        # the whole-word wrap adds no group: "a|b" becomes "\ba|b\b"
        src = f"\\b{body}\\b" if q.whole_word else body
        return java_regex(src, ignore_case=not q.case_sensitive, spark=spark)
    flags = "(?U)(?d)" if q.case_sensitive else "(?iU)(?d)"
    lit = literal(q.text)
    return flags + (f"\\b{lit}\\b" if q.whole_word else lit)


def search_hit(q: R.SearchQuery, fs: FieldSpace, spark=None) -> Column:
    p = search_pattern(q, spark)
    if p is None:
        return _false()
    return _scoped(fs, q.field, lambda v: v.rlike(p))
