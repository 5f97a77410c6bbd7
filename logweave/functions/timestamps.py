"""Timestamp parsing of log field text (naive, no zone) as a Column expression.

Recognises a fixed list of exact formats by shape, then loose forms (month names, AM/PM,
short numbers, ISO), else NULL.  All work stays in the JVM: no Python per row.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exact formats, in the order they are tried (Java pattern letters).
EXACT_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss,SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyyMMdd-HH:mm:ss:SSS",
    "yyyyMMdd-HH:mm:ss.SSS",
    "yyyyMMdd-HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss.SSS",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "HH:mm:ss.SSS",
    "HH:mm:ss",
)

# Whitespace trimmed before parsing.
_WS = " \t\n\r\f\u000b"

def _fixed_literals(pattern: str) -> list[tuple[int, str]]:
    """(position, char) of literal characters in the fixed-width prefix of a pattern.

    Pattern letters are fixed width here (``yyyy``, ``MM``, ``dd``, ``HH`` ...),
    so every literal before the first optional section sits at a known index.
    """
    out, pos, i = [], 0, 0
    while i < len(pattern) and pattern[i] != "[":
        c = pattern[i]
        if c == "'":
            j = pattern.index("'", i + 1)
            for ch in pattern[i + 1:j]:
                out.append((pos, ch))
                pos += 1
            i = j + 1
            continue
        if not c.isalpha():
            out.append((pos, c))
        pos += 1
        i += 1
    return out


def _shape_guard(s: Column, pattern: str) -> Column:
    """Cheap necessary condition for ``pattern`` to parse ``s``: its fixed literals in place.

    Skips parse attempts that cannot succeed (a failed parse costs an exception).
    """
    lits = _fixed_literals(pattern)
    conds = [F.length(s) >= F.lit(max(p for p, _ in lits) + 1)] if lits else []
    conds += [F.substring(s, p + 1, 1) == F.lit(ch) for p, ch in lits]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _sub(s: Column, start: int, length: int | None = None) -> Column:
    """``length`` characters from ``start`` (1-based), or all from there on."""
    return F.substring(s, start, length) if length else F.substr(s, F.lit(start))


def iso_text(s: Column, base_date: str) -> Column:
    """Rewrite the text of any known format into ISO ``yyyy-MM-dd HH:mm:ss[.f]``.

    Each format's fields are fixed width, so its shape (the literal characters
    at known positions, from ``_fixed_literals``) identifies it and a few
    substrings reorder it.  Text of no known shape is left as is for the loose
    parse.
    """
    frac = F.when(F.length(s) > 17, F.concat(F.lit("."), _sub(s, 19))).otherwise(F.lit(""))
    return (
        F.when(_shape_guard(s, "yyyy-MM-dd HH:mm:ss") | _shape_guard(s, "yyyy-MM-dd'T'HH:mm:ss"),
               F.translate(s, ",", "."))
        .when(_shape_guard(s, "yyyyMMdd-HH:mm:ss"),
              F.concat(_sub(s, 1, 4), F.lit("-"), _sub(s, 5, 2), F.lit("-"), _sub(s, 7, 2), F.lit(" "),
                       _sub(s, 10, 8), frac))
        .when(_shape_guard(s, "yyyy/MM/dd HH:mm:ss"), F.concat(F.translate(_sub(s, 1, 10), "/", "-"), _sub(s, 11)))
        .when(_shape_guard(s, "MM/dd/yyyy HH:mm:ss"),
              F.concat(_sub(s, 7, 4), F.lit("-"), _sub(s, 1, 2), F.lit("-"), _sub(s, 4, 2), _sub(s, 11)))
        .when(_shape_guard(s, "HH:mm:ss") & (F.length(s) <= 12), F.concat(F.lit(base_date + " "), s))
        .when(s.rlike(HOUR_MINUTE), F.concat(F.lit(base_date + " "), F.lpad(s, 5, "0"), F.lit(":00")))
        .when(s.rlike(NO_YEAR), _iso_without_year(s, base_date))
        .when(s.rlike(LOOSE), _loose_iso(s))
        .otherwise(s)
    )


# Loose forms: dates with a month's name (day or name first, a weekday before it) and
# dates with slashes and short numbers; 12 or 24 hours, seconds optional.
_NAME = "([A-Za-z]{3})[A-Za-z]*\\.?"
_DATES = (f"(?:[A-Za-z]{{3,9}},? +)?(\\d{{1,2}})[ -]{_NAME}[ ,-]+(\\d{{4}})",
          f"(?:[A-Za-z]{{3,9}},? +)?{_NAME} +(\\d{{1,2}}),? +(\\d{{4}})",
          "(\\d{1,2})/(\\d{1,2})/(\\d{4})")
LOOSE = ("^(?:" + "|".join(_DATES) + ")(?:[ ,T]+(\\d{1,2}):(\\d{2})(?::(\\d{2})(\\.\\d{1,9})?)?(?: *([AaPp])[Mm])?(?: *(?:GMT|UTC|Z))?)?$")
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# A time of hours and minutes, and a date as system logs write it; the rest is of the base date.
HOUR_MINUTE = "^\\d{1,2}:\\d{2}$"
NO_YEAR = f"^{_NAME} +(\\d{{1,2}}) +(\\d{{1,2}}):(\\d{{2}}:\\d{{2}}(?:\\.\\d{{1,9}})?)$"


def _iso_without_year(s: Column, base_date: str) -> Column:
    month, day, hour, rest = (F.regexp_extract(s, NO_YEAR, k) for k in range(1, 5))
    at = F.instr(F.lit(_MONTHS), F.lower(month)) - 1
    number = F.when(at % 3 == 0, (F.floor(at / 3) + 1).cast("string")).otherwise(F.lit("0"))
    return F.concat(F.lit(base_date[:5]), F.lpad(number, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), rest)


def _loose_iso(s: Column) -> Column:
    """ISO text of a loose form; an impossible date stays unparsable.  The groups come out
    of one replacement, bound once."""
    groups = F.split(F.regexp_replace(s, LOOSE, "\u0001".join(f"${i}" for i in range(1, 15))), "\u0001", -1)
    return F.element_at(F.transform(F.array(groups), _iso_of_groups), 1)


def _iso_of_groups(groups: Column) -> Column:
    g = [None, *[F.get(groups, i) for i in range(14)]]
    month_name = F.lower(F.concat(g[2], g[4]))
    at = F.instr(F.lit(_MONTHS), month_name) - 1
    named = F.when(at % 3 == 0, F.floor(at / 3) + 1).otherwise(0)
    month = F.when(month_name != "", named).otherwise(g[7].try_cast("int")).cast("int")
    day, year = F.concat(g[1], g[5], g[8]), F.concat(g[3], g[6], g[9])
    hour = F.coalesce(g[10].try_cast("int"), F.lit(0))
    half = F.lower(g[14])
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(99)).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    full = lambda c: F.when(c == "", "00").otherwise(c)
    return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), full(g[11]), F.lit(":"),
                    full(g[12]), g[13])


def parse_timestamp(c: Column | str, base_date: str = "1970-01-01") -> Column:
    """Parse log text to ``timestamp_ntz``; NULL when blank or unrecognised.

    The exact formats (``EXACT_FORMATS``) are recognised by shape and rewritten
    to ISO text, then one ``try_cast`` parses it -- a small expression with no
    exception per failed format; text of other shapes gets the same cast as the
    loose parse.  Time-only values get ``base_date`` as their date (default
    1970-01-01 so results repeat; pass today's date for wall-clock behaviour).
    """
    c = F.col(c) if isinstance(c, str) else c
    # Bind the trimmed text once (a one-element transform acts as a let): the
    # rewrite reads it many times, and filter pushdown would otherwise inline
    # the whole field expression (e.g. a split of the raw line) at every read.
    return F.element_at(F.transform(F.array(F.btrim(c, F.lit(_WS))),
                                    lambda s: iso_text(s, base_date).try_cast("timestamp_ntz")), 1)


def parse_bound(text: str | None, base_date: str = "1970-01-01") -> _dt.datetime | None:
    """Parse a user-given bound (filter box, colour rule) once, on the driver.

    The forms of ``parse_timestamp``, and a time alone on the same ``base_date``.
    Text that does not parse means "no bound", like an empty box.
    """
    if text is None or not str(text).strip():
        return None
    s = str(text).strip()
    forms = [_python_form(f) for f in EXACT_FORMATS]
    for f in (*forms, "%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            found = _dt.datetime.strptime(s, f)
        except ValueError:
            continue
        if "%Y" not in f:
            found = _dt.datetime.combine(_dt.date.fromisoformat(base_date), found.time())
        return found
    if m := re.match(NO_YEAR, s):
        s = f"{m[1]} {m[2]} {base_date[:4]} {m[3]}:{m[4]}"
    try:
        return _dt.datetime.fromisoformat(s).replace(tzinfo=None)
    except ValueError:
        return _loose_bound(s)


def _python_form(pattern: str) -> str:
    for java, python in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("SSS", "%f"), ("ss", "%S"), ("'", "")):
        pattern = pattern.replace(java, python)
    return pattern


def _loose_bound(s: str) -> _dt.datetime | None:
    m = re.match(LOOSE, s)
    if not m:
        return None
    name = (m[2] or m[4] or "").lower()
    at = _MONTHS.find(name)
    month = (at // 3 + 1 if at % 3 == 0 else 0) if name else int(m[7])
    hour = int(m[10] or 0)
    if m[14]:
        hour = hour % 12 + (12 if m[14] in "pP" else 0) if 1 <= hour <= 12 else 99
    try:
        return _dt.datetime(int(m[3] or m[6] or m[9]), month, int(m[1] or m[5] or m[8]), hour, int(m[11] or 0), int(m[12] or 0),
                            int((m[13] or ".0")[1:7].ljust(6, "0")))
    except ValueError:
        return None
