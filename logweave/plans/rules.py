"""What users ask of rows: tests, paints, searches, views and saved views.

There is one kind of test, ``Match``: a way to compare (equal, containing, regular
expression, between two times), what to compare with, and the field it looks at
(none: any field).  Filters are matches that must all hold, flags are matches of
which one must hold, and a ``Paint`` colours the rows its match finds.
``logweave.functions.predicates`` turns them into Columns, so a set of rules becomes
one expression Catalyst can push and fuse.

    [equals("Level", "ERROR"), ~contains("heartbeat")]
    Paint(regex("timeout"), background="#5A4A1F", priority=5)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

EQUALS, CONTAINS, REGEX, BETWEEN = "equals", "contains", "regex", "between"


@dataclass(frozen=True)
class Match:
    how: str
    what: str | tuple[str | None, str | None]
    field: str | None = None
    any_case: bool = True
    negated: bool = False

    def __invert__(self) -> "Match":
        return replace(self, negated=not self.negated)


def equals(field: str, value: str) -> Match:
    return Match(EQUALS, value, field, any_case=False)


def contains(text: str, field: str | None = None, any_case: bool = True) -> Match:
    return Match(CONTAINS, text, field, any_case)


def regex(pattern: str, field: str | None = None, any_case: bool = True) -> Match:
    return Match(REGEX, pattern, field, any_case)


def between(field: str, start: str | None, end: str | None) -> Match:
    """A time in ``[start, end]``; a missing bound is open, a row without a time never matches."""
    return Match(BETWEEN, (start, end), field)


MESSAGE = "Message"


@dataclass(frozen=True)
class Paint:
    """Colours for the rows of a match; of several paints the highest priority wins,
    of equals the last.  ``highlight`` colours the matched field (the message when the
    match looks at any field)."""

    match: Match
    background: str | None = None
    highlight: str | None = None
    priority: int = 0

    @property
    def target(self) -> str:
        return self.match.field or MESSAGE


# The out-of-the-box rules.
DEFAULT_PAINTS = (
    Paint(regex(r"\b(ERROR|FATAL|FAIL|EXCEPTION|ASSERT)\b"), background="#5A1F1F", priority=10),
    Paint(regex(r"\b(WARN|WARNING|TIMEOUT)\b"), background="#5A4A1F", priority=5),
)
DEFAULT_FLAGS = (regex(r"\b(ERROR|FATAL|FAIL|ASSERT|TIMEOUT|EXCEPTION|WARN)\b"),)


@dataclass(frozen=True)
class SearchQuery:
    text: str
    case_sensitive: bool = False
    is_regex: bool = False
    whole_word: bool = False
    field: str | None = None


@dataclass(frozen=True)
class ViewFilter:
    """What a log view shows: include, exclude, flagged-only and time range."""

    text: str = ""
    is_regex: bool = False
    field: str | None = None
    exclude_text: str = ""
    exclude_is_regex: bool = False
    only_flagged: bool = False
    time_from: str | None = None
    time_to: str | None = None

    def matches(self) -> list[Match]:
        """The text parts of the filter; a regular expression minds the case."""
        out = []
        if self.text:
            out.append(regex(self.text, self.field, False) if self.is_regex else contains(self.text, self.field))
        if self.exclude_text:
            out.append(~(regex(self.exclude_text, any_case=False) if self.exclude_is_regex else contains(self.exclude_text)))
        return out


@dataclass(frozen=True)
class SavedView:
    """A view filter under a name, for all profiles or for one."""

    name: str
    view: ViewFilter
    profile: str | None = None
