"""Level severity rank and field-role guessing, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard severity order, least to most severe.
STANDARD_LEVEL_ORDER = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")

# The semantic roles a field can carry.
ROLES = (
    "Generic", "Timestamp", "Level", "Module", "Message",
    "Thread", "DeviceId", "TestCase", "RunId", "Result",
)

# Names suggested by position for a detected delimited format;
# positions past the list are named Field{i} (1-based).
SUGGESTED_NAMES = ("Timestamp", "Level", "Module", "Message", "Thread", "DeviceId", "TestCase", "RunId", "Result")


def level_rank(c: Column | str, order: tuple[str, ...] | list[str] = STANDARD_LEVEL_ORDER) -> Column:
    """0-based position of the value in ``order`` ignoring case; unknown -> len(order)."""
    c = F.col(c) if isinstance(c, str) else c
    ups = F.array(*[F.lit(x.upper()) for x in order])
    pos = F.coalesce(F.array_position(ups, F.upper(c)), F.lit(0))
    return F.when(pos == 0, F.lit(len(order))).otherwise(pos - 1).cast("int")


def guess_role(name: Column | str) -> Column:
    """Role guessed from a field name: ordered substring / equality tests.

    Order matters ("runtime" is a Timestamp because it contains "time").
    """
    name = F.col(name) if isinstance(name, str) else name
    n = F.lower(F.trim(name))
    has = n.contains
    # Fixed values: (role, substrings, exact names) tested in this order.
    tests = [
        ("Timestamp", ("time", "date"), ("ts",)),
        ("Level", ("level",), ("lvl", "severity")),
        ("Message", ("message",), ("msg", "text")),
        ("Module", ("module", "logger", "tag", "component"), ()),
        ("Thread", ("thread",), ("tid",)),
        ("DeviceId", ("device",), ()),
        ("TestCase", ("test",), ()),
        ("RunId", ("run",), ()),
        ("Result", ("result",), ()),
    ]
    expr = None
    for role, subs, exact in tests:
        conds = [has(s) for s in subs] + [n == e for e in exact]
        cond = reduce(lambda a, b: a | b, conds)
        expr = F.when(cond, F.lit(role)) if expr is None else expr.when(cond, F.lit(role))
    return expr.otherwise(F.lit("Generic"))


def suggested_names(count: Column | int) -> Column:
    """Array of suggested field names for ``count`` columns."""
    count = F.lit(count) if isinstance(count, int) else count
    known = F.array(*[F.lit(x) for x in SUGGESTED_NAMES])
    extra = F.transform(
        F.sequence(F.lit(len(SUGGESTED_NAMES) + 1), F.greatest(count, F.lit(len(SUGGESTED_NAMES) + 1))),
        lambda i: F.concat(F.lit("Field"), i.cast("string")),
    )
    allnames = F.concat(known, F.when(count > len(SUGGESTED_NAMES), extra).otherwise(F.array().cast("array<string>")))
    return F.when(count <= 0, F.array().cast("array<string>")).otherwise(F.slice(allnames, 1, count))
