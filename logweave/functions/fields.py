"""Field access over parsed rows, for either row model.

Parsed rows carry their fields one of two ways:

* **flat** — one string column per profile field, plus ``RawText`` (fixed schema;
  Catalyst can prune and push predicates on the columns);
* **map** — a ``fields map<string,string>`` column (mixed profiles in one frame).

The parser marks every flat field column with its field name in the column's
metadata, which later operators, joins and Parquet files keep.  So engine columns
(flags, colours, events, offsets) are never taken for log fields, and a field may
have any name: where it would clash with another column its column is called
differently and the mark keeps the name.

In both, a key the row lacks is SQL NULL and an empty field is ``''``; that one
rule gives every include/exclude predicate its missing-key behaviour.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH = "path"
LINE = "line_no"
TEXT = "text"
RAW = "raw"
PARSED = "is_parsed"
FIELDS = "fields"
RAW_KEY = "RawText"

# Columns that operators add to rows; a field of such a name gets another column.
RESERVED = frozenset({
    PATH, LINE, TEXT, RAW, PARSED, FIELDS, "block", "profile", "is_flagged", "row_background", "field_overrides",
    "event_line", "is_primary", "n_continuations", "last_line", "generation", "byte_offset", "end_offset", "base_line",
    "level_rank", "sort_pos", "position", "next_match", "prev_match", "nearest_line"})
MARK = "logweave.field"


def quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def field_columns(names: Sequence[str], taken: Sequence[str]) -> dict[str, str]:
    """Column for each field name: the name itself unless another column has it, in any case."""
    used = {c.lower() for c in (*taken, *RESERVED)}
    out: dict[str, str] = {}
    for name in names:
        column = name or "field"
        while column.lower() in used or column.startswith("_lw_"):
            column = "field_" + column
        used.add(column.lower())
        out[name] = column
    return out


def marked(value: Column, name: str, column: str) -> Column:
    """A field's value as its column, with the field's name in the metadata."""
    return value.alias(column, metadata={MARK: name})


@dataclass(frozen=True)
class FieldSpace:
    """How to reach a row's fields: named flat columns, or a map column.

    ``columns`` are field names; ``physical`` their columns where those differ.
    """

    columns: tuple[str, ...] | None = None
    map_col: str = FIELDS
    physical: tuple[str, ...] | None = None

    @property
    def is_map(self) -> bool:
        return self.columns is None

    def column_of(self, name: str) -> str:
        return (self.physical or self.columns)[self.columns.index(name)]

    def get(self, name: str) -> Column:
        if self.is_map:
            return F.try_element_at(F.col(self.map_col), F.lit(name))
        if name in self.columns:
            return quoted(self.column_of(name))
        return F.lit(None).cast("string")

    def without(self, name: str) -> "FieldSpace":
        kept = [(n, self.column_of(n)) for n in self.columns if n != name]
        return FieldSpace(tuple(n for n, _ in kept), self.map_col, tuple(c for _, c in kept))

    def any(self, pred: Callable[[Column], Column]) -> Column:
        """True when ``pred`` holds for some present field value."""
        if self.is_map:
            return F.coalesce(F.exists(F.map_values(F.col(self.map_col)), lambda v: F.coalesce(pred(v), F.lit(False))), F.lit(False))
        if not self.columns:
            return F.lit(False)
        return reduce(lambda a, b: a | b, [F.coalesce(pred(self.get(c)), F.lit(False)) for c in self.columns])

    def entries(self) -> Column:
        """``array<struct<key,value>>`` of present fields, in field order."""
        if self.is_map:
            return F.map_entries(F.col(self.map_col))
        arr = F.array(*[F.struct(F.lit(c).alias("key"), self.get(c).alias("value")) for c in self.columns])
        return F.filter(arr, lambda e: e["value"].isNotNull())

    def values_joined(self, sep: str = " ") -> Column:
        if self.is_map:
            return F.array_join(F.map_values(F.col(self.map_col)), sep)
        return F.concat_ws(sep, *[self.get(c) for c in self.columns])


def fields_of(df: DataFrame, columns: Sequence[str] | None = None) -> FieldSpace:
    """The field space of a rows frame: its marked columns, or its ``fields`` map.

    A frame that no parser made has no marks; then its string columns count that no
    operator adds.
    """
    if columns is not None:
        return FieldSpace(tuple(columns))
    schema = df.schema
    marks = [(f.metadata[MARK], f.name) for f in schema.fields if MARK in (f.metadata or {})]
    if marks:
        return FieldSpace(tuple(n for n, _ in marks), FIELDS, tuple(c for _, c in marks))
    if any(f.name == FIELDS and isinstance(f.dataType, T.MapType) for f in schema.fields):
        return FieldSpace(None)
    return FieldSpace(tuple(f.name for f in schema.fields if f.name not in RESERVED and isinstance(f.dataType, T.StringType)
                            and not f.name.startswith("_lw_")))


def field_or_empty(fs: FieldSpace, name: str) -> Column:
    """A field's text, ``''`` when the row lacks it (display/export rule)."""
    return F.coalesce(fs.get(name), F.lit(""))
