"""Exports: tab-separated rows, raw text, line references -- as columns and files.

The ``*_lines`` / column functions build the exported text per row (or per
bounded chunk); the ``write_*`` functions hand it to Spark's own writers, so an
export of a whole workspace is a distributed write, never a driver string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, RAW_KEY, FieldSpace, field_or_empty, fields_of
from ..plans.carry import block_of


def tsv_lines(rows: DataFrame, columns: Sequence[str], fs: FieldSpace | None = None) -> DataFrame:
    """``(path, line_no, tsv)``: line number then each column (missing -> ``''``), tab-joined."""
    fs = fs or fields_of(rows)
    cells = [F.col(LINE).cast("string")] + [field_or_empty(fs, c) for c in columns]
    return rows.select(PATH, LINE, F.concat_ws("\t", *cells).alias("tsv"))


def tsv_header(columns: Sequence[str]) -> str:
    return "\t".join(["Line", *columns])


def write_tsv(rows: DataFrame, columns: Sequence[str], out_dir: str, fs: FieldSpace | None = None) -> None:
    """Distributed TSV export with the ``Line`` + columns header."""
    fs = fs or fields_of(rows)
    sel = rows.select(F.col(LINE).alias("Line"), *[field_or_empty(fs, c).alias(c) for c in columns])
    sel.write.mode("overwrite").option("sep", "\t").option("header", True).csv(out_dir)


def raw_text(rows: DataFrame, fs: FieldSpace | None = None) -> DataFrame:
    """``(path, line_no, raw_text)``: ``RawText`` when the row has it, else its fields joined by a space."""
    fs = fs or fields_of(rows)
    if fs.is_map:
        joined = fs.values_joined(" ")
    else:
        joined = fs.without(RAW_KEY).values_joined(" ")
    return rows.select(PATH, LINE, F.coalesce(fs.get(RAW_KEY), joined).alias("raw_text"))


def write_text(rows: DataFrame, out_dir: str, fs: FieldSpace | None = None) -> None:
    raw_text(rows, fs).select("raw_text").write.mode("overwrite").text(out_dir)


def line_refs(rows: DataFrame, chunk_lines: int | None = None) -> DataFrame:
    """``(path, line_refs)``: the rows' line numbers joined by ``", "`` in order, one string a file.

    With ``chunk_lines`` one string per ``chunk`` of that many lines of the file, for
    selections too long for one string; joined in chunk order they are the whole.
    """
    g = rows.select(PATH, LINE)
    by = [PATH]
    if chunk_lines:
        g = g.withColumn("chunk", block_of(LINE, chunk_lines))
        by.append("chunk")
    return g.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.col(LINE))), ", ").alias("line_refs"))
