"""Format detection for each file, suggested names and roles.

One grouped pass over the lines of **all** files at once: for every
candidate delimiter, does it occur in every non-blank line, and is the
part count the same (>= 2) on all of them?  (An interactive opening looks at
the first ``SAMPLE_LINES`` lines only; that is an argument.)  The first candidate that qualifies
wins; otherwise the file is raw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FIELDS, LINE, PARSED, PATH, RAW, RAW_KEY, TEXT
from ..functions.levels import guess_role, suggested_names
from .parse import split_pattern

# Candidate delimiters in order of preference ("||" before "|").
CANDIDATE_DELIMITERS = ("||", "\t", "|", ",", ";")

# Lines an interactive opening looks at.
SAMPLE_LINES = 200


def detect_formats(lines: DataFrame, sample_lines: int | None = None) -> DataFrame:
    """``(path, kind, delimiter, field_count)`` per file; ``kind`` is Delimited or Raw.

    All lines count unless ``sample_lines`` limits them to the first ones of each file.
    """
    s = lines if sample_lines is None else lines.where(F.col(LINE) <= F.lit(sample_lines))
    s = s.where(~F.col(TEXT).rlike("^(?U)\\s*$"))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, d in enumerate(CANDIDATE_DELIMITERS):
        n = F.size(F.split(F.col(TEXT), split_pattern(d), -1))
        aggs += [F.bool_and(F.col(TEXT).contains(d)).alias(f"_all{i}"), F.min(n).alias(f"_mn{i}"),
                 F.max(n).alias(f"_mx{i}")]
    # every file with lines has a line 1: the file list without a distinct over all lines
    files = lines.where(F.col(LINE) == F.lit(1)).select(PATH)
    g = files.join(s.groupBy(PATH).agg(*aggs), PATH, "left")
    kind = F.lit(None).cast("string")
    delim = F.lit(None).cast("string")
    count = F.lit(0)
    for i in reversed(range(len(CANDIDATE_DELIMITERS))):
        ok = F.coalesce(F.col(f"_all{i}") & (F.col(f"_mn{i}") == F.col(f"_mx{i}")) & (F.col(f"_mn{i}") >= 2), F.lit(False))
        delim = F.when(ok, F.lit(CANDIDATE_DELIMITERS[i])).otherwise(delim)
        count = F.when(ok, F.col(f"_mn{i}")).otherwise(count)
    kind = F.when(delim.isNotNull(), F.lit("Delimited")).otherwise(F.lit("Raw"))
    return g.select(PATH, kind.alias("kind"), delim.alias("delimiter"), count.cast("long").alias("field_count"))


def suggested_fields(formats: DataFrame) -> DataFrame:
    """``(path, position, field_name, role)`` for detected delimited formats."""
    names = suggested_names(F.col("field_count").cast("int"))
    ex = formats.where(F.col("kind") == "Delimited").select(PATH, F.posexplode(names).alias("pos", "field_name"))
    return ex.select(PATH, (F.col("pos") + 1).cast("long").alias("position"), "field_name",
                     guess_role(F.col("field_name")).alias("role"))


def parse_detected(lines: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Parse every file with its detected format (no prompt): the ``fields`` map model.

    The delimiter is per file, so one literal-split branch per candidate keeps
    every pattern a compile-once literal.  Without ``formats`` the lines carry their
    file's ``delimiter`` and ``field_count`` already.
    """
    j = lines if formats is None else lines.join(formats.select(PATH, "delimiter", "field_count"), PATH, "left")
    text, d = F.col(TEXT), F.col("delimiter")
    parts = F.lit(None).cast("array<string>")
    for cand in CANDIDATE_DELIMITERS:
        parts = F.when(d == cand, F.split(text, split_pattern(cand), -1)).otherwise(parts)
    # a file detected as raw parses every line (as RawText); a delimited one
    # falls back on lines without its delimiter
    split_ok = F.coalesce(F.expr("delimiter is not null and instr(text, delimiter) > 0"), F.lit(False))
    ok = d.isNull() | split_ok
    names = suggested_names(F.coalesce(F.col("field_count"), F.lit(0)).cast("int"))
    vals = F.transform(names, lambda _n, i: F.coalesce(F.try_element_at(parts, i + 1), F.lit("")))
    fmap = F.when(split_ok, F.map_from_arrays(names, vals)).otherwise(F.create_map(F.lit(RAW_KEY), text))
    keep = [c for c in lines.columns if c != TEXT]
    return j.select(*keep, text.alias(RAW), ok.alias(PARSED), fmap.alias(FIELDS))
