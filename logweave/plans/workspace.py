"""Open a whole workspace the way the desktop tool opens one log -- as one Spark job.

``open_workspace`` composes the operators: scan and decode every file, resolve
each file's profile (file override, nearest assigned folder), detect a format
for files without one, parse, flag, colour, fold multiline events per profile,
and summarise per file.  Everything stays lazy except the few small tables that
are written once (numbered lines, encodings) because several branches read them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import FIELDS, PATH, FieldSpace
from ..functions.predicates import view_predicate
from ..functions.regex import java_regex
from ..operators import detect as D
from ..operators import events as E
from ..operators import parse as PA
from ..operators import resolve as RS
from ..operators import summary as SU
from ..operators import tags as T
from ..sources.config import Settings
from ..sources.files import detect_workspace
from ..sources.lines import cap_lines
from .profile import LogProfile
from .rules import ViewFilter
from .sizing import materialize

DETECTED = "(detected)"


@dataclass
class WorkspaceView:
    files: DataFrame      # (path, dir, name, ext, length, modified)
    encodings: DataFrame  # (path, encoding, had_bom, is_fallback, warning)
    lines: DataFrame      # (path, line_no, text)
    profiles: DataFrame   # (path, profile) -- resolved name, or "(detected)" / NULL for raw
    rows: DataFrame       # (path, line_no, raw, is_parsed, fields, profile, is_flagged, row_background,
                          #  field_overrides, event_line, is_primary)
    status: DataFrame     # per file + total: shown, total, parsed, fallback, flagged, encoding, warning, profile,
                          #  truncated


def open_workspace(spark: SparkSession, root: str, settings: Settings | None = None,
                   profiles: Sequence[LogProfile] = (), detect_unresolved: bool = True,
                   view: ViewFilter | None = None, timestamp_field: str | None = None,
                   line_cap: int | None = None, sample_lines: int | None = None) -> WorkspaceView:
    """``view`` (and the ``timestamp_field`` its time range reads) decides what the
    status counts as shown; without it every row is shown.  ``line_cap`` loads the
    first lines of each file only; the status says which files it cut.  Formats are
    detected on whole files unless ``sample_lines`` limits that to the first lines of
    each (the desktop tool looks at ``detect.SAMPLE_LINES``).

    Profile, encoding and detected format of a file reach its lines on the split
    table: no line text is shuffled before the event fold.
    """
    settings = settings or Settings()
    by_name = {p.name: p.validate(spark) for p in profiles}
    files, scan = detect_workspace(spark, root, settings.extensions)

    dirs = RS.assignments_frame(spark, settings.dir_assignments, "dir")
    overrides = RS.assignments_frame(spark, settings.file_overrides, "file") if settings.file_overrides else None
    resolved = RS.resolve_profiles(files, dirs, overrides).withColumn(
        "profile", F.when(F.col("profile").isin(list(by_name) or [""]), F.col("profile")))
    formats = None
    if detect_unresolved:
        unresolved = scan.lines(resolved).where(F.col("profile").isNull()).drop("profile")
        formats = D.detect_formats(unresolved, sample_lines).select(PATH, "delimiter", "field_count")
        resolved = resolved.join(formats, PATH, "left")
    else:
        resolved = resolved.withColumns({"delimiter": F.lit(None).cast("string"), "field_count": F.lit(None).cast("long")})
    resolved = materialize(resolved)  # one row a file

    lines = scan.lines(resolved)
    loaded = lines if line_cap is None else cap_lines(lines, line_cap)
    known = PA.parse_with_profiles(loaded.where(F.col("profile").isNotNull()), by_name, spark=spark)
    rest = D.parse_detected(loaded.where(F.col("profile").isNull()))
    rest = rest.withColumn("profile", F.when(F.col("delimiter").isNotNull(), F.lit(DETECTED)))
    rows = known.unionByName(rest.select(*known.columns)).drop("delimiter", "field_count")

    fs = FieldSpace(None, FIELDS)
    rows = T.color_rows(T.flag_rows(rows, settings.flags, fs, spark), settings.paints, fs, spark)
    is_new = F.lit(True)
    for name, prof in by_name.items():
        if prof.new_event:
            is_new = F.when(F.col("profile") == name, F.col("raw").rlike(java_regex(prof.new_event))).otherwise(is_new)
    rows = E.assign_events_marked(rows, is_new)

    names = F.coalesce("profile", F.when(F.col("delimiter").isNotNull(), F.lit(DETECTED)))
    stats = scan.encodings.select(PATH, "encoding", "warning").join(resolved.select(PATH, names.alias("profile")), PATH, "left")
    if line_cap is None:
        stats = stats.withColumn("truncated", F.lit(False))
    else:
        sizes = lines.groupBy(PATH).agg((F.max("line_no") > line_cap).alias("truncated"))  # of decoded lines: splits of UTF-16 files count other breaks
        stats = stats.join(sizes, PATH, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    shown = view_predicate(view, fs, timestamp_field, spark=spark) if view is not None else F.lit(True)
    status = SU.status_summary(rows, shown, stats)
    return WorkspaceView(files, scan.encodings, lines.select(PATH, "line_no", "text"), resolved.select(PATH, names.alias("profile")),
                         rows, status)
