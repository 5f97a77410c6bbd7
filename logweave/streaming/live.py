"""Live views over growing logs: numbering, folding, parsing, tagging, counters.

* ``number_lines`` -- sequential line numbers per file and generation across
  micro-batches, and the event each line belongs to (multiline folding across
  batches).  The state per file is four longs: generation, next line number,
  end of the last line, and the open event's primary line.  The new-event test
  runs JVM-side (``rlike``) before the grouped step; Python only orders a
  file's new rows and assigns numbers.
* ``fold_events`` -- whole events, each sent once: when the next one starts or, after
  a quiet time, by a processing-time timer.
* ``live_rows`` -- the same stateless parse / flag / colour Columns as batch.
* ``workspace_events`` -- a workspace folder as one stream: growing and new files, each
  decoded, numbered, folded and parsed by the profile that applies to it.
* ``each_batch`` -- the same for lines, with profiles and rules read anew per batch.
* ``running_counts``, ``level_counts`` -- streaming aggregates, the second over event time.

One key's rows in one micro-batch go to one task: the batch size per file is
bounded by the tail source's ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.fields import FIELDS, LINE, PATH, TEXT, FieldSpace
from ..functions.regex import java_regex
from ..functions.timestamps import parse_timestamp
from ..operators import parse as PA
from ..operators import resolve as RS
from ..operators import tags as T
from ..plans import rules as R
from ..plans.profile import LogProfile
from ..session import ROCKSDB_STATE, ship_package
from ..sources.config import Settings
from ..sources.files import normalize_extensions
from . import tail

NUMBERED_SCHEMA = ("path string, generation long, line_no long, byte_offset long, text string, "
                   "event_line long, is_primary boolean")
# per file: generation, next line number, end byte of the last line, open event
_STATE_SCHEMA = "generation long, next_line long, last_end long, event_line long"


def tail_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """``readStream`` over appended bytes of the log files at ``path``."""
    tail.register(spark)
    reader = spark.readStream.format("logtail").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


# ---- numbering ----------------------------------------------------------------

def _numbered(pdf: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple, bool]:
    """A file's new rows in order with their line numbers and events, the state after
    them, and whether they begin a new generation.

    Rows that only count skipped lines move the number on and go; rows before the first
    line wanted go after they are numbered.
    """
    pdf = pdf.sort_values(["generation", "byte_offset"], kind="stable").reset_index(drop=True)
    gen, next_line, last_end, open_event = state or (0, 1, 0, None)
    reset = state is not None and int(pdf["byte_offset"].iloc[0]) < last_end  # truncated, rotated or replaced
    if reset:
        gen, next_line, last_end, open_event = gen + 1, 1, 0, None
    end = max(last_end, int(pdf["end_offset"].max()))
    is_line = pdf["skipped"].isna().to_numpy()
    step = np.where(is_line, 1, pdf["skipped"].fillna(0).to_numpy()).astype(np.int64)
    pdf = pdf.assign(line_no=next_line + np.cumsum(step) - step)[is_line]
    next_line += int(step.sum())
    if gen == 0 and len(pdf):
        pdf = pdf[pdf["line_no"].to_numpy() >= pdf["first_line"].to_numpy()]
    pdf = pdf.reset_index(drop=True)
    lines = pdf["line_no"].to_numpy(dtype=np.int64)
    starts = np.where(pdf["is_new"].to_numpy(dtype=bool), lines, 0)
    if open_event is None and len(pdf):
        starts[0] = lines[0]  # the first line of a stream opens an event
    events = np.maximum.accumulate(starts) if len(pdf) else starts
    events = np.where(events == 0, open_event or 0, events)
    pdf = pdf.assign(event_line=events)
    return pdf, (int(gen), int(next_line), end, int(events[-1]) if len(pdf) else open_event), reset


def _number(key, pdfs: Iterable[pd.DataFrame], state):
    pdf = pd.concat(list(pdfs), ignore_index=True)
    if pdf.empty:
        return
    pdf, after, _ = _numbered(pdf, state.get if state.exists else None)
    state.update(after)
    yield pd.DataFrame({
        "path": pdf["path"], "generation": np.full(len(pdf), after[0], dtype=np.int64), "line_no": pdf["line_no"],
        "byte_offset": pdf["byte_offset"], "text": pdf["text"], "event_line": pdf["event_line"],
        "is_primary": pdf["event_line"] == pdf["line_no"],
    })


def _is_new(new_event: str | Column | None) -> Column:
    """Whether a line starts an event: by a pattern, by a given test, or always."""
    if isinstance(new_event, Column):
        return F.coalesce(new_event, F.lit(False))
    return F.coalesce(F.col(TEXT).rlike(java_regex(new_event)), F.lit(False)) if new_event else F.lit(True)


def _keyed(stream: DataFrame, new_event: str | Column | None):
    ship_package(stream.sparkSession)
    return stream.select("path", "generation", "byte_offset", "end_offset", "skipped", "first_line", TEXT,
                         _is_new(new_event).alias("is_new")).groupBy("path")


def number_lines(stream: DataFrame, new_event_pattern: str | Column | None = None) -> DataFrame:
    """Numbered lines with their event and generation, ordered per file.

    State per file (checkpointed by Spark): generation, next line number, end of
    the last line, open event.  A batch starting before the last line's end is a
    new generation (the source re-read a truncated or rotated file from 0).
    """
    return _keyed(stream, new_event_pattern).applyInPandasWithState(
        _number, NUMBERED_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


# ---- whole events -------------------------------------------------------------

EVENT_SCHEMA = ("path string, generation long, event_line long, part int, byte_offset long, text string, "
                "continuation array<struct<line_no:bigint,text:string>>, n_continuations long, last_line long, sent_by string")
_OPEN_SCHEMA = ("generation long, next_line long, last_end long, event_line long, "
                "part int, byte_offset long, text string, n_held long, last_line long")


class _Fold(StatefulProcessor):
    """Per file: the numbering of ``number_lines``, the open event's first line, and its
    continuation lines in a list."""

    def __init__(self, quiet_seconds: float, part_lines: int):
        self.quiet, self.part_lines = int(quiet_seconds * 1000), part_lines

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _OPEN_SCHEMA)
        self.held = handle.getListState("held", "line_no long, text string")

    def _event(self, path, state: list, held: list[tuple], by: str) -> tuple:
        gen, _, _, event_line, part, offset, text, _, _ = state
        last = int(held[-1][0]) if held else event_line
        return (path, gen, event_line, part, offset, text, [{"line_no": int(n), "text": t} for n, t in held], len(held), last, by)

    def _sent(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in ("path generation event_line part byte_offset text continuation "
                                                                "n_continuations last_line sent_by").split()])

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf.empty:
            return
        before = list(self.state.get()) if self.state.exists() else None
        pdf, after, reset = _numbered(pdf, tuple(before[:4]) if before else None)
        out: list[tuple] = []
        # the open event: [numbering..., part, offset, text, lines held, last line]
        open_event = before if before and before[3] is not None else None
        pending: list[tuple] = []  # continuation lines that are not in the list yet

        def taken() -> list[tuple]:
            held = [tuple(r) for r in self.held.get()] if open_event[7] else []
            if held:
                self.held.clear()
            return held + pending

        def close(by: str) -> None:
            if open_event[4] == 0 or open_event[7] or pending:  # a later part only if there is something in it
                out.append(self._event(key[0], open_event, taken(), by))

        if open_event and reset:
            close("reset")
            open_event = None
        for line, event, offset, text in zip(pdf["line_no"], pdf["event_line"], pdf["byte_offset"], pdf["text"]):
            if line == event:
                if open_event:
                    close("next")
                open_event, pending = [after[0], 0, 0, int(line), 0, int(offset), text, 0, int(line)], []
                continue
            pending.append((int(line), text))
            if open_event[7] + len(pending) >= self.part_lines:
                out.append(self._event(key[0], open_event, taken(), "length"))
                open_event[4:9], pending = [open_event[4] + 1, int(offset), None, 0, int(line)], []
        if open_event and pending:
            self.held.appendList(pending)
            open_event[7] += len(pending)
        rest = open_event[4:9] if open_event else [0, 0, None, 0, 0]
        self.state.update((*after, *rest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_event and (open_event[4] == 0 or open_event[7]):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        if out:
            yield self._sent(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        state = list(self.state.get())
        if state[3] is None or not (state[4] == 0 or state[7]):
            return
        held = [tuple(r) for r in self.held.get()] if state[7] else []
        event = self._event(key[0], state, held, "quiet")
        self.held.clear()
        # what comes later still belongs to this event, as its next part
        state[4:9] = [state[4] + 1, state[5], None, 0, event[8]]
        self.state.update(tuple(state))
        yield self._sent([event])

    def close(self) -> None:
        pass


def fold_events(stream: DataFrame, new_event: str | Column | None = None, quiet_seconds: float = 5.0, part_lines: int = 10_000) -> DataFrame:
    """One row per event of a tailed stream, with its continuation lines.

    An event is sent once, whole: when the next one starts (``sent_by`` next), when its
    file has been quiet for ``quiet_seconds`` (quiet), or when the file was replaced
    (reset).  Continuation lines that come after a quiet event was sent belong to it all
    the same: they are sent as its ``part`` 1, 2, ... without a text.  So is an event of
    ``part_lines`` continuation lines (length), which bounds the state of a file that
    never starts another.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``;
    ``session.ENGINE_CONF`` has it); without it an error says so.
    """
    spark = stream.sparkSession
    if spark.conf.get(ROCKSDB_STATE[0], None) != ROCKSDB_STATE[1]:
        raise RuntimeError(f"fold_events keeps lists and timers: set {ROCKSDB_STATE[0]} to {ROCKSDB_STATE[1]}")
    return _keyed(stream, new_event).transformWithStateInPandas(
        _Fold(quiet_seconds, part_lines), EVENT_SCHEMA, "Append", "ProcessingTime")


# ---- parsing ------------------------------------------------------------------

def live_rows(numbered: DataFrame, profile: LogProfile, flag_rules: Sequence[R.Match] = R.DEFAULT_FLAGS,
              color_rules: Sequence[R.Paint] | None = R.DEFAULT_PAINTS, spark=None) -> DataFrame:
    """Parse, flag and colour new rows only -- the batch Column functions, unchanged."""
    rows = PA.parse_lines(numbered, profile, spark)
    rows = T.flag_rows(rows, flag_rules, spark=spark)
    if color_rules:
        rows = T.color_rows(rows, color_rules, spark=spark)
    return rows


def profile_rows(lines: DataFrame, settings: Settings, profiles: Mapping[str, LogProfile], spark=None) -> DataFrame:
    """Rows of lines that carry their file's ``profile``: parsed by it, flagged and coloured."""
    fs = FieldSpace(None, FIELDS)
    rows = PA.parse_with_profiles(lines, profiles, spark=spark)
    return T.color_rows(T.flag_rows(rows, settings.flags, fs, spark), settings.paints, fs, spark)


def starts_event(profiles: Mapping[str, LogProfile], profile: Column) -> Column:
    """The new-event test of each row's profile; without one every line is an event."""
    test = F.lit(True)
    for name, p in profiles.items():
        if p.new_event:
            test = F.when(profile == name, F.col(TEXT).rlike(java_regex(p.new_event))).otherwise(test)
    return test


def workspace_events(spark: SparkSession, root: str, settings: Settings, profiles: Sequence[LogProfile], quiet_seconds: float = 5.0,
                     **options) -> DataFrame:
    """The events of all files below ``root``, old and new ones: one stream.

    New files enter the tail's own listing, so their lines are decoded, numbered and folded
    like any other.  A file's profile (override, else nearest assigned folder) decides where
    its events start and how their first lines are parsed; assignments and profiles are
    those of the query's start.
    """
    by_name = {p.name: p.validate(spark) for p in profiles}
    stream = tail_stream(spark, root, extensions=",".join(normalize_extensions(settings.extensions)), **options)
    profile = RS.profile_of(F.col(PATH), settings.dir_assignments, settings.file_overrides, by_name)
    events = fold_events(stream, starts_event(by_name, profile), quiet_seconds)
    return profile_rows(events.withColumn("profile", profile), settings, by_name, spark)


def each_batch(numbered: DataFrame, load: Callable[[], tuple[Settings, Sequence[LogProfile]]],
               write: Callable[[DataFrame, int], None]):
    """A stream writer that parses every micro-batch by the profiles, assignments and rules that ``load``
    gives for it, so a change of them holds from the next batch on.

    ``numbered``: lines with their path.  The profiles of a batch's files are resolved as for a
    batch workspace and joined to the lines; ``write`` gets the rows and the batch's id.
    """
    def handle(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        settings, profiles = load()
        by_name = {p.name: p.validate(spark) for p in profiles}
        lines.persist()  # read twice: for its files and for its lines
        try:
            dirs = RS.assignments_frame(spark, settings.dir_assignments, "dir")
            overrides = RS.assignments_frame(spark, settings.file_overrides, "file") if settings.file_overrides else None
            resolved = RS.resolve_profiles(lines, dirs, overrides)
            write(profile_rows(lines.join(resolved, PATH, "left"), settings, by_name, spark), batch)
        finally:
            lines.unpersist()

    return numbered.writeStream.foreachBatch(handle)


# ---- counters -----------------------------------------------------------------

def running_counts(rows: DataFrame) -> DataFrame:
    """Per-file running counts (use output mode ``update`` or ``complete``)."""
    return rows.groupBy(PATH).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("is_parsed")).alias("parsed"),
        F.count_if(~F.col("is_parsed")).alias("fallback"),
        F.count_if(F.col("is_flagged")).alias("flagged"),
    )


def level_counts(rows: DataFrame, timestamp: Column, level: Column, window: str = "1 minute", lateness: str = "1 minute") -> DataFrame:
    """Rows per file, level and window of their own time; a window is final when ``lateness`` has passed.

    Rows later than that are not counted: ``late_rows`` of the query tells how many.  Rows without a
    readable time belong to no window.
    """
    timed = rows.select(PATH, level.alias("level"), parse_timestamp(timestamp).cast("timestamp").alias("ts")).where(F.col("ts").isNotNull())
    found = timed.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), PATH, "level").agg(F.count(F.lit(1)).alias("rows"))
    return found.select(PATH, "level", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows")


def late_rows(query) -> int:
    """Rows of the query's known batches that came after their window was final."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def latest_generation(rows: DataFrame) -> DataFrame:
    """Rows of each file's newest generation (for a batch read of a live sink)."""
    mx = rows.groupBy(PATH).agg(F.max("generation").alias("_g"))
    return rows.join(mx, PATH).where(F.col("generation") == F.col("_g")).drop("_g")


def new_entries(query) -> int:
    """Rows the last micro-batch brought in (0 when nothing new)."""
    p = query.lastProgress
    return int(p["numInputRows"]) if p else 0


def workspace_files(spark: SparkSession, root: str, extensions=None, **options) -> DataFrame:
    """Numbered lines of all files below ``root``, files that appear later included."""
    stream = tail_stream(spark, root, extensions=",".join(normalize_extensions(extensions)), **options)
    return number_lines(stream)


def reset_notices(numbered: DataFrame) -> DataFrame:
    """One row per detected truncation / rotation: the first line of each new generation."""
    return numbered.where((F.col("generation") > 0) & (F.col(LINE) == 1)).select(
        PATH, "generation", F.col("byte_offset").alias("reset_at_byte"))
