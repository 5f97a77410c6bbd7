"""Tail growing log files as a Structured Streaming source (``format("logtail")``).

Spark's file source only notices *new* files; a log tail needs the bytes
appended to existing ones, of all files of a workspace, new ones included:

* the driver looks at few files a trigger (``positions.Folders``) and reads 512 bytes of
  those that changed; with ``checkpointLocation`` (the query's own) the planned positions
  are logged there, changed files only, and an offset is one number.  Without it offsets
  hold the positions of all files, for a handful of files;
* ``partitions`` turns each changed file's new byte range into input partitions of at
  most ``chunkBytes``; executors read the ranges;
* a range *owns* the lines whose ``\\n`` lies inside it; the reader looks back
  past the range start for the line's beginning, so a partial line is never
  emitted and no carry buffer needs checkpointing;
* one trailing ``\\r`` is stripped at the owned ``\\n`` (CRLF split over writes);
* text is decoded as in batch reading: UTF-16 by its byte-order mark (breaks count at
  even offsets only), else UTF-8, and a line that is not UTF-8 as Windows-1252;
* a file that got shorter, or whose bytes before its position are not those that were
  read, was truncated, rotated or replaced: its generation goes up and it is re-read from
  byte 0; consumers key state by ``(path, generation)``;
* a file that vanished or cannot be read is "no new data" for this trigger.

Files are listed, stat'ed and read through ``sources.fsio`` (``pyarrow.fs``), so
local paths and -- where configured -- ``s3://`` / ``hdfs://`` URIs work alike.

Options: ``path`` (file, folder, local glob or URI), ``glob`` (file-name filter inside a
folder, default ``*.log``) or ``extensions`` (comma list), ``startingOffsets`` (``earliest``
| ``latest`` | ``lines:N``), ``chunkBytes``, ``maxLineBytes`` (look-back step),
``maxBytesPerTrigger`` (most new bytes of one file in a micro-batch: bounds what a file's
group holds; without ``checkpointLocation`` not for the first batch after a start),
``idlePerTrigger`` (idle files looked at in a trigger, in turn).

Lines before the start are numbered too: after ``latest`` the skipped ranges come as rows
that only count their lines (``skipped``, counted by executors), after ``lines:N`` the rows
say from which line on they are wanted (``first_line``); ``live.number_lines`` and
``live.fold_events`` apply both.  The authoritative generation counter is kept by them in
checkpointed state (offsets going backwards = new generation).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import fsio
from . import positions as P

SCHEMA = "path string, generation long, byte_offset long, end_offset long, skipped long, first_line long, text string"


class RangePartition(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int, skip: bool = False, first_line: int = 1):
        self.path, self.generation, self.start, self.end = path, generation, start, end
        self.skip, self.first_line = skip, first_line


class TailStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        path = options.get("path")
        if not path:
            raise ValueError("logtail needs option 'path'")
        names = [f"*{e.strip()}" for e in options.get("extensions", "").split(",") if e.strip()] or [options.get("glob", "*.log")]
        self.starting = options.get("startingOffsets", "earliest")
        if self.starting not in ("earliest", "latest") and not self.starting.removeprefix("lines:").isdigit():
            raise ValueError(f"startingOffsets is earliest, latest or lines:N, not {self.starting}")
        self.chunk = int(options.get("chunkBytes", 64 << 20))
        self.max_line = int(options.get("maxLineBytes", 1 << 20))
        self.max_bytes = int(options.get("maxBytesPerTrigger", 128 << 20))
        self.folders = P.Folders(path, names, int(options.get("idlePerTrigger", 1000)))
        checkpoint = options.get("checkpointLocation")
        self.log = P.PositionLog(f"{checkpoint.rstrip('/')}/logtail") if checkpoint else None
        self.known: dict[str, dict] = {}  # without a log: the positions last planned
        self.bounded = self.log is not None  # whether the place to go on from is known
        self.loaded = self.folders_seen = False

    def _load(self) -> None:
        """Goes on from the log, or begins it (Spark asks for the end of the first batch before its start)."""
        if not self.loaded and self.log:
            self.log.load()
            if not self.log.exists:
                self.log.begin(self._first_positions())
        self.loaded = True

    # ---- offsets (driver) ------------------------------------------------------
    def _first_positions(self) -> dict:
        """Where a new query starts in the files of now: ``latest`` only counts the lines up to their ends,
        ``lines:N`` reads all and wants them from a line on."""
        if self.starting == "earliest":
            return {}
        files = self.folders.poll()
        if self.starting == "latest":
            return {p: {"g": 0, "to": 0, "m": None, "f": None, "s": size} for p, (size, _) in files.items()}
        first = int(self.starting.removeprefix("lines:")) + 1
        return {p: {"g": 0, "to": 0, "m": None, "f": None, "first": first} for p in files}

    def initialOffset(self) -> dict:
        self._load()
        if self.log:
            return {"seq": 0}
        self.known, self.bounded = self._first_positions(), True
        return {"files": dict(self.known)}

    def latestOffset(self) -> dict:
        self._load()
        known = self.log.positions if self.log else self.known
        files = self.folders.poll()
        if not self.folders_seen:  # files that were listed for the start already count as new once
            files = {**fsio.look([p for p in known if p not in files]), **files}
            self.folders_seen = True
        changes = {}
        for path, info in files.items():
            try:
                news = info and P.advanced(path, *info, known.get(path), self.max_bytes if self.bounded else info[0])
            except OSError:  # vanished or locked meanwhile: another trigger
                continue
            if news:
                changes[path] = news
                self.folders.saw_growth(path)
        if self.log:
            return {"seq": self.log.append(changes) if changes else self.log.seq}
        self.known.update(changes)
        return {"files": dict(self.known)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._load()
        if self.log:
            ranges: dict[str, list[dict]] = {}
            for entry in self.log.between((start or {}).get("seq", 0), end["seq"]):
                for path, r in entry.items():
                    kept = [x for x in ranges.get(path, []) if x["g"] == r["g"]]  # a replaced file's bytes are gone
                    ranges[path] = [*kept, r]
        else:
            self.bounded = True
            ranges = {path: [r] for path, e in end.get("files", {}).items() if (r := self._since((start or {}).get("files", {}).get(path), path, e))}
        out: list[InputPartition] = []
        for path, found in ranges.items():
            for r in found:
                read_from = min(max(r["from"], r.get("s", 0)), r["to"])
                for lo, hi, skip in ((r["from"], read_from, True), (read_from, r["to"], False)):
                    out += [RangePartition(path, r["g"], at, min(at + self.chunk, hi), skip, r.get("first", 1)) for at in range(lo, hi, self.chunk)]
        return out

    def _since(self, start: dict | None, path: str, end: dict) -> dict | None:
        """The range between two positions of offsets; after a restart the reader's own generation of the
        end is too low, and whether the file was replaced shows only here."""
        if start is None or end["g"] > start["g"]:
            r = {**end, "from": 0}
        elif end["to"] < start["to"] or (end["f"] != start["f"] and self._replaced(path, start)):
            r = {"to": end["to"], "m": end["m"], "f": end["f"], "g": start["g"] + 1, "from": 0}
        else:
            r = {**end, "g": start["g"], "from": start["to"], **{k: start[k] for k in ("s", "first") if k in start}}
        self.known[path] = r
        return r if r["to"] > r["from"] else None

    def _replaced(self, path: str, start: dict) -> bool:
        try:
            return bool(start["f"]) and start["to"] > 0 and P.fingerprint(path, start["to"]) != start["f"]
        except OSError:
            return False

    def commit(self, end: dict) -> None:
        if self.log:
            self.log.forget(end["seq"])

    # ---- data (executors) ----------------------------------------------------
    def read(self, partition: RangePartition) -> Iterator[tuple]:
        part = partition
        try:
            brk, charset = fsio.line_break(fsio.read(part.path, 0, 2))
            w = len(brk)
            if part.skip:
                at = max(0, part.start - w + 1)  # a break may begin before the range
                data = fsio.read(part.path, at, part.end - at)
                last = fsio.last_break(data, at, brk)
                end = last + w if last is not None else 0  # a line begun before the range's end goes on after it
                yield (part.path, part.generation, part.start, end, fsio.count_breaks(data, at, brk), part.first_line, None)
                return
            # look back (in steps of maxLineBytes, as far as needed) for the
            # beginning of the first owned line
            begin = hi = part.start
            while hi > 0:
                back = max(0, hi - self.max_line)
                at = fsio.last_break(fsio.read(part.path, back, hi - back), back, brk)
                if at is not None:
                    begin = at + w
                    break
                # a break may lie across the step's edge
                begin, hi = back, back + w - 1 if back else 0
            data = fsio.read(part.path, begin, part.end - begin)
        except OSError:  # vanished or locked: nothing this time
            return
        pos = 0
        while True:
            nl = fsio.next_break(data, pos, begin, brk)
            if nl is None:
                break
            owner = begin + nl
            if owner + w > part.start:
                text = _decoded(data[pos:nl], charset)
                if begin + pos == 0:
                    text = text.removeprefix("\ufeff")
                yield (part.path, part.generation, begin + pos, owner + w, None, part.first_line, text.removesuffix("\r"))
            pos = nl + w


def _decoded(raw: bytes, charset: str | None) -> str:
    if charset:
        return raw.decode(charset, errors="replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(_ANSI[b] for b in raw)


# Windows-1252; the five bytes it leaves undefined stand for themselves.
_ANSI = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(256)]


class TailDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailStreamReader(self.options)


def register(spark) -> None:
    """Make ``spark.readStream.format("logtail")`` available in this session.

    The source is planned in a Python process the JVM starts on the driver,
    which does not see files added with ``addPyFile``; this module and the file
    access it uses are therefore pickled by value (their code travels with the
    pickled class) instead of by import name.
    """
    import sys

    from pyspark import cloudpickle

    from ..session import ship_package

    ship_package(spark)
    for mod in (__name__, P.__name__, fsio.__name__):
        cloudpickle.register_pickle_by_value(sys.modules[mod])
    spark.dataSource.register(TailDataSource)
