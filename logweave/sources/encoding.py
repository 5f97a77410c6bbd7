"""Per-file encoding detection and decoding into numbered lines.

Detection, for every file at once:

* byte-order mark from the first bytes of the file (read per file on executors);
* else valid UTF-8 judged over the **whole** file: the text source keeps raw
  bytes, so ``bool_and(is_valid_utf8(value))`` per file is one aggregate pass;
* else Windows-1252 with a warning; an empty file is UTF-8.

Decoding: UTF-8 and Windows-1252 files share one scan (1252 rows are decoded as
ISO-8859-1 and their 0x80-0x9F range remapped); UTF-16 files are read in ranges of
bytes by tasks of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, TEXT
from ..plans.sizing import broadcast_if_small, materialize
from ..session import ship_package
from . import fsio
from .lines import number_from_splits, plain_path, read_lines, scan_once, scan_raw, split_stats, text_reader

# Encoding labels.
UTF8 = "UTF-8"
UTF8_BOM = "UTF-8 (BOM)"
UTF16LE = "UTF-16 LE"
UTF16BE = "UTF-16 BE"
ANSI = "Windows-1252 (ANSI)"
ANSI_WARNING = "Some bytes are not UTF-8, so the text was read as Windows-1252; letters beyond ASCII may be wrong."

_CHARSET = {UTF16LE: "utf-16-le", UTF16BE: "utf-16-be"}


def _cp1252_high() -> tuple[str, str]:
    """Characters 0x80-0x9F as ISO-8859-1 decodes them, and as Windows-1252 does.

    Built from Python's codec; the five bytes 1252 leaves undefined map to
    themselves.
    """
    src, dst = [], []
    for b in range(0x80, 0xA0):
        try:
            ch = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            ch = chr(b)
        src.append(chr(b))
        dst.append(ch)
    return "".join(src), "".join(dst)


_HIGH_SRC, _HIGH_DST = _cp1252_high()


def decode_ansi(value: Column) -> Column:
    """Raw line bytes decoded as Windows-1252."""
    return F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), _HIGH_SRC, _HIGH_DST)


def _head_bytes(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for pdf in it:
        heads = []
        for p in pdf["path"]:
            try:
                heads.append(fsio.read(p, 0, 4))
            except (OSError, ValueError):
                heads.append(None)
        yield pd.DataFrame({"path": pdf["path"], "head": heads})


def file_heads(files: DataFrame) -> DataFrame:
    """First four bytes of each file, read on executors (``fsio``: local paths and URIs).

    In a stage of its own: a listing that still runs in Python would otherwise take a second
    worker beside this one on every core.
    """
    ship_package(files.sparkSession)
    return files.select(PATH).repartition(F.col(PATH)).mapInPandas(_head_bytes, "path string, head binary")


def bom_encoding(head: Column) -> Column:
    h = F.hex(head)
    return (F.when(h.startswith("EFBBBF"), F.lit(UTF8_BOM))
            .when(h.startswith("FFFE"), F.lit(UTF16LE))
            .when(h.startswith("FEFF"), F.lit(UTF16BE)))


def detect_encodings(spark: SparkSession, files: DataFrame, paths, recursive: bool = False,
                     glob: str | None = None) -> DataFrame:
    """``(path, encoding, had_bom, is_fallback, warning)`` per file of ``files``.

    ``paths``/``recursive``/``glob`` name the same files for the validity scan
    (the folder and filter the workspace scan used).
    """
    scan = text_reader(spark, recursive, glob).load(paths if isinstance(paths, list) else [paths]).select(
        plain_path(F.col("_metadata.file_path")).alias(PATH), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"), F.col("value"))
    # whole-file validity, and the first line's first bytes (a UTF-16 mark survives
    # the text scan) for storage the executors cannot open directly
    valid = scan.groupBy(PATH).agg(
        F.bool_and(F.expr("is_valid_utf8(value)")).alias("_valid"),
        F.min_by(F.substring(F.col("value").cast("binary"), 1, 4), F.struct("_split", "_id")).alias("_first"))
    return _encodings(files, valid)


def read_decoded(spark: SparkSession, encodings: DataFrame, paths, recursive: bool = False,
                 glob: str | None = None) -> DataFrame:
    """Numbered, decoded lines ``(path, line_no, text)`` for files with known encodings.

    ``encodings`` is ``(path, encoding)`` -- detected, or forced by the user.
    UTF-16 files are read in ranges of their own; every other file goes through one
    shared scan.
    """
    enc_side = broadcast_if_small(encodings.select(PATH, "encoding"))
    base = read_lines(spark, paths, recursive=recursive, glob=glob).join(enc_side, PATH, "left")
    return _decoded(spark, base, encodings)


@dataclass
class DetectedScan:
    """A written scan of a workspace: per-file encodings, and lines with per-file columns."""

    spark: SparkSession
    raw: DataFrame        # (path, _split, _id, text) as written
    splits: DataFrame     # (path, _split) -> line counts
    split_bytes: int
    encodings: DataFrame  # (path, encoding, had_bom, is_fallback, warning)

    def lines(self, per_file: DataFrame | None = None) -> DataFrame:
        """Numbered, decoded lines; the columns of ``per_file`` (path, ...) come along.

        They ride on the split table, one row per split, so no line text is joined
        by path, let alone shuffled.
        """
        extra = [c for c in per_file.columns if c != PATH] if per_file is not None else []
        files = self.encodings.select(PATH, "encoding")
        if per_file is not None:
            files = files.join(per_file, PATH, "left")
        base = number_from_splits(self.raw, self.splits.join(files, PATH, "left"), keep=("encoding", *extra),
                                  known_bytes=self.split_bytes * (1 + len(extra)))
        return _decoded(self.spark, base, self.encodings, files.select(PATH, *extra) if extra else None)


def scan_detected(spark: SparkSession, files: DataFrame, paths, recursive: bool = False, glob: str | None = None) -> DetectedScan:
    """Scan once, write, and detect each file's encoding from what was written.

    UTF-8 validity, first bytes and line counts per split come from one aggregate of
    the written scan.  UTF-16 files (found by their mark) are re-read with their own
    options when lines are asked for.
    """
    raw, size = scan_once(scan_raw(spark, paths, recursive=recursive, glob=glob))
    unread = materialize(files.where("length > 0").select(PATH, "length").join(raw.select(PATH).distinct(), PATH, "left_anti"))
    if not unread.isEmpty():  # listed, but hidden from Spark's reader: names that begin with _ or .
        extra, extra_size = scan_once(scan_ranges(unread))
        raw, size = raw.unionByName(extra), size + extra_size
    splits = materialize(split_stats(
        raw,
        F.bool_and(F.expr("is_valid_utf8(text)")).alias("_valid"),
        F.min_by(F.substring(F.col(TEXT).cast("binary"), 1, 4), F.col("_id")).alias("_first")))
    per_file = splits.groupBy(PATH).agg(F.bool_and("_valid").alias("_valid"),
                                        F.min_by("_first", F.col("_split")).alias("_first"))
    return DetectedScan(spark, raw, splits, size, materialize(_encodings(files, per_file)))


# Bytes of a file that one step reads; even, so that it never cuts a UTF-16 unit.
RANGE_BYTES = 32 << 20

_BREAK = re.compile(b"\r\n|\n|\r")


def scan_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The text scan (path, _split, _id, text) of files ``(path, length)`` that Spark's own reader leaves out.

    Files are cut into byte ranges, read by tasks of their own; a range owns the lines that begin in
    it.  Line ends, a UTF-8 mark and bytes that are no UTF-8 are as in Spark's reader.
    """
    ship_package(files.sparkSession)

    def lines(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                found = _range_lines(r.path, int(r.start), min(int(r.start) + range_bytes, int(r.length)), int(r.length))
                if found:
                    yield pd.DataFrame({PATH: r.path, "_split": int(r.start), "_id": range(len(found)), TEXT: found})

    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = files.select(PATH, "length", F.explode(starts).alias("start")).repartition(PATH, "start")
    read = ranges.mapInPandas(lines, f"{PATH} string, _split long, _id long, {TEXT} binary")
    return read.withColumn(TEXT, F.col(TEXT).cast("string"))


def _range_lines(path: str, start: int, stop: int, size: int, step: int = 1 << 16) -> list[bytes]:
    """The lines whose first byte lies in ``[start, stop)``."""
    base, end = max(0, start - 1), stop
    data = fsio.read(path, base, stop - base)
    while end < size:  # on to the end of the last line, and a byte more to tell \r from \r\n
        last = _BREAK.search(data, max(0, stop - 1 - base))
        if last and last.end() < len(data):
            break
        more = fsio.read(path, end, step)
        if not more:
            break
        data, end, step = data + more, end + len(more), 2 * step
    if start == 0:
        pos = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    else:
        before = _BREAK.search(data)
        if not before:
            return []
        pos = before.end()
    out = []
    while base + pos < stop and pos < len(data):
        at = _BREAK.search(data, pos)
        out.append(data[pos:at.start() if at else len(data)])
        pos = at.end() if at else len(data)
    return out


def read_detected(spark: SparkSession, files: DataFrame, paths, recursive: bool = False,
                  glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(encodings, lines)``: each file's encoding and its numbered, decoded lines."""
    scan = scan_detected(spark, files, paths, recursive, glob)
    return scan.encodings, scan.lines()


def _encodings(files: DataFrame, per_file: DataFrame) -> DataFrame:
    """Label, mark and warning per file from its first bytes and UTF-8 validity."""
    j = files.select(PATH).join(file_heads(files), PATH, "left").join(per_file, PATH, "left")
    bom = F.coalesce(bom_encoding(F.col("head")), bom_encoding(F.col("_first")))
    enc = F.coalesce(bom, F.when(F.coalesce(F.col("_valid"), F.lit(True)), F.lit(UTF8)).otherwise(F.lit(ANSI)))
    return j.select(
        PATH, enc.alias("encoding"), bom.isNotNull().alias("had_bom"), (enc == ANSI).alias("is_fallback"),
        F.when(enc == ANSI, F.lit(ANSI_WARNING)).alias("warning"))


def _decoded(spark: SparkSession, numbered: DataFrame, encodings: DataFrame, per_file: DataFrame | None = None) -> DataFrame:
    """Text of numbered raw lines (with their ``encoding``); UTF-16 files are re-read."""
    base = numbered.where(~F.coalesce(F.col("encoding").isin(UTF16LE, UTF16BE), F.lit(False)))
    extra = [c for c in numbered.columns if c not in (PATH, LINE, TEXT, "encoding")]
    text = F.when(F.col("encoding") == ANSI, decode_ansi(F.col(TEXT))).otherwise(F.col(TEXT))
    out = base.select(PATH, LINE, text.alias(TEXT), *extra)
    wide = encodings.where(F.col("encoding").isin(UTF16LE, UTF16BE)).select(PATH, "encoding")
    if wide.isEmpty():
        return out
    u = read_utf16(wide)
    if per_file is not None:
        u = u.join(per_file, PATH, "left")
    return out.unionByName(u.select(PATH, LINE, TEXT, *extra))


def read_utf16(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, line_no, text)`` of UTF-16 files, given as ``(path, encoding)``.

    Spark's text source looks for the two bytes of a line break at any offset and so
    finds breaks across two characters.  Here files are cut into ranges at even
    offsets, read by tasks of their own; a range owns the lines whose break ends in
    it, breaks count at even offsets only.  The decoded lines are written once and
    numbered from the lines of the ranges before them.
    """
    ship_package(files.sparkSession)

    def cut(frames):
        for frame in frames:
            for path, encoding in zip(frame["path"], frame["encoding"]):
                size = fsio.size(path) or 0
                starts = list(range(0, max(size, 1), range_bytes))
                yield pd.DataFrame({"path": path, "encoding": encoding, "start": starts, "stop": [min(s + range_bytes, size) for s in starts],
                                    "size": size})

    def lines(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                texts = _utf16_lines(r.path, _CHARSET[r.encoding], int(r.start), int(r.stop), int(r.size))
                if texts:
                    yield pd.DataFrame({"path": r.path, "start": int(r.start), "n": range(len(texts)), "text": texts})

    ranges = files.mapInPandas(cut, "path string, encoding string, start long, stop long, size long")
    read = materialize(ranges.repartition(PATH, "start").mapInPandas(lines, "path string, start long, n long, text string"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(PATH).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = read.groupBy(PATH, "start").agg(F.count(F.lit(1)).alias("c")).select(PATH, "start", before.alias("before"))
    return read.join(broadcast_if_small(counts), [PATH, "start"]).select(
        PATH, (F.col("before") + F.col("n") + 1).cast("long").alias(LINE), F.col("text").alias(TEXT))


def _utf16_lines(path: str, charset: str, start: int, stop: int, size: int, step: int = 1 << 20) -> list[str]:
    """The lines whose break ends in ``(start, stop]``; at the file's end also the last one."""
    brk = "\n".encode(charset)
    begin = hi = start
    while hi > 0:  # back to the beginning of the first line owned
        back = max(0, hi - step)
        at = fsio.last_break(fsio.read(path, back, hi - back), back, brk)
        if at is not None:
            begin = at + 2
            break
        begin, hi = back, back
    data = fsio.read(path, begin, stop - begin)
    out, pos = [], 0
    while (nl := fsio.next_break(data, pos, begin, brk)) is not None:
        if begin + nl + 2 > start:
            out.append((begin + pos, data[pos:nl]))
        pos = nl + 2
    if stop == size and begin + pos + (2 if begin + pos == 0 else 0) < size:  # a mark alone is no line
        out.append((begin + pos, data[pos:]))
    return [raw.decode(charset, errors="replace").removeprefix("\ufeff" if at == 0 else "").removesuffix("\r") for at, raw in out]


def force_encoding(files: DataFrame, encoding: str | Mapping[str, str]) -> DataFrame:
    """An ``(path, encoding)`` table forcing one encoding for all files, or per path."""
    if isinstance(encoding, str):
        return files.select(PATH, F.lit(encoding).alias("encoding"))
    m = F.create_map(*[x for k, v in encoding.items() for x in (F.lit(k), F.lit(v))])
    return files.select(PATH, F.coalesce(F.try_element_at(m, F.col(PATH)), F.lit(UTF8)).alias("encoding"))
