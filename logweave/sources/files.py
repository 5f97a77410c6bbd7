"""Workspace scan: every log file under a root, as a DataFrame of file metadata.

Mounted folders are listed by tasks, every file in them (empty ones and names with
``_`` or ``.`` in front too; the lines of the latter are read by ``encoding.scan_ranges``).  In
object stores and HDFS Spark's own listing (``binaryFile`` with
``recursiveFileLookup``) does the walk; it hides such names and zero-length files.
No file content is read.  Extensions match ignoring case.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import PATH
from ..plans.sizing import materialize
from ..session import ship_package
from . import fsio

DEFAULT_EXTENSIONS = (".log",)

# Entries in one frame of a listing task.
LISTED_FILES = 10_000


class WorkspaceNotFoundError(FileNotFoundError):
    pass


def normalize_extensions(exts: Iterable[str] | None) -> list[str]:
    """Trim, add a leading dot, drop blanks and case-insensitive duplicates; empty -> ``.log``."""
    seen: dict[str, str] = {}
    for e in exts or ():
        e = (e or "").strip()
        if not e:
            continue
        if not e.startswith("."):
            e = "." + e
        seen.setdefault(e.lower(), e)
    return list(seen.values()) or list(DEFAULT_EXTENSIONS)


def _ci(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else ("\\" + c if c in "[]{}*?\\," else c) for c in text)


def extension_glob(exts: Iterable[str] | None) -> str:
    """Case-insensitive file-name glob for the extensions, e.g. ``*.[lL][oO][gG]``."""
    parts = [_ci(e) for e in normalize_extensions(exts)]
    return "*" + parts[0] if len(parts) == 1 else "*{" + ",".join(parts) + "}"


def scan_workspace(spark: SparkSession, root: str, extensions: Iterable[str] | None = None) -> DataFrame:
    """``(path, dir, name, ext, length, modified)`` of every matching file below ``root``
    (or of ``root`` itself when it names one file)."""
    if "://" not in root and not os.path.exists(root):
        raise WorkspaceNotFoundError(f"Workspace root not found: {root}")
    single = "://" not in root and os.path.isfile(root)  # a file named explicitly is taken as is
    if "://" not in root or root.startswith("file:"):
        df = _list_mounted(spark, root, None if single else [e.lower() for e in normalize_extensions(extensions)])
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        df = reader.option("pathGlobFilter", extension_glob(extensions)).load(root)
    path = F.col("path")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return df.select(
        path.alias(PATH),
        F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"),
        name.alias("name"),
        F.regexp_extract(name, "(\\.[^.]*)$", 1).alias("ext"),
        F.col("length").cast("long").alias("length"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
    )


def _list_mounted(spark: SparkSession, root: str, endings: list[str] | None) -> DataFrame:
    """(path, length, modificationTime) of every file below a folder that executors see as mounted.

    One task lists the root, then one per folder in it lists the tree below: no
    listing on the driver, and neither empty files nor names with ``_`` or ``.`` in
    front are left out.  A task holds one folder's entries and one frame, never a tree.
    """
    ship_package(spark)
    row = "path string, is_dir boolean, length long, modificationTime timestamp"
    columns = ["path", "is_dir", "length", "modificationTime"]

    def listing(deep: bool):
        def run(frames):
            rows = []
            for frame in frames:
                for path in frame["path"]:
                    for entry in fsio.entries(path, deep):
                        if entry[1] or endings is None or entry[0].lower().endswith(tuple(endings)):
                            rows.append(entry)
                        if len(rows) == LISTED_FILES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        return run

    start = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path"))  # from the JVM: a list would take Python workers on every core
    top = start.mapInPandas(listing(False), row)
    folders = top.where("is_dir").select("path").repartition(F.col("path"))
    below = folders.mapInPandas(listing(True), row)
    return top.union(below).where("not is_dir").select("path", "length", "modificationTime")


def read_workspace(spark: SparkSession, root: str, extensions: Iterable[str] | None = None,
                   encoding: str | None = None):
    """Scan a workspace and return ``(files, encodings, lines)`` DataFrames.

    ``lines`` are numbered and decoded with each file's detected encoding, or
    with ``encoding`` forced for all files.
    """
    from .encoding import force_encoding, read_decoded

    if encoding:
        files = scan_workspace(spark, root, extensions)
        enc = force_encoding(files, encoding)
        return files, enc, read_decoded(spark, enc, root, recursive=True, glob=workspace_glob(root, extensions))
    files, scan = detect_workspace(spark, root, extensions)
    return files, scan.encodings, scan.lines()


def workspace_glob(root: str, extensions: Iterable[str] | None) -> str | None:
    """File-name filter of a workspace scan; none for a root that names one file."""
    return None if ("://" not in root and os.path.isfile(root)) else extension_glob(extensions)


def detect_workspace(spark: SparkSession, root: str, extensions: Iterable[str] | None = None):
    """``(files, scan)``: the files, listed once and written, and their written scan with detected encodings."""
    from .encoding import scan_detected

    files = materialize(scan_workspace(spark, root, extensions))
    return files, scan_detected(spark, files, root, recursive=True, glob=workspace_glob(root, extensions))
