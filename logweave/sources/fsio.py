"""Small file-system access for code that runs in Python workers (tail ranges, file heads).

Goes through ``pyarrow.fs``, so local paths, ``file:`` URIs and -- where pyarrow
is built and configured for them -- ``s3://`` / ``hdfs://`` URIs all work the
same way.  ``s3a://`` (Spark's name) is read as ``s3://``.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from urllib.parse import quote, urlparse

from pyarrow import fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path inside it) for a local path, or a URI as Spark lists files:
    its path is not percent-encoded, so ``50%.log`` and ``a#b.log`` mean themselves."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        if scheme == "file":
            uri = "/" + rest[2:].partition("/")[2] if rest.startswith("//") else rest
        return pafs.LocalFileSystem(), uri
    if scheme == "s3a":
        scheme = "s3"
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def _join(uri: str, inner: str) -> str:
    """A path listed inside ``uri``'s file system, in the caller's form."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return inner
    return f"{u.scheme}://{u.netloc}/{inner.lstrip('/')}"


def size(uri: str) -> int | None:
    """File size in bytes; None when it does not exist or cannot be read."""
    try:
        fsys, p = resolve(uri)
        info = fsys.get_file_info(p)
    except (OSError, ValueError):
        return None
    return info.size if info.type == pafs.FileType.File else None


def list_files(uri: str, pattern: str) -> list[str]:
    """Files at ``uri``: the file itself, or files below a folder whose name matches
    ``pattern`` (ignoring case)."""
    try:
        fsys, p = resolve(uri)
        info = fsys.get_file_info(p)
        if info.type == pafs.FileType.File:
            return [uri]
        if info.type != pafs.FileType.Directory:
            return []
        found = fsys.get_file_info(pafs.FileSelector(p, recursive=True))
    except (OSError, ValueError):
        return []
    pat = pattern.lower()
    return sorted(_join(uri, f.path) for f in found
                  if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name.lower(), pat))


def entries(path: str, deep: bool) -> Iterator[tuple]:
    """(path as Spark lists it, is a folder, length, time of change) of a mounted folder's
    entries, of the whole tree below with ``deep``; of a file itself.  Folders are listed one
    after the other, so a tree is never held whole."""
    fsys, inner = resolve(path)
    info = fsys.get_file_info(inner)
    folders = [inner] if info.type == pafs.FileType.Directory else []
    if info.type == pafs.FileType.File:
        yield _entry(info)
    while folders:
        found = [f for f in fsys.get_file_info(pafs.FileSelector(folders.pop(), recursive=False))
                 if f.type in (pafs.FileType.File, pafs.FileType.Directory)]
        if deep:
            folders += [f.path for f in found if f.type == pafs.FileType.Directory]
        yield from map(_entry, found)


def _entry(f: pafs.FileInfo) -> tuple:
    return "file:" + os.path.abspath(f.path), f.type == pafs.FileType.Directory, f.size or 0, f.mtime


def children(folder: str) -> list[tuple] | None:
    """(path, is a folder, size, time of change in ns) of a folder's entries; None when it cannot be listed."""
    try:
        fsys, inner = resolve(folder)
        found = fsys.get_file_info(pafs.FileSelector(inner, recursive=False))
    except (OSError, ValueError):
        return None
    return [(_join(folder, f.path), f.type == pafs.FileType.Directory, f.size or 0, f.mtime_ns or 0)
            for f in found if f.type in (pafs.FileType.File, pafs.FileType.Directory)]


def look(paths: list[str]) -> dict[str, tuple[int, int] | None]:
    """(size, time of change in ns) of each file; None for one that is no file or cannot be read."""
    out: dict[str, tuple[int, int] | None] = {}
    for path in paths:
        try:
            fsys, inner = resolve(path)
            info = fsys.get_file_info(inner)
        except (OSError, ValueError):
            out[path] = None
            continue
        out[path] = (info.size, info.mtime_ns or 0) if info.type == pafs.FileType.File else None
    return out


def changed_at(folder: str) -> int | None:
    """A folder's time of change in ns; None where the storage has none."""
    try:
        fsys, inner = resolve(folder)
        info = fsys.get_file_info(inner)
    except (OSError, ValueError):
        return None
    return info.mtime_ns if info.type == pafs.FileType.Directory and isinstance(fsys, pafs.LocalFileSystem) else None


def write(uri: str, data: bytes) -> None:
    """A file written as a whole: under another name first, so no reader sees half of it."""
    fsys, inner = resolve(uri)
    fsys.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.part"
    with fsys.open_output_stream(part) as fh:
        fh.write(data)
    fsys.move(part, inner)


def remove(uri: str) -> None:
    fsys, inner = resolve(uri)
    try:
        fsys.delete_file(inner)
    except FileNotFoundError:
        pass


def read(uri: str, start: int, length: int) -> bytes:
    """``length`` bytes from ``start`` (fewer at end of file)."""
    fsys, p = resolve(uri)
    with fsys.open_input_file(p) as fh:
        fh.seek(start)
        return fh.read(length)


# ---- line breaks in raw bytes ---------------------------------------------------
def line_break(head: bytes) -> tuple[bytes, str | None]:
    """A file's line break and charset from its first bytes (None: UTF-8 or Windows-1252)."""
    if head[:2] == b"\xff\xfe":
        return b"\n\x00", "utf-16-le"
    if head[:2] == b"\xfe\xff":
        return b"\x00\n", "utf-16-be"
    return b"\n", None


def next_break(data: bytes, pos: int, begin: int, brk: bytes) -> int | None:
    """Index of the next line break; of two bytes only at an even offset of the file."""
    at = data.find(brk, pos)
    while at >= 0 and (begin + at) % len(brk):
        at = data.find(brk, at + 1)
    return at if at >= 0 else None


def count_breaks(data: bytes, begin: int, brk: bytes) -> int:
    """Line breaks in the data."""
    if len(brk) == 1:
        return data.count(brk)
    n, at = 0, next_break(data, 0, begin, brk)
    while at is not None:
        n, at = n + 1, next_break(data, at + len(brk), begin, brk)
    return n


def last_break(data: bytes, begin: int, brk: bytes) -> int | None:
    """File offset of the last line break that lies wholly in the data."""
    at = data.rfind(brk)
    while at >= 0 and (begin + at) % len(brk):
        at = data.rfind(brk, 0, at + len(brk) - 1)
    return begin + at if at >= 0 else None
