"""What the tail source knows of growing files: which there are and how far they are planned.

``Folders`` finds files without touching all of them at every trigger.  A folder is
listed only when its time of change differs from the last listing (or is too young to
tell); a file is looked at when it is new, was seen growing lately, or its turn has
come in a rotation over the idle ones.  Storage without folder times is listed as a
whole, which brings sizes along.

``PositionLog`` keeps the planned positions in the query's checkpoint folder: one small
entry per batch with the changed files only, and a table of all files now and then.
An entry is written before its number is handed to Spark as an offset, so a batch that is
planned again reads the same bytes, and a restart goes on where the log ends.
"""

from __future__ import annotations

import fnmatch
import json
import re
import time
import zlib

from ..sources import fsio

HOT_SECONDS = 60  # a file that grew so lately is looked at on every trigger
SETTLED_SECONDS = 2  # a folder changed so lately is listed again
FINGERPRINT_BYTES = 256
TABLE_EVERY = 64  # entries between two tables of all files
KEEP_ENTRIES = 256  # entries kept behind a committed one


class Folders:
    """Files below a folder (or one file) whose names match, found with little listing."""

    def __init__(self, path: str, patterns: list[str], idle_per_poll: int):
        self.root, self.idle_per_poll = path, idle_per_poll
        self.wanted = re.compile("|".join(fnmatch.translate(p.lower()) for p in patterns))
        self.whole = None
        if "://" not in path and any(c in path for c in "*?["):
            self.whole = re.compile(_glob_pattern(path))
            self.root = path[:min(path.index(c) for c in "*?[" if c in path)].rpartition("/")[0] or "."
        self.folders: dict[str, tuple[int | None, list[str], list[str]]] = {}  # folder -> (time, files, folders)
        self.grew: dict[str, float] = {}
        self.idle: list[str] = []
        self.listed = 0  # folders listed and files looked at, of the last poll
        self.looked = 0

    def _wanted(self, path: str) -> bool:
        return bool(self.whole.match(path) if self.whole else self.wanted.match(path.rsplit("/", 1)[-1].lower()))

    def _list(self, folder: str, now: float, found: dict) -> None:
        """Lists a folder if it may have changed; goes through the folders below it."""
        stamp = fsio.changed_at(folder)
        known = self.folders.get(folder)
        if known is None or stamp is None or stamp != known[0]:
            self.listed += 1
            entries = fsio.children(folder)
            if entries is None:  # gone or locked: what is known of it stays
                return
            files = [(p, size, at) for p, is_folder, size, at in entries if not is_folder and self._wanted(p)]
            before = set(known[1]) if known else set()
            for p, size, at in files:
                if p not in before or stamp is None:
                    found[p] = (size, at)
                if p not in before and now - at / 1e9 <= HOT_SECONDS:
                    self.grew[p] = now
            settled = stamp is not None and now - stamp / 1e9 > SETTLED_SECONDS
            known = (stamp if settled else -1 if stamp is not None else None, [f[0] for f in files], [e[0] for e in entries if e[1]])
            self.folders[folder] = known
        for sub in known[2]:
            self._list(sub, now, found)

    def poll(self) -> dict[str, tuple[int, int]]:
        """path -> (size, time of change) of the files that may have news."""
        now, found = time.time(), {}
        self.listed = self.looked = 0
        info = fsio.look([self.root])
        if info.get(self.root):
            found[self.root] = info[self.root]
            return found
        self._list(self.root, now, found)
        self.grew = {p: t for p, t in self.grew.items() if now - t <= HOT_SECONDS}
        if not self.idle:
            self.idle = [p for _, files, _ in self.folders.values() for p in files]
        turn, self.idle = self.idle[:self.idle_per_poll], self.idle[self.idle_per_poll:] if self.idle_per_poll else []
        paths = [p for p in dict.fromkeys([*self.grew, *turn]) if p not in found]
        self.looked = len(paths)
        found.update({p: at for p, at in fsio.look(paths).items() if at})
        return found

    def saw_growth(self, path: str) -> None:
        self.grew[path] = time.time()


def _glob_pattern(path: str) -> str:
    """``**`` spans folders, ``*`` and ``?`` stay in one; names that begin with a dot only where written."""
    out = []
    for piece in re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]*\])", path):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or
                   (piece.replace("[!", "[^", 1) if piece.startswith("[") and piece.endswith("]") else re.escape(piece)))
    return "".join(out) + r"\Z"


# ---- positions ----------------------------------------------------------------

def fingerprint(path: str, upto: int) -> list[int]:
    """Checksums of a file's first bytes and of the last ones before ``upto``."""
    n = min(FINGERPRINT_BYTES, upto)
    return [n, zlib.crc32(fsio.read(path, 0, n)), zlib.crc32(fsio.read(path, upto - n, n))]


def advanced(path: str, size: int, at: int, pos: dict | None, most: int) -> dict | None:
    """The next position of a file, with the range ``from``..``to`` of its new bytes; None without news.

    A position holds the generation ``g``, the end ``to`` of what is planned, time ``m`` and fingerprint
    ``f`` of the file then, and, of a file that is not read from its start, ``s`` (bytes up to there only
    count lines) or ``first`` (first line wanted).  A file shorter than its position, or whose bytes there
    are not the ones that were read, has been replaced: it is read from the start as a new generation.
    """
    pos = pos or {"g": 0, "to": 0, "m": None, "f": None}
    if (size, at) == (pos["to"], pos["m"]):
        return None
    if size < pos["to"] or (pos["to"] > 0 and pos["f"] is not None and fingerprint(path, pos["to"]) != pos["f"]):
        to = min(size, most)
        return {"g": pos["g"] + 1, "from": 0, "to": to, "m": at, "f": fingerprint(path, to)}
    start, skip = pos["to"], pos.get("s", 0)
    to = min(size, max(start, skip) + most)
    if to == start:
        return None
    kept = {**({"s": skip} if skip > start else {}), **({"first": pos["first"]} if "first" in pos else {})}
    return {"g": pos["g"], "from": start, "to": to, "m": at, "f": fingerprint(path, to), **kept}


class PositionLog:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.seq, self.positions = 0, {}
        self.exists = False

    def _name(self, seq: int, kind: str) -> str:
        return f"{self.folder}/{seq:012d}.{kind}"

    def _stored(self, kind: str) -> list[int]:
        return sorted(int(p.rsplit("/", 1)[1].split(".")[0]) for p in fsio.list_files(self.folder, f"*.{kind}"))

    def load(self) -> None:
        tables, entries = self._stored("table"), self._stored("entry")
        if tables:
            self.exists = True
            self.seq, self.positions = tables[-1], self._read(tables[-1], "table")
        for seq in entries:
            if seq > self.seq:
                self.positions.update(self._read(seq, "entry"))
                self.seq = seq

    def _read(self, seq: int, kind: str) -> dict:
        name = self._name(seq, kind)
        return json.loads(fsio.read(name, 0, fsio.size(name) or 0))

    def begin(self, positions: dict) -> None:
        self.positions, self.exists = positions, True
        fsio.write(self._name(0, "table"), json.dumps(positions).encode())

    def append(self, changes: dict) -> int:
        self.seq += 1
        fsio.write(self._name(self.seq, "entry"), json.dumps(changes).encode())
        self.positions.update(changes)
        if self.seq % TABLE_EVERY == 0:
            fsio.write(self._name(self.seq, "table"), json.dumps(self.positions).encode())
        return self.seq

    def between(self, after: int, upto: int) -> list[dict]:
        return [self._read(seq, "entry") for seq in range(after + 1, upto + 1)]

    def forget(self, committed: int) -> None:
        """Removes entries that no batch can ask for and no restart needs."""
        tables = [t for t in self._stored("table") if t <= committed - KEEP_ENTRIES]
        if not tables:
            return
        for seq in self._stored("entry"):
            if seq <= tables[-1]:
                fsio.remove(self._name(seq, "entry"))
        for seq in tables[:-1]:
            fsio.remove(self._name(seq, "table"))
