"""Packing of documents into training sequences by hierarchical multi-length windows.

A document is its token ids and an end id.  Documents are routed to tiers of context
sizes (4096, 2048, 1024, 512): whole windows of the longest tier are cut from a long
document, its rest and every shorter document go to the smallest tier that holds them.
The tiers are packed from the longest down.  A window starts with the longest document
of its tier; its gap takes the longest whole document that still fits, from whatever
shorter tier, again and again, and what nothing fits is closed by cutting a document,
whose rest stays in the pool.  So every window is exactly full, and a power of two long.
The windows of a tier are dealt into step groups of ``STEP_TOKENS`` tokens each, the
dearest in attention (sum of squared piece lengths) to and fro over the groups, so that
the steps of a tier cost about the same.

Every task packs the documents of its partition in blocks of ``BLOCK_TOKENS`` tokens: no
shuffle, and a task holds a block and its longest document.  What a block leaves over
(under one long window) is carried to the next block; what the last block leaves is cut
into sequences of powers of two, so no sequence needs padding.  A sequence never spans
tasks, and its id holds the task's number: packing the same partitions again gives the
same rows, so a lost executor's task may run again.  Partitions come from a table scan
in the query; a frame of another origin should be written first.

Tokens are those of the ``tokenizers`` library for the given file.  Where the file's
rules allow it (``WordPieces``), words are encoded once and remembered; the memory of
words is bounded and emptied when full.

Defined cases: a null text counts as empty; an empty text is the end id alone; null and
repeated ids are kept as they are (pieces of two documents with one id are told apart by
their sequences only); an empty table gives no sequences; very long texts are encoded in
parts; other columns of the input are not read, so no name of theirs clashes.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import SLICE_ROWS

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 2
TIERS = (4096, 2048, 1024, 512)
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16

# What a Python worker remembers: so many words and characters of them, checked before every part.
MEMORY_WORDS = 500_000
WORD_CHARS = 16
PART_CHARS = 1 << 18  # a text is encoded in parts of about this many characters

PIECE_SCHEMA = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, "
                "step_group long")


# ---- tokens -------------------------------------------------------------------

# Characters that Unicode normalisation leaves alone and whose lower case is one of
# them whatever stands beside it: ASCII and the Latin letters up to U+024F, less a few.
_LATIN = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]]
_PLAIN = "".join(c for c in _LATIN if c.lower() in _LATIN)
_GAPS = re.compile("[\t\n\r ]")


def _class_of(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


class WordPieces:
    """Ids of a text as the library gives them, words remembered.

    The short way needs a file whose rules are: NFC, runs of white space to one blank,
    lower case; then a pattern that keeps its matches only, then bytes.  White space
    then always parts tokens, so a run of plain characters is split into words, each is
    looked up, and the ids of all are gathered at once; a new word is cut by the file's
    own pattern and each match encoded by the library's model.  Words with other
    characters or with an added token go to the library; so does every text under any
    other rules.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.coder = Tokenizer.from_str(spec)
        self.words, self.matches = _Remembered(self._add), _Remembered(self._encoded)
        self._forget()
        self.pattern = self._short_way(json.loads(spec))

    def _forget(self) -> None:
        """Words are numbered; word k has the ids from bounds[k] to bounds[k + 1]."""
        self.words.clear()
        self.matches.clear()
        self.flat, self.bounds, self.chars = array("I"), array("q", [0]), 0

    def _short_way(self, spec: dict) -> re.Pattern | None:
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        added = [t["content"] for t in spec.get("added_tokens") or []]
        fits = ([s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": "\\s+"}
                and steps[1].get("content") == " " and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
                and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and "Regex" in cuts[0].get("pattern", {})
                and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
                and not any(_GAPS.search(t) for t in added) and not any(t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or []))
        if not fits:
            return None
        self.special = re.compile("|".join(["[^" + re.escape(_PLAIN) + "]", *map(re.escape, added)]))
        self.bytewise = {ord(c): "".join(part for part, _ in self.coder.pre_tokenizer.pre_tokenize_str(c)) for c in _PLAIN if not c.isspace()}
        pattern = cuts[0]["pattern"]["Regex"]
        for name, chars in (("\\p{L}", _class_of("L")), ("\\p{N}", _class_of("N")), ("\\s", "\\t\\n\\r ")):
            pattern = pattern.replace(name, chars)
        return None if "\\p" in pattern else re.compile(pattern)

    def _encoded(self, match: str) -> tuple[int, ...]:
        if not match.isascii():
            match = match.translate(self.bytewise)
        return tuple([t.id for t in self.coder.model.tokenize(match)])

    def _add(self, word: str) -> int:
        for match in self.pattern.findall(word):
            self.flat.extend(self.matches[match])
        self.bounds.append(len(self.flat))
        self.chars += len(word)
        return len(self.bounds) - 2

    def _plain(self, text: str) -> np.ndarray:
        if len(self.words) >= MEMORY_WORDS or self.chars >= MEMORY_WORDS * WORD_CHARS:
            self._forget()
        words = text.lower().split()
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        bounds, flat = np.frombuffer(self.bounds, np.int64), np.frombuffer(self.flat, np.uint32)
        starts = bounds[at]
        counts = bounds[at + 1] - starts
        ends = np.cumsum(counts)
        return flat[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def _part(self, text: str) -> np.ndarray:
        if not self.special.search(text):
            return self._plain(text)
        found, run = [], []
        for word in _GAPS.split(text):
            if self.special.search(word):
                found += [self._plain(" ".join(run)), np.array(self.coder.encode(word, add_special_tokens=False).ids, dtype=np.uint32)]
                run = []
            else:
                run.append(word)
        return np.concatenate([*found, self._plain(" ".join(run))])

    def ids(self, text: str) -> np.ndarray:
        if self.pattern is None:
            return np.array(self.coder.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if len(text) <= PART_CHARS:
            return self._part(text)
        parts, at = [], 0
        while at < len(text):
            gap = _GAPS.search(text, at + PART_CHARS) if at + PART_CHARS < len(text) else None
            to = gap.start() if gap else len(text)
            parts.append(self._part(text[at:to]))
            at = to
        return np.concatenate(parts)


class _Remembered(dict):
    def __init__(self, found):
        self.found = found

    def __missing__(self, word: str):
        value = self[word] = self.found(word)
        return value


_coders: dict[int, WordPieces] = {}


def _coder(spec: str) -> WordPieces:
    """The worker's coder for a file: later tasks of the worker find its words."""
    key = hash(spec)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordPieces(spec)
    return _coders[key]


# ---- windows ------------------------------------------------------------------

class Pool:
    """Pieces (document, start, length) by length."""

    def __init__(self):
        self.stacks: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length == 0:
            return
        if length not in self.stacks:
            self.stacks[length] = []
            bisect.insort(self.lengths, length)
        self.stacks[length].append((doc, start))
        self.tokens += length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        k = bisect.bisect_right(self.lengths, most) - 1
        if k < 0:
            return None
        length = self.lengths[k]
        doc, start = self.stacks[length].pop()
        if not self.stacks[length]:
            del self.stacks[length], self.lengths[k]
        self.tokens -= length
        return doc, start, length


def fill(pool: Pool, size: int) -> list[tuple[int, int, int]]:
    """A full window of ``size`` from a pool that holds as many tokens: the longest piece
    that fits, the longest that fits the gap, and so on; the last gap by a cut."""
    window, gap = [], size
    while gap:
        piece = pool.take(gap)
        if piece is None:
            doc, start, length = pool.take(pool.lengths[-1])
            piece = doc, start, gap
            pool.put(doc, start + gap, length - gap)
        window.append(piece)
        gap -= piece[2]
    return window


def windows(pool: Pool, tiers: Sequence[int], last: bool) -> Iterator[list[tuple[int, int, int]]]:
    """Takes full windows out of the pool, tier by tier.  Under a window of the longest tier
    is left over, and with ``last`` nothing (sequences of powers of two)."""
    for k, size in enumerate(tiers):
        above = tiers[k + 1] if k + 1 < len(tiers) else 0
        while pool.lengths and pool.lengths[-1] > above and pool.tokens >= size:
            yield fill(pool, size)
        if not last and pool.tokens < tiers[0]:
            return
    while last and pool.tokens:
        yield fill(pool, 1 << (pool.tokens.bit_length() - 1))


def balanced(found: list[list[tuple]], per_group: int) -> list[list[list[tuple]]]:
    """Groups of ``per_group`` windows each, the dearest dealt to and fro."""
    groups: list[list] = [[] for _ in range(len(found) // per_group)]
    for k, window in enumerate(sorted(found, key=lambda w: -sum(p[2] ** 2 for p in w))):
        turn, at = divmod(k, len(groups))
        groups[at if turn % 2 == 0 else len(groups) - 1 - at].append(window)
    return groups


class Packer:
    """Packs the documents of a task, block by block, into rows of PIECE_SCHEMA."""

    def __init__(self, task: int, tiers: Sequence[int], step_tokens: int, block_tokens: int):
        self.tiers, self.step_tokens, self.block_tokens = sorted(tiers, reverse=True), step_tokens, block_tokens
        self.pool = Pool()
        self.docs: dict[int, tuple[object, np.ndarray]] = {}
        self.n_docs, self.waiting = 0, {size: [] for size in self.tiers}
        self.sequence, self.group = task << 40, task << 40

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs[self.n_docs] = (doc_id, ids)
        longest, at = self.tiers[0], 0
        while len(ids) - at >= longest:
            self.waiting[longest].append([(self.n_docs, at, longest)])
            at += longest
        self.pool.put(self.n_docs, at, len(ids) - at)
        self.n_docs += 1

    def full(self) -> bool:
        return sum(len(w) * size for size, w in self.waiting.items()) + self.pool.tokens >= self.block_tokens

    def packed(self, last: bool) -> Iterator[tuple]:
        rest: list[list[tuple]] = []
        for window in windows(self.pool, self.tiers, last):
            size = sum(p[2] for p in window)
            (self.waiting[size] if size in self.waiting else rest).append(window)
        for size, found in self.waiting.items():
            per_group = max(1, self.step_tokens // size)
            whole = len(found) // per_group * per_group
            for group in balanced(found[:whole], per_group) if whole else []:
                yield from self._rows(group)
            self.waiting[size] = found[whole:]
        if last:
            group, tokens = [], 0
            for window in [*chain.from_iterable(self.waiting.values()), *rest]:
                size = sum(p[2] for p in window)
                if group and tokens + size > self.step_tokens:
                    yield from self._rows(group)
                    group, tokens = [], 0
                group.append(window)
                tokens += size
            yield from self._rows(group)
            self.waiting = {size: [] for size in self.tiers}
        held = {p[0] for found in self.waiting.values() for w in found for p in w}
        held |= {doc for stack in self.pool.stacks.values() for doc, _ in stack}
        self.docs = {k: d for k, d in self.docs.items() if k in held}

    def _rows(self, group: list[list[tuple]]) -> Iterator[tuple]:
        for window in group:
            offset, size = 0, sum(p[2] for p in window)
            for doc, start, length in window:
                doc_id, ids = self.docs[doc]
                yield (doc_id, start, length, ids[start:start + length].astype("<u4").tobytes(), len(ids), self.sequence, offset, size, self.group)
                offset += length
            self.sequence += 1
        self.group += 1


# ---- operator -----------------------------------------------------------------

def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID,
         tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: the id, ``start`` and ``length`` in the document, its ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` there, the sequence's ``window``
    and ``step_group``."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    given = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", given.schema["_id"].dataType), *T._parse_datatype_string(PIECE_SCHEMA).fields])

    def run(batches):
        coder = _coder(spec.value)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, block_tokens)
        end = np.array([end_id], dtype=np.uint32)
        kind = None

        def tables(last):
            rows = packer.packed(last)
            while part := [row for _, row in zip(range(SLICE_ROWS * 4), rows)]:
                columns = list(zip(*part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], kind), *[pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns[1:], start=1)]],
                    names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    packer.add(doc_id, np.concatenate([coder.ids(text.as_py()), end]))
                    if packer.full():
                        yield from tables(False)
        if kind is not None:
            yield from tables(True)

    return given.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def padded(length: Column, longest: int = TIERS[0]) -> Column:
    """Length of a sequence of so many tokens with its padding: none at a power of two."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(longest)).cast("bigint")


def packed_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with a checksum of their ids."""
    return pack(docs, vocabulary=vocabulary).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")
