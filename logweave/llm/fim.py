"""Fill-in-middle transformation on SWAR words.

A text is cut into units (white space before a word and the word; white space at the
end is a unit of its own), two unit positions are drawn from a hash of the id, and the
prefix, middle and suffix are written in suffix-prefix-middle (spm) or
prefix-suffix-middle (psm) order behind markers; a share of the texts stays plain.

The cut points are found without decoding or splitting the text.  The UTF-8 bytes of a
slice of rows are viewed as 64-bit words; three additions and some masks mark every
byte that ends a unit by its high bit, eight bytes at a time.  ``bitwise_count`` gives
the marks of each word and their running sum is the index: the k-th unit end is found by
a search of the running sums for its word, then resolved inside the word by a multiply
(running counts of its eight bytes) and a byte-wise compare.  The same rank on the
leading bytes of characters turns byte positions into code points.

Work is one pass over the rows, no shuffle; a slice holds about ``SLICE_BYTES`` of text
or one text, so the arrays of a step are bounded by that.

Defined cases: a null text counts as empty; an empty text has no units and stays plain; a
null id is drawn as the empty string; repeated rows and ids give repeated results;
an empty table gives an empty one; other columns of the input are not read, so no name
of theirs clashes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

# The form's rules.
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

SLICE_BYTES = 8 << 20  # bytes of text whose words are held at once; bounds memory, not results

_HIGH, _LOW7 = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
_EACH = np.uint64(0x0101010101010101)
_1, _7, _8, _56 = (np.uint64(n) for n in (1, 7, 8, 56))


def _repeated(byte: int) -> np.uint64:
    return _EACH * np.uint64(byte)


def white_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a blank or 0x09 to 0x0D.

    No sum leaves its byte: seven-bit values plus at most 0x7F stay under 0x100.
    """
    low = words & _LOW7
    from_9, from_14 = low + _repeated(0x80 - 9), low + _repeated(0x80 - 14)
    apart = words ^ _repeated(0x20)
    not_blank = ((apart & _LOW7) + _LOW7) | apart
    return ((from_9 & ~from_14 & ~words) | ~not_blank) & _HIGH


def unit_ends(words: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a unit: it is not white and the next byte is,
    or it is the last of its text (``lasts``: their places)."""
    white = white_bytes(words)
    following = white >> _8
    following[:-1] |= white[1:] << _56
    ends = ~white & following & _HIGH
    ends.view(np.uint8)[lasts] |= 0x80
    return ends


def leading_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a character (is not 10xxxxxx)."""
    return _HIGH & ~(words & ~(words << _1))


class Marks:
    """Rank and select over the marked bytes of a run of words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)  # marks in this word and before it

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before the bytes ``at``."""
        word, part = at >> 3, (at & 7).astype(np.uint64)
        inside = np.bitwise_count(self.words[word] & ((_1 << (part * _8)) - _1)).astype(np.int64)
        return self.upto[word] - np.bitwise_count(self.words[word]).astype(np.int64) + inside

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th marks, counted from 1."""
        word = np.searchsorted(self.upto, k, side="left")
        marks = self.words[word]
        left = k - (self.upto[word] - np.bitwise_count(marks).astype(np.int64))
        running = (marks >> _7) * _EACH  # byte i: marks in the bytes up to i
        reached = ((running | _HIGH) - left.astype(np.uint64) * _EACH) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64)


def _bytes_and_bounds(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls and the n + 1 bounds of its values."""
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if data is not None else b""), bounds - bounds[0]


def cut_points(data: bytes, bounds: np.ndarray, first: np.ndarray, second: np.ndarray):
    """Per text: units n, the byte places of both cuts (the draws modulo n + 1, in order),
    and the code points of prefix and middle."""
    words = np.zeros(len(data) // 8 + 1, dtype="<u8")
    words.view(np.uint8)[:len(data)] = np.frombuffer(data, np.uint8)
    starts, stops = bounds[:-1], bounds[1:]
    units = Marks(unit_ends(words, stops[stops > starts] - 1))
    before = units.rank(starts)
    n = units.rank(stops) - before
    one, two = first % (n + 1), second % (n + 1)
    cuts = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        cut = starts.copy()
        inside = k > 0
        cut[inside] = units.select((before + k)[inside]) + 1
        cuts.append(cut)
    chars = Marks(leading_bytes(words))
    at = [chars.rank(place) for place in (starts, *cuts)]
    return n, cuts[0], cuts[1], at[1] - at[0], at[2] - at[1]


def _slices(column: pa.Array):
    """(from, to) row ranges of about SLICE_BYTES of text, of one row at least."""
    _, bounds = _bytes_and_bounds(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to
        at = to


def _transformed(part: pa.RecordBatch, percent: int, spm_percent: int, markers: Sequence[bytes]) -> pa.RecordBatch:
    ids, texts, *draws = part.columns
    h1, h2, h3, h4 = (d.to_numpy() for d in draws)
    data, bounds = _bytes_and_bounds(texts)
    n, low, high, prefix_chars, middle_chars = cut_points(data, bounds, h1, h2)
    plain = (np.diff(bounds) == 0) | (h3 % 100 >= percent)
    if any(m in data for m in markers):
        plain |= np.array([any(data.find(m, s, e) >= 0 for m in markers) for s, e in zip(bounds[:-1], bounds[1:])])
    spm = h4 % 100 < spm_percent
    p, s, m = markers
    outputs = []
    for i, (start, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if plain[i]:
            outputs.append(data[start:stop])
            continue
        a, b = int(low[i]), int(high[i])
        head, tail = (p, data[start:a]), (s, data[b:stop])
        outputs.append(b"".join([*(tail + head if spm[i] else head + tail), m, data[a:b]]))
    return pa.RecordBatch.from_arrays([
        ids, pa.array(n), pa.array(np.where(plain, PLAIN, np.where(spm, SPM, PSM)).tolist(), pa.string()),
        pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), pa.array(outputs, pa.binary()).view(pa.string()),
    ], names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws from the id: the first hex groups of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT, markers: Sequence[str] = MARKERS) -> DataFrame:
    """The id, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain) and
    the ``output`` text of every row."""
    ship_package(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
                        *[d.alias(f"_h{k}") for k, d in enumerate(draws(F.col(f"`{id_col}`"), seed), start=1)])
    marks = [m.encode("utf-8") for m in markers]

    def run(batches):
        for batch in batches:
            for at, to in _slices(batch.column(1)):
                yield _transformed(batch.slice(at, to - at), percent, spm_percent, marks)

    kinds = T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output string")
    schema = T.StructType([T.StructField("_id", given.schema["_id"].dataType), *kinds.fields])
    return given.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that a form was made of, from the form alone (no text that takes a form holds a marker)."""
    parts = F.split(output, "|".join("\\Q" + m + "\\E" for m in markers), -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == PSM, F.concat(piece(1), piece(3), piece(2))).when(
        form == SPM, F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def transformed_documents(docs: DataFrame) -> DataFrame:
    """The transformation of every document with digests of the output and of the text rebuilt from it."""
    done = fill_in_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
