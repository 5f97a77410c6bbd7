"""Benchmark decontamination on a distributed positional inverted index.

1. ``build_index`` tokenises every training text once and stores, per document,
   the posting lists of the benchmark's vocabulary: the terms that occur, how
   often, and their word positions, sorted by term.  The index is partitioned by
   document, so a posting list never has to fit one task whatever its term's
   frequency, and intersecting lists needs no shuffle.
2. ``term_counts`` sums the stored frequencies over all documents.
3. ``match`` reads the index.  A window's words are ordered by corpus frequency;
   the rarest word's postings, shifted by its offset in the window, are the
   candidate starts, and the lists of the next words cut them down one by one.
   Lists are cut first with a tolerance of ``slop`` positions (every word near its
   place as the rarest word's occurrence gives it: a proximity match), then exactly (a phrase match).

A window is ``window`` consecutive words of an item; an item with fewer words is
one window.  Windows equal in content are searched once.  The benchmark is the
stated query set: it is taken in blocks of about ``block_chars`` characters, each
with an index of its own, so what a task holds of it is bounded whatever its size.

Defined cases: null or empty texts have no words and no hits; an item without
words, or without an id, is no item; rows of one item id are one item; repeated
rows each get their result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import SLICE_ROWS, boxed, stored, unboxed, with_row_key

WINDOW = 10
SLOP = 3
BLOCK_CHARS = 2_000_000
PAIRS = 1 << 20  # candidate starts looked at in one step

# Byte table of the word rule: letters lowered, digits and non-ASCII kept, the rest separates.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


# ---- benchmark side -----------------------------------------------------------

class Windows:
    """The distinct windows of a block of items, over term numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        for name, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text.encode() if text else None)]
            if not ids:
                continue
            if name not in number:
                number[name] = len(self.names)
                self.names.append(name)
            for at in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[at:at + window]), set()).add(number[name])
        self.size = np.array([len(w) for w in found], np.int64)
        self.words = np.full((len(found), window), -1, np.int64)
        for i, w in enumerate(found):
            self.words[i, :len(w)] = w
        self.item_at = np.concatenate(([0], np.cumsum([len(s) for s in found.values()]))).astype(np.int64)
        self.items = np.array([n for s in found.values() for n in sorted(s)], np.int64)

    def by_rarity(self, counts: dict[int, int]) -> "Plan":
        freq = np.zeros(len(self.terms) + 1, np.int64)
        for t, n in counts.items():
            freq[t] = n
        freq[-1] = np.iinfo(np.int64).max  # padding comes last
        order = np.argsort(freq[self.words], axis=1, kind="stable")
        first = np.argsort(np.take_along_axis(self.words, order, 1)[:, 0], kind="stable")
        return Plan(np.take_along_axis(self.words, order, 1)[first], order[first], self.size[first], first,
                    self.item_at, self.items, self.names)


class Plan:
    """Windows sorted by their rarest term; column k is the k-th rarest word."""

    def __init__(self, terms, offsets, size, number, item_at, items, names):
        self.terms, self.offsets, self.size, self.number = terms, offsets, size, number
        self.item_at, self.items, self.names = item_at, items, names


# ---- index --------------------------------------------------------------------

def _lists(at, values, kind):
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32))).cast(pa.list_(kind))


def build_index(df: DataFrame, terms: dict[bytes, int], text_col: str) -> DataFrame:
    """``df`` without its text, with n_words, terms, freqs and positions (by term)."""
    keep = [c for c in df.columns if c != text_col]
    schema = df.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in (
        ("n_words", "bigint"), ("terms", "array<int>"), ("freqs", "array<int>"), ("positions", "array<int>"))]).schema
    base = max(1, len(terms))

    def run(batches):
        get = terms.get
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                each = [words(t) for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                n = np.fromiter(map(len, each), np.int64, len(each))
                ids = np.fromiter((get(w, -1) for ws in each for w in ws), np.int64, int(n.sum()))
                doc = np.repeat(np.arange(len(each)), n)
                pos = np.arange(ids.size) - np.repeat(np.cumsum(n) - n, n)
                known = ids >= 0
                key = doc[known] * base + ids[known]
                order = np.argsort(key, kind="stable")
                key, pos = key[order], pos[known][order]
                new = np.flatnonzero(np.diff(key, prepend=-1))
                freq = np.diff(np.append(new, key.size))
                bounds = np.arange(len(each) + 1) * base
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [
                        pa.array(n), _lists(np.searchsorted(key[new], bounds), key[new] % base, pa.int32()),
                        _lists(np.searchsorted(key[new], bounds), freq, pa.int32()),
                        _lists(np.searchsorted(key, bounds), pos, pa.int32())],
                    names=[*keep, "n_words", "terms", "freqs", "positions"])

    return df.select(*keep, text_col).mapInArrow(run, schema)


def term_counts(index: DataFrame) -> dict[int, int]:
    """Corpus frequency of every indexed term (as many rows as the block has terms)."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "freqs")).alias("p"))
    return {r[0]: r[1] for r in pairs.groupBy("p.terms").agg(F.sum("p.freqs")).collect()}


# ---- intersection -------------------------------------------------------------

def _within(key, plan, at, start, span, slop):
    """Which candidates (window, start) have all their words within ``slop`` of their place."""
    alive = np.ones(at.size, bool)
    for k in range(plan.terms.shape[1]):
        rows = np.flatnonzero(alive & (plan.size[at] > k))
        if not rows.size:
            break
        term, place = plan.terms[at[rows], k], start[rows] + plan.offsets[at[rows], k]
        low = np.searchsorted(key, term * span + np.maximum(place - slop, 0), "left")
        high = np.searchsorted(key, term * span + np.minimum(place + slop, span - 1), "right")
        alive[rows[high <= low]] = False
    return alive


def intersect(plan: Plan, n_words, term_lists, freq_lists, position_lists, slop: int):
    """Phrase matches (window, document, start) and proximity matches (window, document)."""
    window = plan.terms.shape[1]
    gap = window + 2 * slop + 1
    base = np.cumsum(n_words + gap) - (n_words + gap) + gap  # texts lie apart: no match spans two
    span = int(base[-1] + n_words[-1] + gap) if len(base) else gap
    terms, freqs = term_lists.values.to_numpy().astype(np.int64), freq_lists.values.to_numpy()
    owner = np.repeat(base, np.diff(position_lists.offsets.to_numpy()))
    key = np.sort(np.repeat(terms, freqs) * span + owner + position_lists.values.to_numpy())
    first = np.searchsorted(key, plan.terms[:, 0] * span)
    count = np.searchsorted(key, (plan.terms[:, 0] + 1) * span) - first
    phrases, near = [], []
    live = np.flatnonzero(count)
    cut = np.flatnonzero(np.diff(np.cumsum(count[live]) // PAIRS, prepend=0)) if live.size else []
    for some in np.split(live, cut):
        n = count[some]
        at = np.repeat(some, n)
        list_at = np.repeat(first[some], n) + np.arange(at.size) - np.repeat(np.cumsum(n) - n, n)
        start = key[list_at] % span - plan.offsets[at, 0]
        ok = _within(key, plan, at, start, span, slop)
        at, start = at[ok], start[ok]
        exact = _within(key, plan, at, start, span, 0)
        doc = np.searchsorted(base, start + plan.offsets[at, 0], "right") - 1
        near.append((plan.number[at], doc))
        phrases.append((plan.number[at[exact]], doc[exact], (start - base[doc])[exact], plan.size[at[exact]]))
    join = lambda parts, i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
    return [join(phrases, i) for i in range(4)], [join(near, i) for i in range(2)]


def _items(plan: Plan, window, doc, n_docs):
    """List array: per document the distinct item names of its windows, sorted."""
    pair = np.unique(window * n_docs + doc) if window.size else np.zeros(0, np.int64)
    window, doc = pair // max(n_docs, 1), pair % max(n_docs, 1)
    many = plan.item_at[window + 1] - plan.item_at[window]
    at = np.repeat(plan.item_at[window], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pair = np.unique(np.repeat(doc, many) * max(1, len(plan.names)) + plan.items[at])
    owner, item = pair // max(1, len(plan.names)), pair % max(1, len(plan.names))
    lists = [[] for _ in range(n_docs)]
    for d, i in zip(owner.tolist(), item.tolist()):
        lists[d].append(plan.names[i])
    return pa.array([sorted(x) for x in lists], pa.list_(pa.string()))


def _spans(doc, start, size, n_docs):
    """List array: per document the merged word spans (start, length)."""
    lists = [[] for _ in range(n_docs)]
    order = np.lexsort((start, doc))
    for d, s, n in zip(doc[order].tolist(), start[order].tolist(), size[order].tolist()):
        last = lists[d][-1] if lists[d] else None
        if last and s <= last["start"] + last["length"]:
            last["length"] = max(last["length"], s + n - last["start"])
        else:
            lists[d].append({"start": s, "length": n})
    return pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))


def match(index: DataFrame, plan: Plan, slop: int) -> DataFrame:
    """The index's rows with ``spans`` (hit words), ``items`` and ``near_items``."""
    keep = [c for c in index.columns if c not in ("terms", "freqs", "positions")]
    schema = index.select(*keep, F.lit(None).cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
                          F.lit(None).cast("array<string>").alias("items"),
                          F.lit(None).cast("array<string>").alias("near_items")).schema

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = pa.RecordBatch.from_arrays([c.take(pa.array(range(k, min(k + SLICE_ROWS, batch.num_rows))))
                                                   for c in batch.columns], names=batch.schema.names)
                n = part.num_rows
                (w, d, s, size), (nw, nd) = intersect(plan, part.column("n_words").to_numpy(), part.column("terms"),
                                                      part.column("freqs"), part.column("positions"), slop)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [_spans(d, s, size, n), _items(plan, w, d, n), _items(plan, nw, nd, n)],
                    names=[*keep, "spans", "items", "near_items"])

    return index.select(*keep, "terms", "freqs", "positions").mapInArrow(run, schema)


# ---- operator -----------------------------------------------------------------

def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       slop: int = SLOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``df``: id, row key, n_words, ``spans`` (merged spans of hit words:
    start, length), ``items`` (ids with a phrase match) and ``near_items`` (ids with a
    proximity match, phrase matches included)."""
    ship_package(df.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where(
        "i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    docs = with_row_key(df.select(id_col, text_col), id_col, text_col)
    results = []
    for b in range(blocks):
        block = Windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()], window)
        index = stored(build_index(docs, block.terms, text_col))
        results.append(match(index, block.by_rarity(term_counts(index)), slop))
    if blocks == 1:
        return results[0]
    return _merge_blocks(results, id_col, blocks)


def _merge_blocks(results: list[DataFrame], id_col: str, blocks: int) -> DataFrame:
    """One row per row again: spans and items of all benchmark blocks together."""
    every = results[0]
    for r in results[1:]:
        every = every.union(r)
    grouped = every.groupBy("_k1", "_k2").agg(
        F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        (F.count("*") / blocks).cast("int").alias("copies"))
    runs = F.expr("""aggregate(all_spans, cast(array() as array<struct<start:bigint,length:bigint>>), (a, s) ->
        if(size(a) > 0 and s.start <= element_at(a, -1).start + element_at(a, -1).length,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'length',
             greatest(element_at(a, -1).length, s.start + s.length - element_at(a, -1).start)))),
           concat(a, array(s))))""")
    return grouped.withColumn("spans", runs).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        id_col, "_k1", "_k2", "n_words", "spans", "items", "near_items")


def contamination_report(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of ``find_contamination`` per document of ``documents``."""
    found = find_contamination(df, benchmark, **options)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """``df`` without the rows that hold a phrase of the benchmark."""
    hit = find_contamination(df, benchmark, id_col, text_col, **options).where(F.size("spans") > 0)
    keys = stored(hit.select("_k1", "_k2").distinct())
    if keys.count() <= 1_000_000:  # 16 bytes a row
        keys = F.broadcast(keys)
    return unboxed(boxed(df, id_col, text_col).join(keys, ["_k1", "_k2"], "left_anti"), df.columns)
