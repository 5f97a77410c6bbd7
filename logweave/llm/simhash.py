"""SimHash near-duplicates through distributed vantage-point trees.

Fingerprint: 64 bits over the XXH64 hashes (seed 42) of all word shingles; two
texts link when their fingerprints differ in at most ``max_bits`` bits.

Search.  The 64 bits are cut into ``blocks`` bit ranges.  Two fingerprints within
``max_bits`` agree up to ``max_bits // blocks`` bits in at least one range (else
the differences would add up to more), so each range gets a vantage-point tree of
its own over the range's Hamming distance with that small radius: the triangle
bound prunes almost every branch, where a radius of 4 over 64 random bits would
prune almost none.  A tree node holds a vantage value v and a threshold t: points
with d(x, v) <= t go inside, the others outside, and those outside with
d(x, v) <= t + radius overlap the boundary and visit the inside as well.  Any two
points within the radius therefore meet in at least one leaf.

The top levels of each tree are built from a sample of distinct fingerprints, which
grows with the number of shards (``MAX_SAMPLE`` at most), and route every fingerprint to its shards; inside a shard the
recursion goes on over the shard's own points, and leaves compare exactly over
all 64 bits.  A shard returns a spanning forest of its links (never all pairs),
and ``components`` joins the shards' forests.

Copies cost nothing: only distinct fingerprints are routed, so a group of copies
that holds a third of all rows is one point.  A shard of a million points is
8 MB.  Defined cases: a null or empty text has fingerprint zero and links like any
other; a repeated row gets the same result as often as it occurs; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import LOWER_ASCII, SLICE_ROWS, boxed, stored, unboxed, with_row_key
from .components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BLOCKS = 3
SAMPLE = 4096          # fingerprints the routing trees are built from, at least
SHARD_SAMPLE = 16      # of them for each wanted shard
MAX_SAMPLE = 1 << 20   # and at most: 8 MB for 65,000 shards, a billion distinct fingerprints at the wanted size
SHARD_POINTS = 16_384  # wanted distinct fingerprints in a shard
LEAF_POINTS = 256
_CHUNK = 1 << 16       # shingles expanded to bits at a time


# ---- fingerprints -------------------------------------------------------------

def shingle_hashes(text: bytes | None, shingle: int, seed: int = SEED) -> list[int]:
    words = (text or b"").translate(LOWER_ASCII).split()  # bytes.split: exactly 0x20, 0x09-0x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], seed) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprint of each text: a bit is one when set in over half the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, shingle, seed), dtype="<u8")
        if not hashes.size:
            continue
        ones = np.zeros(64, np.int64)
        for k in range(0, hashes.size, _CHUNK):
            part = hashes[k:k + _CHUNK]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        out[i] = np.packbits(ones * 2 > hashes.size, bitorder="little").view("<u8")[0]
    return out


def add_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fp",
                     shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` without its text and with the signed 64-bit fingerprint in ``out_col``."""
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != text_col]
    schema = df.select(*keep, F.lit(0).cast("bigint").alias(out_col)).schema

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                texts = part.column(text_col).cast(pa.binary()).to_pylist()
                fp = fingerprints(texts, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(fp)], names=[*keep, out_col])

    return df.select(*keep, text_col).mapInArrow(run, schema)


# ---- vantage-point trees ------------------------------------------------------

def block_masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def choose_split(points: np.ndarray, mask: np.uint64, radius: int):
    """(vantage, threshold, inside, outside) with the smallest larger side, or None.

    Tries a few points as vantage; a split must leave both sides smaller.
    """
    best = None
    n = len(points)
    for at in (n // 2, n // 5, (4 * n) // 5):
        v = points[at]
        d = np.bitwise_count((points ^ v) & mask)
        counts = np.bincount(d, minlength=66).cumsum()
        inside = counts[np.minimum(np.arange(65) + radius, 65)]
        outside = n - counts[:65]
        worst = np.maximum(inside, outside)
        t = int(worst.argmin())
        if best is None or worst[t] < best[0]:
            best = (int(worst[t]), v, t, d)
    if best is None or best[0] >= n:
        return None
    _, v, t, d = best
    return v, t, d <= t + radius, d > t


def routing_tree(sample: np.ndarray, mask: int, radius: int, enough: float) -> list:
    """Nested [vantage, threshold, inside, outside]; None is a shard: of ``enough`` of the sample or
    less, visitors included."""
    if len(sample) <= enough:
        return None
    split = choose_split(sample, np.uint64(mask), radius)
    if split is None:
        return None
    v, t, inside, outside = split
    return [int(v), t, routing_tree(sample[inside], mask, radius, enough),
            routing_tree(sample[outside], mask, radius, enough)]


def route(points: np.ndarray, tree, mask: int, radius: int):
    """Yields (shard number, indices of the points that belong to or visit it)."""
    stack, shard = [(tree, np.arange(len(points)))], 0
    while stack:
        node, at = stack.pop()
        if node is None:
            if at.size:
                yield shard, at
            shard += 1
            continue
        v, t, inside, outside = node
        d = np.bitwise_count((points[at] ^ np.uint64(v)) & np.uint64(mask))
        stack.append((outside, at[d > t]))
        stack.append((inside, at[d <= t + radius]))


def _forest(points: np.ndarray, max_bits: int, out: list) -> None:
    """Spanning forest of the links among the points (sorted): each link once found
    removes a point, so a dense group costs a few sweeps, not all its pairs."""
    if len(points) <= 2 * LEAF_POINTS:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= max_bits
        points = points[near.sum(axis=1) > 1]
    rest = points
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and rest.size:
            p = frontier.pop()
            near = np.bitwise_count(rest ^ p) <= max_bits
            if near.any():
                found = rest[near]
                out.append((np.full(found.size, root, np.uint64), found))
                frontier.extend(found)
                rest = rest[~near]


def shard_links(points: np.ndarray, mask: int, radius: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the points that are within the radius in the masked bits."""
    out: list = []
    stack = [np.unique(points)]
    while stack:
        part = stack.pop()
        if len(part) > LEAF_POINTS:
            split = choose_split(part, np.uint64(mask), radius)
            if split is not None and max(split[2].sum(), split[3].sum()) <= 0.9 * len(part):
                stack += [part[split[2]], part[split[3]]]
                continue
        _forest(part, max_bits, out)
    if not out:
        none = np.zeros(0, np.uint64)
        return none, none
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def sample_size(n: int, least: int, shard_points: int) -> int:
    """Fingerprints to draw for the routing trees of ``n`` distinct ones: it grows with the shards, so
    they keep their size."""
    return min(MAX_SAMPLE, max(least, SHARD_SAMPLE * math.ceil(n / shard_points)))


def links(points: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, sample: int = SAMPLE,
          shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct values of ``fp``."""
    spark = points.sparkSession
    ship_package(spark)
    distinct = stored(points.select("fp").distinct())
    n = distinct.count()
    wanted = sample_size(n, sample, shard_points)
    picked = distinct.where(F.pmod(F.xxhash64("fp", F.lit("vantage")), F.lit(1 << 30)) < math.ceil(min(1.0, wanted / max(1, n)) * (1 << 30)))
    drawn = np.sort(picked.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    radius = max_bits // blocks
    masks = block_masks(blocks)
    enough = max(SHARD_SAMPLE, shard_points * len(drawn) / max(1, n))
    trees = [routing_tree(drawn, m, radius, enough) for m in masks]

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for b, (tree, mask) in enumerate(zip(trees, masks)):
                for shard, at in route(fp, tree, mask, radius):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(at.size, b, np.int32)), pa.array(np.full(at.size, shard, np.int32)),
                         pa.array(fp[at].view(np.int64))], names=["block", "shard", "fp"])

    def search(key, frame):
        pts = frame["fp"].to_numpy().view(np.uint64)
        a, b = shard_links(pts, masks[int(key[0])], radius, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (distinct.mapInArrow(deal, "block int, shard int, fp bigint")
            .groupBy("block", "shard").applyInPandas(search, "a bigint, b bigint").distinct())


# ---- operator -----------------------------------------------------------------

def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **search) -> DataFrame:
    """One row per row of ``df``: id, ``fp``, ``root``, ``component_id``, row key.

    ``root`` names the component (its smallest linked fingerprint), ``component_id``
    is its smallest id (nulls do not count; null when all are null).
    """
    keyed = with_row_key(df.select(id_col, text_col), id_col, text_col)
    table = stored(add_fingerprints(keyed, text_col, "fp", shingle))
    own = table.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = components(links(table, max_bits, **search))
    classes = stored(own.join(roots, own.fp == roots.node, "left")
                     .select("fp", "low", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")))
    merged = classes.where("linked").groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.where("linked").join(merged, "root").select("fp", "root", "component_id").union(
        classes.where("not linked").select("fp", "root", F.col("low").alias("component_id")))
    return table.join(named, "fp", "left").select(id_col, "_k1", "_k2", "fp", "root", "component_id")


def hex64(col: str):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    out = near_duplicates(df, id_col, text_col)
    return out.select(F.col(id_col).alias("doc_id"), hex64("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: that of the smallest (id, row key).

    Rows with a null id come last; of a repeated row one copy stays.
    """
    found = stored(near_duplicates(df, id_col, text_col))
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), "_k1", "_k2")
    kept = found.groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r._k1").alias("_k1"), F.col("r._k2").alias("_k2"))
    keyed = boxed(df, id_col, text_col)
    repeated = found.groupBy("_k1", "_k2").count().where("count > 1").select("_k1", "_k2")
    single = keyed.join(kept.join(repeated, ["_k1", "_k2"], "left_anti"), ["_k1", "_k2"], "left_semi").select("row")
    again = kept.join(repeated, ["_k1", "_k2"], "left_semi")
    if not again.isEmpty():
        firsts = keyed.join(again, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
        single = single.union(firsts.select("row"))
    return unboxed(single, df.columns)
