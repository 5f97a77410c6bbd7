"""Prefix trie of conversations, screened by a count-min sketch of prefix digests.

A conversation is a sequence of turns (role, text); every distinct beginning of one is a
node of the trie.  A prefix is told by a 128-bit digest: the XOR over its turns of a hash
of (position, turn), so that digests of all prefixes are running values.

Screening.  A count-min sketch counts the digests of all prefixes (two rows of cells,
counters stop at two).  An estimate is never too small: one proves that a prefix belongs to
a single conversation, and so do all longer prefixes of it.  These tails -- most turns of
most corpora -- are written as nodes on the spot; only the prefixes that may be shared are
shuffled and grouped exactly.  The sketch is bounded by ``MAX_BITS``; a corpus too large
for it has more prefixes take the exact way, with the same result.

Subtrees without walking the tree.  A node is named by its smallest member.  A
conversation names a node and then every longer prefix of its own, so one number per
conversation, the depth ``first`` from which it names its prefixes, describes all of
that.  Then everything asked of a subtree is a plain sum over its members:

* children of a node at depth d: members that name their prefix of length d + 1;
* leaves: members that name a childless end;
* saved tokens, the sum of (members - 1) * words over the subtree: the words of a
  member's turns from the node on that it does not name.

Skew.  Groups by digest are combined before the shuffle.  The one lookup by digest (the
parent of the first prefix a conversation names) is by a broadcast table for nodes with
more than a ``HOT_SHARE``-th of the screened rows -- at most that many nodes --
and by a shuffle for the rest.  Conversations of any length are numbered and digested in
blocks of turns.  Ids of a node's ends are joined in parallel into texts of bounded
length; only the hashing of one node's texts is a single stream.

Defined cases: null role or text counts as empty, a null turn comes first; turns of one
number are ordered by their content's digest; repeated rows are turns of their own;
rows without a conversation id belong to none; an empty table has no nodes, not even a
root; very long texts count whole; other columns are not read, so no name clashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.carry import number_rows
from ..session import ship_package
from .common import stored

# The rule of the registered query's rebuilt conversations.
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"

BLOCK_TURNS = 1 << 16  # turns of one conversation in a window's group
CELLS_PER_PREFIX = 8
MAX_BITS = 25  # cells of a row of the sketch: 2 ** 25 bytes, twice
MIN_BITS = 16
CHUNK_BITS = 16  # cells of a row of the sketch while it is added up
HOT_SHARE = 50_000
BATCH_ROWS = 1 << 20
TEXT_IDS = 1 << 15  # ids in one text of a node's ends

TURNS = "conv bigint, at bigint, t1 bigint, t2 bigint, words bigint"
_MARKED = "conv bigint, at bigint, n bigint, d1 bigint, d2 bigint, q1 bigint, q2 bigint, words bigint, upto bigint, tail boolean, after boolean"


# ---- turns --------------------------------------------------------------------

def turn_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """conv, at (1 from the first turn), digest t1, t2 and words of every turn: texts go no further."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    slim = stored(conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("turn"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")))
    order = [F.col("turn").asc_nulls_first(), "t1", "t2"]
    block = F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK_TURNS)).cast("bigint"), F.lit(-(1 << 62)))
    return number_rows(slim, ["conv"], order, block, out="at").select("conv", "at", "t1", "t2", "words")


def sizes(turns: DataFrame) -> DataFrame:
    """conv, n turns."""
    return turns.groupBy("conv").agg(F.max("at").alias("n"))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, sizes) of the conversations that go on from another: the first h turns of the first
    conversation of the family (ids of one whole quotient), then the own ones after the first h;
    h is a checksum of the id modulo ``heads``."""
    turns = stored(turns)
    h = lambda c: (F.crc32(c.cast("string")) % heads)
    first = turns.where((F.col("conv") % family == 0) & (F.col("at") < heads)).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("at", "t1", "t2", "words"))).alias("head")).withColumnRenamed("conv", "of")
    own = sizes(turns).select("conv", F.col("n").alias("own"), h(F.col("conv")).alias("h"))
    given = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("bigint"))
    convs = stored(own.join(first, F.col("conv") - F.col("conv") % family == F.col("of"), "left").select(
        "conv", (given + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"), (given - F.col("h")).alias("shift"),
        F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,t1:bigint,t2:bigint,words:bigint>>")), 1, given.cast("int")).alias("head")))
    after = turns.where(F.col("at") > h(F.col("conv"))).join(convs.select("conv", "shift"), "conv").select(
        "conv", (F.col("at") + F.col("shift")).alias("at"), "t1", "t2", "words")
    before = convs.select("conv", F.inline("head"))
    return after.unionByName(before), convs.select("conv", "n")


# ---- digests of prefixes ------------------------------------------------------

def prefixes(turns: DataFrame, convs: DataFrame, block_turns: int | None = None) -> DataFrame:
    """One row per prefix of at least a turn: conv, at (its length), n, digest d1, d2, digest q1, q2 of the
    prefix before it, words of its last turn and ``upto`` of all its turns."""
    block_turns = block_turns or BLOCK_TURNS
    rows = turns.join(convs, "conv").select(
        "conv", "at", "n", "words", F.xxhash64("at", "t1", "t2").alias("e1"), F.xxhash64(F.lit("at"), "at", "t2", "t1").alias("e2"),
        F.floor((F.col("at") - 1) / block_turns).cast("bigint").alias("block"))
    running = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"e1": F.bit_xor, "e2": F.bit_xor, "words": F.sum}
    out = rows.select("*", *[f(c).over(running).alias(f"r_{c}") for c, f in sums.items()])
    longest = convs.agg(F.max("n")).first()[0] or 0
    if longest > block_turns:  # what the blocks before hold, one row a block of the long ones
        blocks = rows.where(F.col("n") > block_turns).groupBy("conv", "block").agg(*[f(c).alias(f"b_{c}") for c, f in sums.items()])
        earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = blocks.select("conv", "block", *[f(f"b_{c}").over(earlier).alias(f"c_{c}") for c, f in sums.items()])
        out = out.join(carry, ["conv", "block"], "left")
        joined = {c: (F.col(f"r_{c}") + F.coalesce(f"c_{c}", F.lit(0)) if f is F.sum else F.col(f"r_{c}").bitwiseXOR(F.coalesce(f"c_{c}", F.lit(0))))
                  for c, f in sums.items()}
    else:
        joined = {c: F.col(f"r_{c}") for c in sums}
    return out.select("conv", "at", "n", joined["e1"].alias("d1"), joined["e2"].alias("d2"), joined["e1"].bitwiseXOR(F.col("e1")).alias("q1"),
                      joined["e2"].bitwiseXOR(F.col("e2")).alias("q2"), "words", joined["words"].alias("upto"))


# ---- sketch -------------------------------------------------------------------

def _cells(d1: np.ndarray, d2: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.int64((1 << bits) - 1)
    return d1 & mask, (d2 & mask) + (1 << bits)


def count_min(digests: DataFrame, bits: int) -> np.ndarray:
    """Counters (0, 1, 2 or more) of both rows, 2 ** (bits + 1) bytes.

    Tasks send the cells they saw, two bytes each and at most twice a batch; the cells are
    added up chunk by chunk in parallel, and only the finished chunks reach the driver.
    """
    ship_package(digests.sparkSession)
    chunk_bits = min(bits, CHUNK_BITS)

    def seen(batches):
        held, rows = [], 0

        def parts():
            cells, times = np.unique(np.concatenate(held), return_counts=True)
            chunk = cells >> chunk_bits
            low = (cells & ((1 << chunk_bits) - 1)).astype("<u2")
            edges = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
            out = [(int(chunk[a]), low[a:b][times[a:b] == 1].tobytes(), low[a:b][times[a:b] > 1].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))],
                                              names=["chunk", "once", "more"])

        for batch in batches:
            held += _cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                yield parts()
                held, rows = [], 0
        if rows:
            yield parts()

    def added(batches):
        chunk, counts = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["chunk", "counts"])
        for batch in batches:
            for at, once, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if at != chunk:
                    if chunk is not None:
                        yield row()
                    chunk, counts = at, np.zeros(1 << chunk_bits, np.uint8)
                one = np.frombuffer(once.as_buffer(), "<u2")
                counts[one] = np.minimum(counts[one] + 1, 2)
                counts[np.frombuffer(more.as_buffer(), "<u2")] = 2
        if chunk is not None:
            yield row()

    chunks = digests.select("d1", "d2").mapInArrow(seen, "chunk int, once binary, more binary").repartition("chunk").sortWithinPartitions(
        "chunk").mapInArrow(added, "chunk int, counts binary")
    table = np.zeros(2 << bits, np.uint8)
    for chunk, counts in chunks.collect():  # the sketch: bounded by MAX_BITS
        table[chunk << chunk_bits:(chunk + 1) << chunk_bits] = np.frombuffer(counts, np.uint8)
    return table


def screened(rows: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    """The prefixes with ``tail`` (proven to be of one conversation) and ``after`` (the one before it is a tail).

    The rows of a conversation lie in a row where the table was written in its order; where a read
    begins inside a conversation, prefixes before the next proof merely take the exact way.
    """
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        counts = shared.value
        last = (None, None, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            one, two = _cells(batch.column(3).to_numpy(), batch.column(4).to_numpy(), bits)
            single = np.minimum(counts[one], counts[two]) == 1
            begins = np.ones(len(conv), bool)
            begins[1:] = (conv[1:] != conv[:-1]) | (at[1:] != at[:-1] + 1)
            goes_on = conv[0] == last[0] and at[0] == last[1] + 1
            single[0] |= goes_on and last[2]
            starts = np.flatnonzero(begins)
            place = np.arange(len(conv))
            proof = np.minimum.reduceat(np.where(single, place, len(conv)), starts)
            tail = place >= np.repeat(proof, np.diff(starts, append=len(conv)))
            after = np.zeros(len(conv), bool)
            after[1:] = tail[:-1] & ~begins[1:]
            after[0] = goes_on and last[2]
            last = int(conv[-1]), int(at[-1]), bool(tail[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail), pa.array(after)], names=[*batch.schema.names, "tail", "after"])

    return rows.select("conv", "at", "n", "d1", "d2", "q1", "q2", "words", "upto").mapInArrow(run, _MARKED)


# ---- ends ---------------------------------------------------------------------

def end_digests(ends: DataFrame) -> DataFrame:
    """d1, d2 and the SHA-256 of each group's ids, ascending and joined by commas."""
    ship_package(ends.sparkSession)
    rows = lambda out, names, kinds: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    key = [pa.int64(), pa.int64()]

    def joined(batches):
        for batch in batches:
            d1, d2, conv = (batch.column(k).to_numpy() for k in range(3))
            edge = np.ones(len(conv), bool)
            edge[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            starts = np.flatnonzero(edge).tolist()
            out = [(int(d1[a]), int(d2[a]), int(conv[k]), ",".join(map(str, conv[k:min(b, k + TEXT_IDS)].tolist())))
                   for a, b in zip(starts, [*starts[1:], len(conv)]) for k in range(a, b, TEXT_IDS)]
            if out:
                yield rows(out, ["d1", "d2", "first", "ids"], [*key, pa.int64(), pa.string()])

    def hashed(batches):
        now, digest, out = None, None, []
        for batch in batches:
            for a, b, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (a, b) == now:
                    digest.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256(text.encode())
            if out:
                yield rows(out, ["d1", "d2", "ends_sha256"], [*key, pa.string()])
                out = []
        if now is not None:
            yield rows([(*now, digest.hexdigest())], ["d1", "d2", "ends_sha256"], [*key, pa.string()])

    texts = ends.select("d1", "d2", "conv").repartitionByRange("d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv").mapInArrow(
        joined, "d1 bigint, d2 bigint, first bigint, ids string")
    return texts.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(hashed, "d1 bigint, d2 bigint, ends_sha256 string")


# ---- trie ---------------------------------------------------------------------

def _named(convs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per conversation: n, ``first`` (depth from which it names its prefixes; n + 1 for none), ``kept``
    (words of its turns before that), the digest p1, p2 of the prefix before and ``leaf``."""
    before = F.col("upto") - F.col("words")
    tails = marked.where("tail").groupBy("conv").agg(
        F.min("at").alias("t_first"), F.min_by(before, "at").alias("t_kept"), F.min_by("q1", "at").alias("t_p1"),
        F.min_by("q2", "at").alias("t_p2"), F.max(F.col("at") == F.col("n")).alias("t_leaf"))
    exact = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("x_first"), F.min_by("kept", "depth").alias("x_kept"), F.min_by("p1", "depth").alias("x_p1"),
        F.min_by("p2", "depth").alias("x_p2"), F.max(F.col("deepest") == F.col("depth")).alias("x_leaf"))
    words = marked.groupBy("conv").agg(F.sum("words").alias("words"))
    by_tail = F.col("t_first").isNotNull() & (F.col("x_first").isNull() | (F.col("t_first") < F.col("x_first")))
    pick = lambda name: F.when(by_tail, F.col(f"t_{name}")).otherwise(F.col(f"x_{name}"))
    joined = convs.join(tails, "conv", "left").join(exact, "conv", "left").join(words, "conv", "left")
    return joined.select("conv", "n", F.coalesce(pick("first"), F.col("n") + 1).alias("first"),
                         F.coalesce(pick("kept"), F.col("words"), F.lit(0)).alias("kept"), pick("p1").alias("p1"), pick("p2").alias("p2"),
                         (F.coalesce("t_leaf", F.lit(False)) | F.coalesce("x_leaf", F.lit(False))).cast("bigint").alias("leaf"))


def _parents(named: DataFrame, nodes: DataFrame, n_rows: int) -> DataFrame:
    """conv, depth, parent: the name of the node before the first that a conversation names."""
    wanted = named.where((F.col("first") > 1) & (F.col("first") <= F.col("n"))).select("conv", F.col("first").alias("depth"), "p1", "p2")
    limit = max(n_rows // HOT_SHARE, 100)
    names = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"), "n_convs")
    hot = names.where(F.col("n_convs") > limit).drop("n_convs")  # at most HOT_SHARE nodes
    met = wanted.join(F.broadcast(hot), ["p1", "p2"], "left")
    rest = met.where("parent is null").drop("parent").join(names.where(F.col("n_convs") <= limit).drop("n_convs"), ["p1", "p2"])
    return met.where("parent is not null").unionByName(rest).select("conv", "depth", "parent")


def prefix_trie(turns: DataFrame, convs: DataFrame, max_bits: int | None = None, block_turns: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations.

    ``turns``: conv, at (1, 2, ... in a conversation), t1, t2, words; ``convs``: every conversation (also without
    turns) and its number n of turns.  Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256 of every node.
    """
    spark = turns.sparkSession
    convs = stored(convs.select("conv", "n"))
    root = convs.agg(F.min("conv"), F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    rows = stored(prefixes(turns, convs, block_turns))
    bits = min(MAX_BITS if max_bits is None else max_bits, max(MIN_BITS, ((root[3] or 0) * CELLS_PER_PREFIX).bit_length()))
    marked = stored(screened(rows, count_min(rows, bits), bits))
    shared = marked.where("not tail")

    nodes = stored(shared.groupBy("d1", "d2").agg(
        F.min("conv").alias("conv_id"), F.min("at").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("deepest"),
        F.min_by(F.col("upto") - F.col("words"), "conv").alias("kept"), F.min_by("q1", "conv").alias("p1"), F.min_by("q2", "conv").alias("p2")))
    named = stored(_named(convs, marked, nodes))
    parents = stored(_parents(named, nodes, root[3] or 0))
    ends = end_digests(shared.where("at = n").select("d1", "d2", "conv").unionByName(
        convs.where("n = 0").select(F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"), "conv")))
    ends = stored(ends)

    of_root = lambda depth, other: F.when(depth == 1, F.lit(root[0]).cast("bigint")).otherwise(other)
    no_ends = F.sha2(F.lit(""), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    sums = shared.join(named.select("conv", "first", "kept", "leaf"), "conv").groupBy("d1", "d2").agg(
        F.sum(((F.col("first") <= F.col("at") + 1) & (F.col("n") > F.col("at"))).cast("bigint")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("kept") - F.col("upto") + F.col("words"), F.lit(0))).alias("saved_tokens"))
    exact = nodes.join(sums, ["d1", "d2"]).join(ends, ["d1", "d2"], "left").join(
        parents.withColumnRenamed("conv", "conv_id"), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", of_root(F.col("depth"), F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", no_ends).alias("ends_sha256"))

    single = [F.lit(1).cast("bigint").alias("n_convs"), (F.col("n") > F.col("depth")).cast("bigint").alias("n_children"),
              F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
              F.when(F.col("n") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(no_ends).alias("ends_sha256")]
    tails = marked.where("tail").select(F.col("conv").alias("conv_id"), F.col("at").alias("depth"), "n", "after")
    inner = tails.where("after").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *single)
    heads = tails.where("not after").join(parents.withColumnRenamed("conv", "conv_id"), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", of_root(F.col("depth"), F.coalesce("parent", "conv_id")).alias("parent_conv_id"), *single)

    top = named.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                    F.sum(((F.col("first") <= 1) & (F.col("n") > 0)).cast("bigint")).alias("n_children"),
                    F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("kept").alias("saved_tokens")).where("n_convs > 0").select(
        "*", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(0).cast("bigint").alias("d1"),
        F.lit(0).cast("bigint").alias("d2")).join(ends, ["d1", "d2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", no_ends))
    parts = [part.select(*columns) for part in (exact, inner, heads, top)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def trie_of_conversations(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(turn_digests(conversations)))
