"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import trie as M

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def trie_by_hand(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out = {}
    for key in sorted(members, key=len, reverse=True):
        below = [out[k] for k in children[key]]
        words = len(WORD.findall(key[-1][1])) if key else 0
        ends = sorted(c for c in members[key] if len(seqs[c]) == len(key))
        out[key] = {
            "conv_id": min(members[key]), "depth": len(key), "parent_conv_id": min(members[key[:-1]]) if key else None,
            "n_convs": len(members[key]), "n_children": len(below), "n_leaves": sum(b["n_leaves"] for b in below) or 1,
            "saved_tokens": (len(members[key]) - 1) * words + sum(b["saved_tokens"] for b in below),
            "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()}
    return sorted((tuple(v.items()) for v in out.values()), key=lambda v: (v[1][1], v[0][1]))


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=lambda v: (v[1][1], v[0][1]))


def corpus(seed, n=160, vocabulary=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * n), n):
        if rng.random() < 0.3:  # copies of a few long conversations
            kind = rng.randint(0, 2)
            turns = [("user", f"copy {kind} turn  {i}") for i in range(3 + kind)]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["", "a", "b c\t d", None] + [f"own {c}"] * vocabulary)) for _ in range(rng.randint(1, 7))]
        for i, (role, text) in enumerate(turns):
            rows.append((c, None if i == 0 and rng.random() < 0.2 else i, role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bits", [(1, None), (2, 5), (3, 0), (4, 8)])
def test_against_a_dictionary(spark, seed, bits):
    """Also with sketches far too small: estimates are then too high and nearly all goes the exact way."""
    rows = corpus(seed) + [(None, 0, "user", "of no conversation"), (None, 1, None, None)]
    turns, convs = M.rebuilt(M.turn_digests(spark.createDataFrame(rows, SCHEMA)))
    assert result(M.prefix_trie(turns, convs, max_bits=bits)) == trie_by_hand(rebuilt_by_hand(rows))


def test_long_conversations_in_blocks(spark, monkeypatch):
    rows = [(c, i, "user", f"{i % 5} word") for c in (20, 21, 25, 40) for i in range(60 + c)] + [(41, 3, "x", "y")]
    monkeypatch.setattr(M, "BLOCK_TURNS", 7)
    got = result(M.trie_of_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert got == trie_by_hand(rebuilt_by_hand(rows))


def test_hot_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "TEXT_IDS", 7)
    rows = [(c, 0, "system", "the same prompt") for c in range(0, 700)] + [(c, 1, "user", f"ask {c % 450}") for c in range(0, 700)]
    rows += [(c, 0, "user", "one turn") for c in range(1000, 1300)]
    got = result(M.trie_of_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert got == trie_by_hand(rebuilt_by_hand(rows))


def test_turnless_alone_empty_and_clashing_columns(spark):
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, "user", "dropped") for c in turnless]
    want = trie_by_hand(rebuilt_by_hand(rows))
    assert len(want) == 1
    assert result(M.trie_of_conversations(spark.createDataFrame(rows, SCHEMA))) == want
    assert M.trie_of_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert M.trie_of_conversations(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    other = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in corpus(7, 40)], SCHEMA + ", conv long, at long, words string, n long")
    assert result(M.trie_of_conversations(other)) == trie_by_hand(rebuilt_by_hand(corpus(7, 40)))


def test_repeated_rows_and_turns_of_one_number(spark):
    rows = [(0, 1, "a", "x"), (0, 1, "a", "x"), (0, 0, "u", "first"), (40, 5, "a", "p"), (40, 5, "a", "q"), (60, 5, "a", "q"), (60, 5, "a", "p"),
            (100, 0, "u", "long é " * 50_000)]
    got = result(M.trie_of_conversations(spark.createDataFrame(rows, SCHEMA)))
    by_depth = {(dict(v)["conv_id"], dict(v)["depth"]): dict(v) for v in got}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (0, 40, 60, 100)}
    assert h is not None and by_depth[0, 3]["n_convs"] == 1  # both repeated rows are turns
    assert by_depth[40, 1]["n_convs"] == by_depth[40, 2]["n_convs"] == 2  # the same order in both conversations
    assert by_depth[0, 0]["n_convs"] == 4


def test_the_sketch_never_counts_too_few(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(-2**63, 2**63 - 1, (3000, 2), dtype=np.int64)
    times = rng.integers(1, 4, 3000)
    df = spark.createDataFrame([tuple(map(int, x)) for x in np.repeat(ids, times, axis=0)], "d1 long, d2 long").repartition(5)
    for bits in (4, 12, 18):
        table = M.count_min(df, bits)
        assert table.nbytes == 2 << bits
        one, two = M._cells(ids[:, 0], ids[:, 1], bits)
        estimate = np.minimum(table[one], table[two])
        assert (estimate >= np.minimum(times, 2)).all()
    assert (estimate == np.minimum(times, 2)).mean() > 0.99  # enough cells: nearly always exact


def test_tails_are_told_without_a_shuffle(spark):
    rows = corpus(9)
    turns, convs = M.rebuilt(M.turn_digests(spark.createDataFrame(rows, SCHEMA)))
    pre = M.stored(M.prefixes(turns, convs))
    marked = M.screened(pre, M.count_min(pre, 18), 18)
    assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()
    shared = marked.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.max("tail").alias("tail")).collect()
    assert all(r.n == 1 for r in shared if r.tail)
    assert all(r.tail for r in shared if r.n == 1)  # at this size every single prefix is proven
