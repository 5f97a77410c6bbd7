import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import simhash as S
from logweave.llm.components import components


def brute_fp(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in lowered:
        if c == " " or "\t" <= c <= "\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if cur:
        words.append(cur)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits=4):
    """rows: (id, fp) -> component id per row."""
    fps = [fp for _, fp in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgäéß", k=5)) for _ in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(60)]
    rows = list(base)
    for t in base[:25]:
        words = t.split()
        for _ in range(4):
            w = list(words)
            w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
        rows += [t, t.upper(), t.replace(" ", "\n\t ")]
    rows += [None, "", " \t\r\n ", " ", "one", "one", "ein Wort", "a b c", "a b c d", "x " * 30000]
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_fingerprints_match_definition(docs_df):
    rows = corpus()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_groups(docs_df(rows)).collect()}
    want = [(d, brute_fp(t)) for d, t in rows]
    comp = brute_components(want)
    assert got == {d: (f"{fp:016x}", c) for (d, fp), c in zip(want, comp)}
    assert len(set(comp)) < len(rows) - 40


def test_same_result_whatever_the_shards(docs_df):
    df = docs_df(corpus(2))
    a = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    for blocks, points in ((3, 8), (2, 16), (5, 8), (1, 64)):
        b = {r.doc_id: r.component_id for r in S.near_duplicates(df, blocks=blocks, shard_points=points).collect()}
        assert a == b


@pytest.mark.parametrize("radius,mask", [(1, (1 << 21) - 1), (2, ((1 << 32) - 1) << 32), (4, (1 << 64) - 1)])
def test_every_near_pair_meets_in_a_shard(radius, mask):
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    pts = np.unique(np.concatenate([pts, pts ^ flips, pts ^ flips ^ np.roll(flips, 1)]))
    tree = S.routing_tree(pts[::3], mask, radius, 6)
    where = [set() for _ in pts]
    for shard, at in S.route(pts, tree, mask, radius):
        for i in at:
            where[i].add(shard)
    assert all(where) and len(set.union(*where)) > 4
    d = np.bitwise_count((pts[:, None] ^ pts[None, :]) & np.uint64(mask))
    for i, j in zip(*np.nonzero(d <= radius)):
        assert where[i] & where[j]


def test_dense_group_gives_a_forest_not_all_pairs():
    rng = np.random.default_rng(4)
    centre = np.uint64(0x123456789ABCDEF0)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    pts = np.unique(np.array([centre ^ bits[rng.integers(64)] ^ bits[rng.integers(64)] for _ in range(3000)]))
    a, b = S.shard_links(pts, (1 << 64) - 1, 4, 4)
    assert len(pts) - 1 <= len(a) <= 3 * len(pts)
    assert set(a.tolist()) | set(b.tolist()) == set(pts.tolist())


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)]
    edges += [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_of_each_group(docs_df):
    rows = corpus(6)
    rows += [rows[3], rows[3], (None, "nobody here has an id at all"), (None, "nobody here has an id at all")]
    df = docs_df(rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    comp = brute_components([(d, brute_fp(t)) for d, t in rows])
    assert got == sorted(set(c for c in comp if c is not None)) + [None]


def test_empty_table(docs_df):
    df = docs_df([])
    assert S.simhash_groups(df).count() == 0
    assert S.drop_near_duplicates(df).count() == 0


def test_shards_keep_their_size_with_a_larger_sample():
    """With the sample that belongs to the number of points no shard is over four times the wanted size."""
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**64, 400_000, dtype=np.uint64)
    wanted = 200
    drawn = np.sort(rng.choice(points, min(len(points), S.sample_size(len(points), S.SAMPLE, wanted)), replace=False))
    enough = max(S.SHARD_SAMPLE, wanted * len(drawn) / len(points))
    for mask in S.block_masks(S.BLOCKS):
        sizes = np.array([at.size for _, at in S.route(points, S.routing_tree(drawn, mask, 1, enough), mask, 1)])
        assert sizes.max() <= 4 * wanted and len(sizes) > 10_000 and sizes.sum() < 15 * len(points)
    assert S.sample_size(10**12, S.SAMPLE, S.SHARD_POINTS) == S.MAX_SAMPLE and S.sample_size(0, S.SAMPLE, S.SHARD_POINTS) == S.SAMPLE
