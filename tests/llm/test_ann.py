import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import ann as A


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("x", F.lit(0))


def brute(rows, k=20):
    """Every row but the query's own is a candidate, rows of one id too (query ids are distinct here)."""
    v = [(i, np.array(x, np.float32).astype(float)) for i, x in rows]
    out = {}
    for at, (q, x) in enumerate(v):
        if q % 20 == 0:
            s = sorted((-(y * x).sum(), i) for k_, (i, y) in enumerate(v) if k_ != at)[:k]
            out[q] = [(i, -s_) for s_, i in s]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def clustered(n, dims, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(12, size=n)] + spread * rng.normal(size=(n, dims))
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


def test_recall_and_scores(spark):
    rows = clustered(1500, 16)
    got, want = result(A.neighbours_of_embeddings(frame(spark, rows))), brute(rows)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
        exact = {i: s for i, s in want[q]}
        assert all(abs(s - exact[i]) < 1e-9 for _, i, s in found if i in exact)
    assert hits >= 0.9 * 20 * len(got)


def test_full_depth_is_brute_force_with_ties(spark, monkeypatch):
    rows = clustered(300, 7, 2)
    rows += [(1000 + i, rows[20][1]) for i in range(150)]  # a repeated vector: ties by id
    monkeypatch.setattr(A, "LEAST_DEPTH", 10 ** 9)
    monkeypatch.setattr(A, "SHARD_ROWS", 40)  # the repeated vector is split over shards
    monkeypatch.setattr(A, "STEP", 3)
    got, want = result(A.neighbours_of_embeddings(frame(spark, rows))), brute(rows)
    assert {q: [i for _, i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_vectors_that_take_no_part(spark):
    good = clustered(25, 4, 3)
    rows = good + [(40, None), (60, [0.0] * 4), (80, [1.0, None, 1.0, 1.0]), (100, [float("nan"), 1.0, 1.0, 1.0]),
                   (120, [float("inf"), 1.0, 1.0, 1.0]), (140, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (160, [])]
    rows += [good[3], good[3]]
    got, want = result(A.neighbours_of_embeddings(frame(spark, rows))), brute([*good, good[3], good[3]])
    assert {q: [i for _, i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_few_or_no_rows(spark):
    assert A.neighbours_of_embeddings(frame(spark, [])).count() == 0
    assert A.neighbours_of_embeddings(frame(spark, [(0, [1.0, 2.0])])).count() == 0
    assert A.neighbours_of_embeddings(frame(spark, [(1, [1.0]), (3, [2.0])])).count() == 0
    two = A.neighbours_of_embeddings(frame(spark, [(0, [2.0]), (1, [3.0])])).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 6.0)]


@pytest.mark.parametrize("k1,k2", [(1, 1), (1, 5), (6, 4), (9, 9)])
def test_walk_visits_all_cells_in_order(k1, k2):
    rng = np.random.default_rng(k1 * 10 + k2)
    u, v = rng.integers(-3, 4, k1).astype(float), rng.integers(-3, 4, k2).astype(float)
    counts = rng.integers(0, 5, (k1, k2))
    seen = list(A.walk(u, v, counts, 10 ** 9))
    assert sorted((i, j) for _, i, j, _ in seen) == [(i, j) for i in range(k1) for j in range(k2)]
    assert [s for s, *_ in seen] == sorted((u[:, None] + v[None, :]).ravel().tolist(), reverse=True)
    assert seen[-1][3] == counts.sum()


def test_rows_of_one_id_and_other_lengths_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.9, 0.1]), (0, [0.5, 0.5]), (2, [0.0, 1.0]), (3, [2.0, 0.0, 1.0]), (20, [1.0, 1.0, 1.0]), (4, [1.0, 2.0, 0.0])]
    got = A.neighbours_of_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"], r.vec_id)):
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    first = [(1, 1, 1.0), (2, 1, 0.9), (3, 0, 0.5), (4, 2, 0.0)]
    second = [(1, 0, 0.5), (2, 1, 0.5), (3, 1, 0.5), (4, 2, 0.5)]
    assert sorted(by_query[0]) == sorted(first + second)
    assert by_query[20] == [(1, 3, 3.0), (2, 4, 3.0)]
