import random

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import quality as Q


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abdeilnorst", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws = rng.choices(vocab, k=rng.randint(20, 200))
        g = rng.choices((0, 1, 2), (1, 1, 4))[0]
        if g == 0:
            ws = [w.upper() + "!!" for w in ws] if i % 2 else [w + rng.choice(["###", "%%%"]) for w in ws]
        if g == 1:
            for _ in range(max(2, len(ws) // 12)):
                ws[rng.randrange(len(ws))] = rng.choice(["foulword", "nastything", "foulest"])
        docs.append((i, " ".join(ws)))
        labels.append((i, int(g > 0), int(g == 1)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_grades(spark, docs_df):
    docs, labels = corpus()
    taught = [x for x in labels if x[0] % 3]
    df = docs_df(docs).withColumn("p_good", F.lit("clash"))
    got = {r.doc_id: r for r in Q.grade_documents(df, spark.createDataFrame(taught, LABELS)).collect()}
    assert len(got) == len(docs)
    held = [(i, 0 if not q else 1 if t else 2) for i, q, t in labels if i % 3 == 0]
    assert sum(got[i].selected == (g == 2) for i, g in held) >= 0.95 * len(held)
    for r in got.values():
        assert 0 <= r.p_good <= r.p_sound <= 1 and abs(r.expected_grade - r.p_good - r.p_sound) < 1e-9
        assert r.selected == (r.p_good >= Q.KEEP_TAIL)
    mean = [np.mean([got[i].expected_grade for i, g in held if g == k]) for k in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.6 < mean[2]


def test_score_by_forms_is_the_sum_over_features():
    model = Q.OrdinalModel({f: 0.1 * (f % 7 - 3) for t in ("One two, TWO!! one", "") for f in Q.features(t)}, np.array([-1.0, 1.0]))
    for text in ("One two, TWO!! one", "two three one\none", "", None, " \n", "é" * 5000 + " x" * 9000, "\u0000 a"):
        want = sum(model.weights.get(f, 0.0) * v for f, v in Q.features(text).items())
        seen = {}
        assert abs(model.score(text, seen) - want) < 1e-9
        assert abs(model.score(text, seen) - want) < 1e-9  # from what is remembered


def test_fit_reaches_the_maximum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = (x @ [1.5, -1.0, 0.0] + rng.logistic(size=500))
    grades = (y > -1).astype(int) + (y > 1)
    table = spark.createDataFrame([(int(g), {k: float(v) for k, v in enumerate(r)}) for g, r in zip(grades, x)], "grade int, f map<bigint,double>")
    m = Q.fit_spread(table.repartition(4), np.arange(3), np.bincount(grades, minlength=3), penalty=1e-6, rounds=200)
    w = [m.weights[i] for i in range(3)]
    assert abs(w[0] - 1.5) < 0.3 and abs(w[1] + 1.0) < 0.3 and abs(w[2]) < 0.25
    assert m.thresholds[0] < m.thresholds[1] and abs(m.thresholds[0] + 1) < 0.3 and abs(m.thresholds[1] - 1) < 0.3


def by_hand(rows, n_grades=3):
    """Plain gradient descent on the same penalised likelihood, over a dense matrix of (grade, features)."""
    keys = sorted(k for k in {k for _, f in rows for k in f} if sum(k in f for _, f in rows) >= min(Q.MIN_ROWS, max(2, len(rows) // 50)))
    x = np.array([[f.get(k, 0.0) for k in keys] for _, f in rows], dtype=np.float32).astype(float)
    g = np.array([grade for grade, _ in rows])
    scale = np.maximum((x * x).mean(0), 1e-12) ** 0.25
    z = x / scale
    counts = np.bincount(g, minlength=n_grades)
    weight = ((n_grades * (counts / len(g)).clip(1 / len(g))) ** -0.5)[g]

    def loss(w, theta):
        tail = np.hstack([np.ones((len(g), 1)), 1 / (1 + np.exp(-(z @ w)[:, None] + theta)), np.zeros((len(g), 1))])
        p = np.maximum(tail[np.arange(len(g)), g] - tail[np.arange(len(g)), g + 1], 1e-12)
        return Q.PENALTY / 2 * w @ w - (weight * np.log(p)).mean()

    return keys, scale, loss


def test_the_query_s_model_is_the_best_of_its_likelihood(spark, docs_df):
    """No small step away from the trained model, along any of many directions, raises the likelihood."""
    docs, labels = corpus(150, 6)
    model = Q.train(docs_df(docs).repartition(3), spark.createDataFrame(labels, LABELS))
    grade = {i: 0 if q == 0 else 1 if t else 2 for i, q, t in labels}
    keys, scale, loss = by_hand([(grade[i], Q.features(t)) for i, t, *_ in docs if i in grade])
    assert sorted(model.weights) == keys
    w, theta = np.array([model.weights[k] for k in keys]) * scale, np.array(model.thresholds)
    here, rng = loss(w, theta), np.random.default_rng(1)
    for step in (1e-1, 1e-2):
        for _ in range(60):
            dw, dt = rng.normal(size=len(w)), rng.normal(size=2)
            assert loss(w + step * dw / np.linalg.norm(dw), theta + step * dt / np.linalg.norm(dt) / 10) > here - 1e-4


def test_one_model_whatever_the_partitions_and_id_types(spark, docs_df):
    docs, labels = corpus(200, 5)
    df, marks = docs_df(docs + [(900, ""), (901, None)]), spark.createDataFrame([*labels, (900, 0, 0), (901, 1, 0)], LABELS)
    want = Q.train(df, marks)
    for got in (Q.train(df.repartition(5), marks), Q.train(df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")),
                                                           marks.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), fit_rows=10 ** 9)):
        assert sorted(got.weights) == sorted(want.weights)
        for _, text in docs:
            assert np.allclose(got.tails(np.array([got.score(text, {})])), want.tails(np.array([want.score(text, {})])), atol=1e-9)


def test_of_several_texts_of_an_id_the_smallest_trains(spark, docs_df):
    docs, labels = corpus(120, 7)
    marks = spark.createDataFrame(labels, LABELS)
    want = Q.train(docs_df(docs), marks)
    for seed in (1, 2):
        got = Q.train(docs_df(docs + [(i, "~ other text") for i, *_ in docs]).orderBy(F.rand(seed)), marks)
        assert sorted(got.weights) == sorted(want.weights)
        assert max(abs(got.weights[f] - w) for f, w in want.weights.items()) < 1e-9


def test_odd_rows(spark, docs_df):
    docs, labels = corpus(120, 3)
    docs += [(900, None), (901, ""), (902, " \n\t"), (None, "words without an id"), (903, "x " * 100_000), (5, docs[5][1])]
    labels += [(None, 1, 0), (900, None, None), (901, 1, None), (5, 0, 0), (5, 1, 0), (12345, 1, 0)]
    df = docs_df(docs)
    out = Q.grade_documents(df, spark.createDataFrame(labels, LABELS))
    got = out.collect()
    assert len(got) == len(docs) and all(r.p_good is not None for r in got)
    kept = Q.keep_good(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((r.doc_id for r in got if r.selected), key=key)


def test_nothing_to_learn(spark, docs_df):
    docs, labels = corpus(30, 4)
    none = spark.createDataFrame([], LABELS)
    got = Q.grade_documents(docs_df(docs), none).collect()
    assert len(got) == 30 and all(r.selected and r.p_good is None for r in got)
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    assert all(r.selected for r in Q.grade_documents(docs_df(docs), one).collect())
    assert Q.grade_documents(docs_df([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_lowest_of_several_labels(spark):
    g = Q.grade(F.col("quality"), F.col("toxic"))
    df = spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 1, 1), (3, 0, 0)], LABELS)
    assert [r.g for r in df.orderBy("doc_id").select(g.alias("g")).collect()] == [2, 2, 1, 0]
