import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm import mixing as M


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["src0", "src1", "src2", None], (6, 2, 1, 1))[0]
        lang = rng.choices(["en", "fr", None], (5, 2, 1))[0]
        text = " ".join(["word"] * rng.randint(1, 60)) + rng.choice(["", "", " Licensed under it", " a@b.c", " | x" * 9, " ### "])
        rows.append((i, text, lang, source))
    return rows


def raked(df):
    return M.rake(M.with_targets(M.cells_of(df), {}))


def prepared(docs_df, rows):
    return docs_df(rows).select("source", "lang", M.topic_of(F.col("text")).alias("topic"), M.token_count(F.col("text")).alias("n_tokens"))


def test_marginals_meet_tempered_targets(docs_df):
    cells = raked(prepared(docs_df, corpus())).collect()
    total = sum(c.tokens for c in cells)
    assert abs(sum(c.weight for c in cells) - 1) < 1e-9
    for m in M.MARGINS:
        size, weight = defaultdict(int), defaultdict(float)
        for c in cells:
            size[c[m]] += c.tokens
            weight[c[m]] += c.weight
        norm = sum(n ** M.TEMPER for n in size.values())
        assert total == sum(size.values())
        for v, n in size.items():
            assert abs(weight[v] - n ** M.TEMPER / norm) < 1e-8


@pytest.mark.parametrize("budget", [0.05, 0.5, 0.9, 1.0])
def test_probabilities_spend_the_budget(docs_df, budget):
    cells = M.with_probabilities(raked(prepared(docs_df, corpus(seed=2))), budget).collect()
    total = sum(c.tokens for c in cells)
    assert abs(sum(c.tokens * c.probability for c in cells) - budget * total) < 1e-6 * total
    inner = [c for c in cells if c.probability < 1]
    scale = {round(c.probability * c.tokens / c.weight, 6) for c in inner}
    assert len(scale) <= 1 and all(0 < c.probability <= 1 for c in cells)
    if inner:  # cells cut at one would have been above it
        assert all(scale.copy().pop() * c.weight / c.tokens >= 1 - 1e-6 for c in cells if c.probability == 1)


def test_given_targets(spark, docs_df):
    wanted = spark.createDataFrame([("src0", 0.2), ("src1", 0.8), ("gone", 5.0)], "value string, share double")
    rows = [r for r in corpus(seed=3)]
    out = M.mix(docs_df(rows), {"source": wanted}).collect()
    weight = {}
    for r in out:
        weight[(r.source, r.lang, r.topic)] = r.weight
    by = defaultdict(float)
    for (s, _, _), w in weight.items():
        by[s] += w
    assert abs(by["src0"] - 0.2) < 1e-6 and abs(by["src1"] - 0.8) < 1e-6
    assert by["src2"] == by[None] == 0
    assert not any(r.selected for r in out if r.source in ("src2", None))


def test_sample_is_repeatable_and_near_the_budget(docs_df):
    df = docs_df(corpus(1500, 4)).withColumn("weight", F.lit("mine")).withColumn("topic", F.lit("clash"))
    a = sorted(r.doc_id for r in M.sample(df).collect())
    out = M.sample(df.repartition(7))
    assert out.columns == df.columns and {r.weight for r in out.collect()} == {"mine"}
    assert a == sorted(r.doc_id for r in out.collect())
    tokens = df.select("doc_id", M.token_count(F.col("text")).alias("n")).collect()
    kept = sum(r.n for r in tokens if r.doc_id in set(a))
    assert abs(kept / sum(r.n for r in tokens) - 0.5) < 0.06


def test_odd_rows(docs_df):
    rows = corpus(60, 5) + [(900, None), (901, ""), (902, " \n"), (None, "no id here"), (1, "twice"), (1, "twice"), (903, "x " * 100_000)]
    out = M.mixture_of_documents(docs_df(rows)).collect()
    assert len(out) == len(rows)
    empty = [r for r in out if r.doc_id in (900, 901, 902)]
    assert all((r.n_tokens, r.probability, r.selected) == (0, 0.0, False) for r in empty)
    twice = [r for r in out if r.doc_id == 1 and r.n_tokens == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert M.mixture_of_documents(docs_df([])).count() == 0
    assert not any(r.selected for r in M.mixture_of_documents(docs_df([(1, None), (2, "")])).collect())


def test_large_cell_tables_shuffle_to_the_same_result(docs_df, monkeypatch):
    rows = corpus(120, 6)
    a = sorted(map(tuple, M.mixture_of_documents(docs_df(rows)).collect()))
    monkeypatch.setattr(M, "SMALL_CELLS", 0)
    assert a == sorted(map(tuple, M.mixture_of_documents(docs_df(rows)).collect()))


def test_no_task_takes_the_whole_cell_table(docs_df, monkeypatch, caplog):
    monkeypatch.setattr(M, "SMALL_CELLS", 0)
    cells = M.cells_of(prepared(docs_df, corpus(120, 7)))
    targets = M.with_targets(cells, {})
    for step in (targets, M.with_probabilities(targets.withColumn("weight", F.lit(0.1)))):
        for line in step._jdf.queryExecution().optimizedPlan().toString().splitlines():
            assert "Window" not in line or any(f"[{m}#" in line for m in M.MARGINS), line
    M.rake(targets, rounds=1)
    assert "marginals are off by up to" in caplog.text
    caplog.clear()
    M.rake(targets)
    assert not caplog.text
