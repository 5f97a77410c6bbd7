import random
import tempfile
from collections import Counter

import pytest
import tiktoken

from logweave.llm import tokencount as T

CHANGES = "source string, lang string, tokenizer string, documents long, tokens long"


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices(["the", "naïve", "token's", "12", "x—y", "\t", "🙂"], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(1, lines[0])
        rows.append((i, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["src0"] * 4 + ["src1", None])))
    rows += [(500 + i, *rows[i][1:]) for i in range(30)]
    rows += [(900, None, "en", "src0"), (901, "", "en", "src0"), (902, "", "fr", "src0"), (None, "no id", "en", "src1"),
             (3, *rows[3][1:]), (903, "long text " * 50_000, "en", "src0")]
    return rows


def test_query_against_recount(docs_df):
    rows = corpus()
    enc = tiktoken.Encoding("x", pat_str=T.PATTERN, mergeable_ranks=T.read_ranks(), special_tokens={})
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    want = Counter()
    docs = Counter()
    for i, t, lang, source in rows:
        if i is not None and i > first[t]:
            continue_sign = 0
        else:
            continue_sign = 1
            if t is not None:
                lines = t.split("\n")
                t = "\n".join(x for k, x in enumerate(lines) if k == 0 or x != lines[k - 1])
        for version, n in ((T.BYTE_BPE, len(enc.encode_ordinary(t or ""))), (T.WORDS, len((t or "").split()))):
            docs[source, lang, version] += continue_sign
            want[source, lang, version] += continue_sign * n
    got = {tuple(r)[:3]: tuple(r)[3:] for r in T.maintained_counts(docs_df(rows)).collect()}
    assert got == {k: (docs[k], want[k]) for k in docs}
    assert T.maintained_counts(docs_df([])).count() == 0


def test_random_batches_resent_in_any_order(spark):
    rng = random.Random(2)
    rollup = T.TokenRollup(spark, tempfile.mkdtemp(prefix="lw-rollup-"))
    want, batches = Counter(), []
    for b in range(5):
        rows = [(rng.choice(["a", None]), rng.choice(["en", "fr"]), "v1", rng.choice([1, -1]), rng.randint(-50, 50)) for _ in range(20)]
        batches.append((f"batch/{b} é", spark.createDataFrame(rows, CHANGES)))
        for s, lang, v, d, t in rows:
            want[s, lang, v, "d"] += d
            want[s, lang, v, "t"] += t
    for name, changes in batches[:3] + batches[:2]:
        rollup.commit(name, changes)
    assert rollup.commit(*batches[0]) is False
    rollup.compact()
    assert rollup.commit(*batches[1]) is False
    assert rollup.commit(*batches[3]) is True
    rollup.compact()
    for name, changes in reversed(batches):
        rollup.commit(name, changes)
    assert totals(rollup) == {k[:3]: (want[(*k[:3], "d")], want[(*k[:3], "t")]) for k in want}


def test_batch_that_failed_before_its_commit_is_written_again(spark, monkeypatch):
    rollup = T.TokenRollup(spark, tempfile.mkdtemp(prefix="lw-rollup-"))
    one = spark.createDataFrame([("a", "en", "v", 1, 7)], CHANGES)
    rollup.commit("good", one)
    broken = one.selectExpr("source", "lang", "tokenizer", "documents", "cast(raise_error('lost') as bigint) as tokens")
    with pytest.raises(Exception):
        rollup.commit("late", broken)
    assert totals(rollup) == {("a", "en", "v"): (1, 7)}
    # written but the log entry was lost
    one.selectExpr("source", "lang", "tokenizer", "documents", "tokens", "'late' as batch").write.mode("overwrite").parquet(
        f"{rollup.path}/deltas/{'late'.encode().hex()}")
    assert totals(rollup) == {("a", "en", "v"): (1, 7)}
    assert rollup.commit("late", one) and not rollup.commit("late", one)
    assert totals(rollup) == {("a", "en", "v"): (2, 14)}
    assert rollup.commit("empty", one.limit(0)) and totals(rollup) == {("a", "en", "v"): (2, 14)}


def test_empty_rollup(spark):
    rollup = T.TokenRollup(spark, tempfile.mkdtemp(prefix="lw-rollup-"))
    assert totals(rollup) == {} and rollup.committed() == set()
    rollup.compact()
