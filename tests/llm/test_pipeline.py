"""The pipeline against a plain Python version on a small corpus."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
from logweave.llm import mixing as M
from logweave.llm import quality as Q
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_secrets import redacted
from tests.llm.test_simhash import brute_components, brute_fp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abdeilnorst", k=rng.randint(2, 8))) for _ in range(200)]
    items = [(i, " ".join(rng.choices(vocab, k=14))) for i in range(6)]
    docs, labels = [], []
    for i in range(260):
        ws = rng.choices(vocab, k=rng.randint(12, 90))
        g = rng.choices((0, 1, 2), (1, 1, 5))[0]
        if g == 0:
            ws = [w.upper() + "!!" for w in ws]
        if g == 1:
            ws[::9] = ["foulword"] * len(ws[::9])
        if i % 11 == 0:
            ws[3:3] = items[i % 6][1].split()
        if i % 13 == 0:
            ws.append('token = "0123456789abcdef0123456789abcdef"')
        docs.append((i, " ".join(ws), rng.choice(["en", "fr"]), rng.choice(["src0"] * 4 + ["src1", None])))
        labels.append((i, int(g > 0), int(g == 1)))
    docs += [(300 + i, docs[i][1] + (" x" if i % 2 else ""), *docs[i][2:]) for i in range(20)]
    docs += [(400, None, "en", "src0"), (401, "", None, "src1"), (None, docs[40][1] + " more", "en", "src0"), docs[30], docs[30]]
    return [(*d, len(d[1] or "")) for d in docs], labels, items


def write(spark, tmp, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")


def mixed(docs):
    """Rows (doc_id, text, lang, source, n) drawn as the mixing stage draws them."""
    def topic(t):
        return next((n for p, n in M.TOPICS if re.search(p, t or "")), "prose")
    cell = lambda d: (d[3], d[2], topic(d[1]))
    tokens = defaultdict(int)
    for d in docs:
        tokens[cell(d)] += len((d[1] or "").split())
    tokens = {c: n for c, n in tokens.items() if n}
    share = []
    for m in range(3):
        size = defaultdict(int)
        for c, n in tokens.items():
            size[c[m]] += n
        norm = sum(n ** M.TEMPER for n in size.values())
        share.append({v: n ** M.TEMPER / norm for v, n in size.items()})
    total = sum(tokens.values())
    w = {c: n / total for c, n in tokens.items()}
    for _ in range(60):
        for m in range(3):
            held = defaultdict(float)
            for c, x in w.items():
                held[c[m]] += x
            w = {c: x * share[m][c[m]] / held[c[m]] for c, x in w.items()}
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(1, mid * w[c] / n) * n for c, n in tokens.items()) < M.BUDGET * total:
            low = mid
        else:
            high = mid
    out = []
    for d in docs:
        n = len((d[1] or "").split())
        p = min(1, high * w[cell(d)] / tokens[cell(d)]) if n else 0
        digest = hashlib.md5(f"{M.SEED}:{'' if d[0] is None else d[0]}:{d[1] or ''}".encode()).hexdigest()
        if int(digest[:13], 16) / 16 ** 13 < p:
            out.append(d)
    return out


def test_pipeline_matches_plain_python(spark, tmpdir_path):
    docs, labels, items = corpus()
    write(spark, tmpdir_path, docs, labels, items)
    model = Q.train(spark.read.parquet(f"{tmpdir_path}/documents.parquet"), spark.read.parquet(f"{tmpdir_path}/labels.parquet"))
    want = []
    for d in docs:
        score = sum(model.weights.get(f, 0.0) * v for f, v in Q.features(d[1]).items())
        if Q._logistic(score - model.thresholds[-1]) >= Q.KEEP_TAIL:
            want.append(d)
    assert 0 < len(want) < len(docs)
    # one of each group: the smallest id; here no two texts of a group share it but repeats
    comp = brute_components([(i, brute_fp(d[1])) for i, d in enumerate(want)])
    groups = defaultdict(list)
    for d, c in zip(want, comp):
        groups[c].append(d)
    assert len(groups) < len(want)
    want = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    dirty = [r[5] for r in (brute_contamination([d[:2]], items)[0] for d in want)]
    assert any(dirty)
    want = [d for d, bad in zip(want, dirty) if not bad]
    clean = [(d[0], redacted(d[1]), *d[2:4], d[4] if redacted(d[1]) == d[1] else len(redacted(d[1]))) for d in want]
    assert clean != want
    drawn = mixed(clean)
    assert 0 < len(drawn) < len(clean)
    out = corpus_pipeline.run(spark, tmpdir_path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(drawn, key=str)


def test_stages_keep_columns_and_survive_empty_tables(spark, tmpdir_path):
    docs, labels, items = corpus(2)
    write(spark, tmpdir_path, docs[:40], labels[:40], items)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    for rows in (docs[:40], []):
        df = spark.createDataFrame([(*d, "x", "y") for d in rows], DOCS + ", _k1 string, row string")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, tmpdir_path)
            assert out.columns == df.columns
            assert {r.row for r in out.collect()} <= {"y"}
