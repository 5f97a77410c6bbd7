import hashlib
import random
import re
from collections import Counter

from logweave.llm import decontaminate as D
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10, slop=3):
    out = {}
    freq = Counter(w for _, t in docs for w in tokens(t))
    for key, (doc_id, text) in enumerate(docs):
        ws, hit, ids, near = tokens(text), set(), set(), set()
        for item, itext in items:
            iw = tokens(itext)
            if not iw or item is None:
                continue
            for k in range(max(1, len(iw) - window + 1)):
                w = iw[k:k + window]
                rarest = min(range(len(w)), key=lambda i: freq[w[i]])
                for p, x in enumerate(ws):
                    if x != w[rarest]:
                        continue
                    s = p - rarest
                    if s >= 0 and ws[s:s + len(w)] == w:
                        hit |= set(range(s, s + len(w)))
                        ids.add(str(item))
                    if all(x in ws[max(0, s + i - slop):max(0, s + i + slop + 1)] for i, x in enumerate(w)):
                        near.add(str(item))
        out[key] = (doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    bool(hit), len(near))
    return sorted(out.values(), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "a"] * 12 + ["".join(rng.choices("abcdéß9", k=4)) for _ in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(100, "the " * 14), (101, "zz"), (102, ""), (103, None), (None, "some words that carry no id at all in here"),
              (9, "Extra-Row, of the same ITEM! with other words than before it"), (104, items[3][1].upper())]
    docs = []
    for d in range(40):
        ws = rng.choices(vocab, k=rng.randint(0, 80))
        if d % 2:
            at = rng.randint(0, len(ws))
            ws[at:at] = tokens(rng.choice(items[:12])[1])[:rng.choice([9, 10, 15, 30])]
        if d % 5 == 0 and len(ws) > 8:
            ws.insert(len(ws) // 2, "xx")
        docs.append((d, rng.choice([" ", ", ", "\n-"]).join(ws)))
    docs += [(50, None), (51, ""), (52, "the " * 40), (53, "ZZ"), (53, "ZZ"), (None, items[0][1]), (54, "?! ..."),
             (55, items[4][1] + " " + items[4][1])]
    return docs, items


def run(spark, docs_df, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    df = docs_df(docs).withColumn("terms", F.lit("clash"))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"]
    return sorted((tuple(r) for r in D.contamination_report(df, bench, **options).select(*cols).collect()), key=str)


def test_matches_brute_force(spark, docs_df):
    for seed in (1, 2):
        docs, items = corpus(seed)
        assert run(spark, docs_df, docs, items) == brute(docs, items)


def test_blocks_of_the_benchmark_do_not_change_the_result(spark, docs_df):
    docs, items = corpus(3)
    assert run(spark, docs_df, docs, items, block_chars=200) == brute(docs, items)


def test_small_steps_of_candidates(spark, docs_df, monkeypatch):
    docs, items = corpus(4)
    bench = D.Windows([(str(i), t) for i, t in items if i is not None and t], 10)
    texts = [t.encode() if t else None for _, t in docs]
    assert D.words(b"A-b\xc3\xa9 9x") == [b"a", b"b\xc3\xa9", b"9x"]
    monkeypatch.setattr(D, "PAIRS", 7)
    assert len(bench.names) and texts
    assert run(spark, docs_df, docs, items) == brute(docs, items)


def test_empty_tables(spark, docs_df):
    docs, items = corpus(5)
    assert run(spark, docs_df, [], items) == []
    got = run(spark, docs_df, docs, [])
    assert len(got) == len(docs) and not any(r[5] for r in got)


def test_drop_contaminated(spark, docs_df):
    docs, items = corpus(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_df(docs)
    out = D.drop_contaminated(df, bench)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])
