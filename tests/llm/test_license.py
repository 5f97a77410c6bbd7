import math
import random

import pytest
from pyspark.sql import functions as F

from logweave.llm import license as L


def paragraph(rng):
    return " ".join("".join(rng.choices(["tion", "the", "ing", "éa", "sh"], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 25)))


def corpus(seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(120):
        lines = [paragraph(rng) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            notice = rng.choice([t for ts in L.NOTICES.values() for t in ts])
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "This is ", "*** "]) + rng.choice([notice, notice.upper()]) + rng.choice([".", " and so on"]))
        if i % 9 == 0:
            lines.append("Licensed under the Quux License, version 9.")
        docs.append((i, "\n".join(lines)))
    return docs


def brute(text, model):
    found = []
    for n, line in enumerate((text or "").split("\n")):
        ws = L.words_of(line)
        grams = L.ngrams(ws) & set(model.weights)
        if not grams:
            continue
        p = model.probabilities(grams)
        if 1 - p[-1] <= L.SURE:
            continue
        c = max(range(len(p)), key=p.__getitem__)
        sure = False
        if p[c] >= L.SURE and c < len(L.NOTICES):
            for t in L.NOTICES[model.families[c]]:
                own = L.shingles(L.words_of(t))
                k = min(L.SHINGLE, len(L.words_of(t)))
                here = {" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)}
                sure = sure or len(own & here) >= math.ceil(L.SAME * len(own))
        found.append((n, model.families[c] if sure else L.UNKNOWN, p[c] if sure else 1 - p[-1]))
    return found


def test_scan_against_brute_force(docs_df):
    docs = corpus() + [(900, None), (901, ""), (902, "\n\n"), (903, "Released under the MIT License.\n" * 400), (None, "Released under the MIT License"),
                       (904, "word " * 60_000), (3, "again"), (3, "again")]
    df = docs_df(docs).withColumn("families", F.lit("clash"))
    model = L.train(df)
    got = {}
    for r in L.scan(df, model).collect():
        got.setdefault((r.doc_id, r.text), [(x.line, x.family, x.p) for x in r.licences])
    assert len(got) == len(set(docs))
    for (i, t), found in got.items():
        want = brute(t, model)
        assert [x[:2] for x in found] == [x[:2] for x in want], (i, t)
        assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(found, want))
    digest = {}
    for r in L.licences_of_documents(df).collect():
        digest.setdefault(r.doc_id, r)
    assert (digest[903].families, digest[903].n_licence, digest[903].n_unknown) == ("mit", 400, 0)
    assert (digest[900].families, digest[900].n_licence, digest[900].top_probability) == ("", 0, None)
    assert L.licences_of_documents(docs_df([])).count() == 0


def test_families_are_told_apart(docs_df):
    model = L.train(docs_df(corpus(2)))
    for family, notices in L.NOTICES.items():
        for t in notices:
            assert [f for _, f, _ in brute(t + ".", model)] == [family], t
    for t in ("Licensed under the Quux License, version 9.", "Released under the Foo Public License"):
        assert [f for _, f, _ in brute(t, model)] == [L.UNKNOWN], t
    for t in ("My driver's license is new", "the general public", "a copy of this", "version 2.0 of it", ""):
        assert [f for _, f, _ in brute(t, model) if f != L.UNKNOWN] == [], t


def test_no_python_in_the_plan(docs_df):
    df = docs_df(corpus(3))
    plan = L.licences_of_documents(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("n", [1, 3])
def test_training_does_not_depend_on_partitions(docs_df, n):
    df = docs_df(corpus(4))
    assert L.train(df.repartition(n)) == L.train(df.coalesce(1))


def test_short_wordings_count(docs_df):
    short = {"All rights reserved.": "proprietary", "Copyright 2020 Somebody. All Rights Reserved.": "proprietary", "MIT License": "mit", "The MIT License (MIT)": "mit",
             "Apache License": "apache", "BSD 2-Clause License": "bsd", "GNU General Public License": "gpl", "CC BY-SA 4.0": "cc-by-sa"}
    df = docs_df(corpus(5))
    model = L.train(df)
    got = {r.text: [x.family for x in r.licences] for r in L.scan(docs_df(list(enumerate(short))), model).collect()}
    assert got == {t: [f] for t, f in short.items()}


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
GPL = "You can redistribute it under the terms of the GNU\nGeneral Public License as published by\nthe Free Software Foundation, either version 3"


def test_wrapped_notices_count_once_at_their_first_line(docs_df):
    model = L.train(docs_df(corpus(6)))
    wrapped = {"mit": MIT, "bsd": BSD, "gpl": GPL}
    want = {}
    for family, t in wrapped.items():
        want[t] = [(0, family)]
        for mark in ("# ", " * ", "// ", "REM ", "dnl "):
            want["".join(f"{mark}{x}\n" for x in t.split("\n"))] = [(0, family)]
        want["\n".join(t.split())] = [(t.split().index("under") if family == "gpl" else 0, family)]
        want[f"first\n\nsecond\n{t}\nthird\n\n{t}\n{t}"] = [(3, family), (3 + t.count("\n") + 3, family), (3 + 2 * t.count("\n") + 4, family)]
        want[t.replace("\n", "\n\n", 1) if family == "mit" else f"x\n{t}"] = [(0, L.UNKNOWN)] if family == "mit" else [(1, family)]
    want[f"{MIT}\n{BSD}\nReleased under the MIT License."] = [(0, "mit"), (2, "bsd"), (5, "mit")]
    want["Released under the\nMIT\nLicense"] = [(0, "mit")]
    got = {r.text: [(x.line, x.family) for x in r.licences] for r in L.scan(docs_df(list(enumerate(want))), model).collect()}
    for t, found in want.items():
        assert [x for x in got[t] if x[1] != L.UNKNOWN or x in found] == found, t
    many = L.licences_of_documents(docs_df([(i, t) for i, t in corpus(6)] + [(900, f"{MIT}\n" * 200)])).where("doc_id = 900").collect()[0]
    assert (many.families, many.n_licence, many.n_unknown) == ("mit", 200, 0)


def test_every_confirmed_notice_holds_a_key_word(docs_df):
    keys = set(L.train(docs_df(corpus(7))).key_words)
    for own in (sorted(L.shingles(L.words_of(t))) for ts in L.NOTICES.values() for t in ts):
        spared = len(own) - math.ceil(L.SAME * len(own))
        assert any(sum(k in r.split() for r in own) > spared for k in keys), own
