"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line of text, and also each notice that is broken over neighbouring
lines (up to a line without words; comment marks do not count).  It becomes its words
and pairs of neighbouring words.
Multinomial logistic regression, trained on licence notices and on paragraphs drawn
from the corpus, gives the probability of each licence family, of ``unknown`` (notices whose
own words were exchanged) and of ``none``; the probabilities are calibrated with a
temperature fitted on held-out paragraphs.  A
prediction counts when the paragraph also holds a notice of that family: at least
``SAME`` of the notice's five-word shingles.  A paragraph that reads like a licence
but is not confirmed belongs to the class ``unknown``.  A broken notice is found by its
shingles in the words of all the lines, in their order; it counts once, at its first
line, and its lines are not reported as ``unknown`` besides.

Only n-grams that occur in the notices and hardly ever in the drawn paragraphs carry
weight, so a paragraph without any of them scores as ``none`` whatever else it says:
``vocabulary`` lists their words and paragraphs without one are passed over, which
changes no result.  Likewise lines are joined only around one of the ``key_words``, of
which every confirmed notice holds one.  The model is a few hundred numbers in the plan; scanning is one
pass over the documents without a join or a shuffle, and every row is judged alone,
so no key can be hot.

Training takes a bounded sample (``NEGATIVES`` paragraphs, by a hash of their text)
and runs in the driver; all documents and paragraphs are scanned.

Defined cases: null and empty texts have no paragraphs; repeated rows each get
their result; extra columns are ignored by the query and kept by ``scan``.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings of common licence notices, by family; the short ones stand in headings or alone on a line.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": ("under the terms of the GNU Affero General Public License", "licensed under the GNU Affero General Public License, version 3",
             "SPDX-License-Identifier: AGPL-3.0", "GNU Affero General Public License"),
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License",
               "released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "licensed under the BSD 3-Clause License", "use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause",
            "BSD License", "BSD 2-Clause License", "BSD 3-Clause License"),
    "cc-by": ("licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0",
              "SPDX-License-Identifier: CC-BY-4.0", "Creative Commons Attribution 4.0", "CC BY 4.0"),
    "cc-by-nc": ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0",
                 "SPDX-License-Identifier: CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"),
    "cc-by-sa": ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0",
                 "SPDX-License-Identifier: CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"),
    "cc0": ("has waived all copyright and related or neighboring rights to this work", "dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal"),
    "gpl": ("licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation",
            "released under the GNU GPL version 2", "SPDX-License-Identifier: GPL-3.0-only", "GNU General Public License"),
    "lgpl": ("under the terms of the GNU Lesser General Public License", "licensed under the GNU Lesser General Public License, version 2.1",
             "SPDX-License-Identifier: LGPL-2.1", "GNU Lesser General Public License"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "MIT License"),
    "mpl": ("subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License, version 2.0",
            "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License"),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced", "may not be copied or redistributed without prior written permission",
                    "All rights reserved"),
}
NONE, UNKNOWN = "none", "unknown"

SHINGLE = 5
SAME = 0.8
NEGATIVES = 400
EXCERPT = 300          # characters of a drawn paragraph
COMMON = 0.01          # n-grams in more of the drawn paragraphs carry no weight
EPOCHS = 25
RATE = 0.5
PENALTY = 2e-3
SURE = 0.5            # probability from which a prediction counts
WORD = "[a-z0-9]+"
COMMENT_WORDS = ("rem", "dnl")  # comment marks that are words


# ---- training, on the bounded sample ------------------------------------------

def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def ngrams(ws: list[str]) -> set[str]:
    return set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:])}


def shingles(ws: list[str]) -> set[str]:
    n = min(SHINGLE, len(ws))
    return {" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set()


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]               # the last class is NONE
    bias: list[float]
    weights: dict[str, list[float]]   # n-gram -> weight by class
    temperature: float

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for g in self.weights for w in g.split()})

    @property
    def key_words(self) -> list[str]:
        """For each notice a word that is left by any ``SAME`` of its shingles, one with weight if there is any."""
        out = set()
        for own in (shingles(words_of(t)) for ts in NOTICES.values() for t in ts):
            spared = len(own) - math.ceil(SAME * len(own))
            count: dict[str, int] = {}
            for w in (w for r in own for w in set(r.split())):
                count[w] = count.get(w, 0) + 1
            lasting = [w for w, n in count.items() if n > spared]
            out.add(max(lasting, key=lambda w: (w in self.weights, w in out, len(w), w)))
        return sorted(out)

    def logits(self, grams: set[str]) -> list[float]:
        out = list(self.bias)
        for g in sorted(grams):
            for c, w in enumerate(self.weights.get(g, ())):
                out[c] += w
        return [z / self.temperature for z in out]

    def probabilities(self, grams: set[str]) -> list[float]:
        z = self.logits(grams)
        top = max(z)
        e = [math.exp(x - top) for x in z]
        return [x / sum(e) for x in e]


def _examples(negatives: list[str]) -> list[tuple[set[str], str]]:
    """Notices whole, cut and set among other words; notices without the words of
    their family as UNKNOWN; drawn paragraphs as NONE."""
    rng = random.Random(11)
    plain = [words_of(t) for t in negatives]
    filler = [w for ws in plain for w in ws] or ["text"]
    out = [(ngrams(ws), NONE) for ws in plain if ws]
    users: dict[str, set[str]] = {}
    for family, notices in NOTICES.items():
        for w in (w for t in notices for w in words_of(t)):
            users.setdefault(w, set()).add(family)
    for family, notices in NOTICES.items():
        for notice in notices:
            ws = words_of(notice)
            for n in range(8):
                kept = list(ws)
                if n % 4 == 1 and len(kept) > 6:
                    del kept[rng.randrange(len(kept))]
                if n % 4 == 2 and len(kept) > 6:
                    kept = kept[:max(5, int(0.85 * len(kept)))]
                before, after = (rng.choices(filler, k=rng.randint(0, 8)) if n else [] for _ in range(2))
                out.append((ngrams(before + kept + after), family))
                if n % 2:
                    foreign = [rng.choice(filler) if len(users[w]) <= 4 else w for w in kept]
                    if foreign != kept and sum(a == b for a, b in zip(foreign, kept)) >= 2:
                        out.append((ngrams(before + foreign + after), UNKNOWN))
    rng.shuffle(out)
    return out


def fit(negatives: list[str]) -> LicenceModel:
    """Multinomial logistic regression by stochastic steps with decaying weights; the
    temperature minimises the loss on every fourth example, which is held out."""
    families = [*NOTICES, UNKNOWN, NONE]
    seen: dict[str, int] = {}
    for t in negatives:
        for g in ngrams(words_of(t)):
            seen[g] = seen.get(g, 0) + 1
    rare = {g for notices in NOTICES.values() for t in notices for g in ngrams(words_of(t))
            if seen.get(g, 0) <= COMMON * len(negatives)}
    examples = [(sorted(g & rare), families.index(c)) for g, c in _examples(negatives)]
    taught, held = [e for i, e in enumerate(examples) if i % 4], examples[::4]
    weights = {g: [0.0] * len(families) for g in sorted(rare)}
    bias = [0.0] * len(families)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 4)
        for grams, c in taught:
            z = list(bias)
            for g in grams:
                z = [a + b for a, b in zip(z, weights[g])]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            total = sum(e)
            step = [rate * ((k == c) - x / total) for k, x in enumerate(e)]
            bias = [b + 0.2 * s for b, s in zip(bias, step)]
            scale = 1 / max(1, len(grams)) ** 0.5
            for g in grams:
                weights[g] = [(1 - rate * PENALTY) * w + scale * s for w, s in zip(weights[g], step)]
    raw = LicenceModel(families, bias, weights, 1.0)
    logits = [(raw.logits(set(g)), c) for g, c in held]

    def loss(t):
        return sum(math.log(sum(math.exp((x - z[c]) / t) for x in z)) for z, c in logits)

    temperature = min((0.25 * 1.15 ** k for k in range(25)), key=loss)
    rounded = {g: [round(w, 6) for w in ws] for g, ws in weights.items()}
    return LicenceModel(families, [round(b, 6) for b in bias], rounded, round(temperature, 6))


def train(docs: DataFrame, text_col: str = "text", negatives: int = NEGATIVES) -> LicenceModel:
    """The model from the notices and about ``negatives`` paragraphs of the corpus that
    share no shingle with a notice."""
    texts = docs.select(F.col(text_col).alias("t")).where("t is not null")
    n = texts.count()
    if n:
        some = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(min(1.0, negatives / n) * (1 << 30)))
        line = F.get(F.split("t", "\n"), F.pmod(F.xxhash64("t", F.lit("line")), F.size(F.split("t", "\n")).cast("bigint")).cast("int"))
        drawn = sorted(r[0] for r in some.select(F.substring(line, 1, EXCERPT)).distinct().collect())
    else:
        drawn = []
    known = set().union(*[shingles(words_of(t)) for ts in NOTICES.values() for t in ts])
    sizes = {len(k.split()) for k in known}

    def innocent(text):
        ws = words_of(text)
        return not any(" ".join(ws[i:i + k]) in known for k in sizes for i in range(len(ws)))

    return fit([t for t in drawn if innocent(t)])


# ---- scanning -----------------------------------------------------------------

def _words(line: Column) -> Column:
    ascii_lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(ascii_lower, F.lit(WORD), F.lit(0))


def _runs(ws: Column, n: int) -> Column:
    """All runs of n neighbouring words, joined by blanks."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))


def _literal(value, kind: str) -> Column:
    """A constant of a nested type."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _named(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _judged(lines: Column, model: LicenceModel) -> Column:
    """The paragraphs (with ``words``) that read like a licence: class, its probability and that of any licence.

    Each step maps the array of the paragraphs in question to the next one's, so
    every intermediate value is computed once a paragraph.
    """
    grams_known = _literal(sorted(model.weights), "array<string>")
    weights = _literal(model.weights, "map<string,array<double>>")
    bias = _literal(model.bias, "array<double>")
    known = F.transform(lines, lambda x: _named(at=x, grams=F.array_sort(
        F.array_intersect(F.concat(x["words"], _runs(x["words"], 2)), grams_known))))
    known = F.filter(known, lambda x: F.size(x["grams"]) > 0)
    logits = F.transform(known, lambda x: _named(at=x["at"], z=F.aggregate(
        x["grams"], bias, lambda a, g: F.zip_with(a, F.element_at(weights, g), lambda y, w: y + w))))
    shares = F.transform(logits, lambda x: _named(at=x["at"], e=F.transform(
        x["z"], lambda y: F.exp((y - F.array_max(x["z"])) / model.temperature))))
    shares = F.transform(shares, lambda x: _named(at=x["at"], c=F.array_position(x["e"], F.lit(1.0)).cast("int"),
                                                  total=F.aggregate(x["e"], F.lit(0.0), lambda a, y: a + y),
                                                  none=F.element_at(x["e"], -1)))
    licence = F.filter(shares, lambda x: x["none"] / x["total"] < 1 - SURE)
    return F.transform(licence, lambda x: _named(at=x["at"], c=x["c"], p=F.lit(1.0) / x["total"], licence=F.lit(1.0) - x["none"] / x["total"]))


def _single(lines: Column, model: LicenceModel) -> Column:
    """Lines that read like a licence, each judged alone."""
    sizes = sorted({min(SHINGLE, len(words_of(t))) for ts in NOTICES.values() for t in ts})
    runs = F.transform(_judged(lines, model), lambda x: _named(line=x["at"]["line"], c=x["c"], p=x["p"], licence=x["licence"],
                                                               runs=F.concat(*[_runs(x["at"]["words"], n) for n in sizes])))

    def confirmed(x):
        out = F.lit(False)
        for c, notices in enumerate(NOTICES.values()):
            hits = [F.size(F.array_intersect(_literal(sorted(shingles(words_of(t))), "array<string>"), x["runs"]))
                    >= math.ceil(SAME * len(shingles(words_of(t)))) for t in notices]
            out = out | ((x["c"] == c + 1) & reduce(lambda a, b: a | b, hits))
        return out

    return F.transform(runs, lambda x: _named(line=x["line"], last=x["line"], c=x["c"], p=x["p"], licence=x["licence"],
                                              sure=(x["p"] >= SURE) & confirmed(x)))


def _blocks(lines: Column, keys: Column) -> Column:
    """Runs of two and more neighbouring lines with words and a key word: ``words``, and the line of each word."""
    def has_words(i):
        return F.coalesce(F.size(F.get(lines, i)["words"]) > 0, F.lit(False))

    places = F.sequence(F.lit(0), F.size(lines) - 1)
    first = F.filter(places, lambda i: has_words(i) & ~has_words(i - 1))
    last = F.filter(places, lambda i: has_words(i) & ~has_words(i + 1))
    spans = F.filter(F.zip_with(first, last, lambda a, b: _named(a=a, b=b)), lambda s: s["b"] > s["a"])
    blocks = F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"] + 1))
    blocks = F.filter(blocks, lambda x: F.exists(x, lambda y: F.arrays_overlap(y["words"], keys)))
    blocks = F.transform(blocks, lambda x: F.transform(x, lambda y: _named(line=y["line"], words=F.when(
        F.element_at(y["words"], 1).isin(*COMMENT_WORDS), F.slice(y["words"], 2, F.size(y["words"]))).otherwise(y["words"]))))
    return F.transform(blocks, lambda x: _named(words=F.flatten(F.transform(x, lambda y: y["words"])), lines=F.flatten(
        F.transform(x, lambda y: F.array_repeat(y["line"], F.size(y["words"]))))))


def _broken(lines: Column, model: LicenceModel, keys: Column) -> Column:
    """Notices that are broken over neighbouring lines, each once."""
    by_size: dict[int, list] = {}
    for c, notices in enumerate(NOTICES.values()):
        for t in notices:
            ws = words_of(t)
            n = min(SHINGLE, len(ws))
            own = list(dict.fromkeys(" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1)))
            by_size.setdefault(n, []).append({"c": c + 1, "least": math.ceil(SAME * len(own)), "own": own})
    nowhere = F.array().cast("array<struct<a:int,b:int,n:int>>")

    def copies(hits: Column, own: Column, least: Column) -> Column:
        """From first to last shingle of every copy: a copy ends where the notice's order goes back."""
        mine = F.filter(F.transform(hits, lambda h: _named(i=h["i"], k=F.array_position(own, h["run"]).cast("int"))), lambda h: h["k"] > 0)
        zero = F.lit(0)
        start = _named(done=nowhere, k=zero, a=zero, b=zero, n=zero)

        def step(s, h):
            on = h["k"] > s["k"]
            return _named(done=F.when(on, s["done"]).otherwise(F.concat(s["done"], F.array(_named(a=s["a"], b=s["b"], n=s["n"])))),
                          k=h["k"], a=F.when(on & (s["n"] > 0), s["a"]).otherwise(h["i"]), b=h["i"], n=F.when(on, s["n"] + 1).otherwise(F.lit(1)))

        found = F.aggregate(mine, start, step, lambda s: F.concat(s["done"], F.array(_named(a=s["a"], b=s["b"], n=s["n"]))))
        return F.filter(found, lambda s: s["n"] >= least)

    def of_size(block: Column, n: int, notices: list) -> Column:
        every = _literal(sorted({r for x in notices for r in x["own"]}), "array<string>")
        runs = F.transform(_runs(block["words"], n), lambda run, i: _named(i=i, run=run))
        return _let(F.filter(runs, lambda h: F.array_contains(every, h["run"])), lambda hits: F.flatten(F.transform(
            _literal(notices, "array<struct<c:int,least:int,own:array<string>>>"), lambda t: F.transform(
                copies(hits, t["own"], t["least"]), lambda s: _named(c=t["c"], a=s["a"], b=s["b"] + (n - 1))))))

    def of_block(block: Column) -> Column:
        out = [of_size(block, n, notices) for n, notices in sorted(by_size.items())]
        # of one family's copies that overlap, the one that begins first and goes farthest
        return _let(F.array_distinct(F.concat(*out)), lambda all_: F.transform(
            F.filter(all_, lambda s: (F.get(block["lines"], s["a"]) < F.get(block["lines"], s["b"])) & ~F.exists(all_, lambda o: (
                (o["c"] == s["c"]) & (o["b"] >= s["a"]) & ((o["a"] < s["a"]) | ((o["a"] == s["a"]) & (o["b"] > s["b"])))))),
            lambda s: _named(line=F.get(block["lines"], s["a"]), last=F.get(block["lines"], s["b"]), family=s["c"],
                             words=F.slice(block["words"], s["a"] + 1, s["b"] - s["a"] + 1))))

    found = F.flatten(F.transform(_blocks(lines, keys), of_block))
    sure = F.filter(_judged(found, model), lambda x: (x["c"] == x["at"]["family"]) & (x["p"] >= SURE))
    return F.transform(sure, lambda x: _named(line=x["at"]["line"], last=x["at"]["last"], c=x["c"], p=x["p"], licence=x["licence"], sure=F.lit(True)))


def _with_broken(single: Column, broken: Column) -> Column:
    """Both in line order, without broken copies on a line that says the same alone and without ``unknown`` parts."""
    def meet(x, y):
        return (x["line"] <= y["last"]) & (y["line"] <= x["last"])

    fresh = F.filter(broken, lambda y: ~F.exists(single, lambda x: x["sure"] & (x["c"] == y["c"]) & meet(x, y)))
    return F.array_sort(F.concat(F.filter(single, lambda x: x["sure"] | ~F.exists(broken, lambda y: meet(x, y))), fresh))


def scan(df: DataFrame, model: LicenceModel, text_col: str = "text", out_col: str = "licences") -> DataFrame:
    """``df`` with ``out_col``: an array of (line number, family or ``unknown``, probability)
    of the paragraphs that read like a licence."""
    keys = _literal(model.key_words, "array<string>")
    wanted = _literal(sorted({*model.vocabulary, *model.key_words}), "array<string>")
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x, i: _named(line=i, words=_words(x)))

    def of_lines(every: Column) -> Column:
        def of_some(some: Column) -> Column:
            return F.when(F.exists(some, lambda x: F.arrays_overlap(x["words"], keys)), _let(
                _named(single=_single(some, model), broken=_broken(every, model, keys)),
                lambda x: _with_broken(x["single"], x["broken"]))).otherwise(_single(some, model))
        return _let(F.filter(every, lambda x: F.arrays_overlap(x["words"], wanted)), of_some)

    return df.withColumn(out_col, F.transform(_let(lines, of_lines), lambda x: _named(
        line=x["line"], family=F.when(x["sure"], F.element_at(_literal(model.families, "array<string>"), x["c"])).otherwise(UNKNOWN),
        p=F.when(x["sure"], x["p"]).otherwise(x["licence"]))))


def licences_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, families (confirmed, sorted, comma-joined), n_licence, n_unknown, top probability."""
    found = scan(docs.select("doc_id", "text"), train(docs)).select("doc_id", "licences")
    known = F.filter("licences", lambda x: x["family"] != UNKNOWN)
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
        F.size(known).cast("bigint").alias("n_licence"), (F.size("licences") - F.size(known)).cast("bigint").alias("n_unknown"),
        F.round(F.array_max(F.transform("licences", lambda x: x["p"])), 4).alias("top_probability"))
