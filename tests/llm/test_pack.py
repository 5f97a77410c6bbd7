"""Packing against the library's own encoding, and the rules of a sequence."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm import pack as P

CODER = Tokenizer.from_file(P.VOCABULARY)
SPEC = open(P.VOCABULARY, encoding="utf-8").read()


@pytest.fixture(scope="module")
def words():
    return P.WordPieces(SPEC)


def library(text):
    return CODER.encode(text or "", add_special_tokens=False).ids


def check(rows, docs, tiers=P.TIERS, step=P.STEP_TOKENS):
    """rows of ``pack``; docs: list of (id, text) with distinct ids."""
    whole, sequences, groups = defaultdict(list), defaultdict(list), defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        whole[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length, r.window))
        groups[r.step_group][r.sequence_id] = r.window
    assert set(whole) == {i for i, _ in docs}
    for i, text in docs:
        want, at = [*library(text), P.END_ID], 0
        for start, ids, n in sorted(whole[i]):
            assert start == at and n == len(want) and ids == want[at:at + len(ids)]
            at += len(ids)
        assert at == len(want)
    for parts in sequences.values():
        at = 0
        for offset, length, window in sorted(parts):
            assert offset == at
            at += length
            assert window == sum(p[1] for p in parts)
        assert at <= max(tiers) and at & (at - 1) == 0
    assert all(sum(g.values()) <= step for g in groups.values())
    return sequences, groups


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(["the", "Naïve", "token's", "12", "x—y", "\n", "\t", "🙂", "İx", "ΣΑΣ", "é", "foo<|endoftext|>bar", "word,"],
                                  k=rng.choice([1, 5, 40, 300, 2500]))) for _ in range(n)]
    return list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "long text, é " * 40_000)]


def test_pieces_sequences_and_groups(docs_df):
    docs = corpus()
    seqs, groups = check(P.pack(docs_df(docs).repartition(3, "doc_id")).collect(), docs)
    assert len({s >> 40 for s in seqs}) == 3
    assert {len(g) * max(g.values()) for g in groups.values() if len(set(g.values())) == 1 and len(g) > 8} <= {P.STEP_TOKENS, *range(P.STEP_TOKENS)}


def test_blocks_much_smaller_than_the_corpus(docs_df):
    docs = corpus(2, 400)
    rows = P.pack(docs_df(docs).coalesce(1), tiers=(64, 32, 16), step_tokens=256, block_tokens=3000).collect()
    seqs, groups = check(rows, docs, (64, 32, 16), 256)
    full = [g for g in groups.values() if sum(g.values()) == 256]
    assert len(full) >= len(groups) - 1  # all but the last of the task
    short = [p for p in seqs.values() if p[0][2] not in (64, 32, 16)]
    assert len(short) <= 6  # the powers of two of what the last block leaves


def test_documents_keep_whole_where_they_fit(docs_df):
    docs = [(i, "word " * (20 + i % 400)) for i in range(600)]
    rows = P.pack(docs_df(docs).coalesce(1)).collect()
    cut = {r.doc_id for r in rows if r.length < r.doc_tokens}
    assert len(cut) < 0.35 * len(docs)


def test_query_checksums_and_repeats(docs_df):
    docs = [(1, "same text"), (1, "same text"), (None, "no id"), (2, None)]
    got = P.packed_documents(docs_df(docs).coalesce(1)).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, text, times in ((1, "same text", 2), (None, "no id", 1), (2, "", 1)):
        ids = [*library(text), 2]
        assert sum(n for _, n, _ in pieces[i]) == times * len(ids)
        assert all(c == crc(ids[s:s + n]) for s, n, c in pieces[i])


def test_same_rows_again_and_other_columns(spark, docs_df):
    cols = "doc_id long, text string, length string, window string, _text string, _id string"
    assert P.pack(spark.createDataFrame([], cols)).collect() == []
    df = spark.createDataFrame([(i, "a b c " * i, "x", "y", "z", "t") for i in range(50)], cols).repartition(4, "doc_id")
    assert P.pack(df).collect() == P.pack(df).collect()
    named = spark.createDataFrame([("k-1", "a b c")], "`my id` string, body string")
    r = P.pack(named, "my id", "body").orderBy(F.desc("length")).collect()
    assert {x["my id"] for x in r} == {"k-1"} and sum(x.length for x in r) == 4


@settings(max_examples=250, deadline=None)
@given(st.text(st.sampled_from(list("abc'st reLL,.!12²½ éÉñßŁİıΣσςΩḱͅ漢字🙂\t\n\r\x0b\x0c\x1c\x85\xa0  \xad_-<|>")), max_size=60))
def test_words_are_the_librarys(words, text):
    assert words.ids(text).tolist() == library(text)
    mixed = text.join(["<|startoftext|>", " x "])
    assert words.ids(mixed).tolist() == library(mixed)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_the_librarys(words, text):
    assert words.ids(text).tolist() == library(text)


def test_long_texts_in_parts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(P, "PART_CHARS", 50)
    monkeypatch.setattr(P, "MEMORY_WORDS", 20)
    coder = P.WordPieces(SPEC)
    rng = random.Random(3)
    text = "".join(rng.choices(["Ab", "c'd ", "é", "\n", " ", "🙂", "12", "İ", "verylongword" * 9], k=3000))
    assert coder.pattern is not None and coder.ids(text).tolist() == library(text)
    assert len(coder.words) <= 20 + 50


def test_other_rules_take_the_library():
    coder = P.WordPieces(open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf-8").read())
    assert coder.pattern is None
    text = "Hello  world,\n it's 12"
    assert coder.ids(text).tolist() == Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60), st.booleans())
def test_windows_use_up_the_pool(lengths, last):
    pool = P.Pool()
    for doc, n in enumerate(lengths):
        pool.put(doc, 0, n)
    seen = defaultdict(list)
    for window in P.windows(pool, (64, 32, 16), last):
        size = sum(p[2] for p in window)
        assert size & (size - 1) == 0 and size <= 64 and (last or size >= 16)
        for doc, start, n in window:
            seen[doc].append((start, n))
    assert pool.tokens < 64 and (not last or pool.tokens == 0)
    assert sum(n for p in seen.values() for _, n in p) + pool.tokens == sum(lengths)
    for doc, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n


def test_groups_of_equal_size_and_near_cost():
    rng = random.Random(4)
    found = [[(i, 0, n), (i, n, 4096 - n)] for i, n in enumerate(rng.choices(range(1, 4096), k=160))]
    groups = P.balanced(found, 16)
    cost = [sum(p[2] ** 2 for w in g for p in w) for g in groups]
    assert [len(g) for g in groups] == [16] * 10
    assert max(cost) < 1.05 * min(cost)
