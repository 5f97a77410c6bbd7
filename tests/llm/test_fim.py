"""Fill-in-middle against a reading of its rules with Python regexes."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import fim as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ALPHABET = " \t\n\x0b\x0c\r\x08\x0e\x1f!aé\xa0 漢🙂\x7f"


def test_against_the_rules(docs_df):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " "), (403, "x"), (404, "\n\n"), (None, "no id here"), (None, None),
             (2, "the same id twice"), (2, "the same id twice"), (405, "a <P> b"), (406, "a <S> b"), (407, "<M>"), (408, "< P > <p>")]
    rows += [(500 + i, "long text é " * 30_000) for i in range(6)]
    got = M.fill_in_middle(docs_df(rows)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == \
        sorted(((i, *by_hand(i, t)) for i, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_digests_and_round_trip(docs_df):
    rows = [(i, f"word {i} and\nmore  of it \t" * (i % 5)) for i in range(200)] + [(900, None)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: r for r in M.transformed_documents(docs_df(rows)).collect()}
    for i, t in rows:
        n, form, p, m, out = by_hand(i, t)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert (r.output_sha256, r.restored_sha256) == (sha(out), sha(t or ""))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET + "bcd", max_size=40), max_size=12), st.randoms())
def test_cut_points(texts, rnd):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    draws = np.array([[rnd.getrandbits(32), rnd.getrandbits(32)] for _ in texts], dtype=np.int64).reshape(-1, 2)
    n, low, high, p, m = M.cut_points(b"".join(raw), bounds, draws[:, 0], draws[:, 1])
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        a, b = sorted(int(x) % (len(units) + 1) for x in draws[i])
        assert n[i] == len(units)
        assert low[i] - bounds[i] == len("".join(units[:a]).encode())
        assert high[i] - bounds[i] == len("".join(units[:b]).encode())
        assert (p[i], m[i]) == (len("".join(units[:a])), len("".join(units[a:b])))


def test_white_bytes_of_all_values():
    words = np.arange(256, dtype=np.uint8).view("<u8")
    white = M.white_bytes(words).view(np.uint8)
    assert [b for b in range(256) if white[b]] == [9, 10, 11, 12, 13, 32]


def test_select_is_the_inverse_of_rank():
    rng = np.random.default_rng(1)
    bits = rng.random(4000) < 0.3
    bits[800:1600] = False
    marks = M.Marks((bits.astype(np.uint8) * 128).view("<u8"))
    places = np.flatnonzero(bits)
    assert np.array_equal(marks.select(np.arange(1, len(places) + 1)), places)
    assert np.array_equal(marks.rank(places), np.arange(len(places)))


def test_small_slices_give_the_same(docs_df, monkeypatch):
    rows = [(i, "one two  three é\n" * (i % 7)) for i in range(60)]
    data = M.pa.array([t for _, t in rows])
    monkeypatch.setattr(M, "SLICE_BYTES", 40)
    spans = list(M._slices(data))
    assert spans[0][0] == 0 and spans[-1][1] == len(rows) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    whole = M._transformed(M.pa.RecordBatch.from_arrays([M.pa.array(range(60)), data, *[M.pa.array([7 * i + k for i in range(60)]) for k in range(4)]],
                                                        names=list("abcdef")), 50, 80, [b"<P>", b"<S>", b"<M>"])
    cut = [M._transformed(M.pa.RecordBatch.from_arrays([M.pa.array(range(60)), data, *[M.pa.array([7 * i + k for i in range(60)]) for k in range(4)]],
                                                       names=list("abcdef")).slice(a, b - a), 50, 80, [b"<P>", b"<S>", b"<M>"]) for a, b in spans]
    assert M.pa.Table.from_batches(cut).to_pylist() == whole.to_pylist()


def test_empty_table_clashing_names_and_other_types(spark):
    cols = "doc_id long, text string, n string, form string, output string, _text string"
    assert M.fill_in_middle(spark.createDataFrame([], cols)).collect() == []
    df = spark.createDataFrame([(1, "a b c", "x", "y", "z", "t")], cols)
    r = M.fill_in_middle(df).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(1, "a b c")
    named = spark.createDataFrame([("k-1", "a b c")], "`my id` string, body string")
    r = M.fill_in_middle(named, "my id", "body").first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand("k-1", "a b c")


@pytest.mark.parametrize("percent,spm,forms", [(100, 100, {"spm"}), (100, 0, {"psm"}), (0, 50, {"plain"})])
def test_rates(docs_df, percent, spm, forms):
    got = M.fill_in_middle(docs_df([(i, "a b c d") for i in range(30)]), percent=percent, spm_percent=spm, markers=("[p]", "[s]", "[m]"))
    assert {r.form for r in got.collect()} == forms
    back = got.select(M.restored(got.output, got.form, ("[p]", "[s]", "[m]")).alias("t")).distinct().collect()
    assert [r.t for r in back] == ["a b c d"]
