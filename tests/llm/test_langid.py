import random
import zlib

from pyspark.sql import functions as F

from logweave.llm import langid as L

SYLLABLES = {"aa": ["tion", "the", "ing", "er", "and"], "bb": ["schl", "ung", "keit", "der", "ü"],
             "cc": ["ción", "ñ", "que", "los", "ja"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.choice([12, 30, 60, 400])), lang))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_columns(docs_df):
    rows = corpus()
    got = {r.doc_id: r for r in L.language_of_documents(docs_df(rows)).collect()}
    assert {i: r.held_out for i, r in got.items()} == {i: held(i) for i, _, _ in rows}
    out = [i for i, _, _ in rows if held(i)]
    truth = {i: lang for i, _, lang in rows}
    assert sum(got[i].lang_pred == truth[i] for i in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.accepted == (r.margin >= L.NARROW) for r in got.values())


def test_undetermined_and_odd_rows(docs_df):
    rows = corpus(60) + [(500, None, "aa"), (501, "", "bb"), (502, "12 + 3 = !!", "aa"), (None, "the and ing", "aa"),
                         (503, prose(random.Random(9), "aa", 100_000), "aa"), (504, "ü", "bb"), (504, "ü", "bb"), (505, "schlung keit", None)]
    df = docs_df(rows).withColumn("lang_best", F.lit("clash"))
    got = L.language_of_documents(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    for i in (500, 501, 502):
        assert (by[i][0].lang_pred, by[i][0].score, by[i][0].accepted) == ("und", 0.0, False)
    assert by[503][0].lang_pred == "aa" and by[505][0].lang_pred == "bb"
    assert by[None][0].held_out is False
    assert by[504][0] == by[504][1]


def test_held_out_rows_and_other_columns_teach_nothing(docs_df):
    rows = corpus(120, 2)
    a = docs_df(rows)
    wrong = [(i, t, "zz" if held(i) else lang, "elsewhere") for i, t, lang in rows]
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in L.language_of_documents(df).collect())
    assert key(a) == key(docs_df(wrong))


def test_training_does_not_depend_on_partitions(docs_df):
    df = docs_df(corpus(100, 3))
    assert L.train(df.repartition(7)).contents == L.train(df.coalesce(1)).contents


def test_narrow_margin_is_rejected(docs_df):
    df = docs_df(corpus(100, 4))
    model = L.train(df)
    out = L.identify(df.withColumn("lang_margin", F.lit("x")), model, narrow=0.5)
    assert out.where("lang_id = 'und'").count() > 0
    assert out.where("lang_id not in ('und', lang_best)").count() == 0


def test_nothing_to_learn_from(docs_df):
    assert L.language_of_documents(docs_df([])).count() == 0
    got = L.language_of_documents(docs_df([(1, "words", None), (2, None, "aa")])).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_numbers_are_no_letters_and_length_changes_no_rule(spark, docs_df):
    rows = corpus()
    model = L.train(docs_df(rows))
    coders = model.coders()
    for text in ("½ ²", "③", "Ⅷ", "12 34", "", None, " _ - "):
        assert model.judge(text, coders) == (L.UNDETERMINED, 0.0, 0.0)
    assert model.judge("½ x", coders)[0] != L.UNDETERMINED
    rng = random.Random(8)
    text = L.normal(prose(rng, "bb", 90)).decode()
    scores = [model.judge(text[:n], coders)[1] for n in range(190, 215)]
    assert max(abs(a - b) for a, b in zip(scores, scores[1:])) < 0.12
