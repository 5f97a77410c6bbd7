"""Engine columns are never log fields, and log fields may have any name."""

import tempfile

import pytest
from pyspark.sql import functions as F

from logweave.functions.fields import fields_of
from logweave.operators import events as E
from logweave.operators import filters as FL
from logweave.operators import parse as PA
from logweave.operators import search as S
from logweave.operators import sort as SO
from logweave.operators import tags as T
from logweave.operators import view as V
from logweave.plans import rules as R
from logweave.plans.profile import LogProfile
from logweave.streaming.live import NUMBERED_SCHEMA, live_rows
from tests.conftest import lines_df

TEXTS = ["INFO|ok", "ERROR|the true 500", "WARN|nothing", "no delimiter"]


def parsed(spark, names=("Level", "Message")):
    return PA.parse_delimited(lines_df(spark, TEXTS), "|", list(names))


def decorate(rows):
    out = T.color_rows(T.flag_rows(rows, R.DEFAULT_FLAGS), R.DEFAULT_PAINTS)
    return E.assign_events(out, "^[A-Z]")


@pytest.mark.parametrize("query", ["true", "500", "1", "ok", "[]", "a.log"])
def test_same_answer_before_and_after_other_operators(spark, query):
    rows = parsed(spark)
    more = decorate(rows)
    assert fields_of(more) == fields_of(rows)
    vf = R.ViewFilter(text=query)
    assert FL.view(rows, vf).count() == FL.view(more, vf).count()
    q = R.SearchQuery(query)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.search(rows, q)) == key(S.search(more, q))
    rule = [R.contains(query)]
    lines = lambda df: sorted(r.line_no for r in T.flag_rows(df, rule).where("is_flagged").collect())
    assert lines(rows) == lines(more)


def test_live_rows_do_not_search_offsets(spark):
    numbered = spark.createDataFrame([("a.log", 0, 1, 500, "INFO|ok", 1, True), ("a.log", 0, 2, 7, "INFO|500", 2, True)], NUMBERED_SCHEMA)
    profile = LogProfile.delimited("|", ["Level", "Message"])
    got = live_rows(numbered, profile, [R.contains("500")], spark=spark).where("is_flagged").collect()
    assert [r.line_no for r in got] == [2]


NAMES = ["Path", "text", "_verb", "profile", "is_flagged", "line_no", "fields", "raw", "block", "a`b", "x.y"]


def test_any_field_name(spark):
    text = "|".join(f"v{i}" for i in range(len(NAMES)))
    rows = PA.parse_delimited(lines_df(spark, [text, "none"]), "|", NAMES)
    fs = fields_of(rows)
    assert list(fs.columns) == [*NAMES, "RawText"]
    got = rows.orderBy("line_no").select(*[fs.get(n).alias(f"c{i}") for i, n in enumerate(NAMES)]).first()
    assert list(got) == [f"v{i}" for i in range(len(NAMES))]
    for i, n in enumerate(NAMES):
        assert FL.apply_filters(rows, [R.equals(n, f"v{i}")]).count() == 1
        assert [r.field for r in S.search(decorate(rows), R.SearchQuery(f"v{i}", whole_word=True)).collect()] == [n]
    assert FL.view(rows, R.ViewFilter(text="v2")).count() == 1  # a field whose name starts with an underscore
    assert SO.sort_by_field(rows, "Path").count() == 2
    shown = V.show_columns(rows, ["Path", "x.y"])
    assert list(fields_of(shown).columns) == ["Path", "x.y"]
    assert "text" not in fields_of(V.hide_columns(rows, ["text"])).columns


def test_marks_survive_parquet_and_joins(spark):
    rows = decorate(parsed(spark, ["profile", "Message"]))
    out = tempfile.mkdtemp(prefix="lw-marks-") + "/rows"
    rows.write.parquet(out)
    back = spark.read.parquet(out).join(spark.createDataFrame([("a.log", "x")], "path string, more string"), "path")
    assert fields_of(back) == fields_of(rows)
    assert FL.apply_filters(back, [R.equals("profile", "ERROR")]).count() == 1


def test_unmarked_frames_use_their_string_columns(spark):
    df = spark.createDataFrame([("a.log", 1, "x", 5, True)], "path string, line_no long, word string, n long, is_flagged boolean")
    assert fields_of(df).columns == ("word",)
    assert fields_of(df.withColumn("_w", F.lit("y"))).columns == ("word", "_w")
