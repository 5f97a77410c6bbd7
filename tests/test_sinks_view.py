import csv
import glob
import os

from logweave.operators import events as E
from logweave.operators import summary as SU
from logweave.operators.tags import flag_rows
from logweave.plans import rules as R
from logweave.sources import sinks as SK
from tests.conftest import lines_df, rows_df


def test_tsv_and_raw_text(spark):
    df = spark.createDataFrame([("a.log", 1, "x", "y", None), ("a.log", 2, None, None, "raw line")],
                               "path string, line_no long, A string, B string, RawText string")
    tsv = {r.line_no: r.tsv for r in SK.tsv_lines(df, ["A", "B"]).collect()}
    assert tsv == {1: "1\tx\ty", 2: "2\t\t"}
    raw = {r.line_no: r.raw_text for r in SK.raw_text(df).collect()}
    assert raw == {1: "x y", 2: "raw line"}
    assert SK.tsv_header(["A", "B"]) == "Line\tA\tB"


def test_write_tsv(spark, tmpdir_path):
    df = spark.createDataFrame([("a.log", 1, "x", None)], "path string, line_no long, A string, B string")
    out = os.path.join(tmpdir_path, "out")
    SK.write_tsv(df, ["A", "B"], out)
    parts = glob.glob(os.path.join(out, "part-*.csv"))
    rows = [r for p in parts for r in csv.reader(open(p), delimiter="\t")]
    assert ["Line", "A", "B"] in rows
    assert [r[:2] for r in rows if r[0] != "Line"] == [["1", "x"]]


def test_line_refs_chunks(spark):
    df = spark.createDataFrame([("a.log", i) for i in [5, 1, 3]], "path string, line_no long")
    assert SK.line_refs(df).collect()[0].line_refs == "1, 3, 5"
    big = SK.line_refs(df, chunk_lines=2).orderBy("chunk").collect()
    assert [(r.chunk, r.line_refs) for r in big] == [(0, "1"), (1, "3"), (2, "5")]


def test_attach_continuations(spark):
    rows = lines_df(spark, ["H1", "  a", "  b", "H2", "H3", " c"]).withColumnRenamed("text", "raw")
    assigned = E.assign_events(rows, "^H")
    shown = assigned.where("raw like 'H%'").select("path", "line_no")
    got = {r.line_no: r.n_continuations for r in E.attach_continuations(shown, assigned).collect()}
    assert got == {1: 2, 4: 0, 5: 1}


def test_status_summary_and_total(spark):
    df = rows_df(spark, [(1, "ERROR", "x"), (2, "INFO", "y"), (3, "WARN", "z")], ["Level", "Message"])
    df = df.withColumn("is_parsed", df.line_no != 2)
    tagged = flag_rows(df)
    from pyspark.sql import functions as F
    summ = {r.path: (r.shown, r.total, r.parsed, r.fallback, r.flagged)
            for r in SU.status_summary(tagged, F.col("Level") != "INFO").collect()}
    assert summ == {"a.log": (2, 3, 2, 1, 2), None: (2, 3, 2, 1, 2)}
    assert SU.total_flagged(tagged).collect()[0].total_flagged == 2


def test_view_helpers(spark):
    from logweave.operators import view as V
    df = rows_df(spark, [(1, "INFO", "a"), (2, "ERROR", "b")], ["Level", "Message"])
    assert V.show_columns(df, ["Message"]).columns == ["path", "line_no", "Message"]
    assert V.hide_columns(df, ["Level", "path"]).columns == ["path", "line_no", "Message"]
    refs = spark.createDataFrame([("a.log", 2)], "path string, line_no long")
    assert [r.line_no for r in V.lookup_lines(df, refs).collect()] == [2]
    more = rows_df(spark, [(3, "WARN", "c")], ["Level", "Message"])
    assert V.append_rows(df, more.drop("Message")).count() == 3
