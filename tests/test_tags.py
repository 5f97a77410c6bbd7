from logweave.functions.levels import guess_role, level_rank, suggested_names
from logweave.operators import sort as SO
from logweave.operators import tags as T
from logweave.plans import rules as R
from tests.conftest import rows_df
from pyspark.sql import functions as F
import pytest


def flagged(df):
    return [r.line_no for r in T.flagged_lines(df).collect()]


def test_flag_field_value(spark):
    df = rows_df(spark, [(1, "INFO"), (2, "ERROR"), (3, "WARN"), (4, "ERROR")], ["Level"])
    assert flagged(T.flag_rows(df, [R.equals("Level", "ERROR")])) == [2, 4]


def test_flag_union_counts_each_line_once(spark):
    df = rows_df(spark, [(1, "ERROR", "disk fail"), (2, "INFO", "ok"), (3, "WARN", "disk")], ["Level", "Message"])
    rules = [R.equals("Level", "ERROR"), R.contains("DISK"), R.regex("fail")]
    tagged = T.flag_rows(df, rules)
    assert flagged(tagged) == [1, 3]
    counts = {r.path: r.flagged for r in T.flag_counts(tagged).collect()}
    assert counts == {"a.log": 2, None: 2}


def test_flag_regex_scoped_to_field(spark):
    df = rows_df(spark, [(1, "ERROR", "x"), (2, "INFO", "ERROR here")], ["Level", "Message"])
    assert flagged(T.flag_rows(df, [R.regex("error", "Message")])) == [2]


def test_default_flags(spark):
    df = rows_df(spark, [(1, "a timeout here"), (2, "timeouts"), (3, "Exception!")], ["Message"])
    assert flagged(T.flag_rows(df)) == [1, 3]


def styles(df, rules):
    out = T.color_rows(df, rules).orderBy("line_no").collect()
    return [(r.row_background, {k: v.foreground for k, v in (r.field_overrides or {}).items()}) for r in out]


def test_colour_rules(spark):
    df = rows_df(spark, [(1, "ERROR", "x"), (2, "INFO", "a timeout"), (3, "INFO", "FATAL boom"), (4, "INFO", "ok")],
                 ["Level", "Message"])
    rules = [R.Paint(R.equals("Level", "ERROR"), "#FF4444"),
             R.Paint(R.contains("TIMEOUT", R.MESSAGE), highlight="#FFFF00"),
             R.Paint(R.regex("fatal|assert"), "#8B0000")]
    assert styles(df, rules) == [("#FF4444", {}), (None, {"Message": "#FFFF00"}), ("#8B0000", {}), (None, {})]


def test_colour_priority_last_wins(spark):
    df = rows_df(spark, [(1, "ERROR")], ["Level"])
    rules = [R.Paint(R.equals("Level", "ERROR"), "#222222", priority=2),
             R.Paint(R.equals("Level", "ERROR"), "#111111", priority=1)]
    assert styles(df, rules)[0][0] == "#222222"
    same = [R.Paint(R.equals("Level", "ERROR"), "#AAAAAA", priority=1),
            R.Paint(R.equals("Level", "ERROR"), "#BBBBBB", priority=1)]
    assert styles(df, same)[0][0] == "#BBBBBB"


def test_colour_time_range(spark):
    df = rows_df(spark, [(1, "2024-01-15 10:00:00"), (2, "2024-01-15 12:00:00"), (3, "junk")], ["Timestamp"])
    rules = [R.Paint(R.between("Timestamp", "2024-01-15 09:00:00", "2024-01-15 11:00:00"), "#123456")]
    assert [s[0] for s in styles(df, rules)] == ["#123456", None, None]
    open_end = [R.Paint(R.between("Timestamp", "2024-01-15 11:00:00", None), "#654321")]
    assert [s[0] for s in styles(df, open_end)] == [None, "#654321", None]


def test_no_rules_null_and_empty(spark):
    df = rows_df(spark, [(1, "x")], ["Message"])
    assert styles(df, []) == [(None, {})]


@pytest.mark.parametrize("order,values,expected", [
    (("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"), ["info", "FATAL", "odd"], [2, 5, 6]),
    (("LOW", "HIGH"), ["high", "low", "mid"], [1, 0, 2]),
])
def test_level_rank(spark, order, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.r for r in df.select(level_rank(F.col("v"), order).alias("r")).collect()] == expected


def test_level_sort_positions(spark):
    df = rows_df(spark, [(1, "ERROR"), (2, "INFO"), (3, "weird"), (4, "INFO"), (5, "TRACE")], ["Level"])
    pos = {r.line_no: r.sort_pos for r in SO.level_positions(df, "Level", block_lines=2).collect()}
    assert pos == {5: 1, 2: 2, 4: 3, 1: 4, 3: 5}
    desc = [r.line_no for r in SO.sort_by_level(df, "Level", descending=True).collect()]
    assert desc == [3, 1, 2, 4, 5]


@pytest.mark.parametrize("name,role", [
    ("Timestamp", "Timestamp"), ("runtime", "Timestamp"), ("ts", "Timestamp"), ("lvl", "Level"),
    ("Severity", "Level"), ("msg", "Message"), ("logger", "Module"), ("tid", "Thread"), ("DeviceId", "DeviceId"),
    ("TestCase", "TestCase"), ("RunId", "RunId"), ("Result", "Result"), ("foo", "Generic"),
])
def test_guess_role(spark, name, role):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(guess_role("n").alias("r")).collect()[0].r == role


def test_suggested_names(spark):
    got = spark.range(1).select(suggested_names(11).alias("n")).collect()[0].n
    assert got[:4] == ["Timestamp", "Level", "Module", "Message"] and got[9:] == ["Field10", "Field11"]


def test_sort_field_time_restore_and_saved_state(spark):
    df = rows_df(spark, [(1, "b", "2024-01-02 00:00:00"), (2, "a", "junk"), (3, None, "2024-01-01 00:00:00")],
                 ["Name", "Timestamp"])
    assert [r.line_no for r in SO.sort_by_field(df, "Name").collect()] == [3, 2, 1]
    assert [r.line_no for r in SO.sort_by_field(df, "Line", descending=True).collect()] == [3, 2, 1]
    assert [r.line_no for r in SO.sort_by_time(df, "Timestamp").collect()] == [3, 1, 2]
    assert [r.line_no for r in SO.restore_order(SO.sort_by_field(df, "Name")).collect()] == [1, 2, 3]
    assert [r.line_no for r in SO.sort_view(df, SO.SortState("Name", True)).collect()] == [1, 2, 3]
    assert [r.line_no for r in SO.first_lines(df, 2).collect()] == [1, 2]
