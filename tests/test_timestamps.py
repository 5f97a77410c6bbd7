import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.functions.timestamps import parse_bound, parse_timestamp


@pytest.mark.parametrize("text,expected", [
    ("2024-01-15 10:32:39", dt.datetime(2024, 1, 15, 10, 32, 39)),
    ("2024-01-15 10:32:39.123", dt.datetime(2024, 1, 15, 10, 32, 39, 123000)),
    ("2024-01-15 10:32:39,123", dt.datetime(2024, 1, 15, 10, 32, 39, 123000)),
    ("2024-01-15T10:32:39", dt.datetime(2024, 1, 15, 10, 32, 39)),
    ("2024-01-15T10:32:39.5", dt.datetime(2024, 1, 15, 10, 32, 39, 500000)),
    ("10:32:39", dt.datetime(1970, 1, 1, 10, 32, 39)),
    ("01/15/2024 10:32:39", dt.datetime(2024, 1, 15, 10, 32, 39)),
    ("20171223-22:15:29:606", dt.datetime(2017, 12, 23, 22, 15, 29, 606000)),
    ("2024/01/15 10:32:39", dt.datetime(2024, 1, 15, 10, 32, 39)),
    ("  2024-01-15 10:32:39  ", dt.datetime(2024, 1, 15, 10, 32, 39)),
    ("2024-01-15", dt.datetime(2024, 1, 15)),
    ("Jan 15 2024 10:32:39", dt.datetime(2024, 1, 15, 10, 32, 39)),
    ("15 January 2024 10:32", dt.datetime(2024, 1, 15, 10, 32)),
    ("1/5/2024 9:03:04 AM", dt.datetime(2024, 1, 5, 9, 3, 4)),
    ("1/5/2024 12:03:04 am", dt.datetime(2024, 1, 5, 0, 3, 4)),
    ("Mon, 15 Jan 2024 10:32:39 GMT", dt.datetime(2024, 1, 15, 10, 32, 39)),
    ("15-Jan-2024 12:05 pm", dt.datetime(2024, 1, 15, 12, 5)),
    ("Dec 5, 2024", dt.datetime(2024, 12, 5)),
    ("13/40/2024 1:01", None),
    ("Foo 1 2024 10:00", None),
    ("anf 1 2024 10:00", None),
    ("Jan 5 2024 13:00 PM", None),
    ("not a time", None),
    ("", None),
    (None, None),
    ("10:32", dt.datetime(1970, 1, 1, 10, 32)),
    ("7:05", dt.datetime(1970, 1, 1, 7, 5)),
    ("25:00", None),
    ("Jan 15 10:32:39", dt.datetime(1970, 1, 15, 10, 32, 39)),
    ("Feb  3 07:02:01.5", dt.datetime(1970, 2, 3, 7, 2, 1, 500000)),
    ("Foo 15 10:32:39", None),
    ("Feb 30 10:32:39", None),
])
def test_parse_timestamp(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(parse_timestamp(F.col("s")).alias("t")).collect()[0].t == expected
    assert parse_bound(text) == expected  # the same forms for the user's bounds


def test_time_only_base_date(spark):
    df = spark.createDataFrame([("10:00:00",)], "s string")
    got = df.select(parse_timestamp("s", base_date="2024-02-03").alias("t")).collect()[0].t
    assert got == dt.datetime(2024, 2, 3, 10)


def test_parse_bound():
    assert parse_bound("2024-01-15 10:02") == dt.datetime(2024, 1, 15, 10, 2)
    assert parse_bound("garbage") is None and parse_bound("") is None


def test_time_only_range_filters_a_time_only_log(spark):
    from logweave.operators import filters as FL
    from logweave.operators import parse as PA
    from tests.conftest import lines_df
    rows = PA.parse_delimited(lines_df(spark, [f"{h:02}:30:00|x" for h in range(24)]), "|", ["Time", "Message"])
    got = FL.time_range(rows, "Time", "10:00:00", "12:00:00")
    assert sorted(r.Time for r in got.collect()) == ["10:30:00", "11:30:00"]


def test_bound_with_another_base_date():
    assert parse_bound("10:00", "2024-02-03") == dt.datetime(2024, 2, 3, 10)
