import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_every_log_query_has_an_oracle():
    assert set(E.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["path", "shown", "total", "parsed", "fallback", "flagged"]


def test_queries_run_on_smallest_tables(spark):
    for name in ["flag_counts", "events_multiline", "align_nearest", "profile_resolve"]:
        assert E.queries()[name](spark, E.SMOKE_DIR).count() >= 0
