import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="logweave-tests", shuffle_partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lw-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lw-test-")


def lines_df(spark, texts, path="a.log"):
    return spark.createDataFrame([(path, i + 1, t) for i, t in enumerate(texts)], "path string, line_no long, text string")


def rows_df(spark, rows, columns):
    """rows: list of tuples (line_no, *values); columns: field names."""
    schema = "path string, line_no long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([("a.log", *r) for r in rows], schema)
