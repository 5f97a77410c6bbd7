"""Line ranges by the sparse table against the numbered lines."""

import os

import pytest

from logweave.sources import lineindex as LI
from logweave.sources.files import detect_workspace
from logweave.sources.lines import read_range


@pytest.fixture()
def workspace(spark, tmpdir_path):
    rows = [f"row {i} é {'x' * (i % 37)}" for i in range(900)]
    data = {"a.log": "\n".join(rows).encode(), "crlf.log": "\r\n".join(rows).encode() + b"\r\n", "ansi.log": "\n".join(rows).encode("cp1252"),
            "wide.log": b"\xff\xfe" + "\n".join(rows).encode("utf-16-le"), "empty.log": b"", "one.log": b"x", "_hid.log": b"h\rj\n"}
    for name, body in data.items():
        with open(os.path.join(tmpdir_path, name), "wb") as fh:
            fh.write(body)
    files, scan = detect_workspace(spark, tmpdir_path)
    return files.join(scan.encodings.select("path", "encoding"), "path"), scan.lines().cache(), tmpdir_path


def test_ranges_equal_the_numbered_lines(spark, workspace):
    files, lines, root = workspace
    index = LI.build_index(files, 200).cache()
    key = lambda df: sorted(map(tuple, df.collect()))
    for start, count in ((1, 5), (-3, 2), (450, 60), (899, 10), (901, 4), (1, 10_000), (7, 0)):
        assert key(LI.read_lines_at(index, start, count)) == key(read_range(lines, start, count).select("path", "line_no", "text"))
    per_file = {r.path.rsplit("/", 1)[-1]: r["count"] for r in index.groupBy("path").count().collect()}
    assert per_file["a.log"] > 100
    touched = LI.ranges_of(index, 450, 1).groupBy("path").count().collect()
    assert touched and max(r["count"] for r in touched) == 1  # one range a file is read


def test_index_is_stored_and_shorter_files_are_told(spark, workspace):
    files, _, root = workspace
    where = os.path.join(root, "index.parquet")
    LI.build_index(files, 1000).write.parquet(where)
    index = spark.read.parquet(where)
    with open(os.path.join(root, "a.log"), "ab") as fh:
        fh.write(b"\nnew")
    assert LI.read_lines_at(index, 10, 3).where("path like '%/a.log'").count() == 3
    with open(os.path.join(root, "one.log"), "wb"):
        pass
    with pytest.raises(Exception, match="shorter than when it was indexed"):
        LI.read_lines_at(index, 1, 1).collect()
