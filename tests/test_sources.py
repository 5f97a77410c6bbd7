import os

import pytest

from logweave.sources import encoding as EN
from logweave.sources import files as FS
from logweave.sources import lines as L


def touch(root, rel, data=b"x\n"):
    full = os.path.join(root, rel)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as fh:
        fh.write(data)
    return full


def names(df):
    return sorted(r.name for r in df.collect())


def test_scan_root_level_and_exclusions(spark, tmpdir_path):
    for n in ["app.log", "system.log", "notes.txt", "data.csv"]:
        touch(tmpdir_path, n)
    assert names(FS.scan_workspace(spark, tmpdir_path)) == ["app.log", "system.log"]


def test_scan_recurses_and_ignores_case(spark, tmpdir_path):
    touch(tmpdir_path, "app.log")
    touch(tmpdir_path, "sub/nested.LOG")
    touch(tmpdir_path, "sub/deeper/deep.Log")
    df = FS.scan_workspace(spark, tmpdir_path)
    assert names(df) == ["app.log", "deep.Log", "nested.LOG"]
    row = [r for r in df.collect() if r.name == "deep.Log"][0]
    assert row.ext == ".Log" and row.length == 2 and row.dir.endswith("sub/deeper")


def test_scan_custom_extensions(spark, tmpdir_path):
    for n in ["a.log", "b.txt", "c.TXT", "d.csv"]:
        touch(tmpdir_path, n)
    assert names(FS.scan_workspace(spark, tmpdir_path, ["txt", " .LOG ", ".Txt", ""])) == ["a.log", "b.txt", "c.TXT"]
    assert FS.normalize_extensions(["", " "]) == [".log"]


def test_listing_in_several_frames(spark, tmpdir_path, monkeypatch):
    for i in range(7):
        touch(tmpdir_path, f"d{i % 3}/a{i}.log")
        touch(tmpdir_path, f"top{i}.log")
    monkeypatch.setattr(FS, "LISTED_FILES", 2)
    assert names(FS.scan_workspace(spark, tmpdir_path)) == [f"a{i}.log" for i in range(7)] + [f"top{i}.log" for i in range(7)]


def test_a_core_runs_one_python_worker_at_a_time(spark, tmpdir_path):
    """No step of Python feeds another one inside a stage, and nothing is sent through Python to get into the plan."""
    import re

    from logweave.operators import resolve as RS

    touch(tmpdir_path, "sub/a.log")
    lazy = FS.scan_workspace(spark, tmpdir_path)
    for df in (lazy, EN.file_heads(lazy), RS.assignments_frame(spark, {"/x": "p"}, "dir"), RS.assignments_frame(spark, {}, "dir")):
        assert "PythonRDD" not in df._jdf.toJavaRDD().toDebugString()
        above = []  # the steps a line of the plan feeds: (depth, step)
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            depth = len(re.match(r"[\s:+|*-]*", line)[0])
            above = [x for x in above if x[0] < depth]
            last = next((x[1] for x in reversed(above)), None)
            step = "Exchange" if "Exchange" in line else "MapInPandas" if "MapInPandas" in line else None
            assert not (step == last == "MapInPandas"), line
            above += [(depth, step)] if step else []
    files, scan = FS.detect_workspace(spark, tmpdir_path)
    assert "MapInPandas" not in files._jdf.queryExecution().executedPlan().toString()  # listed once
    assert [r.encoding for r in scan.encodings.collect()] == [EN.UTF8]
    rows = [("a", "p", 0), ("b/", "q", 1)]
    kept = RS.assignments_frame(spark, {"a": "p", "b/": "q"}, "dir")
    assert [tuple(r) for r in kept.collect()] == rows and kept.schema.simpleString() == "struct<dir:string,profile:string,ordinal:int>"


def test_scan_missing_root(spark):
    with pytest.raises(FS.WorkspaceNotFoundError):
        FS.scan_workspace(spark, "/nonexistent/dir/xyz")


def lines_of(spark, path, **kw):
    return [(r.line_no, r.text) for r in L.read_lines(spark, path, **kw).orderBy("line_no").collect()]


def test_line_endings_and_blank_lines(spark, tmpdir_path):
    p = touch(tmpdir_path, "m.log", b"a\n\nb\r\nc\rd")
    assert lines_of(spark, p) == [(1, "a"), (2, ""), (3, "b"), (4, "c"), (5, "d")]
    p2 = touch(tmpdir_path, "t.log", b"a\nb\nc")
    assert lines_of(spark, p2) == [(1, "a"), (2, "b"), (3, "c")]


def test_empty_file_has_no_lines(spark, tmpdir_path):
    p = touch(tmpdir_path, "e.log", b"")
    assert lines_of(spark, p) == []


def test_missing_file_raises(spark):
    with pytest.raises(L.LogFileNotFoundError):
        L.read_lines(spark, "/nonexistent/file.log")


def test_ranges_and_counts(spark, tmpdir_path):
    p = touch(tmpdir_path, "big.log", "".join(f"line {i}\n" for i in range(1, 1001)).encode())
    lines = L.read_lines(spark, p)
    got = [r.line_no for r in L.read_range(lines, 950, 5).orderBy("line_no").collect()]
    assert got == [950, 951, 952, 953, 954]
    assert L.read_range(lines, 2000, 5).count() == 0
    assert [r.line_no for r in L.read_range(lines, -3, 2).collect()] == [1, 2]
    assert L.line_counts(lines).collect()[0].line_count == 1000
    st = L.load_stats(lines, 500).collect()[0]
    assert (st.loaded, st.total_lines, st.truncated) == (500, 1000, True)


def test_numbering_exact_across_tiny_splits(spark, tmpdir_path):
    """Metamorphic: line numbers are the same with 200-byte splits as with one split."""
    texts = [f"{i}:" + "x" * (i % 37) for i in range(1, 801)]
    touch(tmpdir_path, "w1.log", ("\n".join(texts) + "\n").encode())
    touch(tmpdir_path, "w2.log", ("\r\n".join(texts[:300])).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    old_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        small = L.read_lines(spark, tmpdir_path, recursive=True, glob="*.log")
        assert small.rdd.getNumPartitions() > 10
        got = {(r.path.rsplit("/", 1)[1], r.line_no): r.text for r in small.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", old_cost)
    expect = {("w1.log", i): t for i, t in enumerate(texts, start=1)}
    expect.update({("w2.log", i): t for i, t in enumerate(texts[:300], start=1)})
    assert got == expect


def write_encoded(root):
    touch(root, "bom8.log", b"\xef\xbb\xbfhi\nthere\n")
    touch(root, "u16le.log", b"\xff\xfe" + "ab\r\ncafé\nx".encode("utf-16-le"))
    touch(root, "u16be.log", b"\xfe\xff" + "ab\ncd\n".encode("utf-16-be"))
    touch(root, "ansi.log", b"h\x93i\x94!\nplain\n")
    touch(root, "utf8.log", "café — naïve résumé\n".encode())
    touch(root, "ascii.log", b"2024-01-15 INFO hello world\n")
    # a multi-byte character straddling byte 65,536 must not make the file look like 1252
    touch(root, "edge.log", b"a" * 65535 + "é\n".encode())


def test_detect_and_decode(spark, tmpdir_path):
    write_encoded(tmpdir_path)
    files, enc, lines = FS.read_workspace(spark, tmpdir_path)
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.had_bom, r.is_fallback, r.warning is not None)
           for r in enc.collect()}
    assert got == {
        "bom8.log": (EN.UTF8_BOM, True, False, False),
        "u16le.log": (EN.UTF16LE, True, False, False),
        "u16be.log": (EN.UTF16BE, True, False, False),
        "ansi.log": (EN.ANSI, False, True, True),
        "utf8.log": (EN.UTF8, False, False, False),
        "ascii.log": (EN.UTF8, False, False, False),
        "edge.log": (EN.UTF8, False, False, False),
    }
    text = {}
    for r in lines.collect():
        text.setdefault(r.path.rsplit("/", 1)[1], {})[r.line_no] = r.text
    assert text["bom8.log"] == {1: "hi", 2: "there"}
    assert text["u16le.log"] == {1: "ab", 2: "café", 3: "x"}
    assert text["u16be.log"] == {1: "ab", 2: "cd"}
    assert text["ansi.log"] == {1: "h“i”!", 2: "plain"}
    assert text["utf8.log"] == {1: "café — naïve résumé"}


def test_forced_encoding(spark, tmpdir_path):
    touch(tmpdir_path, "ansi.log", b"h\x93i\n")
    _, enc, lines = FS.read_workspace(spark, tmpdir_path, encoding=EN.ANSI)
    assert [r.text for r in lines.collect()] == ["h“i"]


def test_utf16_detected_from_text_scan_without_direct_reads(spark, tmpdir_path, monkeypatch):
    """Storage the executors cannot open directly: the BOM still shows in the first line."""
    from pyspark.sql import functions as F
    touch(tmpdir_path, "u16le.log", b"\xff\xfe" + "ab\ncd\n".encode("utf-16-le"))
    touch(tmpdir_path, "plain.log", b"hello\n")
    monkeypatch.setattr(EN, "file_heads", lambda files: files.select("path", F.lit(None).cast("binary").alias("head")))
    files = FS.scan_workspace(spark, tmpdir_path)
    enc = EN.detect_encodings(spark, files, tmpdir_path, recursive=True, glob=FS.extension_glob(None))
    got = {r.path.rsplit("/", 1)[1]: r.encoding for r in enc.collect()}
    assert got == {"u16le.log": EN.UTF16LE, "plain.log": EN.UTF8}


def test_write_numbered_roundtrip_prunes(spark, tmpdir_path):
    p = touch(tmpdir_path, "n.log", "".join(f"l{i}\n" for i in range(1, 501)).encode())
    out = os.path.join(tmpdir_path, "numbered")
    L.write_numbered(L.read_lines(spark, p), out)
    back = spark.read.parquet(out)
    assert back.count() == 500
    rng = L.read_range(back, 100, 3)
    assert [r.text for r in rng.orderBy("line_no").collect()] == ["l100", "l101", "l102"]
    plan = rng._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "line_no" in plan


def test_rows_do_not_depend_on_settings_at_the_action(spark, tmpdir_path):
    """Splits move between building the frame and running it; every line stays."""
    n = 600_000
    p = touch(tmpdir_path, "big.log", "".join(f"{i}\n" for i in range(1, n + 1)).encode())
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[2], "1000")
        spark.conf.set(keys[0], "4")
        lines = L.read_lines(spark, p)
        for value in ("4", "6", "32"):
            spark.conf.set(keys[0], value)
            bad = lines.where("cast(text as long) <> line_no").count()
            assert (lines.count(), bad) == (n, 0)
        spark.conf.set(keys[1], "100000")
        once = L.numbered_once(spark, p)
        spark.conf.set(keys[2], "4000000")
        spark.conf.set(keys[1], "700000")
        for df in (lines, once):
            assert (df.count(), df.where("cast(text as long) <> line_no").count()) == (n, 0)
        # a split table counted over other splits is an error, not a loss
        raw = L.scan_raw(spark, p)
        spark.conf.set(keys[2], "1000")
        spark.conf.set(keys[1], "100000")
        from logweave.plans.sizing import materialize
        table = materialize(L.split_stats(raw))
        spark.conf.set(keys[1], "70000")
        with pytest.raises(Exception, match="counted over other splits"):
            L.number_from_splits(raw, table).agg({"line_no": "max"}).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["my app.log", "50%.log", "a%20b.log", "a+b.log", "a#b.log", "é ü.log", "[x]{y}.log", "q=1.log"])
def test_one_path_form_for_odd_names(spark, tmpdir_path, name):
    touch(tmpdir_path, name, b"h\x93i\n")
    touch(tmpdir_path, "w" + name, b"\xff\xfe" + "wide\nlines".encode("utf-16-le"))
    files, enc, lines = FS.read_workspace(spark, tmpdir_path)
    listed = {r.path.rsplit("/", 1)[1] for r in files.collect()}
    assert listed == {name, "w" + name}
    assert {r.path.rsplit("/", 1)[1]: r.encoding for r in enc.collect()} == {name: EN.ANSI, "w" + name: EN.UTF16LE}
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.text) for r in lines.collect())
    assert got == sorted([(name, 1, "h“i"), ("w" + name, 1, "wide"), ("w" + name, 2, "lines")])


@pytest.mark.parametrize("charset,mark", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")])
def test_utf16_breaks_only_at_even_offsets_whatever_the_ranges(spark, tmpdir_path, charset, mark):
    texts = ["ਅĀ ਊ\u0a0a", "", "naïve ✓ 🙂", "x" * 37, "\u0a00\u000b\u000a".replace("\n", ""), "last"]
    body = "".join(t + ("\r\n" if i % 2 else "\n") for i, t in enumerate(texts * 9)) + "no break at the end"
    touch(tmpdir_path, "w.log", mark + body.encode(charset))
    touch(tmpdir_path, "empty.log", mark)
    files, enc, lines = FS.read_workspace(spark, tmpdir_path)
    want = list(enumerate([*texts * 9, "no break at the end"], start=1))
    assert [(r.line_no, r.text) for r in lines.orderBy("line_no").collect()] == want
    label = EN.UTF16LE if charset == "utf-16-le" else EN.UTF16BE
    wide = enc.where("path like '%/w.log'")
    assert wide.first().encoding == label
    for size in (2, 14, 100, 1 << 20):
        got = EN.read_utf16(wide.select("path", "encoding"), range_bytes=size)
        assert [(r.line_no, r.text) for r in got.orderBy("line_no").collect()] == want


def test_empty_and_hidden_files_are_listed(spark, tmpdir_path):
    touch(tmpdir_path, "empty.log", b"")
    touch(tmpdir_path, "_hid.log")
    touch(tmpdir_path, ".dot/deep/_x.LOG", b"abc\n")
    touch(tmpdir_path, "a.log")
    touch(tmpdir_path, "b.txt")
    files, enc, lines = FS.read_workspace(spark, tmpdir_path)
    got = {r.name: (r.length, r.ext, r.modified is not None) for r in files.collect()}
    assert got == {"empty.log": (0, ".log", True), "_hid.log": (2, ".log", True), "_x.LOG": (4, ".LOG", True), "a.log": (2, ".log", True)}
    assert all(r.path.startswith("file:/") and not r.path.startswith("file://") for r in files.collect())
    assert {r.path.rsplit("/", 1)[1]: r.encoding for r in enc.collect()}["empty.log"] == EN.UTF8
    assert sorted(r.text for r in lines.collect()) == ["abc", "x", "x"]  # lines of hidden names too
