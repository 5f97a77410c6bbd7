import os

from logweave.plans.profile import LogProfile
from logweave.plans.workspace import open_workspace
from logweave.sources.config import Settings


def touch(root, rel, data):
    full = os.path.join(root, rel)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as fh:
        fh.write(data)


def test_open_workspace_end_to_end(spark, tmpdir_path):
    touch(tmpdir_path, "app/server.log",
          b"2024-01-15 10:00:00|ERROR|Auth|Login failed\n   at A.B()\n2024-01-15 10:00:01|INFO|Auth|ok\n")
    touch(tmpdir_path, "other/data.log", b"a,b,c\nd,e,f\n")
    touch(tmpdir_path, "other/free.log", b"just words here\nno delimiters\n")
    prof = LogProfile.delimited("|", ["Timestamp", "Level", "Module", "Message"], name="pipes") \
        .using(new_event=r"^\d{4}-")
    settings = Settings(dir_assignments={os.path.join(tmpdir_path, "app"): "pipes"})
    ws = open_workspace(spark, tmpdir_path, settings, [prof])
    rows = {(r.path.rsplit("/", 1)[1], r.line_no): r for r in ws.rows.collect()}
    srv1 = rows[("server.log", 1)]
    assert srv1.profile == "pipes" and srv1.fields["Level"] == "ERROR" and srv1.is_flagged
    assert srv1.row_background == "#5A1F1F"
    assert rows[("server.log", 2)].event_line == 1 and not rows[("server.log", 2)].is_parsed
    assert rows[("data.log", 1)].profile == "(detected)" and dict(rows[("data.log", 1)].fields) == {
        "Timestamp": "a", "Level": "b", "Module": "c"}
    assert rows[("free.log", 1)].profile is None and dict(rows[("free.log", 1)].fields) == {"RawText": "just words here"}
    status = {(r.path or "").rsplit("/", 1)[-1]: (r.total, r.parsed, r.fallback, r.flagged) for r in ws.status.collect()}
    assert status["server.log"] == (3, 2, 1, 1) and status[""] == (7, 6, 1, 1)
    from logweave.plans.rules import ViewFilter
    ws2 = open_workspace(spark, tmpdir_path, settings, [prof], view=ViewFilter(text="auth"))
    shown = {(r.path or "").rsplit("/", 1)[-1]: r.shown for r in ws2.status.collect()}
    assert shown["server.log"] == 2 and shown["data.log"] == 0


def test_open_single_file_with_forced_encoding(spark, tmpdir_path):
    from logweave.sources.files import read_workspace
    touch(tmpdir_path, "one.txt", b"h\x93i\nplain\n")
    files, enc, lines = read_workspace(spark, os.path.join(tmpdir_path, "one.txt"), encoding="Windows-1252 (ANSI)")
    assert files.count() == 1
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["h“i", "plain"]
    _f, enc2, lines2 = read_workspace(spark, os.path.join(tmpdir_path, "one.txt"))
    assert enc2.collect()[0].encoding == "Windows-1252 (ANSI)" and lines2.count() == 2


def test_status_says_profile_and_truncation_and_no_text_is_shuffled(spark, tmpdir_path):
    touch(tmpdir_path, "a/x.log", b"1|INFO\n2|WARN\n3|ERROR\n")
    touch(tmpdir_path, "b/y.log", b"1,2\n3,4\n")
    touch(tmpdir_path, "b/wide.log", b"\xff\xfe" + "p,q\nr,s\nt,u\nv,w".encode("utf-16-le"))
    touch(tmpdir_path, "b/z.log", b"words\n")
    prof = LogProfile.delimited("|", ["N", "Level"], name="pipes")
    ws = open_workspace(spark, tmpdir_path, Settings(dir_assignments={os.path.join(tmpdir_path, "a"): "pipes"}), [prof], line_cap=2)
    got = {(r.path or "").rsplit("/", 1)[-1]: (r.total, r.profile, r.truncated, r.encoding) for r in ws.status.collect()}
    assert got == {"x.log": (2, "pipes", True, "UTF-8"), "y.log": (2, "(detected)", False, "UTF-8"), "z.log": (1, None, False, "UTF-8"),
                   "wide.log": (2, "(detected)", True, "UTF-16 LE"), "": (7, None, None, None)}
    wide = {r.line_no: dict(r.fields) for r in ws.rows.where("path like '%wide.log'").collect()}
    assert wide == {1: {"Timestamp": "p", "Level": "q"}, 2: {"Timestamp": "r", "Level": "s"}}
    assert ws.lines.count() == 10  # the whole files
    plan = ws.lines._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("Exchange hashpartitioning" in line and "text" in line)


def test_formats_are_detected_on_whole_files(spark, tmpdir_path):
    from logweave.operators.detect import SAMPLE_LINES
    touch(tmpdir_path, "changes.log", b"a,b\n" * SAMPLE_LINES + b"p|q\n")
    for sample_lines, want in ((None, None), (SAMPLE_LINES, "(detected)")):  # a delimiter counts when every line has it
        ws = open_workspace(spark, tmpdir_path, sample_lines=sample_lines)
        assert [r.profile for r in ws.profiles.collect()] == [want]


def test_intermediates_can_be_removed(spark):
    from logweave.plans import sizing
    df = sizing.materialize(spark.range(3))
    assert df.count() == 3
    assert sizing.remove_intermediates(spark) >= 1 and sizing.remove_intermediates(spark) == 0


def test_hidden_names_empty_files_and_utf16_counts(spark, tmpdir_path):
    """Lines of files that Spark's reader hides, status of files without lines, and truncation of decoded lines."""
    body = "ERROR one\r\ntwo é\rthree\n\nlast".encode()
    ansi = b"caf\xe9\nplain\n"
    wide = b"\xff\xfe" + "".join(f"row {i}\r\n" for i in range(60)).encode("utf-16-le")
    os.makedirs(os.path.join(tmpdir_path, "_dir"))
    files = {"x.log": body, "_x.log": body, ".y.log": body, "_dir/z.log": body, "_a.log": ansi, "empty.log": b"", "_none.log": b"", "_bom.log": b"\xef\xbb\xbfhi\n",
             "w.log": wide, "_w.log": wide}
    for name, data in files.items():
        with open(os.path.join(tmpdir_path, name), "wb") as fh:
            fh.write(data)
    ws = open_workspace(spark, tmpdir_path, line_cap=100)
    got = {}
    for r in ws.lines.orderBy("path", "line_no").collect():
        got.setdefault(os.path.relpath(r.path.removeprefix("file:"), tmpdir_path), []).append((r.line_no, r.text))
    want = list(enumerate(["ERROR one", "two é", "three", "", "last"], start=1))
    assert got["x.log"] == want and all(got[n] == want for n in ("_x.log", ".y.log", "_dir/z.log"))
    assert got["_a.log"] == [(1, "café"), (2, "plain")] and got["_bom.log"] == [(1, "hi")]
    assert got["_w.log"] == got["w.log"] == [(i + 1, f"row {i}") for i in range(60)]
    status = {os.path.relpath(r.path.removeprefix("file:"), tmpdir_path): r for r in ws.status.where("path is not null").collect()}
    assert set(status) == set(files)
    assert [(status[n].total, status[n].flagged, status[n].truncated) for n in ("_x.log", "empty.log", "_none.log", "w.log")] == [
        (5, 1, False), (0, 0, False), (0, 0, False), (60, 0, False)]
    assert status["_a.log"].encoding == "Windows-1252" or "1252" in status["_a.log"].encoding
    total = ws.status.where("path is null").first()
    assert total.total == sum(r.total for r in status.values())
    cut = {os.path.relpath(r.path.removeprefix("file:"), tmpdir_path): r.truncated for r in open_workspace(spark, tmpdir_path, line_cap=59).status.where("path is not null").collect()}
    assert {n for n, t in cut.items() if t} == {"w.log", "_w.log"}


def test_ranges_own_the_lines_that_begin_in_them(tmpdir_path):
    import random
    import re
    from logweave.sources.encoding import _range_lines
    rnd = random.Random(4)
    p = os.path.join(tmpdir_path, "_r.log")
    for trial in range(60):
        data = b"".join(rnd.choice([b"a", b"bc", b"\r", b"\n", b"\r\n", b"\xc3\xa9" * 9]) for _ in range(rnd.randint(1, 60)))
        with open(p, "wb") as fh:
            fh.write(data)
        want = re.split(b"\r\n|\n|\r", data)
        want = want[:-1] if want[-1] == b"" else want
        for size in (1, 2, 3, 7, 1000):
            got = [x for s in range(0, len(data), size) for x in _range_lines(p, s, min(s + size, len(data)), len(data), step=rnd.choice([1, 3, 50]))]
            assert got == want, (data, size)
