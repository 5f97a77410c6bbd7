import os
import tempfile
import time

import pytest

from logweave.plans.profile import LogProfile
from logweave.streaming import live


def append(path, data: bytes):
    with open(path, "ab") as fh:
        fh.write(data)


class Tail:
    def __init__(self, spark, path, pattern=None, name="t", **opts):
        self.spark = spark
        self.name = name + str(abs(hash((path, name))) % 10_000_000)
        ck = tempfile.mkdtemp(prefix="lw-stream-ck-")
        stream = live.tail_stream(spark, path, checkpointLocation=ck, **opts)
        numbered = live.number_lines(stream, pattern)
        self.q = (numbered.writeStream.format("memory").queryName(self.name)
                  .option("checkpointLocation", ck).outputMode("append").start())

    def step(self):
        self.q.processAllAvailable()
        return [(r.generation, r.line_no, r.text, r.event_line) for r in
                self.spark.sql(f"select * from {self.name} order by generation, line_no").collect()]

    def stop(self):
        self.q.stop()


@pytest.fixture()
def logfile(tmpdir_path):
    p = os.path.join(tmpdir_path, "app.log")
    open(p, "wb").close()
    return p


def test_append_numbering_and_no_resend(spark, logfile):
    t = Tail(spark, logfile)
    try:
        append(logfile, b"one\ntwo\n")
        assert [x[1:3] for x in t.step()] == [(1, "one"), (2, "two")]
        assert [x[1:3] for x in t.step()] == [(1, "one"), (2, "two")]
        append(logfile, b"three\n")
        assert [x[1:3] for x in t.step()] == [(1, "one"), (2, "two"), (3, "three")]
        assert live.new_entries(t.q) in (0, 1)
    finally:
        t.stop()


def test_partial_line_and_crlf_split(spark, logfile):
    t = Tail(spark, logfile)
    try:
        append(logfile, b"partial")
        assert t.step() == []
        append(logfile, b" line complete\ncrlf line\r")
        assert [x[2] for x in t.step()] == ["partial line complete"]
        append(logfile, b"\nnext line\n")
        assert [x[1:3] for x in t.step()] == [(1, "partial line complete"), (2, "crlf line"), (3, "next line")]
    finally:
        t.stop()


def test_resume_after_lines(spark, logfile):
    append(logfile, b"l1\nl2\nl3\nl4\n")
    t = Tail(spark, logfile, startingOffsets="lines:2")
    try:
        assert [x[1:3] for x in t.step()] == [(3, "l3"), (4, "l4")]
    finally:
        t.stop()


def test_truncation_resets_generation(spark, logfile):
    t = Tail(spark, logfile)
    try:
        append(logfile, b"first line here\nsecond line here\n")
        t.step()
        with open(logfile, "wb") as fh:
            fh.write(b"after reset\n")
        rows = t.step()
        assert (1, 1, "after reset") in [x[:3] for x in rows]
        assert [x[:2] for x in rows if x[0] == 0] == [(0, 1), (0, 2)]
        notices = live.reset_notices(spark.table(t.name)).collect()
        assert [(r.generation, r.reset_at_byte) for r in notices] == [(1, 0)]
    finally:
        t.stop()


def test_multiline_across_batches(spark, logfile):
    t = Tail(spark, logfile, pattern=r"^\d{4}-")
    try:
        append(logfile, b"2024-01-01 ERROR boom\n   at A.B()\n")
        t.step()
        append(logfile, b"   at C.D()\n2024-01-01 INFO ok\n")
        rows = t.step()
        assert [(x[1], x[3]) for x in rows] == [(1, 1), (2, 1), (3, 1), (4, 4)]
    finally:
        t.stop()


def test_stream_equals_batch_on_random_cuts(spark, tmpdir_path):
    import random
    from logweave.sources.lines import read_lines
    p = os.path.join(tmpdir_path, "cut.log")
    data = "".join(f"row {i} {'x' * (i % 13)}\r\n" if i % 5 == 0 else f"row {i}\n" for i in range(200)).encode()
    open(p, "wb").close()
    t = Tail(spark, p, chunkBytes=97)
    rnd = random.Random(3)
    try:
        pos = 0
        while pos < len(data):
            step = rnd.randint(1, 400)
            append(p, data[pos:pos + step])
            pos += step
            if rnd.random() < 0.5:
                t.step()
        streamed = [(x[1], x[2]) for x in t.step()]
    finally:
        t.stop()
    batch = [(r.line_no, r.text) for r in read_lines(spark, p).orderBy("line_no").collect()]
    assert streamed == batch


def test_live_rows_and_counts(spark, logfile):
    stream = live.tail_stream(spark, logfile)
    numbered = live.number_lines(stream)
    rows = live.live_rows(numbered, LogProfile.delimited("|", ["Level", "Message"]))
    counts = live.running_counts(rows)
    name = "counts" + str(abs(hash(logfile)) % 100000)
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").start()
    try:
        append(logfile, b"ERROR|disk full\nINFO|ok\nno delimiter\n")
        q.processAllAvailable()
        r = spark.sql(f"select * from {name}").collect()[0]
        assert (r.lines, r.parsed, r.fallback, r.flagged) == (3, 2, 1, 1)
    finally:
        q.stop()


def test_restart_from_checkpoint_continues(spark, logfile):
    ck = tempfile.mkdtemp(prefix="lw-stream-restart-")
    out = tempfile.mkdtemp(prefix="lw-stream-out-")

    def run_once():
        stream = live.tail_stream(spark, logfile)
        q = (live.number_lines(stream).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).outputMode("append").start())
        q.processAllAvailable()
        q.stop()

    append(logfile, b"a\nb\n")
    run_once()
    append(logfile, b"c\n")
    run_once()
    with open(logfile, "wb") as fh:  # truncated while the query is stopped
        fh.write(b"new\n")
    run_once()
    append(logfile, b"more\n")
    run_once()
    rows = sorted((r.generation, r.line_no, r.text) for r in spark.read.parquet(out).collect())
    assert rows == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "new"), (1, 2, "more")]


def test_missing_file_is_no_new_data(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "a.log")
    b = os.path.join(tmpdir_path, "b.log")
    with open(a, "wb") as fh:
        fh.write(b"a1\n")
    with open(b, "wb") as fh:
        fh.write(b"b1\n")
    t = Tail(spark, tmpdir_path, name="dir")
    try:
        assert len(t.step()) == 2
        os.remove(b)
        append(a, b"a2\n")
        rows = t.step()
        assert sorted(x[2] for x in rows) == ["a1", "a2", "b1"]
    finally:
        t.stop()


class Events:
    """Folded events of a tail as (event line, part, text, continuation texts, sent by)."""

    def __init__(self, spark, path, pattern, quiet=600.0, part_lines=10_000, ck=None):
        self.spark, ck = spark, ck or tempfile.mkdtemp(prefix="lw-events-ck-")
        folded = live.fold_events(live.tail_stream(spark, path, checkpointLocation=ck), pattern, quiet, part_lines)
        self.out, self.read = ck + "-out", {}
        self.q = (folded.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", ck).outputMode("append")
                  .trigger(processingTime="100 milliseconds").start())

    def rows(self):
        if not os.path.isdir(f"{self.out}/_spark_metadata"):
            return []
        got = self.spark.read.schema(live.EVENT_SCHEMA).parquet(self.out).orderBy("path", "generation", "event_line", "part").collect()
        return [(r.event_line, r.part, r.text, [c.text for c in r.continuation], r.sent_by) for r in got]

    def after(self, lines, seconds=40):
        """The events sent once so many lines have been read (a query with timers never says it is idle)."""
        for _ in range(seconds * 5):
            self.read.update({p["batchId"]: p["numInputRows"] for p in self.q.recentProgress})
            if sum(self.read.values()) >= lines:
                return self.rows()
            assert self.q.exception() is None
            time.sleep(0.2)
        raise TimeoutError(f"{sum(self.read.values())} lines of {lines}")

    def wait(self, n, seconds=40):
        for _ in range(seconds * 4):
            if len(self.rows()) >= n:
                break
            time.sleep(0.25)
        return self.rows()

    def stop(self):
        self.q.stop()


def test_events_are_sent_whole_when_the_next_begins(spark, logfile):
    t = Events(spark, logfile, r"^\d")
    try:
        append(logfile, b"1 a\n  at x\n")
        assert t.after(2) == []
        append(logfile, b"  at y\n2 b\n3 c\n  at z\n")
        assert t.after(6) == [(1, 0, "1 a", ["  at x", "  at y"], "next"), (4, 0, "2 b", [], "next")]
        with open(logfile, "wb") as fh:
            fh.write(b"9 z\n8 y\n")
        got = t.after(8)
        assert (5, 0, "3 c", ["  at z"], "reset") in got and (1, 0, "9 z", [], "next") in got and len(got) == 4
    finally:
        t.stop()


def test_events_by_timer_and_late_continuations(spark, logfile):
    t = Events(spark, logfile, r"^\d", quiet=1.0)
    try:
        append(logfile, b"1 a\n  at x\n")
        assert t.wait(1) == [(1, 0, "1 a", ["  at x"], "quiet")]
        append(logfile, b"  late\n")
        assert t.wait(2)[1:] == [(1, 1, None, ["  late"], "quiet")]
        append(logfile, b"2 b\n  at y\n3 c\n")
        assert t.wait(4)[2:] == [(4, 0, "2 b", ["  at y"], "next"), (6, 0, "3 c", [], "quiet")]
    finally:
        t.stop()


def test_events_over_a_restart(spark, logfile):
    ck = tempfile.mkdtemp(prefix="lw-events-restart-")
    for data in (b"1 a\n  at x\n", b"  at y\n", b"2 b\n"):
        append(logfile, data)
        t = Events(spark, logfile, r"^\d", ck=ck)
        got = t.after(data.count(b"\n"))
        t.stop()
    assert got == [(1, 0, "1 a", ["  at x", "  at y"], "next")]


def test_endless_event_in_parts(spark, logfile):
    t = Events(spark, logfile, r"^H", part_lines=10)
    try:
        for k in range(5):
            append(logfile, "".join(f"line {k * 7 + i}\n" for i in range(7)).encode())
            t.after(7 * k + 7)
        append(logfile, b"H next\nH last\n")
        got = t.after(37)
    finally:
        t.stop()
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (36, 0)]
    assert [x for g in got[:4] for x in ([g[2]] if g[2] else []) + g[3]] == [f"line {i}" for i in range(35)]


def test_event_stream_equals_batch_on_random_cuts(spark, tmpdir_path):
    """Two folders with two profiles, three encodings, a file that appears late: the same events as a batch."""
    import random
    from logweave.plans.workspace import open_workspace
    from logweave.sources.config import Settings
    rnd = random.Random(5)
    profiles = [LogProfile.delimited("|", ["Time", "Level", "Message"]).using(name="pipes", new_event=r"^\d\d:"),
                LogProfile.regex(r"^(?<Level>[A-Z]+) (?<Message>.*)$").using(name="words", new_event=r"^[A-Z]+ ")]
    for sub in ("p/deep", "w", "none"):
        os.makedirs(os.path.join(tmpdir_path, sub))
    settings = Settings(dir_assignments={os.path.join(tmpdir_path, "p"): "pipes", os.path.join(tmpdir_path, "w"): "words"})
    pipes = "".join(rnd.choice([f"1{i % 10}:00|ERROR|é {i}\n", "   at X\r\n", f"2{i % 4}:11|INFO|ok {i}\n"]) for i in range(80))
    words = "".join(rnd.choice([f"WARN w{i}\n", "\tat Y\n", "lower\n"]) for i in range(80))
    data = {"p/deep/a.log": pipes.encode(), "w/b.LOG": b"\xff\xfe" + words.encode("utf-16-le"), "none/c.log": b"plain\n" * 9,
            "p/late.log": pipes.encode("cp1252"), "w/ignored.txt": b"WARN no\n"}
    ck, out = tempfile.mkdtemp(prefix="lw-ws-ck-"), tempfile.mkdtemp(prefix="lw-ws-out-")
    stream = live.workspace_events(spark, tmpdir_path, settings, profiles, quiet_seconds=1.0, checkpointLocation=ck)
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .trigger(processingTime="200 milliseconds").start())
    try:
        at = dict.fromkeys(data, 0)
        while any(at[p] < len(d) for p, d in data.items()):
            for p, d in data.items():
                if p == "p/late.log" and at["none/c.log"] < 30:
                    continue
                append(os.path.join(tmpdir_path, p), d[at[p]:at[p] + (cut := rnd.randint(1, 900))])
                at[p] += cut
            time.sleep(rnd.random() * 0.3)
        ws = open_workspace(spark, tmpdir_path, settings, profiles, detect_unresolved=False)
        batch = {}
        for r in ws.rows.orderBy("path", "line_no").collect():
            key = (os.path.relpath(r.path.removeprefix("file:"), tmpdir_path), r.event_line)
            if r.is_primary:
                batch[key] = [r.raw, r.profile, r.is_parsed, r.fields, r.is_flagged, []]
            else:
                batch[key][-1].append(r.raw)
        for _ in range(120):
            got = {}
            if any(f.endswith(".parquet") for f in os.listdir(out)):
                for r in spark.read.parquet(out).orderBy("path", "event_line", "part").collect():
                    key = (os.path.relpath(r.path.removeprefix("file:"), tmpdir_path), r.event_line)
                    if r.part == 0:
                        got[key] = [r.raw, r.profile, r.is_parsed, r.fields, r.is_flagged, []]
                    got[key][-1].extend(c.text for c in r.continuation)
            if len(got) == len(batch):
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == batch


def test_profiles_read_anew_for_each_batch(spark, logfile):
    from logweave.sources.config import Settings
    now = {"profiles": [LogProfile.delimited("|", ["Level", "Message"]).using(name="p")]}
    settings = Settings(dir_assignments={os.path.dirname(logfile): "p"})
    ck, seen = tempfile.mkdtemp(prefix="lw-each-"), []
    q = live.each_batch(live.number_lines(live.tail_stream(spark, logfile, checkpointLocation=ck)), lambda: (settings, now["profiles"]),
                        lambda rows, _: seen.extend((r.line_no, r.fields) for r in rows.collect())).option("checkpointLocation", ck).start()
    try:
        append(logfile, b"ERROR|disk\n")
        q.processAllAvailable()
        now["profiles"] = [LogProfile.delimited("|", ["Severity", "Text"]).using(name="p")]
        append(logfile, b"INFO|ok\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [(1, {"Level": "ERROR", "Message": "disk"}), (2, {"Severity": "INFO", "Text": "ok"})]


@pytest.mark.parametrize("charset,mark", [("utf-8", b""), ("utf-16-le", b"\xff\xfe")])
def test_latest_numbers_from_the_physical_line(spark, logfile, charset, mark):
    append(logfile, mark + "".join(f"old {i} ਊ\n" for i in range(1, 101)).encode(charset) + "begun".encode(charset))
    ck, out = tempfile.mkdtemp(prefix="lw-latest-"), "latest" + charset.replace("-", "")
    for opts in ({"checkpointLocation": ck}, {}):
        t = Tail(spark, logfile, name=out + str(len(opts)), startingOffsets="latest", chunkBytes=101, **({} if opts else {"glob": "*.log"}))
        try:
            assert t.step() == []
            before = os.path.getsize(logfile)
            append(logfile, " done\nnew\n".encode(charset))
            got = t.step()
            n = 101 if opts else 103
            assert [x[1:3] for x in got] == ([(n, "begun done"), (n + 1, "new")] if opts else [(n, " done"), (n + 1, "new")])
            assert os.path.getsize(logfile) > before
        finally:
            t.stop()


def test_replaced_by_as_many_bytes(spark, logfile):
    t = Tail(spark, logfile, name="same")
    try:
        append(logfile, b"first line\nsecond line\n")
        t.step()
        with open(logfile, "wb") as fh:
            fh.write(b"other line\nanother one\n" + b"longer\n")
        got = t.step()
        assert [x[:3] for x in got if x[0] == 1] == [(1, 1, "other line"), (1, 2, "another one"), (1, 3, "longer")]
        with open(logfile, "r+b") as fh:
            fh.write(b"OTHER LINE\nANOTHER ONE\nLONGER\n")
        os.utime(logfile)
        got = t.step()
        assert [x[:3] for x in got if x[0] == 2] == [(2, 1, "OTHER LINE"), (2, 2, "ANOTHER ONE"), (2, 3, "LONGER")]
    finally:
        t.stop()


def test_idle_files_cost_nothing(tmpdir_path):
    """Of thousands of idle files none is looked at and an offset is one number; the growing one is one entry."""
    from logweave.streaming import positions as P
    from logweave.streaming.tail import TailStreamReader
    long_ago = time.time() - 3600
    for d in range(20):
        os.makedirs(os.path.join(tmpdir_path, f"d{d}"))
        for i in range(250):
            p = os.path.join(tmpdir_path, f"d{d}", f"{i}.log")
            with open(p, "wb") as fh:
                fh.write(b"idle\n")
            os.utime(p, (long_ago, long_ago))
        os.utime(os.path.join(tmpdir_path, f"d{d}"), (long_ago, long_ago))
    os.utime(tmpdir_path, (long_ago, long_ago))
    hot = os.path.join(tmpdir_path, "d3", "7.log")
    ck = tempfile.mkdtemp(prefix="lw-idle-")
    reader = TailStreamReader({"path": tmpdir_path, "checkpointLocation": ck, "idlePerTrigger": "0"})
    assert reader.initialOffset() == {"seq": 0}
    assert reader.latestOffset() == {"seq": 1}
    assert len(reader.partitions({"seq": 0}, {"seq": 1})) == 5000
    reader.folders.grew.clear()
    reader.folders.saw_growth(hot)
    append(hot, b"more\n")
    assert reader.latestOffset() == {"seq": 2}
    assert (reader.folders.listed, reader.folders.looked) == (0, 1)
    assert [(p.path, p.start, p.end) for p in reader.partitions({"seq": 1}, {"seq": 2})] == [(hot, 5, 10)]
    assert len(reader.log.between(1, 2)[0]) == 1
    assert reader.latestOffset() == {"seq": 2}
    new = os.path.join(tmpdir_path, "d4", "new.log")
    append(new, b"born\n")
    assert reader.latestOffset() == {"seq": 3} and reader.folders.listed == 1
    again = TailStreamReader({"path": tmpdir_path, "checkpointLocation": ck, "idlePerTrigger": "0"})
    assert again.latestOffset() == {"seq": 3} and len(again.log.positions) == 5001
    assert [p.path for p in again.partitions({"seq": 2}, {"seq": 3})] == [new]
    rotating = P.Folders(tmpdir_path, ["*.log"], 100)
    rotating.poll()
    rotating.grew.clear()
    seen = set()
    for _ in range(51):
        seen |= set(rotating.poll())
    assert len(seen) == 5001


def test_log_of_positions_is_kept_short(tmpdir_path, monkeypatch):
    from logweave.streaming import positions as P
    monkeypatch.setattr(P, "TABLE_EVERY", 5)
    monkeypatch.setattr(P, "KEEP_ENTRIES", 7)
    log = P.PositionLog(os.path.join(tmpdir_path, "log"))
    log.begin({"z": {"to": 0}})
    for k in range(40):
        log.append({f"f{k % 4}": {"to": k}})
        log.forget(log.seq)
    files = os.listdir(os.path.join(tmpdir_path, "log"))
    assert len(files) < 20 and not any(f.endswith(".part") for f in files)
    again = P.PositionLog(log.folder)
    again.load()
    assert (again.seq, again.positions) == (40, log.positions) and again.positions["z"] == {"to": 0}
    assert again.between(38, 40) == [{"f2": {"to": 38}}, {"f3": {"to": 39}}]


def test_globs_and_extensions(tmpdir_path):
    from logweave.streaming.tail import TailStreamReader
    for p in ("a.log", "sub/b.log", "sub/c.TXT", "sub/deep/d.log", ".x.log", "_y.log"):
        os.makedirs(os.path.dirname(os.path.join(tmpdir_path, p)), exist_ok=True)
        append(os.path.join(tmpdir_path, p), b"x\n")

    def found(**options):
        reader = TailStreamReader({"path": tmpdir_path, **options})
        return sorted(os.path.relpath(p, tmpdir_path) for p in reader.latestOffset()["files"])

    assert found() == [".x.log", "_y.log", "a.log", "sub/b.log", "sub/deep/d.log"]
    assert found(extensions=".txt, .log") == [".x.log", "_y.log", "a.log", "sub/b.log", "sub/c.TXT", "sub/deep/d.log"]
    assert found(path=f"{tmpdir_path}/sub/*.log") == ["sub/b.log"]
    assert found(path=f"{tmpdir_path}/**/*.log") == [".x.log", "_y.log", "a.log", "sub/b.log", "sub/deep/d.log"]
    assert found(path=f"{tmpdir_path}/a.log", glob="*.none") == ["a.log"]
    with pytest.raises(ValueError):
        TailStreamReader({"path": tmpdir_path, "startingOffsets": "lines:x"})


def test_level_counts_over_event_time(spark, logfile):
    ck = tempfile.mkdtemp(prefix="lw-levels-")
    rows = live.live_rows(live.number_lines(live.tail_stream(spark, logfile, checkpointLocation=ck)), LogProfile.delimited("|", ["Time", "Level"]))
    counts = live.level_counts(rows, rows["Time"], rows["Level"], "1 minute", "2 minutes")
    name = "levels" + str(abs(hash(logfile)) % 100000)
    q = counts.writeStream.format("memory").queryName(name).option("checkpointLocation", ck).outputMode("append").start()
    try:
        for data in (b"2024-01-01 10:00:05|ERROR\n2024-01-01 10:00:10|INFO\nno time|INFO\n", b"2024-01-01 10:01:59|INFO\n",
                     b"2024-01-01 10:00:59|ERROR\n",  # late, within the two minutes
                     b"2024-01-01 10:09:00|INFO\n", b"2024-01-01 10:00:01|ERROR\n2024-01-01 10:09:30|INFO\n"):
            append(logfile, data)
            q.processAllAvailable()
        got = {(r.level, str(r.window_start)[11:16]): r.rows for r in spark.table(name).collect()}
        late = live.late_rows(q)
    finally:
        q.stop()
    assert got == {("ERROR", "10:00"): 2, ("INFO", "10:00"): 1, ("INFO", "10:01"): 1}
    assert late == 1


def test_workspace_files_discovers_new_files(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "first.log"), "wb") as fh:
        fh.write(b"x\n")
    name = "ws" + str(abs(hash(tmpdir_path)) % 100000)
    q = live.workspace_files(spark, tmpdir_path).writeStream.format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        os.makedirs(os.path.join(tmpdir_path, "sub"))
        with open(os.path.join(tmpdir_path, "sub", "second.LOG"), "wb") as fh:
            fh.write(b"y\nz\n")
        with open(os.path.join(tmpdir_path, "ignored.txt"), "wb") as fh:
            fh.write(b"no\n")
        q.processAllAvailable()
        got = sorted((r.path.rsplit("/", 1)[1], r.text) for r in spark.sql(f"select * from {name}").collect())
        assert got == [("first.log", "x"), ("second.LOG", "y"), ("second.LOG", "z")]
    finally:
        q.stop()


def test_long_lines_across_small_ranges(spark, logfile):
    long_line = b"x" * 700
    append(logfile, b"short\n" + long_line + b"\nend\n")
    t = Tail(spark, logfile, chunkBytes=64, maxLineBytes=50)
    try:
        assert [(x[1], len(x[2])) for x in t.step()] == [(1, 5), (2, 700), (3, 3)]
    finally:
        t.stop()


def test_backlog_in_bounded_batches_equals_batch(spark, logfile):
    """A backlog many times the bound: no micro-batch holds more of a file, results as in batch."""
    from logweave.sources.lines import read_lines
    append(logfile, "".join(f"{'H' if i % 7 == 0 else ' '} row {i} {'x' * (i % 29)}\n" for i in range(1500)).encode())
    size = os.path.getsize(logfile)
    t = Tail(spark, logfile, pattern="^H", maxBytesPerTrigger=2000, chunkBytes=700)
    try:
        got = t.step()
        batches = [p for p in t.q.recentProgress if p["numInputRows"] > 0]
        assert len(batches) >= size // 2000
        assert max(p["numInputRows"] for p in batches) <= 2000 // 8
    finally:
        t.stop()
    want = [(r.line_no, r.text) for r in read_lines(spark, logfile).orderBy("line_no").collect()]
    assert [(x[1], x[2]) for x in got] == want
    assert [x[3] for x in got] == [1 + (i - i % 7) for i in range(1500)]


@pytest.mark.parametrize("mark,charset", [(b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")])
def test_utf16_tail(spark, logfile, mark, charset):
    texts = ["first ✓", "ਅĀ odd bytes ਊ", "", "naïve", "x" * 90]
    data = mark + "".join(t + ("\r\n" if i % 2 else "\n") for i, t in enumerate(texts)).encode(charset)
    t = Tail(spark, logfile, chunkBytes=11, maxLineBytes=7)
    try:
        for cut in (5, 18, 33, len(data)):
            append(logfile, data[os.path.getsize(logfile):cut])
            got = t.step()
        assert [x[1:3] for x in got] == list(enumerate(texts, start=1))
    finally:
        t.stop()


def test_lines_that_are_not_utf8_read_as_ansi(spark, logfile):
    t = Tail(spark, logfile)
    try:
        append(logfile, b"h\x93i\x94\n" + "é\n".encode())
        assert [x[2] for x in t.step()] == ["h“i”", "é"]
    finally:
        t.stop()
