import os

from logweave.sources import fsio


def test_fsio_local_paths_and_uris(tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    for rel, data in [("a.log", b"hello\n"), ("sub/B.LOG", b"x"), ("c.txt", b"no")]:
        with open(os.path.join(tmpdir_path, rel), "wb") as fh:
            fh.write(data)
    names = [p.rsplit("/", 1)[1] for p in fsio.list_files(tmpdir_path, "*.log")]
    assert names == ["a.log", "B.LOG"] or sorted(names) == ["B.LOG", "a.log"]
    a = os.path.join(tmpdir_path, "a.log")
    assert fsio.size(a) == 6 and fsio.size("file:" + a) == 6
    assert fsio.read("file://" + a, 1, 3) == b"ell"
    assert fsio.size(os.path.join(tmpdir_path, "missing.log")) is None
    assert fsio.list_files(os.path.join(tmpdir_path, "missing"), "*.log") == []
    assert fsio.list_files(a, "*.txt") == [a]


def test_entries_come_folder_by_folder(tmpdir_path, monkeypatch):
    """A tree of many folders is listed as it is asked for, not gathered first."""
    for i in range(20):
        os.makedirs(os.path.join(tmpdir_path, f"d{i}", "e"))
        for rel in (f"d{i}/a.log", f"d{i}/e/b.log"):
            with open(os.path.join(tmpdir_path, rel), "wb") as fh:
                fh.write(b"hello\n")
    found = fsio.entries(tmpdir_path, True)
    assert iter(found) is found
    listed = []
    selector = fsio.pafs.FileSelector
    monkeypatch.setattr(fsio.pafs, "FileSelector", lambda p, recursive: listed.append(p) or selector(p, recursive=recursive))
    first = next(found)
    assert listed == [tmpdir_path] and first[1]
    rest = [first, *found]
    assert len(listed) == 41 and len(rest) == len({e[0] for e in rest}) == 80
    assert sorted(e[0] for e in rest if not e[1])[0] == f"file:{tmpdir_path}/d0/a.log" and {e[2] for e in rest if not e[1]} == {6}
    assert sorted(e[0] for e in fsio.entries(tmpdir_path, False)) == sorted(f"file:{tmpdir_path}/d{i}" for i in range(20))
    assert [e[:3] for e in fsio.entries(f"{tmpdir_path}/d0/a.log", True)] == [(f"file:{tmpdir_path}/d0/a.log", False, 6)]
