import json
import os

from logweave.plans import rules as R
from logweave.plans.profile import LogProfile
from logweave.sources import config as C


def write(path, obj):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_profiles_roundtrip_skip_corrupt_sorted(spark, tmpdir_path):
    p1 = LogProfile.delimited("||", ["Timestamp", "Level", "Message"], name="pipe pipes")
    p2 = LogProfile.regex(r"(?<Level>\w+):(?<Message>.+)", name="Regex one").using(new_event=r"^\d{4}-")
    p3 = LogProfile.delimited("\t", ["X", "Y"], name="Tabby").using(roles={"X": "Timestamp"})
    for i, p in enumerate([p1, p2, p3]):
        write(os.path.join(tmpdir_path, f"p{i}.json"), C.profile_record(p))
    write(os.path.join(tmpdir_path, "bad.json"), "{not json")
    write(os.path.join(tmpdir_path, "notes.txt"), "ignored")
    got = C.load_profiles(spark, tmpdir_path)
    assert [p.name for p in got] == ["pipe pipes", "Regex one", "Tabby"]
    assert got[0].delimiter == "||" and got[0].field_names == ("Timestamp", "Level", "Message")
    assert got[1].pattern == r"(?<Level>\w+):(?<Message>.+)" and got[1].new_event == r"^\d{4}-"
    assert got[2].field_for("Timestamp") == "X" and got[2].role_of("x") == "Timestamp"


def test_settings_rules_and_presets(tmpdir_path):
    doc = {
        "IncludedExtensions": [".log", ".txt"],
        "ColorRules": [{"Kind": "FieldValue", "FieldName": "Level", "MatchValue": "ERROR", "Background": "#FF0000",
                        "FieldHighlight": "#FFFFFF", "Priority": 3},
                       {"Kind": "TimestampRange", "MatchValue": "2024-01-01|", "Background": "#000000"}],
        "FlagRules": [{"Kind": 2, "MatchValue": "disk"}, {"Kind": "FieldValue", "MatchValue": "FATAL"}],
        "FilterPresets": [{"Name": "errs", "FilterText": "error", "IsRegex": False, "OnlyFlagged": True,
                           "ProfileScope": "apache"}],
        "DirectoryProfileAssignments": {"C:\\Logs": "apache"},
    }
    p = os.path.join(tmpdir_path, "settings.json")
    write(p, doc)
    s = C.load_settings(p)
    assert s.extensions == [".log", ".txt"]
    assert s.paints[0] == R.Paint(R.equals("Level", "ERROR"), "#FF0000", "#FFFFFF", 3)
    assert s.paints[1].match.field == "Timestamp"
    assert s.flags == [R.contains("disk"), R.equals("Level", "FATAL")]
    assert s.views[0].view.only_flagged and s.views[0].profile == "apache"
    assert s.dir_assignments == {"C:\\Logs": "apache"}
    assert C.load_settings(os.path.join(tmpdir_path, "missing.json")).flags == list(R.DEFAULT_FLAGS)


def test_stored_rules_become_matches():
    flags = [{"Kind": 0, "MatchValue": "FATAL"}, {"Kind": 1, "MatchValue": "x+", "FieldName": "Body"}, {"Kind": "Contains", "MatchValue": "disk"}]
    assert [C.stored_match(r, C.STORED_FLAGS) for r in flags] == [
        R.equals("Level", "FATAL"), R.regex("x+", "Body"), R.contains("disk")]
    colours = [{"Kind": 3, "MatchValue": "2024-01-01 00:00:00|", "Background": "#1"}, {"Kind": 1, "MatchValue": "late", "FieldName": "Body"},
               {"Kind": 2, "MatchValue": "a|b", "FieldName": "Body", "Priority": 4}]
    assert [C.stored_paint(r) for r in colours] == [
        R.Paint(R.between("Timestamp", "2024-01-01 00:00:00", None), "#1"), R.Paint(R.contains("late", R.MESSAGE)),
        R.Paint(R.regex("a|b"), priority=4)]
    assert ~~R.contains("x") == R.contains("x")


def test_settings_from_a_uri(tmpdir_path):
    path = os.path.join(tmpdir_path, "my settings%.json")
    with open(path, "w") as fh:
        fh.write('{"IncludedExtensions": [".txt"]}')
    assert C.load_settings("file:" + path).extensions == [".txt"]
    assert C.load_settings(path).extensions == [".txt"]
