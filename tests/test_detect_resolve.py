from logweave.operators import detect as D
from logweave.operators import resolve as RS
from tests.conftest import lines_df


def detect(spark, texts):
    r = D.detect_formats(lines_df(spark, texts)).collect()[0]
    return r.kind, r.delimiter, r.field_count


def test_detect_pipe(spark):
    assert detect(spark, ["a|b|c|d", "e|f|g|h", "i|j|k|l"]) == ("Delimited", "|", 4)


def test_detect_double_pipe_preferred(spark):
    assert detect(spark, ["a||b||c", "d||e||f"]) == ("Delimited", "||", 3)


def test_detect_comma_and_tab(spark):
    assert detect(spark, ["a,b", "c,d"]) == ("Delimited", ",", 2)
    assert detect(spark, ["a\tb\tc", "d\te\tf"]) == ("Delimited", "\t", 3)


def test_detect_free_text_and_blank(spark):
    assert detect(spark, ["just some text", "more words here"]) == ("Raw", None, 0)
    assert detect(spark, ["", "   "]) == ("Raw", None, 0)


def test_detect_stray_comma(spark):
    assert detect(spark, ["a|b|c", "d|e,x|f", "g|h|i"]) == ("Delimited", "|", 3)


def test_parse_detected_and_roles(spark):
    lines = lines_df(spark, ["2024|INFO|x", "2024|WARN|y", "no pipe"])
    fmts = D.detect_formats(lines.where("line_no <= 2"))
    rows = D.parse_detected(lines, fmts).orderBy("line_no").collect()
    assert dict(rows[0].fields) == {"Timestamp": "2024", "Level": "INFO", "Module": "x"}
    assert dict(rows[2].fields) == {"RawText": "no pipe"}
    roles = [(r.field_name, r.role) for r in D.suggested_fields(fmts).orderBy("position").collect()]
    assert roles == [("Timestamp", "Timestamp"), ("Level", "Level"), ("Module", "Module")]


def resolve(spark, files, dirs, overrides=None):
    f = spark.createDataFrame([(p,) for p in files], "path string")
    d = RS.assignments_frame(spark, dirs, "dir")
    o = RS.assignments_frame(spark, overrides, "file") if overrides else None
    return {r.path: r.profile for r in RS.resolve_profiles(f, d, o).collect()}


def test_resolve_none(spark):
    assert resolve(spark, ["C:\\Logs\\a.log"], {}) == {"C:\\Logs\\a.log": None}


def test_resolve_directory_applies_to_subfolders_and_nearest_wins(spark):
    got = resolve(spark, ["C:\\Logs\\x\\a.log", "C:\\Logs\\b.log", "D:\\other\\c.log"],
                  {"C:\\Logs": "outer", "C:\\Logs\\x": "inner"})
    assert got == {"C:\\Logs\\x\\a.log": "inner", "C:\\Logs\\b.log": "outer", "D:\\other\\c.log": None}


def test_resolve_file_override_wins_and_case_insensitive(spark):
    got = resolve(spark, ["c:\\logs\\APP.LOG", "c:/logs/b.log"], {"C:\\Logs": "dir"}, {"C:/LOGS/app.log": "file"})
    assert got == {"c:\\logs\\APP.LOG": "file", "c:/logs/b.log": "dir"}


def test_resolve_prefix_is_not_ancestor(spark):
    assert resolve(spark, ["C:\\LogsOld\\a.log"], {"C:\\Logs": "dir"}) == {"C:\\LogsOld\\a.log": None}
