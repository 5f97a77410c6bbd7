import pytest
from pyspark.sql import functions as F

from logweave.functions.regex import InvalidPatternError, java_regex, literal, translate


def test_named_groups_become_positional_with_names():
    jp = translate(r"^(?<Time_stamp>\d+) (?'lvl'\w+)(x)?", explicit_capture=True)
    assert jp.group_names == ("Time_stamp", "lvl")
    assert "(?:x)" in jp.pattern
    assert jp.pattern.startswith("(?U)(?d)")


def test_unnamed_groups_capture_without_explicit_capture():
    jp = translate(r"(a)(?<n>b)")
    assert jp.group_names == (None, "n")


def test_lookarounds_and_classes_untouched():
    jp = translate(r"(?<=a)[(]b(?!c)\(", explicit_capture=True)
    assert jp.group_names == ()
    assert "(?<=a)" in jp.pattern and "[(]" in jp.pattern


def test_repeated_names_are_listed():
    jp = translate(r"(?<x>a)|(?<x>b)", explicit_capture=True)
    assert jp.named_groups() == [("x", [1, 2])]


@pytest.mark.parametrize("bad", ["[invalid(", "(?(x)a|b)", "(?<a-b>x)", "a)"])
def test_bad_patterns_rejected(bad):
    with pytest.raises(InvalidPatternError):
        translate(bad, explicit_capture=True)


def test_literal_quotes_E():
    assert literal(r"a\Eb") == r"\Qa\E\\E\Qb\E"


def test_ignore_case_flag():
    assert translate("x", ignore_case=True).pattern.startswith("(?iU)")


def test_jvm_validation_rejects(spark):
    from logweave.functions.regex import java_regex
    with pytest.raises(InvalidPatternError):
        java_regex("a{2,1}", spark=spark)


def test_named_backreference_and_inline_flags(spark):
    from pyspark.sql import functions as F
    from logweave.functions.regex import java_regex
    jp = translate(r"(?<w>\w+) \k<w>", explicit_capture=True)
    assert jp.pattern.endswith(r"(\w+) \1")
    df = spark.createDataFrame([("hello hello",), ("hello world",), ("ÉTÉ été",)], "s string")
    hits = [r.s for r in df.where(F.col("s").rlike(jp.pattern)).collect()]
    assert hits == ["hello hello"]
    ci = java_regex("été", ignore_case=True)
    assert [r.s for r in df.where(F.col("s").rlike(ci)).collect()] == ["ÉTÉ été"]
    assert [r.s for r in df.where(F.col("s").rlike(java_regex("(?i)HELLO W"))).collect()] == ["hello world"]


def test_group_syntax_inside_class_is_literal():
    jp = translate(r"[(?<x>)]+(?<y>a)", explicit_capture=True)
    assert jp.group_names == ("y",)


def test_unicode_classes_and_line_ends(spark):
    from pyspark.sql import functions as F
    from logweave.functions.regex import java_regex
    df = spark.createDataFrame([("٣",), ("a\rb",), ("x\n",)], "s string")
    assert df.where(F.col("s").rlike(java_regex(r"^\d$"))).count() == 1      # Unicode digit
    assert df.where(F.col("s").rlike(java_regex(r"a.b"))).count() == 1       # only \n ends a line
    assert df.where(F.col("s").rlike(java_regex(r"^x$"))).count() == 1       # $ before a final \n


@pytest.mark.parametrize("pattern,hits", [
    ("^[a-z-[aeiou]]+$", ["bcd"]),
    (r"^[\w-[\d_]]+$", ["bcd", "abc", "é"]),
    ("^[a-z-[^aeiou]]+$", ["aei"]),
    ("^[^a-z-[A-Z]]+$", ["123", "&&", "é"]),
    ("^[&&]+$", ["&&"]),
    ("^[a&&b]+$", ["&&"]),
])
def test_class_subtraction_and_ampersands(spark, pattern, hits):
    values = ["bcd", "abc", "aei", "ABC", "123", "&&", "é"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v for r in df.where(F.col("v").rlike(java_regex(pattern, spark=spark))).collect()}
    want = set(hits)
    if pattern == r"^[\w-[\d_]]+$":
        want |= {"aei", "ABC"}
    assert got == want


def test_nested_subtraction_is_rejected():
    for bad in ("[a-z-[b-y-[c]]]", "[a-z-[b]c]", "[a-z-[b"):
        with pytest.raises(InvalidPatternError):
            translate(bad)


@pytest.mark.parametrize("bad", [
    "a++b", "a*+", "a?+", "a{2}+", "a**", "a{2}{3}", r"\h", r"\R", r"\X", r"\Qa.b\E", r"\E", r"\i", r"\_", r"\pL", r"\p{Alpha}", r"\p{javaLowerCase}",
    r"\p{IsAlphabetic", "(?U)a", "(?d)a", "(?<n>a", "*a", "(*a)", "a|+", "a{3,2}", "[a", "[]", "a\\", r"\x1", r"\u12", r"\c", r"(a)\2", r"\k<none>",
    "(?<1a>x)", "(?P<n>a)", "(?#open", r"[\8]"])
def test_what_the_dialect_does_not_know_is_an_error(bad):
    with pytest.raises(InvalidPatternError):
        translate(bad)


@pytest.mark.parametrize("pattern,yes,no", [
    (r"^\p{IsGreek}$", ["α", "Ϡ"], ["ἀ", "a"]),  # the block, not the script
    (r"^\P{IsBasicLatin}$", ["é"], ["a"]),
    (r"^\p{IsGreekandCoptic}\p{IsLatin-1Supplement}$", ["αé"], ["aé"]),
    (r"^\p{Lu}\p{Nd}[\p{Pd}x]$", ["É٣-", "A1x"], ["e3-"]),
    ("^a{,3}$", ["a{,3}"], ["aaa", ""]),
    ("^{x}a{b}{$", ["{x}a{b}{"], []),
    ("^a{2}?b{1,}c{0,1}$", ["aabbc", "aab"], ["ab"]),
    (r"^\v\a\e\cJ\x41é\0\07$", ["\x0b\x07\x1b\nAé\0\x07"], []),
    (r"^[\b\v\]\-\d]+$", ["\x08\x0b]-1"], ["b"]),
    (r"^(?x) a b [ #] # the end" + "\n c $", ["ab c", "ab#c"], ["abc", "a b c"]),
    (r"^(?x: a b ) c$", ["ab c"], ["abc"]),
    (r"^(?#say a)a(?i:B)(?-i)c$", ["abc", "aBc"], ["abC"]),
    (r"^(a)(?<n>b)(c)\2\3$", ["abccb"], ["abcbc"]),  # numbers count unnamed groups first
    (r"^(a)\10?$", [], []),
    (r"^(?<n>a)\k'n'1$", ["aa1"], ["a1"]),
    (r"^[[:alpha:]]$", ["a]", ":]", "[]"], ["a"]),
    (r"^[a&&b]]$", ["&]"], ["&"]),
    (r"^(?:a|)(?=b)b(?!c)(?>d*)(?<=b|d)(?<!x)$", ["ab", "b", "bdd"], ["bc"]),
])
def test_dialect_against_examples(spark, pattern, yes, no):
    if pattern == r"^(a)\10?$":
        with pytest.raises(InvalidPatternError):
            translate(pattern)
        return
    java = java_regex(pattern, spark=spark)
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    assert sorted(r.v for r in df.where(F.col("v").rlike(java)).collect()) == sorted(yes)


def test_explicit_capture_renumbers():
    assert translate(r"(x)(?<n>y)\1", explicit_capture=True).pattern.endswith(r"(?:x)(y)\1")
    assert translate(r"(?<a>x)(?<b>y)\2", explicit_capture=True).pattern.endswith(r"(x)(y)\2")
