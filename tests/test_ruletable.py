"""Rules as a table against the OR of single rules."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.fields import FIELDS, FieldSpace, fields_of
from logweave.functions.predicates import match_predicate
from logweave.operators import ruletable as RT
from logweave.plans import rules as R
from tests.conftest import rows_df

SCHEMA = "rule_id long, how string, what string, field string, any_case boolean"
ROWS = [(1, "INFO", "Auth", "User logged in"), (2, "ERROR", "Auth", "Login failed: timeout"), (3, "WARN", None, "Retry É attempt"),
        (4, "ERROR", "DB", ""), (5, None, None, None), (6, "info", "DB", "straße STRASSE ΚΣΑΣΟ")]


def single(rule):
    _, how, what, field, any_case = rule
    return R.Match(how, what, field, any_case=bool(any_case))


def test_equal_to_single_rules(spark):
    rows = rows_df(spark, ROWS, ["Level", "Module", "Message"])
    rules = [(1, R.EQUALS, "ERROR", "Level", False), (2, R.EQUALS, "DB", "Module", None), (3, R.CONTAINS, "TIMEOUT", None, True),
             (4, R.CONTAINS, "timeout", None, False), (5, R.CONTAINS, "log", "Message", True), (6, R.REGEX, "failed|retry", None, True),
             (7, R.REGEX, "^Re", "Message", False), (8, R.CONTAINS, "é", None, True), (9, R.CONTAINS, "ss", None, True), (10, R.CONTAINS, "σας", None, True),
             (11, R.CONTAINS, "", "Message", True), (12, R.EQUALS, "", "Message", False), (13, R.CONTAINS, "og", None, False), (14, R.EQUALS, "INFO", "Nope", False)]
    table = spark.createDataFrame([*rules, (None, R.CONTAINS, "x", None, True), (15, R.CONTAINS, None, None, True)], SCHEMA)
    want = {}
    for rule in rules:
        for r in rows.where(match_predicate(single(rule), fields_of(rows), spark)).collect():
            want.setdefault(r.line_no, []).append(rule[0])
    for size in (RT.RULE_BYTES, 300):  # one pass, and many
        got = {r.line_no: r[RT.HITS] for r in RT.match_rules(rows, table, spark=spark, rule_bytes=size).collect()}
        assert got == {n: want.get(n, []) for n, *_ in ROWS}
    assert sorted(tuple(r)[1:] for r in RT.rule_hits(rows, table, spark=spark).collect()) == sorted((n, i) for n, ids in want.items() for i in ids)


def test_field_maps_other_id_types_and_no_rules(spark):
    rows = rows_df(spark, ROWS, ["Level", "Module", "Message"])
    mapped = rows.select("path", "line_no", F.map_from_arrays(F.array(F.lit("Level"), F.lit("Message")), F.array("Level", "Message")).alias(FIELDS))
    table = spark.createDataFrame([("r-a", R.CONTAINS, "err", None, True), ("r-b", R.EQUALS, "Auth", None, False)], SCHEMA.replace("rule_id long", "rule_id string"))
    got = {r.line_no: r[RT.HITS] for r in RT.match_rules(mapped, table, FieldSpace(None, FIELDS), spark).collect()}
    assert got == {1: [], 2: ["r-a"], 3: [], 4: ["r-a"], 5: [], 6: []}
    assert all(r[RT.HITS] == [] for r in RT.match_rules(rows, table.limit(0), spark=spark).collect())
    with pytest.raises(ValueError):
        RT.match_rules(rows, spark.createDataFrame([(1, "sounds like", "x", None, True)], SCHEMA), spark=spark)


def test_ten_thousand_literals_in_one_pass(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=rng.randint(4, 7))) for _ in range(10_000)]
    rows = rows_df(spark, [(i, "".join(rng.choices("abcde ", k=300)), "M") for i in range(1, 200)], ["Message", "Module"])
    table = spark.createDataFrame([(i, R.CONTAINS, w, None, False) for i, w in enumerate(words)], SCHEMA)
    done = RT.match_rules(rows, table, spark=spark)
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for r in done.collect():
        assert r[RT.HITS] == [i for i, w in enumerate(words) if w in r.Message]
