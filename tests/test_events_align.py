import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import align as A
from logweave.operators import events as E
from tests.conftest import lines_df


def test_multiline_stack_trace(spark):
    texts = ["2024-01-15 10:00:00 ERROR boom", "   at A.B()", "   at C.D()", "2024-01-15 10:00:01 INFO ok"]
    rows = lines_df(spark, texts).withColumnRenamed("text", "raw")
    ev = E.events(E.assign_events(rows, r"^\d{4}-")).orderBy("line_no").collect()
    assert [(r.line_no, r.n_continuations) for r in ev] == [(1, 2), (4, 0)]


def test_multiline_banner_before_first_header(spark):
    texts = ["=== banner", "--- more", "2024-01-15 10:00:00 INFO start"]
    rows = lines_df(spark, texts).withColumnRenamed("text", "raw")
    ev = E.events(E.assign_events(rows, r"^\d{4}-")).orderBy("line_no").collect()
    assert [(r.line_no, r.n_continuations) for r in ev] == [(1, 1), (3, 0)]


def test_no_rule_every_row_is_event(spark):
    rows = lines_df(spark, ["a", "b"]).withColumnRenamed("text", "raw")
    assert E.assign_events(rows, None).where("is_primary").count() == 2


def test_events_blockwise_equals_sequential_fold(spark):
    rnd = random.Random(7)
    texts = [("H" if rnd.random() < 0.2 else "c") + str(i) for i in range(300)]
    rows = lines_df(spark, texts).withColumnRenamed("text", "raw")
    got = {r.line_no: r.event_line for r in E.assign_events(rows, "^H", block_lines=16).collect()}
    expect, cur = {}, None
    for i, t in enumerate(texts, start=1):
        if cur is None or t.startswith("H"):
            cur = i
        expect[i] = cur
    assert got == expect


def test_continuation_text(spark):
    rows = lines_df(spark, ["H1", "a", "b", "H2"]).withColumnRenamed("text", "raw")
    ct = E.continuation_text(E.assign_events(rows, "^H")).collect()
    assert [(r.line_no, r.continuation_text) for r in ct] == [(1, "a\nb")]


def ts(h, m, s):
    return dt.datetime(2024, 1, 15, h, m, s)


def test_align_by_line(spark):
    ref = spark.createDataFrame([("r", 5), ("r", 99), ("r", 0)], "path string, line_no long")
    pairs = spark.createDataFrame([("r", "t")], "path string, target_path string")
    counts = spark.createDataFrame([("t", 10)], "path string, last_line long")
    got = {r.line_no: r.target_line for r in A.align_by_line(ref, pairs, counts).collect()}
    assert got == {5: 5, 99: 10, 0: 1}
    empty = spark.createDataFrame([], "path string, last_line long")
    assert A.align_by_line(ref, pairs, empty).collect()[0].target_line == 1


def test_nearest_by_time_fixture(spark):
    tgt = spark.createDataFrame([("t", 1, ts(10, 0, 0)), ("t", 2, ts(10, 0, 10)), ("t", 3, ts(10, 0, 20))],
                                "path string, line_no long, ts timestamp_ntz")
    ref = spark.createDataFrame([("r", 1, ts(10, 0, 11)), ("r", 2, ts(10, 0, 18)), ("r", 3, ts(9, 59, 0)),
                                 ("r", 4, ts(10, 0, 5))], "path string, line_no long, ts timestamp_ntz")
    pairs = spark.createDataFrame([("r", "t")], "path string, target_path string")
    got = {r.line_no: r.target_line for r in A.nearest_by_time(ref, tgt, pairs, buckets=3).collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 1}


def brute(ref, tgt):
    out = {}
    for (rl, rt) in ref:
        best = None
        for (tl, tt) in tgt:
            d = abs((rt - tt).total_seconds())
            if best is None or d < best[0]:
                best = (d, tl)
        out[rl] = best[1] if best else None
    return out


@pytest.mark.parametrize("seed,bucket", [(1, 12), (2, None), (3, 60)])
def test_nearest_matches_brute_force_with_ties(spark, seed, bucket):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    tgt = sorted([(i, base + dt.timedelta(seconds=rnd.randrange(0, 600, 3))) for i in range(1, 61)])
    ref = [(i, base + dt.timedelta(seconds=rnd.randrange(-30, 630))) for i in range(1, 121)]
    tdf = spark.createDataFrame([("t", l, t) for l, t in tgt], "path string, line_no long, ts timestamp_ntz")
    rdf = spark.createDataFrame([("r", l, t) for l, t in ref], "path string, line_no long, ts timestamp_ntz")
    pairs = spark.createDataFrame([("r", "t")], "path string, target_path string")
    got = {r.line_no: r.target_line for r in A.nearest_by_time(rdf, tdf, pairs, buckets=bucket).collect()}
    assert got == brute(ref, tgt)


def test_fallback_chain(spark):
    ref = spark.createDataFrame([("r", 1, ts(10, 0, 0)), ("r", 2, None)], "path string, line_no long, ts timestamp_ntz")
    tgt_ts = spark.createDataFrame([("t", 7, ts(10, 0, 1))], "path string, line_no long, ts timestamp_ntz")
    counts = spark.createDataFrame([("t", 9), ("u", 1)], "path string, last_line long")
    pairs = spark.createDataFrame([("r", "t"), ("r", "u")], "path string, target_path string")
    got = {(r.line_no, r.target_path): (r.target_line, r.used_fallback)
           for r in A.align(ref, tgt_ts, counts, pairs).collect()}
    assert got == {(1, "t"): (7, False), (2, "t"): (2, True), (1, "u"): (1, True), (2, "u"): (1, True)}
    assert got == {(r.line_no, r.target_path): (r.target_line, r.used_fallback)
                   for r in A.align(ref, tgt_ts, counts, pairs, buckets=9).collect()}


def test_group_pairs_excludes_self_and_opted_out(spark):
    g = spark.createDataFrame([(1, "a", True, True), (1, "b", False, True), (1, "c", False, False)],
                              "group_id long, path string, is_source boolean, sync_enabled boolean")
    assert [(r.path, r.target_path) for r in A.group_pairs(g).collect()] == [("a", "b")]
    many = spark.createDataFrame([(1, f"p{i:03}", True, True) for i in range(50)], g.schema)
    assert A.group_pairs(many).count() == 49  # one source, however many claim to be


def test_nearest_adaptive_buckets_match_brute_force(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    tgt = [(i, base + dt.timedelta(seconds=rnd.randrange(0, 900, 2))) for i in range(1, 81)]
    ref = [(i, base + dt.timedelta(seconds=rnd.randrange(-50, 950))) for i in range(1, 151)]
    tdf = spark.createDataFrame([("t", l, t) for l, t in tgt], "path string, line_no long, ts timestamp_ntz")
    rdf = spark.createDataFrame([("r", l, t) for l, t in ref], "path string, line_no long, ts timestamp_ntz")
    pairs = spark.createDataFrame([("r", "t")], "path string, target_path string")
    got = {r.line_no: r.target_line for r in A.nearest_by_time(rdf, tdf, pairs, buckets=33).collect()}
    assert got == brute(ref, sorted(tgt))


def test_dense_minute_and_long_file_take_linear_time(spark):
    """200,000 rows of one pair within one minute; 400,000 lines of one file in one block."""
    import time

    from logweave.operators import search as SE
    n = 200_000
    t = F.expr("timestampadd(MICROSECOND, cast(id * 7 % 60000000 as int), timestamp_ntz'2024-01-01 00:00:00')")
    rows = spark.range(1, n + 1).select(F.lit("a").alias("path"), F.col("id").alias("line_no"), t.alias("ts"))
    other = rows.withColumn("path", F.lit("b"))
    pairs = spark.createDataFrame([("a", "b")], "path string, target_path string")
    start = time.time()
    got = A.nearest_by_time(rows, other, pairs).agg(F.count("*"), F.max("delta_micros")).first()
    assert tuple(got) == (n, 0) and time.time() - start < 60
    lines = spark.range(1, 2 * n + 1).select(F.lit("a").alias("path"), F.col("id").alias("line_no"))
    start = time.time()
    hits = SE.find_next_prev(lines, F.col("line_no") % 100_000 == 7)
    bad = hits.where("next_match <= line_no and line_no < 300007 or prev_match >= line_no and line_no > 7").count()
    assert bad == 0 and time.time() - start < 60


def test_one_second_is_spread_over_many_buckets(spark):
    """All rows of a pair at two moments: buckets of about equal depth, the same result as brute force."""
    base = dt.datetime(2024, 1, 1)
    ref = [(i, base + dt.timedelta(seconds=3 * (i % 2))) for i in range(1, 401)]
    tgt = [(i, base + dt.timedelta(seconds=i % 5)) for i in range(1, 91)] + [(i, base) for i in range(100, 400)]
    frame = lambda name, rows: spark.createDataFrame([(name, n, t) for n, t in rows], "path string, line_no long, ts timestamp_ntz")
    pairs = spark.createDataFrame([("r", "t")], "path string, target_path string")
    u = frame("r", ref).select(F.lit("r").alias("src"), F.lit("t").alias("dst"), A.micros(F.col("ts")).alias("us"), F.lit(None).cast("long").alias("tline"),
                               F.col("line_no").alias("rline"))
    depth = [r["count"] for r in A._in_buckets(u, 16).groupBy("bucket").count().collect()]
    assert len(depth) >= 14 and max(depth) <= 60
    got = {r.line_no: r.target_line for r in A.nearest_by_time(frame("r", ref), frame("t", tgt), pairs, buckets=16).collect()}
    assert got == brute(ref, sorted(tgt))
