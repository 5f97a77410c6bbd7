"""Aligning logs: by line, by nearest timestamp, with the fallback chain.

Logs are never merged; the output is pairs of references
``(path, line_no) -> (target_path, target_line)``.

The nearest-timestamp match is an **as-of join** without a nested loop: the times of
both sides are written once, in buckets of about equal depth -- ranges of (pair, time,
line) that Spark draws from a sample of the rows, so a second that holds a third of all
rows is cut by line number like any other stretch.  Inside a bucket two windows, by
rising and by falling time, find the closest target at-or-before and at-or-after each
reference row; a tiny per-bucket summary carries the nearest target across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, FieldSpace, fields_of
from ..functions.timestamps import parse_timestamp
from ..plans.sizing import materialize

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` (zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def with_timestamps(rows: DataFrame, timestamp_field: str | None, fs: FieldSpace | None = None) -> DataFrame:
    """``(path, line_no, ts)`` of every row; ``ts`` is null where the field does not parse."""
    fs = fs or fields_of(rows)
    ts = F.lit(None).cast("timestamp_ntz") if timestamp_field is None else parse_timestamp(fs.get(timestamp_field))
    return rows.select(PATH, LINE, ts.alias("ts"))


def timestamped_rows(rows: DataFrame, timestamp_field: str | None, fs: FieldSpace | None = None) -> DataFrame:
    """``(path, line_no, ts)`` of rows whose timestamp field parses (empty without a field)."""
    return with_timestamps(rows, timestamp_field, fs).where(F.col("ts").isNotNull())


def line_counts(rows: DataFrame) -> DataFrame:
    """Last line number per file (0 when it has none is implied by absence)."""
    return rows.groupBy(PATH).agg(F.max(LINE).alias("last_line"))


def clamp_line(line: Column, last_line: Column) -> Column:
    """Line aligned by position: clamped to ``[1, last]``; an empty target gives 1."""
    n = F.coalesce(last_line, F.lit(0))
    return F.when(n < 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(line, n))).cast("long")


def align_by_line(ref: DataFrame, pairs: DataFrame, target_counts: DataFrame) -> DataFrame:
    """``ref (path, line_no)`` x ``pairs (path, target_path)`` -> clamped target line."""
    j = ref.select(PATH, LINE).join(pairs, PATH)
    j = j.join(target_counts.select(F.col(PATH).alias("target_path"), "last_line"), "target_path", "left")
    return j.select(PATH, LINE, "target_path", clamp_line(F.col(LINE), F.col("last_line")).alias("target_line"))


def _in_buckets(u: DataFrame, buckets: int | None) -> DataFrame:
    """``u`` written in order of (pair, time, targets before references, line), with ``bucket``:
    the range it fell in.  Of one time and pair there is one target, and it comes first, so
    every reference row finds it in its own bucket or in an earlier one."""
    order = ["src", "dst", "us", F.col("tline").isNull(), "rline"]
    cut = u.repartitionByRange(buckets, *order) if buckets else u.repartitionByRange(*order)
    return materialize(cut.withColumn("bucket", F.spark_partition_id().cast("long")))


def _with_nearest(ref: DataFrame, target: DataFrame, pairs: DataFrame, buckets: int | None) -> DataFrame:
    """``ref (src, dst, ts, rline, fall)`` with the nearest target's line and distance.

    Rows without a time stay, spread by their line, and find nothing.
    """
    # target reduced to one row per (file, ts): the smallest line wins a tie
    tgt = target.groupBy(PATH, "ts").agg(F.min(LINE).alias("tline"))
    tgt = tgt.join(pairs.select(F.col(PATH).alias("src"), F.col("target_path").alias(PATH)), PATH).select(
        "src", F.col(PATH).alias("dst"), "ts", F.lit(None).cast("long").alias("rline"), F.lit(None).cast("long").alias("fall"), "tline")
    u = ref.withColumn("tline", F.lit(None).cast("long")).unionByName(tgt).withColumn("us", micros(F.col("ts"))).drop("ts")
    u = _in_buckets(materialize(u), buckets)  # written first: drawing the ranges reads the rows as well
    point = F.when(F.col("tline").isNotNull(), F.struct(F.col("us").alias("us"), F.col("tline").alias("line")))
    group = Window.partitionBy("src", "dst", "bucket")
    until = group.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    since = group.orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, 0)
    near = u.withColumn("_pred", F.last(point, ignorenulls=True).over(until))
    near = near.withColumn("_succ", F.last(point, ignorenulls=True).over(since))

    # Carry across buckets: one row per bucket with its latest and earliest target.
    # A reference row whose own bucket has no target on a side takes the nearest
    # bucket's boundary target on that side.
    per_bucket = u.groupBy("src", "dst", "bucket").agg(F.max(point).alias("_mx"), F.min(point).alias("_mn"))
    of_pair = Window.partitionBy("src", "dst")
    carry = per_bucket.select(
        "src", "dst", "bucket",
        F.last("_mx", ignorenulls=True).over(of_pair.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_cpred"),
        F.last("_mn", ignorenulls=True).over(of_pair.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("_csucc"))

    r = near.where(F.col("rline").isNotNull()).join(carry, ["src", "dst", "bucket"], "left")
    pred = F.coalesce(F.col("_pred"), F.col("_cpred"))
    succ = F.coalesce(F.col("_succ"), F.col("_csucc"))
    cand_p = F.when(pred.isNotNull(), F.struct((F.col("us") - pred["us"]).alias("d"), pred["line"].alias("line")))
    cand_s = F.when(succ.isNotNull(), F.struct((succ["us"] - F.col("us")).alias("d"), succ["line"].alias("line")))
    best = F.when(F.col("us").isNotNull(), F.least(cand_p, cand_s))
    return r.select("src", "dst", "rline", "fall", best["line"].alias("near_line"), best["d"].alias("delta_micros"))


def nearest_by_time(ref: DataFrame, target: DataFrame, pairs: DataFrame, buckets: int | None = None) -> DataFrame:
    """For each timestamped reference row, the target line with the smallest |dt|.

    Ties go to the smaller target line (file order).  ``ref`` and ``target`` are
    ``(path, line_no, ts)``; ``pairs`` is ``(path, target_path)``; ``buckets`` of about
    equal depth are made in all (default: the session's shuffle partitions).
    Output ``(path, line_no, target_path, target_line, delta_micros)``.
    """
    pairs = materialize(pairs)  # small (one row per pair) and read twice below
    rf = ref.join(pairs, PATH).select(F.col(PATH).alias("src"), F.col("target_path").alias("dst"), "ts",
                                      F.col(LINE).cast("long").alias("rline"), F.lit(None).cast("long").alias("fall"))
    found = _with_nearest(rf, target, pairs, buckets)
    return found.where("near_line is not null").select(
        F.col("src").alias(PATH), F.col("rline").alias(LINE), F.col("dst").alias("target_path"),
        F.col("near_line").alias("target_line"), "delta_micros")


def align(ref: DataFrame, target_ts: DataFrame, target_counts: DataFrame, pairs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Timestamp alignment with the fallback chain, for every reference row.

    ``ref`` is ``(path, line_no, ts)`` of all reference rows, ``ts`` null where no
    timestamp parses (``with_timestamps``):

    * reference row without a timestamp -> align by line;
    * target without any timestamped row -> align by line;
    * else the nearest timestamp.
    Output ``(path, line_no, target_path, target_line, used_fallback)``.  The line
    to fall back to travels with the row, so nothing is joined afterwards.
    """
    pairs = materialize(pairs)
    counts = target_counts.select(F.col(PATH).alias("target_path"), "last_line")
    rf = ref.join(pairs, PATH).join(counts, "target_path", "left").select(
        F.col(PATH).alias("src"), F.col("target_path").alias("dst"), "ts", F.col(LINE).cast("long").alias("rline"),
        clamp_line(F.col(LINE), F.col("last_line")).alias("fall"))
    found = _with_nearest(rf, target_ts, pairs, buckets)
    return found.select(F.col("src").alias(PATH), F.col("rline").alias(LINE), F.col("dst").alias("target_path"),
                        F.coalesce("near_line", "fall").alias("target_line"), F.col("near_line").isNull().alias("used_fallback"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Source -> target pairs of split groups.

    ``groups (group_id, path, is_source, sync_enabled)``: each group's source is
    aligned against every *other* enabled member (the source itself and opted-out
    members are skipped).  A group has one source; of several the first path counts,
    so the pairs stay linear in the group's size.
    """
    src = groups.where(F.col("is_source") & F.col("sync_enabled")).groupBy("group_id").agg(F.min(PATH).alias(PATH))
    dst = groups.where(F.col("sync_enabled")).select("group_id", F.col(PATH).alias("target_path"))
    return src.join(dst, "group_id").where(F.col(PATH) != F.col("target_path")).select(PATH, "target_path").distinct()
