"""Which profile applies to a file: file override, else nearest assigned ancestor.

Paths compare with ``/`` and ``\\`` as the same separator, ignoring case and a
trailing separator.  Each file's directory is expanded into its ancestors (a
few per file), equi-joined to the directory assignments, and the longest match
kept -- a join on equality, never a prefix scan of assignments per file.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import PATH
from ..plans.sizing import materialize


def norm_path(c: Column) -> Column:
    """``file:`` scheme dropped, separators unified to ``\\``, trailing separators removed, lower-cased."""
    c = F.regexp_replace(c, "^file:(//)?", "")
    return F.lower(F.regexp_replace(F.regexp_replace(c, "/", "\\\\"), "\\\\+$", ""))


def parent_dir(normed: Column) -> Column:
    """Directory part of a normalised path ('' when it has none)."""
    return F.regexp_extract(normed, "^(.*)\\\\[^\\\\]*$", 1)


def ancestors(dir_col: Column) -> Column:
    """All ancestors of a normalised directory including itself, as an array."""
    parts = F.split(dir_col, "\\\\", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))


def profile_of(path: Column, assignments: Mapping[str, str], overrides: Mapping[str, str], known: Collection[str]) -> Column:
    """``resolve_profiles`` as an expression of a path, for streams: the assignments become part of the plan.

    Override first, else the deepest assigned folder; NULL without one, or when it names no known profile.
    """
    np = norm_path(path)
    own = F.when(np.contains("\\"), parent_dir(np)).otherwise(F.lit(""))
    above = F.concat(ancestors(own), F.array(own))
    deepest_first = sorted(assignments.items(), key=lambda kv: -len(kv[0].removeprefix("file:").removeprefix("//").rstrip("/\\")))
    rules = [F.when(np == norm_path(F.lit(k)), F.lit(v)) for k, v in overrides.items()]
    rules += [F.when(F.array_contains(above, norm_path(F.lit(k))), F.lit(v)) for k, v in deepest_first]
    found = F.coalesce(*rules) if rules else F.lit(None).cast("string")
    return F.when(found.isin(list(known) or [""]), found)


def assignments_frame(spark: SparkSession, assignments: Mapping[str, str], key: str) -> DataFrame:
    """The assignments as a table of the plan itself; rows given as a Python list would take a worker on every core."""
    table = pa.table({key: pa.array(assignments.keys(), pa.string()), "profile": pa.array(assignments.values(), pa.string()),
                      "ordinal": pa.array(range(len(assignments)), pa.int32())})
    return spark.createDataFrame(table)


def resolve_profiles(files: DataFrame, dir_assignments: DataFrame, file_overrides: DataFrame | None = None,
                     path_col: str = PATH) -> DataFrame:
    """``(path, profile)`` for every distinct file in ``files``; NULL when none applies.

    ``dir_assignments (dir, profile, ordinal)`` and ``file_overrides (file,
    profile, ordinal)`` are configuration; ``ordinal`` breaks ties in favour of
    the earlier entry.
    """
    # one row per file, read by three branches below: written once
    f = materialize(files.select(F.col(path_col).alias(PATH)).distinct().withColumn("_np", norm_path(F.col(PATH))))
    # a path that is just a file name has directory '' (matches only an empty assignment)
    f = f.withColumn("_dir", F.when(F.col("_np").contains("\\"), parent_dir(F.col("_np"))).otherwise(F.lit("")))
    anc = f.select(PATH, F.explode(F.array_distinct(F.concat(ancestors(F.col("_dir")), F.array(F.col("_dir"))))).alias("_anc"))
    da = dir_assignments.select(norm_path(F.col("dir")).alias("_anc"), "profile", "ordinal")
    best_dir = anc.join(da, "_anc").groupBy(PATH).agg(
        F.max_by("profile", F.struct(F.length("_anc"), -F.col("ordinal"))).alias("_dir_profile"))
    out = f.join(best_dir, PATH, "left")
    if file_overrides is not None:
        fo = file_overrides.select(norm_path(F.col("file")).alias("_np"), "profile", "ordinal")
        best_file = f.select(PATH, "_np").join(fo, "_np").groupBy(PATH).agg(
            F.min_by("profile", F.col("ordinal")).alias("_file_profile"))
        out = out.join(best_file, PATH, "left")
    else:
        out = out.withColumn("_file_profile", F.lit(None).cast("string"))
    return out.select(PATH, F.coalesce("_file_profile", "_dir_profile").alias("profile"))
