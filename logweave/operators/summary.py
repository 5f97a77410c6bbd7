"""Status summaries: shown / total / parsed / fallback / flagged per file, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import PARSED, PATH


COUNTS = ("shown", "total", "parsed", "fallback", "flagged")


def status_summary(tagged: DataFrame, shown: Column, stats: DataFrame | None = None) -> DataFrame:
    """One row per file plus a grand total (``path`` NULL).

    ``tagged`` carries ``is_parsed`` and ``is_flagged``; ``shown`` is the view
    predicate, evaluated once a line.  Lines shrink to their three booleans before
    anything is grouped, files are counted with partial aggregates (a hot file costs
    one row per task) and the total adds up the files.  ``stats`` (per-file encoding,
    warning, profile, truncation) is joined on when given, and every file of it has a
    row: one without lines counts zero.
    """
    marks = tagged.select(PATH, F.coalesce(shown, F.lit(False)).alias("s"), F.col(PARSED).alias("p"), F.col("is_flagged").alias("f"))
    files = marks.groupBy(PATH).agg(
        F.count_if("s").cast("long").alias("shown"), F.count(F.lit(1)).cast("long").alias("total"),
        F.count_if("p").cast("long").alias("parsed"), F.count_if(~F.col("p")).cast("long").alias("fallback"),
        F.count_if("f").cast("long").alias("flagged"))
    if stats is not None:
        files = stats.select(PATH).join(files, PATH, "full").fillna(0, COUNTS)
    # a file's row and its share of the total, from the per-file counts
    both = files.select(F.explode(F.array(F.col(PATH), F.lit(None).cast("string"))).alias(PATH), *COUNTS)
    agg = both.groupBy(PATH).agg(*[F.sum(c).alias(c) for c in COUNTS])
    if stats is not None:
        agg = agg.join(stats, PATH, "left")
    return agg


def total_flagged(tagged: DataFrame) -> DataFrame:
    return tagged.agg(F.count_if(F.col("is_flagged")).cast("long").alias("total_flagged"))
