"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import materialize

# Byte table: ASCII letters to lower case, everything else unchanged.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Rows handled by one step of a Python task: bounds its memory, not its result.
SLICE_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_row_key(df: DataFrame, *cols: str) -> DataFrame:
    """Adds ``_k1``, ``_k2``: a 128-bit key of the given columns' values.

    Rows with equal values share the key (a repeated row is one key); null values
    take part, so it joins without null-safe comparisons.  Two hashes in opposite
    argument order keep accidental collisions out of reach for any table size.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return df.withColumns({
        "_k1": F.xxhash64(*parts, F.lit("1")),
        "_k2": F.xxhash64(F.lit("2"), *reversed(parts)),
    })


def boxed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns of ``df`` as one struct, so that no name can clash) and the row key."""
    one = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_row_key(one, "_id", "_text").select("row", "_k1", "_k2")


def unboxed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def has_letter(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\p{L}"), F.lit(False))


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder and read back (cuts lineage)."""
    return materialize(df)


def unlike(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, built from the wanted one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
