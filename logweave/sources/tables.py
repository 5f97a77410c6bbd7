"""Logs derived from the driver's tables, so every query's work grows with them.

* **evlog** -- the ``events`` table rendered as one pipe-delimited log per user:
  ``Timestamp|Level|Module|Message``.  Line numbers follow ``event_id`` within a
  user and are assigned blockwise (no one-task window per user).
* **doclog** -- each ``documents`` row is a log file; its text split on ``\\n``
  gives the lines, numbered by ``posexplode`` (parallel per document).

Both return a **lines** frame ``(path, line_no, text)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.carry import number_rows
from ..plans.profile import LogProfile

# Event type -> level of the rendered line.
EVENT_LEVELS = {"click": "TRACE", "view": "DEBUG", "signup": "INFO", "purchase": "WARN", "error": "ERROR"}

# Rows of events per numbering block (bounds one window task per user).
EVENT_BLOCK = 1 << 20

EVLOG_PROFILE = LogProfile.delimited(
    "|", ("Timestamp", "Level", "Module", "Message"), name="evlog",
).using(roles={"Timestamp": "Timestamp", "Level": "Level", "Module": "Module", "Message": "Message"})

DOC_NEW_EVENT = "^[A-Z]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def evlog_path(user_id) -> F.Column:
    return F.concat(F.lit("events/u"), user_id.cast("string"), F.lit(".log"))


def level_of_event(event_type) -> F.Column:
    expr = None
    for k, v in EVENT_LEVELS.items():
        expr = F.when(event_type == k, F.lit(v)) if expr is None else expr.when(event_type == k, F.lit(v))
    return expr.otherwise(F.upper(event_type))


def evlog_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``path`` and ``line_no`` (blockwise row numbers per user)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    ev = ev.withColumn("path", evlog_path(F.col("user_id")))
    return number_rows(ev, ["path"], [F.col("event_id")],
                       F.floor(F.col("event_id") / F.lit(EVENT_BLOCK)).cast("long"), out="line_no")


def evlog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evlog_numbered(spark, sf_dir)
    text = F.concat_ws(
        "|",
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSS"),
        level_of_event(F.col("event_type")),
        F.col("event_type"),
        F.coalesce(F.col("props"), F.lit("")),
    )
    return ev.select("path", "line_no", text.alias("text"))


def doclog_path(lang, doc_id) -> F.Column:
    return F.concat(F.lit("docs/"), lang, F.lit("/"), doc_id.cast("string"), F.lit(".log"))


def doclog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.select(
        doclog_path(F.col("lang"), F.col("doc_id")).alias("path"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    ).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("line").alias("text"))
