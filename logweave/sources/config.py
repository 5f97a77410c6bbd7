"""Configuration inputs: parsing profiles, colour/flag rules, filter presets, assignments.

Profiles are read with Spark's JSON source (a folder of ``*.json`` files, one
profile each; corrupt files are skipped, names sorted ignoring case).  Settings
(rules, presets, profile assignments) are one small document read on the driver.
Enum values are stored by name; integers are accepted too.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import ROLES, STANDARD_LEVEL_ORDER
from ..plans import rules as R
from ..plans.profile import LogProfile
from . import fsio

PROFILE_SCHEMA = (
    "Name string, Kind string, Delimiter string, Pattern string, FieldNames array<string>, "
    "MultilineNewEventPattern string, FieldTypes map<string,string>, LevelOrder array<string>, "
    "_corrupt_record string"
)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile records from a folder of JSON files (or one file); corrupt ones dropped."""
    df = (spark.read.schema(PROFILE_SCHEMA)
          .option("multiLine", "true").option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record")
          .option("pathGlobFilter", "*.json")
          .json(path))
    df = df.cache()  # a corrupt-record column may only be queried on a cached/saved frame
    ok = df.where(F.col("_corrupt_record").isNull() & F.col("Name").isNotNull()).drop("_corrupt_record")
    return ok.orderBy(F.lower("Name"))


def load_profiles(spark: SparkSession, path: str) -> list[LogProfile]:
    """Profiles as objects (configuration-sized: one per saved profile)."""
    out = []
    for r in read_profiles(spark, path).collect():
        rec = r.asDict()
        rec["FieldTypes"] = dict(rec.get("FieldTypes") or {})
        out.append(stored_profile(rec))
    return out


@dataclass
class Settings:
    extensions: list[str] = field(default_factory=lambda: [".log"])
    paints: list[R.Paint] = field(default_factory=lambda: list(R.DEFAULT_PAINTS))
    flags: list[R.Match] = field(default_factory=lambda: list(R.DEFAULT_FLAGS))
    views: list[R.SavedView] = field(default_factory=list)
    dir_assignments: dict[str, str] = field(default_factory=dict)
    file_overrides: dict[str, str] = field(default_factory=dict)


# How the stored kinds of rules and profiles are named, in the order of their numbers.
STORED_FLAGS = ("FieldValue", "Regex", "Contains")
STORED_COLOURS = ("FieldValue", "MessageContaining", "Regex", "TimestampRange")
STORED_PARSERS = ("Raw", "Delimited", "Regex")


def _stored_kind(rec: dict, kinds: tuple[str, ...], default: str) -> str:
    kind = rec.get("Kind", default)
    return kinds[kind] if isinstance(kind, int) else kind


def stored_match(rec: dict, kinds: tuple[str, ...]) -> R.Match:
    """The test of a stored flag or colour rule."""
    kind, value, field_name = _stored_kind(rec, kinds, "Regex"), rec.get("MatchValue") or "", rec.get("FieldName")
    any_field = None if kinds is STORED_COLOURS else field_name  # stored colours by pattern look at any field
    if kind == "FieldValue":
        return R.equals(field_name or "Level", value)
    if kind == "Regex":
        return R.regex(value, any_field)
    if kind == "Contains":
        return R.contains(value, any_field)
    if kind == "MessageContaining":
        return R.contains(value, R.MESSAGE)
    if kind == "TimestampRange":  # stored as "from|to"
        start, _, end = value.partition("|")
        return R.between(field_name or "Timestamp", start or None, end.partition("|")[0] or None)
    raise ValueError(f"unknown kind of rule {kind!r}")


def stored_paint(rec: dict) -> R.Paint:
    return R.Paint(stored_match(rec, STORED_COLOURS), rec.get("Background"), rec.get("FieldHighlight"), int(rec.get("Priority") or 0))


def stored_view(rec: dict) -> R.SavedView:
    view = R.ViewFilter(
        text=rec.get("FilterText") or "", is_regex=bool(rec.get("IsRegex")),
        exclude_text=rec.get("ExcludeText") or "", exclude_is_regex=bool(rec.get("ExcludeIsRegex")),
        only_flagged=bool(rec.get("OnlyFlagged")), time_from=rec.get("FilterTimeFrom"), time_to=rec.get("FilterTimeTo"))
    return R.SavedView(rec.get("Name") or "", view, rec.get("ProfileScope"))


def stored_profile(rec: dict) -> LogProfile:
    """A profile from its stored record; what a record leaves out gets a default that parses."""
    kind = _stored_kind(rec, STORED_PARSERS, "Raw")
    roles = {f: ROLES[r] if isinstance(r, int) else r for f, r in (rec.get("FieldTypes") or {}).items()}
    common = dict(name=rec.get("Name") or "(no name)", new_event=rec.get("MultilineNewEventPattern") or None, roles=roles,
                  level_order=tuple(rec.get("LevelOrder") or STANDARD_LEVEL_ORDER))
    if kind == "Delimited":
        return LogProfile.delimited(rec.get("Delimiter") or "|", rec.get("FieldNames") or (), **common)
    if kind == "Regex":
        return LogProfile.regex(rec.get("Pattern") or ".*", **common)
    return LogProfile.raw(**common)


def profile_record(p: LogProfile) -> dict:
    """The stored record of a profile."""
    return {"Name": p.name, "Kind": p.kind, "Delimiter": p.delimiter, "Pattern": p.pattern, "FieldNames": list(p.field_names),
            "MultilineNewEventPattern": p.new_event, "FieldTypes": dict(p.roles), "LevelOrder": list(p.level_order)}


def parse_settings(doc: dict) -> Settings:
    s = Settings()
    if doc.get("IncludedExtensions"):
        s.extensions = list(doc["IncludedExtensions"])
    if doc.get("ColorRules") is not None:
        s.paints = [stored_paint(r) for r in doc["ColorRules"]]
    if doc.get("FlagRules") is not None:
        s.flags = [stored_match(r, STORED_FLAGS) for r in doc["FlagRules"]]
    s.views = [stored_view(r) for r in doc.get("FilterPresets") or []]
    s.dir_assignments = dict(doc.get("DirectoryProfileAssignments") or {})
    s.file_overrides = dict(doc.get("FileProfileOverrides") or {})
    return s


def load_settings(path: str) -> Settings:
    """Settings document at a local path or URI; a missing file gives the defaults, an
    unreadable one too, any other failure to read is raised."""
    length = fsio.size(path)
    if length is None:
        return Settings()
    try:
        return parse_settings(json.loads(fsio.read(path, 0, length).decode("utf-8-sig")))
    except ValueError:  # not JSON, or not of the known shape
        return Settings()


def views_frame(spark: SparkSession, views: list[R.SavedView]) -> DataFrame:
    """Saved views as rows: name, the view's parts, profile_scope."""
    rows = [(v.name, v.view.text, v.view.is_regex, v.view.only_flagged, v.view.time_from, v.view.time_to, v.profile,
             v.view.exclude_text or None, v.view.exclude_is_regex) for v in views]
    return spark.createDataFrame(rows, "name string, filter_text string, is_regex boolean, only_flagged boolean, "
                                       "time_from string, time_to string, profile_scope string, exclude_text string, "
                                       "exclude_is_regex boolean")
