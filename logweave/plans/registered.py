"""The registered queries: each operator run over logs derived from the driver tables.

Every query reads the whole tables (``events`` rendered as per-user logs,
``documents`` as one log per document, ``pages`` URLs as file paths) so its work
grows with them.  Each returns a DataFrame whose column names match the oracle
SQL in ``logweave.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import LINE, PATH, FieldSpace, fields_of
from ..functions.levels import guess_role
from ..functions.timestamps import EXACT_FORMATS, parse_timestamp
from ..operators import align as A
from ..operators import detect as D
from ..operators import events as E
from ..operators import filters as FL
from ..operators import parse as PA
from ..operators import resolve as RS
from ..operators import search as S
from ..operators import sort as SO
from ..operators import summary as SU
from ..operators import tags as T
from ..operators import view as V
from ..functions import predicates as P
from ..sources import lines as L
from ..sources import sinks as SK
from ..sources.tables import EVLOG_PROFILE, DOC_NEW_EVENT, doclog_lines, doclog_path, evlog_lines, evlog_path, table
from . import rules as R
from .profile import LogProfile
from .sizing import materialize

# ---- shared inputs -------------------------------------------------------------
DOC_CSV = LogProfile.delimited(",", ("Head", "Body", "Tail"), name="doc-csv")
DOC_REGEX = LogProfile.regex(r"^(?<first_word>[A-Z][a-z]+)(?<punct>[,.])? (?<rest>.*)$", name="doc-words")
EV_REGEX = LogProfile.regex(
    r"^(?<Timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\|(?<Level>INFO|WARN|ERROR)\|(?<Module>\w+)\|(?<Message>.*)$",
    name="ev-regex")

HIGHLIGHT_RULES = (
    R.Paint(R.contains('"k": 5', R.MESSAGE), highlight="#D9B44A", priority=1),
    R.Paint(R.equals("Level", "ERROR"), background="#B23A48", priority=2, highlight="#B23A48"),
    R.Paint(R.regex("purchase"), priority=3, highlight="#4FA36B"),
)
BACKGROUND_RULES = R.DEFAULT_PAINTS + (
    R.Paint(R.equals("Module", "signup"), background="#1F5A1F", priority=7),
    R.Paint(R.between("Timestamp", "2024-01-10 00:00:00", "2024-01-11 00:00:00"), background="#1F1F5A", priority=20),
)
EV_VIEW = R.ViewFilter(text='k": 1', field="Message", exclude_text="purchase", exclude_is_regex=True,
                       only_flagged=True, time_from="2024-01-03 00:00:00", time_to="2024-01-20 00:00:00")
PRESETS = (
    R.SavedView("p_errors", R.ViewFilter(text="error")),
    R.SavedView("p_flagged", R.ViewFilter(only_flagged=True)),
    R.SavedView("p_k9", R.ViewFilter(text=r'"k": 9\d', is_regex=True, exclude_text="view")),
    R.SavedView("p_window", R.ViewFilter(time_from="2024-01-07 00:00:00", time_to="2024-01-14 00:00:00",
                                         exclude_text="^TRACE$", exclude_is_regex=True)),
)
DOC_VISIBLE_TEXT = "the"
DOC_HIT_TEXT = "tion"


def _ev_rows(spark, sf):
    return PA.parse_lines(evlog_lines(spark, sf), EVLOG_PROFILE, spark)


def _doc_lines(spark, sf):
    return doclog_lines(spark, sf)


def _doc_csv(spark, sf):
    return PA.parse_lines(_doc_lines(spark, sf), DOC_CSV, spark)


def _user_pairs(spark, sf) -> DataFrame:
    users = table(spark, sf, "events").select("user_id").distinct()
    nxt = users.select((F.col("user_id") - 1).alias("user_id"), F.col("user_id").alias("next_id"))
    return users.join(nxt, "user_id").select(evlog_path(F.col("user_id")).alias(PATH),
                                             evlog_path(F.col("next_id")).alias("target_path"))


# ---- sources ---------------------------------------------------------------------
def q_scan_lines(spark, sf):
    return _doc_lines(spark, sf)


def q_line_count(spark, sf):
    return L.line_counts(_doc_lines(spark, sf))


def q_read_range(spark, sf):
    return L.read_range(_doc_lines(spark, sf), 3, 5)


def q_load_cap(spark, sf):
    return L.load_stats(_doc_lines(spark, sf), 20)


# Documents per workspace file in the round-trip query (bounds one write task), and lines loaded for the status.
WS_DOCS_PER_FILE = 1000
WS_LINE_CAP = 2000


def _shared_folder(spark, name):
    import uuid

    from ..session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/logweave-{name}-{uuid.uuid4().hex}"


def _written_workspace(spark, sf):
    """Documents written as log files -- one per source and block of ``WS_DOCS_PER_FILE`` document
    ids, in id order -- into the shared checkpoint folder."""
    root = _shared_folder(spark, "ws")
    docs = table(spark, sf, "documents").select(
        "source", F.floor(F.col("doc_id") / WS_DOCS_PER_FILE).cast("long").alias("blk"), "doc_id", "text")
    (docs.repartition("source", "blk").sortWithinPartitions("source", "blk", "doc_id").drop("doc_id")
     .write.partitionBy("source", "blk").option("compression", "none").text(root))
    return root


def _workspace_path():
    src = F.regexp_extract(PATH, "/source=([^/]+)/", 1)
    blk = F.regexp_extract(PATH, "/blk=([0-9]+)/", 1)
    return F.concat(F.lit("ws/"), src, F.lit("/"), blk, F.lit(".log"))


def q_workspace_lines(spark, sf):
    """Files end to end: scanned, encoding-detected, numbered and decoded."""
    from ..sources.files import read_workspace

    _files, enc, lines = read_workspace(spark, _written_workspace(spark, sf), extensions=[".txt"])
    j = lines.join(enc.select(PATH, "encoding"), PATH)
    return j.select(_workspace_path().alias(PATH), LINE, "text", "encoding")


def q_workspace_status(spark, sf):
    """The status of every file of an opened workspace, its first lines loaded."""
    from ..sources.config import Settings
    from .workspace import open_workspace

    ws = open_workspace(spark, _written_workspace(spark, sf), Settings(extensions=[".txt"]), detect_unresolved=False,
                        view=R.ViewFilter(text=DOC_HIT_TEXT), line_cap=WS_LINE_CAP)
    return ws.status.where(F.col(PATH).isNotNull()).select(
        _workspace_path().alias(PATH), "shown", "total", "parsed", "fallback", "flagged", "encoding", "truncated")


def q_read_range_indexed(spark, sf):
    """A few lines far into every file, read through a table of lines per byte range."""
    from ..sources.encoding import detect_encodings
    from ..sources.files import scan_workspace, workspace_glob
    from ..sources.lineindex import build_index, read_lines_at

    root = _written_workspace(spark, sf)
    files = scan_workspace(spark, root, [".txt"])
    encodings = detect_encodings(spark, files, root, recursive=True, glob=workspace_glob(root, [".txt"]))
    index = materialize(build_index(files.join(encodings.select(PATH, "encoding"), PATH), 1 << 16))
    return read_lines_at(index, 90, 11).select(_workspace_path().alias(PATH), LINE, "text")


def q_decode_ansi(spark, sf):
    """Text as Windows-1252 bytes, decoded again; characters it lacks became question marks."""
    from ..sources.encoding import decode_ansi

    text = F.regexp_replace("text", "[^\\x00-\\x7F\\xA0-\\xFF]", "?")
    return table(spark, sf, "documents").select("doc_id", decode_ansi(F.encode(text, "ISO-8859-1")).alias("text"))


def q_profiles_read(spark, sf):
    """A profile stored per language and source as a JSON file, and all read back."""
    from ..sources.config import read_profiles

    docs = table(spark, sf, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first"))
    own = docs.select(
        F.concat_ws("-", "lang", "source").alias("Name"), F.lit("Delimited").alias("Kind"), F.lit("|").alias("Delimiter"),
        F.array(F.lit("Time"), F.upper("lang"), F.concat(F.lit("F"), F.col("first").cast("string"))).alias("FieldNames"),
        F.create_map(F.lit("Time"), F.lit("Timestamp")).alias("FieldTypes"), F.concat_ws("-", "lang", "source").alias("file"))
    root = _shared_folder(spark, "profiles")
    own.repartition("file").write.partitionBy("file").json(root)
    read = read_profiles(spark, root)
    return read.select("Name", "Kind", "Delimiter", F.array_join("FieldNames", ",").alias("field_names"), F.col("FieldTypes")["Time"].alias("time_role"))


def q_rules_read(spark, sf):
    """Flag rules stored as a settings document, one for each module and level, and applied."""
    import json

    from ..sources import fsio
    from ..sources.config import load_settings

    seen = sorted((r.module, r.n) for r in table(spark, sf, "events").groupBy(F.col("event_type").alias("module")).agg(F.count("*").alias("n")).collect())
    rules = [{"Kind": "FieldValue", "FieldName": "Module", "MatchValue": m} for m, n in seen if n % 2] + [
        {"Kind": "Contains", "MatchValue": f'"k": {len(seen)}'}, {"Kind": "Regex", "MatchValue": "k\\W+9"}]
    path = _shared_folder(spark, "settings").removeprefix("file://") + "/settings.json"
    fsio.write(path, json.dumps({"FlagRules": rules}).encode())
    rows = T.flag_rows(_ev_rows(spark, sf), load_settings(path).flags, spark=spark)
    return rows.where("is_flagged").select(PATH, LINE)


def q_presets_visible(spark, sf):
    """Presets (one an event, a third of them global) that a profile sees."""
    presets = table(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.upper("event_type")).alias("profile_scope"))
    return FL.visible_presets(presets, "Click").select("name", "profile_scope")


def q_filter_ignore_case(spark, sf):
    rows = PA.parse_raw(_doc_lines(spark, sf))
    kept = FL.apply_filters(rows, [R.contains("CIÓN"), ~R.contains("LOS ")], spark=spark)
    return kept.select(PATH, LINE)


DIALECT = {
    "consonants": r"\b[a-z-[aeiou]]{3,}\b", "block": r"[\p{IsLatin-1Supplement}-[\xA0-\xBF]]{2}", "twice": r"(?<w>t[a-z])(?:o)?\k<w>",
    "spaced": r"(?x) \b the [ ] \w{3} # two words", "literal": r"a{,3}|(?#none)\.$",
}


def q_regex_dialect(spark, sf):
    from ..functions.regex import java_regex

    hits = {name: F.col("text").rlike(java_regex(p, spark=spark)) for name, p in DIALECT.items()}
    found = _doc_lines(spark, sf).select(PATH, LINE, *[hit.alias(name) for name, hit in hits.items()])
    return found.where(" or ".join(hits))


def q_rule_table(spark, sf):
    """Rules as a table: every long word of the benchmark, searched ignoring case in all lines."""
    from ..operators.ruletable import rule_hits

    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))
    rules = table(spark, sf, "benchmark").select(F.explode(words).alias("what")).distinct().select(
        F.col("what").alias("rule_id"), F.lit(R.CONTAINS).alias("how"), "what", F.lit(None).cast("string").alias("field"), F.lit(True).alias("any_case"))
    hits = rule_hits(PA.parse_raw(_doc_lines(spark, sf)), rules, spark=spark)
    return hits.select(PATH, LINE, F.col("rule_id").alias("word"))


# ---- parsing ---------------------------------------------------------------------
def q_parse_delimited(spark, sf):
    return _ev_rows(spark, sf).select(PATH, LINE, "is_parsed", "Timestamp", "Level", "Module", "Message", "RawText")


def q_parse_delimited_short(spark, sf):
    return _doc_csv(spark, sf).select(PATH, LINE, "is_parsed", "Head", "Body", "Tail", "RawText")


def q_parse_regex(spark, sf):
    rows = PA.parse_lines(evlog_lines(spark, sf), EV_REGEX, spark)
    return rows.select(PATH, LINE, "is_parsed", "Timestamp", "Level", "Module", "Message", "RawText")


def q_parse_regex_doc(spark, sf):
    rows = PA.parse_lines(_doc_lines(spark, sf), DOC_REGEX, spark)
    return rows.select(PATH, LINE, "is_parsed", "first_word", "punct", "rest", "RawText")


def q_parse_stats(spark, sf):
    return PA.parse_stats(_doc_csv(spark, sf))


def q_columns_discovered(spark, sf):
    rows = PA.parse_lines(_doc_lines(spark, sf), DOC_REGEX, spark)
    return PA.discover_columns(rows, FieldSpace(DOC_REGEX.output_fields()))


def q_format_detect(spark, sf):
    return D.detect_formats(_doc_lines(spark, sf))


def q_format_fields(spark, sf):
    return D.suggested_fields(D.detect_formats(_doc_lines(spark, sf)))


def q_parse_detected(spark, sf):
    lines = _doc_lines(spark, sf)
    rows = D.parse_detected(lines, D.detect_formats(lines))
    return rows.select(PATH, LINE, "is_parsed", F.explode("fields").alias("key", "value"))


def q_semantic_guess(spark, sf):
    """Role guessed for every distinct word of the documents, taken as a field name."""
    words = _doc_lines(spark, sf).select(F.explode(F.split(F.col("text"), " ", -1)).alias("field_name")).distinct()
    return words.select("field_name", guess_role(F.col("field_name")).alias("role"))


def _page_files(spark, sf):
    return table(spark, sf, "pages").select(F.concat(F.lit("/"), F.regexp_replace("url", "://", "/")).alias(PATH))


def _page_assignments(spark, sf):
    pages = table(spark, sf, "pages")
    hosts = pages.where(F.col("url").startswith("https://blog.")).select(
        F.regexp_extract("url", "^https://([^/]+)", 1).alias("host")).distinct()
    fixed = spark.createDataFrame([("/https", "secure", 0), ("/HTTP/", "plain", 1)], "dir string, profile string, ordinal int")
    blog = hosts.select(F.concat(F.lit("\\HTTPS\\"), F.upper("host")).alias("dir"), F.lit("blog").alias("profile"),
                        F.lit(2).alias("ordinal"))
    blog_en = hosts.select(F.concat(F.lit("/https/"), F.col("host"), F.lit("/en")).alias("dir"),
                           F.lit("blog-en").alias("profile"), F.lit(3).alias("ordinal"))
    overrides = _page_files(spark, sf).where(F.col(PATH).contains("#top")).select(
        F.upper(PATH).alias("file"), F.lit("anchored").alias("profile"), F.lit(0).alias("ordinal")).distinct()
    return fixed.unionByName(blog).unionByName(blog_en), overrides


def q_profile_resolve(spark, sf):
    dirs, overrides = _page_assignments(spark, sf)
    return RS.resolve_profiles(_page_files(spark, sf), dirs, overrides)


def q_parse_multi_profile(spark, sf):
    lines = _doc_lines(spark, sf)
    assign = spark.createDataFrame([("docs/en", "doc-csv", 0), ("DOCS\\FR\\", "doc-words", 1)],
                                   "dir string, profile string, ordinal int")
    prof = RS.resolve_profiles(lines.where(F.col(LINE) == 1), assign)  # one row per file
    j = lines.join(prof, PATH, "left")
    rows = PA.parse_with_profiles(j, {"doc-csv": DOC_CSV, "doc-words": DOC_REGEX}, spark=spark)
    return rows.select(PATH, LINE, "profile", "is_parsed", F.explode("fields").alias("key", "value"))


# ---- filters -------------------------------------------------------------------
def q_filter_include_value(spark, sf):
    return FL.apply_filters(_ev_rows(spark, sf), [R.equals("Level", "ERROR")]).select(
        PATH, LINE, "Level", "Module")


def q_filter_exclude_value(spark, sf):
    return FL.apply_filters(_ev_rows(spark, sf), [~R.equals("Module", "click")]).select(
        PATH, LINE, "Module")


def q_filter_text_any(spark, sf):
    return FL.apply_filters(_ev_rows(spark, sf), [R.contains('"K": 1')]).select(PATH, LINE)


def q_filter_text_exclude(spark, sf):
    return FL.apply_filters(_ev_rows(spark, sf), [~R.contains("error")]).select(PATH, LINE)


def q_filter_regex(spark, sf):
    return FL.apply_filters(_ev_rows(spark, sf), [R.regex(r": 9\d\}", "Message", any_case=False)],
                            spark=spark).select(PATH, LINE, "Message")


def q_filter_regex_exclude(spark, sf):
    return FL.apply_filters(_ev_rows(spark, sf), [~R.regex("^(TRACE|DEBUG)$", "Level", any_case=False)],
                            spark=spark).select(PATH, LINE, "Level")


def q_filter_time_range(spark, sf):
    return FL.time_range(_ev_rows(spark, sf), "Timestamp", "2024-01-05 00:00:00", "2024-01-12 12:00:00").select(
        PATH, LINE, "Timestamp")


def q_view_filter(spark, sf):
    rows = T.flag_rows(_ev_rows(spark, sf), spark=spark)
    return FL.view(rows, EV_VIEW, EVLOG_PROFILE.field_for("Timestamp"), spark=spark).select(PATH, LINE)


def q_preset_counts(spark, sf):
    rows = T.flag_rows(_ev_rows(spark, sf), spark=spark)
    return FL.preset_counts(rows, PRESETS, EVLOG_PROFILE.field_for("Timestamp"), spark=spark)


# ---- search --------------------------------------------------------------------
def q_search_matches(spark, sf):
    rows = PA.parse_raw(_doc_lines(spark, sf))
    return S.search(rows, R.SearchQuery("ent"), spark=spark)


def q_search_word(spark, sf):
    rows = PA.parse_raw(_doc_lines(spark, sf))
    return S.search(rows, R.SearchQuery("The", case_sensitive=True, whole_word=True), spark=spark)


def q_search_fields(spark, sf):
    return S.search(_ev_rows(spark, sf), R.SearchQuery("error"), spark=spark)


def q_find_next(spark, sf):
    rows = _doc_lines(spark, sf)
    return S.find_next_prev(rows, F.col("text").contains(DOC_HIT_TEXT)).select(PATH, LINE, "next_match", "prev_match")


def _doc_visible(spark):
    return P.view_predicate(R.ViewFilter(text=DOC_VISIBLE_TEXT), FieldSpace(("RawText",)), None, spark=spark)


def q_nearest_visible(spark, sf):
    rows = PA.parse_raw(_doc_lines(spark, sf))
    return S.nearest_visible(rows, _doc_visible(spark)).select(PATH, LINE, "nearest_line")


def q_search_hidden(spark, sf):
    rows = PA.parse_raw(_doc_lines(spark, sf))
    return S.search_hidden(rows, R.SearchQuery(DOC_HIT_TEXT, case_sensitive=True), _doc_visible(spark), spark=spark)


# ---- tags ----------------------------------------------------------------------
def q_flag_lines(spark, sf):
    return T.flagged_lines(T.flag_rows(_ev_rows(spark, sf), spark=spark))


DOC_FLAGS = (R.contains("password"), R.regex(r"\b(secret|token)\b"),
             R.equals("Head", "Le"))


def q_flag_lines_doc(spark, sf):
    return T.flagged_lines(T.flag_rows(_doc_csv(spark, sf), DOC_FLAGS, spark=spark))


def q_total_flagged(spark, sf):
    return SU.total_flagged(T.flag_rows(_ev_rows(spark, sf), spark=spark))


def q_flag_counts(spark, sf):
    return T.flag_counts(T.flag_rows(_ev_rows(spark, sf), spark=spark))


def q_row_background(spark, sf):
    return T.color_rows(_ev_rows(spark, sf), BACKGROUND_RULES, spark=spark).select(PATH, LINE, "row_background")


def q_field_highlight(spark, sf):
    return T.highlight_table(T.color_rows(_ev_rows(spark, sf), HIGHLIGHT_RULES, spark=spark))


# ---- events --------------------------------------------------------------------
def _doc_events(spark, sf):
    rows = PA.parse_raw(_doc_lines(spark, sf))
    return E.assign_events(rows, DOC_NEW_EVENT, spark=spark)


def q_events_multiline(spark, sf):
    return E.events(_doc_events(spark, sf)).select(PATH, LINE, "n_continuations", "last_line")


def q_continuation_text(spark, sf):
    return E.continuation_text(_doc_events(spark, sf))


def q_events_single(spark, sf):
    """No multiline rule: every line is its own event."""
    rows = PA.parse_raw(_doc_lines(spark, sf))
    return E.events(E.assign_events(rows, None)).select(PATH, LINE, "n_continuations", "last_line")


def q_lookup_flagged_text(spark, sf):
    """Line lookup: the raw text of flagged lines, by (path, line_no) references."""
    refs = T.flagged_lines(T.flag_rows(_doc_csv(spark, sf), DOC_FLAGS, spark=spark))
    return V.lookup_lines(_doc_lines(spark, sf), refs).select(PATH, LINE, "text")


def q_append_logs(spark, sf):
    """Rows of two kinds of logs appended into one frame (missing columns NULL)."""
    ev = _ev_rows(spark, sf).select(PATH, LINE, "raw", "Level")
    docs = PA.parse_raw(_doc_lines(spark, sf)).select(PATH, LINE, "raw")
    return V.append_rows(ev, docs)


def q_visible_columns(spark, sf):
    return V.show_columns(_ev_rows(spark, sf), ["Message", "Level"])


# ---- sort ----------------------------------------------------------------------
def q_level_sort_rank(spark, sf):
    return SO.level_positions(_ev_rows(spark, sf), "Level").select(PATH, LINE, "level_rank", "sort_pos")


def q_attach_continuations(spark, sf):
    rows = PA.parse_raw(_doc_lines(spark, sf))
    assigned = E.assign_events(rows, DOC_NEW_EVENT, spark=spark)
    shown = FL.view(assigned, R.ViewFilter(text=DOC_VISIBLE_TEXT))
    return E.attach_continuations(shown.select(PATH, LINE), assigned).select(
        PATH, LINE, F.coalesce("n_continuations", F.lit(0)).cast("long").alias("n_continuations"))


# ---- alignment -----------------------------------------------------------------
def q_timestamped_rows(spark, sf):
    return A.timestamped_rows(_ev_rows(spark, sf), EVLOG_PROFILE.field_for("Timestamp"))



def q_align_line(spark, sf):
    rows = materialize(_ev_rows(spark, sf).select(PATH, LINE))
    return A.align_by_line(rows, _user_pairs(spark, sf), A.line_counts(rows))


def q_align_nearest(spark, sf):
    ts = materialize(A.timestamped_rows(_ev_rows(spark, sf), "Timestamp"))
    return A.nearest_by_time(ts, ts, _user_pairs(spark, sf))


def q_align_fallback(spark, sf):
    ev = materialize(_ev_rows(spark, sf).select(PATH, LINE, "Timestamp"))
    docs = _doc_lines(spark, sf)
    users = table(spark, sf, "events").select("user_id").distinct()
    dmeta = table(spark, sf, "documents").select("doc_id", "lang")
    src = users.select(F.col("user_id").alias("group_id"), evlog_path(F.col("user_id")).alias(PATH),
                       F.lit(True).alias("is_source"))
    nxt = users.select((F.col("user_id") - 1).alias("group_id"), evlog_path(F.col("user_id")).alias(PATH),
                       F.lit(False).alias("is_source"))
    doc = dmeta.select(F.col("doc_id").alias("group_id"), doclog_path(F.col("lang"), F.col("doc_id")).alias(PATH),
                       F.lit(False).alias("is_source"))
    groups = src.unionByName(nxt).unionByName(doc).withColumn("sync_enabled", F.lit(True))
    pairs = A.group_pairs(groups)
    ref = A.with_timestamps(ev, "Timestamp")
    counts = A.line_counts(ev).unionByName(A.line_counts(docs))
    return A.align(ref, A.timestamped_rows(ev, "Timestamp"), counts, pairs)  # documents have no Timestamp field


# ---- summaries and sinks -------------------------------------------------------
def q_status_summary(spark, sf):
    rows = T.flag_rows(_doc_csv(spark, sf), spark=spark)
    shown = P.view_predicate(R.ViewFilter(text=DOC_VISIBLE_TEXT), fields_of(rows), None, spark=spark)
    return SU.status_summary(rows, shown)


def q_export_tsv(spark, sf):
    return SK.tsv_lines(_doc_csv(spark, sf), DOC_CSV.field_names)


def q_raw_text(spark, sf):
    return SK.raw_text(_doc_csv(spark, sf))


def q_line_refs(spark, sf):
    return SK.line_refs(T.flag_rows(_ev_rows(spark, sf), spark=spark).where("is_flagged"))


def q_timestamp_formats(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    renders = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("fmt_id"), F.date_format("ts", f).alias("text"))
                        for i, f in enumerate(EXACT_FORMATS)])
    r = ev.select("event_id", F.inline(renders))
    return r.select("event_id", "fmt_id", "text", parse_timestamp(F.col("text")).alias("parsed"))


# ---- field names, loose times, orders -------------------------------------------
# names that engine columns have too, in one case or another
ANY_NAMES = ("Path", "text", "_kind", "profile")


def q_field_names_any(spark, sf):
    """A profile whose fields are called like engine columns: parsed, flagged, folded, then searched."""
    rows = PA.parse_delimited(evlog_lines(spark, sf), "|", ANY_NAMES)
    rows = E.assign_events(T.color_rows(T.flag_rows(rows, DOC_FLAGS)), None)
    fs = fields_of(rows)
    shown = FL.view(rows, R.ViewFilter(text='k": 1'))
    return shown.select(PATH, LINE, *[fs.get(n).alias(f"f_{n}") for n in ANY_NAMES])


def q_search_decorated(spark, sf):
    """A search after flags, colours and the event fold finds what it finds before them."""
    rows = E.assign_events(T.color_rows(T.flag_rows(_doc_csv(spark, sf))), DOC_NEW_EVENT)
    return S.search(rows, R.SearchQuery("ru"))


def q_time_only_range(spark, sf):
    """A log that gives times without dates, cut by a range of times."""
    ev = table(spark, sf, "events").select(
        evlog_path(F.col("user_id")).alias(PATH), F.col("event_id").alias(LINE),
        F.concat_ws("|", F.date_format("ts", "HH:mm:ss.SSS"), F.col("event_type")).alias("text"))
    rows = PA.parse_delimited(ev, "|", ["Time", "Kind"])
    return FL.time_range(rows, "Time", "08:00:00", "17:30").select(PATH, LINE, "Time", "Kind")


# Loose forms of a time, as Spark writes them.
LOOSE_FORMS = ("MMM d yyyy HH:mm:ss", "M/d/yyyy h:mm:ss a", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "d MMMM yyyy HH:mm", "MMM d, yyyy",
               "HH:mm", "MMM d HH:mm:ss")


def q_timestamp_loose(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.posexplode(F.array(
        *[F.date_format("ts", f) for f in LOOSE_FORMS])).alias("form", "text"))
    return ev.select("event_id", (F.col("form") + 1).cast("long").alias("form"), "text", parse_timestamp("text").alias("parsed"))


def _positions(ordered):
    return SO.positions(ordered.select(PATH, LINE))


def q_sort_field(spark, sf):
    return _positions(SO.sort_by_field(_ev_rows(spark, sf), "Message", descending=True))


def q_sort_time(spark, sf):
    return _positions(SO.sort_by_time(_ev_rows(spark, sf), "Timestamp"))


def q_sort_saved(spark, sf):
    return _positions(SO.sort_view(_ev_rows(spark, sf), SO.SortState("Module", descending=True), "Level"))


def q_sort_restored(spark, sf):
    rows = SO.sort_by_field(_ev_rows(spark, sf), "Module")
    return _positions(SO.restore_order(rows))


QUERIES = {
    "scan_lines": q_scan_lines,
    "line_count": q_line_count,
    "read_range": q_read_range,
    "load_cap": q_load_cap,
    "workspace_lines": q_workspace_lines,
    "field_names_any": q_field_names_any,
    "search_decorated": q_search_decorated,
    "time_only_range": q_time_only_range,
    "timestamp_loose": q_timestamp_loose,
    "sort_field": q_sort_field,
    "sort_time": q_sort_time,
    "sort_restored": q_sort_restored,
    "sort_saved": q_sort_saved,
    "workspace_status": q_workspace_status,
    "read_range_indexed": q_read_range_indexed,
    "decode_ansi": q_decode_ansi,
    "profiles_read": q_profiles_read,
    "rules_read": q_rules_read,
    "presets_visible": q_presets_visible,
    "filter_ignore_case": q_filter_ignore_case,
    "regex_dialect": q_regex_dialect,
    "rule_table": q_rule_table,
    "parse_delimited": q_parse_delimited,
    "parse_delimited_short": q_parse_delimited_short,
    "parse_regex": q_parse_regex,
    "parse_regex_doc": q_parse_regex_doc,
    "parse_stats": q_parse_stats,
    "columns_discovered": q_columns_discovered,
    "format_detect": q_format_detect,
    "format_fields": q_format_fields,
    "parse_detected": q_parse_detected,
    "semantic_guess": q_semantic_guess,
    "profile_resolve": q_profile_resolve,
    "parse_multi_profile": q_parse_multi_profile,
    "filter_include_value": q_filter_include_value,
    "filter_exclude_value": q_filter_exclude_value,
    "filter_text_any": q_filter_text_any,
    "filter_text_exclude": q_filter_text_exclude,
    "filter_regex": q_filter_regex,
    "filter_regex_exclude": q_filter_regex_exclude,
    "filter_time_range": q_filter_time_range,
    "view_filter": q_view_filter,
    "preset_counts": q_preset_counts,
    "search_matches": q_search_matches,
    "search_word": q_search_word,
    "search_fields": q_search_fields,
    "find_next": q_find_next,
    "nearest_visible": q_nearest_visible,
    "search_hidden": q_search_hidden,
    "flag_lines": q_flag_lines,
    "flag_lines_doc": q_flag_lines_doc,
    "lookup_flagged_text": q_lookup_flagged_text,
    "flag_counts": q_flag_counts,
    "total_flagged": q_total_flagged,
    "row_background": q_row_background,
    "field_highlight": q_field_highlight,
    "events_multiline": q_events_multiline,
    "continuation_text": q_continuation_text,
    "attach_continuations": q_attach_continuations,
    "events_single": q_events_single,
    "level_sort_rank": q_level_sort_rank,
    "timestamped_rows": q_timestamped_rows,
    "align_line": q_align_line,
    "align_nearest": q_align_nearest,
    "align_fallback": q_align_fallback,
    "status_summary": q_status_summary,
    "append_logs": q_append_logs,
    "visible_columns": q_visible_columns,
    "export_tsv": q_export_tsv,
    "raw_text": q_raw_text,
    "line_refs": q_line_refs,
    "timestamp_formats": q_timestamp_formats,
}
