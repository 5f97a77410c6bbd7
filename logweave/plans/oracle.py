"""DuckDB SQL for every registered query: an independent formulation of each result.

The oracle derives the same logs from the same tables (``events`` -> per-user
pipe-delimited logs, ``documents`` -> one log per document) but computes each
operator the plain way: whole-file windows, string functions, prefix tests and
brute-force nearest search.  Column names match the Spark queries.

RE2 (DuckDB) treats ``\\b \\w \\s`` as ASCII while the engine follows Unicode
rules; the patterns below only meet ASCII tokens.
"""

from __future__ import annotations

FLAGRX = r"(?i)\b(ERROR|FATAL|FAIL|ASSERT|TIMEOUT|EXCEPTION|WARN)\b"
REDRX = r"(?i)\b(ERROR|FATAL|FAIL|EXCEPTION|ASSERT)\b"
AMBERRX = r"(?i)\b(WARN|WARNING|TIMEOUT)\b"
EV_RX = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\|(INFO|WARN|ERROR)\|(\w+)\|(.*)$"
DOC_RX = r"^([A-Z][a-z]+)([,.])? (.*)$"

EVN = r"""
evn AS (
  SELECT 'events/u' || CAST(user_id AS VARCHAR) || '.log' AS path,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS line_no,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS "Timestamp",
         CASE event_type WHEN 'click' THEN 'TRACE' WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'INFO'
              WHEN 'purchase' THEN 'WARN' WHEN 'error' THEN 'ERROR' ELSE upper(event_type) END AS "Level",
         event_type AS "Module", coalesce(props, '') AS "Message",
         user_id, event_id, ts, epoch_us(date_trunc('millisecond', ts)) AS us
  FROM events),
evr AS (
  SELECT *, "Timestamp" || '|' || "Level" || '|' || "Module" || '|' || "Message" AS raw FROM evn),
evf AS (
  SELECT *, (regexp_matches("Timestamp", '__FLAG__') OR regexp_matches("Level", '__FLAG__')
             OR regexp_matches("Module", '__FLAG__') OR regexp_matches("Message", '__FLAG__')) AS is_flagged
  FROM evn)""".replace("__FLAG__", FLAGRX)

DOC = r"""
doc AS (
  SELECT path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS text
  FROM (SELECT 'docs/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.log' AS path,
               string_split(text, chr(10)) AS parts FROM documents)),
dcsv AS (
  SELECT path, line_no, text, contains(text, ',') AS ok,
         CASE WHEN contains(text, ',') THEN coalesce(string_split(text, ',')[1], '') END AS h,
         CASE WHEN contains(text, ',') THEN coalesce(string_split(text, ',')[2], '') END AS b,
         CASE WHEN contains(text, ',') THEN coalesce(string_split(text, ',')[3], '') END AS t,
         CASE WHEN NOT contains(text, ',') THEN text END AS r
  FROM doc)"""

PAIRS = r"""
uu AS (SELECT DISTINCT user_id FROM events),
pairs AS (
  SELECT 'events/u' || CAST(a.user_id AS VARCHAR) || '.log' AS path,
         'events/u' || CAST(b.user_id AS VARCHAR) || '.log' AS target_path
  FROM uu a JOIN uu b ON b.user_id = a.user_id + 1)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(cols, test):
    return "(" + " OR ".join(f"coalesce({test.format(c=c)}, false)" for c in cols) + ")"


EVCOLS = ['"Timestamp"', '"Level"', '"Module"', '"Message"']
DOCCOLS = ["h", "b", "t", "r"]

ROLE_CASE = r"""CASE WHEN contains(@n, 'time') OR contains(@n, 'date') OR @n = 'ts' THEN 'Timestamp'
 WHEN contains(@n, 'level') OR @n = 'lvl' OR @n = 'severity' THEN 'Level'
 WHEN contains(@n, 'message') OR @n = 'msg' OR @n = 'text' THEN 'Message'
 WHEN contains(@n, 'module') OR contains(@n, 'logger') OR contains(@n, 'tag') OR contains(@n, 'component') THEN 'Module'
 WHEN contains(@n, 'thread') OR @n = 'tid' THEN 'Thread'
 WHEN contains(@n, 'device') THEN 'DeviceId'
 WHEN contains(@n, 'test') THEN 'TestCase'
 WHEN contains(@n, 'run') THEN 'RunId'
 WHEN contains(@n, 'result') THEN 'Result'
 ELSE 'Generic' END""".replace("@n", "lower(trim(field_name))")

_DELIMS = ["'||'", "chr(9)", "'|'", "','", "';'"]

DETECT = r"""
samp AS (SELECT path, text FROM doc WHERE NOT regexp_matches(text, '^\s*$')),
gagg AS (SELECT path, """ + ",\n ".join(
    f"bool_and(contains(text, {d})) AS a{i}, min(len(string_split(text, {d}))) AS n{i}, "
    f"max(len(string_split(text, {d}))) AS x{i}" for i, d in enumerate(_DELIMS)) + r"""
  FROM samp GROUP BY path),
fmt AS (
  SELECT p.path,
    CASE """ + " ".join(f"WHEN a{i} AND n{i} = x{i} AND n{i} >= 2 THEN {d}" for i, d in enumerate(_DELIMS)) + r""" END AS delimiter,
    CASE """ + " ".join(f"WHEN a{i} AND n{i} = x{i} AND n{i} >= 2 THEN n{i}" for i, d in enumerate(_DELIMS)) + r""" ELSE 0 END AS field_count
  FROM (SELECT DISTINCT path FROM doc) p LEFT JOIN gagg g ON g.path = p.path)"""

NAMES = "['Timestamp','Level','Module','Message','Thread','DeviceId','TestCase','RunId','Result']"

EVENTS = r"""
dst AS (SELECT path, line_no, text, regexp_matches(text, '^[A-Z]') AS st FROM doc),
dev AS (
  SELECT path, line_no, text,
         coalesce(max(CASE WHEN st THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  min(line_no) OVER (PARTITION BY path)) AS ev
  FROM dst)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["scan_lines"] = _w(DOC) + "SELECT path, line_no, text FROM doc"
SQL["line_count"] = _w(DOC) + "SELECT path, count(*) AS line_count FROM doc GROUP BY path"
SQL["read_range"] = _w(DOC) + "SELECT path, line_no, text FROM doc WHERE line_no BETWEEN 3 AND 7"
SQL["load_cap"] = _w(DOC) + (
    "SELECT path, count(*) FILTER (WHERE line_no <= 20) AS loaded, count(*) AS total_lines, "
    "count(*) > 20 AS truncated FROM doc GROUP BY path")

SQL["workspace_lines"] = """
WITH wd AS (
  SELECT source, doc_id // 1000 AS blk, doc_id, unnest(range(1, len(parts) + 1)) AS ln, unnest(parts) AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents))
SELECT 'ws/' || source || '/' || CAST(blk AS VARCHAR) || '.log' AS path,
       CAST(row_number() OVER (PARTITION BY source, blk ORDER BY doc_id, ln) AS BIGINT) AS line_no,
       text, 'UTF-8' AS encoding
FROM wd"""

SQL["parse_delimited"] = _w(EVN) + (
    'SELECT path, line_no, true AS is_parsed, "Timestamp", "Level", "Module", "Message", '
    'CAST(NULL AS VARCHAR) AS "RawText" FROM evn')
SQL["parse_delimited_short"] = _w(DOC) + (
    'SELECT path, line_no, ok AS is_parsed, h AS "Head", b AS "Body", t AS "Tail", r AS "RawText" FROM dcsv')
SQL["parse_regex"] = _w(EVN) + f"""
SELECT path, line_no, regexp_matches(raw, '{EV_RX}') AS is_parsed,
  CASE WHEN regexp_matches(raw, '{EV_RX}') THEN regexp_extract(raw, '{EV_RX}', 1) END AS "Timestamp",
  CASE WHEN regexp_matches(raw, '{EV_RX}') THEN regexp_extract(raw, '{EV_RX}', 2) END AS "Level",
  CASE WHEN regexp_matches(raw, '{EV_RX}') THEN regexp_extract(raw, '{EV_RX}', 3) END AS "Module",
  CASE WHEN regexp_matches(raw, '{EV_RX}') THEN regexp_extract(raw, '{EV_RX}', 4) END AS "Message",
  CASE WHEN NOT regexp_matches(raw, '{EV_RX}') THEN raw END AS "RawText"
FROM evr"""
SQL["parse_regex_doc"] = _w(DOC) + f"""
SELECT path, line_no, regexp_matches(text, '{DOC_RX}') AS is_parsed,
  CASE WHEN regexp_matches(text, '{DOC_RX}') THEN regexp_extract(text, '{DOC_RX}', 1) END AS first_word,
  CASE WHEN regexp_matches(text, '{DOC_RX}') THEN regexp_extract(text, '{DOC_RX}', 2) END AS punct,
  CASE WHEN regexp_matches(text, '{DOC_RX}') THEN regexp_extract(text, '{DOC_RX}', 3) END AS rest,
  CASE WHEN NOT regexp_matches(text, '{DOC_RX}') THEN text END AS "RawText"
FROM doc"""
SQL["parse_stats"] = _w(DOC) + (
    "SELECT path, count(*) FILTER (WHERE ok) AS parsed, count(*) FILTER (WHERE NOT ok) AS fallback "
    "FROM dcsv GROUP BY path")
SQL["columns_discovered"] = _w(DOC, f"""
pk AS (SELECT path, line_no, regexp_matches(text, '{DOC_RX}') AS ok FROM doc),
keys AS (
  SELECT path, 'first_word' AS column_name, line_no * 4 AS o FROM pk WHERE ok
  UNION ALL SELECT path, 'punct', line_no * 4 + 1 FROM pk WHERE ok
  UNION ALL SELECT path, 'rest', line_no * 4 + 2 FROM pk WHERE ok
  UNION ALL SELECT path, 'RawText', line_no * 4 FROM pk WHERE NOT ok),
firsts AS (SELECT path, column_name, min(o) AS o FROM keys GROUP BY path, column_name)""") + (
    "SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY o) AS BIGINT) AS position, column_name "
    "FROM firsts")
SQL["format_detect"] = _w(DOC, DETECT) + (
    "SELECT path, CASE WHEN delimiter IS NULL THEN 'Raw' ELSE 'Delimited' END AS kind, delimiter, "
    "CAST(field_count AS BIGINT) AS field_count FROM fmt")
SQL["format_fields"] = _w(DOC, DETECT, f"""
pos AS (SELECT path, unnest(range(1, field_count + 1)) AS i FROM fmt WHERE delimiter IS NOT NULL),
nm AS (SELECT path, i, CASE WHEN i <= 9 THEN {NAMES}[i] ELSE 'Field' || CAST(i AS VARCHAR) END AS field_name
       FROM pos)""") + (
    f"SELECT path, CAST(i AS BIGINT) AS position, field_name, "
    f"{ROLE_CASE} AS role FROM nm")
SQL["parse_detected"] = _w(DOC, DETECT, f"""
dj AS (SELECT d.path, d.line_no, d.text, f.delimiter, f.field_count,
              coalesce(f.delimiter IS NOT NULL AND contains(d.text, f.delimiter), false) AS ok
       FROM doc d LEFT JOIN fmt f ON f.path = d.path),
parsed AS (SELECT path, line_no, text, delimiter, unnest(range(1, field_count + 1)) AS i FROM dj WHERE ok)""") + f"""
SELECT path, line_no, delimiter IS NULL AS is_parsed, 'RawText' AS key, text AS value FROM dj WHERE NOT ok
UNION ALL
SELECT path, line_no, true AS is_parsed,
       CASE WHEN i <= 9 THEN {NAMES}[i] ELSE 'Field' || CAST(i AS VARCHAR) END AS key,
       coalesce(string_split(text, delimiter)[i], '') AS value
FROM parsed"""
SQL["semantic_guess"] = _w(DOC, """
w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS field_name FROM doc)""") + (
    f"SELECT field_name, {ROLE_CASE} AS role FROM w")

_NORM = "lower(regexp_replace(replace({x}, '/', '\\'), '\\\\+$', ''))"
SQL["profile_resolve"] = _w(r"""
pf AS (SELECT DISTINCT '/' || replace(url, '://', '/') AS path FROM pages),
pn AS (SELECT path, """ + _NORM.format(x="path") + r""" AS np FROM pf),
pd AS (SELECT path, np, CASE WHEN contains(np, '\') THEN regexp_extract(np, '^(.*)\\[^\\]*$', 1) ELSE '' END AS dir
       FROM pn),
hosts AS (SELECT DISTINCT regexp_extract(url, '^https://([^/]+)', 1) AS host FROM pages
          WHERE starts_with(url, 'https://blog.')),
da AS (SELECT '/https' AS dir, 'secure' AS profile, 0 AS ordinal
       UNION ALL SELECT '/HTTP/', 'plain', 1
       UNION ALL SELECT '\HTTPS\' || upper(host), 'blog', 2 FROM hosts
       UNION ALL SELECT '/https/' || host || '/en', 'blog-en', 3 FROM hosts),
dan AS (SELECT """ + _NORM.format(x="dir") + r""" AS adir, profile, ordinal FROM da),
dm AS (SELECT pd.path, arg_max(dan.profile, length(dan.adir) * 1000 - dan.ordinal) AS dp
       FROM pd JOIN dan ON pd.dir = dan.adir OR starts_with(pd.dir, dan.adir || '\')
       GROUP BY pd.path),
fo AS (SELECT DISTINCT upper(path) AS file, 'anchored' AS profile FROM pf WHERE contains(path, '#top')),
fm AS (SELECT pn.path, min(fo.profile) AS fp FROM pn JOIN fo ON pn.np = """ + _NORM.format(x="fo.file") + r"""
       GROUP BY pn.path)""") + (
    "SELECT pn.path, coalesce(fm.fp, dm.dp) AS profile FROM pn "
    "LEFT JOIN dm ON dm.path = pn.path LEFT JOIN fm ON fm.path = pn.path")
SQL["parse_multi_profile"] = _w(DOC, """
dp AS (SELECT path, line_no, text,
              CASE WHEN starts_with(path, 'docs/en/') THEN 'doc-csv'
                   WHEN starts_with(path, 'docs/fr/') THEN 'doc-words' END AS profile FROM doc)""") + f"""
SELECT path, line_no, profile, true AS is_parsed, 'RawText' AS key, text AS value FROM dp WHERE profile IS NULL
UNION ALL SELECT path, line_no, profile, false, 'RawText', text FROM dp
  WHERE profile = 'doc-csv' AND NOT contains(text, ',')
UNION ALL SELECT path, line_no, profile, true, 'Head', coalesce(string_split(text, ',')[1], '') FROM dp
  WHERE profile = 'doc-csv' AND contains(text, ',')
UNION ALL SELECT path, line_no, profile, true, 'Body', coalesce(string_split(text, ',')[2], '') FROM dp
  WHERE profile = 'doc-csv' AND contains(text, ',')
UNION ALL SELECT path, line_no, profile, true, 'Tail', coalesce(string_split(text, ',')[3], '') FROM dp
  WHERE profile = 'doc-csv' AND contains(text, ',')
UNION ALL SELECT path, line_no, profile, false, 'RawText', text FROM dp
  WHERE profile = 'doc-words' AND NOT regexp_matches(text, '{DOC_RX}')
UNION ALL SELECT path, line_no, profile, true, 'first_word', regexp_extract(text, '{DOC_RX}', 1) FROM dp
  WHERE profile = 'doc-words' AND regexp_matches(text, '{DOC_RX}')
UNION ALL SELECT path, line_no, profile, true, 'punct', regexp_extract(text, '{DOC_RX}', 2) FROM dp
  WHERE profile = 'doc-words' AND regexp_matches(text, '{DOC_RX}')
UNION ALL SELECT path, line_no, profile, true, 'rest', regexp_extract(text, '{DOC_RX}', 3) FROM dp
  WHERE profile = 'doc-words' AND regexp_matches(text, '{DOC_RX}')"""

SQL["filter_include_value"] = _w(EVN) + "SELECT path, line_no, \"Level\", \"Module\" FROM evn WHERE \"Level\" = 'ERROR'"
SQL["filter_exclude_value"] = _w(EVN) + "SELECT path, line_no, \"Module\" FROM evn WHERE \"Module\" <> 'click'"
SQL["filter_text_any"] = _w(EVN) + (
    "SELECT path, line_no FROM evn WHERE " + _any(EVCOLS, "contains(lower({c}), '\"k\": 1')"))
SQL["filter_text_exclude"] = _w(EVN) + (
    "SELECT path, line_no FROM evn WHERE NOT " + _any(EVCOLS, "contains(lower({c}), 'error')"))
SQL["filter_regex"] = _w(EVN) + "SELECT path, line_no, \"Message\" FROM evn WHERE regexp_matches(\"Message\", ': 9\\d\\}')"
SQL["filter_regex_exclude"] = _w(EVN) + (
    "SELECT path, line_no, \"Level\" FROM evn WHERE NOT regexp_matches(\"Level\", '^(TRACE|DEBUG)$')")
SQL["filter_time_range"] = _w(EVN) + (
    "SELECT path, line_no, \"Timestamp\" FROM evn WHERE date_trunc('millisecond', ts) "
    "BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
SQL["view_filter"] = _w(EVN) + (
    "SELECT path, line_no FROM evf WHERE contains(lower(\"Message\"), 'k\": 1') AND NOT "
    + _any(EVCOLS, "regexp_matches({c}, 'purchase')")
    + " AND is_flagged AND date_trunc('millisecond', ts) BETWEEN TIMESTAMP '2024-01-03 00:00:00' "
      "AND TIMESTAMP '2024-01-20 00:00:00'")
SQL["preset_counts"] = _w(EVN) + (
    "SELECT path, "
    "count(*) FILTER (WHERE " + _any(EVCOLS, "contains(lower({c}), 'error')") + ") AS p_errors, "
    "count(*) FILTER (WHERE is_flagged) AS p_flagged, "
    "count(*) FILTER (WHERE " + _any(EVCOLS, "regexp_matches({c}, '\"k\": 9\\d')") + " AND NOT "
    + _any(EVCOLS, "contains(lower({c}), 'view')") + ") AS p_k9, "
    "count(*) FILTER (WHERE date_trunc('millisecond', ts) BETWEEN TIMESTAMP '2024-01-07 00:00:00' "
    "AND TIMESTAMP '2024-01-14 00:00:00' AND NOT " + _any(EVCOLS, "regexp_matches({c}, '^TRACE$')")
    + ") AS p_window FROM evf GROUP BY path")

SQL["search_matches"] = _w(DOC) + (
    "SELECT path, line_no, 'RawText' AS field, CAST(strpos(lower(text), 'ent') - 1 AS INTEGER) AS match_index "
    "FROM doc WHERE contains(lower(text), 'ent')")
SQL["search_word"] = _w(DOC) + (
    "SELECT path, line_no, 'RawText' AS field, "
    "CAST(length(regexp_extract(text, '^(.*?)\\bThe\\b', 1)) AS INTEGER) AS match_index "
    "FROM doc WHERE regexp_matches(text, '\\bThe\\b')")
SQL["search_fields"] = _w(EVN) + "\nUNION ALL\n".join(
    f"SELECT path, line_no, '{c.strip(chr(34))}' AS field, "
    f"CAST(strpos(lower({c}), 'error') - 1 AS INTEGER) AS match_index FROM evn WHERE contains(lower({c}), 'error')"
    for c in EVCOLS)
SQL["find_next"] = _w(DOC, "hh AS (SELECT path, line_no, contains(text, 'tion') AS hit FROM doc)") + """
SELECT path, line_no,
  coalesce(min(CASE WHEN hit THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
           min(CASE WHEN hit THEN line_no END) OVER (PARTITION BY path)) AS next_match,
  coalesce(max(CASE WHEN hit THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           max(CASE WHEN hit THEN line_no END) OVER (PARTITION BY path)) AS prev_match
FROM hh"""
SQL["nearest_visible"] = _w(DOC, """
vv AS (SELECT path, line_no, contains(lower(text), 'the') AS vis FROM doc),
nb AS (SELECT path, line_no,
         max(CASE WHEN vis THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bef,
         min(CASE WHEN vis THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM vv)""") + """
SELECT path, line_no, CASE WHEN bef IS NULL THEN aft WHEN aft IS NULL THEN bef
                           WHEN line_no - bef <= aft - line_no THEN bef ELSE aft END AS nearest_line FROM nb"""
SQL["search_hidden"] = _w(DOC) + (
    "SELECT path, line_no, NOT contains(lower(text), 'the') AS hidden FROM doc WHERE contains(text, 'tion')")

SQL["flag_lines"] = _w(EVN) + "SELECT path, line_no FROM evf WHERE is_flagged"
SQL["flag_lines_doc"] = _w(DOC) + (
    "SELECT path, line_no FROM dcsv WHERE " + _any(DOCCOLS, "contains(lower({c}), 'password')") + " OR "
    + _any(DOCCOLS, "regexp_matches({c}, '(?i)\\b(secret|token)\\b')") + " OR coalesce(h = 'Le', false)")
SQL["total_flagged"] = _w(EVN) + "SELECT count(*) FILTER (WHERE is_flagged) AS total_flagged FROM evf"
SQL["lookup_flagged_text"] = _w(DOC) + (
    "SELECT path, line_no, text FROM doc WHERE (path, line_no) IN (SELECT path, line_no FROM dcsv WHERE "
    + _any(DOCCOLS, "contains(lower({c}), 'password')") + " OR "
    + _any(DOCCOLS, "regexp_matches({c}, '(?i)\\b(secret|token)\\b')") + " OR coalesce(h = 'Le', false))")
SQL["flag_counts"] = _w(EVN) + (
    "SELECT path, count(*) FILTER (WHERE is_flagged) AS flagged FROM evf GROUP BY ROLLUP (path)")
SQL["row_background"] = _w(EVN) + (
    "SELECT path, line_no, CASE "
    "WHEN date_trunc('millisecond', ts) BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00' "
    "THEN '#1F1F5A' "
    f"WHEN {_any(EVCOLS, 'regexp_matches({c}, ' + _q(REDRX) + ')')} THEN '#5A1F1F' "
    "WHEN \"Module\" = 'signup' THEN '#1F5A1F' "
    f"WHEN {_any(EVCOLS, 'regexp_matches({c}, ' + _q(AMBERRX) + ')')} THEN '#5A4A1F' "
    "END AS row_background FROM evn")
SQL["field_highlight"] = _w(EVN, f"""
hl AS (
  SELECT path, line_no, 'Message' AS field,
         CASE WHEN {_any(EVCOLS, "regexp_matches({c}, '(?i)purchase')")} THEN '#4FA36B'
              WHEN contains(lower("Message"), '"k": 5') THEN '#D9B44A' END AS foreground FROM evn
  UNION ALL
  SELECT path, line_no, 'Level', CASE WHEN "Level" = 'ERROR' THEN '#B23A48' END FROM evn)""") + (
    "SELECT path, line_no, field, foreground FROM hl WHERE foreground IS NOT NULL")

SQL["events_multiline"] = _w(DOC, EVENTS) + (
    "SELECT path, ev AS line_no, CAST(count(*) - 1 AS BIGINT) AS n_continuations, max(line_no) AS last_line "
    "FROM dev GROUP BY path, ev")
SQL["continuation_text"] = _w(DOC, EVENTS) + (
    "SELECT path, ev AS line_no, "
    "string_agg(text, chr(10) ORDER BY line_no) AS continuation_text "
    "FROM dev WHERE line_no <> ev GROUP BY path, ev")
SQL["attach_continuations"] = _w(DOC, EVENTS, """
evc AS (SELECT path, ev, count(*) - 1 AS n FROM dev GROUP BY path, ev)""") + (
    "SELECT d.path, d.line_no, CAST(coalesce(e.n, 0) AS BIGINT) AS n_continuations FROM doc d "
    "LEFT JOIN evc e ON e.path = d.path AND e.ev = d.line_no WHERE contains(lower(d.text), 'the')")
SQL["timestamped_rows"] = _w(EVN) + "SELECT path, line_no, date_trunc('millisecond', ts) AS ts FROM evn"
SQL["events_single"] = _w(DOC) + (
    "SELECT path, line_no, CAST(0 AS BIGINT) AS n_continuations, line_no AS last_line FROM doc")
SQL["level_sort_rank"] = _w(EVN, """
rk AS (SELECT path, line_no, CASE upper("Level") WHEN 'TRACE' THEN 0 WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2
        WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 WHEN 'FATAL' THEN 5 ELSE 6 END AS level_rank FROM evn)""") + (
    "SELECT path, line_no, CAST(level_rank AS INTEGER) AS level_rank, "
    "CAST(row_number() OVER (PARTITION BY path ORDER BY level_rank, line_no) AS BIGINT) AS sort_pos FROM rk")

SQL["align_line"] = _w(EVN, PAIRS, "cnt AS (SELECT path, max(line_no) AS last_line FROM evn GROUP BY path)") + """
SELECT e.path, e.line_no, p.target_path,
  CAST(CASE WHEN coalesce(c.last_line, 0) < 1 THEN 1 ELSE greatest(1, least(e.line_no, c.last_line)) END AS BIGINT)
    AS target_line
FROM evn e JOIN pairs p ON e.path = p.path LEFT JOIN cnt c ON c.path = p.target_path"""
_NEAR = """
near AS (
  SELECT a.path, a.line_no, p.target_path, b.line_no AS target_line, abs(a.us - b.us) AS delta_micros,
         row_number() OVER (PARTITION BY a.path, a.line_no, p.target_path ORDER BY abs(a.us - b.us), b.line_no) AS rk
  FROM evn a JOIN __PAIRS__ p ON a.path = p.path JOIN evn b ON b.path = p.target_path)"""
SQL["align_nearest"] = _w(EVN, PAIRS, _NEAR.replace("__PAIRS__", "pairs")) + (
    "SELECT path, line_no, target_path, target_line, delta_micros FROM near WHERE rk = 1")
SQL["align_fallback"] = _w(EVN, DOC, PAIRS, """
gp AS (SELECT path, target_path FROM pairs
       UNION SELECT 'events/u' || CAST(u.user_id AS VARCHAR) || '.log',
                    'docs/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.log'
             FROM uu u JOIN documents d ON d.doc_id = u.user_id),
cnt AS (SELECT path, max(line_no) AS last_line FROM evn GROUP BY path
        UNION ALL SELECT path, max(line_no) FROM doc GROUP BY path)""", _NEAR.replace("__PAIRS__", "gp")) + """
SELECT e.path, e.line_no, g.target_path,
  coalesce(n.target_line,
           CAST(CASE WHEN coalesce(c.last_line, 0) < 1 THEN 1 ELSE greatest(1, least(e.line_no, c.last_line)) END
                AS BIGINT)) AS target_line,
  n.target_line IS NULL AS used_fallback
FROM evn e JOIN gp g ON e.path = g.path LEFT JOIN cnt c ON c.path = g.target_path
LEFT JOIN (SELECT * FROM near WHERE rk = 1) n ON n.path = e.path AND n.line_no = e.line_no AND n.target_path = g.target_path"""

SQL["status_summary"] = _w(DOC, f"""
st AS (SELECT path, ok, {_any(DOCCOLS, "regexp_matches({c}, '" + FLAGRX + "')")} AS is_flagged,
              {_any(DOCCOLS, "contains(lower({c}), 'the')")} AS shown FROM dcsv)""") + (
    "SELECT path, count(*) FILTER (WHERE shown) AS shown, count(*) AS total, count(*) FILTER (WHERE ok) AS parsed, "
    "count(*) FILTER (WHERE NOT ok) AS fallback, count(*) FILTER (WHERE is_flagged) AS flagged "
    "FROM st GROUP BY ROLLUP (path)")
SQL["append_logs"] = _w(EVN, DOC) + (
    'SELECT path, line_no, raw, "Level" FROM evr UNION ALL SELECT path, line_no, text AS raw, '
    'CAST(NULL AS VARCHAR) AS "Level" FROM doc')
SQL["visible_columns"] = _w(EVN) + (
    'SELECT path, line_no, raw, true AS is_parsed, "Message", "Level" FROM evr')
SQL["export_tsv"] = _w(DOC) + (
    "SELECT path, line_no, concat_ws(chr(9), CAST(line_no AS VARCHAR), coalesce(h, ''), coalesce(b, ''), "
    "coalesce(t, '')) AS tsv FROM dcsv")
SQL["raw_text"] = _w(DOC) + "SELECT path, line_no, coalesce(r, concat_ws(' ', h, b, t)) AS raw_text FROM dcsv"
SQL["line_refs"] = _w(EVN) + (
    "SELECT path, "
    "string_agg(CAST(line_no AS VARCHAR), ', ' ORDER BY line_no) AS line_refs "
    "FROM evf WHERE is_flagged GROUP BY path")

_RENDER = ["%Y-%m-%d %H:%M:%S.%g", "%Y-%m-%d %H:%M:%S,%g", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%g",
           "%Y-%m-%dT%H:%M:%S", "%Y%m%d-%H:%M:%S:%g", "%Y%m%d-%H:%M:%S.%g", "%Y%m%d-%H:%M:%S",
           "%Y/%m/%d %H:%M:%S.%g", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%H:%M:%S.%g", "%H:%M:%S"]


def _expected(f: str) -> str:
    unit = "millisecond" if "%g" in f else "second"
    if f.startswith("%H"):
        return f"TIMESTAMP '1970-01-01 00:00:00' + (date_trunc('{unit}', ts) - date_trunc('day', ts))"
    return f"date_trunc('{unit}', ts)"


SQL["timestamp_formats"] = (
    "SELECT event_id, unnest(range(1, 14)) AS fmt_id, unnest([" + ", ".join(f"strftime(ts, '{f}')" for f in _RENDER)
    + "]) AS text, unnest([" + ", ".join(_expected(f) for f in _RENDER) + "]) AS parsed FROM events")

SQL["field_names_any"] = _w(EVN) + (
    'SELECT path, line_no, "Timestamp" AS "f_Path", "Level" AS f_text, "Module" AS f__kind, "Message" AS f_profile FROM evn '
    """WHERE contains(lower("Timestamp" || chr(10) || "Level" || chr(10) || "Module" || chr(10) || "Message"), 'k": 1')""")
SQL["search_decorated"] = _w(DOC) + " UNION ALL ".join(
    f"SELECT path, line_no, '{name}' AS field, CAST(strpos(lower({col}), 'ru') - 1 AS INTEGER) AS match_index "
    f"FROM dcsv WHERE contains(lower({col}), 'ru')"
    for name, col in (("Head", "h"), ("Body", "b"), ("Tail", "t"), ("RawText", "r")))
SQL["time_only_range"] = """
SELECT 'events/u' || CAST(user_id AS VARCHAR) || '.log' AS path, event_id AS line_no, strftime(ts, '%H:%M:%S.%g') AS "Time",
  event_type AS "Kind"
FROM events WHERE strftime(ts, '%H:%M:%S.%g') BETWEEN '08:00:00.000' AND '17:30:00.000'"""
_LOOSE = (("%b %-d %Y %H:%M:%S", "second"), ("%-m/%-d/%Y %-I:%M:%S %p", "second"), ("%a, %d %b %Y %H:%M:%S GMT", "second"),
          ("%-d %B %Y %H:%M", "minute"), ("%b %-d, %Y", "day"))
SQL["timestamp_loose"] = " UNION ALL ".join(
    f"SELECT event_id, CAST({i} AS BIGINT) AS form, strftime(ts, '{f}') AS text, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS parsed FROM events"
    for i, (f, unit) in enumerate(_LOOSE, start=1))
for _name, _order in (("sort_field", 'coalesce("Message", \'\') DESC, path, line_no'), ("sort_time", "us, path, line_no"),
                      ("sort_restored", "path, line_no")):
    SQL[_name] = _w(EVN) + f"SELECT path, line_no, CAST(row_number() OVER (ORDER BY {_order}) AS BIGINT) AS position FROM evn"
SQL["timestamp_loose"] += """ UNION ALL
SELECT event_id, CAST(6 AS BIGINT) AS form, strftime(ts, '%H:%M') AS text, CAST('1970-01-01 ' || strftime(ts, '%H:%M') || ':00' AS TIMESTAMP) AS parsed FROM events
UNION ALL SELECT event_id, CAST(7 AS BIGINT) AS form, strftime(ts, '%b %-d %H:%M:%S') AS text,
  TRY_CAST('1970-' || strftime(ts, '%m-%d %H:%M:%S') AS TIMESTAMP) AS parsed FROM events"""
SQL["sort_saved"] = _w(EVN) + """SELECT path, line_no,
  CAST(row_number() OVER (ORDER BY coalesce("Module", '') DESC, path, line_no) AS BIGINT) AS position FROM evn"""
SQL["workspace_status"] = f"""
WITH wd AS (
  SELECT source, doc_id // 1000 AS blk, doc_id, unnest(range(1, len(parts) + 1)) AS ln, unnest(parts) AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents)),
n AS (SELECT *, row_number() OVER (PARTITION BY source, blk ORDER BY doc_id, ln) AS line_no FROM wd),
c AS (
  SELECT source, blk, count(*) FILTER (line_no <= 2000 AND contains(lower(text), 'tion')) AS shown, least(count(*), 2000) AS total,
    count(*) FILTER (line_no <= 2000 AND regexp_matches(text, '{FLAGRX}')) AS flagged, count(*) > 2000 AS truncated
  FROM n GROUP BY source, blk)
SELECT 'ws/' || source || '/' || CAST(blk AS VARCHAR) || '.log' AS path, CAST(shown AS BIGINT) AS shown, CAST(total AS BIGINT) AS total,
  CAST(total AS BIGINT) AS parsed, CAST(0 AS BIGINT) AS fallback, CAST(flagged AS BIGINT) AS flagged, 'UTF-8' AS encoding, truncated FROM c"""
SQL["decode_ansi"] = r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\x{A0}-\x{FF}]', '?', 'g') AS text FROM documents"
SQL["profiles_read"] = """
SELECT concat_ws('-', lang, source) AS "Name", 'Delimited' AS "Kind", '|' AS "Delimiter",
  'Time,' || upper(lang) || ',F' || CAST(min(doc_id) AS VARCHAR) AS field_names, 'Timestamp' AS time_role
FROM documents GROUP BY lang, source"""
SQL["rules_read"] = _w(EVN) + r"""
, seen AS (SELECT "Module" AS m, count(*) AS n FROM evn GROUP BY 1)
SELECT path, line_no FROM evn
WHERE "Module" IN (SELECT m FROM seen WHERE n % 2 = 1) OR contains("Message", '"k": ' || (SELECT count(*) FROM seen))
  OR regexp_matches("Message", '(?i)k[^a-zA-Z0-9_]+9')"""
SQL["presets_visible"] = """
SELECT 'p' || CAST(event_id AS VARCHAR) AS name, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) END AS profile_scope
FROM events WHERE event_id % 3 = 0 OR lower(event_type) = 'click'"""
SQL["filter_ignore_case"] = _w(DOC) + "SELECT path, line_no FROM doc WHERE contains(upper(text), 'CIÓN') AND NOT contains(upper(text), 'LOS ')"
SQL["regex_dialect"] = _w(DOC) + r"""
, hits AS (
  SELECT path, line_no, regexp_matches(text, '(^|[^\p{L}\p{N}\p{M}_])[b-df-hj-np-tv-z]{3,}($|[^\p{L}\p{N}\p{M}_])') AS consonants,
    regexp_matches(text, '[\x{C0}-\x{FF}]{2}') AS block,
    len(list_filter(generate_series(97, 122), lambda c: contains(text, 't' || chr(c::INTEGER) || 't' || chr(c::INTEGER)) OR contains(text, 't' || chr(c::INTEGER) || 'ot' || chr(c::INTEGER)))) > 0 AS twice,
    regexp_matches(text, '(^|[^\p{L}\p{N}\p{M}_])the [\p{L}\p{N}\p{M}_]{3}') AS spaced,
    contains(text, 'a{,3}') OR regexp_matches(text, '\.$') AS literal
  FROM doc)
SELECT * FROM hits WHERE consonants OR block OR twice OR spaced OR literal"""
SQL["rule_table"] = _w(DOC) + """
, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM benchmark)
SELECT path, line_no, word FROM doc JOIN words ON contains(upper(text), upper(word))"""
SQL["read_range_indexed"] = """
WITH wd AS (
  SELECT source, doc_id // 1000 AS blk, doc_id, unnest(range(1, len(parts) + 1)) AS ln, unnest(parts) AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents)),
n AS (SELECT source, blk, CAST(row_number() OVER (PARTITION BY source, blk ORDER BY doc_id, ln) AS BIGINT) AS line_no, text FROM wd)
SELECT 'ws/' || source || '/' || CAST(blk AS VARCHAR) || '.log' AS path, line_no, text FROM n WHERE line_no BETWEEN 90 AND 100"""
