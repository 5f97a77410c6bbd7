"""DuckDB SQL of the registered queries that SQL can express."""

from . import mixing as M
from . import secrets as S
from .decontaminate import SLOP, WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(col: str) -> str:
    return (f"coalesce(regexp_extract_all(translate({col}, '{_UPPER}', '{_LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[])")


OP4 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT item, list_slice(w, s, s + {WINDOW} - 1) AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS s FROM i WHERE len(w) > 0)),
pos AS MATERIALIZED (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
freq AS (SELECT word, count(*) AS n FROM pos GROUP BY word),
grams AS (SELECT g, unnest(g) AS word, generate_subscripts(g, 1) AS o FROM (SELECT DISTINCT g FROM win)),
rare AS (
  SELECT g, arg_min(word, (coalesce(n, 0), o)) AS word, arg_min(o, (coalesce(n, 0), o)) AS o
  FROM grams LEFT JOIN freq USING (word) GROUP BY g),
cand AS MATERIALIZED (
  SELECT pos.rid, rare.g, pos.p - rare.o AS s, list_slice(d.w, pos.p - rare.o + 1, pos.p - rare.o + len(rare.g)) = rare.g
    AND pos.p >= rare.o AS phrase,
    len(list_filter(generate_series(1, len(rare.g)), lambda i: list_contains(list_slice(d.w, greatest(1, pos.p - rare.o + i - {SLOP}),
      greatest(0, pos.p - rare.o + i + {SLOP})), rare.g[i]))) = len(rare.g) AS near
  FROM rare JOIN pos USING (word) JOIN d USING (rid)),
hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(generate_series(s + 1, s + len(g))) AS p FROM cand WHERE phrase) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item) FILTER (phrase) AS n_items, count(DISTINCT item) AS n_near,
    string_agg(DISTINCT item, ',' ORDER BY item) FILTER (phrase) AS ids
  FROM cand JOIN win USING (g) WHERE near GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind_rows(kind: str) -> str:
    p = _quoted(S.PATTERNS[kind])
    return f"""SELECT rid, {S.KINDS.index(kind)} AS k, '{kind}' AS kind, unnest(m) AS match, generate_subscripts(m, 1) AS n, m, b
      FROM (SELECT rid, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS b FROM d) WHERE len(m) > 0"""


_LIST = lambda kinds: ", ".join(str(S.KINDS.index(k)) for k in kinds)
_NEAR = lambda role: (f"EXISTS (SELECT 1 FROM parts o WHERE o.rid = p.rid AND o.k IN ({_LIST(S.ROLES[role])}) "  # noqa: E731
                      f"AND o.start <= p.stop + {S.REACH} AND o.stop >= p.start - {S.REACH})")
_IN_BASE = f"EXISTS (SELECT 1 FROM parts o WHERE o.rid = p.rid AND o.k < {len(S.BASE)} AND o.start < p.stop AND o.stop > p.start)"

OP2 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({' UNION ALL '.join(_kind_rows(k) for k in S.KINDS)}),
placed AS (
  SELECT rid, k, kind, match, list_sum(list_transform(list_slice(b, 1, n), lambda x: length(x)))::BIGINT
    + coalesce(list_sum(list_transform(list_slice(m, 1, n - 1), lambda x: length(x))), 0)::BIGINT AS start FROM raw),
parts AS MATERIALIZED (
  SELECT rid, k, kind, start, start + length(match) AS stop FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(match, {_quoted(S.ASSIGN)}, 2)) >= {S.LEAST_VALUE}
    WHEN 'key' THEN regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[0-9]')
    ELSE true END),
told AS (
  SELECT rid, k, kind, start, kind || ':' || start || ':' || stop AS span FROM parts p
  WHERE k < {len(S.BASE)} OR kind = 'key' AND {_NEAR('identifier')} AND NOT {_IN_BASE}
    OR kind = 'user' AND {_NEAR('secret')} AND {_NEAR('endpoint')} AND NOT {_IN_BASE}),
sums AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    count(*) FILTER (k >= {len(S.BASE)}) AS l, string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(S.BASE)}) AS base,
    string_agg(span, ',' ORDER BY start, k) AS spans
  FROM told GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0)::BIGINT AS n_linked
FROM d LEFT JOIN sums USING (rid)
"""


def _raked(rounds: int) -> str:
    sql = "SELECT *, tokens / sum(tokens) OVER () AS weight FROM targets"
    for _ in range(rounds):
        for m in M.MARGINS:
            sql = f"SELECT * REPLACE (weight * t_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM ({sql})"
    return sql


_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {_quoted(p)}) THEN '{n}'" for p, n in M.TOPICS) + " ELSE 'prose' END"

OP5 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, text, source, lang, {_TOPIC} AS topic, coalesce(len(regexp_extract_all(text, {_quoted(M.WORD)})), 0)::BIGINT AS n_tokens
  FROM documents),
cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
sizes AS (SELECT *, {', '.join(f'sum(tokens) OVER (PARTITION BY {m}) AS n_{m}' for m in M.MARGINS)} FROM cells),
targets AS MATERIALIZED (
  SELECT source, lang, topic, tokens, {', '.join(
      f'pow(n_{m}, {M.TEMPER}) / sum(pow(n_{m}, {M.TEMPER}) * tokens / n_{m}) OVER () AS t_{m}' for m in M.MARGINS)} FROM sizes),
raked AS MATERIALIZED ({_raked(36)}),
ranked AS (
  SELECT *, weight / tokens AS ratio, {M.BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER larger, 0) AS room,
    sum(weight) OVER () - coalesce(sum(weight) OVER larger, 0) AS rest
  FROM raked
  WINDOW larger AS (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scaled AS (
  SELECT *, max(CASE WHEN rest > 0 AND room > 0 AND room / rest * ratio <= 1 THEN room / rest END) OVER () AS scale FROM ranked)
SELECT doc_id, d.topic, n_tokens, round(coalesce(weight, 0), 6) AS cell_weight,
  round(CASE WHEN n_tokens > 0 THEN least(1, scale * ratio) ELSE 0 END, 6) AS probability,
  ('0x' || left(md5('{M.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 13))::BIGINT::DOUBLE / {16 ** 13}
    < CASE WHEN n_tokens > 0 THEN least(1, scale * ratio) ELSE 0 END AS selected
FROM d LEFT JOIN scaled s ON d.source IS NOT DISTINCT FROM s.source AND d.lang IS NOT DISTINCT FROM s.lang AND d.topic = s.topic
"""

# The CRC-32 of a decimal id, byte by byte and bit by bit (3988292384: the reversed polynomial).
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT),
  lambda acc, ch: list_reduce(list_prepend(xor(acc, ch), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (a & 1))), 4294967295::UBIGINT))"""

OP11 = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s,
    ({_CRC32} % 4)::BIGINT AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seq AS MATERIALIZED (
  SELECT o.conv_id AS c, list_concat(coalesce(list_slice(f.s, 1, o.h), []), list_slice(o.s, o.h + 1, len(o.s))) AS s
  FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
pre AS MATERIALIZED (
  SELECT c, len(s) AS n, d, list_slice(s, 1, d) AS key FROM (SELECT c, s, unnest(generate_series(0, len(s))) AS d FROM seq)),
nodes AS MATERIALIZED (
  SELECT d, key, min(c) AS conv_id, count(*)::BIGINT AS n_convs, max(n) = d AS leaf,
    CASE WHEN d > 0 THEN len(regexp_extract_all(key[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM pre GROUP BY d, key),
below AS (
  SELECT p.d, p.key, count(*) FILTER (u.d = p.d + 1) AS n_children, count(*) FILTER (u.leaf) AS n_leaves,
    sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM pre p JOIN nodes u ON u.conv_id = p.c AND u.d >= p.d GROUP BY p.d, p.key)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b ON b.d = v.d AND b.key = v.key
  LEFT JOIN nodes up ON up.d = v.d - 1 AND up.key = list_slice(v.key, 1, v.d - 1)
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS g,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(g, 1, 8))::BIGINT % (len(u) + 1) AS c1,
    ('0x' || substr(g, 9, 8))::BIGINT % (len(u) + 1) AS c2, ('0x' || substr(g, 17, 8))::BIGINT % 100 AS h3,
    ('0x' || substr(g, 25, 8))::BIGINT % 100 AS h4 FROM d),
p AS (
  SELECT *, coalesce(array_to_string(list_slice(u, 1, least(c1, c2)), ''), '') AS pre,
    coalesce(array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), ''), '') AS mid,
    coalesce(array_to_string(list_slice(u, greatest(c1, c2) + 1, n), ''), '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain'
      WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

SQL: dict[str, str] = {
    "op5_source_mixing": OP5,
    "op2_secret_scan": OP2,
    "op4_benchmark_decontamination": OP4,
    "op11_prefix_trie": OP11,
    "op13_fill_in_middle": OP13,
}
