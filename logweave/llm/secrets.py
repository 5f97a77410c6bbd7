"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts stand for themselves: assignments of a password, token or key, access
key identifiers, long hexadecimal strings.  Weak parts are reported only when the
parts that complete a credential lie in their scope, that is within ``reach`` code
points: a long mixed token (``key``) needs an identifier (an access key or a user
name); a user name (``user``) needs both a secret and an endpoint (a URL).

Every text is searched whole.  Matches are cut out together with the lengths of
what lies between them, so positions are running sums over a document's matches
(windows over its few match rows; the text itself is never shuffled).  The
interval join of the parts is a sweep: per document, in order of start, the
furthest end so far and (in falling order) the nearest start to come of each role
decide whether a role is in scope.  It is linear in the matches and never emits
pairs, however many parts a document holds.

Defined cases: a null text is empty; repeated rows each get their result; a null
id stays null; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, with_row_key

REACH = 200
LEAST_VALUE = 6
MARK = "[REDACTED]"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_QUOTED_VALUE = "[\"']?\\x20*[:=]\\x20*[\"']?"
# The base patterns of the contract, in its order, letters written in either case.
ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" \
    + _QUOTED_VALUE + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"      # runs of 20 characters and more
HEX = "[0-9a-f]{24,}"
# Parts of the linking method.
KEY = "[A-Za-z0-9/+]{32,}"
USER = "(" + "|".join(map(_either_case, ("user(?:name)?", "login", "account", "client_?id"))) + ")" \
    + _QUOTED_VALUE + "([A-Za-z0-9_.@-]+)"
ENDPOINT = "[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9._:/?&=%-]+"

PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY, "user": USER, "endpoint": ENDPOINT}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
ROLES = {"identifier": ("access", "user"), "secret": ("assign", "hex", "key"), "endpoint": ("endpoint",), "base": tuple(BASE)}


def _matches(text: Column) -> dict[str, Column]:
    """Arrays of matches by kind; weak kinds only where a part they need occurs at all."""
    found = lambda kind: F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    identified = text.contains("AKIA") | text.rlike(USER)
    located = text.contains("://")
    return {
        "assign": found("assign"),
        "access": F.when(text.contains("AKIA"), found("access")).otherwise(none),
        "hex": found("hex"),
        "key": F.when(identified, found("key")).otherwise(none),
        "user": F.when(identified, found("user")).otherwise(none),
        "endpoint": F.when(located, found("endpoint")).otherwise(none),
    }


def _rows_of(kind: str) -> Column:
    """Array of (kind, n, gap, match): each match with the length of the text before it."""
    m, between = f"_m_{kind}", f"_b_{kind}"
    return F.transform(F.col(m), lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("n"),
        F.length(F.get(F.col(between), i)).alias("gap"), x.alias("match")))


def parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per match of every distinct row: key, id, copies, kind, start, stop
    (code points, end exclusive); a row without a match has a null kind."""
    keyed = with_row_key(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", "text")
    cut = keyed.withColumns({f"_m_{k}": c for k, c in _matches(F.col("text")).items()})
    cut = cut.withColumns({f"_b_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("text", F.lit(PATTERNS[k]), -1)) for k in KINDS})
    rows = cut.select("id", "_k1", "_k2", F.concat(*[_rows_of(k) for k in KINDS]).alias("rows"))
    once = rows.groupBy("_k1", "_k2").agg(F.first("id").alias("id"), F.first("rows").alias("rows"), F.count("*").alias("copies"))
    each = once.select("_k1", "_k2", "id", "copies", F.explode_outer("rows").alias("r")).select("_k1", "_k2", "id", "copies", "r.*")
    so_far = W.partitionBy("_k1", "_k2", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    stop = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("match"))


def _proper(kind: Column, match: Column) -> Column:
    """Whether a match counts: long enough values, mixed characters for a key."""
    return (F.when(kind == KINDS.index("assign"), F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE)
            .when(kind == KINDS.index("key"), match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]"))
            .otherwise(kind.isNotNull()))


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``found`` with ``reported``: strong parts, and weak ones whose complement is in scope."""
    of = lambda role: F.col("proper") & F.col("kind").isin(*[KINDS.index(k) for k in ROLES[role]])
    rows = found.withColumn("proper", F.coalesce(_proper(F.col("kind"), F.col("match")), F.lit(False))).drop("match", "gap", "n")
    before = W.partitionBy("_k1", "_k2").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("_k1", "_k2").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    for role in ROLES:
        rows = rows.withColumn(f"end_{role}", F.max(F.when(of(role), F.col("stop"))).over(before))
    for role in ROLES:
        rows = rows.withColumn(f"next_{role}", F.min(F.when(of(role), F.col("start"))).over(after))

    def near(role):
        return F.coalesce(F.col(f"end_{role}") >= F.col("start") - reach, F.lit(False)) | F.coalesce(
            F.col(f"next_{role}") <= F.col("stop") + reach, F.lit(False))

    inside_base = F.coalesce(F.col("end_base") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("next_base") < F.col("stop"), F.lit(False))
    kind = F.col("kind")
    reported = (F.when(kind.isin(*[KINDS.index(k) for k in BASE]), F.lit(True))
                .when(kind == KINDS.index("key"), near("identifier") & ~inside_base)
                .when(kind == KINDS.index("user"), near("secret") & near("endpoint") & ~inside_base)
                .otherwise(F.lit(False)))
    return rows.withColumn("reported", F.col("proper") & reported).select(
        "_k1", "_k2", "id", "copies", "kind", "start", "stop", "reported")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per distinct row: key, id, copies and ``spans``, an array of (start, kind number,
    stop, kind) in order of start and kind."""
    linked = link(parts(df, id_col, text_col), reach)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when(F.col("reported"), F.struct("start", F.col("kind").alias("k"), "stop", name.alias("kind")))
    return linked.groupBy("_k1", "_k2").agg(
        F.first("id").alias("id"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(span)).alias("spans"))


def secrets_of_documents(docs: DataFrame) -> DataFrame:
    """The digest of ``scan`` for every row of ``documents``."""
    found = scan(docs)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["k"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_linked"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars",
           reach: int = REACH, mark: str = MARK) -> DataFrame:
    """``df`` with every reported span replaced; ``count_col`` follows the new text.

    Texts without any part that could be reported pass through; only the others are
    joined with their spans.
    """
    text = F.col(text_col)
    suspect = F.coalesce(text.rlike(ASSIGN) | text.rlike(HEX) | text.rlike(ACCESS) | text.rlike(KEY), F.lit(False))
    some = df.where(suspect)
    spans = scan(some, id_col, text_col, reach).where(F.size("spans") > 0).select("_k1", "_k2", F.explode("spans").alias("s"))
    # overlapping spans become one stretch
    order = W.partitionBy("_k1", "_k2").orderBy("s.start", "s.k")
    reached = F.max("s.stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("s.start") <= reached, 0).otherwise(1)
    stretches = spans.withColumn("fresh", fresh).withColumn(
        "g", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy("_k1", "_k2", "g").agg(
        F.min("s.start").alias("start"), F.max("s.stop").alias("stop")).groupBy("_k1", "_k2").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    cut = boxed(some, id_col, text_col).join(stretches, ["_k1", "_k2"], "left")
    text = F.col("row").getField(text_col)
    chars = F.split(text, "")  # code points; slices of it cost their own length only
    cut = cut.withColumn("chars", F.when(F.col("cuts").isNotNull(), chars)).withColumn("n", F.size("cuts"))
    piece = F.expr("""transform(sequence(0, n), i -> array_join(slice(chars,
        if(i = 0, 1, cast(get(cuts, i - 1).stop as int) + 1),
        greatest(0, if(i = n, size(chars), cast(get(cuts, i).start as int)) - if(i = 0, 0, cast(get(cuts, i - 1).stop as int)))), ''))""")
    cut = cut.withColumn("clean", F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(piece, mark)))
    changed = {text_col: F.col("clean")}
    if count_col and count_col in df.columns:
        count = F.col("row").getField(count_col)
        changed[count_col] = F.when(F.col("cuts").isNull(), count).otherwise(F.length("clean")).cast(df.schema[count_col].dataType)
    out = cut.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])
    return df.where(~suspect).union(out)
