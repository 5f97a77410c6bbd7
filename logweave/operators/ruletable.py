"""Rules kept as a table: thousands of them matched in one pass, telling which ones hit.

``rules (rule_id, how, what, field, any_case)``: ``how`` is ``equals``, ``contains`` or
``regex``; ``field`` NULL looks at any field of a row.  The tests are those of single
rules (``functions.predicates``): a row without the field does not match, and case is
ignored character by character where ``any_case`` is set (``equals`` never ignores it).

All literals go into one Aho-Corasick automaton (a second one for those ignoring case),
so a row costs its length, however many rules there are; equality is a lookup; patterns
stay JVM predicates.  The rules are configuration: their size in bytes is measured, and a
table over ``RULE_BYTES`` is matched in several passes of so many bytes each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import predicates as P
from ..functions.fields import LINE, PATH, FieldSpace, fields_of
from ..plans import rules as R
from ..plans.sizing import materialize, size_in_bytes
from ..session import ship_package

RULE_BYTES = 32 << 20  # of rules that one pass broadcasts
HITS = "rule_hits"
_ENTRIES = "_lw_entries"
_SLICE = 4096


def upper_by_character(text: str) -> str:
    """Upper case of as many characters: what has none of a single character stays."""
    if text.isascii():
        return text.upper()
    return "".join(u if len(u := c.upper()) == 1 else c for c in text)


class Literals:
    """The literal rules of a pass; ``hits`` gives the places of those that match a row."""

    def __init__(self, rules: list[tuple]):
        import ahocorasick
        self.equal: dict[tuple, list[int]] = {}
        self.inside = {}
        self.always: list[tuple[int, str | None]] = []  # an empty text is inside any value
        found: dict[bool, dict[str, list]] = {False: {}, True: {}}
        for at, (how, what, field, any_case) in enumerate(rules):
            if how == R.EQUALS:
                self.equal.setdefault((field, what), []).append(at)
            elif what == "":
                self.always.append((at, field))
            else:
                found[any_case].setdefault(upper_by_character(what) if any_case else what, []).append((at, field))
        for any_case, words in found.items():
            if words:
                made = ahocorasick.Automaton()
                for word, held in words.items():
                    made.add_word(word, held)
                made.make_automaton()
                self.inside[any_case] = made

    def hits(self, entries: list[tuple[str, str]]) -> list[int]:
        out: set[int] = set()
        for field, value in entries:
            for of in (field, None):
                out.update(self.equal.get((of, value), ()))
            out.update(at for at, of in self.always if of is None or of == field)
            for any_case, words in self.inside.items():
                for _, held in words.iter(upper_by_character(value) if any_case else value):
                    out.update(at for at, of in held if of is None or of == field)
        return sorted(out)


def match_rules(rows: DataFrame, rules: DataFrame, fs: FieldSpace | None = None, spark=None, out: str = HITS,
                rule_bytes: int = RULE_BYTES) -> DataFrame:
    """``rows`` with ``rule_hits``: the ids of the rules that match each row, ascending."""
    fs = fs or fields_of(rows)
    session = rows.sparkSession
    ship_package(session)
    kind = rules.schema["rule_id"].dataType
    rules = materialize(rules.select("rule_id", "how", "what", "field", F.coalesce("any_case", F.lit(False)).alias("any_case")).where(
        "rule_id is not null and what is not null"))
    passes = max(1, -(-size_in_bytes(rules) // rule_bytes))
    hits = [f"_lw_hits{k}" for k in range(passes)]
    for k, column in enumerate(hits):  # each pass holds what its share of the rules takes
        share = rules.where(F.pmod(F.xxhash64("rule_id", "what"), F.lit(passes)) == k)
        rows = _one_pass(rows, [tuple(r) for r in share.orderBy("rule_id", "how", "what").collect()], fs, kind, column, spark or session)
    found = F.array_sort(F.array_distinct(F.concat(*[F.col(c) for c in hits])))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (*hits, out)], found.alias(out))


def _one_pass(rows: DataFrame, rules: list[tuple], fs: FieldSpace, kind: T.DataType, out: str, spark) -> DataFrame:
    literal = [r for r in rules if r[1] in (R.EQUALS, R.CONTAINS)]
    other = [r for r in rules if r[1] == R.REGEX]
    unknown = {r[1] for r in rules} - {R.EQUALS, R.CONTAINS, R.REGEX}
    if unknown:
        raise ValueError(f"unknown way to match {sorted(unknown)}")
    listed = T.ArrayType(kind)
    by_pattern = F.array_compact(F.array(*[F.when(P.match_predicate(R.Match(R.REGEX, r[2], r[3], any_case=r[4]), fs, spark), F.lit(r[0]).cast(kind))
                                           for r in other])) if other else F.array().cast(listed)
    if not literal:
        return rows.withColumn(out, by_pattern)
    shared = spark.sparkContext.broadcast(([r[0] for r in literal], [r[1:] for r in literal]))  # at most a pass's bytes

    def run(batches):
        ids, tests = shared.value
        literals = Literals(tests)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                *columns, entries = part.columns
                found = [None if row is None else [ids[k] for k in literals.hits([(e["key"], e["value"]) for e in row if e["value"] is not None])]
                         for row in entries.to_pylist()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(to_arrow_type(kind)))], names=[*part.schema.names[:-1], out])

    given = rows.withColumn(out + "p", by_pattern).withColumn(_ENTRIES, fs.entries())
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(out, listed)])
    done = given.mapInArrow(run, schema)
    return done.withColumn(out, F.concat(F.coalesce(out, F.array().cast(listed)), out + "p")).drop(out + "p")


def rule_hits(rows: DataFrame, rules: DataFrame, fs: FieldSpace | None = None, spark=None) -> DataFrame:
    """One row per rule and line it hits: (path, line_no, rule_id)."""
    return match_rules(rows, rules, fs, spark).select(PATH, LINE, F.explode(HITS).alias("rule_id"))
