"""Language identification by compression.

Every language has raw-content Zstandard dictionaries made of training text.  A
text is encoded with each language's dictionaries; the language whose dictionaries
give the smallest code wins, and the margin to the second says how sure that is.

Training: a bounded sample of labelled rows, drawn by a hash of the text so that
it does not depend on row order or partitioning.  ``dictionary_bytes`` and
``shards`` bound it: each language gets up to ``shards`` dictionaries of that many
bytes (several smaller codes give a finer measure than one, which short texts
need).  Languages with more text are thinned to the same bound; only the sample
reaches the driver.

Coding: texts are brought to lower case, marks other than letters become one
blank, and the whole text is encoded in pieces of ``piece`` bytes so that a long
text is judged by the dictionaries throughout and not by its own beginning.
Prediction sees the text and nothing else.

Defined cases: a null text or one without a letter is ``und`` with score 0; a
table without any labelled row learns nothing and every text is ``und``; ties go
to the language with more training text, then by name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import SLICE_ROWS, has_letter

UNDETERMINED = "und"
DICTIONARY_BYTES = 100_000
SHARDS = 2
PIECE = 1_000
EXCERPT = 300          # characters of one training text that may enter a dictionary
LEVEL = 6
NARROW = 0.01          # margin under which the general operator rejects
SHARPNESS = 0.35       # nats a byte of difference counts for in the score

_NOT_LETTERS = regex.compile(r"\P{L}+")


def normal(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary contents per language, languages ordered by training text, then name."""
    contents: dict[str, list[bytes]]
    level: int = LEVEL
    piece: int = PIECE

    def coders(self) -> dict[str, list[zstandard.ZstdCompressor]]:
        """Compressors per language, one a dictionary."""
        made: dict[str, list] = {}
        for lang, parts in self.contents.items():
            made[lang] = []
            for content in parts:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                made[lang].append(zstandard.ZstdCompressor(
                    level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def sizes(self, text: bytes, coders) -> dict[str, float]:
        """Mean code length in bytes over the language's dictionaries."""
        pieces = [text[k:k + self.piece] for k in range(0, len(text), self.piece)]
        return {lang: sum(len(c.compress(p)) for c in cs for p in pieces) / len(cs) for lang, cs in coders.items()}

    def judge(self, text: str | None, coders) -> tuple[str, float, float]:
        """(best language, score, margin): score is a soft minimum over the code lengths,
        margin the relative distance of the two smallest."""
        data = normal(text) if text else b""
        if not data or not self.contents:
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(data, coders)
        best = min(sizes, key=sizes.get)  # the first of equals
        low = sizes[best]
        others = [s for lang, s in sizes.items() if lang != best]
        score = 1.0 / (1.0 + sum(math.exp(min(0.0, (low - s) * SHARPNESS)) for s in others))
        return best, score, (min(others) - low) / low if others else 1.0


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
          dictionary_bytes: int = DICTIONARY_BYTES, shards: int = SHARDS, excerpt: int = EXCERPT) -> LanguageModel:
    """Dictionaries from rows with a language and a letter in their text.

    The sample holds about ``2 * shards * dictionary_bytes`` characters a language.
    """
    rows = df.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        F.col("l").isNotNull() & has_letter(F.col("t")))
    known = {r[0]: r[1] for r in rows.groupBy("l").agg(
        F.sum(F.least(F.length("t"), F.lit(excerpt)))).orderBy(F.desc(F.sum(F.least(F.length("t"), F.lit(excerpt)))), "l").collect()}
    if not known:
        return LanguageModel({})
    wanted = 2 * shards * dictionary_bytes
    share = F.create_map(*[x for lang, n in known.items() for x in (F.lit(lang), F.lit(min(1.0, wanted / n)))])
    draw = (F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)) < F.element_at(share, F.col("l"))
    # an excerpt starts anywhere in a long text, not always at its head
    begin = F.pmod(F.xxhash64("t", F.lit("at")), F.greatest(F.lit(1), F.length("t") - excerpt)).cast("int") + 1
    texts: dict[str, list[str]] = {lang: [] for lang in known}
    picked = rows.where(draw).select("l", F.xxhash64("t", F.lit("order")).alias("h"), F.substring("t", begin, F.lit(excerpt)).alias("e"))
    for r in picked.distinct().orderBy("l", "h", "e").collect():
        texts[r.l].append(r.e)
    contents = {}
    for lang in known:
        parts, now = [], b""
        for t in texts[lang]:
            if len(parts) == shards:
                break
            now += b" " + normal(t)
            if len(now) >= dictionary_bytes:
                parts.append(now[:dictionary_bytes])
                now = b""
        if len(parts) < shards and len(now) >= 8 and (not parts or len(now) > dictionary_bytes // 2):
            parts.append(now)
        if parts:
            contents[lang] = parts
    return LanguageModel(contents)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """``df`` with ``lang_best``, ``lang_score``, ``lang_margin`` and ``lang_id``: the
    language, or ``und`` where the margin is narrower than ``narrow``."""
    ship_package(df.sparkSession)
    kind = "lang_best string, lang_score double, lang_margin double"
    df = df.drop("lang_best", "lang_score", "lang_margin", "lang_id")  # own columns replace those of the input

    def run(batches):
        coders = model.coders()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                out = [model.judge(t, coders) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()),
                     pa.array([o[2] for o in out], pa.float64())],
                    names=[*part.schema.names, "lang_best", "lang_score", "lang_margin"])

    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(kind).fields])
    found = df.mapInArrow(run, schema)
    sure = F.when(F.col("lang_margin") >= narrow, F.col("lang_best")).otherwise(F.lit(UNDETERMINED))
    return found.withColumn("lang_id", sure)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, accepted for every document."""
    model = train(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                        F.col("lang_best").alias("lang_pred"), F.col("lang_score").alias("score"),
                        F.col("lang_margin").alias("margin"), (F.col("lang_id") != UNDETERMINED).alias("accepted"))
