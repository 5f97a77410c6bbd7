"""Token counts kept as delta-maintained rollups.

``TokenRollup`` holds additive totals (documents, tokens) by source, language and
tokenizer version.  A batch of changes is a table of signed rows: an insert adds a
document's count, a delete takes it off, a revision does both.  The batch is
summed, written under its batch id and then entered in the commit log; totals are
the sum over committed batches.  A batch id that is committed already is passed
over, one that was written but not committed is written again, so a batch may be
sent any number of times, after any failure, and counts once.  ``compact`` folds
committed batches into one that names them.

Counting runs once per text: the public byte-pair vocabulary (its path is a
parameter; the file is read on the driver and travels with the task) and plain
words.  Only the signed counts are shuffled, summed map-side, so a source with a
third of all rows is one partial row per task.

Defined cases: null and empty texts count as documents with no tokens; null
categories are categories; repeated rows count as often as they occur; totals that
have become zero stay as zero rows; an empty batch is committed and changes nothing.
"""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package
from .common import SLICE_ROWS, stored

KEYS = ("source", "lang", "tokenizer")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_BPE, WORDS = "byte_bpe_50k/1", "words/1"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def count_tokens(df: DataFrame, text_cols: list[str], ranks: dict[bytes, int]) -> DataFrame:
    """``df`` without the texts; for each text column a struct ``n_<column>`` of the
    counts by tokenizer (bpe, words), null where the text is null."""
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c not in text_cols]
    kind = pa.struct([("bpe", pa.int64()), ("words", pa.int64())])
    schema = df.select(*keep, *[F.lit(None).cast("struct<bpe:bigint,words:bigint>").alias(f"n_{c}") for c in text_cols]).schema

    def run(batches):
        import tiktoken
        coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                counts = [pa.array([None if t is None else {"bpe": len(coder.encode_ordinary(t)), "words": len(t.split())}
                                    for t in part.column(c).to_pylist()], kind) for c in text_cols]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + counts, names=[*keep, *[f"n_{c}" for c in text_cols]])

    return df.select(*keep, *text_cols).mapInArrow(run, schema)


# ---- signed changes -----------------------------------------------------------

def _signed(df: DataFrame, counts: str, sign: int, tokenizers: dict[str, str]) -> DataFrame:
    """One row per tokenizer: the keys, +-1 document and +-count tokens."""
    each = F.explode(F.array(*[F.struct(F.lit(version).alias("tokenizer"), F.coalesce(F.col(counts)[field], F.lit(0)).alias("n"))
                               for field, version in tokenizers.items()])).alias("t")
    return df.select("source", "lang", each).select(
        "source", "lang", F.col("t.tokenizer").alias("tokenizer"), F.lit(sign).cast("bigint").alias("documents"),
        (F.col("t.n") * sign).cast("bigint").alias("tokens"))


def inserts(df, counts, tokenizers):
    return _signed(df, counts, 1, tokenizers)


def deletes(df, counts, tokenizers):
    return _signed(df, counts, -1, tokenizers)


def revisions(df, before, after, tokenizers):
    return deletes(df, before, tokenizers).union(inserts(df, after, tokenizers))


# ---- rollup -------------------------------------------------------------------

class TokenRollup:
    """Totals in a folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def commits(self) -> DataFrame:
        """(batch, covers): committed batches and, for folded ones, the batches inside."""
        return self._read("commits", "batch string, covers array<string>")

    def committed(self) -> set[str]:
        rows = self.commits().collect()  # one row a batch
        return {r.batch for r in rows} | {b for r in rows for b in r.covers}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch unless it is committed already; says whether it did."""
        if batch in self.committed():
            return False
        self._write(batch, changes, [])
        return True

    def _write(self, batch: str, changes: DataFrame, covers: list[str]) -> None:
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        name = batch.encode().hex()  # any id makes a valid folder name
        sums.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        log = self.spark.createDataFrame([(batch, covers)], "batch string, covers array<string>")
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def _live(self) -> list[str]:
        """Batches that count: committed and not folded into another."""
        rows = self.commits().collect()
        folded = {b for r in rows for b in r.covers}
        return sorted({r.batch for r in rows} - folded)

    def _deltas(self) -> DataFrame:
        schema = "source string, lang string, tokenizer string, documents bigint, tokens bigint, batch string"
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/deltas/{b.encode().hex()}" for b in live])

    def totals(self) -> DataFrame:
        return self._deltas().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def compact(self) -> None:
        """Folds the live batches into one."""
        live = self._live()
        if len(live) > 1:
            self._write(f"folded-{uuid.uuid4().hex}", self._deltas().drop("batch"), live)


# ---- query --------------------------------------------------------------------

def _without_repeats(text):
    """The text without lines that repeat the line before them; null when there are none."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return F.when(F.size(kept) < F.size(lines), F.array_join(kept, "\n"))


def maintained_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals after three batches over ``documents``: all are inserted; later copies
    of a text (same text, larger id) are deleted; of the others, texts with repeated
    lines are revised to the count without the repeats.  Every batch is sent twice."""
    spark = docs.sparkSession
    versions = {"bpe": BYTE_BPE, "words": WORDS}
    texts = docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("2"), "text").alias("h2"),
                        "text", _without_repeats(F.col("text")).alias("revised"))
    counts = stored(count_tokens(texts, ["text", "revised"], read_ranks(vocabulary)))
    first = counts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    marked = counts.join(first, ["h1", "h2"]).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    rollup = TokenRollup(spark, f"{checkpoint_dir(spark).rstrip('/')}/token-rollup-{uuid.uuid4().hex}")
    batches = [("load", inserts(counts, "n_text", versions)),
               ("withdraw copies", deletes(marked.where("copy"), "n_text", versions)),
               ("revise repeats", revisions(marked.where("not copy and n_revised is not null"), "n_text", "n_revised", versions))]
    for name, changes in [*batches, *batches]:
        rollup.commit(name, changes)
    return rollup.totals()
