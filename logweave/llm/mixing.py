"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are added up per cell (source, language, topic).  The cell weights are raked
to the target share of every source, then language, then topic, round after round,
until no marginal is off by more than ``TOLERANCE``.  A cell's weight over its
tokens says how often its text should be seen; scaled to the token budget and cut at
one (what is cut off goes to the other cells) it is the probability with which each
of the cell's documents is kept.  The draw compares it with a hash of the
document's id and text, so it is the same in every run and on every cluster.

Only the first aggregation and the last lookup see documents.  The raking works on
the cell table, whose size is that of the combinations of categories: up to
``SMALL_CELLS`` rows it runs in one task without a shuffle, beyond that its sums
are shuffled by category and totals are added up over partitions; the arithmetic is
the same, and no task has to take the whole table.

Defined cases: null categories are categories of their own; documents without
tokens (null, empty or blank texts) weigh nothing and are never drawn; a category
without a target gets weight 0, a target without text is left out and the rest
scaled up; targets that contradict each other are met as far as ``ROUNDS`` rounds
bring them, and a warning says how far marginals are off then; repeated rows share one fate; extra columns are kept.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LOG = logging.getLogger(__name__)

MARGINS = ("source", "lang", "topic")
TEMPER = 0.5       # default target of a category: its share of the tokens to this power
BUDGET = 0.5       # share of all tokens to keep
ROUNDS = 60
ROUNDS_A_JOB = 6
TOLERANCE = 1e-11
SMALL_CELLS = 200_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
# Topics by the form of a text: pattern and name, the first that matches; else prose.
TOPICS = ((r"(?:\|[^|\n]*){8}", "tables"), (r"[Ll]icen[sc]ed|License", "legal"), (r"[A-Za-z0-9]@[A-Za-z0-9]", "contacts"),
          (r"[$#%&*]{3}|!!", "noise"))
# What any match of a topic's pattern holds: a plain search that spares most texts the pattern.
HELD = {"tables": "|", "legal": "icen", "contacts": "@"}


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for pattern, name in reversed(TOPICS):
        hit = text.rlike(pattern)
        out = F.when(text.contains(HELD[name]) & hit if name in HELD else hit, name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) for the cells that have tokens."""
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def _with_totals(cells: DataFrame, **sums: Column) -> DataFrame:
    """``cells`` with sums over all of them, as columns."""
    return cells.crossJoin(F.broadcast(cells.agg(*[F.sum(c).alias(n) for n, c in sums.items()])))


def with_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``t_<margin>``: the target share of the cell's category."""
    for m in MARGINS:
        size = F.sum("tokens").over(W.partitionBy(m))
        if m in targets:
            wanted = targets[m].select(F.col("value").alias("_v"), F.col("share").cast("double").alias("_s"))
            cells = cells.join(F.broadcast(wanted), F.col(m).eqNullSafe(F.col("_v")), "left").drop("_v")
            cells = cells.withColumn(f"t_{m}", F.coalesce("_s", F.lit(0.0))).drop("_s").withColumn(f"_n_{m}", size)
        else:
            cells = cells.withColumn(f"_n_{m}", size).withColumn(f"t_{m}", F.pow(F.col(f"_n_{m}").cast("double"), F.lit(TEMPER)))
    # each category counts once: its cells' parts of it add up to one
    cells = _with_totals(cells, **{f"_t_{m}": F.col(f"t_{m}") * F.col("tokens") / F.col(f"_n_{m}") for m in MARGINS})
    cells = cells.withColumns({f"t_{m}": F.col(f"t_{m}") / F.col(f"_t_{m}") for m in MARGINS})
    return cells.drop(*[f"_{x}_{m}" for x in "nt" for m in MARGINS])


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (with targets) with ``weight``: shares that meet the targets, adding up to one."""
    cells = _with_totals(cells, _all=F.col("tokens")).withColumn("weight", F.col("tokens") / F.col("_all")).drop("_all")
    small = cells.count() <= SMALL_CELLS
    done, error = 0, 0.0
    while done < rounds:
        for _ in range(min(ROUNDS_A_JOB, rounds - done)):
            for m in MARGINS:
                held = F.sum("weight").over(W.partitionBy(m))
                cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"t_{m}") / held).otherwise(0.0))
            done += 1
        cells = stored(cells)
        if small:
            cells = cells.coalesce(1)
        off = [F.max(F.abs(F.col(f"s_{m}") - F.col(f"t_{m}"))) for m in MARGINS]
        sums = cells.withColumns({f"s_{m}": F.sum("weight").over(W.partitionBy(m)) for m in MARGINS})
        error = max(x or 0.0 for x in sums.agg(*off).first())
        if error <= TOLERANCE:
            break
    if error > TOLERANCE:
        LOG.warning("marginals are off by up to %.3g after %d rounds", error, done)
    return cells


def with_probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells`` with ``probability`` = min(1, scale * weight / tokens), the scale such
    that the expected tokens are ``budget`` of all."""
    cells = cells.withColumn("ratio", F.col("weight") / F.col("tokens"))
    # cells of too large a ratio are kept whole and the scale rises for the others, until no further cell is whole
    scale, whole = None, -1
    while True:
        kept = F.lit(scale) * F.col("ratio") > 1 if scale is not None else F.lit(False)
        n, tokens, held, weight = cells.agg(F.count(F.when(kept, 1)), F.sum("tokens"), F.sum(F.when(kept, F.col("tokens"))),
                                            F.sum(F.when(~kept, F.col("weight")))).first()
        wanted = budget * (tokens or 0)
        if n == whole or not weight or wanted <= (held or 0):
            break
        whole, scale = n, max(scale or 0.0, (wanted - (held or 0)) / weight)
    cells = cells.withColumn("_scale", F.lit(scale).cast("double"))
    p = F.coalesce(F.least(F.lit(1.0), F.col("_scale") * F.col("ratio")), F.when(F.col("weight") > 0, 1.0).otherwise(0.0))
    return cells.withColumn("probability", p).drop("_scale", "ratio")


def draw(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the document's id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def mix(df: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text",
        budget: float = BUDGET, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """``row`` (the columns of ``df``), source, lang, topic, n_tokens, weight, probability, selected."""
    text = F.col(text_col)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("source"), F.col("lang"),
                     (topic if topic is not None else topic_of(F.coalesce(text, F.lit("")))).alias("topic"),
                     token_count(text).alias("n_tokens"))
    cells = stored(cells_of(rows.select(*MARGINS, "n_tokens")))
    few = cells.count() <= SMALL_CELLS
    if few:
        cells = cells.coalesce(1)
    raked = rake(with_targets(cells, targets or {}))
    fitted = stored(with_probabilities(raked, budget)).select(
        *[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("weight"), F.col("probability"))
    same = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    joined = rows.join(F.broadcast(fitted) if few else fitted, same[0] & same[1] & same[2], "left")
    p = F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(0.0)
    u = draw(F.col("row").getField(id_col), F.col("row").getField(text_col), seed)
    return joined.select("row", *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                         F.coalesce(p, F.lit(0.0)).alias("probability")).withColumn("selected", u < F.col("probability"))


def mixture_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, topic, n_tokens, cell_weight, probability, selected for every document."""
    return mix(docs).select(F.col("row").getField("doc_id").alias("doc_id"), "topic", "n_tokens",
                            F.round("weight", 6).alias("cell_weight"), F.round("probability", 6).alias("probability"), "selected")


def sample(df: DataFrame, targets: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """The drawn rows of ``df``."""
    return mix(df, targets, **options).where("selected").select(*[F.col("row").getField(c).alias(c) for c in df.columns])
