"""Quality grades by ordinal cumulative-link regression on hashed text.

Graded ratings come from the labels: 0 poor, 1 sound but toxic, 2 good.  One
weight vector over hashed text features is shared by all grades and ordered
thresholds cut its score: P(grade > g) = logistic(w.x - theta_g), theta rising.
A text gets its expected grade and the tail probability of the best grade, which
decides selection.

Features of a whole text: for its distinct written forms the words in them (lower
case, letters and digits), their beginnings and a rough shape (case, marks at the
ends); and a few bucketed proportions (capitals, letters, repeated words, length).
A form's feature counts the distinct forms that have it, over the root of their
number.  Names are hashed to 64 bits; features of fewer than ``MIN_ROWS`` training
rows are left out, so rare words cost and say nothing.

The classifier is fitted on a bounded sample of labelled rows (about ``FIT_ROWS``,
drawn by a hash of the id); scoring covers every row and every word.  The sample's
matrix stays in Spark, where each step adds up the gradient over partitions; only
vectors over the features reach the driver.

Defined cases: a null or blank text has the one feature of being empty; without
any usable label there is no model, the predictions are null and every row is
kept.  Label rows without a quality are ignored, a missing toxic mark counts as
none, of several labels for an id the lowest grade holds, of several texts the
smallest trains.  Ids may be of any type.  Repeated rows are scored each; own output columns replace those of the input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import SLICE_ROWS, stored, unlike

FIT_ROWS = 5_000
MIN_ROWS = 12
GRADIENT_TASKS = 16
GRADES = 3
PENALTY = 1e-4
ROUNDS = 60
KEEP_TAIL = 0.6
PREFIXES = (3, 4, 5, 6)
CACHED_FORMS = 300_000  # written forms whose score a task remembers

_EDGE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
_CORE = re.compile(r"[^\W_]+")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_NOT_ASCII = bytes(range(128, 256))


def _bucket(share: float) -> int:
    return int(10 * share) if share >= 0.1 else -1 - int(-np.log2(max(share, 1e-4)))


def _shape(form: str) -> str:
    """Case and edge marks of a written form."""
    head, core, tail = _EDGE.match(form).groups()
    case = "-" if not core else "0" if not any(c.isalpha() for c in core) else "A" if core.isupper() and len(core) > 1 \
        else "Aa" if core[0].isupper() else "a"
    return f"{head[:3]}<{case}>{tail[:3]}"


def form_features(form: str) -> list[str]:
    """Names of the features of one written form: words, their beginnings, its shape."""
    names = [f"s:{_shape(form)}"]
    for w in _CORE.findall(form.lower()):
        names.append("w:" + w)
        names += [f"p:{w[:n]}" for n in PREFIXES if len(w) > n]
    return names


def text_features(text: str, forms: list[str], distinct: set[str]) -> list[str]:
    data = text.encode("utf-8", "replace")
    ascii_letters = len(data) - len(data.translate(None, _LETTERS))
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = ascii_letters + len(text) - len(data.translate(None, _NOT_ASCII))  # characters beyond ASCII count as letters
    return [f"#upper:{_bucket(upper / max(1, letters))}", f"#letters:{_bucket(letters / len(text))}",
            f"#distinct:{_bucket(len(distinct) / len(forms))}", f"#size:{int(np.log2(len(forms)))}",
            f"#form:{min(20, len(text) // len(forms))}"]


def number(name: str) -> int:
    return xxhash.xxh64_intdigest(name) - (1 << 63)


def features(text: str | None) -> dict[int, float]:
    """Feature numbers of a whole text and their values."""
    forms = (text or "").split()
    if not forms:
        return {number("#empty"): 1.0}
    distinct = set(forms)
    out: dict[int, float] = {}
    unit = len(distinct) ** -0.5
    for form in distinct:
        for name in form_features(form):
            f = number(name)
            out[f] = out.get(f, 0.0) + unit
    for name in text_features(text, forms, distinct):
        out[number(name)] = 1.0
    return out


# ---- model --------------------------------------------------------------------

@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[int, float]
    thresholds: np.ndarray  # rising, one fewer than grades

    def score(self, text: str | None, forms_seen: dict[str, float]) -> float:
        """w.x, form by form; ``forms_seen`` remembers what forms weigh."""
        forms = (text or "").split()
        get = self.weights.get
        if not forms:
            return get(number("#empty"), 0.0)
        distinct = set(forms)
        if len(forms_seen) > CACHED_FORMS:
            forms_seen.clear()
        total = 0.0
        for form in distinct:
            w = forms_seen.get(form)
            if w is None:
                w = forms_seen[form] = sum(get(number(name), 0.0) for name in form_features(form))
            total += w
        return total * len(distinct) ** -0.5 + sum(get(number(name), 0.0) for name in text_features(text, forms, distinct))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > g) for each row and threshold."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def _logistic(x):
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


def _lbfgs(f, x, rounds: int, memory: int = 10):
    """Minimum of f (value, gradient) by limited-memory BFGS with halved steps."""
    fx, g = f(x)
    pairs: list = []
    for _ in range(rounds):
        d, back = -g, []
        for s, y, r in reversed(pairs):
            a = r * (s @ d)
            back.append(a)
            d = d - a * y
        d = d * (1 / (pairs[-1][2] * (pairs[-1][1] @ pairs[-1][1])) if pairs else 1 / max(1e-9, np.sqrt(g @ g)))
        for (s, y, r), a in zip(pairs, reversed(back)):
            d = d + s * (a - r * (y @ d))
        step, slope = 1.0, g @ d
        nf, ng = f(x + d)
        while nf > fx + 1e-4 * step * slope and step > 1e-6:
            step /= 2
            nf, ng = f(x + step * d)
        s, y = step * d, ng - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        still = abs(fx - nf) <= 1e-7 * abs(fx)
        x, fx, g = x + s, nf, ng
        if still:
            break
    return x


def _scale(squares: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(squares / n, 1e-12) ** 0.25


def _sums(row, col, value, grades, weight, w, theta):
    """Log likelihood of rows, and its slopes along the weights and the thresholds; ``weight`` is by grade."""
    n, i, n_grades = len(grades), np.arange(len(grades)), len(weight)
    weight = weight[grades]
    score = np.bincount(row, w[col] * value, n)
    tail = np.hstack([np.ones((n, 1)), _logistic(score[:, None] - theta), np.zeros((n, 1))])
    slope = tail * (1 - tail)
    p = np.maximum(tail[i, grades] - tail[i, grades + 1], 1e-12)
    by_score = weight * (slope[i, grades] - slope[i, grades + 1]) / p
    by_theta = (np.bincount(grades + 1, weight * slope[i, grades + 1] / p, n_grades + 1)
                - np.bincount(grades, weight * slope[i, grades] / p, n_grades + 1))[1:-1]
    return (weight * np.log(p)).sum(), np.bincount(col, by_score[row] * value, len(w)), by_theta


def _fit(keys: np.ndarray, scale: np.ndarray, counts: np.ndarray, sums, penalty: float, rounds: int) -> OrdinalModel:
    """The model from the rows' number by grade and ``sums(weight by grade, weights, thresholds)``."""
    n, k, n_grades = counts.sum(), len(keys), len(counts)
    weight = (n_grades * (counts / n).clip(1 / n)) ** -0.5
    above = np.array([counts[g + 1:].sum() / n for g in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(1 / above - 1)
    start = np.concatenate([np.zeros(k), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])

    def ordered(x):
        return np.concatenate([x[k:k + 1], x[k:k + 1] + np.cumsum(np.exp(x[k + 1:]))])

    def loss(x):
        w = x[:k]
        gain, by_weight, by_theta = sums(weight, w, ordered(x))
        later = np.cumsum(by_theta[::-1])[::-1] / n
        up = np.concatenate([by_weight / n - penalty * w, later[:1], later[1:] * np.exp(x[k + 1:])])
        return penalty / 2 * (w @ w) - gain / n, -up

    x = _lbfgs(loss, start, rounds)
    return OrdinalModel(dict(zip(keys.tolist(), (x[:k] / scale).tolist())), ordered(x))


def fit_spread(table: DataFrame, keys: np.ndarray, counts: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> OrdinalModel:
    """Penalised maximum likelihood over ``table`` (grade, f), whose rows stay in Spark.

    Columns are scaled by the root of their root mean square, which lets words seen
    in a few rows weigh more than the penalty alone would; grades count by the
    inverse root of their frequency.
    """
    sc, k = table.sparkSession.sparkContext, len(keys)
    known = sc.broadcast(keys)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                cols, values = [], []
                for f in part.column("f").to_pylist():
                    name, value = np.array([x[0] for x in f], np.int64), np.array([x[1] for x in f], np.float32)
                    col = np.minimum(np.searchsorted(known.value, name), k - 1)
                    held = np.flatnonzero(known.value[col] == name)
                    held = held[np.argsort(col[held])]
                    cols.append(col[held].astype(np.int32))
                    values.append(value[held])
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                                                 names=["grade", "col", "value"])

    rows = stored(table.select("grade", "f").mapInArrow(run, "grade int, col array<int>, value array<float>")).coalesce(GRADIENT_TASKS)

    def added(of_rows, n_sums: int) -> np.ndarray:
        """Sums of ``of_rows(grades, row, col, value)`` over all rows."""
        def run(batches):
            total = np.zeros(n_sums)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    col, value = part.column("col"), part.column("value").flatten().to_numpy()
                    row = np.repeat(np.arange(part.num_rows), np.diff(col.offsets.to_numpy()))
                    total += of_rows(part.column("grade").to_numpy(), row, col.flatten().to_numpy(), value)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        out = np.zeros(n_sums)
        for r in rows.mapInArrow(run, "sums binary").collect():
            out += np.frombuffer(bytes(r.sums))
        return out

    scale = _scale(added(lambda grades, row, col, value: np.bincount(col, value * value, k), k), counts.sum())

    def sums(weight, w, theta):
        sent = sc.broadcast((scale, w))

        def of_rows(grades, row, col, value):
            scale, w = sent.value
            gain, by_weight, by_theta = _sums(row, col, (value / scale[col]).astype(np.float32), grades, weight, w, theta)
            return np.concatenate([[gain], by_theta, by_weight])

        got = added(of_rows, 1 + len(theta) + k)
        sent.destroy()
        return got[0], got[1 + len(theta):], got[1:1 + len(theta)]

    return _fit(keys, scale, counts, sums, penalty, rounds)


# ---- operator -----------------------------------------------------------------

def grade(quality, toxic):
    """Column of the graded rating: 0 poor, 1 sound but toxic, 2 good."""
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) != 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = FIT_ROWS, min_rows: int = MIN_ROWS) -> OrdinalModel | None:
    """The model from labelled documents; None when fewer than two grades are there."""
    spark = docs.sparkSession
    ship_package(spark)
    graded = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("string").alias("_id")).agg(
        F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    n = graded.count()
    if not n:
        return None
    share = min(1.0, fit_rows / n)
    drawn = graded.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about fit_rows rows
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "_id")
    rows = rows.groupBy("_id", "grade").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                each = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([list(e.items()) for e in each], pa.map_(pa.int64(), pa.float64()))],
                                                 names=["grade", "f"])

    table = stored(rows.select("grade", "text").mapInArrow(run, "grade int, f map<bigint,double>"))
    counts = np.zeros(GRADES, np.int64)
    for r in table.groupBy("grade").count().collect():
        counts[r.grade] = r["count"]
    if (counts > 0).sum() < 2:
        return None
    least = min(min_rows, max(2, int(counts.sum()) // 50))
    common = table.select(F.explode(F.map_keys("f")).alias("key")).groupBy("key").count().where(F.col("count") >= least)
    keys = np.sort(common.select("key").toPandas()["key"].to_numpy(np.int64))  # features of at least so many drawn rows
    return fit_spread(table, keys, counts)


def score(df: DataFrame, model: OrdinalModel | None, text_col: str = "text",
          names: tuple[str, ...] = ("expected_grade", "p_sound", "p_good")) -> DataFrame:
    """``df`` with ``expected_grade``, ``p_sound`` = P(grade > 0), ``p_good`` = P(grade > 1)."""
    ship_package(df.sparkSession)
    df = df.drop(*names)
    if model is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in names})

    def run(batches):
        seen: dict[str, float] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                tails = model.tails(np.array([model.score(t, seen) for t in part.column(text_col).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1])],
                                                 names=[*part.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]]))


def selected(tail: str = "p_good", keep: float = KEEP_TAIL):
    return F.coalesce(F.col(tail) >= keep, F.lit(True))


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, p_sound, p_good, selected for every document."""
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", "expected_grade", "p_sound", "p_good", selected().alias("selected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose tail probability of the best grade reaches ``KEEP_TAIL``."""
    names = tuple(unlike(docs, n) for n in ("expected_grade", "p_sound", "p_good"))
    return score(docs, train(docs, labels), names=names).where(selected(names[-1])).select(*docs.columns)
