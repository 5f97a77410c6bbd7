"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves and each half has its own codebook; a pair of
centroids is a cell.  A query walks the cells by the sum of its two partial inner
products (largest first) with a heap over the two sorted codebooks, until the
visited cells hold the wanted number of entries.  Every entry of those cells is
reranked by its exact inner product, in double precision on the vectors given.

How deep to walk is measured, not guessed: ``calibrate`` compares a bounded sample
of queries with brute force over all rows and takes the depth at which the index
finds ``recall`` of their true neighbours.  Clustered vectors need little, vectors
without structure need much; either way the recall holds.

Layout.  Cells are dealt to shards of about ``SHARD_ROWS`` rows (all cells of a
first-half centroid together, small ones packed, large ones split by a hash of the
id, so a vector that is repeated a million times is spread).  A query travels only
to shards that hold a cell it visits, with the score of the last cell it visits;
the shard derives the cells from that.  A task loads one shard's rows and lets the
queries stream past them, so its memory is bounded by the shard.

Fitted on bounded samples: the codebooks (``FIT_ROWS``) and the depth
(``CALIBRATION_QUERIES``).  Every row is indexed and is a candidate.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or
have no id take no part; vectors of each length are searched among themselves; rows of
one id are rows of their own; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored

NEIGHBOURS = 20
RECALL = 0.95
FIT_ROWS = 20_000
FIT_ROUNDS = 12
CALIBRATION_QUERIES = 128
CELL_ROWS = 12        # wanted mean rows of a cell; codebooks have sqrt(rows / CELL_ROWS) centroids
MAX_CENTROIDS = 256
SHARD_ROWS = 8_192
LEAST_DEPTH = 1_000
SLACK = 1e-9          # roundings of partial sums
STEP = 256            # queries scored at a time


# ---- codebooks ----------------------------------------------------------------

def kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for k in range(0, len(x), 8192):
        out[k:k + 8192] = np.argmax(x[k:k + 8192] @ c.T - half, axis=1)
    return out


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, :self.cut], self.first) * len(self.second) + nearest(x[:, self.cut:], self.second)

    def partial(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of queries with the centroids of each half."""
        return q[:, :self.cut] @ self.first.T, q[:, self.cut:] @ self.second.T


def walk(u: np.ndarray, v: np.ndarray, counts: np.ndarray, depth: int):
    """Cells (i, j) by falling u[i] + v[j], until they hold ``depth`` entries.

    Multi-sequence: the next cells to the right and below enter the heap only when
    both their predecessors have been visited.  Yields (sum, i, j, entries so far).
    """
    order_u, order_v = np.argsort(-u, kind="stable").tolist(), np.argsort(-v, kind="stable").tolist()
    su, sv = [float(u[i]) for i in order_u], [float(v[j]) for j in order_v]
    rows = counts.tolist()
    heap = [(-(su[0] + sv[0]), 0, 0)]
    reached = [0] * len(su)  # columns visited in each line: line a is visited up to reached[a]
    seen = 0
    while heap:
        s, a, b = heapq.heappop(heap)
        i, j = order_u[a], order_v[b]
        seen += rows[i][j]
        reached[a] = b + 1
        yield -s, i, j, seen
        if seen >= depth:
            return
        if a + 1 < len(su) and reached[a + 1] == b:
            heapq.heappush(heap, (-(su[a + 1] + sv[b]), a + 1, b))
        if b + 1 < len(sv) and (a == 0 or reached[a - 1] > b + 1):
            heapq.heappush(heap, (-(su[a] + sv[b + 1]), a, b + 1))


def last_sum(u, v, counts, depth) -> float:
    s = float("-inf")
    for s, _, _, _ in walk(u, v, counts, depth):
        pass
    return s


# ---- rows ---------------------------------------------------------------------

def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, x array<double>): the rows with a proper vector, each under a key of its own."""
    x = F.col(vector_col)
    good = (F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
            & F.exists(x, lambda e: e != 0))
    return stored(df.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
                                        x.cast("array<double>").alias("x")))


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _drawn(df: DataFrame, share: float, word: str) -> DataFrame:
    """The rows whose hashed id falls under the share."""
    return df.where(F.pmod(F.xxhash64("id", F.lit(word)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def best(scores: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int):
    """The k best (score, id) of a query among the rows with a finite score; exact, ties by id."""
    n = int(np.isfinite(scores).sum())
    if n > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k] - SLACK * max(1.0, abs(scores[np.isfinite(scores)]).max())
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.flatnonzero(np.isfinite(scores))
    exact = (x[at] * q).sum(axis=1)  # row by row in one order: equal vectors get equal scores
    order = np.lexsort((ids[at], -exact))[:k]
    return exact[order], ids[at][order], at[order]


# ---- index --------------------------------------------------------------------

@dataclass
class Layout:
    books: Codebooks
    counts: np.ndarray      # rows of each cell
    shard: np.ndarray       # first shard of each first-half centroid
    parts: np.ndarray       # shards it is split into (1: shares a shard with others)

    @property
    def shards(self) -> int:
        return int((self.shard + self.parts).max())


def _lay_out(books: Codebooks, counts: np.ndarray) -> Layout:
    shard, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    now, room = 0, SHARD_ROWS
    for i, n in enumerate(counts.sum(1).tolist()):
        if n > SHARD_ROWS:
            continue
        if n > room:
            now, room = now + 1, SHARD_ROWS
        shard[i], room = now, room - n
    now += 1
    for i, n in enumerate(counts.sum(1).tolist()):
        if n > SHARD_ROWS:
            parts[i] = -(-n // SHARD_ROWS)
            shard[i], now = now, now + parts[i]
    return Layout(books, counts, shard, parts)


def fit(rows: DataFrame, n: int, dims: int) -> Codebooks:
    sample = _drawn(rows, FIT_ROWS / n, "fit").collect()
    if not sample:
        sample = rows.limit(1).collect()
    x = np.array([r.x for r in sorted(sample, key=lambda r: (r.id, r.x))])
    k = int(min(MAX_CENTROIDS, max(1, round((n / CELL_ROWS) ** 0.5)), len(x)))
    cut = (dims + 1) // 2
    return Codebooks(kmeans(x[:, :cut], k), kmeans(x[:, cut:], k) if cut < dims else np.zeros((1, 0)))


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(books.cells(matrix(b.column("x"))))], names=["row", "id", "x", "cell"])

    return rows.select("row", "id", "x").mapInArrow(run, "row bigint, id bigint, x array<double>, cell bigint")


def calibrate(index: DataFrame, queries: DataFrame, n_queries: int, books: Codebooks, counts: np.ndarray, k: int,
              recall: float) -> int:
    """Entries to visit so that ``recall`` of the sampled queries' true neighbours are found."""
    drawn = sorted(_drawn(queries, CALIBRATION_QUERIES / n_queries, "calibrate").collect(), key=lambda r: (r.id, r.x))
    if not drawn:
        drawn = queries.limit(1).collect()
    of, q = np.array([r.row for r in drawn]), np.array([r.x for r in drawn])

    def run(batches):
        for b in batches:
            x, own, cell = matrix(b.column("x")), b.column("id").to_numpy(), b.column("cell").to_numpy()
            if not len(x):
                continue
            scores = q @ x.T
            scores[of[:, None] == b.column("row").to_numpy()[None, :]] = -np.inf
            found = [best(s, own, x, one, k) for s, one in zip(scores, q)]
            many = [len(f[1]) for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(q)), many)), pa.array(np.concatenate([f[1] for f in found])),
                pa.array(np.concatenate([f[0] for f in found])), pa.array(cell[np.concatenate([f[2] for f in found])])],
                names=["q", "id", "score", "cell"])

    near = index.mapInArrow(run, "q bigint, id bigint, score double, cell bigint")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    true: dict[int, list[int]] = {}
    for r in near.withColumn("r", rank).where(F.col("r") <= k).select("q", "cell").collect():
        true.setdefault(r.q, []).append(r.cell)
    needed = []
    u, v = books.partial(q)
    for at, cells in true.items():
        wanted, left = set(cells), {}
        for _, i, j, seen in walk(u[at], v[at], counts, int(counts.sum())):
            c = i * counts.shape[1] + j
            if c in wanted:
                left[c] = seen
                if len(left) == len(wanted):
                    break
        needed += [left[c] for c in cells]
    depth = int(np.quantile(needed, recall, method="higher")) if needed else 0
    return max(depth, LEAST_DEPTH, 2 * k)


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
           recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows, of its vector's length.

    Rows of one id are rows of their own, as queries (each with its ranks) and as candidates.
    """
    ship_package(df.sparkSession)
    rows = usable(df, id_col, vector_col)
    found = df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for r in rows.groupBy(F.size("x").alias("dims")).count().orderBy("dims").collect():  # vectors of one length have products
        found = found.unionByName(_search(rows.where(F.size("x") == r.dims), is_query, r["count"], r.dims, k, recall))
    return found


def _search(rows: DataFrame, is_query: Column, n: int, dims: int, k: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    schema = "query bigint, query_id bigint, vec_id bigint, score double"
    queries = rows.where(is_query)
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    books = fit(rows, n, dims)
    index = stored(assign(rows, books))
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r.cell // counts.shape[1], r.cell % counts.shape[1]] = r["count"]
    depth = calibrate(index, queries, n_queries, books, counts, k, recall)
    plan = _lay_out(books, counts)
    width = counts.shape[1]
    fields = "shard bigint, is_query boolean, row bigint, id bigint, x array<double>, cell bigint, floor double"
    names = ["shard", "is_query", "row", "id", "x", "cell", "floor"]

    def deal_rows(batches):
        for b in batches:
            own, cell = b.column("row").to_numpy(), b.column("cell").to_numpy()
            line = cell // width
            mixed = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard = plan.shard[line] + (mixed % plan.parts[line].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(own), bool)), b.column("row"), b.column("id"), b.column("x"),
                                              b.column("cell"), pa.nulls(len(own), pa.float64())], names=names)

    def deal_queries(batches):
        line_rows = counts.sum(1) > 0
        for b in batches:
            q = matrix(b.column("x"))
            if not len(q):
                continue
            u, v = books.partial(q)
            floor = np.array([last_sum(u[a], v[a], counts, depth) for a in range(len(q))]) - SLACK
            visits = (u + v.max(axis=1)[:, None] >= floor[:, None]) & line_rows
            for s in range(plan.shards):
                lines = np.flatnonzero((plan.shard <= s) & (s < plan.shard + plan.parts))
                at = np.flatnonzero(visits[:, lines].any(axis=1))
                if at.size:
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(at.size, s)), pa.array(np.ones(at.size, bool)), b.column("row").take(take), b.column("id").take(take),
                        b.column("x").take(take), pa.nulls(at.size, pa.int64()), pa.array(floor[at])], names=names)

    def score(batches):
        """Rows arrive by shard, a shard's entries before its queries."""
        shard, held, x, ids, row, cell = None, [], None, None, None, None
        for b in batches:
            keys = b.column("shard").to_numpy()
            kinds = b.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if low == high:
                    continue
                part = b.slice(low, high - low)
                if keys[low] != shard:
                    shard, held, x = keys[low], [], None
                if not kinds[low]:
                    held.append((matrix(part.column("x")).copy(), *[part.column(c).to_numpy().copy() for c in ("id", "row", "cell")]))
                    continue
                if not held:
                    continue
                if x is None:
                    x, ids, row, cell = (np.concatenate([h[i] for h in held]) for i in range(4))
                for at in range(0, part.num_rows, STEP):
                    few = part.slice(at, STEP)
                    q, own, floor = matrix(few.column("x")), few.column("row").to_numpy(), few.column("floor").to_numpy()
                    u, v = books.partial(q)
                    s = q @ x.T
                    s[(u[:, cell // width] + v[:, cell % width] < floor[:, None]) | (own[:, None] == row[None, :])] = -np.inf
                    found = [best(line, ids, x, one, k) for line, one in zip(s, q)]
                    many = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(own, many)), pa.array(np.repeat(few.column("id").to_numpy(), many)),
                        pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[0] for f in found]))],
                        names=["query", "query_id", "vec_id", "score"])

    parts = min(plan.shards, 4 * spark.sparkContext.defaultParallelism) if plan.shards < 4096 else plan.shards
    dealt = index.mapInArrow(deal_rows, fields).union(queries.mapInArrow(deal_queries, fields))
    found = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "is_query").mapInArrow(score, schema)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_of_embeddings(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("id") % 20 == 0)
