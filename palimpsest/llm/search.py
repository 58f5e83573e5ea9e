"""Exact top-k search by inner product with pivot-table elimination.

Distances of every vector to a set of pivots are computed once and stored beside it. For a query q
and a candidate v, ``|d(q,p) - d(v,p)|`` bounds their distance from below for every pivot p; the
largest bound over the pivots bounds the inner product from above, as
``2 <q,v> = |q|^2 + |v|^2 - d(q,v)^2``. Candidates are evaluated in the order of that bound, in
steps, until the k-th best score is above all bounds that are left. No candidate is dropped that
the bounds don't exclude, so the answer is exact.

Candidates stay where they are: each task packs its own into blocks of near ones, with the range of
their distances to each pivot, and a block whose range excludes a query is not opened for it. Queries
are broadcast, in chunks of a fixed size, with the k-th score that they reach among the vectors that
the pivots were chosen from; a task carries each query's best from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import giving_back, save_shared

#: Vectors in a block of candidates, and their bytes.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Bytes of the queries that are broadcast at once.
QUERY_BYTES = 16 << 20
#: Pivots, and the vectors that they are chosen from: the first by a hash of the id.
PIVOTS, PIVOT_SAMPLE = 16, 1024
#: Candidates of a query that are evaluated between two looks at the bounds.
STEP = 512
#: Sums up to these are exact as doubles and as 64-bit integers.
EXACT_IN_DOUBLE, EXACT_IN_LONG = 1 << 53, 1 << 63
#: Slack for rounding in the bounds, relative to the norms.
SLACK = 1e-9


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and v: ``floor(scale * x)`` of every component. Vectors that are null or empty or
    hold a null or a number that is not finite take no part."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(scale))).alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The farthest point from those chosen, again and again."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = vectors.astype(float), pivots.astype(float)
    return np.stack([np.sqrt(((x - q) ** 2).sum(1)) for q in p], axis=1) if len(p) else np.zeros((len(x), 0))


class Best:
    """The best candidates of some queries so far. ``floor``: a score that k candidates reach somewhere, or
    None; what is below it need not be kept."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray, k: int):
        self.ids, self.v, self.d, self.k = ids, v, d, k
        self.norm = (v.astype(float) ** 2).sum(1)
        self.most = int(np.abs(v).max(initial=0))
        self.found: list[dict[int, int]] = [{} for _ in ids]
        self.floor: list[int | None] = [None] * len(ids)

    def kind(self, c: np.ndarray) -> type:
        """The fastest numbers in which the products' sums are exact."""
        most = self.most * int(np.abs(c).max(initial=0)) * max(1, c.shape[1])
        return float if most < EXACT_IN_DOUBLE else np.int64 if most < EXACT_IN_LONG else object

    def set_floors(self, ids: np.ndarray, c: np.ndarray) -> None:
        """The k-th score of every query among a few candidates with different ids."""
        kind = self.kind(c)
        x = c.astype(kind)
        for i, q in enumerate(self.v.astype(kind)):
            scores = (x @ q)[ids != self.ids[i]]
            if len(scores) >= self.k:
                self.floor[i] = int(sorted(scores.tolist(), reverse=True)[self.k - 1])

    def see(self, ids: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """Take in a block of candidates."""
        kind, norm = self.kind(c), (c.astype(float) ** 2).sum(1)
        x, q = c.astype(kind), self.v.astype(kind)
        gap = np.maximum(0, np.maximum(d.min(0) - self.d, self.d - d.max(0))).max(axis=1) if d.shape[1] else np.zeros(len(q))
        whole = self._bound(gap, self.norm, norm.max())
        for i in range(len(q)):
            floor = self.floor[i]
            if floor is not None and whole[i] < floor:
                continue
            low = np.abs(d - self.d[i]).max(axis=1) if d.shape[1] else np.zeros(len(c))
            bound = self._bound(low, self.norm[i], norm)
            order = np.argsort(-bound, kind="stable")
            best = self.found[i]
            for a in range(0, len(order), STEP):
                if floor is not None and bound[order[a]] < floor:
                    break
                at = order[a : a + STEP]
                got = x[at] @ q[i]
                if floor is not None:
                    keep = got >= floor
                    at, got = at[keep], got[keep]
                for j, s in zip(at.tolist(), got.tolist(), strict=True):
                    if (v := int(ids[j])) != self.ids[i] and int(s) >= best.get(v, int(s)):
                        best[v] = int(s)
                best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.k])
                if len(best) == self.k:
                    floor = max(min(best.values()), floor if floor is not None else -(1 << 200))
            self.found[i], self.floor[i] = best, floor

    @staticmethod
    def _bound(low, qn, cn):
        """The largest inner product of vectors at least ``low`` apart, from their squared norms."""
        low = np.maximum(0, low - SLACK * (np.sqrt(qn) + np.sqrt(cn) + 1))
        return (qn + cn - low * low) / 2 + SLACK * (qn + cn + 1)

    def rows(self) -> pa.RecordBatch:
        """query_id, vec_id and score of all that is kept; scores beyond 64 bits stand at their ends."""
        flat = [(int(q), v, min(max(s, -EXACT_IN_LONG), EXACT_IN_LONG - 1)) for q, best in zip(self.ids, self.found, strict=True) for v, s in best.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])


def _blocks(df: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Each task's rows as blocks of vectors with one nearest pivot: ids, vectors and pivot distances as bytes."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def close(cell: int) -> pa.RecordBatch:
            ids, v, d = (np.concatenate(x) for x in zip(*held.pop(cell), strict=True))
            kind = next((t for t in ("<i2", "<i4") if v.min() >= np.iinfo(t).min and v.max() <= np.iinfo(t).max), "<i8")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((ids.astype("<i8").tobytes(), pa.binary()), (v.astype(kind).tobytes(), pa.binary()), (d.tobytes(), pa.binary()), (kind, pa.string()))], ["ids", "v", "d", "kind"])

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids, v = part.column("vec_id").to_numpy(), part.column("v").flatten().to_numpy().reshape(-1, dim)
                d = distances(v, pivots)
                nearest = d.argmin(1) if len(pivots) else np.zeros(len(v), int)
                for cell in np.unique(nearest).tolist():
                    at = nearest == cell
                    held.setdefault(cell, []).append((ids[at], v[at], d[at]))
                    if sum(len(x[0]) for x in held[cell]) >= size:
                        yield close(cell)
        for cell in sorted(held):
            yield close(cell)

    return df.mapInArrow(giving_back(pack), "ids binary, v binary, d binary, kind string")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best candidates of every query.

    Both inputs hold vec_id and v, a list of whole numbers; only vectors of one length are compared.
    A candidate with the query's own id is left out, ties go to the smaller id, and repeated rows
    of an id count once, with their best score. Scores beyond 64 bits count as the largest or least
    number of 64 bits. Empty tables give no rows. The different lengths of the queries go to the driver.
    """
    merged = None
    dims = [r[0] for r in queries.select(F.size("v").alias("n")).distinct().collect()]
    for dim in sorted(dims):
        part = top_k_of_length(queries.where(F.size("v") == dim), candidates.where(F.size("v") == dim), dim, k, pivots, pivot_sample)
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = merged.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_length(queries: DataFrame, candidates: DataFrame, dim: int, k: int, n_pivots: int, pivot_sample: int) -> DataFrame:
    spark = candidates.sparkSession
    matrix = lambda rows: np.array([r["v"] for r in rows], np.int64).reshape(-1, dim)
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_sample).collect()  # fits the pivots, and floors of scores
    sample = list({r["vec_id"]: r for r in sample}.values())
    pivots = choose_pivots(matrix(sample).astype(float), n_pivots)
    blocks = save_shared(_blocks(candidates.select("vec_id", "v"), pivots, dim), "blocks")
    asked = save_shared(queries.select("vec_id", "v").distinct(), "queries")
    chunks = max(1, -(-asked.count() * 8 * (dim + len(pivots) + 2) // QUERY_BYTES))
    out = None
    for chunk in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)) == chunk).collect()  # about QUERY_BYTES
        v = matrix(rows)
        best = Best(np.array([r["vec_id"] for r in rows], np.int64), v, distances(v, pivots), k)
        best.set_floors(np.array([r["vec_id"] for r in sample], np.int64), matrix(sample))
        part = _scored(spark, blocks, best, dim, len(pivots))
        out = part if out is None else out.unionByName(part)
    return out


def _scored(spark, blocks: DataFrame, best: Best, dim: int, n_pivots: int) -> DataFrame:
    """query_id, vec_id and score of each task's best candidates of some queries."""
    shared = spark.sparkContext.broadcast(best)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value  # kept by the worker for its next tasks, which begin anew
        mine = Best(start.ids, start.v, start.d, start.k)
        mine.floor = list(start.floor)
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                mine.see(np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["v"], x["kind"]).reshape(-1, dim).astype(np.int64), np.frombuffer(x["d"]).reshape(-1, n_pivots))
        yield mine.rows()

    return blocks.mapInArrow(giving_back(score), "query_id long, vec_id long, score long")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
