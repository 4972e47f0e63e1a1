"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to a set of pivots are computed once. By the triangle inequality the largest difference between
a query's and a candidate's distances to one pivot is a lower bound of their distance, and with both lengths an upper bound of their
inner product. Candidates are evaluated in the order of that bound, until it falls below the k-th score found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import store

PIVOTS = 32
#: Vectors from which the pivots are chosen and the first thresholds taken.
SAMPLE = 2048
#: Queries that are searched for in one pass over the pivot table.
BLOCK = 1024
#: Candidates whose bounds are computed at a time.
ROWS = 2048
#: Bits of the largest component that are squared as they are.
LARGE_BITS = 400


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) as doubles. Null ids and vectors with null or non-finite components go."""
    big = float("inf")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < big))
    return vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(F.col(vector), lambda x: _floor(x.cast("double") * scale)).alias("x"))


def _floor(x):
    # floor() gives a bigint; beyond it doubles are whole already
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    at = 0
    for row, n in zip(out, lengths, strict=True):
        row[:n] = flat[at:at + n]
        at += n
    return out


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles while they fit, else as Python integers held to 64 bits."""
    with np.errstate(over="ignore"):
        most = np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < 1 << 53:
        return (rows @ q).astype(np.int64)
    mine = [int(v) for v in q]
    whole = [sum(a * int(b) for a, b in zip(mine, row, strict=True)) for row in rows]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in whole], np.int64)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(x), 0))


def unit_of(most: float) -> float:
    """The power of two in which vectors are measured, so that squares of components up to ``most`` stay finite."""
    return 2.0 ** max(0, math.frexp(most)[1] - LARGE_BITS)


def upper_bounds(q: np.ndarray, dq: np.ndarray, x: np.ndarray, dx: np.ndarray, unit: float = 1.0) -> np.ndarray:
    """[candidates, queries]: no inner product, held to 64 bits, is larger. A little is added for rounding.

    Distances are given in ``unit``.
    """
    q, x = q / unit, x / unit
    lower = np.zeros((len(x), len(q)))
    for p in range(dx.shape[1]):
        np.maximum(lower, np.abs(dx[:, p, None] - dq[None, :, p]), out=lower)
    own, other = (q * q).sum(1), (x * x).sum(1)
    room = own[None, :] + other[:, None]
    with np.errstate(over="ignore"):  # an infinite bound rules nothing out
        return np.maximum(((room - lower * lower) / 2 + 1e-9 * room + 1e-3) * unit * unit, -float(1 << 63))


class Best:
    """The k best (score, id) of one query: higher scores first, then smaller ids."""

    def __init__(self, k: int, least: int | None):
        self.k, self.least = k, least  # a score that k candidates are known to reach
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def need(self) -> float:
        """No candidate below this score can be among the best."""
        full = self.scores[self.k - 1] if len(self.scores) == self.k else None
        known = [v for v in (full, self.least) if v is not None]
        return max(known) if known else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.need()
        scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, ~scores))[:self.k]  # ~s falls as s rises and cannot overflow
        self.scores, self.ids = scores[order], ids[order]


def search(
    best: list[Best], q_ids: np.ndarray, q: np.ndarray, dq: np.ndarray, ids: np.ndarray, x: np.ndarray, dx: np.ndarray,
    unit: float = 1.0,
) -> int:
    """Add a batch of candidates to the best of each query; returns how many products were computed."""
    bounds = upper_bounds(q, dq, x, dx, unit)
    done = 0
    for k, b in enumerate(best):
        hope = np.flatnonzero((bounds[:, k] >= b.need()) & (ids != q_ids[k]))
        hope = hope[np.argsort(-bounds[hope, k], kind="stable")]
        at, step = 0, 4 * b.k
        while at < len(hope) and bounds[hope[at], k] >= b.need():
            part = hope[at:at + step]
            b.add(products(q[k], x[part]), ids[part])
            done += len(part)
            at, step = at + step, 2 * step
    return done


def top_k(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024,
    pivots: int = PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id ``every`` divides, the ``k`` highest inner products.

    Components become floor(scale * x). Ties go to the smaller id. Rows with the query's own id are no candidates;
    rows that share an id count once, as the smallest vector; shorter vectors count as ending in zeros; vectors that are null or hold
    null or non-finite components take no part; scores beyond 64 bits are held to that range.

    Queries, a fixed part of all rows, are searched for in blocks of about ``block``, each in one pass over the
    pivot table; a task returns only candidates that reach the k-th score of a bounded sample.
    """
    spark = vectors.sparkSession
    base = store(whole_numbers(vectors, vec_id, vector, scale).groupBy("vec_id").agg(F.min("x").alias("x")), "whole-vectors")
    picked = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    facts = base.agg(
        F.max(F.size("x")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("queries"),
        F.max(F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))).alias("most")).first()
    width, unit = facts.width or 0, unit_of(facts.most or 0.0)
    sample = np.zeros((len(picked), width))
    for row, r in zip(sample, picked, strict=True):
        row[:len(r.x)] = r.x
    sample_ids = np.array([r.vec_id for r in picked], np.int64)
    chosen = choose_pivots(sample / unit, pivots)
    shared = spark.sparkContext.broadcast(chosen)
    sampled = spark.sparkContext.broadcast((sample_ids, sample))

    @F.arrow_udf("long")
    def reached(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, xs in columns:
            rows = zip(ids.to_pylist(), _matrix(xs, width), strict=True)
            yield pa.array([_kth(*sampled.value, i, v, k) for i, v in rows], pa.int64())

    @F.arrow_udf("array<double>")
    def to_pivots(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for xs in columns:
            d = distances(_matrix(xs, width) / unit, shared.value)
            yield pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], pa.array(d.reshape(-1)))

    pivot_table = store(base.withColumn("d", to_pivots("x")), "pivot-table")
    blocks = max(1, -(-facts.queries // block))
    found = None
    for number in range(blocks):
        queries = pivot_table.filter(F.col("vec_id") % every == 0)
        if blocks > 1:
            queries = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number)
        rows = {r.vec_id: r for r in queries.withColumn("least", reached("vec_id", "x")).orderBy("vec_id").collect()}  # about ``block`` rows
        q = np.zeros((len(rows), width))
        for row, r in zip(q, rows.values(), strict=True):
            row[:len(r.x)] = r.x
        q_ids = np.array(list(rows), np.int64)
        dq = np.array([r.d for r in rows.values()]).reshape(len(rows), len(chosen))
        least = [r.least for r in rows.values()]
        part = _pass(pivot_table, spark.sparkContext.broadcast((q_ids, q, dq, least)), width, k, unit)
        part = store(part, "found") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(sample_ids: np.ndarray, sample: np.ndarray, query_id: int, q: np.ndarray, k: int) -> int | None:
    """A score that k sampled candidates reach."""
    others = sample[sample_ids != query_id]
    return int(np.sort(products(q, others))[-k]) if len(others) >= k else None


def _pass(pivot_table: DataFrame, shared, width: int, k: int, unit: float) -> DataFrame:
    """One pass over the pivot table: each task's best candidates of every query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, dq, least = shared.value
        best = [Best(k, v) for v in least]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                if len(best):
                    search(best, q_ids, q, dq, ids, _matrix(part.column(1), width), _matrix(part.column(2), dq.shape[1]), unit)
        n = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(q_ids, n), pa.int64()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *[b.ids for b in best]]), pa.int64()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *[b.scores for b in best]]), pa.int64()),
        ], ["query_id", "vec_id", "score"])

    return pivot_table.select("vec_id", "x", "d").mapInArrow(scan, "query_id long, vec_id long, score long")
