"""Cosine similarity of many vectors against reference vectors, best match per class.

A reference table up to ``budget`` bytes (checked) is broadcast as one matrix per
(keys, dimension) and multiplied inside a vectorised UDF: the other columns of the
large side stay in the JVM and nothing is shuffled. A larger reference table is streamed:
vectors are dealt into chunks that fit into a task, each row going to one of them, and every
chunk reads the references in order of their class behind its vectors, keeping running maxima.
Blocks of references whose centre and radius rule out a greater value are passed over.
Neither plan emits a row per pair of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

BROADCAST_BYTES = 64 * 1024 * 1024
#: Vectors of one chunk, as doubles.
CHUNK_BYTES = 128 * 1024 * 1024
#: Least share of the references' bytes in one chunk of vectors: all copies of the references stay within so many times the vectors.
COPIES = 8
#: Values of one matrix product; larger ones are made block by block.
PRODUCT_VALUES = 1 << 21
#: Smallest block of references whose bound is looked at first.
BOUND_ROWS = 8
#: Vectors that are brought to unit length at a time.
UNIT_ROWS = 4096
#: Floor of a vector norm.
EPS = 1e-12

FOUND = "struct<class:array<string>,similarity:array<double>>"


def unit(rows: np.ndarray, mode: str = "max") -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / (np.maximum(norm, EPS) if mode == "max" else norm + 1e-8)


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _grouped(keys: pd.DataFrame, vectors: pd.Series):
    """Row positions per (key values, dimension)."""
    at = keys.reset_index(drop=True).assign(_dim=[-1 if v is None else len(v) for v in vectors])
    return at.groupby(list(at.columns), sort=False, dropna=False).indices.items()


def _blocks(refs: pd.DataFrame, keys: list[str], mode: str) -> dict:
    """Unit matrices per (key values, dimension): (matrix, first row of each class, class names)."""
    out = {}
    for group, rows in _grouped(refs[keys], refs["embedding"]):
        part = refs.iloc[rows].sort_values("class", kind="stable")
        names, starts = np.unique(part["class"].to_numpy(dtype=str), return_index=True)
        out[group] = (unit(matrix(part["embedding"]), mode), starts, names.astype(object))
    return out


def _pieces(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows whose products with ``width`` vectors stay within ``PRODUCT_VALUES``."""
    step = max(1, PRODUCT_VALUES // max(1, width))
    for k in range(0, n, step):
        yield slice(k, min(n, k + step))


def _search(blocks: dict, keys: pd.DataFrame, vectors: pd.Series, best_only: np.ndarray, mode: str) -> pd.DataFrame:
    """Class names and greatest similarities per vector; only the best class where ``best_only``."""
    none = np.empty(0, dtype=object), np.empty(0)
    names_out, sims_out = [none[0]] * len(vectors), [none[1]] * len(vectors)
    vectors = vectors.reset_index(drop=True)
    for group, rows in _grouped(keys, vectors):
        if group not in blocks:
            continue
        ref, starts, names = blocks[group]
        sought = unit(matrix(vectors.iloc[rows]), mode)
        best = np.concatenate([np.maximum.reduceat(sought[p] @ ref.T, starts, axis=1) for p in _pieces(len(rows), len(ref))])
        top = best.argmax(axis=1)
        for k, row in enumerate(rows):
            if best_only[row]:
                names_out[row], sims_out[row] = names[top[k] : top[k] + 1], best[k, top[k] : top[k] + 1]
            else:
                names_out[row], sims_out[row] = names, best[k]
    return pd.DataFrame({"class": names_out, "similarity": sims_out})


def reference_bytes(refs: DataFrame) -> int:
    return refs.agg(F.sum(F.size("embedding").cast("bigint") * 8)).first()[0] or 0


def _spread(df: DataFrame, ids: list[str], found: str, outer: bool) -> DataFrame:
    pairs = F.arrays_zip(F.col(f"{found}.class").alias("class"), F.col(f"{found}.similarity").alias("similarity"))
    return df.select(*ids, F.inline_outer(pairs) if outer else F.inline(pairs))


def similarity(
    vectors: DataFrame, refs: DataFrame, keys: list[str], ids: list[str], mode: str = "max",
    budget: int = BROADCAST_BYTES, chunk_bytes: int = CHUNK_BYTES, best_only: Column | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Greatest cosine per vector and class: ``ids, class, similarity``.

    ``vectors`` has ``keys``, ``embedding`` and the columns ``ids`` to carry along
    (rows that agree in all of them stay separate); ``refs`` has ``keys``, ``class``, ``embedding``. A class whose
    dimension differs from a vector's gives it no row. Where ``best_only`` holds, only the
    best class of the row is returned, the first name on ties. ``keep_unmatched`` returns
    vectors without any class with nulls.
    """
    flag = (F.lit(False) if best_only is None else best_only).alias("_one")
    refs = refs.select(*keys, "class", "embedding").filter(F.col("embedding").isNotNull())
    n_keys = len(keys)
    size = reference_bytes(refs)
    if size <= budget:
        blocks = vectors.sparkSession.sparkContext.broadcast(_blocks(refs.toPandas(), keys, mode))

        @F.pandas_udf(FOUND)
        def search(part: pd.DataFrame) -> pd.DataFrame:
            return _search(
                blocks.value, part.iloc[:, :n_keys], part["embedding"], part["_one"].to_numpy(dtype=bool), mode
            )

        row = F.struct(*[F.col(k) for k in keys], F.col("embedding"), flag)
        return _spread(vectors.select(*ids, search(row).alias("_f")), ids, "_f", keep_unmatched)

    total = vectors.agg(F.sum(F.size("embedding").cast("bigint") * 8)).first()[0] or 0
    return _streamed(vectors.withColumn("_one", flag), refs, keys, ids, mode, chunk_count(total, size, chunk_bytes), keep_unmatched)


def chunk_count(vector_bytes: int, ref_bytes: int, chunk_bytes: int) -> int:
    """Chunks of ``chunk_bytes``, or as large as ``COPIES`` asks for, but then not beyond ``CHUNK_BYTES``."""
    return max(1, math.ceil(vector_bytes / max(chunk_bytes, min(CHUNK_BYTES, ref_bytes / COPIES))))


def _streamed(
    vectors: DataFrame, refs: DataFrame, keys: list[str], ids: list[str], mode: str, n_chunks: int, keep_unmatched: bool,
) -> DataFrame:
    """One exchange: vectors once, references once per chunk of vectors, copied by many tasks."""
    fields = [vectors.schema[c] for c in ids]
    row = F.struct(*ids)
    # two tables of floats stay floats until they are multiplied
    floats = all(df.schema["embedding"].dataType.elementType == FloatType() for df in (vectors, refs))
    kind = "array<float>" if floats else "array<double>"
    left = vectors.select(
        F.pmod(F.xxhash64(*keys, "embedding", row), F.lit(n_chunks)).cast("int").alias("_c"), F.lit(0).alias("_kind"), *keys,
        F.lit(None).cast("string").alias("class"), F.col("embedding").cast(kind), "_one", row.alias("_row"))
    right = refs.repartition(max(n_chunks, refs.sparkSession.sparkContext.defaultParallelism)).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("_c"), F.lit(1).alias("_kind"), *keys, F.col("class").cast("string"),
        F.col("embedding").cast(kind), F.lit(False).alias("_one"), F.lit(None).cast(StructType(fields)).alias("_row"))
    both = left.unionByName(right).repartitionById(n_chunks, F.col("_c")).sortWithinPartitions("_c", "_kind", *keys, "class")
    schema = StructType([*fields, StructField("class", StringType()), StructField("similarity", DoubleType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: _Chunk | None = None
        for batch in batches:
            numbers = batch.column("_c").to_numpy()
            kinds = batch.column("_kind").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers) | np.diff(kinds)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                part = batch.slice(lo, hi - lo)
                if chunk is None or chunk.number != numbers[lo]:
                    if chunk is not None:
                        yield from chunk.rest()
                    chunk = _Chunk(int(numbers[lo]), keys, mode, keep_unmatched)
                if kinds[lo] == 0:
                    chunk.add(part)
                else:
                    yield from chunk.compare(part)
        if chunk is not None:
            yield from chunk.rest()

    return both.mapInArrow(search, schema)


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector of a list column as a view of one array."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [None if null else values[a:b] for a, b, null in
            zip(offsets[:-1], offsets[1:], column.is_null().to_pylist(), strict=True)]


class _Group:
    """Different vectors of one chunk that agree in keys and dimension, and the rows that carry them."""

    def __init__(self) -> None:
        self.vectors: dict[bytes, int] = {}
        self.rows: list[int] = []
        self.of: list[int] = []
        self.one: list[bool] = []

    def close(self, mode: str, dtype: np.dtype = np.dtype(np.float64)) -> None:
        """Unit vectors, made block by block: beside them only the different vectors as they came are held."""
        n = len(self.vectors)
        self.unit = np.empty((n, len(next(iter(self.vectors))) // dtype.itemsize if n else 0))
        vectors, self.vectors = iter(self.vectors), {}
        for lo in range(0, n, UNIT_ROWS):
            part = np.frombuffer(b"".join(islice(vectors, UNIT_ROWS)), dtype).reshape(-1, self.unit.shape[1])
            self.unit[lo : lo + UNIT_ROWS] = unit(part.astype(np.float64), mode)
        self.rows, self.of, self.one = np.array(self.rows), np.array(self.of), np.array(self.one)
        self.each = np.zeros(n, bool)
        self.each[self.of[~self.one]] = True
        self.best, self.name = np.full(n, -np.inf), np.full(n, None, object)
        self.now = np.full(n, -np.inf)
        self.seen = False

    def compare(self, refs: np.ndarray) -> None:
        """Raise the running maxima of the present class."""
        floor = np.where(self.each, self.now, np.maximum(self.now, self.best))
        some = np.arange(len(floor))
        if len(refs) >= BOUND_ROWS and np.isfinite(floor).any():
            centre = refs.mean(axis=0)
            bound = self.unit @ centre + np.sqrt(((refs - centre) ** 2).sum(axis=1).max()) + 1e-9
            some = np.flatnonzero(bound > floor)
        for p in _pieces(len(some), len(refs)):
            rows = some[p]
            self.now[rows] = np.maximum(self.now[rows], (self.unit[rows] @ refs.T).max(axis=1))


class _Chunk:
    def __init__(self, number: int, keys: list[str], mode: str, keep_unmatched: bool):
        self.number, self.keys, self.mode, self.keep_unmatched = number, keys, mode, keep_unmatched
        self.groups: dict[tuple, _Group] = {}
        self.dtype = np.dtype(np.float64)
        self.parts: list[pa.Array] = []
        self.n = 0
        self.present: tuple | None = None
        self.closed = False

    def add(self, batch: pa.RecordBatch) -> None:
        names = list(zip(*(batch.column(k).to_pylist() for k in self.keys), strict=True)) if self.keys else [()] * len(batch)
        self.dtype = np.dtype(batch.schema.field("embedding").type.value_type.to_pandas_dtype())
        for k, (key, vector, one) in enumerate(zip(names, _lists(batch.column("embedding")), batch.column("_one").to_pylist(), strict=True)):
            group = self.groups.setdefault((key, -1 if vector is None else len(vector)), _Group())
            group.rows.append(self.n + k)
            group.of.append(0 if vector is None else group.vectors.setdefault(vector.tobytes(), len(group.vectors)))
            group.one.append(bool(one))
        self.parts.append(batch.column("_row"))
        self.n += len(batch)

    def close(self) -> None:
        if not self.closed:
            self.ids = pa.concat_arrays(self.parts).flatten() if self.parts else []
            self.parts = []
            for (_, dim), group in self.groups.items():
                if dim >= 0:
                    group.close(self.mode, self.dtype)
            self.closed = True

    def compare(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.close()
        names = list(zip(*(batch.column(k).to_pylist() for k in [*self.keys, "class"]), strict=True))
        vectors = _lists(batch.column("embedding"))
        start = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[start]:
                if self.present != names[start]:
                    yield from self.finish()
                    self.present = names[start]
                by_dim: dict[int, list[np.ndarray]] = {}
                for v in vectors[start:k]:
                    by_dim.setdefault(-1 if v is None else len(v), []).append(v)
                for dim, refs in by_dim.items():
                    group = self.groups.get((names[start][:-1], dim))
                    if dim >= 0 and group is not None:
                        group.seen = True
                        group.compare(unit(np.stack(refs).astype(np.float64), self.mode))
                start = k

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The maxima of the present class."""
        if self.present is None:
            return
        for (key, dim), group in self.groups.items():
            if dim < 0 or key != self.present[:-1] or not group.seen:
                continue
            better = group.now > group.best
            group.best[better], group.name[better] = group.now[better], self.present[-1]
            each = ~group.one & np.isfinite(group.now[group.of])
            if each.any():
                yield self.out(group.rows[each], [self.present[-1]] * int(each.sum()), group.now[group.of[each]])
            group.now[:] = -np.inf

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The best classes, and rows that no class fits."""
        self.close()
        yield from self.finish()
        for (_, dim), group in self.groups.items():
            if dim < 0 or not group.seen:
                if self.keep_unmatched:
                    yield self.out(np.array(group.rows), [None] * len(group.rows), None)
            elif group.one.any():
                of = group.of[group.one]
                yield self.out(group.rows[group.one], list(group.name[of]), group.best[of])

    def out(self, rows: np.ndarray, names: list, values: np.ndarray | None) -> pa.RecordBatch:
        sims = pa.array(values) if values is not None else pa.nulls(len(rows), pa.float64())
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in self.ids), pa.array(names, pa.string()), sims],
                                          [*(f"c{k}" for k in range(len(self.ids))), "class", "similarity"])
