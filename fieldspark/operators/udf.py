"""Pluggable models: embedders and proposers over Arrow batches.

The factory runs once per task; model code stays with the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec


def embed(
    df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], np.ndarray]], in_cols: list[str], dim: int,
    batch: int = 32, out: str = "embedding",
) -> DataFrame:
    """Adds unit vectors of length ``dim``: ``factory()`` gives ``fn(rows) -> (N, dim)``."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = np.asarray(fn(part[in_cols]), dtype=np.float32)
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"embedder returned {vectors.shape}, expected {(len(part), dim)}")
                yield part.assign(**{out: list(vectors)})

    raw = df.mapInPandas(run, schema)
    return raw.withColumn(out, vec.l2_normalize(F.col(out)).cast("array<float>"))


def propose(
    df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], Iterable[pd.DataFrame]]], schema: str, batch: int = 32
) -> DataFrame:
    """1-to-N: ``factory()`` gives ``fn(rows) -> frames`` of ``schema``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                yield from fn(pdf.iloc[at : at + batch])

    return df.mapInPandas(run, schema)
