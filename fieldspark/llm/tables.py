"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldspark.scale import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table beside the checkpoints and read it back.

    It cuts the lineage like a checkpoint, but keeps columns prunable.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``store`` returned and nothing reads any more."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: its cleaner does so once the driver's JVM has dropped their plans."""
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def column_bytes(values: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, value by value, without decoding them."""
    if pa.types.is_string(values.type):
        values = values.cast(pa.binary())
    elif pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    for v in values:
        yield v.as_py()


def slices(values, rows: int = 500):
    """A column or batch in short pieces, so that what is built from them stays small."""
    for k in range(0, len(values), rows):
        yield values.slice(k, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
