"""Helpers that keep plans healthy when tables are large or skewed.

* ``cut_lineage``   - reliable checkpoint for iterative operators,
* ``bounded_broadcast`` - broadcast hint only behind a checked row count,
* ``split_hot``     - separate groups that are too large for one task.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest group (rows) that an operator may hold in one array / one task.
GROUP_LIMIT = 8192
#: Largest side (rows) that may be broadcast.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only a local
    session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table beside the checkpoints."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that a lost executor does not replay every round."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its size is checked; else leave the join to AQE.

    The unhinted join shuffles both sides and relies on AQE's skew-join splitting.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    ``withColumn`` lets the optimizer paste an expression into each of its uses, which
    grows without bound for chained box arithmetic. A one-element generator is not
    pasted and stays in the generated code.
    """
    row = F.struct(*[c.alias(n) for n, c in values.items()])
    return df.select(*[F.col(c) for c in df.columns if c not in values], F.inline(F.array(row)))


def split_hot(df: DataFrame, keys: list[str], limit: int = GROUP_LIMIT):
    """Split ``df`` into (groups of <= limit rows, rows of larger groups or None).

    Sizes come from a partially aggregated count, so a hot key costs one small
    record per map task. Null keys form a group of their own.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = cut_lineage(sizes.select(*keys))
    if hot.isEmpty():
        return df, None
    hot = bounded_broadcast(hot)
    cond = same_keys(df, hot, keys)
    return df.join(hot, cond, "left_anti"), df.join(hot, cond, "left_semi")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on ``keys``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
