"""Grids as runs: only cells with points are stored, all others are gaps.

A row of the grid that holds points is cut into maximal runs of one level, with gaps as runs of the empty level;
consecutive rows without points are one slab over the whole width. Runs cover the grid exactly, so what lies across a
border is found by order alone. The cost follows the points, not the cells: a stray point far away adds a row and two slabs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import bounded_broadcast, cut_lineage
from .components import star_contract, union_roots

#: Runs that are labelled in one task; more are cut into bands of whole rows.
BAND_RUNS = 500_000


def field_runs(cells: DataFrame, spec: DataFrame, by: list[str], empty: str) -> DataFrame:
    """``by, level, j_lo, j_hi, lo, hi`` (all inclusive) covering every grid of ``spec``.

    ``cells`` has ``by, i, j, level`` of the cells with points; all others have the level ``empty``. Neighbouring runs of a row
    may share a level only if a cell with points has the level ``empty``.
    """
    grid = bounded_broadcast(spec.select(*by, "ncol", "nrow"))
    row = Window.partitionBy(*by, "j").orderBy("i")
    same = (F.lag("i").over(row) == F.col("i") - 1) & (F.lag("level").over(row) == F.col("level"))
    marked = cells.select(*by, "j", "i", "level").withColumn("_new", F.when(same, 0).otherwise(1))
    marked = marked.withColumn("_k", F.sum("_new").over(row))
    filled = marked.groupBy(*by, "j", "level", "_k").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))

    order = Window.partitionBy(*by, "j").orderBy("lo")
    filled = filled.join(grid, by).withColumn("_before", F.lag("hi").over(order)).withColumn("_after", F.lead("lo").over(order))

    def run(level, lo, hi):
        return F.struct(level.alias("level"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    lo, hi, gap = F.col("lo"), F.col("hi"), F.lit(empty)
    pieces = F.array(
        run(gap, F.when(F.col("_before").isNull(), F.lit(0)), lo - 1), run(F.col("level"), lo, hi),
        run(gap, hi + 1, F.coalesce(F.col("_after"), F.col("ncol")) - 1))
    pieces = F.filter(pieces, lambda p: p["lo"].isNotNull() & (p["lo"] <= p["hi"]))
    rows = filled.select(*by, F.col("j").alias("j_lo"), F.col("j").alias("j_hi"), F.inline(pieces))

    # a row before the first one lets every slab be what follows a row
    below = cells.select(*by, "j").distinct().unionByName(spec.select(*by, F.lit(-1).alias("j")))
    below = below.withColumn("_next", F.lead("j").over(Window.partitionBy(*by).orderBy("j"))).join(grid, by)
    slabs = below.select(
        *by, (F.col("j") + 1).cast("int").alias("j_lo"), (F.coalesce("_next", "nrow") - 1).cast("int").alias("j_hi"), F.lit(empty).alias("level"),
        F.lit(0).alias("lo"), (F.col("ncol") - 1).cast("int").alias("hi")).filter("j_lo <= j_hi")
    return rows.select(*by, "level", F.col("j_lo").cast("int").alias("j_lo"), F.col("j_hi").cast("int").alias("j_hi"), "lo", "hi").unionByName(slabs)


def touching(j_lo: np.ndarray, j_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of runs that share an edge; runs are sorted by (j_lo, lo) and cover their rows."""
    n, width = len(lo), int(hi.max()) + 2
    start = j_lo * width + lo
    first = np.searchsorted(start, (j_hi + 1) * width + lo, "right") - 1
    last = np.searchsorted(start, (j_hi + 1) * width + hi, "right") - 1
    there = j_lo[first] == j_hi + 1
    count = np.where(there, last - first + 1, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(first, count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    beside = np.flatnonzero((j_lo[1:] == j_lo[:-1]) & (lo[1:] == hi[:-1] + 1))
    return np.concatenate([a, beside]), np.concatenate([b, beside + 1])


def _label(pdf: pd.DataFrame) -> pd.DataFrame:
    """Component of each run of a band: the packed (j, i) of the component's first cell."""
    pdf = pdf.sort_values(["j_lo", "lo"], kind="stable", ignore_index=True)
    j_lo, j_hi, lo, hi = (pdf[c].to_numpy(np.int64) for c in ("j_lo", "j_hi", "lo", "hi"))
    level = pd.factorize(pdf["level"])[0]
    a, b = touching(j_lo - j_lo[0], j_hi - j_lo[0], lo, hi)
    equal = level[a] == level[b]
    root = union_roots(len(pdf), a[equal], b[equal])
    return pdf.assign(component=((j_lo << 32) + lo)[root])


def run_components(runs: DataFrame, by: list[str], band_runs: int = BAND_RUNS) -> DataFrame:
    """``runs`` with ``component``, as ``components`` gives it for cells.

    Bands of whole rows with about ``band_runs`` runs are labelled in a task each (a row is never cut); labels that meet
    across bands are merged by star contraction.
    """
    runs = runs.select(*by, "level", "j_lo", "j_hi", "lo", "hi")
    sizes = cut_lineage(runs.groupBy(*by, "j_lo").agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("j_lo").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bands = sizes.withColumn("_band", F.floor((upto - F.col("_n")) / band_runs)).select(*by, "j_lo", "_band")
    one = bands.filter("_band > 0").isEmpty()
    placed = runs.withColumn("_band", F.lit(0).cast("bigint")) if one else runs.join(bands, [*by, "j_lo"])
    placed = placed.select(*runs.columns, "_band")
    schema = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes) + ", component bigint"
    local = cut_lineage(placed.groupBy(*by, "_band").applyInPandas(_label, schema))
    if one:
        return local.drop("_band")

    edge = Window.partitionBy(*by, "_band")
    rims = local.withColumn("_top", F.max("j_hi").over(edge)).withColumn("_bottom", F.min("j_lo").over(edge))
    label = F.struct(*by, "level", "component")
    none = F.lit(None).cast(local.select(label.alias("x")).schema["x"].dataType)
    events = rims.filter("j_hi = _top").select(*by, (F.col("j_hi") + 1).alias("r"), "lo", label.alias("u"), none.alias("v")).unionByName(
        rims.filter("j_lo = _bottom").select(*by, F.col("j_lo").alias("r"), "lo", none.alias("u"), label.alias("v")))
    # the runs on both sides of a border at every start of one of them
    here = Window.partitionBy(*by, "r").orderBy("lo").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = events.select(F.last("u", ignorenulls=True).over(here).alias("u"), F.last("v", ignorenulls=True).over(here).alias("v"))
    edges = cut_lineage(pairs.filter("u.level = v.level").distinct())
    if edges.isEmpty():
        return local.drop("_band")
    roots = star_contract(edges).select("node", F.col("root.component").alias("_root"))
    merged = local.drop("_band").withColumn("node", label).join(roots, "node", "left")
    return merged.withColumn("component", F.coalesce("_root", "component")).drop("node", "_root")


def first_cells(runs: DataFrame, by: list[str], empty: str) -> DataFrame:
    """``by, i, j``: the first cell of each run of the level ``empty``."""
    return runs.filter(F.col("level") == empty).select(*by, F.col("lo").alias("i"), F.col("j_lo").alias("j"))


def cells_of(runs: DataFrame) -> DataFrame:
    """One row per cell of each run, ``i`` and ``j`` in place of its borders: rows first, spread over the cluster."""
    rows = runs.withColumn("j", F.explode(F.sequence("j_lo", "j_hi"))).drop("j_lo", "j_hi")
    rows = rows.repartition(*[c for c in rows.columns if c not in ("component", "hi")])
    return rows.withColumn("i", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
