"""Cells over boxes, for equi-joins in place of pairwise comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..scale import bounded_broadcast, cut_lineage


def cell_side(b: Column, factor: float = 8.0) -> Column:
    """Aggregate expression: a cell side that keeps the number of (box, cell) rows small.

    With side >= factor * mean(longer edge) and side >= sqrt(mean area), the mean
    number of cells per box is at most 1 + 2/factor + 1, whatever the distribution.
    """
    w, h = F.abs(b["x2"] - b["x1"]), F.abs(b["y2"] - b["y1"])
    return F.greatest(F.avg(F.greatest(w, h)) * factor, F.sqrt(F.avg(w * h)), F.lit(1e-6))


def _span(lo: Column, hi: Column, side: Column) -> tuple[Column, Column]:
    a, b = F.floor(lo / side), F.floor(hi / side)
    return F.least(a, b), F.greatest(a, b)


def n_cells(b: Column, side: Column) -> Column:
    x0, x1 = _span(b["x1"], b["x2"], side)
    y0, y1 = _span(b["y1"], b["y2"], side)
    return (x1 - x0 + 1) * (y1 - y0 + 1)


def to_cells(df: DataFrame, b: Column, side: Column) -> DataFrame:
    """One row per cell that the (closed) box touches: boxes that share a point share a cell."""
    x0, x1 = _span(b["x1"], b["x2"], side)
    y0, y1 = _span(b["y1"], b["y2"], side)
    return df.withColumn("_cx", F.explode(F.sequence(x0, x1))).withColumn("_cy", F.explode(F.sequence(y0, y1)))


def meets_here(a: Column, b: Column, side: Column) -> Column:
    """True in exactly one of the cells two overlapping boxes share."""
    px, py = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    return (F.floor(px / side) == F.col("_cx")) & (F.floor(py / side) == F.col("_cy"))


def pack(*columns: tuple[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns])


def flat(b: Column, prefix: str) -> list[tuple[str, Column]]:
    return [(f"{prefix}_{n}", b[n]) for n in bx.EDGES]


#: Below this IoU, size and distance bound too little and boxes meet in uniform cells.
LEAST_IOU = 0.1
#: Most boxes of the right side in one cell of ``near_pairs``; fuller cells are dealt out.
CELL_ROWS = 1024


def _places(lo: Column, hi: Column, t: float, base: float) -> Column:
    """Along one axis, the (size class, cell) pairs that may hold a partner of a box from ``lo`` to ``hi``."""
    size, middle, log = hi - lo, (lo + hi) / 2, math.log(base)
    classes = F.sequence(
        F.floor(F.ln(size * t) / log - 1e-9).cast("int"), F.floor(F.ln(size / t) / log + 1e-9).cast("int"))

    def cells(k: Column) -> Column:
        largest = F.pow(F.lit(base), k + 1)
        far = (F.least(largest, size / t) + size) * ((1 - t) / (2 * (1 + t)) * (1 + 1e-9)) + 1e-9
        side = largest / 2
        spots = F.sequence(F.floor((middle - far) / side), F.floor((middle + far) / side))
        return F.transform(spots, lambda c: F.struct(k.alias("k"), c.alias("c")))

    return F.flatten(F.transform(classes, cells))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], t: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs ``(keys, l_ord, r_ord, iou)`` with IoU >= ``t`` > 0 of boxes (``ord``, ``box``) of one group, each once.

    Boxes whose IoU reaches ``t`` differ in width and height by a factor of 1/t at most, and along each axis their middles
    lie within (1 - t) / (2 (1 + t)) of the sum of their sizes. So a right box goes into one cell of the grid of its size
    class, and a left box into the few cells, of the few classes, that can hold a partner: a cell grows with the boxes
    in it, and large boxes never meet the small ones under them. Cells with more than ``cell_rows`` right boxes
    are dealt out over several tasks.
    """
    base = min(16.0, max(1.5, 1 / (t * t)))
    x1, y1, x2, y2 = (F.col("box")[e] for e in bx.EDGES)
    left, right = (df.filter((x2 > x1) & (y2 > y1)) for df in (left, right))
    place = ["_kx", "_ky", "_cx", "_cy"]

    def own(lo: Column, hi: Column, axis: str) -> list[Column]:
        k = F.floor(F.ln(hi - lo) / math.log(base)).cast("int")
        return [k.alias(f"_k{axis}"), F.floor((lo + hi) / F.pow(F.lit(base), k + 1)).alias(f"_c{axis}")]

    b = right.select(*keys, F.col("ord").alias("r_ord"), F.col("box").alias("r_box"), *own(x1, x2, "x"), *own(y1, y2, "y"))
    a = left.withColumn("_x", F.explode(_places(x1, x2, t, base))).withColumn("_y", F.explode(_places(y1, y2, t, base))).select(
        *keys, F.col("ord").alias("l_ord"), F.col("box").alias("l_box"), F.col("_x.k").alias("_kx"), F.col("_y.k").alias("_ky"),
        F.col("_x.c").alias("_cx"), F.col("_y.c").alias("_cy"))
    on = [*keys, *place]
    full = cut_lineage(b.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_rows))
    if not full.isEmpty():
        parts = bounded_broadcast(full.select(*on, F.ceil(F.col("_n") / cell_rows).cast("int").alias("_parts")))
        b = b.join(parts, on, "left").withColumn("_part", F.pmod(F.xxhash64("r_ord"), F.coalesce("_parts", F.lit(1))).cast("int"))
        a = a.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        a, b, on = a.drop("_parts"), b.drop("_parts"), [*on, "_part"]
    score = bx.iou(F.col("l_box"), F.col("r_box"), "plain")
    return a.join(b, on).filter(score >= t).select(*keys, "l_ord", "r_ord", score.alias("iou"))
